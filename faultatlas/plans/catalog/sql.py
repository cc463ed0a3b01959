"""SQL twins of ``views``: common table expressions for the checking engine."""

from __future__ import annotations


def stem(key: str) -> str:
    return f"concat(CASE WHEN {key} % 10 = 0 THEN 'test_' ELSE '' END, 'm', lpad(CAST({key} AS VARCHAR), 9, '0'))"


def folder(key: str) -> str:
    return f"concat('svc', CAST(({key} // 7) % 8 AS VARCHAR))"


def path(key: str) -> str:
    return f"concat({folder(key)}, '/', {stem(key)}, '.py')"


def symbol(key: str) -> str:
    return f"concat({path(key)}, '::f_', {stem(key)})"


def is_test(path_column: str) -> str:
    return f"regexp_matches({path_column}, '/test_[^/]*$')"


def boundary(path_column: str) -> str:
    return f"split_part({path_column}, '/', 1)"


CODE_EDGES = """code_edges AS MATERIALIZED (
  SELECT DISTINCT src, dst FROM (
    SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem)
  WHERE src <> dst)"""

# The files asked about: per supplier the part shipped last.
CHANGED = f"""changed AS (
  SELECT DISTINCT {path('k')} AS file FROM (
    SELECT l_suppkey, arg_max(l_partkey, row(l_shipdate, -l_partkey)) AS k FROM lineitem GROUP BY l_suppkey))"""

# Edges that the parser can see: files with k % 97 = 5 do not parse.
FILE_DEPS = f"""{CODE_EDGES},
deps AS MATERIALIZED (
  SELECT src, dst, {path('src')} AS consumer, {path('dst')} AS dependency,
         CASE WHEN (src + dst) % 3 <> 0 THEN 'CALLS' WHEN src % 10 = 0 THEN 'TESTS' ELSE 'IMPORTS' END AS evidence
  FROM code_edges WHERE src % 97 <> 5),
files AS (
  SELECT p_partkey AS k, {path('p_partkey')} AS path, {folder('p_partkey')} AS service_boundary,
         p_partkey % 10 = 0 AS is_test
  FROM part)"""


def impact(hops: int, roots: str | None = None) -> str:
    """Breadth-first levels with the least path, on top of FILE_DEPS; ``roots`` names a table of files."""
    asked = f" WHERE dependency IN (SELECT file FROM {roots})" if roots else ""
    levels = [f"l1 AS MATERIALIZED (SELECT dependency AS root, consumer AS node, 1 AS depth, [dependency, consumer] AS path, evidence FROM deps{asked})"]
    for d in range(2, hops + 1):
        seen = " UNION ALL ".join(f"SELECT root, node FROM l{i}" for i in range(1, d))
        levels.append(f"""l{d} AS MATERIALIZED (
  SELECT root, node, {d} AS depth, p[1] AS path, p[2] AS evidence FROM (
    SELECT l.root, d.consumer AS node, min(row(list_append(l.path, d.consumer), d.evidence)) AS p
    FROM l{d - 1} l JOIN deps d ON d.dependency = l.node
    WHERE d.consumer <> l.root
      AND NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.root = l.root AND s.node = d.consumer)
    GROUP BY 1, 2))""")
    union = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(1, hops + 1))
    levels.append(f"paths AS ({union})")
    levels.append(f"members AS (SELECT *, {is_test('node')} AS is_test, {boundary('node')} AS service_boundary FROM paths)")
    return FILE_DEPS + (f",\n{CHANGED}" if roots == "changed" else "") + ",\n" + ",\n".join(levels)


def seq(*parts: str) -> str:
    joined = ", '|', ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5(concat({joined})), 1, 15)) AS BIGINT)"


_TITLE = "concat(' Issue ', CAST(l_suppkey % 5 AS VARCHAR), ' ')"
_SPELLED = f"""CASE WHEN l_orderkey % 5 = 0 THEN replace({path('l_partkey')}, '/', '\\')
       WHEN l_orderkey % 3 = 0 THEN concat('./', {path('l_partkey')})
       WHEN l_orderkey % 7 = 0 THEN concat('/work/checkout/', {path('l_partkey')})
       ELSE {path('l_partkey')} END"""

RAW_FINDINGS = f"""base_findings AS (
  SELECT 'main' AS repo_key,
    CASE WHEN l_linestatus = 'O' AND l_suppkey % 4 = 0 THEN 'performance'
         WHEN l_returnflag = 'A' THEN 'security_vulnerability'
         WHEN l_returnflag = 'N' THEN 'functional_bug' ELSE 'code_quality' END AS issue_class,
    ['info', 'low', 'medium', 'high', 'critical', 'weird'][CAST(trunc(l_quantity) AS INTEGER) % 6 + 1] AS severity,
    CASE WHEN l_orderkey % 2 = 1 THEN upper({_TITLE}) ELSE {_TITLE} END AS title,
    concat('about part ', CAST(l_partkey AS VARCHAR)) AS description,
    {_SPELLED} AS raw_path,
    {path('l_partkey')} AS file_path,
    CASE WHEN l_linenumber < 7 THEN l_linenumber END AS line_number,
    concat('tool', CAST(l_suppkey % 4 AS VARCHAR)) AS tool_source,
    CASE WHEN l_suppkey % 6 = 0 THEN 'known cause' END AS root_cause,
    CASE WHEN l_suppkey % 10 = 0 THEN 'apply the fix' END AS suggested_fix,
    CAST(l_suppkey % 4 AS INTEGER) AS source_priority,
    {seq('l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey', 'CAST(round(l_extendedprice * 100) AS BIGINT)')} AS seq
  FROM lineitem),
raw_findings AS (
  SELECT *, substr(sha256(concat_ws('|', repo_key, raw_path, CAST(seq AS VARCHAR), issue_class, title, tool_source)), 1, 16) AS finding_id,
    CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 ELSE 1 END AS severity_rank
  FROM base_findings),
findings AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (
      PARTITION BY file_path, line_number, issue_class, CASE WHEN line_number IS NULL THEN lower(trim(title)) END
      ORDER BY source_priority, seq) AS rn
    FROM raw_findings) WHERE rn = 1)"""
