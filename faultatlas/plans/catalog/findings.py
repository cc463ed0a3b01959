"""Queries over findings and review tables (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultatlas.functions import text
from faultatlas.operators import findings as ops
from faultatlas.operators import impact, reach, review
from faultatlas.plans.catalog import sql, views
from faultatlas.plans.catalog.graph import _ANALYSIS
from faultatlas.plans.catalog.registry import query, table
from faultatlas.plans.layout import cut


def normalized(spark, sf_dir):
    return ops.normalize_paths(views.raw_findings(spark, sf_dir), root="/work/checkout")


def deduped(spark, sf_dir):
    return ops.dedupe_findings(normalized(spark, sf_dir))


@query("normalized_paths", f"WITH {sql.RAW_FINDINGS} SELECT seq, file_path FROM raw_findings")
def normalized_paths(spark, sf_dir):
    return normalized(spark, sf_dir).select("seq", "file_path")


@query("union_findings", f"""WITH {sql.RAW_FINDINGS}
SELECT source_priority, count(*) AS n FROM (
  SELECT 0 AS source_priority FROM raw_findings WHERE tool_source = 'tool2' UNION ALL SELECT 1 FROM raw_findings WHERE tool_source <> 'tool2') GROUP BY 1""")
def union_findings(spark, sf_dir):
    raw = views.raw_findings(spark, sf_dir).drop("source_priority")
    both = ops.union_findings(raw.where("tool_source = 'tool2'"), raw.where("tool_source <> 'tool2'").drop("suggested_fix"))
    return both.groupBy("source_priority").agg(F.count(F.lit(1)).alias("n"))


@query("deduped_findings", f"""WITH {sql.RAW_FINDINGS}
SELECT finding_id, file_path, CAST(line_number AS BIGINT) AS line_number, issue_class, severity, title, tool_source FROM findings""")
def deduped_findings(spark, sf_dir):
    return deduped(spark, sf_dir).select(
        "finding_id", "file_path", F.col("line_number").cast("bigint").alias("line_number"),
        "issue_class", "severity", "title", "tool_source",
    )


@query("fixable_split", f"""WITH {sql.RAW_FINDINGS}
SELECT finding_id, CAST(severity_rank AS BIGINT) AS severity_rank, issue_class <> 'code_quality' AND severity_rank >= 1 AS is_fixable,
  CASE WHEN issue_class = 'code_quality' THEN 'class is report-only' WHEN severity_rank < 1 THEN 'below minimum severity' END AS gate_reason FROM findings""")
def fixable_split(spark, sf_dir):
    gated = ops.gate_findings(deduped(spark, sf_dir))
    return gated.select("finding_id", F.col("severity_rank").cast("bigint").alias("severity_rank"), "is_fixable", "gate_reason")


@query("finding_search", f"""WITH {sql.RAW_FINDINGS}
SELECT finding_id, severity, row_number() OVER (ORDER BY severity_rank DESC, source_priority, seq) AS position FROM findings
WHERE severity IN ('high', 'critical', 'weird') AND issue_class IN ('security_vulnerability', 'functional_bug')
  AND (contains(lower(title), 'issue 1') OR contains(lower(file_path), 'issue 1') OR contains(lower(description), 'issue 1'))""")
def finding_search(spark, sf_dir):
    hits = ops.search_findings(
        deduped(spark, sf_dir), ["high", "critical", "weird"], ["security_vulnerability", "functional_bug"], " Issue 1"
    )
    return hits.select("finding_id", "severity", F.col("position").cast("bigint").alias("position"))


def blast_of_findings(spark, sf_dir, findings, hops=3):
    """Impact measures of the files that have findings, each file once."""
    seeds = findings.select("repo_key", F.col("file_path").alias("file")).distinct()
    return reach.reach_summary(cut(views.file_deps(spark, sf_dir)), views.file_names(spark, sf_dir), hops, seeds)


def members_of_findings(spark, sf_dir, findings, hops=3):
    """What a change of each file with findings reaches, a row each."""
    seeds = findings.select("repo_key", F.col("file_path").alias("file")).distinct()
    return impact.impact_members(impact.impact_paths(cut(views.file_deps(spark, sf_dir)), seeds, hops, paths=False))


@query("enriched_findings", f"""WITH {sql.RAW_FINDINGS}, {sql.impact(3)}, {_ANALYSIS}
SELECT finding_id, f.file_path, a.file_count AS blast_radius, a.direct_dependents, a.related_tests, a.module_count, a.confidence AS impact_confidence,
  coalesce(root_cause, concat('Potential ', issue_class, ' in ', f.file_path, ' affecting ', CAST(a.file_count AS VARCHAR), ' files.')) AS root_cause
FROM findings f JOIN analysed a ON a.file = f.file_path WHERE issue_class <> 'code_quality' AND severity_rank >= 1""")
def enriched_findings(spark, sf_dir):
    fixable, _ = ops.split_fixable(deduped(spark, sf_dir))
    fixable = cut(fixable)
    blast = blast_of_findings(spark, sf_dir, fixable)
    counts = ("blast_radius", "direct_dependents", "related_tests", "module_count")
    return ops.enrich_findings(fixable, blast).select(
        "finding_id", "file_path", *[F.col(c).cast("bigint").alias(c) for c in counts], "impact_confidence", "root_cause"
    )


# -------------------------------------------------------------------- review

@query("review_ranking", f"""WITH {sql.FILE_DEPS}, ends AS (SELECT consumer AS path FROM deps UNION ALL SELECT dependency FROM deps),
d AS (SELECT path, count(*) AS degree FROM ends GROUP BY path)
SELECT f.path, coalesce(degree, 0) AS degree, CAST(p_size * 100 AS BIGINT) AS size,
  row_number() OVER (ORDER BY coalesce(degree, 0) DESC, p_size DESC, f.path) AS position
FROM files f JOIN part ON p_partkey = f.k LEFT JOIN d ON d.path = f.path WHERE p_size * 100 <= 4000""")
def review_ranking(spark, sf_dir):
    deps = views.file_deps(spark, sf_dir)
    edges = deps.select("repo_key", F.col("consumer").alias("src"), F.col("dependency").alias("dst"))
    ranked = review.rank_files_for_review(views.file_names(spark, sf_dir), edges, max_bytes=4000)
    return ranked.select("path", "degree", "size", F.col("position").cast("bigint").alias("position"))


def document_files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.lit(views.REPO).alias("repo_key"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("text").alias("content"),
        "doc_id",
    )


_LINES = """l AS (
  SELECT *, CASE WHEN parts[-1] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS lines FROM (
    SELECT *, string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS parts FROM documents))"""


def _numbered(limit: int) -> str:
    return f"""concat(array_to_string([concat(CAST(i AS VARCHAR), ': ', lines[i]) FOR i IN generate_series(1, least(len(lines), {limit}))], chr(10)),
    CASE WHEN len(lines) > {limit} THEN concat(chr(10), '... (', CAST(len(lines) - {limit} AS VARCHAR), ' more lines truncated)') ELSE '' END)"""


@query("numbered_lines", f"WITH {_LINES} SELECT doc_id, md5({_numbered(12)}) AS numbered, md5({_numbered(1_000_000_000)}) AS whole FROM l")
def numbered_lines(spark, sf_dir):
    content = F.col("content")
    return document_files(spark, sf_dir).select(
        "doc_id", F.md5(text.number_lines(content, 12)).alias("numbered"), F.md5(text.number_lines(content, None)).alias("whole")
    )


@query("snippets", f"""WITH {_LINES}, r AS (SELECT *, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 17 END AS n FROM l)
SELECT doc_id, md5(CASE WHEN n BETWEEN 1 AND len(lines) THEN array_to_string(lines[greatest(n - 3, 1):least(n + 3, len(lines))], chr(10)) ELSE '' END) AS snippet FROM r""")
def snippets(spark, sf_dir):
    line = F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 17).cast("int"))
    return document_files(spark, sf_dir).select("doc_id", F.md5(text.snippet(F.col("content"), line)).alias("snippet"))


def _neighbour_documents(spark, sf_dir):
    """Each document is related to the next four by number."""
    rows = table(spark, sf_dir, "documents").select(F.lit(views.REPO).alias("repo_key"), "doc_id")
    return rows.select(
        "repo_key",
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"),
        F.posexplode(F.sequence(F.col("doc_id") + 1, F.col("doc_id") + 4)).alias("at", "other"),
    ).select(
        "repo_key", "file", (F.col("at") + 1).alias("position"),
        F.concat(F.lit("doc/"), F.col("other").cast("string"), F.lit(".txt")).alias("related"),
    )


_CONTEXT = """context AS (
  SELECT a.doc_id, string_agg(concat('### doc/', b.doc_id, '.txt', chr(10), '```', chr(10), left(b.text, 8000), chr(10), '```'), concat(chr(10), chr(10)) ORDER BY b.doc_id) AS context
  FROM documents a JOIN documents b ON b.doc_id IN (a.doc_id + 1, a.doc_id + 2) GROUP BY a.doc_id)"""


@query("related_context", f"WITH {_CONTEXT} SELECT concat('doc/', doc_id, '.txt') AS path, md5(context) AS context FROM context")
def related_context(spark, sf_dir):
    contexts = review.related_context(document_files(spark, sf_dir), _neighbour_documents(spark, sf_dir))
    return contexts.select("path", F.md5("context").alias("context"))


def _summaries(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.lit(views.REPO).alias("repo_key"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"),
        F.concat(F.lit("Language: "), "lang").alias("summary"),
    )


_REQUEST_HEAD = f"""concat('File: doc/', doc_id, '.txt', chr(10), 'Repository relationships:', chr(10), 'Language: ', lang, chr(10), '```', chr(10), {_numbered(1200)}, chr(10), '```')"""


@query("triage_requests", f"WITH {_LINES} SELECT concat('doc/', doc_id, '.txt') AS path, md5({_REQUEST_HEAD}) AS request FROM l WHERE regexp_matches(text, '\\S')")
def triage_requests(spark, sf_dir):
    requests = review.triage_requests(document_files(spark, sf_dir).drop("doc_id"), _summaries(spark, sf_dir))
    return requests.select("path", F.md5("request").alias("request"))


@query("confirm_requests", f"""WITH {_LINES}, {_CONTEXT}, c AS (
  SELECT doc_id, string_agg(concat('- line ', quality, ': [bug/low] toxic ', toxic, ' — label'), chr(10) ORDER BY quality, toxic) AS candidates FROM labels GROUP BY doc_id)
SELECT concat('doc/', l.doc_id, '.txt') AS path, md5(concat({_REQUEST_HEAD.replace('doc_id', 'l.doc_id')}, chr(10), 'Related files:', chr(10),
  coalesce(context, 'No additional file content available.'), chr(10), 'Candidate issues:', chr(10), candidates)) AS request
FROM l JOIN c USING (doc_id) LEFT JOIN context USING (doc_id)""")
def confirm_requests(spark, sf_dir):
    files = document_files(spark, sf_dir)
    candidates = table(spark, sf_dir, "labels").join(files.select("repo_key", "path", "doc_id"), "doc_id").select(
        "repo_key", "path", (F.col("quality") * 2 + F.col("toxic")).alias("seq"), F.lit("bug").alias("class"),
        F.lit("low").alias("severity"), F.col("quality").alias("line"),
        F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("title"), F.lit("label").alias("why"),
    )
    contexts = review.related_context(files, _neighbour_documents(spark, sf_dir))
    requests = review.confirm_requests(files.drop("doc_id"), _summaries(spark, sf_dir), contexts, candidates)
    return requests.select("path", F.md5("request").alias("request"))


_NUMBERED_CONTEXT = f"""numbered_context AS (
  SELECT a.doc_id, string_agg(concat('### FILE: doc/', b.doc_id, '.txt', chr(10), '```', chr(10), b.body, chr(10), '```'), concat(chr(10), chr(10)) ORDER BY b.doc_id) AS context
  FROM documents a JOIN (SELECT doc_id, strlen(text) AS bytes, {_numbered(1_000_000_000)} AS body FROM l) b
    ON b.doc_id IN (a.doc_id + 1, a.doc_id + 2, a.doc_id + 3) AND b.bytes <= 20000 GROUP BY a.doc_id)"""


@query("repair_requests", f"""WITH {_LINES}, {_NUMBERED_CONTEXT}
SELECT concat('doc/', l.doc_id, '.txt') AS path, md5(concat_ws(chr(10), concat('Fix the following issue(s) originating in `doc/', l.doc_id, '.txt` with minimal anchored edits.'),
  concat('Overall strategy: shorten to ', n_chars), concat('### FILE: doc/', l.doc_id, '.txt'), '```', {_numbered(1_000_000_000)}, '```', context)) AS request
FROM l LEFT JOIN numbered_context USING (doc_id)""")
def repair_requests(spark, sf_dir):
    files = document_files(spark, sf_dir)
    strategies = table(spark, sf_dir, "documents").select(
        F.lit(views.REPO).alias("repo_key"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"),
        F.lit(0).alias("part"),
        F.concat(F.lit("shorten to "), F.col("n_chars").cast("string")).alias("fix_strategy"),
    )
    contexts = review.related_context(
        files, _neighbour_documents(spark, sf_dir), k=3, chars=None, max_bytes=review.MAX_RELATED_BYTES, numbered=True
    )
    requests = review.repair_requests(files.drop("doc_id"), strategies, contexts)
    return requests.select("path", F.md5("request").alias("request"))
