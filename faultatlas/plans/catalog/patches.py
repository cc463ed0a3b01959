"""Queries over anchored edits (G): replies are written from document text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultatlas.operators import patches
from faultatlas.plans.catalog.registry import query, table
from faultatlas.plans.layout import cut


def _block(search: Column, replace: Column) -> Column:
    return F.concat(
        F.lit("<<<<<<< SEARCH\n"), search, F.lit("\n=======\n"), replace, F.lit("\n>>>>>>> REPLACE\n")
    )


def contents(spark, sf_dir):
    """Every document as the file ``docs/D<id>.txt`` of its own patch."""
    key = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        key.alias("patch_id"),
        F.concat(F.lit("docs/D"), key, F.lit(".txt")).alias("file_path"),
        F.col("text").alias("content"),
        "doc_id",
    )


def replies(spark, sf_dir):
    """A reply per document: change its first line; some add a bad second edit."""
    key, number = F.col("patch_id"), F.col("doc_id")
    first = F.get(F.split("content", "\n"), F.lit(0))
    marker = (
        F.when(number % 3 == 0, F.concat(F.lit("### FILE: docs/D"), key, F.lit(".txt\n")))
        .when(number % 3 == 1, F.concat(F.lit("* FILE: ./DOCS\\d"), key, F.lit(".TXT\n")))
        .otherwise("")
    )
    bad = (
        F.when(number % 5 == 0, _block(F.lit("no such text anywhere §"), F.lit("y")))
        .when(number % 7 == 0, F.concat(F.lit("### FILE: other/x.py\n"), _block(F.lit("a"), F.lit("b"))))
        .otherwise("")
    )
    reply = F.when(number % 13 == 0, F.lit("I cannot help.")).otherwise(
        F.concat(F.lit("Here:\n"), marker, _block(first, F.concat(F.lit("X"), first)), bad)
    )
    return contents(spark, sf_dir).select(
        "patch_id", reply.alias("reply"), F.col("file_path").alias("default_path"), "doc_id"
    )


_EDITS_SQL = """d AS (SELECT *, string_split(text, chr(10))[1] AS first_line FROM documents WHERE doc_id % 13 <> 0),
edits AS (
  SELECT doc_id, 1 AS seq, CASE WHEN doc_id % 3 = 1 THEN concat('./DOCS', chr(92), 'd', doc_id, '.TXT') ELSE concat('docs/D', doc_id, '.txt') END AS file_path,
         first_line AS search, concat('X', first_line) AS replace FROM d
  UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 3 = 1 THEN concat('./DOCS', chr(92), 'd', doc_id, '.TXT') ELSE concat('docs/D', doc_id, '.txt') END,
         'no such text anywhere §', 'y' FROM d WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, 2, 'other/x.py', 'a', 'b' FROM d WHERE doc_id % 7 = 0 AND doc_id % 5 <> 0)"""


@query("parsed_edits", f"WITH {_EDITS_SQL} SELECT CAST(doc_id AS VARCHAR) AS patch_id, CAST(seq AS BIGINT) AS seq, file_path, md5(search) AS search, md5(replace) AS replace FROM edits")
def parsed_edits(spark, sf_dir):
    edits = patches.parse_edits(replies(spark, sf_dir))
    return edits.select(
        "patch_id", F.col("seq").cast("bigint").alias("seq"), "file_path", F.md5("search").alias("search"), F.md5("replace").alias("replace")
    )


def _matched(spark, sf_dir):
    edits = patches.parse_edits(replies(spark, sf_dir))
    context = contents(spark, sf_dir).select("patch_id", F.col("file_path").alias("path"))
    return patches.match_edit_paths(edits, context)


@query("matched_edits", f"""WITH {_EDITS_SQL} SELECT CAST(doc_id AS VARCHAR) AS patch_id, CAST(seq AS BIGINT) AS seq,
  CASE WHEN file_path = 'other/x.py' THEN 'unknown' ELSE concat('docs/D', doc_id, '.txt') END AS target FROM edits""")
def matched_edits(spark, sf_dir):
    matched, unknown = _matched(spark, sf_dir)
    columns = ["patch_id", F.col("seq").cast("bigint").alias("seq")]
    return matched.select(*columns, F.col("file_path").alias("target")).unionByName(
        unknown.select(*columns, F.lit("unknown").alias("target"))
    )


@query("unsafe_paths", """SELECT CAST(doc_id AS VARCHAR) AS patch_id, doc_id % 4 IN (0, 3) AS safe FROM documents""")
def unsafe_paths(spark, sf_dir):
    key = F.col("doc_id")
    path = (
        F.when(key % 4 == 1, "../x")
        .when(key % 4 == 2, "/etc/x")
        .when(key % 4 == 3, "a/../b/./c.py")
        .otherwise("a/b.py")
    )
    edits = table(spark, sf_dir, "documents").select(key.cast("string").alias("patch_id"), path.alias("file_path"))
    safe, unsafe = patches.reject_unsafe_paths(edits)
    return safe.select("patch_id", F.lit(True).alias("safe")).unionByName(unsafe.select("patch_id", F.lit(False).alias("safe")))


# Occurrences of the first line decide the first edit; the second edit never fits.
_APPLIED_SQL = f"""{_EDITS_SQL},
fixed AS (SELECT *, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS body,
    replace(replace(first_line, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS anchor FROM d),
counted AS (SELECT *, CASE WHEN anchor = '' THEN 0 ELSE (length(body) - length(replace(body, anchor, ''))) // length(anchor) END AS places FROM fixed),
applied AS (SELECT doc_id, concat('docs/D', doc_id, '.txt') AS file_path, CASE WHEN places = 1 THEN concat('X', body) ELSE body END AS new_content,
    CASE WHEN places = 1 THEN 1 ELSE 0 END AS edits_applied, 1 + (CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) AS edits_total,
    (CASE WHEN places = 1 THEN 0 ELSE 1 END) + (CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) AS error_count FROM counted)"""


def _applied(spark, sf_dir):
    matched, unknown = _matched(spark, sf_dir)
    return patches.apply_edits(contents(spark, sf_dir).drop("doc_id"), matched), unknown


@query("applied_edits", f"""WITH {_APPLIED_SQL} SELECT CAST(doc_id AS VARCHAR) AS patch_id, file_path, md5(new_content) AS new_content,
  CAST(edits_applied AS BIGINT) AS edits_applied, CAST(edits_total AS BIGINT) AS edits_total, CAST(error_count AS BIGINT) AS error_count, edits_applied > 0 AS ok FROM applied""")
def applied_edits(spark, sf_dir):
    applied, _ = _applied(spark, sf_dir)
    return applied.select(
        "patch_id", "file_path", F.md5("new_content").alias("new_content"),
        F.col("edits_applied").cast("bigint").alias("edits_applied"), F.col("edits_total").cast("bigint").alias("edits_total"),
        F.size("errors").cast("bigint").alias("error_count"), "ok",
    )


@query("patch_results", f"""WITH {_APPLIED_SQL}, r AS (
  SELECT o.doc_id, coalesce(edits_applied, 0) AS edits_applied, coalesce(edits_total, 0) + s.stray AS edits_total,
    coalesce(error_count, 0) + s.stray + (CASE WHEN a.doc_id IS NULL THEN 1 ELSE 0 END) AS error_count
  FROM documents o LEFT JOIN applied a USING (doc_id), LATERAL (SELECT CASE WHEN o.doc_id % 7 = 0 AND o.doc_id % 5 <> 0 AND o.doc_id % 13 <> 0 THEN 1 ELSE 0 END AS stray) s)
SELECT CAST(doc_id AS VARCHAR) AS patch_id, CAST(edits_applied AS BIGINT) AS edits_applied, CAST(edits_total AS BIGINT) AS edits_total, CAST(error_count AS BIGINT) AS error_count,
  CASE WHEN edits_applied > 0 THEN concat('docs/D', doc_id, '.txt') ELSE '' END AS changed_files, edits_total > 0 AND edits_applied = edits_total AND error_count = 0 AS ok FROM r""")
def patch_results(spark, sf_dir):
    applied, unknown = _applied(spark, sf_dir)
    asked = contents(spark, sf_dir).select("patch_id")
    results = patches.patch_results(asked, cut(applied), unknown)
    return results.select(
        "patch_id", *[F.col(c).cast("bigint").alias(c) for c in ("edits_applied", "edits_total", "error_count")],
        F.array_join("changed_files", ">").alias("changed_files"), "ok",
    )


@query("patch_errors", f"""WITH {_APPLIED_SQL}, e AS (
  SELECT doc_id, file_path, 0 AS place, CASE WHEN anchor = '' THEN 'Edit 1 does not say what to look for.'
    WHEN places = 0 THEN concat('Edit 1 fits no place; no lines like `', near, '` were found.')
    ELSE concat('Edit 1 fits ', places, ' places; more lines around `', near, '` would tell them apart.') END AS error
  FROM (SELECT *, left(regexp_extract(regexp_replace(anchor, '^\\s+', ''), '^[^\\n]*'), 80) AS near,
          concat('docs/D', doc_id, '.txt') AS file_path FROM counted) WHERE places <> 1
  UNION ALL SELECT doc_id, concat('docs/D', doc_id, '.txt'), CASE WHEN places = 1 THEN 0 ELSE 1 END,
    'Edit 2 fits no place; no lines like `no such text anywhere §` were found.' FROM counted WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, 'other/x.py', 0, 'The reply edits `other/x.py`, which is not part of this change.' FROM d WHERE doc_id % 7 = 0 AND doc_id % 5 <> 0
  UNION ALL SELECT doc_id, NULL, 0, 'The reply has no edit block.' FROM documents WHERE doc_id % 13 = 0)
SELECT CAST(doc_id AS VARCHAR) AS patch_id, file_path, place, left(error, 25) AS error, length(error) > 25 AS long FROM e""")
def patch_errors(spark, sf_dir):
    """Every error of every reply; of the sentences the first words, since anchors are trimmed by another engine's blanks in SQL."""
    applied, unknown = _applied(spark, sf_dir)
    found = patches.patch_errors(contents(spark, sf_dir), cut(applied), unknown)
    return found.select("patch_id", "file_path", "place", F.left("error", F.lit(25)).alias("error"), (F.length("error") > 25).alias("long"))


@query("patch_diffs", f"""WITH {_APPLIED_SQL} SELECT CAST(doc_id AS VARCHAR) AS patch_id, 0 AS part, file_path AS files,
  concat('--- a/', file_path, chr(10), '+++ b/', file_path, chr(10), '@@ -') AS head FROM applied WHERE edits_applied > 0""")
def patch_diffs(spark, sf_dir):
    applied, _ = _applied(spark, sf_dir)
    found = patches.patch_diffs(cut(applied))
    head = F.concat(F.substring_index("unified_diff", "@@ -", 1), F.lit("@@ -"))
    return found.select("patch_id", "part", F.array_join("files", ",").alias("files"), head.alias("head"))


@query("diff_stats", f"""WITH {_APPLIED_SQL} SELECT CAST(doc_id AS VARCHAR) AS patch_id, CAST(CASE WHEN edits_applied > 0 THEN 1 ELSE 0 END AS BIGINT) AS additions,
  CAST(CASE WHEN edits_applied > 0 THEN 1 ELSE 0 END AS BIGINT) AS deletions FROM applied""")
def diff_stats(spark, sf_dir):
    applied, _ = _applied(spark, sf_dir)
    both = applied.join(contents(spark, sf_dir).select("patch_id", "content"), "patch_id")
    counts = patches.diff_stats(F.col("content"), F.col("new_content"))
    return both.select("patch_id", counts.alias("n")).select(
        "patch_id", *[F.col(f"n.{c}").cast("bigint").alias(c) for c in ("additions", "deletions")]
    )


# In the text of a diff, a changed last line without line break swallows the next one.
@query("diff_text_stats", f"""WITH {_APPLIED_SQL} SELECT CAST(doc_id AS VARCHAR) AS patch_id,
  CAST(CASE WHEN edits_applied > 0 AND contains(body, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS additions,
  CAST(CASE WHEN edits_applied > 0 THEN 1 ELSE 0 END AS BIGINT) AS deletions FROM applied JOIN fixed USING (doc_id)""")
def diff_text_stats(spark, sf_dir):
    applied, _ = _applied(spark, sf_dir)
    return patches.diff_text_stats(applied).select(
        "patch_id", *[F.col(c).cast("bigint").alias(c) for c in ("additions", "deletions")]
    )


@query("unified_diffs", """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS lines, len(text) AS n FROM documents),
c AS (SELECT *, len(lines) AS m, least(len(lines), 3) AS shown, len(lines) - least(len(lines), 3) + 1 AS low FROM p)
SELECT doc_id, concat('--- a/d', doc_id, chr(10), '+++ b/d', doc_id, chr(10), '@@ -', low, CASE WHEN shown > 1 THEN concat(',', shown) ELSE '' END, ' +', low, ',', shown + 1, ' @@', chr(10),
  array_to_string([concat(' ', x, chr(10)) FOR x IN lines[low:m]], ''), '+', CAST(n AS VARCHAR), chr(10)) AS diff FROM c""")
def unified_diffs(spark, sf_dir):
    """Every whole text against itself with one more line."""
    old = F.concat("text", F.lit("\n"))
    new = F.concat(old, F.length("text").cast("string"), F.lit("\n"))
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", patches.unified_diff(old, new, path).alias("diff"))
