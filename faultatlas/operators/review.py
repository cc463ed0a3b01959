"""Which files to review first, and the request tables for batch scoring.

The requests are rows; sending them to a model is not part of this library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultatlas.functions import text
from faultatlas.functions.vocabulary import REVIEW_LANGUAGES
from faultatlas.plans.layout import bounded_list, rank_within, top_per

MAX_REVIEW_BYTES = 60_000
MAX_RELATED_BYTES = 20_000


def rank_files_for_review(
    files: DataFrame, edges: DataFrame, languages: list[str] | None = None,
    max_bytes: int = MAX_REVIEW_BYTES, max_files: int = 0,
) -> DataFrame:
    """Reviewable files by edge count, then size, both falling.

    Only names, languages and sizes are read; the content stays in the table.
    """
    ends = edges.select("repo_key", F.explode(F.array("src", "dst")).alias("path"))
    degree = ends.groupBy("repo_key", "path").agg(F.count(F.lit(1)).alias("degree"))
    fitting = files.where(
        F.col("language").isin(languages or REVIEW_LANGUAGES) & (F.col("size") > 0) & (F.col("size") <= max_bytes)
    ).select("repo_key", "path", "language", "size")
    scored = fitting.join(degree, ["repo_key", "path"], "left").fillna(0, ["degree"])
    order = [F.col("degree").desc(), F.col("size").desc(), F.col("path")]
    if max_files > 0:
        return top_per(scored, ["repo_key"], order, max_files, rank="position")
    return rank_within(scored, ["repo_key"], order)


def numbered_files(files: DataFrame, limit: int | None = 1200) -> DataFrame:
    """File text with line numbers, cut after ``limit`` lines with a note."""
    return files.select("repo_key", "path", text.number_lines(F.col("content"), limit).alias("numbered"))


def related_context(
    files: DataFrame, related: DataFrame, k: int = 2, chars: int | None = 8000,
    max_bytes: int | None = None, numbered: bool = False,
) -> DataFrame:
    """The excerpts of each file's first ``k`` related files, as one text.

    ``chars`` cuts an excerpt; ``max_bytes`` leaves out larger files instead.
    Only the at most ``k`` files that are wanted carry their content.
    """
    wanted = related.where(F.col("position") <= k)
    sources = files.select("repo_key", F.col("path").alias("related"), "content")
    if max_bytes is not None:
        sources = sources.where(F.octet_length("content") <= max_bytes)
    body: Column = F.col("content") if chars is None else F.left("content", F.lit(chars))
    if numbered:
        body, label = text.number_lines(F.col("content"), None), "### FILE: "
    else:
        label = "### "
    chunk = F.concat(F.lit(label), "related", F.lit("\n```\n"), body, F.lit("\n```"))
    chunks = wanted.join(sources, ["repo_key", "related"]).select(
        "repo_key", F.col("file").alias("path"), "position", chunk.alias("chunk")
    )
    joined = bounded_list(chunks, ["repo_key", "path"], [F.col("position")], "chunk", k, "chunks")
    return joined.select("repo_key", "path", F.array_join("chunks", "\n\n").alias("context"))


def triage_requests(files: DataFrame, summaries: DataFrame, limit: int = 1200) -> DataFrame:
    """One request per non-blank file: its relations and its numbered text."""
    readable = files.where(text.strip(F.col("content")) != "")
    joined = readable.join(summaries.withColumnRenamed("file", "path"), ["repo_key", "path"])
    return joined.select(
        "repo_key",
        "path",
        F.concat_ws(
            "\n",
            F.concat(F.lit("File: "), "path"),
            F.lit("Repository relationships:"),
            "summary",
            F.lit("```"),
            text.number_lines(F.col("content"), limit),
            F.lit("```"),
        ).alias("request"),
    )


def confirm_requests(
    files: DataFrame, summaries: DataFrame, contexts: DataFrame, candidates: DataFrame,
    limit: int = 1200, listed: int = 1000,
) -> DataFrame:
    """One request per file with candidates.

    Files without candidates never join, so the costly text is only built for the
    rest.  ``candidates`` is (repo_key, path, seq, class, severity, line, title,
    why); a file with more than ``listed`` of them gets several requests.
    """
    line = F.concat(
        F.lit("- line "), F.coalesce(F.col("line").cast("string"), F.lit("?")),
        F.lit(": ["), F.coalesce("class", F.lit("?")), F.lit("/"), F.coalesce("severity", F.lit("?")), F.lit("] "),
        F.coalesce("title", F.lit("")), F.lit(" — "), F.coalesce("why", F.lit("")),
    )
    ranked = rank_within(candidates, ["repo_key", "path"], [F.col("seq")], "_position").select(
        "repo_key", "path", F.floor((F.col("_position") - 1) / listed).alias("batch"), "seq", line.alias("line_text")
    )
    lists = bounded_list(ranked, ["repo_key", "path", "batch"], [F.col("seq")], "line_text", listed, "lines")
    joined = (
        lists.join(files, ["repo_key", "path"])
        .join(summaries.withColumnRenamed("file", "path"), ["repo_key", "path"])
        .join(contexts, ["repo_key", "path"], "left")
    )
    return joined.select(
        "repo_key",
        "path",
        "batch",
        F.concat_ws(
            "\n",
            F.concat(F.lit("File: "), "path"),
            F.lit("Repository relationships:"),
            "summary",
            F.lit("```"),
            text.number_lines(F.col("content"), limit),
            F.lit("```"),
            F.lit("Related files:"),
            F.coalesce("context", F.lit("No additional file content available.")),
            F.lit("Candidate issues:"),
            F.array_join("lines", "\n"),
        ).alias("request"),
    )


def repair_requests(files: DataFrame, strategies: DataFrame, contexts: DataFrame) -> DataFrame:
    """One request per planned file and part of its instructions.

    A request has the part's instructions, the numbered text, editable neighbours.
    """
    joined = strategies.join(
        files.select("repo_key", F.col("path").alias("file"), "content"), ["repo_key", "file"]
    ).join(contexts.withColumnRenamed("path", "file"), ["repo_key", "file"], "left")
    return joined.select(
        "repo_key",
        F.col("file").alias("path"),
        "part",
        F.concat_ws(
            "\n",
            F.concat(F.lit("Fix the following issue(s) originating in `"), "file", F.lit("` with minimal anchored edits.")),
            F.concat(F.lit("Overall strategy: "), "fix_strategy"),
            F.concat(F.lit("### FILE: "), "file"),
            F.lit("```"),
            text.number_lines(F.col("content"), None),
            F.lit("```"),
            "context",
        ).alias("request"),
    )
