"""D: the findings pipeline - union, normalise, dedupe, gate, enrich, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultatlas import schemas
from faultatlas.functions import text
from faultatlas.functions.vocabulary import (
    AUTO_FIX_CLASSES,
    ISSUE_CLASS_ALIASES,
    SEVERITY_RANK,
    severity_rank,
)
from faultatlas.plans.layout import rank_within, top_per

_FINDING_FIELDS = [part.replace("`", "").split(" ") for part in schemas.FINDINGS.split(", ")]


def finding_id(repo_key: Column, file_path: Column, line: Column, issue_class: Column, title: Column, tool: Column) -> Column:
    """Repeatable id: a hash of what identifies the finding."""
    parts = [repo_key, file_path, line.cast("string"), issue_class, title, tool]
    return F.substring(
        F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 16
    )


def as_findings(df: DataFrame, **columns: Column) -> DataFrame:
    """Project ``df`` to the findings schema; fields not given are null."""
    given = {"repo_key": F.col("repo_key"), "confidence": F.lit(0.0), **columns}
    if "finding_id" not in given:
        given["finding_id"] = finding_id(
            given["repo_key"],
            given["file_path"],
            given.get("line_number", F.lit(None)),
            given["issue_class"],
            given["title"],
            given["tool_source"],
        )
    return df.select(
        *[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in _FINDING_FIELDS]
    )


def union_findings(*sources: DataFrame) -> DataFrame:
    """Findings of all tools; an earlier argument wins later ties."""
    tagged = [df.withColumn("source_priority", F.lit(i)) for i, df in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def normalize_paths(findings: DataFrame, root: str | None = None, column: str = "file_path") -> DataFrame:
    """Repository-relative POSIX paths.

    A path below ``root`` loses the root; a relative path is resolved; anything
    that leaves the root keeps its text, less a leading ``./``.
    """
    path = text.posix(F.col(column))
    fallback = F.regexp_replace(path, "^\\./", "")
    relative = path
    if root is not None:
        prefix = root.rstrip("/") + "/"
        relative = F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)
    relative = F.regexp_replace(relative, "^(\\./)+", "")
    # Only a path with an empty, ``.`` or ``..`` part needs the fold over its parts.
    resolved = (
        F.when(relative.startswith("/"), fallback)
        .when(relative.rlike("(^|/)\\.{0,2}(/|$)"), F.coalesce(text.collapse_path(relative), fallback))
        .otherwise(relative)
    )
    return findings.withColumn(column, resolved)


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """D3: keep the first of equal findings.

    With a line the place and class decide; without one the title does too.  The
    rank filter keeps one row per key before the shuffle, so a key that a tool
    repeats without end costs nothing to move.
    """
    titled = findings.withColumn(
        "_title_key",
        F.when(F.col("line_number").isNull(), F.lower(text.strip(F.col("title")))),
    )
    keys = ["repo_key", "file_path", "line_number", "issue_class", "_title_key"]
    return top_per(titled, keys, [F.col("source_priority"), F.col("seq")]).drop("_title_key")


def gate_findings(
    findings: DataFrame,
    auto_fix_classes: list[str] | None = None,
    fix_code_quality: bool = False,
    min_severity: str = "low",
) -> DataFrame:
    """``is_fixable`` and, for the others, why not (``gate_reason``)."""
    allowed = auto_fix_classes or AUTO_FIX_CLASSES
    floor = SEVERITY_RANK.get(min_severity, 1)
    issue_class = F.col("issue_class")
    quality = issue_class == "code_quality"
    if fix_code_quality:
        class_ok = quality | issue_class.isin(allowed)
    else:
        class_ok = ~quality & issue_class.isin(allowed)
    rank = severity_rank(F.col("severity"))
    return findings.select(
        "*",
        rank.alias("severity_rank"),
        (class_ok & (rank >= floor)).alias("is_fixable"),
        F.when(~class_ok, "class is report-only")
        .when(rank < floor, "below minimum severity")
        .alias("gate_reason"),
    )


def split_fixable(findings: DataFrame, **rules) -> tuple[DataFrame, DataFrame]:
    """(fixable, report-only)."""
    gated = gate_findings(findings, **rules)
    return gated.where("is_fixable"), gated.where("not is_fixable")


def map_model_findings(items: DataFrame) -> DataFrame:
    """Items of a model reply (see ``read_model_findings``) to findings.

    ``items`` has repo_key, path, content and the raw text fields of an item.
    Rows of an unknown class are dropped; a line that is no number becomes null.
    """
    aliases = text.literal_map(ISSUE_CLASS_ALIASES)
    mapped = items.withColumn("_class", F.try_element_at(aliases, F.lower("class"))).where(
        F.col("_class").isNotNull()
    )
    severity = F.lower(F.coalesce("severity", F.lit("medium")))
    line = F.col("line").try_cast("int")
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("Issue"))
    description = F.coalesce(F.nullif("description", F.lit("")), F.nullif("why", F.lit("")), F.lit(""))
    return as_findings(
        mapped,
        issue_class=F.col("_class"),
        severity=F.when(severity.isin(list(SEVERITY_RANK)), severity).otherwise("medium"),
        title=F.left(text.strip(title), F.lit(120)),
        description=text.strip(description),
        file_path=F.col("path"),
        line_number=line,
        code_snippet=text.snippet(F.coalesce("content", F.lit("")), line),
        tool_source=F.lit("llm"),
        confidence=F.lit(0.8),
        root_cause=text.blank_to_null(F.col("root_cause")),
        evidence=text.blank_to_null(F.col("evidence")),
        suggested_fix=text.blank_to_null(F.col("suggested_fix")),
        seq=F.col("seq"),
    )


def enrich_findings(findings: DataFrame, blast: DataFrame) -> DataFrame:
    """Impact measures of the finding's file, and a root cause for all.

    ``blast`` has one row per (repo_key, file); it is computed once per distinct
    file, never per finding.  The member lists stay in the long tables of
    ``impact`` - copying them to every finding would multiply them.
    """
    measures = blast.select(
        "repo_key",
        F.col("file").alias("file_path"),
        F.col("file_count").alias("blast_radius"),
        "direct_dependents",
        "related_tests",
        "module_count",
        F.col("confidence").alias("impact_confidence"),
    )
    joined = findings.join(measures, ["repo_key", "file_path"], "left")
    counts = ["blast_radius", "direct_dependents", "related_tests", "module_count"]
    filled = joined.fillna(0, counts).fillna("low", ["impact_confidence"])
    return filled.withColumn("root_cause", root_cause_or_default())


def root_cause_or_default() -> Column:
    """The given root cause, else a sentence about class, file and reach."""
    default = F.format_string(
        "Potential %s in %s affecting %d files.",
        F.col("issue_class"),
        F.col("file_path"),
        F.col("blast_radius"),
    )
    return F.coalesce(F.nullif("root_cause", F.lit("")), default)


def search_findings(
    findings: DataFrame,
    severities: list[str] | None = None,
    issue_classes: list[str] | None = None,
    needle: str = "",
) -> DataFrame:
    """Filter by severity, class and a text in title, path or description.

    ``position`` is the rank by falling severity inside the repository; callers
    page by it, so no global sort is needed.
    """
    hits = findings
    if severities is not None:
        hits = hits.where(F.col("severity").isin(severities))
    if issue_classes is not None:
        hits = hits.where(F.col("issue_class").isin(issue_classes))
    wanted = needle.strip().lower()
    if wanted:
        fields = [F.col("title"), F.col("file_path"), F.coalesce("description", F.lit(""))]
        hits = hits.where(
            reduce(lambda a, b: a | b, [F.contains(F.lower(f), F.lit(wanted)) for f in fields])
        )
    order = [severity_rank(F.col("severity")).desc(), F.col("source_priority"), F.col("seq")]
    return rank_within(hits, ["repo_key"], order)
