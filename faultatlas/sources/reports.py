"""Tool reports, one document per row, to rows of findings.

Every reader is a projection plus one generator: the parts of a report are built
as one array of structs and exploded once, so a document is parsed once.
"""

from __future__ import annotations

import json
import math
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultatlas.functions import text
from faultatlas.operators.findings import as_findings

# Task code travels with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BANDIT = (
    "struct<errors:array<struct<filename:string,reason:string>>,"
    "results:array<struct<issue_severity:string,test_name:string,issue_text:string,"
    "filename:string,line_number:int,code:string,test_id:string>>>"
)
_ESLINT = (
    "array<struct<filePath:string,messages:array<struct<severity:int,ruleId:string,"
    "message:string,line:int,column:int>>>>"
)
_PIP_AUDIT = (
    "struct<dependencies:array<struct<name:string,vulns:array<struct<id:string,description:string>>>>>"
)
_NPM_AUDIT = (
    "struct<advisories:map<string,struct<severity:string,module_name:string,title:string,overview:string>>>"
)
_SAFETY_ITEMS = "array<struct<package_name:string,vulnerability_spec:string>>"

# Severities of the tools.
BANDIT_SEVERITY = {"HIGH": "high", "MEDIUM": "medium", "LOW": "low"}
NPM_SEVERITY = {"critical": "critical", "high": "high", "moderate": "medium", "low": "low"}

# Fixed value: the shape of a compiler error line.
COMPILER_ERROR = r"(?dm)^([^:\n]+):(\d+):(?:(\d+):)?\s*(?:fatal )?error:\s*(.+)$"

# Keys under which a model reply may hold its list, in this order.
REPLY_LIST_KEYS = ["issues", "findings", "results", "candidates"]


def _or(value: Column, default: str) -> Column:
    return F.coalesce(value, F.lit(default))


def read_bandit_report(documents: DataFrame, column: str = "document") -> DataFrame:
    """A2: parse errors become high functional bugs, results security findings."""
    report = F.from_json(column, _BANDIT)

    def error(e: Column) -> Column:
        reason = _or(e["reason"], "file failed to parse")
        return F.struct(
            F.lit("functional_bug").alias("issue_class"),
            F.lit("high").alias("severity"),
            F.concat(F.lit("Bandit could not parse file: "), F.left(reason, F.lit(80))).alias("title"),
            F.concat(
                F.lit("`"), e["filename"], F.lit("` could not be analyzed ("), reason,
                F.lit(") — usually a Python syntax error."),
            ).alias("description"),
            e["filename"].alias("file_path"),
            F.lit(None).cast("int").alias("line_number"),
            F.lit(None).cast("string").alias("code_snippet"),
            F.lit("B000-parse-error").alias("rule_id"),
        )

    def result(r: Column) -> Column:
        severity = F.try_element_at(text.literal_map(BANDIT_SEVERITY), r["issue_severity"])
        return F.struct(
            F.lit("security_vulnerability").alias("issue_class"),
            _or(severity, "medium").alias("severity"),
            F.concat(F.lit("Bandit: "), _or(r["test_name"], "Issue")).alias("title"),
            _or(r["issue_text"], "").alias("description"),
            _or(r["filename"], "").alias("file_path"),
            r["line_number"].alias("line_number"),
            _or(r["code"], "").alias("code_snippet"),
            r["test_id"].alias("rule_id"),
        )

    named = F.filter("_report.errors", lambda e: _or(e["filename"], "") != "")
    rows = F.concat(
        F.coalesce(F.transform(named, error), F.array().cast(_finding_array())),
        F.coalesce(F.transform("_report.results", result), F.array().cast(_finding_array())),
    )
    found = documents.select("repo_key", report.alias("_report")).select("repo_key", F.inline(rows))
    return _findings_from(found, "bandit")


def _finding_array() -> str:
    return (
        "array<struct<issue_class:string,severity:string,title:string,description:string,"
        "file_path:string,line_number:int,code_snippet:string,rule_id:string>>"
    )


def _findings_from(found: DataFrame, tool: str, **extra: Column) -> DataFrame:
    given = {
        c: F.col(c)
        for c in ("issue_class", "severity", "title", "description", "file_path", "line_number",
                  "column", "code_snippet", "rule_id")
        if c in found.columns
    }
    return as_findings(found, tool_source=F.lit(tool), **given, **extra)


def read_eslint_report(documents: DataFrame, column: str = "document") -> DataFrame:
    """A3: messages of severity 2 and up."""
    entries = documents.select("repo_key", F.explode(F.from_json(column, _ESLINT)).alias("entry"))
    messages = entries.select(
        "repo_key", F.col("entry.filePath").alias("path"), F.explode("entry.messages").alias("m")
    ).where(F.col("m.severity") >= 2)
    return as_findings(
        messages,
        issue_class=F.lit("functional_bug"),
        severity=F.lit("medium"),
        title=F.concat(F.lit("ESLint: "), _or(F.col("m.ruleId"), "error")),
        description=_or(F.col("m.message"), ""),
        file_path=_or(F.col("path"), ""),
        line_number=F.col("m.line"),
        column=F.col("m.column"),
        tool_source=F.lit("eslint"),
        rule_id=F.col("m.ruleId"),
    )


def read_pip_audit_report(documents: DataFrame, column: str = "document") -> DataFrame:
    """A4: documents carry ``path``, the requirement file that was audited."""
    deps = documents.select(
        "repo_key", "path", F.explode(F.from_json(column, _PIP_AUDIT)["dependencies"]).alias("d")
    )
    vulns = deps.select("repo_key", "path", F.col("d.name").alias("name"), F.explode("d.vulns").alias("v"))
    return as_findings(
        vulns,
        issue_class=F.lit("security_vulnerability"),
        severity=F.lit("high"),
        title=F.concat(F.lit("CVE in "), _or(F.col("name"), "unknown"), F.lit(": "), _or(F.col("v.id"), "CVE-?")),
        description=_or(F.col("v.description"), "Known vulnerability in dependency"),
        file_path=F.col("path"),
        tool_source=F.lit("pip-audit"),
        rule_id=F.col("v.id"),
    )


def read_npm_audit_report(documents: DataFrame, column: str = "document") -> DataFrame:
    """A5: the ``advisories`` map, its key as rule."""
    rows = documents.select(
        "repo_key", F.explode(F.from_json(column, _NPM_AUDIT)["advisories"]).alias("advisory", "a")
    )
    severity = F.try_element_at(text.literal_map(NPM_SEVERITY), F.col("a.severity"))
    return as_findings(
        rows,
        issue_class=F.lit("security_vulnerability"),
        severity=_or(severity, "medium"),
        title=F.concat(F.lit("npm: "), _or(F.col("a.module_name"), "unknown"), F.lit(" - "), _or(F.col("a.title"), "")),
        description=_or(F.col("a.overview"), ""),
        file_path=F.lit("package.json"),
        tool_source=F.lit("npm-audit"),
        rule_id=F.col("advisory"),
    )


def read_safety_report(documents: DataFrame, column: str = "document") -> DataFrame:
    """A bare list, or an object with ``vulnerabilities``."""
    bare = F.ltrim(column).startswith("[")
    items = F.when(bare, F.from_json(column, _SAFETY_ITEMS)).otherwise(
        F.from_json(column, f"struct<vulnerabilities:{_SAFETY_ITEMS}>")["vulnerabilities"]
    )
    rows = documents.select("repo_key", F.explode(items).alias("v"))
    return as_findings(
        rows,
        issue_class=F.lit("security_vulnerability"),
        severity=F.lit("high"),
        title=F.concat(F.lit("Safety: "), _or(F.col("v.package_name"), "unknown"), F.lit(" vulnerability")),
        description=_or(F.col("v.vulnerability_spec"), ""),
        file_path=F.lit("requirements.txt"),
        tool_source=F.lit("safety"),
    )


def read_compiler_log(logs: DataFrame, per_file: int = 3) -> DataFrame:
    """(repo_key, path, log), one compiler run per row, to findings.

    Only errors in the checked file itself count, missing headers do not, and a
    run gives its first ``per_file`` errors.  The cut is inside the row: no
    shuffle.
    """
    def parts(match: Column) -> Column:
        def group(i: int) -> Column:
            return F.regexp_extract(match, COMPILER_ERROR, i)

        return F.struct(
            group(1).alias("file"),
            group(2).try_cast("int").alias("line"),
            F.nullif(group(3), F.lit("")).try_cast("int").alias("column"),
            text.strip(group(4)).alias("message"),
        )

    matches = F.transform(F.regexp_extract_all("log", F.lit(COMPILER_ERROR), F.lit(0)), parts)
    own = F.filter(
        matches,
        lambda m: (text.basename(m["file"]) == text.basename(F.col("path")))
        & ~F.contains(m["message"], F.lit("No such file or directory")),
    )
    rows = logs.select("repo_key", "path", F.posexplode(F.slice(own, 1, per_file)).alias("at", "e"))
    message, line = F.col("e.message"), F.col("e.line")
    return as_findings(
        rows,
        issue_class=F.lit("functional_bug"),
        severity=F.lit("high"),
        title=F.concat(F.lit("C/C++ syntax error: "), F.left(message, F.lit(80))),
        description=F.concat(
            F.lit("`"), "path", F.lit("` fails to compile (line "), line.cast("string"), F.lit("): "), message
        ),
        file_path=F.col("path"),
        line_number=line,
        tool_source=F.lit("repo_mapper:compiler"),
    )


def _plain(value):
    """A parsed value that any JSON parser takes."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {key: _plain(inner) for key, inner in value.items()}
    return [_plain(inner) for inner in value] if isinstance(value, list) else value


def _first_json_span(candidate: str | None) -> str | None:
    """First balanced ``[...]`` or else ``{...}`` that parses; brackets in strings count."""
    for opening, closing in (("[", "]"), ("{", "}")):
        start = (candidate or "").find(opening)
        if start < 0:
            continue
        depth = 0
        for found in re.finditer(f"[{re.escape(opening + closing)}]", candidate[start:]):
            depth += 1 if found.group() == opening else -1
            if depth == 0:
                try:
                    # Written anew: a repeated key keeps its last value, NaN becomes null.
                    return json.dumps(_plain(json.loads(candidate[start : start + found.end()])))
                except (ValueError, RecursionError):
                    break
    return None


@F.pandas_udf(T.StringType())
def _rescue_json(candidates: pd.Series) -> pd.Series:
    return candidates.map(_first_json_span, na_action="ignore")


# So marked, the optimizer neither repeats the call nor moves filters on it below a shuffle.
_rescue_json = _rescue_json.asNondeterministic()


def read_model_findings(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of model replies (repo_key, path, content, reply, seq).

    A fenced block or the whole reply is parsed in the JVM; only a reply that does
    not parse is handed to the bracket search.  Items that are no objects are
    dropped; a reply without any JSON is a reject.
    """
    reply = F.coalesce("reply", F.lit(""))
    fence = r"(?s)```(?:json)?\s*(.*?)```"
    candidate = text.strip(
        F.when(reply.rlike(fence), F.regexp_extract(reply, fence, 1)).otherwise(reply)
    )
    parsed = replies.withColumn("_candidate", candidate).withColumn(
        "_value", F.try_parse_json("_candidate")
    )
    rescued = parsed.withColumn(
        "_span", _rescue_json(F.when(F.col("_value").isNull(), F.col("_candidate")))
    ).withColumn("_value", F.coalesce("_value", F.try_parse_json("_span")))
    rejects = rescued.where(F.col("_value").isNull()).select("repo_key", "path", "seq", "reply")

    lists = [F.try_variant_get("_value", path, "array<variant>")
             for path in ["$", *(f"$.{key}" for key in REPLY_LIST_KEYS)]]

    def field(name: str) -> Column:
        return F.try_variant_get("_item", f"$.{name}", "string").alias(name)

    # A reply without JSON or list has nothing to explode.
    items = (
        rescued.select("repo_key", "path", "content", "seq", F.explode(F.coalesce(*lists)).alias("_item"))
        .where(F.schema_of_variant("_item").startswith("OBJECT"))
        .select(
            "repo_key", "path", "content", "seq",
            *[field(n) for n in ("class", "severity", "title", "description", "why", "evidence", "root_cause", "suggested_fix")],
            F.try_variant_get("_item", "$.line", "int").alias("line"),
        )
    )
    return items, rejects
