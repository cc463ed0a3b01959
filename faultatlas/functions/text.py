"""String helpers with Python's line and whitespace rules, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python treats as whitespace and as line breaks.
_SPACE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"

# File suffix -> language, compared with case.
LANGUAGE_BY_SUFFIX = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".jsx": "jsx",
    ".tsx": "tsx",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".hh": "cpp",
}


def literal_map(mapping: dict[str, str]) -> Column:
    """A constant map column; lookups fold into the projection, no join."""
    quoted = ", ".join("'" + part.replace("'", "\\'") + "'" for pair in mapping.items() for part in pair)
    return F.expr(f"map({quoted})")


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of every kind, not only blanks."""
    return F.regexp_replace(F.regexp_replace(text, f"^{_SPACE}+", ""), f"{_SPACE}+$", "")


def unix_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def lines(text: Column) -> Column:
    """Lines of a text; a final line break does not open another line."""
    pieces = F.split(text, _LINE_BREAK, -1)
    return F.when(
        F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)
    ).otherwise(pieces)


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Directory of a path, the empty string at the top level."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def suffix(path: Column) -> Column:
    """Last suffix with its dot; a leading dot of the name does not count."""
    return F.regexp_extract(path, "[^/](\\.[^./]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), "(?<=.)\\.[^.]+$", "")


def detect_language(path: Column) -> Column:
    return F.try_element_at(literal_map(LANGUAGE_BY_SUFFIX), suffix(path))


def is_python_test(path: Column) -> Column:
    return path.rlike("(^|/)(test_[^/]*|[^/]*_test)\\.py$")


def service_boundary(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise(F.lit("root"))


def collapse_path(path: Column) -> Column:
    """Resolve ``.`` and ``..`` inside a relative path; null when it leaves the root.

    The fold carries the stack of kept parts; one null part marks an escape.
    """
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    escaped = F.array(F.lit(None).cast("string"))

    def step(stack: Column, part: Column) -> Column:
        gone = F.exists(stack, lambda x: x.isNull())
        return (
            F.when(gone, stack)
            .when((part == "..") & (F.size(stack) == 0), escaped)
            .when(part == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0))))
            .otherwise(F.concat(stack, F.array(part)))
        )

    stack = F.aggregate(parts, F.expr("cast(array() as array<string>)"), step)
    return F.when(F.exists(stack, lambda x: x.isNull()), F.lit(None)).otherwise(
        F.array_join(stack, "/")
    )


def is_safe_relative_path(path: Column) -> Column:
    """True for a relative path that stays below the root it is applied to."""
    return ~path.startswith("/") & collapse_path(path).isNotNull()


def number_lines(text: Column, limit: int | None = 1200) -> Column:
    """``n: line`` per line, cut after ``limit`` lines with a note of how many follow."""
    all_lines = lines(text)
    shown = all_lines if limit is None else F.slice(all_lines, 1, limit)
    numbered = F.transform(
        shown, lambda line, i: F.concat((i + 1).cast("string"), F.lit(": "), line)
    )
    if limit is None:
        return F.array_join(numbered, "\n")
    hidden = F.size(all_lines) - limit
    note = F.concat(F.lit("... ("), hidden.cast("string"), F.lit(" more lines truncated)"))
    return F.array_join(
        F.when(hidden > 0, F.concat(numbered, F.array(note))).otherwise(numbered), "\n"
    )


def snippet(text: Column, line: Column, radius: int = 3) -> Column:
    """Lines around a 1-based line; empty when the line is null or outside the text."""
    all_lines = lines(text)
    first = F.greatest(line - radius, F.lit(1))
    last = F.least(line + radius, F.size(all_lines))
    inside = line.isNotNull() & (line >= 1) & (line <= F.size(all_lines))
    return F.when(
        inside, F.array_join(F.slice(all_lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")
    ).otherwise(F.lit(""))


def diff_line_count(diff: Column, sign: str) -> Column:
    """Lines of a unified diff that start with ``sign`` and are not a file header."""
    return F.size(
        F.filter(lines(diff), lambda l: l.startswith(sign) & ~l.startswith(sign * 3))
    )
