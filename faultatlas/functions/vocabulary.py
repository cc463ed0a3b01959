"""Severities, issue classes and the patterns of the critical-path rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultatlas.functions.text import literal_map

# Severity -> rank; every other text ranks 1.
SEVERITY_RANK = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}

# Severities in report order.
SEVERITIES = ["critical", "high", "medium", "low", "info"]

# The four issue classes.
ISSUE_CLASSES = [
    "functional_bug",
    "security_vulnerability",
    "code_quality",
    "performance",
]

# Spellings a model reply may use for an issue class.
ISSUE_CLASS_ALIASES = {
    "security_vulnerability": "security_vulnerability",
    "security": "security_vulnerability",
    "functional_bug": "functional_bug",
    "functional": "functional_bug",
    "bug": "functional_bug",
    "performance": "performance",
    "code_quality": "code_quality",
    "quality": "code_quality",
}

# Issue classes that are fixed by default.
AUTO_FIX_CLASSES = ["security_vulnerability", "functional_bug", "performance"]

# Languages a review covers.
REVIEW_LANGUAGES = ["python", "javascript", "typescript", "jsx", "tsx", "c", "cpp"]

# Patterns of security-relevant files and functions, any case.
CRITICAL_FILE_PATTERNS = [
    ".*auth.*\\.py",
    ".*jwt.*",
    ".*crypto.*",
    ".*password.*",
    ".*login.*",
    ".*session.*",
    ".*oauth.*",
]
CRITICAL_FUNCTION_PATTERNS = [
    ".*authenticate.*",
    ".*authorize.*",
    ".*hash.*",
    ".*encrypt.*",
    ".*sign.*",
]

# Phases of a run, in order; the position is the phase index.
RUN_PHASES = [
    "cloning",
    "phase_1_discovery",
    "phase_2_investigation",
    "phase_3_planning",
    "phase_4_fix_validate",
    "phase_5_publication",
]


def severity_rank(severity: Column) -> Column:
    """Numeric order of a severity, 0 for info up to 4 for critical, 1 if unknown."""
    ranked = literal_map({k: str(v) for k, v in SEVERITY_RANK.items()})
    return F.coalesce(F.try_element_at(ranked, severity).cast("int"), F.lit(1))


def matches_any(text: Column, patterns: list[str]) -> Column:
    """One alternation instead of one regex pass per pattern, any case."""
    return text.rlike("(?i)(?:" + "|".join(patterns) + ")")


def phase_index(phase: Column, phases: list[str] | None = None) -> Column:
    """0-based position of a phase; null for a phase outside the list."""
    position = F.array_position(F.array(*[F.lit(p) for p in phases or RUN_PHASES]), phase)
    return F.when(position > 0, position.cast("int") - 1)
