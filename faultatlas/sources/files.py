"""File inventory of a corpus of repositories.

The corpus is a table ``(repo_key, path, content)``: directory listings hide
names that start with ``_`` or ``.``, and package files are such names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultatlas.functions import text
from faultatlas.plans.layout import top_per

# Directories a repository scan skips, besides hidden ones.
SKIPPED_DIRECTORIES = ["venv", "__pycache__", "node_modules", ".git", "build", "dist"]

# Directories whose requirement files are not the repository's own.
VENDORED_DIRECTORIES = ["venv", ".venv", "node_modules"]


def _directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def is_scanned(path: Column) -> Column:
    """No directory on the way is hidden or skipped; a hidden file name is fine."""
    return ~F.exists(
        _directories(path), lambda d: d.startswith(".") | d.isin(SKIPPED_DIRECTORIES)
    )


def load_files(corpus: DataFrame) -> DataFrame:
    """A1/B1/B2: one row per readable file, with language, size and boundary.

    A pure projection, so a query that needs no content reads none.
    """
    path = F.col("path")
    return corpus.where(is_scanned(path) & F.col("content").isNotNull()).select(
        "repo_key",
        "path",
        text.detect_language(path).alias("language"),
        F.octet_length("content").cast("bigint").alias("size"),
        text.service_boundary(path).alias("service_boundary"),
        text.is_python_test(path).alias("is_test"),
        "content",
    )


def find_manifests(corpus: DataFrame, limit: int = 10) -> DataFrame:
    """The files a dependency scan starts from, per repository.

    ``requirements`` rows are the first ``limit`` requirement files in path-part
    order; ``pyproject`` and ``package_json`` rows mark the files at the root.
    """
    paths = corpus.select("repo_key", "path").distinct()
    path = F.col("path")
    vendored = F.exists(F.split(path, "/"), lambda p: p.isin(VENDORED_DIRECTORIES))
    requirements = top_per(
        paths.where(text.basename(path).rlike("^requirements.*\\.txt$") & ~vendored),
        ["repo_key"],
        [F.split(path, "/")],
        limit,
        rank="position",
    ).select("repo_key", F.lit("requirements").alias("kind"), "path", "position")
    roots = paths.where(path.isin("pyproject.toml", "package.json")).select(
        "repo_key",
        F.when(path == "pyproject.toml", "pyproject").otherwise("package_json").alias("kind"),
        "path",
        F.lit(1).alias("position"),
    )
    return requirements.unionByName(roots)
