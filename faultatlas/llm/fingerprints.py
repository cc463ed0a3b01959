"""Lempel-Ziv phrase fingerprints of documents.

A text is parsed into dictionary phrases: the shortest run of characters not met
before becomes a phrase, and the next phrase begins behind it.  The set of phrases is
hashed and its smallest hash values are the fingerprint; the share of the smallest
values of two sets that both have estimates how much dictionary the texts share, as a
compressor would see it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNATURE = 64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def parse(text: str, seen: set[str], begin: int, end: int, upto: int) -> tuple[list[int], int]:
    """Phrases of ``text`` from ``begin`` on, looking at the characters ``end`` to ``upto``.

    Returns the ends of the new phrases and the begin of the one still open; ``seen``
    grows by the new phrases.
    """
    ends = []
    for at in range(end + 1, upto + 1):
        phrase = text[begin:at]
        if phrase not in seen:
            seen.add(phrase)
            ends.append(at)
            begin = at
    return ends, begin


def phrase_hashes(text: str, ends: list[int]) -> np.ndarray:
    """Hash of every phrase, by differences of one running sum over the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(points) or not ends:
        return np.empty(0, np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    down = np.cumprod(np.full(len(points), inverse, np.uint64))
    # The powers of the base run up again from any phrase's begin.
    up = np.cumprod(np.full(len(points), _BASE, np.uint64))
    mixed = (points + np.uint64(0x51)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(31)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed * down)])
    stop = np.array(ends)
    start = np.concatenate([[0], stop[:-1]])
    h = (total[stop] - total[start]) * np.where(start > 0, up[start - 1], np.uint64(1))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xA24BAED4963EE407)
    return h ^ (h >> np.uint64(29))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest distinct 32-bit values of a phrase set, in order."""
    values = np.unique((hashes >> np.uint64(32)).astype(np.uint32))
    return values[:SIGNATURE]


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Shared part of the smallest values of both sets; two empty sets are alike."""
    least = np.union1d(x, y)[:SIGNATURE]
    return len(np.intersect1d(np.intersect1d(x, y), least)) / len(least) if len(least) else 1.0


def shown(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def fingerprint(text: str | None) -> np.ndarray:
    """Signature of a whole text; empty for a null or empty one."""
    body = text or ""
    ends, _ = parse(body, set(), 0, 0, len(body))
    return signature(phrase_hashes(body, ends))


def edited(text: str, following: str) -> str:
    """The last third (rounded down) replaced by as many first characters of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def with_edit(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Signatures of a text and of its edited form, which share the parse of their common part."""
    changed = edited(text, following)
    kept = len(text) - len(text) // 3
    seen: set[str] = set()
    ends, begin = parse(text, seen, 0, 0, kept)
    other = set(seen) if kept < len(text) else seen
    more, _ = parse(text, seen, begin, kept, len(text))
    changes, _ = parse(changed, other, begin, kept, len(changed))
    return signature(phrase_hashes(text, ends + more)), signature(phrase_hashes(changed, ends + changes)), changed


def _bucket(key: Column, bounds: list[float]) -> Column:
    """Number of the range a key falls in, from the largest keys down, by halving."""
    if not bounds:
        return F.lit(0)

    def halve(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key > bounds[middle], halve(low, middle)).otherwise(halve(middle + 1, high))

    bounds = sorted({int(b) for b in bounds}, reverse=True)
    return halve(0, len(bounds))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of every whole text, of its edited form, and how near both and the next one are.

    The next document is the one with the next smaller id, after the smallest the
    largest.  Ids are cut into ranges, a range is one sorted task, and the first
    document of a range is also sent to the range before it; texts move once.  A null
    text is empty.  Null ids come last, rows of one id are ordered by text, repeated
    rows stay, a single row follows itself, other columns are not read.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(lowest)).alias("key"),
    )
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = docs.select(F.col(doc_id).cast("double").alias("doc_id")).approxQuantile(
        "doc_id", [k / parts for k in range(1, parts)], 0.1 / parts
    )
    placed = rows.withColumn("bucket", _bucket(F.col("key"), bounds))
    # One row per range: its largest key, which the range before it needs too.
    tops = sorted(placed.groupBy("bucket").agg(F.max("key").alias("key")).collect())
    if not tops:
        return spark.createDataFrame([], RESULT)
    heads = [(top["key"], tops[place - 1]["bucket"]) for place, top in enumerate(tops)]
    also = F.broadcast(spark.createDataFrame(heads, "head long, target int"))
    lent = placed.join(also, F.col("key") == F.col("head")).select("doc_id", "text", "key", F.col("target").alias("bucket"), F.lit(True).alias("lent"))
    dealt = placed.withColumn("lent", F.lit(False)).select("doc_id", "text", "key", "bucket", "lent").unionByName(lent)
    ordered = dealt.repartitionById(max(t["bucket"] for t in tops) + 1, F.col("bucket").cast("int"))
    ordered = ordered.sortWithinPartitions("bucket", "lent", F.desc("key"), "text")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RESULT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        done: list[tuple] = []
        pending: tuple | None = None  # a row whose next text is still to come
        waiting: tuple | None = None  # a row that lacks only its next row's fingerprint

        def finish(own: np.ndarray) -> None:
            nonlocal waiting
            if waiting is not None:
                number, size, digest, mine, changed = waiting
                done.append((number, size, digest, shown(mine), shown(changed), likeness(mine, changed), likeness(mine, own)))
                waiting = None

        for batch in batches:
            for number, body, lent in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "lent")), strict=True):
                if pending is not None:
                    own, changed, new = with_edit(pending[1], body)
                    finish(own)
                    waiting = (pending[0], len(pending[1]), hashlib.sha256(new.encode()).hexdigest(), own, changed)
                    pending = None
                    if lent:
                        finish(fingerprint(body))
                if not lent:
                    pending = (number, body)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(types)], names)
                done = []

    return ordered.select("doc_id", "text", "lent").mapInArrow(compute, RESULT)
