"""Product codes of integer vectors by a Lloyd iteration that looks at moved entries only.

A vector is cut into equal parts, and every part position has a codebook.  A round
assigns each part to its nearest entry and moves every entry to the mean of its parts.
The state of a vector is the entry and the exact distance of each part.  In the next
round a part whose entry has not moved still has that exact distance, and none of the
other unmoved entries can have come nearer; so only moved entries are compared with the
stored distance.  A part whose entry has moved is compared with all entries.  Equal
distances go to the lower index in both cases, so the result is that of a full scan.

Vectors and state are rows of a table that every round writes anew; sums for the
means are added up in each task, then by Spark.  Only codebooks are on the driver.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultatlas.llm.vectors import lists_of, scaled, usable
from faultatlas.plans.layout import checkpoint_folder

# Up to here squared distances of parts of up to 512 components fit 64 bits.
_NARROW = 1 << 26
_MOST = (1 << 63) - 1
_ROWS = 4096


@dataclass
class Codebooks:
    """``books[part, entry, position]`` as Python integers, and the entries that the last round moved."""

    books: np.ndarray
    moved: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        if self.moved is None:
            self.moved = np.ones(self.books.shape[:2], bool)

    def sha256(self) -> str:
        """Digest of all components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    @property
    def narrow(self) -> bool:
        return not self.books.size or max(-int(self.books.min()), int(self.books.max())) <= _NARROW


def distances_to(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of one part to some entries, as 64-bit or as Python integers."""
    out = np.zeros((len(parts), len(entries)), parts.dtype)
    for position in range(parts.shape[1]):
        difference = parts[:, position, None] - entries[None, :, position]
        out += difference * difference
    return out


def nearest(
    parts: np.ndarray, known: Codebooks, part: int, entry: np.ndarray, distance: np.ndarray, fresh: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Entry and exact distance of one part position's rows, from those of the round before.

    ``fresh`` asks for a full scan of every row.
    """
    books, moved = known.books[part].astype(parts.dtype), np.flatnonzero(known.moved[part])
    entry, distance = entry.copy(), distance.astype(parts.dtype)
    again = np.ones(len(parts), bool) if fresh else known.moved[part][entry]
    scan, keep = np.flatnonzero(again), np.flatnonzero(~again)
    if len(scan):
        # The first of equal distances is the one with the lowest index.
        found = distances_to(parts[scan], books)
        entry[scan] = found.argmin(axis=1)
        distance[scan] = found.min(axis=1)
    if len(keep) and len(moved):
        found = distances_to(parts[keep], books[moved])
        best, index = found.min(axis=1), moved[found.argmin(axis=1)]
        nearer = (best < distance[keep]) | ((best == distance[keep]) & (index < entry[keep]))
        entry[keep[nearer]], distance[keep[nearer]] = index[nearer], best[nearer]
    return entry, distance


def assign(
    components: np.ndarray, known: Codebooks, entries: np.ndarray | None, distances: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray]:
    """Entries and distances of all parts of some vectors; without a state every part is scanned."""
    n_parts, _, width = known.books.shape
    fresh = entries is None
    if fresh:
        entries, distances = np.zeros((len(components), n_parts), np.int64), np.zeros((len(components), n_parts), np.int64)
    body = components.reshape(len(components), n_parts, width)
    out_entries, out_distances = np.empty_like(entries), np.empty((len(components), n_parts), np.int64)
    low = np.abs(body.astype(np.float64)).max(axis=(1, 2), initial=0) <= _NARROW if known.narrow else np.zeros(len(body), bool)
    for rows, kind, scan in ((np.flatnonzero(low), np.int64, fresh), (np.flatnonzero(~low), object, True)):
        if not len(rows):
            continue
        # Distances beyond 64 bits are not kept exactly, so large components are scanned anew each time.
        for part in range(n_parts):
            one, two = nearest(body[rows, part].astype(kind), known, part, entries[rows, part], distances[rows, part], scan)
            out_entries[rows, part] = one
            out_distances[rows, part] = two if kind is np.int64 else [min(x, _MOST) for x in two]
    return out_entries, out_distances


def _state(batch: pa.RecordBatch, dim: int, n_parts: int) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Components, entries and distances of a batch."""
    _, flat = lists_of(batch.column("components"))
    components = flat.reshape(batch.num_rows, dim)
    if "entries" not in batch.schema.names:
        return components, None, None
    entries = np.frombuffer(b"".join(batch.column("entries").to_pylist()), np.uint8).reshape(batch.num_rows, n_parts)
    return components, entries.astype(np.int64), lists_of(batch.column("distances"))[1].reshape(batch.num_rows, n_parts)


def _lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def assigned(rows: DataFrame, known: Codebooks) -> DataFrame:
    """Rows with the entries and distances of this round."""
    n_parts, _, width = known.books.shape

    def one_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(begin, _ROWS)
                components, entries, distances = _state(batch, n_parts * width, n_parts)
                entries, distances = assign(components, known, entries, distances)
                codes = pa.array([bytes(x) for x in entries.astype(np.uint8)], pa.binary())
                columns = [batch.column("vec_id"), batch.column("label"), batch.column("components"), codes, _lists(distances)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "components", "entries", "distances"])

    integers = rows.select("vec_id", "label", "components").schema
    return rows.mapInArrow(one_round, T.StructType(integers.fields).add("entries", T.BinaryType()).add("distances", T.ArrayType(T.LongType())))


def moved_entries(rows: DataFrame, known: Codebooks) -> Codebooks:
    """Every entry at the rounded-down mean of its parts; entries without a part stay."""
    n_parts, n_entries, width = known.books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((n_parts, n_entries, width), object), np.zeros((n_parts, n_entries), np.int64)
        for whole in batches:
            for begin in range(0, whole.num_rows, _ROWS):
                components, entries, _ = _state(whole.slice(begin, _ROWS), n_parts * width, n_parts)
                body = components.reshape(len(components), n_parts, width)
                kind = np.int64 if np.abs(body.astype(np.float64)).max(initial=0) <= _NARROW else object
                for part in range(n_parts):
                    some = np.zeros((n_entries, width), kind)
                    np.add.at(some, entries[:, part], body[:, part].astype(kind))
                    total[part] += some
                    count[part] += np.bincount(entries[:, part], minlength=n_entries)
        part, entry = np.nonzero(count)
        if len(part):
            columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry])]
            text = pa.array([[str(x) for x in total[p, e]] for p, e in zip(part, entry, strict=True)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*columns, text], ["part", "entry", "n", "sums"])

    found = rows.select("components", "entries", "distances").mapInArrow(sums, "part int, entry int, n long, sums array<string>")
    added = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    # A row per entry: at most parts x entries.
    means = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect()
    books = known.books.copy()
    for row in means:
        books[row["part"], row["entry"]] = [int(row[f"s{k}"]) // row["n"] for k in range(width)]
    return Codebooks(books, (books != known.books).any(axis=2))


def initial(rows: DataFrame, n_parts: int, n_entries: int) -> Codebooks | None:
    """Codebooks of the parts of the vectors with the smallest ids; None where no vector can be cut."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "components").limit(n_entries).collect()
    if not first:
        return None
    dim = len(first[0]["components"])
    body = np.array([r["components"] for r in first if len(r["components"]) == dim], object)
    if not dim or dim % n_parts:
        return None
    return Codebooks(body.reshape(len(body), n_parts, dim // n_parts).transpose(1, 0, 2))


class Rounds:
    """Tables of the rounds, written to the shared folder; one that nothing reads any more is removed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{checkpoint_folder(spark)}/tables/{uuid.uuid4().hex}"
        self.written = 0

    def keep(self, rows: DataFrame) -> DataFrame:
        """Write the rows of a round; the one before the last has then been read for the last time."""
        rows.write.parquet(f"{self.folder}/{self.written}")
        if self.written > 1:
            context = self.spark.sparkContext
            old = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.written - 1}")
            old.getFileSystem(context._jsc.hadoopConfiguration()).delete(old, True)
        self.written += 1
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{self.written - 1}")


def integer_vectors(vectors: DataFrame, scale: float, vec_id: str, vector: str, label: str) -> DataFrame:
    """``vec_id, label, components``: ``floor(scale * x)`` of the usable vectors."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, flat = lists_of(batch.column("vector"))
            offsets = pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32))
            components = pa.ListArray.from_arrays(offsets, pa.array(scaled(flat, scale)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), components], ["vec_id", "label", "components"])

    held = vectors.where(usable(F.col(vector))).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector")
    )
    return held.mapInArrow(convert, T.StructType(held.schema.fields[:2]).add("components", T.ArrayType(T.LongType())))


def compress(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256``: one row per usable vector.

    Vectors that are null or hold a null or a non-finite component are left out.
    Components become ``floor(scale * x)``, taken at 62 bits beyond them.  Codebooks
    start as the parts of the vectors with the smallest ids (of equal ids the smaller
    vector first, null ids last; with fewer vectors there are fewer entries).  ``code``
    has two hex digits per part, ``error`` is the sum of its squared distances, and
    ``label_error`` that of all vectors of the label, null labels together; both are
    taken at 64 bits beyond them.  Repeated rows count each.  The vector of the smallest
    id sets the length; vectors of another length, or all if that length has no equal
    parts, come with null code and null error.  An empty table gives no row; other
    columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte per part")
    tables = Rounds(vectors.sparkSession)
    integers = tables.keep(integer_vectors(vectors, scale, vec_id, vector, label))
    known = initial(integers, parts, entries)
    digest = known.sha256() if known else hashlib.sha256(b"").hexdigest()
    fits = F.size("components") == known.books.shape[0] * known.books.shape[2] if known else F.lit(False)
    odd = integers.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = odd
    if known:
        state = tables.keep(assigned(integers.where(fits), known))
        for _ in range(rounds):
            known = moved_entries(state, known)
            state = tables.keep(assigned(state, known))
        digest = known.sha256()
        total = F.aggregate("distances", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)"))
        error = F.least(total, F.lit(_MOST).cast("decimal(38,0)")).cast("long")
        coded = state.select("vec_id", "label", F.lower(F.hex("entries")).alias("code"), error.alias("error")).unionByName(odd)
    least = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy(F.col("label").alias("of_label")).agg(least.alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
