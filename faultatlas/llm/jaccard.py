"""Documents whose sets of word shingles have a high Jaccard similarity.

Prefix filtering on shingles ordered from rare to frequent: two sets that are similar
enough share a shingle within short prefixes.  The join runs on the prefix shingles
with a length and a positional filter; a suffix filter (sets split by hash into bins,
whose size differences bound what the sets cannot share) removes pairs before any set
is moved; what is left is verified exactly, once per pair.

Equal sets are one class before the join.  The classes of a prefix shingle are first
held against a few pivots, and only pairs that are not yet connected are compared
beyond that: a large group of near copies costs a multiple of its size, not its
square, and no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultatlas.llm.components import components
from faultatlas.llm.worker import kept, sliced
from faultatlas.plans.layout import cut

_BUCKET_BITS = 18  # shingle frequencies are counted in so many hashed buckets
_BLOOM_BITS = 20
_BINS = 32
_TEXTS = 500
_M = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """64-bit hashes of the word shingles of texts."""

    def __init__(self, words: int, seed: int = 0, remembered: int = 30_000):
        import xxhash

        self.words, self.remembered = words, remembered
        self.digest = lambda w: xxhash.xxh3_64_digest(w, seed)
        self.known: dict[bytes, bytes] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes.  Fewer words than a shingle are one sequence."""
        # ASCII case and ASCII blanks only, which is what bytes methods know.
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        found = list(map(self.known.get, words))
        if None in found:
            new = {w: self.digest(w) for w, h in zip(words, found, strict=True) if h is None}
            if len(self.known) + len(new) <= self.remembered:
                self.known.update(new)
            found = [new[w] if h is None else h for w, h in zip(words, found, strict=True)]
        each = np.frombuffer(b"".join(found), np.uint64)
        n = min(self.words, len(each))
        total = np.full(len(each) - n + 1, n, np.uint64)
        for k in range(n):
            total = (total ^ (total >> np.uint64(29))) * _M + each[k : len(each) - n + 1 + k]
        return np.unique(mixed(total))


def worker_shingler(words: int, seed: int) -> Shingler:
    """The shingler of this Python worker, with its bounded table of words."""
    return kept(("shingler", words, seed), lambda: Shingler(words, seed))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def set_keys(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set, as signed integers."""
    with np.errstate(over="ignore"):
        first = mixed(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))
        second = mixed(shingles * np.uint64(0xA24BAED4963EE407) + np.uint64(1)).sum(dtype=np.uint64)
    return tuple(int(x) for x in mixed(np.array([first, second])).view(np.int64))


def bins_of(shingles: np.ndarray) -> bytes:
    """Sizes of the parts of a set by hash, as the suffix filter compares them."""
    return np.bincount((shingles & np.uint64(_BINS - 1)).astype(int), minlength=_BINS).astype("<i4").tobytes()


def _buckets(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)


def prefix_length(n: int, percent: int) -> int:
    """Shingles of a set among which one is shared with every similar set."""
    return n - -(-n * percent // 100) + 1


def index_length(n: int, percent: int) -> int:
    """The same against sets that are at least as large."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def similar_groups(
    docs: DataFrame, words: int = 4, percent: int = 85, pivot_rounds: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``, ``component`` and ``row``.

    Two documents are linked when ``100 * shared >= percent * united`` shingles;
    ``component_id`` is the smallest id that links lead to, the document's own
    included.  A null text or one without a word has no shingle and is linked with
    nothing.  Null ids stay null and take part in links; repeated rows and rows of
    equal sets share a component; other columns are not read.  ``component``
    is a number of the component that does not need an id (null without a shingle),
    ``row`` the digest of the row's id and text.
    """
    spark = docs.sparkSession
    bodies = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), row_key(doc_id, text).alias("row")
    )
    for seed in range(8):
        scanned = cut(_scan(bodies, words, seed))
        rows = scanned.where("bucket IS NULL").select("doc_id", "row", "n", "node", "check", "bins")
        classes = rows.where("n > 0").groupBy("node", "check").agg(
            F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("bins").alias("bins")
        )
        classes = cut(classes)
        # Two different sets with one 64-bit key: hash anew.
        if not classes.groupBy("node").count().where("count > 1").limit(1).count():
            break
    order = _rarity(scanned)
    links = _links(bodies, classes, order, words, percent, seed, pivot_rounds)
    groups = components(links)
    nodes = classes.join(groups, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("component"))
    smallest = nodes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    members = nodes.join(smallest, "component").select("node", "component", "component_id")
    linked = rows.drop("check", "bins").join(members, "node", "left")
    return linked.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "component",
        "row",
    )


def _scan(bodies: DataFrame, words: int, seed: int) -> DataFrame:
    """Set size and keys of every row, and shingle counts by hashed bucket, in one pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = worker_shingler(words, seed)
        total = np.zeros(1 << _BUCKET_BITS, np.int64)
        names = ["doc_id", "row", "n", "node", "check", "bins", "bucket", "count"]
        for batch in sliced(batches, _TEXTS):
            sizes, nodes, checks, bins = [], [], [], []
            for body in batch["text"]:
                s = shingler.shingles(body.as_py())
                np.add.at(total, _buckets(s), 1)
                node, check = set_keys(s)
                sizes.append(len(s))
                nodes.append(node)
                checks.append(check)
                bins.append(bins_of(s))
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["row"], *(pa.array(x, pa.int64()) for x in (sizes, nodes, checks)), pa.array(bins, pa.binary()), none, none], names
            )
        seen = np.flatnonzero(total)
        none = pa.nulls(len(seen), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.nulls(len(seen), pa.binary()), pa.array(seen), pa.array(total[seen])], names)

    return bodies.mapInArrow(scan, "doc_id long, row long, n long, node long, check long, bins binary, bucket long, count long")


def _rarity(scanned: DataFrame) -> np.ndarray:
    """Occurrences of all shingles by bucket; the table has a fixed size at any input."""
    counts = scanned.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("count").alias("count")).toArrow()
    total = np.zeros(1 << _BUCKET_BITS, np.int64)
    total[counts["bucket"].to_numpy()] = counts["count"].to_numpy()
    return total


def _entries(bodies: DataFrame, order: np.ndarray, words: int, percent: int, seed: int) -> DataFrame:
    """Prefix shingles of every set, rare first: ``token, node, n, at, bins``.

    A set that a task meets again is sent once.
    """
    shared = bodies.sparkSession.sparkContext.broadcast(order)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = worker_shingler(words, seed), set()
        for batch in sliced(batches, _TEXTS):
            tokens, nodes, sizes, places = [], [], [], []
            for body in batch["text"]:
                s = shingler.shingles(body.as_py())
                node, _ = set_keys(s)
                if not len(s) or node in seen:
                    continue
                seen.add(node)
                k = prefix_length(len(s), percent)
                counts = shared.value[_buckets(s)]
                if 4 * k < len(s):  # the k rarest, ties by hash
                    edge = np.partition(counts, k - 1)[k - 1]
                    near = counts <= edge
                    s_near = s[near]
                    first = s_near[np.lexsort((s_near, counts[near]))[:k]]
                else:
                    first = s[np.lexsort((s, counts))[:k]]
                tokens.append(first.view(np.int64))
                nodes.append(np.full(k, node))
                sizes.append(np.full(k, len(s), np.int32))
                places.append(np.arange(k, dtype=np.int32))
            columns = [
                np.concatenate([*x, np.empty(0, t)])
                for x, t in ((tokens, np.int64), (nodes, np.int64), (sizes, np.int32), (places, np.int32))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "node", "n", "at"])

    return bodies.mapInArrow(prefixes, "token long, node long, n int, at int")


def _links(
    bodies: DataFrame, classes: DataFrame, order: np.ndarray, words: int, percent: int, seed: int, pivot_rounds: int
) -> DataFrame:
    """Verified links between classes, enough to connect what any chain of links connects.

    The classes of a shingle's list are in groups that are connected already.  In a
    pivot round one member of the largest group is held against all other groups; the
    last round compares every class outside the largest group with all of the list
    that is not in its own group.
    """
    # Shingles that at least two classes have in their prefixes; the others are moved once and not written.
    same = Window.partitionBy("token")
    entries = _entries(bodies, order, words, percent, seed)
    entries = entries.withColumn("x", F.min("node").over(same)).withColumn("y", F.max("node").over(same))
    common = entries.where("x <> y").select("token", "node", "n", "at")
    first = classes.select("node", "first_id")
    met = cut(common.distinct().join(first, "node").withColumn("component", F.col("node")))
    found = tried = empty(bodies.sparkSession, "a long, b long")
    for turn in range(pivot_rounds + 1):
        # The first pivot is the smallest id, since copies tend to come after their original.
        rank = F.col("first_id") if turn == 0 else F.xxhash64("node", F.lit(turn))
        groups = met.groupBy("token", "component").agg(
            F.count("*").alias("members"), F.min(F.struct(rank.alias("rank"), "node", "n", "at")).alias("pivot")
        )
        largest = F.max(F.struct("members", (-F.col("pivot.rank")).alias("tie"), "component", "pivot"))
        lists = groups.groupBy("token").agg(
            F.count("*").alias("groups"), F.sum("members").alias("classes"), largest.alias("largest")
        )
        # The one pair of a list of two is compared in the first round.
        lists = lists.where("groups > 1" if turn == 0 else "groups > 1 AND classes > 2")
        lists = lists.select("token", F.col("largest.component").alias("main"), F.col("largest.pivot").alias("pivot"), "classes")
        met = cut(met.join(lists, "token"))
        rest = met.where("component <> main")
        p = [F.col("node").alias("p"), F.col("n").alias("pn"), F.col("at").alias("pat")]
        if turn < pivot_rounds:
            pairs = rest.select(*p, F.col("pivot.node").alias("q"), F.col("pivot.n").alias("qn"), F.col("pivot.at").alias("qat"))
            pairs = pairs.where(_passes(percent))
        else:
            all_of = met.select(
                F.col("token").alias("list"), F.col("component").alias("other"),
                F.col("node").alias("q"), F.col("n").alias("qn"), F.col("at").alias("qat"),
            )
            apart = (F.col("token") == F.col("list")) & (F.col("component") != F.col("other"))
            pairs = rest.select("token", "component", *p).join(all_of, apart & _passes(percent))
        wanted = pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
        wanted = cut(wanted.join(tried, ["a", "b"], "left_anti"))
        found = cut(found.unionByName(_verified(bodies, classes, wanted, words, percent, seed)))
        if turn < pivot_rounds:
            tried = tried.unionByName(wanted)
            known = components(found).withColumnRenamed("component", "known")
            met = met.where("classes > 2").drop("main", "pivot", "classes").join(known, "node", "left")
            met = met.withColumn("component", F.coalesce("known", "component")).drop("known")
    return found


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _passes(percent: int) -> Column:
    """Length and positional filter for a pair that meets at its first shared shingle."""
    n, m = F.col("pn"), F.col("qn")
    needed = F.ceil((n + m) * float(percent) / (100.0 + percent) - 1e-9)
    left = F.least(n - F.col("pat"), m - F.col("qat"))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (left >= needed)


def _sets(bodies: DataFrame, wanted: DataFrame, words: int, seed: int) -> DataFrame:
    """Sets of the wanted classes (``node, first_id``), and of few others: ``node, shingles``.

    A bit table of fixed size tells which ids are wanted, so other texts are not cut
    into shingles; at worst it lets all through, and the join that follows drops them.
    """
    spots = wanted.select(F.pmod(F.coalesce("first_id", F.lit(-1)), F.lit(1 << _BLOOM_BITS)).alias("spot")).distinct().toArrow()
    table = np.zeros(1 << _BLOOM_BITS, bool)
    table[spots["spot"].to_numpy()] = True
    shared = bodies.sparkSession.sparkContext.broadcast(np.packbits(table))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, bits = worker_shingler(words, seed), set(), np.unpackbits(shared.value)
        for batch in sliced(batches, _TEXTS):
            found = []
            for number, body in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                if not bits[(-1 if number is None else number) % len(bits)]:
                    continue
                s = shingler.shingles(body.as_py())
                node, _ = set_keys(s)
                if len(s) and node not in seen:
                    seen.add(node)
                    found.append((node, s.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], ["node", "shingles"]
            )

    return bodies.mapInArrow(sets, "node long, shingles binary")


def _verified(bodies: DataFrame, classes: DataFrame, wanted: DataFrame, words: int, percent: int, seed: int) -> DataFrame:
    """The pairs of ``wanted`` that are similar enough."""

    def suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), "<i4").reshape(-1, _BINS) for c in ("bins_a", "bins_b"))
            apart = np.abs(x - y).sum(1)
            total = batch["n_a"].to_numpy() + batch["n_b"].to_numpy()
            # shared = (total - apart) / 2 at most, united = (total + apart) / 2 at least
            keep = 100 * (total - apart) >= percent * (total + apart)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, _TEXTS):
            keep = []
            for x, y in zip(batch["shingles_a"], batch["shingles_b"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def side(table: DataFrame, name: str, *columns: str) -> DataFrame:
        return table.select(F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    near = wanted.join(side(classes, "b", "n", "bins"), "b").join(side(classes, "a", "n", "bins"), "a")
    near = cut(near.mapInArrow(suffix, "a long, b long"))
    nodes = near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "first_id"), "node")
    sets = cut(_sets(bodies, nodes, words, seed).dropDuplicates(["node"]))
    full = near.join(side(sets, "b", "shingles"), "b").join(side(sets, "a", "shingles"), "a")
    return full.select("a", "b", "shingles_a", "shingles_b").mapInArrow(compare, "a long, b long")


def row_key(doc_id: str, text: str) -> Column:
    """Digest that tells rows apart by id and text."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


def first_of_groups(docs: DataFrame, words: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of every group of similar documents, all columns as they are.

    The row with the smallest id of a group stays (a null id comes last); of several
    rows with that id the one with the smallest digest, and of rows that agree in id
    and text one.  A null text or one without a word is in no group, and all such rows
    stay.  An empty table gives no row.
    """
    # A name unlike any of the input's.
    row = "_" * (1 + max((len(c) for c in docs.columns), default=0)) + "row"
    groups = similar_groups(docs, words, percent, doc_id=doc_id, text=text)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("least")
    kept = groups.where("n_shingles > 0").groupBy("component").agg(least).select(F.col("least.row").alias(row))
    worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    first = docs.where(worded).withColumn(row, row_key(doc_id, text)).join(kept, row, "left_semi")
    first = first.dropDuplicates([row, doc_id]).drop(row)
    return first.unionByName(docs.where(~worded))
