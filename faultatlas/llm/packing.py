"""Packing of token pieces into sequences by a grouping genetic algorithm.

Pieces of full length are sequences by themselves.  The shorter ones are dealt by
hash into shards of about ``shard_pieces``; every shard is packed by ``islands``
populations that evolve apart and pass their best packing to the next island at the
end of each epoch.  An island is one group of bounded size, so neither a hot source
nor the size of the corpus changes what a task holds.

A chromosome is a list of bins.  Crossover injects whole well-filled bins of one
parent into the other and dissolves the bins that hold one of the injected pieces.
Displaced pieces first take the place of one or two shorter ones of a bin that they
fill better (the shorter ones are displaced instead); what is left is put back by best
fit, longest first.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultatlas.llm.tokens import ids_crc32, worker_encoder
from faultatlas.llm.worker import forget
from faultatlas.plans.layout import cut

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every whole text, the end id included.

    A null or empty text is one piece of the end id alone.  Repeated rows give
    repeated pieces, a null id stays null, other columns are not read.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_path)
        for batch in batches:
            rows, numbers, starts, lengths, sums = [], [], [], [], []
            for row, body in enumerate(batch["text"]):
                ids = encoder.ids(body.as_py())
                for number, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append(row)
                    numbers.append(number)
                    starts.append(start)
                    lengths.append(len(part))
                    sums.append(ids_crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32())]
                + [pa.array(x, pa.int64()) for x in (starts, lengths, sums)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(cut_up, PIECES)


class Packer:
    """Bins of one shard: lists of piece numbers, each with at most ``capacity`` ids."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.sizes = np.array(lengths, np.int64)
        self.lengths = self.sizes.tolist()
        self.shorter = (-self.sizes).tolist()
        self.capacity = capacity
        self.random = np.random.default_rng(seed)
        self.pairs: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def best_fit(self, bins: list[list[int]], pieces: list[int]) -> list[list[int]]:
        """Put pieces, longest first, where they leave the least room."""
        free = sorted((self.capacity - self.filled(b), k) for k, b in enumerate(bins))
        for piece in sorted(pieces, key=self.shorter.__getitem__):
            size = self.lengths[piece]
            at = bisect.bisect_left(free, (size, -1))
            if at < len(free):
                room, k = free.pop(at)
                bins[k].append(piece)
            else:
                room, k = self.capacity, len(bins)
                bins.append([piece])
            if room > size:
                bisect.insort(free, (room - size, k))
        return bins

    def filled(self, one: list[int]) -> int:
        return sum(map(self.lengths.__getitem__, one))

    def fitness(self, bins: list[list[int]]) -> tuple[int, float]:
        """Fewer bins first, then fuller ones."""
        return -len(bins), sum((self.filled(b) / self.capacity) ** 2 for b in bins)

    def first(self) -> list[list[int]]:
        """Best fit of all pieces in a slightly shuffled order of lengths."""
        order = np.argsort(-(np.array(self.lengths) * self.random.uniform(0.97, 1.03, len(self.lengths))))
        half = len(order) // 2
        return self.best_fit(self.best_fit([], order[:half].tolist()), order[half:].tolist())

    def cross(self, taker: list[list[int]], giver: list[list[int]], share: float = 0.1) -> list[list[int]]:
        """Inject whole well-filled bins, dissolve the bins they clash with, put back what fell out."""
        fills = np.array([self.filled(b) for b in giver])
        full = np.flatnonzero(fills >= np.quantile(fills, 0.5))
        injected = [list(giver[k]) for k in self.random.choice(full, max(1, int(len(full) * share)), replace=False)]
        placed = {p for b in injected for p in b}
        kept, displaced = injected, []
        for one in taker:
            if placed.isdisjoint(one):
                kept.append(list(one))
            else:
                displaced += [p for p in one if p not in placed]
        return self.put_back(kept, displaced)

    def mutate(self, bins: list[list[int]], n: int = 4) -> list[list[int]]:
        """Dissolve the emptiest bins and a few others."""
        order = sorted(range(len(bins)), key=lambda k: self.filled(bins[k]))
        gone = {*order[:n], *self.random.choice(len(bins), min(n, len(bins)), replace=False).tolist()}
        kept = [list(b) for k, b in enumerate(bins) if k not in gone]
        return self.put_back(kept, [p for k in gone for p in bins[k]])

    def put_back(self, bins: list[list[int]], displaced: list[int]) -> list[list[int]]:
        """Displaced pieces by exchange, the rest by best fit."""
        return self.best_fit(bins, self.exchange(bins, displaced))

    def exchange(self, bins: list[list[int]], displaced: list[int], pairs_of: int = 64) -> list[int]:
        """Replace one or two pieces of a bin by one or two displaced ones that fill it better; returns what is displaced then.

        A bin takes what fills it most.  Every exchange makes a bin fuller and the
        displaced pieces shorter.  Pairs are formed of up to ``pairs_of`` displaced
        pieces and of bins with up to 16; the others are exchanged one by one.
        """
        left, sums, lengths = np.array(displaced, np.int64), None, self.lengths
        small = np.int16 if 2 * self.capacity < 1 << 15 else np.int64
        for k in self.random.permutation(len(bins)):
            one = bins[k]
            room = self.capacity - self.filled(one)
            if not room or not len(left):
                continue
            if sums is None:
                # Single displaced pieces, then pairs of the first ones, by their length.
                sizes = self.sizes[left]
                n = min(pairs_of, len(left))
                if n not in self.pairs:
                    self.pairs[n] = np.triu_indices(n, 1)
                x, y = self.pairs[n]
                # Small types are sorted by their digits.
                sums = np.concatenate([sizes, sizes[x] + sizes[y]]).astype(small)
                order = np.argsort(sums, kind="stable")
                sums = sums[order].astype(np.int64)
            out = [(p,) for p in one] + (list(itertools.combinations(one, 2)) if len(one) <= 16 else [])
            taken_out = np.array([lengths[p[0]] if len(p) == 1 else lengths[p[0]] + lengths[p[1]] for p in out])
            at = np.searchsorted(sums, taken_out + room, "right") - 1
            gain = np.where(at >= 0, sums[at], 0) - taken_out
            best = int(gain.argmax())
            if gain[best] <= 0:
                continue
            number, gone = int(order[at[best]]), out[best]
            here = [number] if number < len(left) else [int(x[number - len(left)]), int(y[number - len(left)])]
            bins[k] = [p for p in one if p not in gone] + left[here].tolist()
            left = np.concatenate([np.delete(left, here), gone])
            self.random.shuffle(left)
            sums = None
        return left.tolist()

    def evolve(self, start: list[list[list[int]]], population: int, generations: int) -> list[list[int]]:
        """Best packing after a number of generations; stops at the bound by total length."""
        least = -(-sum(self.lengths) // self.capacity)
        members = [*start, *(self.first() for _ in range(population - len(start)))]
        ranked = sorted(((self.fitness(m), i, m) for i, m in enumerate(members)), reverse=True, key=lambda x: x[:2])
        made = len(ranked)
        for _ in range(generations):
            if -ranked[0][0][0] <= least:
                break
            a, b = self.random.choice(len(ranked), 2, replace=len(ranked) < 2)
            child = self.mutate(self.cross(ranked[min(a, b)][2], ranked[max(a, b)][2]))
            made += 1
            ranked = sorted([*ranked, (self.fitness(child), made, child)], reverse=True, key=lambda x: x[:2])
            ranked = ranked[:population]
        return ranked[0][2]


def _flat(bins: list[list[int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and place in the bin of every piece."""
    number, place = np.empty(n, "<i4"), np.empty(n, "<i4")
    for k, one in enumerate(bins):
        number[one] = k
        place[one] = np.arange(len(one))
    return number, place


def _bins(number: bytes) -> list[list[int]]:
    numbers = np.frombuffer(number, "<i4")
    order = np.argsort(numbers, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(numbers[order])) + 1)] if len(order) else []


def pack(
    pieces: DataFrame, capacity: int = 2048, shard_pieces: int = 4096, islands: int = 3, epochs: int = 2,
    population: int = 6, generations: int = 12, seed: int = 7,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of ``token_pieces``.

    Every piece is placed once, offsets of a sequence are gapless from 0, and equal
    input gives equal packings.  Repeated rows are packed each.  An empty table gives
    an empty result.  Sequence ids are unique, not dense.
    """
    # Numbers of rows come from a written table, so a repeated task sees the same ones.
    kept = cut(pieces.withColumn("row", F.monotonically_increasing_id()))
    full = kept.where(F.col("length") == capacity)
    short = kept.where(F.col("length") < capacity)
    shards = max(1, -(-short.count() // shard_pieces))
    short = short.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(shards)).cast("int"))

    def first_epoch(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        forget()
        shard, island = (x.as_py() for x in key)
        rows = rows.sort_by("row")
        lengths = rows["length"].to_numpy()
        best = Packer(lengths, capacity, seed + 1000 * shard + island).evolve([], population, generations)
        return elite(shard, island, rows["row"].to_numpy(), lengths, best)

    def elite(shard: int, island: int, row: np.ndarray, lengths: np.ndarray, best: list[list[int]]) -> pa.Table:
        number, place = _flat(best, len(row))
        fill = sum((int(lengths[b].sum()) / capacity) ** 2 for b in best)
        return pa.table(
            {
                "shard": pa.array([shard], pa.int32()),
                "island": pa.array([island], pa.int32()),
                "row": pa.array([row.astype("<i8").tobytes()], pa.binary()),
                "lengths": pa.array([lengths.astype("<i4").tobytes()], pa.binary()),
                "number": pa.array([number.tobytes()], pa.binary()),
                "place": pa.array([place.tobytes()], pa.binary()),
                "n_bins": pa.array([len(best)], pa.int64()),
                "fill": pa.array([fill], pa.float64()),
            }
        )

    def next_epoch(key: tuple[pa.Scalar, ...], elites: pa.Table) -> pa.Table:
        """An island goes on from its own best packing and its neighbour's."""
        shard, island = (x.as_py() for x in key)
        elites = elites.sort_by([("n_bins", "ascending"), ("fill", "descending"), ("home", "ascending")]).to_pylist()
        row, lengths = (np.frombuffer(elites[0][c], t) for c, t in (("row", "<i8"), ("lengths", "<i4")))
        packer = Packer(lengths, capacity, seed + 1000 * shard + 31 * island + 17)
        best = packer.evolve([_bins(x["number"]) for x in elites], population, generations)
        return elite(shard, island, row, lengths, best)

    schema = "shard int, island int, row binary, lengths binary, number binary, place binary, n_bins long, fill double"
    copies = short.select("shard", "row", "length", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    best = copies.groupBy("shard", "island").applyInArrow(first_epoch, schema)
    for _ in range(epochs - 1):
        # Elite migration: a packing goes to its own island and to the next one.
        home = F.col("island").alias("home")
        sent = best.select("*", home, F.explode(F.array_distinct(F.array("island", (home + 1) % islands))).alias("to"))
        arrived = sent.drop("island").withColumnRenamed("to", "island")
        best = arrived.groupBy("shard", "island").applyInArrow(next_epoch, schema)
    order = Window.partitionBy("shard").orderBy("n_bins", F.desc("fill"), "island")
    winners = best.withColumn("rank", F.row_number().over(order)).where("rank = 1")

    def place_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                row, lengths = np.frombuffer(one["row"], "<i8"), np.frombuffer(one["lengths"], "<i4").astype("i8")
                number, place = np.frombuffer(one["number"], "<i4"), np.frombuffer(one["place"], "<i4")
                order = np.lexsort((place, number))
                before = np.cumsum(lengths[order]) - lengths[order]
                begins = np.flatnonzero(np.diff(number[order], prepend=-1))
                offset = np.empty(len(row), "i8")
                offset[order] = before - np.repeat(before[begins], np.diff([*begins, len(row)]))
                sequence = (np.int64(one["shard"]) << 24) + number
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row, sequence, offset)], ["row", "sequence_id", "offset"])

    places = winners.select("shard", "row", "lengths", "number", "place").mapInArrow(
        place_pieces, "row long, sequence_id long, offset long"
    )
    columns = [f.split()[0] for f in PIECES.split(", ")]
    packed = short.drop("shard").join(places, "row").select(*columns, "sequence_id", "offset")
    # Full pieces take the negative numbers.
    alone = full.select(*columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)
