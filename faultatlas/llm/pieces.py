"""Sampled SentencePiece segmentations: forward filtering, backward sampling.

All segmentations of a text into pieces of a public model form a lattice.  A forward
pass sums the weight of all ways to every position; a backward pass draws, from the
end, one incoming piece at a time in proportion to the weight of the ways through it.
So a segmentation is drawn with exactly its share of the total weight.  The draws are
hashes of the row key and the place in the text: the same row gives the same pieces
in any run, on any partitioning.

No piece goes on behind a blank, so a text falls into chunks that begin with blanks
and the lattice of a chunk is built once for all its occurrences in a group of texts.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultatlas.llm.worker import kept

BLANK = "▁"
_CHUNK = re.compile(" +[^ ]*|[^ ]+")
RESULT = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean"


class PieceModel:
    """Pieces of a model with their log weights, as a table of hashed prefixes.

    A unigram model's scores are log probabilities.  The scores of a merge model are
    negative ranks; as words of a language do, its pieces weigh in inverse proportion
    to the rank.  ``sharpness`` multiplies the log weights: 0 draws all
    segmentations alike, large values give nearly always the best one.
    """

    def __init__(self, path: str, sharpness: float = 1.0):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_id = np.zeros(256, np.int32)
        self.weight: dict[str, tuple[int, float]] = {}
        scores = {
            k: model.get_score(k) for k in range(size)
            if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))
        }
        ranks = len(set(scores.values())) > 1 and min(scores.values()) <= -len(scores) / 2
        for k in range(size):
            if model.is_byte(k):
                value = int(model.id_to_piece(k)[3:5], 16)
                self.byte_id[value], self.bytes_of[k] = k, bytes([value])
        for k, score in scores.items():
            piece = model.id_to_piece(k).replace(BLANK, " ")
            log = -math.log(2 + min(-score, len(scores))) if ranks else score
            self.weight[piece] = (k, sharpness * log)
            self.bytes_of[k] = piece.encode()
        self.byte_log = min((w for _, w in self.weight.values()), default=0.0) - 1.0
        self.longest = max(map(len, self.weight), default=1)
        hash_of = {"": 0}
        for n in range(1, self.longest + 1):
            longer = list({piece[:n] for piece in self.weight if len(piece) >= n})
            before = np.array([hash_of[p[:-1]] for p in longer], np.uint64)
            now = grown(before, np.array([ord(p[-1]) for p in longer], np.uint64))
            hash_of.update(zip(longer, now.tolist(), strict=True))
        prefixes = [p for p in hash_of if p]
        hashes = np.array([hash_of[p] for p in prefixes], np.uint64)
        order = np.argsort(hashes)
        self.prefix = hashes[order]
        found = [self.weight.get(prefixes[k], (-1, 0.0)) for k in order]
        self.piece = np.array([f[0] for f in found], np.int32)
        self.log = np.array([f[1] for f in found])

    def decode(self, ids: np.ndarray) -> str:
        """The text of a segmentation, without the blank put before it."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


def grown(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hash of strings that got one more character."""
    return mixed(h + points + np.uint64(0x9E3779B97F4A7C15))


def mixed(x: np.ndarray) -> np.ndarray:
    """Hash of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lattices:
    """Filtered lattices of distinct chunks, in flat arrays.

    Nodes are numbered by place in the chunk, then by chunk.  The edges that end in
    node ``k`` have their cumulative shares in ``(k, k + 1]`` of one array, so draws
    at any number of nodes are one binary search.
    """

    def __init__(self, model: PieceModel, chunks: list[str]):
        self.lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        chunk = np.repeat(np.arange(len(chunks)), self.lengths)
        starts = np.cumsum(self.lengths) - self.lengths
        place = np.arange(len(points)) - starts[chunk]
        left = self.lengths[chunk] - place

        # Edges: from every place, the prefixes of pieces grow as long as there are any.
        active, h = np.arange(len(points)), np.zeros(len(points), np.uint64)
        begins, sizes, pieces, logs = [], [], [], []
        for size in range(1, model.longest + 1):
            inside = left[active] >= size
            active = active[inside]
            h = grown(h[inside], points[active + size - 1].astype(np.uint64))
            at = np.minimum(np.searchsorted(model.prefix, h), len(model.prefix) - 1)
            known = model.prefix[at] == h
            if size == 1:
                # A character that is no piece is its bytes; so is the blank sign itself,
                # which in a piece would be read back as a blank.
                alone = active[~known | (model.piece[at] < 0)]
                begins.append(alone)
                sizes.append(np.ones(len(alone), np.int64))
                pieces.append(-1 - points[alone].astype(np.int64))
                bytes_in = 1 + (points[alone] > 0x7F) + (points[alone] > 0x7FF).astype(int) + (points[alone] > 0xFFFF)
                logs.append(model.byte_log * bytes_in)
            active, h, at = active[known], h[known], at[known]
            whole = model.piece[at] >= 0
            begins.append(active[whole])
            sizes.append(np.full(whole.sum(), size))
            pieces.append(model.piece[at[whole]].astype(np.int64))
            logs.append(model.log[at[whole]])
            if not len(active):
                break
        begin, size, self.id, log = (np.concatenate(x) for x in (begins, sizes, pieces, logs))
        self.step = place[begin]
        end = self.step + size
        order = np.lexsort((chunk[begin], end))
        begin, size, end, log = begin[order], size[order], end[order], log[order]
        self.id, self.step = self.id[order], self.step[order]

        # Node numbers in the order of the edges that end there; every place has such edges.
        ends = begin + size - 1  # last character before the node
        fresh = np.concatenate([[True], ends[1:] != ends[:-1]]) if len(ends) else np.empty(0, bool)
        node = np.cumsum(fresh) - 1
        self.node_after = np.empty(len(points), np.int64)
        self.node_after[ends] = node
        self.back = np.where(self.step > 0, self.node_after[begin - 1], -1)
        self.last = self.node_after[starts + self.lengths - 1]

        # Forward filtering, place by place for all chunks at once.
        ways = np.zeros(int(node[-1]) + 1 if len(node) else 0)
        self.share = np.empty(len(node))
        edges_at = np.flatnonzero(np.diff(end, prepend=0))
        for low, high in zip(edges_at, [*edges_at[1:], len(end)], strict=True):
            to = node[low:high] - node[low]
            heads = np.flatnonzero(fresh[low:high])
            back = self.back[low:high]
            so_far = log[low:high] + np.where(back >= 0, ways[back], 0.0)
            top = np.maximum.reduceat(so_far, heads)
            weight = np.exp(so_far - top[to])
            total = np.add.reduceat(weight, heads)
            ways[node[low] : node[low] + len(heads)] = top + np.log(total)
            summed = np.cumsum(weight / total[to])
            before = (summed - weight / total[to])[heads]
            inner = np.minimum(summed - before[to], 1.0)
            inner[np.append(heads[1:], len(to)) - 1] = 1.0
            self.share[low:high] = node[low:high] + inner


def sample(model: PieceModel, texts: list[str], keys: list[int]) -> list[np.ndarray]:
    """Ids of one drawn segmentation of every text; an empty text has none."""
    # The model reads a text with a blank before it.
    each = [_CHUNK.findall(" " + t) if t else [] for t in texts]
    number: dict[str, int] = {}
    used = [number.setdefault(c, len(number)) for chunks in each for c in chunks]
    if not used:
        return [np.empty(0, np.int32) for _ in texts]
    lattices = Lattices(model, list(number))
    used = np.array(used)
    per_text = np.fromiter(map(len, each), np.int64, len(each))
    of = np.repeat(np.arange(len(texts)), per_text)
    lengths = lattices.lengths[used]
    begins = np.cumsum(lengths) - lengths  # of the chunks, in all texts in a row
    sizes = np.bincount(of, lengths, len(texts)).astype(np.int64)
    origin = np.cumsum(sizes) - sizes  # of the texts
    salt = mixed(np.array(keys, np.int64).view(np.uint64))[of]

    node, place = lattices.last[used], begins + lengths
    active = np.arange(len(used))
    drawn, places = [], []
    while len(active):
        inside = (place[active] - origin[of[active]]).astype(np.uint64)
        u = (mixed(salt[active] + inside * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) * 2.0**-53
        edge = np.searchsorted(lattices.share, node[active] + u, side="right")
        place[active] = begins[active] + lattices.step[edge]
        drawn.append(edge)
        places.append(place[active])
        node[active] = lattices.back[edge]
        active = active[lattices.back[edge] >= 0]
    places = np.concatenate(places)
    order = np.argsort(places, kind="stable")
    ids, places = lattices.id[np.concatenate(drawn)[order]], places[order]
    owner = np.searchsorted(origin, places, side="right") - 1
    for k in np.unique(ids[ids < 0])[::-1]:  # characters that are written as bytes
        spelled = model.byte_id[list(chr(-1 - k).encode("utf-8", "surrogatepass"))]
        spots = np.flatnonzero(ids == k)
        ids = np.insert(ids, np.repeat(spots + 1, len(spelled) - 1), np.tile(spelled[1:], len(spots)))
        owner = np.insert(owner, np.repeat(spots + 1, len(spelled) - 1), np.repeat(owner[spots], len(spelled) - 1))
        ids[ids == k] = spelled[0]
    return np.split(ids.astype(np.int32), np.searchsorted(owner, np.arange(1, len(texts))))


def _groups(batch: pa.RecordBatch, limit: int = 2_000_000) -> Iterator[tuple[list[str], list[int]]]:
    """Texts and keys of a batch, as many at a time as have ``limit`` characters."""
    texts, keys, held = [], [], 0
    for text, key in zip(batch["text"], batch["key"].to_pylist(), strict=True):
        texts.append(text.as_py() or "")
        keys.append(key)
        held += len(texts[-1])
        if held >= limit:
            yield texts, keys
            texts, keys, held = [], [], 0
    if texts:
        yield texts, keys


def worker_model(path: str, sharpness: float = 1.0) -> PieceModel:
    """The model of this Python worker."""
    return kept(("pieces", path, sharpness), lambda: PieceModel(path, sharpness))


def sampled_pieces(
    docs: DataFrame, model_path: str, sharpness: float = 1.0, seed: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, text, ids``: a sampled segmentation of every whole text.

    The row key is the id (null: 0) with ``seed``; rows of one id and one text get
    the same pieces.  A null or empty text has no piece.  Repeated rows stay, an empty
    table gives no row, other columns are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_model(model_path, sharpness)
        for batch in batches:
            found = [ids for texts, keys in _groups(batch) for ids in sample(model, texts, keys)]
            yield _with_ids(batch, found)

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        F.xxhash64(F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), F.lit(seed)).alias("key"),
    )
    return rows.mapInArrow(encode, "doc_id long, text string, ids array<int>")


def _with_ids(batch: pa.RecordBatch, found: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    flat = np.concatenate([*found, np.empty(0, np.int32)]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [batch["doc_id"], batch["text"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "text", "ids"]
    )


def decoded(pieces: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``: the text of the ids, which is the text they came from.

    Null ids give a null text, no ids an empty one; all columns stay.
    """

    @F.pandas_udf("string")
    def decode(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = worker_model(model_path)
        for one in column:
            yield one.map(lambda x: None if x is None else model.decode(np.asarray(x)))

    return pieces.withColumn("decoded", decode(F.col(ids)))


def round_trip(docs: DataFrame, model_path: str, sharpness: float = 1.0, seed: int = 1) -> DataFrame:
    """Sampled pieces of every text, decoded again: counts, checksums, and whether nothing was lost.

    The same as ``sampled_pieces`` and ``decoded`` in one pass, for corpora whose ids
    need not be kept.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_model(model_path, sharpness)
        for batch in batches:
            rows = []
            for texts, keys in _groups(batch):
                for body, ids in zip(texts, sample(model, texts, keys), strict=True):
                    back = model.decode(ids)
                    digest = hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), digest, back == body))
            types = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], [f.split()[0] for f in RESULT.split(", ")])

    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.lit(seed))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("key"))
    return rows.mapInArrow(check, RESULT)
