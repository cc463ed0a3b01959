"""Document quality by attention over passages (multiple-instance learning).

A document is a bag of passages of 64 words.  Every passage is encoded (character
classes, word lengths, repeats, hashed word shapes, one learned layer); gated
attention gives each a weight, and the weighted mean of the encodings is scored.
Only document labels are used: the weights are learned from them.

Training is Adam in numpy on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultatlas.llm.language import hashed_sample, held_out
from faultatlas.llm.worker import forget, trim

PASSAGE_WORDS = 64
BLOCK_CHARS = 1_000_000
SHAPES = 32
_KINDS = 14
_SPACE, _LOWER, _UPPER, _DIGIT, _OTHER = 0, 1, 2, 3, 4
_MARKS = {c: 5 + k for k, group in enumerate([".", ",", "!", "|", "#*$%&", "<>{}[]=+~^\\/@", "?:;", "-_'\"()", "\n"]) for c in group}
FEATURES = _KINDS + 7 + SHAPES


def _kind_table() -> np.ndarray:
    """Kind of every code point below 0x2000; the others count as lower-case letters."""
    kinds = np.full(0x2000, _OTHER, np.uint8)
    for cp in range(0x2000):
        c = chr(cp)
        if c in _MARKS:
            kinds[cp] = _MARKS[c]
        elif c.isspace():
            kinds[cp] = _SPACE
        elif c.isupper():
            kinds[cp] = _UPPER
        elif c.isalpha():
            kinds[cp] = _LOWER
        elif c.isdigit():
            kinds[cp] = _DIGIT
    return kinds


class Encoder:
    """Passages of a text as rows of features."""

    def __init__(self) -> None:
        self.kinds = _kind_table()
        random = np.random.default_rng(5)
        self.mix = random.integers(1, 1 << 62, 0x2000, dtype=np.int64).astype(np.uint64) | np.uint64(1)
        self.power = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))

    def passages(self, text: str | None) -> np.ndarray:
        """Features of all passages; a text without a word has none.

        Passages start anew every ``BLOCK_CHARS`` characters, which bounds the memory
        a very long text takes; all of it is read.
        """
        blocks = [self._block(text[at : at + BLOCK_CHARS]) for at in range(0, len(text or ""), BLOCK_CHARS)]
        return np.concatenate([*blocks, np.empty((0, FEATURES), np.float32)])

    def _block(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        low = np.minimum(points, 0x1FFF)
        kind = np.where(points < 0x2000, self.kinds[low], _LOWER)
        blank = (kind == _SPACE) | (kind == _MARKS["\n"])
        first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        if not len(first):
            return np.empty((0, FEATURES), np.float32)
        last = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]]))
        lengths = last - first + 1
        word = np.cumsum(np.bincount(first, minlength=len(points))) - 1
        # Hash of a word: sum over its characters, each weighted by its place.
        place = np.arange(len(points)) - first[np.maximum(word, 0)]
        weighed = np.where(blank, np.uint64(0), (self.mix[low] ^ points) * self.power[np.minimum(place, 4095)])
        hashes = np.add.reduceat(weighed, first)

        n_words = len(first)
        n = -(-n_words // PASSAGE_WORDS)
        passage = np.maximum(word, 0) // PASSAGE_WORDS
        counts = np.bincount(passage * _KINDS + kind, minlength=n * _KINDS).reshape(n, _KINDS)
        starts = np.arange(0, n_words, PASSAGE_WORDS)
        sizes = np.diff(np.append(starts, n_words))
        mean = np.add.reduceat(lengths, starts) / sizes
        spread = np.sqrt(np.maximum(np.add.reduceat(lengths.astype(float) ** 2, starts) / sizes - mean**2, 0))
        again = np.concatenate([[False], hashes[1:] == hashes[:-1]])
        again[starts] = False
        padded = np.zeros(n * PASSAGE_WORDS, np.uint64)
        padded[:n_words] = hashes
        padded[n_words:] = np.arange(n * PASSAGE_WORDS - n_words)  # all different
        table = np.sort(padded.reshape(n, PASSAGE_WORDS), axis=1)
        same = table[:, 1:] == table[:, :-1]
        run = same[:, 1:] & same[:, :-1]
        # Shape of a word: kinds of its first and last characters and its length.
        shape = (kind[first].astype(int) * 31 + kind[last] * 7 + kind[np.maximum(last - 1, first)] * 3 + np.minimum(lengths, 12) // 3) % SHAPES
        shapes = np.bincount(np.arange(n_words) // PASSAGE_WORDS * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES)
        rows = [
            counts / np.maximum(counts.sum(1, keepdims=True), 1),
            np.column_stack([
                mean / 8, spread / 8, np.add.reduceat(again.astype(float), starts) / sizes,
                same.sum(1) / sizes, run.sum(1) / sizes, np.log1p(sizes) / 4, np.full(n, np.log1p(n_words) / 8),
            ]),
            shapes / sizes[:, None],
        ]
        return np.concatenate(rows, axis=1).astype(np.float32)


@dataclass
class QualityModel:
    """Scaling, encoder layer, gated attention and score of a trained model."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def bag(self, passages: np.ndarray) -> tuple[float, np.ndarray]:
        """Score of a document and the attention weights of its passages."""
        forward = _forward(self.weights, (passages - self.mean) / self.scale, np.zeros(1, int))
        return float(forward["score"][0]), forward["attention"]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Scores of several bags; ``starts`` has the first passage of each."""
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    h = np.tanh(x @ w["encode"] + w["encode_bias"])
    view, gate = np.tanh(h @ w["view"]), 1 / (1 + np.exp(-(h @ w["gate"])))
    energy = (view * gate) @ w["attend"]
    e = np.exp(energy - np.maximum.reduceat(energy, starts)[of])
    attention = e / np.add.reduceat(e, starts)[of]
    z = np.add.reduceat(attention[:, None] * h, starts)
    score = 1 / (1 + np.exp(-(z @ w["out"] + w["out_bias"][0])))
    return {"of": of, "h": h, "view": view, "gate": gate, "attention": attention, "z": z, "score": score}


def _gradients(w: dict, f: dict, x: np.ndarray, starts: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
    error = (f["score"] - truth) / len(truth)
    to_z = np.outer(error, w["out"])[f["of"]]
    to_attention = (to_z * f["h"]).sum(1)
    mean = np.add.reduceat(f["attention"] * to_attention, starts)[f["of"]]
    to_energy = f["attention"] * (to_attention - mean)
    both = np.outer(to_energy, w["attend"])
    to_view = both * f["gate"] * (1 - f["view"] ** 2)
    to_gate = both * f["view"] * f["gate"] * (1 - f["gate"])
    to_h = f["attention"][:, None] * to_z + to_view @ w["view"].T + to_gate @ w["gate"].T
    to_x = to_h * (1 - f["h"] ** 2)
    return {
        "encode": x.T @ to_x, "encode_bias": to_x.sum(0), "view": f["h"].T @ to_view, "gate": f["h"].T @ to_gate,
        "attend": (f["view"] * f["gate"]).T @ to_energy, "out": f["z"].T @ error, "out_bias": np.array([error.sum()]),
    }


def train(bags: list[np.ndarray], truth: np.ndarray, hidden: int = 24, epochs: int = 40, rate: float = 0.01, seed: int = 3) -> QualityModel:
    """Adam over batches of 64 bags; every bag has at least one passage."""
    random = np.random.default_rng(seed)
    every = np.concatenate([*bags, np.empty((0, FEATURES), np.float32)])
    mean = every.mean(0) if len(every) else np.zeros(FEATURES)
    scale = every.std(0) + 0.02 if len(every) else np.ones(FEATURES)
    shapes = {"encode": (FEATURES, hidden), "view": (hidden, 12), "gate": (hidden, 12), "attend": (12,), "out": (hidden,)}
    w = {k: random.normal(0, s[0] ** -0.5, s) for k, s in shapes.items()}
    w |= {"encode_bias": np.zeros(hidden), "out_bias": np.zeros(1)}
    bags = [(b - mean) / scale for b in bags]
    first, second, step = {k: 0.0 for k in w}, {k: 0.0 for k in w}, 0
    for epoch in range(epochs):
        order = random.permutation(len(bags))
        for at in range(0, len(order), 64):
            chosen = order[at : at + 64]
            x = np.concatenate([bags[k] for k in chosen])
            starts = np.cumsum([0, *(len(bags[k]) for k in chosen[:-1])])
            g = _gradients(w, _forward(w, x, starts), x, starts, truth[chosen])
            step += 1
            slower = rate * (1 - 0.9 * epoch / epochs)
            for k in w:
                grad = g[k] + 1e-4 * w[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                w[k] = w[k] - slower * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return QualityModel(mean, scale, w)


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = 6000, bag_passages: int = 128,
    doc_id: str = "doc_id", text: str = "text", label: str = "quality", seed: int = 3,
) -> QualityModel:
    """Train on a bounded sample: ``sample`` labelled ids that are not held out.

    The ids with the smallest hashes are taken; of a longer document ``bag_passages``
    evenly spaced passages train.  Null labels and ids are left out, of several
    labels of an id the smallest holds.  Without a labelled row every score is 0.5.
    """
    key = F.col(doc_id)
    marked = labels.where(key.isNotNull() & F.col(label).isNotNull() & ~held_out(key))
    marked = marked.groupBy(key.alias("doc_id")).agg(F.min(label).alias("truth"))
    drawn = hashed_sample(marked, F.col("doc_id"), marked.count(), sample, seed)
    chosen = drawn.orderBy("place", "doc_id").limit(sample).drop("place")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for batch in batches:
            found = []
            for body in batch["text"]:
                rows = encoder.passages(body.as_py())
                if len(rows) > bag_passages:
                    rows = rows[np.linspace(0, len(rows) - 1, bag_passages).astype(int)]
                found.append(rows.tobytes())
            columns = [batch["doc_id"], batch["truth"], pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "truth", "bag"])

    bodies = docs.select(key.alias("doc_id"), F.col(text).alias("text"))
    # The sample has a fixed number of rows, so it can be sent to every task.
    joined = bodies.join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long"), F.col("truth").cast("double"), "text")
    encoded = joined.mapInArrow(encode, "doc_id long, truth double, bag binary")
    # One bag per id, so what is collected is bounded also where a sampled id repeats.
    rows = encoded.groupBy("doc_id").agg(F.min("truth").alias("truth"), F.min("bag").alias("bag")).collect()
    rows = sorted((r["doc_id"], r["truth"], r["bag"]) for r in rows if r["bag"])
    bags = [np.frombuffer(bytes(b), np.float32).reshape(-1, FEATURES) for _, _, b in rows]
    model = train(bags, np.array([t for _, t, _ in rows]))
    if not bags:
        model.weights["out"][:] = 0
    return model


def quality_of(model: QualityModel, text: Column) -> Column:
    """Score of a whole text, 0 to 1; a null text or one without a word has 0."""
    shared = {"model": model}

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        encoder, known = Encoder(), shared["model"]
        for texts in batches:
            bags = (encoder.passages(t.as_py()) for t in texts)
            yield pa.array([float(known.bag(b)[0]) if len(b) else 0.0 for b in bags], pa.float64())
        trim()

    return score(text)


def score(docs: DataFrame, model: QualityModel, accept: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, held out or not, score, and 1 from ``accept`` on.

    Repeated rows stay, a null id stays null, an empty table gives no row, and other
    columns are not read.
    """
    key = F.col(doc_id)
    scored = docs.select(key.alias("doc_id"), held_out(key).alias("held_out"), quality_of(model, F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= accept).cast("int"))
