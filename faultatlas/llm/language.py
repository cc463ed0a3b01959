"""Language of a text: averaged hashed subword embeddings and a linear softmax.

A word is the bag of its 2- to 4-grams and itself, hashed into a table of vectors; a
text is the mean of the vectors of all its words' subwords.  Vectors and softmax are
trained together by stochastic gradient descent in numpy on a bounded sample of
labelled rows; a temperature, fitted on sampled rows the training did not see, turns
the softmax into a calibrated probability.  A text whose best probability is below
``reject_below`` (more likely wrong than right, at the default), or that has no
letter, is rejected.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultatlas.llm.worker import forget, trim

UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Rows kept for tests: crc32 of the id's text divisible by 5.  A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def hashed_sample(rows: DataFrame, key: Column, n: int, size: int, seed: int) -> DataFrame:
    """About ``size`` of ``n`` rows or a few more, those with the smallest hashes, with the hash as ``place``.

    The rows are filtered where they are read, so no task sends more than its share.
    """
    share = min(1.0, (1.2 * size + 50) / max(n, 1))
    place = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30))
    return rows.withColumn("place", place).where(F.col("place") < int(share * (1 << 30)))


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    return _WORD.findall(text.lower()) if text else []


def subword_blocks(word: str, buckets: int, size: int = 4096) -> Iterator[list[int]]:
    """Hashed 2- to 4-grams of a whole word between marks, and the word itself.

    A word may be a whole text in scripts without blanks.  A block has the n-grams that
    start at ``size`` characters, so memory is bounded and no n-gram is lost.
    """
    if not any(c.isalpha() for c in word):
        return
    marked, whole = f"<{word}>", 0
    for at in range(0, len(marked), size):
        here = marked[at : at + size + 3].encode("utf-32-le")
        whole = zlib.crc32(here[: 4 * size], whole)
        starts = range(0, min(4 * size, len(here)), 4)
        yield [zlib.crc32(here[a : a + 4 * n]) % buckets for n in (2, 3, 4) for a in starts if a + 4 * n <= len(here)]
    yield [whole % buckets]


def subwords(word: str, buckets: int) -> list[int]:
    """All hashed subwords of a word."""
    return [i for block in subword_blocks(word, buckets) for i in block]


@dataclass
class LanguageModel:
    """``table`` holds, for every bucket, its vector times the softmax weights."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        z = (mean + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


class Scorer:
    """Scores texts; the sums of up to ``remembered`` words of at most 64 letters are kept between them."""

    def __init__(self, model: LanguageModel, remembered: int = 400_000):
        self.model, self.remembered = model, remembered
        self.row: dict[str, int] = {}
        self.sums = np.zeros((1024, len(model.languages) + 1), np.float32)

    def _sum(self, word: str) -> np.ndarray:
        total = np.zeros(self.sums.shape[1])
        for ids in subword_blocks(word, len(self.model.table)):
            total += np.append(self.model.table[ids].sum(0), len(ids))
        return total

    def _totals(self, words: list[str]) -> np.ndarray:
        beyond = np.zeros(self.sums.shape[1])
        rows = []
        for w in words:
            k = self.row.get(w)
            if k is None:
                if len(self.row) >= self.remembered or len(w) > 64:
                    beyond += self._sum(w)
                    continue
                k = self.row[w] = len(self.row)
                if k >= len(self.sums):
                    self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
                self.sums[k] = self._sum(w)
            rows.append(k)
        return beyond + self.sums[rows].sum(0, dtype=np.float64)

    def score(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, accepted; ``und``, 0, false without a letter."""
        words = words_of(text)
        total = np.zeros(self.sums.shape[1])
        for at in range(0, len(words), 100_000):
            total += self._totals(words[at : at + 100_000])
        if not total[-1] or not self.model.languages:
            return UNKNOWN, 0.0, False
        p = self.model.probabilities(total[:-1] / total[-1])
        best = int(p.argmax())
        return self.model.languages[best], float(p[best]), bool(p[best] >= self.model.reject_below)


def fit(
    rows: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
    sample: int = 3000, sample_chars: int = 1000, buckets: int = 1 << 16, dim: int = 16,
    epochs: int = 4, rate: float = 0.5, reject_below: float = 0.5, seed: int = 11,
) -> LanguageModel:
    """Train on a bounded sample of labelled rows.

    Of the rows with text, language and id that are not held out, the ``sample`` with
    the smallest hashes are taken, and of each at most ``sample_chars`` characters
    from a hashed place.  Every fifth of them calibrates.  Without a labelled row the
    model knows no language and answers ``und``.
    """
    room = F.greatest(F.length("body") - sample_chars, F.lit(0)) + 1
    known = rows.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("language"), F.col(text).alias("body"))
    known = known.where(F.col("language").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    drawn = hashed_sample(known, F.col("doc_id"), known.count(), sample, seed).where("body IS NOT NULL")
    start = F.pmod(F.xxhash64("doc_id"), room).cast("int") + 1
    taken = (
        drawn.select("place", F.substring(F.col("body"), start, F.lit(sample_chars)).alias("body"), "language")
        .orderBy("place", "body", "language")
        .limit(sample)
        .collect()
    )
    bags = []
    for row in taken:
        ids, n = np.unique([i for w in words_of(row["body"]) for i in subwords(w, buckets)], return_counts=True)
        if len(ids):
            bags.append(((ids.astype(int), n / n.sum()), row["language"]))
    languages = sorted({language for _, language in bags})
    place = {language: k for k, language in enumerate(languages)}
    random = np.random.default_rng(seed)
    vectors = random.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    weights, bias = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    train = [k for k in range(len(bags)) if k % 5]
    calibrate = [k for k in range(len(bags)) if not k % 5]
    steps = epochs * max(1, len(train))
    step = 0
    for _ in range(epochs):
        for k in random.permutation(train) if train else []:
            (ids, share), language = bags[k]
            slower = rate * (1 - step / steps)
            step += 1
            mean = share @ vectors[ids]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[place[language]] -= 1
            back = weights @ p
            weights -= slower * np.outer(mean, p).astype(np.float32)
            bias -= slower * 0.1 * p.astype(np.float32)
            vectors[ids] -= (slower * share[:, None] * back).astype(np.float32)
    model = LanguageModel(languages, vectors @ weights, bias, 1.0, reject_below)
    if calibrate and languages:
        means = np.array([bags[k][0][1] @ model.table[bags[k][0][0]] for k in calibrate])
        truth = [place[bags[k][1]] for k in calibrate]

        def loss(temperature: float) -> float:
            model.temperature = temperature
            p = model.probabilities(means)[np.arange(len(truth)), truth]
            # Among equally good temperatures the one nearest to 1 is taken.
            return float(-np.log(np.maximum(p, 1e-12)).mean() + 1e-3 * abs(np.log(temperature)))

        model.temperature = min(np.geomspace(0.05, 20, 60), key=loss)
    return model


def language_of(model: LanguageModel, text: Column) -> Column:
    """Struct of ``lang_pred``, ``score`` and ``accepted`` of a whole text.

    A null text, or one without a letter, is ``und`` with score 0, not accepted.
    """
    shared = {"model": model}

    fields = {"lang_pred": pa.string(), "score": pa.float64(), "accepted": pa.bool_()}

    # Arrow, not pandas: a worker that never loads pandas is 27 MB smaller.
    @F.arrow_udf("lang_pred string, score double, accepted boolean")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        scorer = Scorer(shared["model"])
        for texts in batches:
            found = [dict(zip(fields, scorer.score(t.as_py()), strict=True)) for t in texts]
            yield pa.array(found, pa.struct(list(fields.items())))
        trim()

    return score(text)


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, held out or not, language, score, accepted.

    Repeated rows stay, a null id stays null, an empty table gives no row, and other
    columns are not read.
    """
    key = F.col(doc_id)
    found = docs.select(key.alias("doc_id"), held_out(key).alias("held_out"), language_of(model, F.col(text)).alias("found"))
    return found.select("doc_id", "held_out", "found.*")
