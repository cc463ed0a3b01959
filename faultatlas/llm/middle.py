"""Fill-in-middle forms of whole documents, cut by memoized content-defined chunks.

A rolling hash over the last 32 characters decides where a text is cut, so a passage
that many documents share gives the same chunks in all of them.  What a chunk adds to
the count of units depends on its content and on the characters next to it only: its
summary is the units that end inside it and whether it begins and ends with white
space.  Summaries are kept per worker under the chunk's whole content, so a hit is a
verified equal chunk, not an equal hash.  The units of a text are the combined counts
of its chunks; the chunk in which a wanted unit ends is found by a search in the
running counts, and only that chunk is read again.

A unit is white space and the run of other characters behind it, or the white space
at the end of the text (white space: blank, and the characters 9 to 13).
"""

from __future__ import annotations

from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WINDOW = 32
LEAST, MEAN, MOST = 256, 1024, 8192
CACHE_BYTES = 32 << 20
_FACTOR = np.uint32(0x2C1B3C6D)
# What remembering one chunk takes besides its characters.
_ENTRY_BYTES = 400


class Summary(NamedTuple):
    """What a chunk tells of units: those that end before its last character, and its two ends."""

    inner: int
    opens_white: bool
    closes_white: bool


def white_space(points: np.ndarray) -> np.ndarray:
    return (points == 32) | ((points >= 9) & (points <= 13))


def rolling_hash(points: np.ndarray) -> np.ndarray:
    """Hash of the ``WINDOW`` characters that end at each place (fewer at the begin).

    Hashes of twice as many characters come from two neighbouring ones, so the number
    of passes is the logarithm of the window.
    """
    h = (points + np.uint32(1)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    width, factor = 1, int(_FACTOR)
    while width < WINDOW:
        h[width:] += h[:-width] * np.uint32(factor)
        factor = factor * factor & 0xFFFFFFFF
        width *= 2
    return h


def chunk_ends(points: np.ndarray) -> list[int]:
    """Where the chunks of a text end: at hits of the rolling hash, ``LEAST`` to ``MOST`` characters long."""
    size = len(points)
    if size <= LEAST:
        return [size] if size else []
    # The high bits depend on the whole window.
    hits = (np.flatnonzero(rolling_hash(points) < np.uint32((1 << 32) // MEAN)) + 1).tolist()
    ends, at = [], 0
    while size - at > LEAST:
        k = bisect_left(hits, at + LEAST)
        at = min(hits[k] if k < len(hits) else size, at + MOST, size)
        ends.append(at)
    if at < size:
        ends.append(size)
    return ends


def _inner_ends(white: np.ndarray) -> np.ndarray:
    return ~white[:-1] & white[1:]


class Units:
    """Counts and places of units in texts; chunk summaries are kept up to a number of bytes.

    The chunks not used for the longest time are dropped first.  What is kept
    affects the time only.
    """

    def __init__(self, bound: int = CACHE_BYTES):
        self.bound, self.used = bound, 0
        self.known: OrderedDict[str, Summary] = OrderedDict()
        self.hits = 0

    def summary(self, chunk: str, points: np.ndarray) -> Summary:
        found = self.known.get(chunk)
        if found is not None:
            self.hits += 1
            self.known.move_to_end(chunk)
            return found
        white = white_space(points)
        found = Summary(int(np.count_nonzero(_inner_ends(white))), bool(white[0]), bool(white[-1]))
        self.known[chunk] = found
        self.used += 4 * len(chunk) + _ENTRY_BYTES
        while self.used > self.bound:
            oldest, _ = self.known.popitem(last=False)
            self.used -= 4 * len(oldest) + _ENTRY_BYTES
        return found

    def cuts(self, text: str, first: int, second: int) -> tuple[int, int, int]:
        """Units ``n`` of a text, and the places behind its smaller and larger draw modulo ``n + 1``."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = chunk_ends(points)
        if not ends:
            return 0, 0, 0
        starts = [0, *ends[:-1]]
        found = [self.summary(text[a:b], points[a:b]) for a, b in zip(starts, ends, strict=True)]
        # A unit ends at a chunk's end if white space opens the next one, or if the text ends there.
        counts, total = [], 0
        for one, after in zip(found, [*found[1:], None], strict=True):
            total += one.inner + (after is None or (not one.closes_white and after.opens_white))
            counts.append(total)
        places = sorted((first % (total + 1), second % (total + 1)))
        return total, *(self._end_of(unit, counts, starts, ends, points) for unit in places)

    @staticmethod
    def _end_of(unit: int, counts: list[int], starts: list[int], ends: list[int], points: np.ndarray) -> int:
        if unit == 0:
            return 0
        k = bisect_left(counts, unit)
        within = unit - (counts[k - 1] if k else 0)
        inside = np.flatnonzero(_inner_ends(white_space(points[starts[k] : ends[k]])))
        return starts[k] + int(inside[within - 1]) + 1 if within <= len(inside) else ends[k]


def unit_cuts(text: Column, first: Column, second: Column) -> Column:
    """Struct of ``n``, ``begin`` and ``end``: units of a text and the two cuts that the draws choose."""

    @F.pandas_udf("n long, begin long, end long")
    def cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        units = Units()
        for texts, one, two in batches:
            rows = [units.cuts(t, a, b) for t, a, b in zip(texts, one, two, strict=True)]
            yield pd.DataFrame(rows, columns=["n", "begin", "end"])

    return cuts(text, first, second)


def draws(doc_id: Column, seed: int) -> Column:
    """Four unsigned 32-bit draws of a document's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))


def _sections(output: Column, second: str) -> tuple[Column, Column, Column]:
    """What stands behind the first marker, behind ``second`` and behind the middle's marker."""
    body = F.substring(output, len(PREFIX) + 1, 1 << 30)
    rest = F.substring_index(body, second, -1)
    return F.substring_index(body, second, 1), F.substring_index(rest, MIDDLE, 1), F.substring_index(rest, MIDDLE, -1)


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of; the markers occur once each, since texts that hold one stay plain."""
    prefix, suffix, middle = _sections(output, SUFFIX)
    suffix_first, prefix_second, last = _sections(output, PREFIX)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(prefix, middle, suffix))
        .otherwise(F.concat(prefix_second, last, suffix_first))
    )


def fill_in_middle(
    docs: DataFrame, share: int = 50, suffix_first: int = 80, seed: int = 42, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: one row per input row.

    ``share`` percent of the texts are rearranged, ``suffix_first`` percent of those as
    suffix, prefix, middle, the others as prefix, suffix, middle.  Texts without a
    character or with a marker stay plain.  A null text is empty; a null id is drawn
    for as an empty one; repeated rows stay and are rearranged alike; an empty table
    gives no row; other columns are not read.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        draws(F.col(doc_id), seed).alias("drawn"),
    )
    body, drawn = F.col("text"), F.col("drawn")
    marked = F.contains(body, F.lit(PREFIX)) | F.contains(body, F.lit(SUFFIX)) | F.contains(body, F.lit(MIDDLE))
    plain = (body == "") | marked | (drawn[2] % 100 >= share)
    form = F.when(plain, "plain").when(drawn[3] % 100 < suffix_first, "spm").otherwise("psm")
    counted = rows.select("doc_id", "text", form.alias("form"), unit_cuts(body, drawn[0], drawn[1]).alias("at"))
    begin, end = F.col("at.begin").cast("int"), F.col("at.end").cast("int")
    prefix, middle = F.substring(body, F.lit(1), begin), F.substring(body, begin + 1, end - begin)
    suffix = F.substring(body, end + 1, F.lit(1 << 30))
    output = (
        F.when(F.col("form") == "plain", body)
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    moved = F.col("form") != "plain"
    return counted.select(
        "doc_id",
        F.col("at.n").alias("n"),
        "form",
        F.when(moved, F.col("at.begin")).alias("prefix_chars"),
        F.when(moved, F.col("at.end") - F.col("at.begin")).alias("middle_chars"),
        output.alias("output"),
    )


def digests(forms: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with digests of the output and of the text rebuilt from it."""
    return forms.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
