"""Documents with what the operators have to stand: nulls, empty and long texts, ties, repeats, other columns."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, token string"
WORDS = "the of and river stone light garden winter paper house music green silver road field".split()


def prose(seed: int, words: int, vocabulary: list[str] = WORDS) -> str:
    pick = random.Random(seed)
    out = []
    while len(out) < words:
        line = [pick.choice(vocabulary) for _ in range(min(pick.randint(5, 12), words - len(out)))]
        out += line[:-1] + [line[-1] + "."]
    return " ".join(out)


def odd_rows() -> list[tuple]:
    """(doc_id, text): the cases every operator has to define."""
    long = prose(7, 30_000)
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, prose(5, 60)), (6, prose(5, 60)), (6, prose(5, 60)),
        (None, "no id here " + prose(9, 30)), (8, long), (9, "é 梦 𝄞 ▁x <|endoftext|>  two  blanks\n\nend "), (10, prose(5, 60) + " more"),
    ]


def frame(spark, rows):
    """A documents table whose other columns have names the operators use themselves."""
    full = [(i, t, "en", "s", len(t) if t is not None else None, 0.5, 1, "x") for i, t in rows]
    return spark.createDataFrame(full, DOCS)
