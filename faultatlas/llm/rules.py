"""Quality rules as weak supervision: rules vote or abstain, their accuracies are learned.

Each rule looks at one measure of a whole text and votes good, bad or not at all.
Expectation-maximisation over the counts of vote patterns (at most three to the power
of the number of rules, at any corpus size) estimates how often each rule is right on
good and on bad documents; the posterior probability of being good replaces a filter
that all rules must pass.  Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultatlas.plans.layout import cut

WINDOW = 8
_BLANK = r"[\x20\x09-\x0D]+"
_NOT_BLANK = r"[^\x20\x09-\x0D]"


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of a whole text to every row, next to the columns it has.

    They are one struct ``measures``: words, characters in words, symbols, repeated
    lines, words in repeated windows, lines, capitals, letters, exclamation marks,
    sentence ends, distinct words.  A null text counts as empty.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    staged = docs.withColumn("__text", body)
    staged = staged.withColumn("__words", F.array_remove(F.split("__text", _BLANK), ""))
    staged = staged.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    staged = staged.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda line: line.rlike(_NOT_BLANK)))
    n = F.size("__hashes")
    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda k: F.xxhash64(F.slice("__hashes", k, WINDOW)))
    staged = staged.withColumn("__windows", F.when(n >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    # Most texts repeat no window; only the others have their windows sorted by place.
    several = F.size("__windows") > F.size(F.array_distinct("__windows"))
    placed = F.array_sort(F.transform("__windows", lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
    staged = staged.withColumn("__placed", F.when(several, placed))

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(F.get("__placed", a)["h"] == F.get("__placed", b)["h"], F.lit(False))

    repeated = F.filter(
        F.transform("__placed", lambda x, k: F.when(same(k, k - 1) | same(k, k + 1), x["k"])), lambda x: x.isNotNull()
    )
    staged = staged.withColumn("__repeated", F.array_sort(repeated))
    # Every repeated window covers its words up to the next repeated window.
    covered = F.aggregate(
        F.transform("__repeated", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__repeated", k + 1) - x, F.lit(WINDOW)))),
        F.lit(0),
        lambda total, x: total + x,
    )

    def without(pattern: str) -> Column:
        return F.length("__text") - F.length(F.regexp_replace("__text", pattern, ""))

    counted = {
        "n_words": n,
        "word_chars": F.length("__text") - without(_BLANK),
        "n_symbols": without(r"[#*$%&|<>]+"),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size("__lines"),
        "n_capitals": without(r"\p{Lu}+"),
        "n_letters": without(r"\p{L}+"),
        "n_marks": without("!+"),
        "n_ends": without("[.?!]+"),
        "n_distinct": F.size(F.array_distinct("__hashes")),
    }
    found = F.struct(*(c.cast("long").alias(name) for name, c in counted.items()))
    return staged.select(*docs.columns, found.alias("measures"))


def votes(m: Column) -> dict[str, Column]:
    """1 (good), 0 (bad) or null (abstains) of every rule on the measures ``m``.

    Most rules look for one defect and abstain where they do not see it.
    """

    def vote(bad: Column, good: Column | None = None) -> Column:
        found = F.when(bad, F.lit(0))
        return (found if good is None else found.when(good, F.lit(1))).cast("int")

    words, chars = m["n_words"], m["word_chars"]
    return {
        "symbols": vote(m["n_symbols"] * 5 > words),
        "repeats": vote(m["n_repeat_words"] * 5 > words),
        "lines": vote((m["n_lines"] >= 6) & (m["n_dup_lines"] * 10 > m["n_lines"] * 4)),
        "word_length": vote((chars > words * 15) | (chars < words * 2), (chars <= words * 10) & (chars >= words * 3)),
        "capitals": vote((m["n_letters"] >= 50) & (m["n_capitals"] * 10 > m["n_letters"] * 4)),
        "marks": vote((words >= 20) & (m["n_marks"] * 5 > words)),
        "sentences": vote((words >= 40) & (m["n_ends"] * 100 < words), m["n_ends"] * 40 >= words),
        "variety": vote((words >= 20) & (m["n_distinct"] * 5 < words), m["n_distinct"] * 2 >= words),
    }


Rates = dict[str, dict[int | None, float]]


def start_rates(names: list[str], own: str | None) -> Rates:
    """How often the rules vote bad, good or abstain in a class, before anything is learned.

    On good documents (``own`` null) a defect is rare; the class of bad documents of
    a rule has the defect that the rule looks for.
    """
    rates = {}
    for name in names:
        bad = 0.002 if own is None else 0.9 if name == own else 0.1
        rates[name] = {0: bad, 1: (1 - bad) / 2, None: (1 - bad) / 2}
    return rates


def _bounded(rate: dict[int | None, float], low: float = 0.0, high: float = 1.0) -> dict[int | None, float]:
    """The rate of a bad vote within bounds, the others in their proportion."""
    bad = min(max(rate[0], low), high)
    scale = (1 - bad) / (1 - rate[0])
    return {0: bad, 1: rate[1] * scale, None: rate[None] * scale}


def learn(voted: DataFrame, names: list[str], rounds: int = 40, prior: float = 0.8) -> Column:
    """Probability of good by the votes in the columns ``names``, with learned accuracies.

    Bad documents are of one class per rule, since one defect seldom comes with the
    others.  One pass counts the vote patterns; the expectation-maximisation runs
    over those counts, whose number depends on the rules alone.  Without a row the
    start values hold.
    """
    rows = voted.groupBy(*names).count().collect()
    classes: list[str | None] = [None, *names]
    rates = {c: start_rates(names, c) for c in classes}
    share = {c: prior if c is None else (1 - prior) / len(names) for c in classes}
    total = sum(row["count"] for row in rows)
    for _ in range(rounds if rows else 0):
        # One document of each kind is added, so that no rate becomes 0.
        weight = dict.fromkeys(classes, 1.0)
        seen = {c: {n: dict.fromkeys((0, 1, None), 1.0) for n in names} for c in classes}
        for row in rows:
            logs = {c: math.log(share[c]) + sum(math.log(rates[c][n][row[n]]) for n in names) for c in classes}
            top = max(logs.values())
            all_of = sum(math.exp(x - top) for x in logs.values())
            for c in classes:
                expected = row["count"] * math.exp(logs[c] - top) / all_of
                weight[c] += expected
                for n in names:
                    seen[c][n][row[n]] += expected
        before = share
        share = {c: weight[c] / (total + len(classes)) for c in classes}
        rates = {c: {n: {v: x / (weight[c] + 2) for v, x in seen[c][n].items()} for n in names} for c in classes}
        for name in names:  # what the classes mean stays fixed
            rates[name][name] = _bounded(rates[name][name], low=0.9)
            rates[None][name] = _bounded(rates[None][name], high=0.005)
        if max(abs(before[c] - share[c]) for c in classes) < 1e-9:
            break

    def log_likelihood(c: str | None) -> Column:
        out = F.lit(math.log(share[c]))
        for n in names:
            bad, good, none = (F.lit(math.log(rates[c][n][v])) for v in (0, 1, None))
            out = out + F.when(F.col(n) == 0, bad).when(F.col(n) == 1, good).otherwise(none)
        return out

    fits_good = log_likelihood(None)
    against = [F.exp(log_likelihood(c) - fits_good) for c in names]
    return F.lit(1.0) / (F.lit(1.0) + sum(against[1:], against[0]))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: float = 0.5) -> DataFrame:
    """One row per input row: base measures, ``base_failed``, ``posterior`` and ``kept``.

    ``base_failed``: fewer than 20 words, or more than 30 percent of the words in
    repeated windows.  ``kept``: not failed, and posterior of at least ``keep``.  A
    null or empty text fails the base; null ids stay null, repeated rows stay, an
    empty table gives no row, other columns are not read.
    """
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    m = F.col("measures")
    rules = votes(m)
    names = [f"vote_{name}" for name in rules]
    counted = measures(chosen).select(
        "doc_id", "measures", *(c.alias(f"vote_{name}") for name, c in rules.items())
    )
    # Small rows, read twice: for the patterns and for the posteriors.
    counted = cut(counted)
    good = learn(counted, names)
    failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return counted.select(
        "doc_id", *(m[name].alias(name) for name in base), failed.alias("base_failed"),
        good.alias("posterior"),
    ).select(
        "doc_id", *base, "base_failed", (~F.col("base_failed") & (F.col("posterior") >= keep)).alias("kept"), "posterior"
    )
