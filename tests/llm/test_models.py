"""Quality, language and rules: learned models on made rows, defined results for odd ones."""

from __future__ import annotations

import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import helpers

from faultatlas.llm import language, quality, rules

GERMAN = "der die und nicht garten winter straße haus musik grün silber über schön lesen".split()


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def test_language_of_held_out_rows(spark):
    rows = [(k, helpers.prose(k, 40, GERMAN if k % 2 else helpers.WORDS), "de" if k % 2 else "en") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    truth = {i: lang for i, _, lang in rows}
    assert all(got[i].lang_pred == truth[i] for i in got if got[i].held_out)
    assert {i: r.held_out for i, r in got.items()} == {i: held(i) for i in truth}
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = language.identify(helpers.frame(spark, [*helpers.odd_rows(), (50, "123 ½ ²")]), model).collect()
    assert len(odd) == len(helpers.odd_rows()) + 1
    for r in odd:
        if r.doc_id in (1, 2, 3, 50):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
        else:
            assert r.lang_pred in ("de", "en")
    assert language.identify(docs.limit(0), model).count() == 0


def test_language_without_labels_is_unknown(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert {r.lang_pred for r in language.identify(docs, model).collect()} == {"und"}


def test_language_labels_of_held_out_rows_do_not_matter(spark):
    rows = [(k, helpers.prose(k, 30, GERMAN if k % 2 else helpers.WORDS), "de" if k % 2 else "en") for k in range(60)]
    schema = "doc_id long, text string, lang string"
    wrong = [(i, t, "xx" if held(i) else lang) for i, t, lang in rows]
    one, other = (language.fit(spark.createDataFrame(r, schema)) for r in (rows, wrong))
    assert one.languages == other.languages and np.array_equal(one.table, other.table)


def test_runs_without_blanks_count_whole():
    pick, buckets = random.Random(4), 1 << 12
    table = np.random.default_rng(4).normal(size=(buckets, 3)).astype(np.float32)
    model = language.LanguageModel(["a", "b", "c"], table, np.zeros(3, np.float32), 0.02, 0.5)
    for n in (1, 2, 63, 64, 65, 200, 4093, 4094, 4095, 4096, 4097, 8190, 8191, 100_000):
        run = "".join(chr(pick.randint(0x4E00, 0x9FFF)) for _ in range(n))
        marked = f"<{run}>"
        grams = [marked[k : k + m] for m in (2, 3, 4) for k in range(len(marked) - m + 1)] + [marked]
        ids = [zlib.crc32(g.encode("utf-32-le")) % buckets for g in grams]
        assert Counter(language.subwords(run, buckets)) == Counter(ids)
        scorer = language.Scorer(model)
        p = model.probabilities(table[ids].astype(float).mean(0))
        for _ in range(2):
            found = scorer.score(run)
            assert found[0] == model.languages[int(p.argmax())] and abs(found[1] - p.max()) < 1e-3
        assert all(len(w) <= 64 for w in scorer.row)


def test_language_of_a_run_is_not_that_of_its_start(spark):
    rows = [(k, helpers.prose(k, 40, GERMAN if k % 2 else helpers.WORDS), "de" if k % 2 else "en") for k in range(300)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    run = "".join(helpers.WORDS)[:70] + "".join(GERMAN) * 1000
    assert language.Scorer(model).score(run)[0] == "de"


def junk(k):
    return " ".join(w + random.Random(k).choice(["&&&", "***", "%%%"]) for w in helpers.prose(k, 50).split())


def test_quality_of_held_out_rows(spark):
    rows = [(k, junk(k) if k % 4 == 0 else helpers.prose(k, 30 + k % 300)) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(400)] + [(3, 1), (None, 0), (7, None)], "doc_id long, quality int")
    docs = helpers.frame(spark, rows)
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert all(r.predicted == int(r.doc_id % 4 != 0) for r in got.values() if r.held_out)
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())
    odd = quality.score(helpers.frame(spark, helpers.odd_rows()), model).collect()
    assert len(odd) == len(helpers.odd_rows())
    assert all(r.score == 0.0 for r in odd if r.doc_id in (1, 2, 3)) and all(0 <= r.score <= 1 for r in odd)
    assert quality.score(docs.limit(0), model).count() == 0
    nothing = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, nothing).collect()} == {0.5}


def test_attention_finds_the_telling_passage(spark):
    """One bad passage among good ones decides, and gets the largest weight."""
    pick, bags, truth = np.random.default_rng(2), [], []
    for k in range(300):
        bag = pick.normal(0, 1, (6, quality.FEATURES)).astype(np.float32)
        if k % 2:
            bag[pick.integers(6), 3] += 8
        bags.append(bag)
        truth.append(1 - k % 2)
    model = quality.train(bags[:200], np.array(truth[:200], float))
    scored = [model.bag(b) for b in bags[200:]]
    assert np.mean([(s >= 0.5) == t for (s, _), t in zip(scored, truth[200:], strict=True)]) > 0.9
    bad = [(a, b) for (_, a), b, t in zip(scored, bags[200:], truth[200:], strict=True) if not t]
    assert np.mean([a.argmax() == b[:, 3].argmax() for a, b in bad]) > 0.8


def test_passages_cover_the_whole_text():
    encoder = quality.Encoder()
    text = helpers.prose(1, 1000)
    assert len(encoder.passages(text)) == -(-1000 // quality.PASSAGE_WORDS)
    assert len(encoder.passages(None)) == len(encoder.passages(" \n")) == 0
    assert not np.array_equal(encoder.passages(text)[-1], encoder.passages(text + "&&&")[-1])


def base(text):
    x = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", x)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 8))
    lines = [line for line in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered), failed


def test_base_measures_equal_brute_force(spark):
    pick = random.Random(4)
    texts = [t for _, t in helpers.odd_rows()]
    texts += ["".join(pick.choice("ab \n\t#|é ") for _ in range(pick.randint(0, 300))) for _ in range(150)]
    texts += [" ".join(pick.choice("abc") for _ in range(60)) for _ in range(20)] + ["x\n\ny\nx\n y\ny"]
    rows = list(enumerate(texts))
    got = rules.judge(helpers.frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == {
        i: base(t) for i, t in rows
    }
    assert not any(r.kept and r.base_failed for r in got)
    assert rules.judge(helpers.frame(spark, [])).count() == 0


def test_rules_reject_junk_and_leave_clean_rows(spark):
    rows = [(k, junk(k) if k % 10 == 0 else helpers.prose(k, 60, [f"w{k}x{n}" for n in range(90)])) for k in range(200)]
    got = {r.doc_id: r.kept for r in rules.judge(helpers.frame(spark, rows)).collect()}
    assert got == {k: k % 10 != 0 for k in range(200)}
