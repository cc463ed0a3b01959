"""Similar documents, fingerprints, surrogates, pages and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import helpers

from faultatlas.llm import fingerprints, html_text, jaccard, private
from faultatlas.llm.components import components


def groups_of(links, nodes):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


def test_components_of_paths_stars_and_rings(spark):
    pick = random.Random(3)
    names = list(range(60))
    pick.shuffle(names)
    links = [(names[i], names[i + 1]) for i in range(24)] + [(names[30], names[k]) for k in range(31, 40)]
    links += [(names[40 + i], names[40 + (i + 1) % 10]) for i in range(10)] + [(names[55], names[55]), (names[56], names[57])]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups_of(links, names)
    assert found == {n: want[n] for a, b in links if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text, n=4):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def changed(text, seed, n):
    words = text.split()
    pick = random.Random(seed)
    for _ in range(n):
        words[pick.randrange(len(words))] = f"new{pick.random()}"
    return " ".join(words)


@pytest.fixture(scope="module")
def similar_rows():
    base = [helpers.prose(k, 80, [f"w{k}x{n}" for n in range(200)]) for k in range(5)]
    rows = [(100 * k, b) for k, b in enumerate(base)]
    rows += [(100 * k + n, changed(b, n, n % 5)) for k, b in enumerate(base) for n in range(1, 25)]
    line = " ".join(f"common{n}" for n in range(20))
    rows += [(1000 + n, f"{line} own{n} {'tail%d ' % n * (n % 3)}") for n in range(30)]
    # A chain: each is similar to the next one only.
    words = [f"c{n}" for n in range(100)]
    rows += [(2000 - k, " ".join(words[2 * k : 2 * k + 60])) for k in range(20)]
    return rows + [(3000, "One  Two"), (3001, "one two"), (3002, "one three")] + helpers.odd_rows()


def test_groups_equal_all_pairs(spark, similar_rows):
    docs = helpers.frame(spark, similar_rows)
    sets = [shingle_set(t) for _, t in similar_rows]
    at = range(len(similar_rows))
    links = [
        (i, j) for i in at for j in range(i) if sets[i] and sets[j]
        and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    ]
    group = groups_of(links, at)
    ids = defaultdict(list)
    for k in at:
        ids[group[k]].append(similar_rows[k][0])
    least = {g: min((i for i in v if i is not None), default=None) for g, v in ids.items()}
    want = Counter((similar_rows[k][0], len(sets[k]), least[group[k]]) for k in at)
    for rounds in (0, 2):
        got = jaccard.similar_groups(docs, pivot_rounds=rounds).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    docs = docs.selectExpr("*", "1 AS __row", "2 AS row")
    kept = jaccard.first_of_groups(docs)
    assert kept.columns == docs.columns
    worded = {group[k] for k in at if sets[k]}
    first = Counter((least[g]) for g in worded) + Counter(similar_rows[k][0] for k in at if not sets[k])
    assert Counter(r.doc_id for r in kept.collect()) == first
    assert jaccard.first_of_groups(docs.limit(0)).count() == 0


def test_prefixes_that_meet_no_other_are_not_written(spark, monkeypatch):
    alike = " ".join(f"w{k}" for k in range(40))
    docs = helpers.frame(spark, [(k, " ".join(f"x{k}y{j}" for j in range(40))) for k in range(20)] + [(100, alike), (101, alike + " z"), (102, alike)])
    written = []
    cut = jaccard.cut
    monkeypatch.setattr(jaccard, "cut", lambda table: written.append(cut(table)) or written[-1])
    got = jaccard.similar_groups(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == {**{k: k for k in range(20)}, 100: 100, 101: 100, 102: 100}
    prefixes = [table for table in written if {"token", "node", "n", "at"} <= set(table.columns)]
    assert max(table.select("node").distinct().count() for table in prefixes) == 2


def test_prefixes_and_filters_lose_no_similar_pair():
    pick = random.Random(5)
    for _ in range(3000):
        n, extra = pick.randint(1, 60), pick.randint(0, 9)
        universe = list(range(90))
        a = set(pick.sample(universe, n))
        b = set(a)
        for _ in range(extra):
            b.symmetric_difference_update({pick.choice(universe)})
        if not b or 100 * len(a & b) < 85 * len(a | b):
            continue
        small, large = sorted((a, b), key=len)
        head, probe = (sorted(s)[: jaccard.prefix_length(len(s), 85)] for s in (small, large))
        assert set(head[: jaccard.index_length(len(small), 85)]) & set(probe)


def phrases(text):
    seen, begin = set(), 0
    for end in range(1, len(text) + 1):
        if text[begin:end] not in seen:
            seen.add(text[begin:end])
            begin = end
    return seen


def test_fingerprints_follow_the_phrase_sets(spark):
    rows = [(3 * k, helpers.prose(k, 20 + 13 * k % 150)) for k in range(40)] + [(500, None), (501, ""), (502, "é梦𝄞" * 40), (503, "aaa")]
    got = {r.doc_id: r for r in fingerprints.fingerprints(helpers.frame(spark, rows).repartition(4)).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        new = text[: len(text) - third] + after[:third]
        row = got[i]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert row.fingerprint == fingerprints.shown(fingerprints.fingerprint(text))
        assert row.edited_fingerprint == fingerprints.shown(fingerprints.fingerprint(new))
        for likeness, other in ((row.near_edited, new), (row.near_next, after)):
            x, y = phrases(text), phrases(other)
            exact = len(x & y) / len(x | y) if x | y else 1.0
            assert abs(likeness - exact) < 0.25
            if len(x | y) <= fingerprints.SIGNATURE:
                assert abs(likeness - exact) < 1e-9
    odd = fingerprints.fingerprints(helpers.frame(spark, helpers.odd_rows()))
    assert Counter(r.doc_id for r in odd.collect()) == Counter(i for i, _ in helpers.odd_rows())
    assert fingerprints.fingerprints(helpers.frame(spark, [])).count() == 0
    assert fingerprints.fingerprints(helpers.frame(spark, [(1, "one row")])).first().n_chars == 7


TEXTS = [
    "Write to ann.lee12@mail4.example.com or ANN.LEE12@MAIL4.EXAMPLE.COM, call +1 (706) 555-3138.",
    "+17065553138 is the same as +1 (706) 555-3138; not 1.2.3 or 12:30. IP 129.38.82.176, then 129.38.82.176###",
    'card 4111 1111 1111 1111 and 4111111111111111, token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"',
    "Mrs Anna Smith met Mr. John Brown and Mrs. Anna Smith. Госпожа Иванова. SSN 123-45-6789, DE89 3704 0044 0532 0130 00.",
    "nothing here 2024-01-02, 3.14159, 100 000 items",
]


def test_surrogates_keep_type_format_and_coreference(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(10 + k, TEXTS[0]) for k in range(3)] + [(20 + i, t) for i, t in enumerate([None, ""])]
    docs = helpers.frame(spark, rows)
    out = private.pseudonymize(docs, count="found")
    assert out.columns == [*docs.columns, "found"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows) and got[20].text is None and got[21].text == "" and got[4].text == TEXTS[4] and got[4].found == 0
    assert got[10].text == got[0].text == got[12].text
    lower, upper = re.findall(r"[\w.]+@[\w.]+\.com", got[0].text, re.I)
    assert upper == lower.upper() and lower != "ann.lee12@mail4.example.com" and re.fullmatch(r"[a-z]{3}\.[a-z]{3}\d\d@[a-z]{4}\d\.[a-z]{7}\.com", lower)
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[0].text)[0]
    assert phone != "+1 (706) 555-3138" and phone in got[1].text and "+" + re.sub(r"\D", "", phone) in got[1].text
    first, second = re.findall(r"\d+\.\d+\.\d+\.\d+", got[1].text)
    assert first == second != "129.38.82.176" and all(0 <= int(x) <= 255 for x in first.split("."))
    spaced, solid = re.findall(r"4[\d ]{14,17}\d", got[2].text.replace(" and", ","))
    digits = [int(d) for d in solid]
    assert spaced.replace(" ", "") == solid and sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0
    assert re.search(r'token = "[0-9a-f]{40}"', got[2].text) and "f3ef4d6b" not in got[2].text
    women = re.findall(r"Mrs\.? (\w+ \w+)", got[3].text)
    assert len(women) == 2 and women[0] == women[1] != "Anna Smith" and women[0].split()[0] in private._GIVEN["female", "latin"]
    assert re.search(r"Mr\. (\w+) \w+", got[3].text)[1] in private._GIVEN["male", "latin"] and re.search("Госпожа [А-Я][а-я]+", got[3].text)
    assert "123-45-6789" not in got[3].text and "0532" not in got[3].text
    other = {r.doc_id: r.text for r in private.pseudonymize(docs, key="other").collect()}
    assert other[0] != got[0].text and private.pseudonymize(docs.limit(0)).count() == 0


IBANS = [
    "NO9386011117947", "BE68539007547034", "NL91ABNA0417164300", "MK07250120000058984", "AT611904300234573201", "CH9300762011623852957",
    "DE89370400440532013000", "GB29NWBK60161331926819", "ES9121000418450200051332", "PT50000201231234567890154",
    "FR1420041010050500013M02606", "IT60X0542811101000000123456", "PL61109010140000071219812874", "MT84MALT011000012345MTLCAST001S",
    "SC18SSCB11010000000000001497USD", "MU17BOMM0101101030300200000MUR", "ZZ12ABCD34567890123456789012345678", "ZZ121234567890X", "DE8937040044053201300",
]


def test_account_numbers_of_all_lengths_are_replaced_whole(spark):
    spaced = [" ".join(i[k : k + 4] for k in range(0, len(i), 4)) for i in IBANS]
    rows = [(k, f"to {a}, or {b} AND {a} IS IT {b}.") for k, (a, b) in enumerate(zip(IBANS, spaced, strict=True))]
    got = {r.doc_id: r for r in private.pseudonymize(helpers.frame(spark, rows), count="found").collect()}
    for k, iban in enumerate(IBANS):
        shape = "".join(r"\d" if c.isdigit() else "[A-Z]" for c in iban)
        solid = re.match(f"to ({shape}), or ", got[k].text)[1]
        grouped = " ".join(solid[n : n + 4] for n in range(0, len(solid), 4))
        assert got[k].text == f"to {solid}, or {grouped} AND {solid} IS IT {grouped}." and got[k].found == 4
        assert solid[:2] == iban[:2] and not any(iban[n : n + 6] in solid for n in range(len(iban) - 5))


def test_clashing_surrogates_are_drawn_again(spark):
    values = [f"{a}{b}0000000" for a in range(10) for b in range(10)]
    entities = spark.createDataFrame([("ip", f"10.0.{k // 250}.{k % 250}") for k in range(400)] + [("ssn", v) for v in values], "kind string, value string")
    found = private.surrogates(entities, "k").collect()
    assert len(found) == 500 and len({(r.kind, r.surrogate) for r in found}) == 500
    assert not {(r.kind, r.surrogate) for r in found} & {(r.kind, r.value) for r in found}
    # So few names that many of the first draws clash.
    names = spark.createDataFrame([("ssn", str(k)) for k in range(60, 100)], "kind string, value string")
    small = private.surrogates(names.where("value < '64'"), "k").collect()
    assert len({r.surrogate for r in small}) == 4 and not {r.surrogate for r in small} & {"60", "61", "62", "63"}


def test_full_formats_end_the_draws(spark):
    """All values of a format are entities: the draws end, and as many as can be are distinct."""
    entities = spark.createDataFrame([("ssn", f"{k:02d}") for k in range(100)], "kind string, value string")
    found = private.surrogates(entities, "k").collect()
    assert len(found) == 100 and all(re.fullmatch(r"\d\d", r.surrogate) for r in found)
    assert len({r.surrogate for r in found}) > 60


def test_long_runs_like_entities_end_no_job(spark):
    """For every pattern a run that nearly or really fits, far longer than any entity."""
    long = 20_000
    runs = [
        "a@" + ".".join(["b"] * long) + ".com", "a@" + "-".join(["b"] * long) + ".com", "a." * long + "@x.org", "a@" + "b." * long,
        "x@" + "y" * long, "1" * long, "0a" * long, "A" * long, "GB29" + " ABCD" * long, "GB29" + "ABCD" * long, "+1" + " 23" * long,
        "1." * long, "1234-" * long, "Mrs " + "A" * long, "Mrs " + "Abc " * long, "Frau " + "A-" * long, "123-45-" * long,
    ]
    rows = [(k, f"see {run} end") for k, run in enumerate(runs)]
    got = {r.doc_id: r.text for r in private.pseudonymize(helpers.frame(spark, rows)).collect()}
    assert len(got) == len(rows) and all(t.startswith("see ") and t.endswith(" end") for t in got.values())
    assert runs[0] not in got[0] and runs[1] not in got[1]


def test_columns_of_any_name_stay(spark):
    rows = [(1, "mail a.b@c.org", "x", "y", "z"), (2, "none", "x", "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __digest string, __body string, __shown string")
    got = sorted(map(tuple, private.pseudonymize(docs).collect()))
    assert [r[2:] for r in got] == [r[2:] for r in rows] and got[1] == rows[1] and "a.b@c.org" not in got[0][1]


def test_odd_rows_pass_through_surrogates(spark):
    got = private.pseudonymize(helpers.frame(spark, helpers.odd_rows())).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(helpers.odd_rows())


def test_visible_text():
    page = (
        "<title>t</title><p>One<p>Two <b>bold</b>  x<ul><li>a<li>b<ol start=3><li>q<li>r</ol><li>c</ul><div hidden>no</div>"
        "<table><tr><th>Name<th>N<tr><td>Al<td>10<tr><td colspan=2>wide one</table>tail &amp; end<script>x</p></script>"
        "<pre> a\n  b</pre><!-- c --><p style='display: none'>h<p>after < 5<span aria-hidden=true>z</span>"
    )
    assert html_text.visible_text(page) == (
        "One\n\nTwo bold x\n\n- a\n- b\n  3. q\n  4. r\n- c\n\nName | N\nAl   | 10\nwide one\n\ntail & end\n\n a\n  b\n\nafter < 5"
    )
    assert html_text.visible_text(None) is None and html_text.visible_text("") == ""
    assert html_text.visible_text("<p>plain</div></p></b> text") == "plain\n\ntext"
    assert html_text.visible_text("<" * 1000) == "<" * 1000
    assert html_text.visible_text("<div>" * 50_000 + "x") == "x"
    assert "x" in html_text._safe("<table><tr><td>" * 2000 + "x")


@pytest.mark.parametrize(
    ("page", "shown"),
    [
        ("<table><form><tr><td>a<td>b</form></table>c", "a | b\n\nc"),
        ("<table><tr><form><td>a</td><td>b</td></form></tr></table>", "a | b"),
        ("<table><tbody><form action=x><tr><td>a</form><tr><td>b</table>", "a\nb"),
        ("<table><div>front</div><tr><td>a</table>behind", "front\n\na\n\nbehind"),
        ("<table><div>front<tr><td>a<td>b</table>", "front\n\na | b"),
        ("<table><tr>front<td>a</table>", "front\n\na"),
        ("<table><tr><td>a</td><b>fr</b>ont<td>b</table>", "front\n\na | b"),
        ("<table><tbody>front<tr><td>a</table>", "front\n\na"),
        ("<table><tr><td>a</table><table>front <i>x</i><thead>y<tr><th>h</table>", "a\n\nfront xy\n\nh"),
        ("<table><colgroup>front<tr><td>a<caption>title</table>", "front\n\ntitle\na"),
        ("<table><tr><td>a<table><p>in<tr><td>b</table>c</table>", "a\nin\nb\nc"),
        ("<table><tr><td>a</td><table><tr><td>b</table>c", "a\n\nb\n\nc"),
        ("<table><img alt=pic><input value=v><tr><td>a<textarea>t</textarea></table>", "picv\n\nat"),
        ("<table><template><tr><td>no</td></tr>no</template><tr><td>a</table>", "a"),
        ("<tr><form><td>a</td>b</form>", "ab"),
    ],
)
def test_all_that_stands_in_a_table_is_shown(page, shown):
    assert html_text.visible_text(page) == shown


def test_pages_keep_rows_and_other_columns(spark):
    rows = [(1, "u", "<p>a", "old"), (1, "u", "<p>a", "old"), (2, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, note string")
    out = html_text.extract(pages)
    assert out.columns == ["page_id", "url", "note", "text"]
    assert Counter(map(tuple, out.collect())) == Counter([(1, "u", "old", "a")] * 2 + [(2, None, None, None)])
    assert html_text.extract(pages.limit(0)).count() == 0


def test_pipeline_finds_near_copies_by_five_words_and_eighty_percent(spark):
    import corpus_pipeline

    def likeness(a, b, n):
        x, y = ({tuple(t[k : k + n]) for k in range(len(t) - n + 1)} for t in (a.split(), b.split()))
        return len(x & y) / len(x | y)

    def changed(words, at, n):
        return " ".join([*words[:at], *(f"new{k}" for k in range(n)), *words[at + n :]])

    first, second = ([f"{name}{k}" for k in range(200)] for name in ("one", "two"))
    near, far = changed(first, 90, 15), changed(second, 90, 20)
    assert likeness(" ".join(first), near, 5) >= 0.8 and likeness(" ".join(first), near, 4) < 0.85
    assert likeness(" ".join(second), far, 5) < 0.8
    docs = helpers.frame(spark, [(1, " ".join(first)), (2, near), (3, " ".join(second)), (4, far)])
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()) == [1, 3, 4]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "language_id", "ngram_jaccard", "private_surrogates", "best_fit_packing"]
    junk = " ".join(f"{w}&&&" for w in helpers.prose(1, 60).split())
    clean = [(k, helpers.prose(k, 60, [f"w{k}x{n}" for n in range(90)])) for k in range(1, 80) if k % 4]
    rows = clean + [(400 + k, junk + f" {k}") for k in range(40)] + [(900, clean[0][1]), (901, clean[1][1] + " x"), (902, "call +1 (706) 555-3138 " + helpers.prose(3, 50))]
    rows += [(950, None), (951, ""), (952, clean[2][1]), (952, clean[2][1])]
    folder = str(tmp_path)
    helpers.frame(spark, rows).drop("node", "token", "score").withColumn("lang", F.lit("en")).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1) for i, _ in clean] + [(400 + k, 0) for k in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.asDict() for r in docs.collect()}
        stage(spark, docs, folder).write.parquet(f"{folder}/{place}")
        docs = spark.read.parquet(f"{folder}/{place}")
        left = [r.doc_id for r in docs.collect()]
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name == "quality_classifier":
            assert {i for i, _ in clean} <= set(left) and not set(left) & {*range(400, 440), 950, 951}
        if name == "language_id":
            assert set(left) == set(before)
        if name == "ngram_jaccard":
            assert sorted(left) == sorted({i for i, _ in clean} | {902})
        if name == "private_surrogates":
            assert len(left) == len(before)
            row = next(r for r in docs.collect() if r.doc_id == 902)
            assert "555-3138" not in row.text and row.n_chars == len(row.text)
        if name == "best_fit_packing":
            assert set(left) == set(before)
    assert corpus_pipeline.run(spark, folder).count() == docs.count()
