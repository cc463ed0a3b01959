"""Vector codes, top products and fill-in-middle forms against brute force on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers

from faultatlas.llm import codes, middle, search

VECTORS = "vec_id long, embedding array<float>, label int, tile int, entry string, components long"


def vector_rows(n: int, dim: int = 16, seed: int = 1, repeats: bool = True):
    pick = random.Random(seed)
    rows = [(i, [round(pick.gauss(0, 0.2), 3) for _ in range(dim)], pick.choice([0, 1, None])) for i in range(n)]
    hot = rows[3][1]
    rows += [(n + i, hot, 2) for i in range(n // 3)]  # one common vector
    rows += [(5000, None, 1), (5020, [None] * dim, 1), (5040, [math.nan] * dim, 1), (5060, [math.inf] + [0.0] * (dim - 1), None)]
    if repeats:
        rows += rows[:5] + [(20, [1.0] * dim, 1), (None, [0.5] * dim, 1)]
    return rows


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "x", 2) for i, v, label in rows], VECTORS)


def integers(vector, scale):
    return [math.floor(scale * float(np.float32(x))) for x in vector]


def held(rows, scale):
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(i, tuple(integers(v, scale)), label) for i, v, label in good]


def brute_codes(rows, parts, entries, rounds, scale):
    kept = held(rows, scale)
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[r[1][p * width : (p + 1) * width] for p in range(parts)] for r in kept]
    books = [[list(one[p]) for one in cut[:entries]] for p in range(parts)]

    def assign():
        out = []
        for one in cut:
            near = [min((sum((a - b) ** 2 for a, b in zip(one[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)]
            out.append(near)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [one[p] for one, near in zip(cut, found, strict=True) if near[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in near) for near in found]
    by_label = defaultdict(int)
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] += e
    return Counter(
        (r[0], r[2], "".join(f"{k:02x}" for _, k in near), e, by_label[r[2]], digest) for r, near, e in zip(kept, found, errors, strict=True)
    )


@pytest.mark.parametrize(("n", "scale"), [(120, 4096.0), (9, 4096.0), (40, 1e13)])
def test_codes_equal_full_scans(spark, n, scale):
    """Also with fewer vectors than entries, and with distances beyond 64 bits."""
    rows = vector_rows(n)
    got = codes.compress(vector_frame(spark, rows).repartition(3), scale=scale)
    want = brute_codes(rows, 8, 16, 6, scale)
    if scale > 1e12:
        want = Counter({(*k[:3], min(k[3], codes._MOST), min(sum(min(x[3], codes._MOST) for x in want.elements() if x[1] == k[1]), codes._MOST), k[5]): c for k, c in want.items()})
    assert Counter(map(tuple, got.collect())) == want


def test_only_moved_entries_are_compared(spark):
    """Parts whose entry stays see moved entries only, and ties go to the lower index."""
    pick = np.random.default_rng(3)
    body = pick.integers(-3, 4, (400, 2, 2))
    books = pick.integers(-3, 4, (2, 6, 2)).astype(object)
    first = codes.Codebooks(books)
    flat = body.reshape(400, 4)
    state = codes.assign(flat, first, None, None)
    for _ in range(30):
        changed = books.copy()
        part, entry = pick.integers(0, 2), pick.integers(0, 6)
        changed[part, entry] = pick.integers(-3, 4, 2)
        known = codes.Codebooks(changed, (changed != books).any(axis=2))
        seen = []
        whole = codes.distances_to
        codes.distances_to = lambda a, b, keep=seen, whole=whole: keep.append((len(a), len(b))) or whole(a, b)
        try:
            after = codes.assign(flat, known, *state)
        finally:
            codes.distances_to = whole
        stayed = int((state[0][:, part] != entry).sum())
        if known.moved.any():
            assert sorted(seen) == sorted(x for x in ((400 - stayed, 6), (stayed, 1)) if x[0])
        else:
            assert not seen
        full = codes.assign(flat, codes.Codebooks(changed), None, None)
        assert (after[0] == full[0]).all() and (after[1] == full[1]).all()
        state, books = after, changed


def test_codes_of_other_lengths_and_no_rows(spark):
    rows = [(1, [0.1] * 8, 0), (2, [0.2] * 8, 0), (3, [0.3] * 16, None), (4, [], 1)]
    got = {r.vec_id: r for r in codes.compress(vector_frame(spark, rows)).collect()}
    assert got[1].code == "00" * 8 and got[2].code == "01" * 8 and got[1].error == got[1].label_error == 0
    assert got[3].code is None and got[3].error is None and got[4].code is None
    short = codes.compress(vector_frame(spark, [(1, [0.1] * 7, 0)])).collect()
    assert [(r.vec_id, r.code) for r in short] == [(1, None)]
    assert codes.compress(vector_frame(spark, [])).count() == 0
    assert codes.compress(vector_frame(spark, rows[:0] + [(1, None, 1)])).count() == 0


def brute_search(rows, k, scale, step):
    kept = {(i, v) for i, v, _ in held(rows, scale) if i is not None}
    out = Counter()
    for own in sorted(x for x in kept if x[0] % step == 0):
        scores = [(-sum(a * b for a, b in zip(own[1], v, strict=True)), i) for i, v in kept if i != own[0] and len(v) == len(own[1])]
        out.update((own[0], rank, i, -s) for rank, (s, i) in enumerate(sorted(set(scores))[:k], 1))
    return out


@pytest.mark.parametrize(("tile", "shard", "fan", "k"), [(4, 16, 2, 7), (2048, 4096, 4, 20), (3, 10, 3, 200)])
def test_top_products_equal_sorting_all(spark, tile, shard, fan, k):
    rows = vector_rows(150) + [(7000 + 20 * i, [0.25] * 8, 1) for i in range(3)] + [(8000, [], 1), (8001, [], 1)]
    table = vector_frame(spark, rows).repartition(5)
    got = search.top_products(table, table.where("vec_id % 20 = 0"), k=k, tile_queries=tile, shard_rows=shard, fan=fan)
    assert Counter(map(tuple, got.collect())) == brute_search(rows, k, 64.0, 20)


def test_top_products_of_large_numbers(spark):
    rows = vector_rows(40)
    table = vector_frame(spark, rows)
    got = search.top_products(table, table.where("vec_id % 20 = 0"), k=5, scale=float(1 << 30))
    assert Counter(map(tuple, got.collect())) == brute_search(rows, 5, float(1 << 30), 20)
    assert search.top_products(table.limit(0), table.limit(0)).count() == 0
    assert search.top_products(table, table.limit(0)).count() == 0
    assert search.top_products(table.where("vec_id = 1").limit(1), table.where("vec_id = 1").limit(1)).count() == 0


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_form(doc_id, text, share=50, suffix_first=80):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= share:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, mid, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < suffix_first:
        return doc_id, n, "spm", len(prefix), len(mid), f"<S>{suffix}<P>{prefix}<M>{mid}"
    return doc_id, n, "psm", len(prefix), len(mid), f"<P>{prefix}<S>{suffix}<M>{mid}"


def odd_texts():
    rows = helpers.odd_rows()
    pick = random.Random(11)
    alphabet = "ab \t\n\x0b\x0c\ré梦𝄞  \x1c<PSM>"
    rows += [(100 + k, "".join(pick.choice(alphabet) for _ in range(pick.randint(0, 60)))) for k in range(300)]
    rows += [(500 + k, "".join(pick.choice("ab  \n") for _ in range(pick.randint(2000, 30000)))) for k in range(20)]
    rows += [(600, " " * 50_000), (601, "x" * 50_000), (602, "x " * 40_000), (603, " " * 9000 + "x"), (604, "x" * 9000 + " ")]
    rows += [(700 + k, f"head {k} " + helpers.prose(3, 4000) + " <M>" * (k % 3 == 0)) for k in range(30)]
    return rows


@pytest.mark.parametrize(("share", "suffix_first"), [(50, 80), (100, 50)])
def test_forms_equal_plain_cutting(spark, share, suffix_first):
    rows = odd_texts()
    forms = middle.fill_in_middle(helpers.frame(spark, rows).repartition(4), share, suffix_first)
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in forms.collect())
    assert got == Counter(brute_form(i, t, share, suffix_first) for i, t in rows)
    texts = Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.restored_sha256) for r in middle.digests(forms).collect()) == texts
    assert middle.digests(middle.fill_in_middle(helpers.frame(spark, []))).count() == 0


def test_shared_passages_share_chunks():
    """Chunks depend on content alone, so a passage behind other heads is summed up once."""
    passage = helpers.prose(5, 20_000)
    units = middle.Units()
    for k in range(20):
        text = f"another head of {'some ' * k}words {passage}"
        n, _, end = units.cuts(text, 1 << 31, (1 << 31) + k)
        assert n == len(UNIT.findall(text)) and end == len("".join(UNIT.findall(text)[: max((1 << 31) % (n + 1), ((1 << 31) + k) % (n + 1))]))
    assert units.hits > 0.9 * 19 * len(middle.chunk_ends(np.frombuffer(passage.encode("utf-32-le"), np.uint32)))


def test_summaries_are_bounded():
    units = middle.Units(bound=20_000)
    for k in range(30):
        text = helpers.prose(k, 2000)
        assert units.cuts(text, 5, 9)[0] == len(UNIT.findall(text))
        assert units.used <= 20_000
