"""Token files, packing and sampled pieces against plain encodings."""

from __future__ import annotations

import collections
import math
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import helpers

from faultatlas.llm import packing, pieces, token_files, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")


def plain(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_give_the_ids_of_the_whole_text(path):
    texts = [t for _, t in helpers.odd_rows()] + [" a", "a ", "a  b", "a \n b", "it's we'll 's", "x y z", "á ́b", "\x1c a", "A.B, c"]
    for mark in ("<|endoftext|>", "<|startoftext|>", "<|EndOfText|>"):
        texts += [f"a {mark} b", f"{mark}", f" {mark}", f"{mark} x", f"a{mark}b {mark}{mark}", f"in  {mark}  y", f"é, {mark}. é", f"a <|endof {mark[2:]}"]
    encode = plain(path)
    for remembered in (1_000_000, 3):
        encoder = tokens.ChunkEncoder(path, remembered)
        for text in texts:
            assert encoder.ids(text).tolist() == [*encode(text), 0]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_every_latin_letter_is_spelled_as_by_the_library(path):
    encode, encoder = plain(path), tokens.ChunkEncoder(path)
    assert encoder.spell is not None
    letters = [c for c in map(chr, range(0x250)) if c.isalpha()]
    words = [f(c) for c in letters for f in ("{}".format, "{}stanbul".format, "Vaz{}".format, "k{}r.".format, "{0}{0},".format)]
    assert "İstanbul" in words
    for word in words:
        text = f"in {word} x"
        assert encoder.ids(text).tolist() == [*encode(text), 0], word
    whole = "in " + " ".join(words)
    assert tokens.ChunkEncoder(path).ids(whole).tolist() == [*encode(whole), 0]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_line_ends_and_marks_take_no_run_of_the_whole_library(path, monkeypatch):
    encode, encoder = plain(path), tokens.ChunkEncoder(path)
    lines = ["Oure.\nAnd so,\nété!! rr$$$", "a\nb", "a:\n(b)\n;c", "it's\n's x.\n'", "a\tb\nc", " a\nb", "a\nb\n", "a\r\nb c", "a\n\nb", "\n", "x*** \ny&&&"]
    lines += ["a <|endoftext|>\n<|endoftext|> b\n<|startoftext|>", "a\n1st 2\n3", "A\u0301\nA\u0301 b", "a<\u0338\nb>\u0338 c", "a\x1cb\n\u3000c", "x_y_\n_z"]
    for text in lines:
        assert encoder.ids(text).tolist() == [*encode(text), 0], text
    asked = []
    library = encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda chunks: asked.extend(chunks) or library(chunks))
    text = "Tonthe.\nAnthere whon$$$ èrea***\nÉtion,\nwha!! onhe&&&"
    assert encoder.ids(text).tolist() == [*encode(text), 0]
    assert not any(c.isalpha() for chunk in asked for c in chunk)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark):
    rows = helpers.odd_rows()
    encode = plain(BYTE)
    manifest = token_files.write_token_files(
        helpers.frame(spark, rows).repartition(3), token_files.token_file_folder(spark), BYTE, length=64, rows=4
    )
    found = token_files.read_token_files(manifest).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == collections.Counter(
        (i, len(encode(t)) + 1, crc([*encode(t), 0])) for i, t in rows
    )
    start = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    ids = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert ids == [None, *sorted(i for i in ids if i is not None)]
    part = manifest.where("file is not null").first()
    reader = token_files.SequenceReader(part.file)
    values, mask = reader.batch(0)
    assert len(values) % 64 == 0 and len(mask) == len(values)
    assert sum(reader.batch(k)[1].sum() for k in range(reader.file.num_record_batches)) == sum(
        r.n_tokens for r in manifest.where(manifest.file == part.file).collect()
    )


def test_token_files_of_no_rows(spark):
    none = helpers.frame(spark, [])
    manifest = token_files.write_token_files(none, token_files.token_file_folder(spark), BYTE)
    assert token_files.read_token_files(manifest).count() == 0


def test_packing_places_every_piece_once(spark):
    rows = helpers.odd_rows() + [(100 + k, helpers.prose(k, 5 + 7 * k % 90)) for k in range(150)]
    encode = plain(WORD)
    docs = helpers.frame(spark, rows)
    packed = packing.pack(packing.token_pieces(docs, WORD, 128), 128, shard_pieces=40).collect()
    want = collections.Counter()
    for i, text in rows:
        ids = [*encode(text), 0]
        for k in range(0, len(ids), 128):
            want[i, k // 128, k, len(ids[k : k + 128]), crc(ids[k : k + 128])] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    ends = collections.Counter()
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 128
    assert len(ends) <= 1.1 * sum(ends.values()) / 128 + 5
    assert packing.pack(packing.token_pieces(docs.limit(0), WORD)).count() == 0


def test_crossover_injects_whole_bins_and_loses_nothing():
    random = np.random.default_rng(1)
    packer = packing.Packer(random.integers(1, 100, 200), 100, 5)
    a, b = packer.first(), packer.first()
    child = packer.cross(a, b)
    assert sorted(p for one in child for p in one) == list(range(200))
    assert all(packer.filled(one) <= 100 for one in child)
    assert sum(set(map(frozenset, b)) >= {frozenset(one)} for one in child) >= 1
    best = packer.evolve([a], 6, 30)
    assert packer.fitness(best) >= packer.fitness(a)


def test_search_needs_fewer_bins_than_best_fit():
    random = np.random.default_rng(0)
    triplets = []
    for _ in range(150):  # three pieces that fill a bin
        x, y = int(random.integers(600, 800)), int(random.integers(600, 740))
        triplets += [x, y, 2048 - x - y]
    for lengths in (np.array(triplets), random.integers(300, 1101, 1000)):
        packer = packing.Packer(lengths, 2048, 5)
        best_fit = packer.best_fit([], list(range(len(lengths))))
        best = packer.evolve([], 6, 12)
        assert sorted(p for one in best for p in one) == list(range(len(lengths)))
        assert all(packer.filled(one) <= 2048 for one in best)
        least = -(-int(lengths.sum()) // 2048)
        # At least half of what best fit needs above the bound is saved.
        assert len(best) - least <= (len(best_fit) - least) / 2


def test_exchange_fills_bins_and_loses_nothing():
    random = np.random.default_rng(2)
    packer = packing.Packer(random.integers(1, 60, 120), 100, 5)
    bins = packer.best_fit([], list(range(100)))
    before = {k: packer.filled(one) for k, one in enumerate(bins)}
    left = packer.exchange(bins, list(range(100, 120)))
    assert sorted([p for one in bins for p in one] + left) == list(range(120))
    assert all(before[k] <= packer.filled(one) <= 100 for k, one in enumerate(bins))
    assert packer.exchange([], [1, 2]) == [1, 2]


def test_exchange_forms_pairs_on_arrays(monkeypatch):
    """One list of all pairs of displaced pieces per exchange made a generation take most of a second."""
    random = np.random.default_rng(4)
    packer = packing.Packer(random.integers(200, 1100, 600), 2048, 5)
    longest = []
    combinations = packing.itertools.combinations
    monkeypatch.setattr(packing.itertools, "combinations", lambda of, n: longest.append(len(of)) or combinations(of, n))
    bins = packer.best_fit([], list(range(500)))
    left = packer.exchange(bins, list(range(500, 600)))
    assert sorted([p for one in bins for p in one] + left) == list(range(600))
    assert all(packer.filled(one) <= 2048 for one in bins)
    assert max(longest) <= 16


def test_sampled_pieces_decode_to_their_text(spark):
    rows = helpers.odd_rows()
    docs = helpers.frame(spark, rows)
    first = pieces.decoded(pieces.sampled_pieces(docs, PIECE), PIECE).collect()
    assert collections.Counter((r.doc_id, r.decoded) for r in first) == collections.Counter((i, t or "") for i, t in rows)
    again = pieces.sampled_pieces(docs.repartition(5), PIECE).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.ids)
    assert sorted(map(key, first)) == sorted(map(key, again))
    other = pieces.sampled_pieces(docs, PIECE, seed=2).collect()
    assert sorted(map(key, first)) != sorted(map(key, other))
    checked = pieces.round_trip(docs, PIECE).collect()
    assert all(r.lossless for r in checked) and len(checked) == len(rows)
    assert pieces.round_trip(docs.limit(0), PIECE).count() == 0


def test_segmentations_are_drawn_by_their_weight():
    model = pieces.PieceModel(PIECE)

    def ways(chunk):
        found = collections.defaultdict(float)

        def walk(at, ids, weight):
            if at == len(chunk):
                found[tuple(ids)] += math.exp(weight)
            for end in range(at + 1, len(chunk) + 1):
                if chunk[at:end] in model.weight:
                    k, log = model.weight[chunk[at:end]]
                    walk(end, [*ids, k], weight + log)
                elif end == at + 1:
                    spelled = [int(model.byte_id[b]) for b in chunk[at].encode()]
                    walk(end, ids + spelled, weight + model.byte_log * len(spelled))

        walk(0, [], 0.0)
        total = sum(found.values())
        return {k: v / total for k, v in found.items()}

    n = 20_000
    for word in ("then", "té▁a"):
        want = ways(" " + word)
        got = collections.Counter(tuple(x.tolist()) for x in pieces.sample(model, [word] * n, list(range(n))))
        assert set(got) <= set(want)
        for ids, share in want.items():
            assert abs(got[ids] / n - share) < 5 * math.sqrt(share / n) + 2 / n


def test_id_bytes_take_the_smallest_type():
    assert tokens.id_type(50_257) == "<u2" and tokens.id_type(70_000) == "<u4"
