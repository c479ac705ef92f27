"""Texts drawn together have exactly the segmentations that each has alone."""

from random import Random

import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash

from changeflow.llm import lockstep, sampling

PIECES = P.path("piece_bpe_32k.model")
ODD = ["a", " ", "\n", "x\0y \0", "  two  blanks ", "the in", "née Ωmega 日本 \U0001f600 ▁ sign", "a" * 60 + " b", "z" * 2100 + " of the",
       " ", "in " * 400, "one\ntwo\n\nthree", "<0x41> <s> </s>", " ".join("qxzjkv" * 5 for _ in range(3))]


def texts(n):
    rng = Random(5)
    words = "the of people internationalization rough thing in und nicht\nwäre señor 1984, (x) zq�".split(" ")
    return ODD + [" ".join(rng.choice(words) + "abcdefgh"[:rng.randrange(9)] for _ in range(int(1.5 ** rng.randrange(17)))) for _ in range(n)]


def rows_of(pieces, rows, seed=7, k=4):
    batch = pa.record_batch([pa.array([d for d, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], ["doc_id", "text"])
    out = {}
    for d, _, ids, *scores, decoded in sampling.together(pieces, k, seed, iter([batch]), 1):
        out.setdefault(d, []).append((list(map(int, ids)), *scores, decoded))
    return out


@pytest.mark.parametrize("few", [(1, 1), (40, 64), (10_000, 10_000)])
def test_together_as_alone(monkeypatch, few):
    monkeypatch.setattr(lockstep, "FEW", few[0])
    monkeypatch.setattr(lockstep, "FEW_SETS", few[1])
    pieces, rows = sampling.Pieces(PIECES), list(enumerate(texts(150)))
    got = rows_of(pieces, rows)
    for d, text in rows:
        alone = sampling.sample(pieces, text, 4, Random(xxhash.xxh3_64_intdigest(f"7:{d}")))
        assert got[d] == [(*g, text) for g in alone], text[:60]


def test_ordinary_texts_are_not_drawn_one_by_one(monkeypatch):
    """What a text takes by itself, about 8 microseconds a piece, is left to those that can't be drawn with others."""
    rows, seen = list(enumerate(texts(100))), []
    alone = sampling.sample
    monkeypatch.setattr(sampling, "sample", lambda p, text, k, r: seen.append(text) or alone(p, text, k, r))
    pieces = sampling.Pieces(PIECES)
    assert len(rows_of(pieces, rows)) == len(rows)
    assert all(len(text.split()) < 2 or len(text) > 2048 for text in seen)      # no choice, or a word too long to be held


def test_forgotten_words_and_small_batches_change_nothing(monkeypatch):
    rows = list(enumerate(texts(60)))
    want = rows_of(sampling.Pieces(PIECES), rows)
    monkeypatch.setattr(lockstep, "MOST_ARCS", 10)
    monkeypatch.setattr(lockstep, "CHUNK", 7)
    monkeypatch.setattr(sampling, "TOGETHER", 500)
    assert rows_of(sampling.Pieces(PIECES), rows[::-1]) == want


def test_stream_is_that_of_random():
    for seed in (0, 1, 2 ** 32 - 1, 2 ** 32, 2 ** 64 - 1):
        stream, want = lockstep.Stream(seed), Random(seed)
        for n in (1, 300, 5, 1000):
            assert stream.ahead(n).tolist()[0] == stream.random() == want.random()
