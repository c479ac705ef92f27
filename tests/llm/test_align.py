"""The alignment of two tokenizers against whole texts encoded by both libraries."""

import hashlib
import json
from collections import Counter
from random import Random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from changeflow.llm import align
from changeflow.llm.bpe import byte_of_symbol

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
DDL = "doc_id long, text string"
RNG = Random(5)
ODD = ["", " ", "  two  blanks ", "tab\there \t and", "lines\n\n  indented\n", "ünï çödé \U0001F600\U0001F600", "▁ literal", "a▁b c", "<s> </s> <unk>",
       "<|endoftext|> x<|endoftext|>", "<0x41> <0x0A>", "nul\0here \x1f x\x1fy", "it's we'll I'M 'tis", "  \n ", "　wide blank x",
       "x" * 3000, "a b " * 500, "日本語のテキスト と ひらがな", "é ́ x", "1234567 12 3.14 $%^", "ﬁ ½ Å ①", "﻿bom", "\r\n dos\r\nlines"]
ODD += ["".join(RNG.choice(["a", "b", " ", "  ", "\n", "é", "the", "ing", "\t", "7", "'s", "▁", "\U0001F600"]) for _ in range(RNG.randrange(60)))
        for _ in range(300)]


def brute(texts):
    """Counts, digest, scores per text; and the pairs' documents and links."""
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    with open(A_PATH, encoding="utf-8") as f:
        symbols = {i: s for s, i in json.load(f)["model"]["vocab"].items()}
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    of = byte_of_symbol()
    found, links, docs = [], Counter(), Counter()
    for text in texts:
        row = None
        if text:
            whole = f" {text}".encode()
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ba = [bytes(of[c] for c in symbols[i]) for i in ia]
            bb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ib for p in [b.id_to_piece(i)]]
            if b"".join(ba) == whole == b"".join(bb):
                ea, eb = np.cumsum([*map(len, ba)]).tolist(), np.cumsum([*map(len, bb)]).tolist()
                pairs = [(ia[ea.index(e)], ib[eb.index(e)]) for e in ea if e in set(eb)]
                groups, i, j = [], 0, 0
                for e in (e for e in ea if e in set(eb)):
                    p, q = ea.index(e) + 1, eb.index(e) + 1
                    groups.append(",".join(map(str, ia[i:p])) + "|" + ",".join(map(str, ib[j:q])))
                    i, j = p, q
                links.update(pairs)
                docs.update(set(pairs))
                row = len(ia), len(ib), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()
        found.append(row)
    highest = Counter()
    for (_, y), n in links.items():
        highest[y] = max(highest[y], n)
    out = [(0,) * 6 + ("",) if r is None else
           (r[0], r[1], len(r[2]), len(r[2]), sum(links[p] == highest[p[1]] for p in r[2]), sum(links[p] for p in r[2]), r[3]) for r in found]
    return out, links, docs


@pytest.mark.parametrize("blocks", ["whole", "small"])
def test_odd_texts(spark, monkeypatch, blocks):
    texts = [None, *ODD, *ODD[:30]]
    want, links, docs = brute(texts)
    df = spark.createDataFrame([(None if k == 9 else k // 2, t) for k, t in enumerate(texts)], DDL).selectExpr("*", "'x' as pair", "1 as at")
    # one task, so that a container has many blocks
    found, pairs = align.align_corpus(df.coalesce(1) if blocks == "small" else df.repartition(5), A_PATH, B_PATH)
    got = sorted(tuple(r)[1:] for r in found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    assert got == sorted(want)
    assert {(r.a_id, r.b_id): (r.n_docs, r.n_links) for r in pairs.collect()} == {p: (docs[p], links[p]) for p in links}


def test_pieces_are_whole_texts():
    aligner = align.Aligner(A_PATH, B_PATH, cache=5)
    assert aligner.cuts
    pieces = aligner.pieces
    for size in (1, 7, 1 << 18):
        aligner.pieces = lambda t, s=size: pieces(t, s)
        for text, want in zip(ODD, brute(ODD)[0]):
            got = aligner.text(text)
            assert (got is None and want[6] == "") or (got[0], got[1], len(got[2]), got[3]) == (*want[:3], want[6]), text


def test_blocks_are_ored(spark):
    rng = Random(2)
    rows, times = [], {}
    for block in range(6):
        pairs, low = [], []
        for doc in range(block * 2000, block * 2000 + 2000):
            for pair in (7, 9, 11):
                n = rng.choice([0, 1, 1, 2, 5, 40]) if pair != 11 else int(doc % 997 == 0)
                times[pair, doc] = n
                pairs += [pair] * n
                low += [doc] * n
        for batch in align.block_bitmaps(np.array(pairs), np.array(low), 3):
            rows += zip(*(batch.column(c).to_pylist() for c in ("pair", "container", "plane", "docs")))
    df = spark.createDataFrame([(*r[:3], bytearray(r[3])) for r in rows], "pair long, container long, plane int, docs binary")
    for r in align.pair_index(df).collect():
        counts = Counter()
        for k, bitmap in enumerate(r.planes):
            for doc in align.unpacked(bytes(bitmap)).tolist():
                counts[doc] += 1 << k
        want = {doc: n for (pair, doc), n in times.items() if pair == r.pair and n}
        assert counts == want and r.n_docs == len(want) and r.n_links == sum(want.values())
        assert r.pair == 11 or len(r.planes[0]) == 8193      # as bits


def test_empty_table(spark):
    found, pairs = align.align_corpus(spark.createDataFrame([], DDL), A_PATH, B_PATH)
    assert found.collect() == [] and pairs.collect() == []


def test_very_long_text():
    aligner = align.Aligner(A_PATH, B_PATH)
    text = " ".join(f"word{k % 977}," for k in range(200_000)) + "  end"
    want = brute([text[:20_000]])[0][0]
    got = aligner.text(text[:20_000])
    assert (got[0], got[1], len(got[2]), got[3]) == (*want[:3], want[6])
    n_a, n_b, pairs, _ = aligner.text(text)
    assert n_a > 400_000 and len(pairs) > 400_000
