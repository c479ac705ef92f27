"""The whole job: blank runs against enumeration over the full vocabulary."""

import hashlib
from collections import Counter
from math import exp, log
from random import Random

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

from changeflow.llm import bpe, packing, ppm, sampling
from changeflow.llm.queries import QUERIES
from tests.conftest import SF_MID, SF_SMALL
from tests.llm.test_llm_edges import LONG

PIECES, BPE = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")


def enumerated(text):
    """Every segmentation over the vocabulary file: ids -> probability; texts that pieces of one sign can spell."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=PIECES)
    n = sp.get_piece_size()
    plain = sorted((i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))),
                   key=lambda i: (-sp.get_score(i), i))
    vocabulary = {sp.id_to_piece(i): (i, 1 / (r + 2)) for r, i in enumerate(plain)}
    total = sum(1 / (r + 2) for r in range(n))
    held = "▁" + text.replace(" ", "▁")

    def ways(at):
        if at == len(held):
            yield (), 1.0
        for end in range(at + 1, len(held) + 1):
            if held[at:end] in vocabulary:
                i, p = vocabulary[held[at:end]]
                for ids, q in ways(end):
                    yield (i, *ids), p / total * q

    found = dict(ways(0))
    whole = sum(found.values())
    return {ids: p / whole for ids, p in found.items()}


def test_segmentations_use_pieces_of_blanks():
    pieces = sampling.load(PIECES)
    for text in ["a  b", "    in", "x   ", "if a:        b"]:
        want = enumerated(text)
        got = {tuple(ids): score for ids, score, *_ in sampling.sample(pieces, text, len(want) + 1, Random(3))}
        assert got.keys() == want.keys()
        assert all(abs(score - log(want[ids])) < 1e-9 for ids, score in got.items())
        assert abs(sum(map(exp, got.values())) - 1) < 1e-9
        assert any("▁▁" in pieces.text[i] for ids in got for i in ids if i in pieces.text)


def test_rare_language_keeps_its_counts(spark):
    """More than two million counts: a language whose counts are the smallest stays, with all of its contexts."""
    hot = spark.range(2_200_000).selectExpr("'hot' AS lang", "id * 1951 AS gram", "9L AS n")
    text = "ein seltener satz"
    rare = ppm.count_grams(spark.createDataFrame([(text, "rare")], "text string, lang string"))
    model = ppm.fit(hot.unionByName(rare))
    assert model.langs == ["hot", "rare"]
    alone = ppm.fit(rare)
    want, got = ppm.code_lengths(alone, [text.encode()]), ppm.code_lengths(model, [text.encode()])
    assert abs(want[0, 0] - got[0, 1]) < 1e-3
    docs = spark.createDataFrame([(1, text), (2, "seltener")], "doc_id long, text string")
    assert {r.lang_pred for r in ppm.predict(docs, model).collect()} == {"rare"}


def test_shards_give_the_same_code_lengths(spark):
    rows = [("the cat sat on the mat", "en"), ("die katze sass auf der matte", "de"), ("le chat était là", "fr")]
    counts = ppm.count_grams(spark.createDataFrame(rows, "text string, lang string"))
    one, many = ppm.fit(counts), ppm.fit(counts, cells=30)
    assert len(one.shards) == 1 < 3 < len(many.shards)
    texts = [t.encode() for t, _ in rows] + [b"zq\xff9", b"x", "là sat der".encode() * 9]
    assert np.abs(ppm.code_lengths(one, texts) - ppm.code_lengths(many, texts)).max() < 1e-9
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in ppm.predict(docs, many).collect()} == {k: lang for k, (_, lang) in enumerate(rows)}


def test_documents_are_segmented_whole(spark):
    got = QUERIES["op7_gumbel_segmentations"](spark, SF_SMALL).collect()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert {r.doc_id for r in got} == {d.doc_id for d in docs}
    want = {(d.doc_id, hashlib.sha256((d.text or "").encode()).hexdigest()) for d in docs}
    assert {(r.doc_id, r.decoded_sha256) for r in got} == want


def test_long_texts_are_segmented(spark):
    """The long documents of test_llm_edges, one long word, and one long run of blanks."""
    texts = {3: LONG, 4: LONG, 5: "a" * 30_000, 6: " " * 30_000 + "x", 7: "日本" * 9_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = sampling.sample_segmentations(docs, ["doc_id"], PIECES).collect()
    assert sorted((r.doc_id, r.rank) for r in rows if r.doc_id < 7) == [(d, k) for d in (3, 4, 5, 6) for k in (1, 2, 3, 4)]
    assert all(r.decoded == texts[r.doc_id] for r in rows)
    assert len({(r.doc_id, tuple(r.ids)) for r in rows}) == len(rows)


def test_late_words_are_drawn_by_their_chances():
    """After many words the rest is drawn word by word: its last word and its log probability are right."""
    pieces = sampling.load(PIECES)
    text = "of the people " * 20 + "in"
    logs = {i: score for i, score, _ in ((p[0][0], p[1], 0) for p in pieces.pieces.values())}
    want, last = {ids: exp(s) for ids, s, *_ in ((tuple(g[0]), *g[1:]) for g in sampling.sample(pieces, "in", 99, Random(0)))}, Counter()
    norm = sum(log(sum(exp(sum(logs[i] for i in ids)) for ids in spelled(pieces, w))) for w in text.split())
    for seed in range(3000):
        for k, (ids, score, *_) in enumerate(sampling.sample(pieces, text, 2, Random(seed))):
            assert seed > 20 or abs(sum(logs[i] for i in ids) - norm - score) < 1e-6
            if k == 0:
                last[next(w for w in want if tuple(ids[-len(w):]) == w and pieces.text[w[0]].startswith("▁"))] += 1
    assert all(abs(last[ids] / 3000 - p) < 0.03 for ids, p in want.items())


def spelled(pieces, word):
    return [tuple(g[0]) for g in sampling.sample(pieces, word, 10_000, Random(0))]


def test_samples_go_by_key_and_text_alone(spark, monkeypatch):
    """Neither the order of rows, nor their partitions, nor what a worker saw before or forgot changes a sample."""
    words = "the of people internationalization rough thing in und nicht".split()
    rng = Random(4)
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 120)))) for k in range(60)] + [(7, "again"), (7, "again"), (None, "x y")] * 2
    pieces = sampling.load(PIECES)
    want = {(k, t): sampling.sample(sampling.Pieces(PIECES) if k == 5 else pieces, t, 4, Random(k or 0)) for k, t in rows}
    monkeypatch.setattr(sampling, "REMEMBERED", 50)
    rng.shuffle(rows)
    assert all(sampling.sample(pieces, t, 4, Random(k or 0)) == want[k, t] for k, t in rows)
    seen = []
    for n in (1, 7):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        seen.append(sorted(map(str, sampling.sample_segmentations(df, ["doc_id"], PIECES).collect())))
    assert seen[0] == seen[1]


def test_odd_rows_of_segmentations(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b"), (4, LONG)]
    got = sampling.sample_segmentations(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], PIECES).collect()
    assert [(r.rank, r.ids, r.inclusion, r.log_inclusion, r.decoded) for r in got if r.doc_id in (1, 2)] == [(1, [], 1.0, 0.0, "")] * 2
    repeated = sorted((r.rank, tuple(r.ids), r.log_prob) for r in got if r.doc_id == 3)
    assert repeated[::2] == repeated[1::2] and all(r.decoded == "a b" for r in got if r.doc_id in (None, 3))
    last = [r for r in got if r.doc_id == 4]
    assert all(r.decoded == LONG and r.inclusion == 0 and r.log_inclusion < -1000 for r in last) and len(last) == 4


def packed(docs, **options):
    rows = packing.pack_documents(docs, BPE, **options).collect()
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append(r)
    for held in windows.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0 and len(r.ids) == 4 * r.length
            at += r.length
    return rows, sorted(sum(r.length for r in held) for held in windows.values())


def test_open_windows_go_on_across_tasks(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text")
    cut = {}
    for tasks in (1, 7, 40):
        rows, sizes = packed(docs.repartition(tasks))
        assert all(n == 1024 for n in sizes[1:])            # one padded window in all
        by_doc = {}
        for r in rows:
            by_doc.setdefault(r.doc_id, []).append(r)
        assert len(by_doc) == docs.count()
        for held in by_doc.values():
            held.sort(key=lambda r: r.start)
            assert [r.start for r in held] == [sum(x.length for x in held[:k]) for k in range(len(held))]
            assert sum(r.length for r in held) == held[0].doc_tokens
        cut[tasks] = sum(len(held) > -(-held[0].doc_tokens // 1024) for held in by_doc.values()) / len(sizes)
    assert max(cut.values()) < 1.2 * cut[1]                 # the end of a task cuts nothing


def test_odd_rows_of_packing(spark):
    rows = [(1, None), (2, ""), (None, "a b c"), (3, "same text"), (3, "same text"), (None, None), (4, "long " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns(
        {c: F.lit("clash") for c in ("ids", "task", "start", "sequence_id")})
    for most in (4096, 1):                                  # 1: nearly all windows are cut anew
        got, sizes = packed(docs, max_open=most)
        assert all(n == 1024 for n in sizes[1:])
        coder = bpe.load(BPE)
        for doc_id, text in set(rows):
            want = coder.encode(text) + bytes(4)
            times = rows.count((doc_id, text))
            pieces = [r for r in got if r.doc_id == doc_id and r.doc_tokens == len(want) // 4]
            assert sum(r.length for r in pieces) == times * len(want) // 4
            assert all(r.ids == want[4 * r.start:4 * (r.start + r.length)] for r in pieces)
