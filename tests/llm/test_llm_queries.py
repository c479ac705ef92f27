"""The operators' queries against DuckDB, brute force, round trips and held-out accuracy."""

import hashlib
import zlib
from collections import Counter, defaultdict
from math import exp
from random import Random

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from changeflow.llm import bpe, components, near_dup, packing, ppm, sampling, suffix_dedup
from changeflow.llm.oracle import ORACLE
from changeflow.llm.queries import QUERIES
from changeflow.llm.run_index import RunIndex
from tests.conftest import SF_SMALL
from tools.check_oracle import TABLES, key, norm


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(norm(x) for x in r) for r in df.collect()]
    found = con.execute(ORACLE[name])
    cols = [d[0] for d in found.description]
    assert sorted(cols) == sorted(df.columns)
    want = [tuple(norm(r[cols.index(c)]) for c in df.columns) for r in found.fetchall()]
    assert sorted(rows, key=key) == sorted(want, key=key)


def ids_of(text):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return t.encode(text or "", add_special_tokens=False).ids


def check_pieces(pieces, texts):
    """Pieces tile each document's ids and each sequence's places."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in pieces:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(docs) == set(texts)
    for doc, rows in docs.items():
        ids, at = [*ids_of(texts[doc]), 0], 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for rows in seqs.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return len(seqs), sum(r.length for r in pieces)


def test_packing_tiles_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    pieces = QUERIES["op10_packing"](spark, SF_SMALL).collect()
    n, total = check_pieces(pieces, texts)
    assert n * 1024 - total < 1024


def test_sum_of_squares_levels():
    r, p, shut = Random(3), packing.SumOfSquares(16, max_open=50), 0
    for k in range(3000):
        size = r.randint(1, 16)
        before = {h: int(c) for h, c in enumerate(p.counts) if c}

        def cost(h):
            n = Counter(before)
            if h:
                n[h] -= 1
            if h + size < 16:
                n[h + size] += 1
            return sum(v * v for v in n.values())

        level = p.level_for(size)
        options = [0, *[h for h in before if h + size <= 16]]
        assert cost(level) == min(map(cost, options))
        shut += sum(len(x[2]) for w in p.add((k, 0, bytes(4 * size), size)) for x in w)
        assert p.open == sum(p.counts) <= 50
    left = p.close()
    assert all(sum(len(x[2]) for x in w) == 64 for w in left[:-1])


def test_token_ids_are_the_library_s():
    coder = bpe.load(P.path("byte_bpe_50k.json"))
    for t in ["a <|endoftext|> b", "x<|endoftext|>  foo", "\n\n foo  bar\t\tx\x1cy \x1f z", "½ ²x a's 'll don't", "  lead", "trail  ",
              "", " ", "　日本 語 x", "a​b \x85c", "emoji 😀 é é", "a  b", "end.\nStart \n x"]:
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == ids_of(t), t


def test_token_counts(spark):
    coder = bpe.load(P.path("byte_bpe_50k.json"), special=False)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    want = Counter((r.doc_id, len(coder.encode(r.text)) // 4) for r in docs)
    assert Counter(tuple(r) for r in QUERIES["op9_token_counts"](spark, SF_SMALL).collect()) == want


def test_token_counts_across_small_blocks(spark):
    from changeflow.llm import token_counts

    texts = ["", None, "a b c", "word " * 300, "<|endoftext|> x", "z"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    coder = bpe.load(P.path("byte_bpe_50k.json"), special=False)
    got = token_counts.token_counts(docs, P.path("byte_bpe_50k.json"), block_ids=7).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {k: len(coder.encode(t)) // 4 for k, t in enumerate(texts)}


def test_token_counts_follow_the_vocabulary(spark, workdir):
    """The separator's id and the width of ids come from the file: one with an id over 65,535 counts the same,
    held against the tokenizer library."""
    import json

    from tokenizers import Tokenizer

    from changeflow.llm import token_counts

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    wide = f"{workdir}/wide.json"
    for token in spec["added_tokens"]:
        token["id"] = 70_000
    with open(wide, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    texts = ["", None, "a b c", "word " * 300, "<|endoftext|> x", "ä\u2028 é  z\n\n", "!" * 200] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {k: len(library.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}
    for path, width, end in ((P.path("byte_bpe_50k.json"), "<u2", 50_256), (wide, "<u4", 70_000)):
        coder = bpe.load(path, special=False)
        assert token_counts.width_of(coder) == width and coder.special_ids["<|endoftext|>"] == end
        got = token_counts.token_counts(docs, path, block_ids=11).collect()
        assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(texts)


def test_language_of_held_out_documents(spark):
    got = {r.doc_id: r for r in QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert all(got[d.doc_id].held_out == (d in held) for d in docs)
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_code_lengths_by_hand(spark):
    train = {"x": ["abab", "ab"], "y": ["ba", "bbb"]}
    rows = [(t, lang) for lang, ts in train.items() for t in ts]
    model = ppm.fit(ppm.count_grams(spark.createDataFrame(rows, "text string, lang string")))

    def chance(lang, context, byte):
        count = Counter()
        for t in train[lang]:
            padded = ppm.START + t.encode()
            for i in range(ppm.ORDER, len(padded)):
                if padded[i - len(context):i] == context:
                    count[padded[i]] += 1
        n, q = sum(count.values()), len(count)
        shorter = (lambda: chance(lang, context[1:], byte)) if context else (lambda: 1 / 256)
        return count[byte] / (n + q) if count[byte] else (q / (n + q) if n else 1) * shorter()

    texts = [b"abb", b"c", b"babab"]
    got = ppm.code_lengths(model, texts)
    for t, bits in zip(texts, got):
        padded = ppm.START + t
        for lang, b in zip(model.langs, bits):
            want = -sum(np.log2(chance(lang, padded[i - ppm.ORDER:i], padded[i])) for i in range(ppm.ORDER, len(padded)))
            assert abs(b - want) < 1e-4


def test_segmentations_are_distinct_and_fair():
    pieces = sampling.load(P.path("piece_bpe_32k.model"))
    for text in ["Hello  wörld\n▁ x", "  a", " ", "日本 é\t😀", "￿ z"]:
        got = sampling.sample(pieces, text, 4, Random(1))
        assert len({tuple(g[0]) for g in got}) == len(got)
        assert all(pieces.decode(g[0]) == text for g in got)
        assert [g[2] for g in got] == sorted((g[2] for g in got), reverse=True)
    every = sampling.sample(pieces, "the in", 10_000, Random(0))
    assert abs(sum(exp(g[1]) for g in every) - 1) < 1e-9
    first, weight, n = Counter(), Counter(), 4000
    for seed in range(n):
        got = sampling.sample(pieces, "the in", 3, Random(seed))
        first[tuple(got[0][0])] += 1
        for ids, score, _, inclusion, _ in got:
            weight[tuple(ids)] += exp(score) / inclusion
    for ids, score, *_ in every[:5]:
        assert abs(first[tuple(ids)] / n - exp(score)) < 0.03
    assert abs(sum(weight.values()) / n - 1) < 0.05     # Horvitz-Thompson: unbiased


def test_run_index_against_brute_force():
    r = Random(1)
    for turn in range(300):
        parts = [bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 6))]
        parts += parts[:2] * (turn % 3 == 0)
        length, seen = r.randint(1, 12), set()
        made = RunIndex(parts)
        later = made.later_matches(length)
        for k, p in enumerate(parts):
            for i in range(len(p) - length + 1):
                assert later[made.starts[k] + i] == (p[i:i + length] in seen)
                seen.add(p[i:i + length])


def test_windows_of_crowded_grams(spark, monkeypatch):
    r = Random(5)
    passage = "".join(r.choice("abcdefgh ") for _ in range(300))
    texts = [r.choice("xyz") * r.randint(0, 40) + passage[r.randint(0, 60):r.randint(200, 300)] + str(k) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_removal(list(enumerate(texts)))
    for most in (1 << 15, 3):
        monkeypatch.setattr(suffix_dedup, "MOST_VARIANTS", most)
        got = {row.doc_id: row.kept_sha256 for row in suffix_dedup.dedup_passages(docs).collect()}
        assert got == want


def brute_removal(docs):
    seen, out = set(), {}
    for doc, text in sorted(docs):
        b = (text or "").encode()
        gone = set()
        for i in range(len(b) - 99):
            if b[i:i + 100] in seen:
                gone.update(range(i, i + 100))
            seen.add(b[i:i + 100])
        out[doc] = hashlib.sha256(bytes(c for i, c in enumerate(b) if i not in gone)).hexdigest()
    return out


def test_near_duplicates_of_one_large_group(spark):
    r = Random(9)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(150)]
    texts = []
    for _ in range(120):
        words = base[:]
        for _ in range(r.randint(0, 6)):
            words[r.randrange(150)] = f"v{r.randint(0, 10**6)}"
        texts.append(" ".join(words))
    texts += texts[:20] + ["", None, "one two", "ONE two", "one  two three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {row.doc_id: (row.n_shingles, row.component_id, row.kept) for row in near_dup.near_duplicates(docs).collect()}
    sets = [frozenset(s) if (s := near_dup.shingles(t).tolist()) else None for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {k: (len(sets[k] or ()), find(k), find(k) == k) for k in range(len(texts))}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (91, 100)], "u long, v long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {90: 90, 91: 90, 100: 90}


def test_pipeline_against_its_operators(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from changeflow.llm.common import saved

        before = {r.doc_id: r.text for r in held.collect()}
        held = saved(stage(spark, held, SF_SMALL), "t")
        assert held.columns == list(corpus_pipeline.COLUMNS)
        after = {r.doc_id: r for r in held.collect()}
        assert set(after) <= set(before) and after
        assert all(r.n_chars == len(r.text) for r in after.values())
        if name in ("quality_rules", "minhash_near_dedup"):
            assert all(after[k].text == before[k] for k in after)
        if name == "line_dedup":
            assert {k: r.text for k, r in after.items()} == brute_lines(before)
        if name == "suffix_dedup":
            lost = brute_removal(before.items())
            assert all(r.text == before[k] or hashlib.sha256(r.text.encode()).hexdigest() == lost[k] or not r.text.isascii()
                       for k, r in after.items())
    texts = {r.doc_id: r.text for r in held.collect()}
    check_pieces(corpus_pipeline.run(spark, SF_SMALL).collect(), texts)


def brute_lines(texts):
    seen, out = {}, {}
    for doc, text in sorted(texts.items()):
        lines, gone = text.split("\n"), set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i:i + 3])
            if "".join(w).strip(" \t\n\v\f\r"):
                if w in seen:
                    gone.update(range(i, i + 3))
                seen.setdefault(w, doc)
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if left:
            out[doc] = left
    return out
