"""The prefix trie against a brute-force version on whole rebuilt conversations."""

import hashlib
import zlib
from collections import defaultdict
from random import Random

import pytest
from pyspark.sql import functions as F

from changeflow.llm import trie

DDL = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs, members, children = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(role, text) for _, role, text in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        own_weight = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = own_weight + sum(saved[k] for k in children[p])
        ends = ",".join(str(c) for c in sorted(members[p]) if len(rebuilt[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]),
                    leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def nodes(df):
    return sorted((tuple(r)[:8] for r in trie.prefix_trie(df).collect()), key=key)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(trie, "SLICE_BITS", 3)      # many slices in short conversations
    monkeypatch.setattr(trie, "ENDS_BITS", 1)
    said = [(None, None, None), (0, "u", "a"), (0, "u", "a"), (0, "u", ""), (1, "a", None), (2, "", "é")]
    rows = [(c, *t) for c in (-7, -5, -3, 0, 1, 2, 7, 10, 12, 13, 14) for t in said]
    rows += [(c, k, "u", "z" * (k % 3)) for c in (10, 12, 3) for k in range(3, 40 * c)]
    rows += [(20 + 5 * c, k, "u", f"copy {k}") for c in range(12) for k in range(9)] + [(None, 1, "u", "x"), (6, 0, "u", "short")]
    df = spark.createDataFrame(rows, DDL).repartition(5).selectExpr("*", "1 as depth", "'x' as fa", "2 as pos", "conv_id as base")
    assert nodes(df) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("seed", range(2))
def test_random_families(spark, seed):
    rng = Random(seed)
    rows = [(c, k, rng.choice("ua"), rng.choice(["x", "yy", "zzz ü"])) for c in range(120) for k in range(rng.randrange(12))]
    df = spark.createDataFrame(rows, DDL).repartition(7)
    assert nodes(df) == sorted(brute(rows), key=key)


def test_empty_table(spark):
    assert trie.prefix_trie(spark.createDataFrame([], DDL)).collect() == []


def test_meeting_fingerprints_are_noticed(spark, monkeypatch):
    rows = [(c, 0, "u", f"text {c}") for c in range(40)]
    df = spark.createDataFrame(rows, DDL)
    true = trie.turn_hash
    # with the first bases all turns hash alike: the check finds it, and other bases are taken
    monkeypatch.setattr(trie, "turn_hash", lambda seed: true(seed) if seed else alike())
    assert nodes(df) == sorted(brute(rows), key=key)
    monkeypatch.setattr(trie, "turn_hash", lambda seed: alike())
    with pytest.raises(RuntimeError):
        trie.prefix_trie(df, tries=2)


def alike():
    return [F.lit(7).cast("long").alias("k1"), F.lit(9).cast("long").alias("k2")]


def test_power():
    for p, b in zip(trie.PRIMES, trie.bases(3)):
        assert 2 ** 20 <= b < p and all(p % q for q in range(2, 46341))


def test_turn_references(spark):
    rows = [(c, k, "u", f"{c} {k}") for c in range(5) for k in range(12)]
    text = {(c, k + 1): t for c, k, _, t in rows}
    for r in trie.prefix_trie(spark.createDataFrame(rows, DDL)).filter("depth > 0").collect():
        h = zlib.crc32(str(r.conv_id).encode()) % 9
        want = text[0, r.depth] if r.depth <= h else text[r.conv_id, r.depth]
        assert text[r.turn_conv_id, r.turn_pos] == want
