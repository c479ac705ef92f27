"""MinHash near-duplicates with sequential Bayesian verification.

1. Documents with the same set of shingles are one class, known by its smallest
   doc_id. 128 minhashes per class, banded 32 x 4: classes that share a band are
   candidates (a pair at similarity 0.75 misses every band once in 200,000).
2. A bucket's members are compared with hubs of it: its smallest member, then about 64,
   then about 4,096 of those left, told by their hashes; all where no more are left.
   Turn 1 is a star, which joins a large group of copies; after it, members already in
   a hub's component need no comparison. Hubs leave a bucket that they have met as a
   whole, and turns go on until each bucket is one component or has no one left, so no
   link between different components is lost. A turn's links are between the components
   so far, so that each turn's graph is no larger than what it joins.
3. The parities of a class's shingles in 1,024 hash slots (an odd sketch) bound how
   much two sets differ from below: by the number of slots whose parity differs. A
   pair whose sets differ too much for the threshold is left out by this bound, which
   never errs, before it is made.
4. Verification of a pair compares signatures 16 hashes at a time and stops as soon
   as the posterior probability (uniform prior) that the similarity reaches the
   threshold falls below ``miss``. Survivors are confirmed on the full sets of their
   whole texts.

Shingles are five lower-cased words, compared by 64-bit hashes. Defined results: no
word or a null text gives an empty set, linked with nothing; fewer than five words
are one shingle; rows with a null doc_id are linked with nothing, have a null
component and are kept; rows with the same doc_id are one document; an empty table
gives no row; columns besides ``doc_id`` and ``text`` aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.llm import common
from changeflow.llm.components import forest

WORDS, PERMS, ROWS, BATCH = 5, 128, 4, 16
HUBS_TIMES, HUBS_MOST = 64, 4096
SLOTS = 1024
STEP = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(20_240_229)
FACTORS = (_random.integers(0, 1 << 32, PERMS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
OFFSETS = _random.integers(0, 1 << 32, PERMS, dtype=np.uint64).astype(np.uint32)
BAND_FACTORS = _random.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(z: np.ndarray) -> np.ndarray:
    """64-bit numbers whose bits all depend on all bits given."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of a text's set of shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(one))
    run = np.full(len(one) - width + 1, width, np.uint64)
    for k in range(width):
        run = run * STEP + one[k:k + len(run)]
    return np.unique(mixed(run))


def minhashes(found: np.ndarray) -> np.ndarray:
    low = np.full(PERMS, 0xFFFFFFFF, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), 1024):
        np.minimum(low, (short[None, k:k + 1024] * FACTORS[:, None] + OFFSETS[:, None]).min(1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    bands = low.reshape(-1, ROWS).astype(np.uint64)
    return mixed((mixed(bands) * BAND_FACTORS).sum(1) + np.arange(len(bands), dtype=np.uint64) * STEP).view(np.int64)


def odd_sketch(found: np.ndarray) -> np.ndarray:
    """Whether each slot has an odd number of shingles, 64 slots to a number."""
    odd = np.bincount((found & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig, bands, odd); only the first two of empty sets."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, sigs, bands, odd = [], [], [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py())
                low = minhashes(found) if len(found) else None
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sigs.append((low & 0xFFFF).astype("<u2").tobytes() if len(found) else None)
                bands.append(band_keys(low) if len(found) else None)
                odd.append(odd_sketch(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()),
                 *(pa.array(c, pa.list_(pa.int64())) for c in (bands, odd))],
                names=["doc_id", "n_shingles", "set_key", "sig", "bands", "odd"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, set_key binary, sig binary, bands array<long>, odd array<long>")


def least_matches(threshold: float, miss: float) -> list[int]:
    """After each batch, the fewest matches with which a pair goes on. With a uniform
    prior, m matches of n leave the similarity at ``threshold`` or more with the
    probability that n + 1 draws of that chance succeed m times at most."""
    out = []
    for n in range(BATCH, PERMS + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def likely(pairs: DataFrame, sigs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) of components (u, v) whose signatures leave their link likely enough."""
    least = least_matches(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, PERMS) for c in (4, 5))
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for k, fewest in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches[alive] += (left[alive, part] == right[alive, part]).sum(1)
                alive = alive[matches[alive] >= fewest]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(alive)) for c in range(4)], names=["a", "b", "u", "v"])

    both = (pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
            .join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b"))
    return both.select("a", "b", "u", "v", "sig_a", "sig_b").mapInArrow(run, "a long, b long, u long, v long")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of components: by the pairs (a, b) whose full sets have 100 * common >= percent * all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_text, held = None, None
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(4), batch.column(5)):
                a = a.as_py()
                if a != held_text:
                    held_text, held = a, shingles(a)
                other = shingles(b.as_py())
                common_size = len(np.intersect1d(held, other, assume_unique=True))
                ok.append(100 * common_size >= percent * (len(held) + len(other) - common_size))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in (2, 3)], names=["u", "v"])

    both = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b"))
    return both.select("a", "b", "u", "v", "text_a", "text_b").sortWithinPartitions("a").mapInArrow(run, "u long, v long")


def several(members: DataFrame, value: str) -> DataFrame:
    """The members of buckets with more than one ``value``; the least one and how many rows the bucket has."""
    kinds = members.groupBy("key").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("size"))
    return members.join(kinds.filter("lo < hi").drop("hi"), "key")


def renamed(rows: DataFrame, comp: str, links: DataFrame) -> DataFrame:
    """The rows with the components that a turn's links (u, v) have joined u to."""
    return rows.join(links, rows[comp] == links["u"], "left").withColumn(comp, F.coalesce("v", comp)).drop("u", "v")


def near_duplicates(docs: DataFrame, percent: int = 75, miss: float = 1e-6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    work = common.Scratch(docs.sparkSession, "near-dup")
    found = work.saved(signatures(docs), "signatures")
    classes = work.saved(
        found.filter("doc_id is not null and set_key is not null").groupBy("set_key").agg(
            F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n_shingles", "sig", "bands", "odd")]), "classes")
    banded = work.saved(several(classes.select("rep", F.explode("bands").alias("key")).distinct(), "rep"), "buckets")
    candidates = banded.select("rep").distinct()
    texts = work.saved(docs.select("doc_id", "text").filter("text is not null").join(
        candidates.withColumnRenamed("rep", "doc_id"), "doc_id").distinct(), "texts")
    own = work.saved(classes.select("rep", "n_shingles", "sig", "odd").join(candidates, "rep"), "candidates")
    sigs = own.select("rep", "sig")
    # no bound, as n is null, where rows with the same doc_id have different texts
    bounds = own.groupBy("rep").agg(F.when(F.count("*") == 1, F.max("n_shingles")).alias("n"), F.first("odd").alias("odd"))
    live = work.saved(banded.join(bounds, "rep").withColumn("comp", F.col("rep")), "buckets")

    differ = " + ".join(f"bit_count(odd[{k}] ^ hub_odd[{k}])" for k in range(SLOTS // 64))
    possible = f"coalesce({100 + percent} * ({differ}) <= {100 - percent} * (n + hub_n), true)"
    joined, turn, n_hubs = [], 0, 1
    while not live.isEmpty():
        # all members where there are no more than hubs
        is_hub = F.col("rep") == F.col("lo") if turn == 0 else F.pmod(F.xxhash64("rep", F.lit(turn)), "size") < n_hubs
        marked = live.withColumn("is_hub", is_hub)
        hubs = marked.filter("is_hub").select("key", *[F.col(c).alias(f"hub_{c}") for c in ("rep", "comp", "n", "odd")])
        met = (marked.join(hubs, "key").filter(f"comp <> hub_comp and (not is_hub or rep < hub_rep) and {possible}")
               .select(F.least("rep", "hub_rep").alias("a"), F.greatest("rep", "hub_rep").alias("b"),
                       F.least("comp", "hub_comp").alias("u"), F.greatest("comp", "hub_comp").alias("v")).distinct())
        links = forest(confirmed(work.saved(likely(met, sigs, percent / 100, miss), "pairs"), texts, percent), work.saved)
        rest = marked.filter("not is_hub").drop("is_hub", "lo", "size")
        if not links.isEmpty():
            joined.append(links)
            rest = renamed(rest, "comp", links)
        live = work.saved(several(rest, "comp"), "buckets")
        turn, n_hubs = turn + 1, min(n_hubs * HUBS_TIMES, HUBS_MOST)

    named = classes.select("set_key", F.col("rep").alias("class_id"))
    for links in joined:
        named = renamed(named, "class_id", links)
    named = work.saved(named, "named")
    out = found.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")))
    out = common.saved(out.select("doc_id", "n_shingles", "component_id",
                                  F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")), "verdicts")
    work.drop()
    return out
