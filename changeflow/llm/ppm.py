"""Language identification by prediction by partial matching.

Per language, a tree of byte contexts of up to ORDER bytes counts what follows
them. A byte's probability is its count over (total + distinct) in the longest
context; a byte not seen there pays the escape, distinct over (total + distinct),
and is looked up in the next shorter one, down to 1/256 for every byte (method C,
without exclusions). A text's code length is the sum over its bytes, and the
shortest code names its language. The statistics are frozen before scoring.

All labelled training texts are counted, whole, and all counts make the model; it has
a row of code lengths, one for each language, for every gram that any language has,
and the escapes of every context. Orders 0 and 1 are one dense table. Orders 2 and 3
are dealt into shards by the last two bytes of the context, of about ``cells`` numbers
each; the driver and a worker hold one shard at a time, so memory is bounded by
``cells``, not by the corpus. Every text is scored against all shards.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as
is every text if nothing was learned; ties go to the smaller name; texts with a
null language, or of held-out or null ids, teach nothing; repeated rows count one
by one; an empty table gives no row; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.llm import common

ORDER = 3
START = b"\n" * ORDER       # the context before a text
GROUP_BYTES = 2 << 20       # texts are coded about this many bytes at a time
STEP_CELLS = 2 << 20        # code lengths looked up at a time


def grams(texts: list[bytes]) -> np.ndarray:
    """Each byte with the ORDER bytes before it, as one big-endian number."""
    held = np.frombuffer(b"".join(START + t for t in texts), np.uint8).astype(np.uint32)
    whole = (held[:-3] << 24) | (held[1:-2] << 16) | (held[2:-1] << 8) | held[3:]
    inside = np.ones(len(held), bool)
    at = np.cumsum([0] + [len(t) + ORDER for t in texts[:-1]])
    for k in range(ORDER):
        inside[at + k] = False
    return whole[inside[3:]]


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over the whole texts of ``docs`` (text, lang)."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[bytes]] = {}

        def count(lang: str) -> None:
            seen, n = np.unique(grams(waiting.pop(lang)), return_counts=True)
            old, m = tables.get(lang, (seen[:0], n[:0]))
            both, where = np.unique(np.concatenate([old, seen]), return_inverse=True)
            tables[lang] = both, np.bincount(where, np.concatenate([m, n]), len(both)).astype(np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, (g, n) in tables.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n)],
                                                 names=["lang", "gram", "n"])
            tables.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                held = waiting.setdefault(lang, [])
                held.append(text.as_buffer().to_pybytes())
                if sum(map(len, held[-64:])) > GROUP_BYTES or len(held) >= 1024:
                    count(lang)
            if sum(len(g) for g, _ in tables.values()) > 1 << 20:
                yield from rows()
        for lang in list(waiting):
            count(lang)
        yield from rows()

    found = docs.filter("text is not null and text <> '' and lang is not null").select(F.encode("text", "UTF-8").alias("text"), "lang")
    return (found.mapInArrow(run, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


@dataclass
class Model:
    langs: list[str]
    base: Broadcast             # the shard of each two context bytes; bits of each context byte and byte
    shards: list[Broadcast]     # of orders 3 and 2: grams, their bits, contexts, their escapes' bits


def chances(table: np.ndarray, keys: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contexts of sorted grams with counts (gram, language), the contexts' escapes,
    and the grams' probabilities; ``shorter`` has those of the next order."""
    known, first, of = np.unique(keys >> 8, return_index=True, return_inverse=True)
    total, distinct = np.add.reduceat(table, first), np.add.reduceat(table > 0, first, dtype=np.float64)
    both = np.maximum(total + distinct, 1)
    escape = np.where(total > 0, distinct / both, 1.0)
    return known, escape, np.where(table > 0, table / both[of], escape[of] * shorter)


def bits(prob: np.ndarray) -> np.ndarray:
    return -np.log2(prob).astype(np.float32)


def fit(counts: DataFrame, cells: int = 4_000_000) -> Model | None:
    """The frozen model of (lang, gram, n); None without counts."""
    spark = counts.sparkSession
    counts = common.saved(counts, "grams")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    number = pa.array(langs)

    def summed(t: pa.Table, keys: np.ndarray) -> np.ndarray:
        table = np.zeros((len(keys), len(langs)))
        at = np.searchsorted(keys, t["gram"].to_numpy()), pc.index_in(t["lang"], number).to_numpy()
        np.add.at(table, at, t["n"].to_numpy().astype(np.float64))
        return table

    ones = counts.groupBy("lang", F.expr("gram & 65535").alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    table = summed(ones, np.arange(1 << 16))
    _, _, prob = chances(table.reshape(256, 256, -1).sum(0), np.arange(256), np.float64(1 / 256))
    _, _, prob = chances(table, np.arange(1 << 16), np.tile(prob, (256, 1)))

    # shards: runs of neighbouring pairs of context bytes
    pair = F.expr("(gram >> 8) & 65535").alias("pair")
    sizes = np.zeros(1 << 16, np.int64)
    for p, n in counts.select("gram").distinct().groupBy(pair).count().toArrow().to_pandas().itertuples(index=False):
        sizes[p] = n
    shard_of = ((np.cumsum(sizes) - sizes) * len(langs) // cells).astype(np.int64)
    used = np.unique(shard_of[sizes > 0])
    shard_of = np.minimum(np.searchsorted(used, shard_of), len(used) - 1)
    if len(used) > 1:
        deal = spark.createDataFrame([(int(p), int(shard_of[p])) for p in np.flatnonzero(sizes)], "pair int, shard int")
        path = common.scratch_path(spark, "shards")
        (counts.withColumn("pair", pair.cast("int")).join(deal, "pair").drop("pair")
         .repartition("shard").write.option("compression", "zstd").partitionBy("shard").parquet(path))
        dealt = spark.read.schema("lang string, gram long, n long, shard int").parquet(path)

    def shard(t: pa.Table) -> list[tuple]:
        keys = np.unique(t["gram"].to_numpy())
        table = summed(t, keys)
        keys2, of = np.unique(keys & 0xFFFFFF, return_inverse=True)
        table2 = np.zeros((len(keys2), len(langs)))
        np.add.at(table2, of, table)
        known2, escape2, prob2 = chances(table2, keys2, prob[keys2 & 0xFFFF])
        known, escape, prob3 = chances(table, keys, prob2[of])
        return [(k.astype(np.uint32), bits(p), c.astype(np.uint32), bits(e))
                for k, p, c, e in ((keys, prob3, known, escape), (keys2, prob2, known2, escape2))]

    sc = spark.sparkContext
    parts = (dealt.filter(F.col("shard") == k) if len(used) > 1 else counts for k in range(len(used)))
    return Model(langs, sc.broadcast((shard_of.astype(np.int32), bits(prob))), [sc.broadcast(shard(x.toArrow())) for x in parts])


def gram_bits(levels: list[tuple], base: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Bits of each gram under each language, by the longest order that has it."""
    if not levels:
        return base[grams]
    keys, cost, known, escape = levels[0]
    at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
    out = cost[at]
    missed = np.flatnonzero(keys[at] != grams)
    if len(missed):
        g = grams[missed]
        at = np.minimum(np.searchsorted(known, g >> 8), len(known) - 1)
        paid = np.where((known[at] == g >> 8)[:, None], escape[at], np.float32(0))
        out[missed] = paid + gram_bits(levels[1:], base, g & (0xFFFFFF if len(levels) == 2 else 0xFFFF))
    return out


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each text (none empty) under each language."""
    shard_of, base = model.base.value
    held = grams(texts)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    dealt = shard_of[held >> 8 & 0xFFFF] if len(model.shards) > 1 else None
    out = np.zeros((len(texts), len(model.langs)))
    step = max(1, STEP_CELLS // len(model.langs))
    for k, shard in enumerate(model.shards):
        at = np.flatnonzero(dealt == k) if dealt is not None else np.arange(len(held))
        for lo in range(0, len(at), step):
            some = at[lo:lo + step]
            of = owner[some]
            first = np.flatnonzero(np.diff(of, prepend=-1))
            out[of[first]] += np.add.reduceat(gram_bits(shard.value, base, held[some]), first, axis=0, dtype=np.float64)
        if dealt is not None:
            vars(shard).pop("_value", None)     # one shard is held at a time
    return out


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score): score is the language's posterior probability, all
    languages being equally likely before."""
    common.ship(docs.sparkSession)
    m = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = GROUP_BYTES * (1 if m is None or len(m.shards) == 1 else 8)
        for batch in batches:
            names, scores = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            group: list[tuple[int, bytes]] = []

            def code() -> None:
                length = code_lengths(m, [t for _, t in group])
                best = length.argmin(1)
                weight = np.exp2(length.min(1)[:, None] - length)
                for (k, _), b, s in zip(group, best, 1 / weight.sum(1)):
                    names[k], scores[k] = m.langs[b], float(s)
                group.clear()

            held = 0
            for k, text in enumerate(batch.column(1)):
                text = text.as_py()
                if m is not None and text and any(map(str.isalpha, text)):
                    group.append((k, text.encode()))
                    held += len(text)
                    if held > most:
                        code()
                        held = 0
            if group:
                code()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    """Documents that teach nothing: crc32 of the id as text has remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the labelled documents that aren't held out, and score all."""
    train = docs.filter(~held_out() & F.col("doc_id").isNotNull())
    return predict(docs, fit(count_grams(train)))
