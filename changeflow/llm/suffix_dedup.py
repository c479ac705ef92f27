"""Removal of long passages that occur earlier, by run-length indexes.

A string of WIDTH bytes is removed where it also starts earlier: in a document with
a smaller doc_id, or earlier in the same one. No index could hold the corpus, so its
windows (all strings of WIDTH bytes) are dealt by content:

1. Exact copies of a text are found by hash; only the first is looked into. These first
   texts are shuffled once, into a table bucketed by document, and each later join with
   them moves only segments, or, for the text that is left, rows without their texts.
2. Each window belongs to its smallest 24-byte gram (by hash, the first of equals).
   Neighbouring windows of one gram are a segment. Equal windows have equal grams,
   so they meet in segments of the same gram.
3. Segments with the same gram and content are known by hashes: all but the first are
   removed. Each task combines its own before the shuffle, so that a passage that a
   third of all documents has is one row per task; what is sorted by gram is streamed.
4. Grams whose segments differ in content are indexed: the bytes of their first
   segments, group by group, make run-length Burrows-Wheeler indexes of about
   INDEX_BYTES, and streaming matching statistics mark the windows that occur before.
   Groups of more than MOST_VARIANTS segments are dealt once more, by the hashes of
   their single windows.

Defined results: a null text is empty; texts under WIDTH bytes stay whole; null
doc_ids come last; rows with the same doc_id go by a hash of their text, and equal
rows are one document, none earlier than another; an empty table gives no row; other
columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.llm import common
from changeflow.llm.near_dup import STEP, mixed
from changeflow.llm.run_index import RunIndex

WIDTH, GRAM = 100, 24
BUFFER = 1 << 17            # bytes looked at together
COMBINED = 1 << 17          # segments that a task combines together
INDEX_BYTES = 1 << 21
MOST_VARIANTS = 1 << 15
LAST_ID = (1 << 63) - 1     # stands for a null doc_id
TEXT = ["doc", "text_key"]
PLACE_BITS = np.uint64(21)
_random = np.random.default_rng(100)
BYTE_CODES = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SEGMENT = pa.schema([("dup", pa.bool_()), ("gram", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()),
                     ("text_key", pa.int64()), ("start", pa.int64()), ("n", pa.int32())])
SEGMENT_DDL = "dup boolean, gram long, content long, doc long, text_key long, start long, n int"


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE's powers and those of its inverse, modulo 2^64."""
    if n not in _powers:
        _powers[n] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))
                           for b in (BASE, pow(BASE, -1, 1 << 64)))
    return _powers[n]


def segments(buffer: bytes, sizes: list[int]) -> tuple[np.ndarray, ...]:
    """(place, n, gram, content) of the segments of the texts joined in ``buffer``."""
    b = np.frombuffer(buffer, np.uint8).astype(np.uint64)
    total = len(b)
    if total < WIDTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    x = b
    for k in (1, 2, 4):
        x = x[:-k] | (x[k:] << np.uint64(8 * k))
    gram = mixed(x[GRAM - 8:])                                 # of GRAM bytes, 8 at a time
    for k in range(GRAM - 16, -1, -8):
        gram = mixed(x[k:k + len(gram)] * STEP ^ gram)
    low = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    span, reach = WIDTH - GRAM + 1, 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[:len(least) - (span - reach)], least[span - reach:])
    ends = np.cumsum(sizes)
    inside = np.zeros(total + 1, np.int64)
    long_enough = np.array(sizes) >= WIDTH
    np.add.at(inside, (ends - sizes)[long_enough], 1)
    np.add.at(inside, ends[long_enough] - WIDTH + 1, -1)
    place = np.flatnonzero(np.cumsum(inside[:len(least)]))
    if not len(place):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    at = (least[place] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (place[1:] != place[:-1] + 1)]))
    n = np.diff(np.append(new, len(place)))
    start = place[new]
    up, down = powers(2 * BUFFER + WIDTH)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODES[b.astype(np.uint8)] * up[:total])])
    content = mixed((sums[start + n + WIDTH - 1] - sums[start]) * down[start] + n.astype(np.uint64) * STEP)
    return start, n, gram[at[new]], content


def joined_runs(doc: np.ndarray, key: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows, in order, with those that touch or overlap joined."""
    if not len(doc):
        return doc, key, start, n
    end = start + n
    text = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]))
    # places of different texts don't meet if each text begins after all of the one before
    shift = text * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.flatnonzero(np.concatenate([[True], start[1:] + shift[1:] > reach[:-1]]))
    last = np.append(new[1:], len(doc)) - 1
    return doc[new], key[new], start[new], reach[last] - shift[last] - start[new]


def found_segments(docs: DataFrame) -> DataFrame:
    """Segments of ``docs`` (doc, text_key, text as bytes); ``dup`` marks those that
    have an earlier equal in the same task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_held = 0

        def combine() -> pa.RecordBatch:
            gram, content, doc, key, start, n = (np.concatenate(c) for c in zip(*held))
            held.clear()
            both = mixed(gram) ^ content
            order = np.argsort(both)
            same = both[order][1:] == both[order][:-1]
            of_group = np.zeros(len(order), bool)
            of_group[1:] |= same
            of_group[:-1] |= same
            rest = order[of_group]
            rest = rest[np.lexsort((start[rest], key[rest], doc[rest], both[rest]))]
            group = np.concatenate([[True], both[rest][1:] != both[rest][:-1]])
            first = rest[np.maximum.accumulate(np.where(group, np.arange(len(rest)), 0))]
            dup = np.zeros(len(order), bool)
            dup[rest] = (doc[rest] != doc[first]) | (key[rest] != key[first]) | (start[rest] != start[first])
            later = np.flatnonzero(dup)
            later = later[np.lexsort((start[later], key[later], doc[later]))]
            runs = joined_runs(doc[later], key[later], start[later], n[later])
            kept, none = ~dup, np.zeros(len(runs[0]), np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(kept.sum() + len(none)) >= kept.sum()),
                 *(pa.array(np.concatenate([a, b]), t) for a, b, t in zip(
                     (gram[kept].view(np.int64), content[kept].view(np.int64), doc[kept], key[kept], start[kept], n[kept]),
                     (none, none, *runs), SEGMENT.types[1:]))], schema=SEGMENT)

        def look(parts: list[tuple[int, int, int, bytes]]) -> None:
            nonlocal n_held
            sizes = np.array([len(p[3]) for p in parts])
            place, n, gram, content = segments(b"".join(p[3] for p in parts), sizes)
            begin = np.cumsum(sizes) - sizes
            k = np.searchsorted(begin, place, "right") - 1
            doc, key, skip = (np.array([p[c] for p in parts], np.int64) for c in range(3))
            held.append((gram, content, doc[k], key[k], place - begin[k] + skip[k], n))
            n_held += len(place)

        parts, size = [], 0
        for batch in batches:
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_buffer()
                # parts overlap, so that each window is in one of them
                for k in range(0, max(len(text) - WIDTH + 1, 0), BUFFER):
                    part = text[k:k + BUFFER + WIDTH - 1].to_pybytes()
                    parts.append((doc, key, k, part))
                    size += len(part)
                    if size >= BUFFER:
                        look(parts)
                        parts, size = [], 0
                        if n_held >= COMBINED:
                            yield combine()
                            n_held = 0
        if parts:
            look(parts)
        if n_held:
            yield combine()
        # a worker is kept for other tasks, beside a JVM that needs the memory
        pa.default_memory_pool().release_unused()

    return docs.select("doc", "text_key", "text").mapInArrow(run, SEGMENT_DDL)


def marked_segments(found: DataFrame) -> DataFrame:
    """Of all segments: ``dup`` those that have an earlier equal, and the first ones
    of each content where a gram has several contents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None           # first row of the last content seen
        waiting: list[tuple] = []           # the last gram's only content so far
        several = False                     # the last gram has several contents
        for batch in batches:
            dup = batch.column(0).to_numpy(zero_copy_only=False)
            yield batch.filter(batch.column(0))
            rest = batch.filter(pa.array(~dup))
            if not rest.num_rows:
                continue
            cols = [rest.column(c).to_numpy() for c in range(1, 7)]
            gram, content, doc, key, start, _ = cols
            before = last or (None,) * 6
            new_gram = np.concatenate([[before[0] != gram[0]], gram[1:] != gram[:-1]])
            new = new_gram | np.concatenate([[before[1] != content[0]], content[1:] != content[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            prior = [np.where(first >= 0, c[first], b if b is not None else 0) for c, b in zip((doc, key, start), before[2:5])]
            later = ~new & ((doc != prior[0]) | (key != prior[1]) | (start != prior[2]))
            yield _segments(True, [c[later] for c in cols])
            # one row for each content; those of a gram with one content go no further
            at = np.flatnonzero(new)
            if len(at):
                gram_no = np.cumsum(new_gram)[at]
                times = np.bincount(gram_no, minlength=gram_no.max() + 1)
                if gram_no[0] == 0:         # goes on with the last batch's gram
                    times[0] += 1
                    if waiting:
                        yield _segments(True, [np.array([v]) for v in waiting[0]], variant=True)
                many = times[gram_no] > 1
                if gram_no[0] == 0:
                    several = True
                yield _segments(True, [c[at[many]] for c in cols], variant=True)
                if gram_no[-1] > 0 or gram_no[0] > 0:
                    several = bool(many[-1])
                waiting = [] if several else [tuple(c[at[-1]] for c in cols)]
                last = tuple(c[at[-1]].item() for c in cols)

    def _segments(dup: bool, cols: list[np.ndarray], variant: bool = False) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), dup and not variant)),
                                           *(pa.array(c, t) for c, t in zip(cols, SEGMENT.types[1:]))], schema=SEGMENT)

    # what is a copy already needs no company
    route = F.when(F.col("dup"), F.xxhash64("doc", "start")).otherwise(F.col("gram"))
    return (found.repartition(route).sortWithinPartitions("gram", "content", "doc", "text_key", "start")
            .mapInArrow(run, SEGMENT_DDL).select("dup", F.expr("if(dup, null, gram)").alias("gram"), "doc", "text_key", "start", "n"))


def variant_bytes(marked: DataFrame) -> DataFrame:
    """(gram, doc, text_key, start, n, bytes) of the ``variants`` of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, text, variants in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2),
                                                batch.column(3).to_pylist()):
                text = text.as_buffer().to_pybytes()
                if variants:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v["gram"] for v in variants]), pa.array([doc] * len(variants)),
                         pa.array([key] * len(variants)), pa.array([v["start"] for v in variants]),
                         pa.array([v["n"] for v in variants], pa.int32()),
                         pa.array([text[v["start"]:v["start"] + v["n"] + WIDTH - 1] for v in variants])],
                        names=["gram", "doc", "text_key", "start", "n", "bytes"])

    return marked.select("doc", "text_key", "text", "variants").mapInArrow(
        run, "gram long, doc long, text_key long, start long, n int, bytes binary")


def indexed(variants: DataFrame) -> DataFrame:
    """(doc, text_key, start, n): runs of windows that occur earlier, by run-length
    indexes over the segments of whole grams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last_gram = 0, None

        def index() -> pa.RecordBatch:
            # by place, so that an earlier position is an earlier window
            rows.sort(key=lambda r: r[1:4])
            made = RunIndex([r[5] for r in rows])
            later = made.later_matches(WIDTH)
            edge = np.diff(np.concatenate([[0], later.view(np.int8), [0]]))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            k = np.searchsorted(made.starts, begin, "right") - 1
            start = [rows[i][3] + int(b) for i, b in zip(k, begin - made.starts[k])]
            out = pa.RecordBatch.from_arrays(
                [pa.array([rows[i][1] for i in k], pa.int64()), pa.array([rows[i][2] for i in k], pa.int64()),
                 pa.array(start, pa.int64()), pa.array(end - begin, pa.int32())], names=["doc", "text_key", "start", "n"])
            rows.clear()
            return out

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != last_gram and size >= INDEX_BYTES:
                    yield index()
                    size = 0
                last_gram = row[0]
                rows.append(row)
                size += len(row[5])
        if rows:
            yield index()
        pa.default_memory_pool().release_unused()

    return (variants.select("gram", "doc", "text_key", "start", "n", "bytes").repartition("gram")
            .sortWithinPartitions("gram", "doc", "text_key", "start")
            .mapInArrow(run, "doc long, text_key long, start long, n int"))


def by_window(variants: DataFrame) -> DataFrame:
    """The same for grams of very many segments, by hashes of their single windows."""
    windows = variants.select("doc", "text_key", "start", "bytes", F.explode(F.expr("sequence(0, n - 1)")).alias("i"))
    cut = F.expr(f"substring(bytes, i + 1, {WIDTH})")
    windows = windows.select("doc", "text_key", (F.col("start") + F.col("i")).alias("start"), F.xxhash64(cut).alias("h1"),
                             F.xxhash64(F.lit("second"), cut).alias("h2"))
    place = F.struct("doc", "text_key", "start")
    firsts = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last")
    return windows.join(firsts, ["h1", "h2"]).filter(place > F.col("first")).select(
        "doc", "text_key", "start", F.lit(1).alias("n"))


def cut_out(text: bytes, runs: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], bytes]:
    """The spans (start, end) that runs of windows cover, and the bytes left."""
    spans: list[tuple[int, int]] = []
    for start, n in sorted(runs):
        end = start + n + WIDTH - 1
        if spans and start <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(end, spans[-1][1])
        else:
            spans.append((start, end))
    left, at = [], 0
    for start, end in spans:
        left.append(text[at:start])
        at = end
    return spans, b"".join([*left, text[at:]])


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> str:
    """What is left if a character goes only with all its bytes."""
    left, at = [], 0
    for start, end in spans:
        while start < end and text[start] & 0xC0 == 0x80:
            start += 1
        while start < end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        left.append(text[at:start])
        at = end
    return b"".join([*left, text[at:]]).decode()


def results(marked: DataFrame, with_text: bool) -> DataFrame:
    """(doc, text_key, spans, kept_sha256, kept) of texts with runs to remove."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, digests, kept = [], [], []
            for text, runs in zip(batch.column(2), batch.column(3).to_pylist()):
                text = text.as_buffer().to_pybytes()
                cut, left = cut_out(text, [(r["start"], r["n"]) for r in runs])
                spans.append([{"start": a, "length": b - a} for a, b in cut])
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(whole_characters(text, cut) if with_text else None)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind), pa.array(digests, pa.string()),
                                              pa.array(kept, pa.string())], names=["doc", "text_key", "spans", "kept_sha256", "kept"])

    return marked.select("doc", "text_key", "text", "runs").mapInArrow(
        run, "doc long, text_key long, spans array<struct<start:long,length:long>>, kept_sha256 string, kept string")


def dedup_passages(docs: DataFrame, with_text: bool = False, keep: tuple[str, ...] = (),
                   held: common.Scratch | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256, kept, *keep) of every
    row; ``kept`` is the text left, by whole characters, if ``with_text``; ``keep`` names
    columns of ``docs`` to go along. With its text, the result reads a table in ``held``,
    which may be dropped once the result is written."""
    common.ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("text_key"),
                       F.xxhash64(F.lit("second"), text).alias("second_key"), text.alias("text"),
                       F.struct(F.lit(None).cast("int").alias("none"), *keep).alias("others"))
    keys = ["text_key", "second_key"]
    early, late = (common.Scratch(docs.sparkSession, name) for name in ("suffix-early", "suffix-late"))
    copies = early.saved(base.filter(F.octet_length("text") >= WIDTH).groupBy(*keys).agg(
        F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select(*keys, "first"), "copies")
    later = common.saved(
        base.select("doc", *keys).join(copies, keys).filter("doc > first").select("doc", *keys).distinct(), "later-copies")
    # equal rows are one before the shuffle, and no later one moves the texts
    texts = base.filter(F.octet_length("text") >= WIDTH).select("doc", "text_key", "text")
    whole_texts = held or common.Scratch(docs.sparkSession, "suffix-texts") if with_text else late
    whole_texts = whole_texts.bucketed(texts.dropDuplicates(TEXT).join(later.select(*TEXT), TEXT, "left_anti"), "texts", TEXT)
    texts = whole_texts.withColumn("text", F.encode("text", "UTF-8"))

    segs = late.saved(marked_segments(found_segments(texts)), "segments")
    early.drop()
    in_text = segs.filter("not dup").groupBy(*TEXT).agg(F.collect_list(F.struct("gram", "start", "n")).alias("variants"))
    variants = late.saved(variant_bytes(texts.join(in_text, TEXT)), "variants")
    crowded = variants.groupBy("gram").count().filter(F.col("count") > MOST_VARIANTS).select("gram", F.lit(True).alias("crowded"))
    variants = variants.join(late.saved(crowded, "crowded"), "gram", "left")
    runs = indexed(variants.filter("crowded is null")).unionByName(by_window(variants.filter("crowded")))
    runs = runs.unionByName(segs.filter("dup").select(*TEXT, "start", "n"))
    runs = runs.groupBy(*TEXT).agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    done = common.saved(results(texts.join(runs, TEXT), with_text), "results")
    late.drop()

    # no text is both looked into and a later copy
    none = F.array().cast("array<struct<start:long,length:long>>")
    removed = done.withColumn("copy", F.lit(False)).unionByName(
        later.select("doc", "text_key", F.lit(True).alias("copy")), allowMissingColumns=True)
    rows = base.select("doc_id", "doc", "text_key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"),
                       "others", *[F.when(F.octet_length("text") < WIDTH, F.col("text")).alias("short_text")] * with_text)
    out = rows.join(removed, TEXT, "left")
    if with_text:       # a text that isn't short or a later copy is in its table, and isn't shuffled again
        out = out.join(whole_texts.withColumnRenamed("text", "whole_text"), TEXT, "left").withColumn("text", F.coalesce("short_text", "whole_text"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("length")))
    out = out.withColumn("spans", F.when(F.col("copy"), whole).otherwise(F.coalesce("spans", none)))
    return out.select(
        "doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (x, s) -> x + s.length)").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), "spans",
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *[F.when(F.col("copy"), F.lit("")).otherwise(F.coalesce("kept", "text")).alias("kept")] * with_text,
        *[F.col("others")[c].alias(c) for c in keep])
