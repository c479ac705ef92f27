"""Aligns two tokenizers' ids over a corpus by an inverted index of id pairs.

A text is encoded by a byte-level BPE (A, with a blank before it) and by a sentencepiece
model (B, which puts the blank itself). Byte offsets where tokens of both end cut the
text into groups, and the A and B token that end there are linked.

The index has, per pair of ids and per container of 65,536 documents, compressed bitmaps
of documents, one for each binary place (plane) of how often a document has the pair: a
document with the pair five times is in planes 0 and 2. A bitmap is a sorted list of
16-bit numbers up to 4,096 documents and 8 kB of bits beyond, so the most frequent pair
costs a bit or two per document, and no key of the index can be hot. Each task makes
bitmaps for blocks of its documents; they meet by pair, are ORed per container, and their
population counts give the documents and (weighted by plane) links of a pair. The pairs'
figures then go along the postings back to the documents, where a dense array per
container sums them up.

A text is cut before each single blank between two other characters than white space, as
no token of either vocabulary goes across (checked when B is loaded; else a text is one
piece), so pieces met before are looked up.

Defined results: a null or empty text, and one whose tokens don't give its bytes back
(piece by piece), has no tokens: zeros and an empty digest; null ids stay; repeated rows
count one by one; an empty table gives no row; columns besides ``doc_id`` and ``text``
are not read. No token has zero bytes, so the links of a text are as many as its groups.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.llm import bpe, common

BLANK = "▁"
CUT = re.compile(r"(?<=\S) (?=\S)")
BESIDE = re.compile(r" (?:(?<=\s )|(?=\s))")     # a blank beside white space
CONTAINER_BITS = 16
MOST_LISTED = 4096              # beyond, a list is longer than the bits
BLOCK_LINKS = 2_000_000         # a task's links are turned into bitmaps when they are as many


class Aligner:
    """Both tokenizers; ``text`` aligns one text. At most ``cache`` pieces are remembered."""

    def __init__(self, a_path: str, b_path: str, cache: int = 600_000):
        import sentencepiece

        coder = bpe.load(a_path, special=False)
        self.a, self.b = coder._coder, sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.n_a, self.n_b = coder.n_vocab, self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any(BLANK in p.lstrip(BLANK) for i, p in enumerate(pieces) if not self.b.is_byte(i))
        ordinary = self.a._mergeable_ranks.items()
        self.a_size, self.b_size = np.zeros(self.n_a, np.int64), np.array([*map(len, self.b_bytes)])
        for token, i in ordinary:
            self.a_size[i] = len(token)
        # each id as text, with what follows it inside a group and at its side's end
        self.written = [b"%d%s" % (i, c) for i in range(self.n_a) for c in (b",", b"|")]
        self.written += [b"%d%s" % (i, c) for i in range(self.n_b) for c in (b",", b";")]
        self.seen: dict[str, tuple[bytes, bytes] | bool] = {}
        self.most = cache

    def learn(self, pieces: list[str]) -> None:
        """Remember both tokenizers' ids of each piece with the blank before it; False if
        its bytes don't come back. The pieces are encoded as one text, and cut again."""
        whole = f" {' '.join(pieces)}".encode()
        a, b = np.array(self.a.encode_ordinary(whole.decode()), np.uint32), np.array(self.b.encode(" ".join(pieces)), np.uint32)
        sound = b"".join(map(self.b_bytes.__getitem__, b.tolist())) == whole and self.a.decode_bytes(a.tolist()) == whole
        if not sound and len(pieces) > 1:
            for piece in pieces:
                self.learn([piece])
            return
        if not sound:
            self.seen[pieces[0]] = False
            return
        ends = np.cumsum([len(p.encode()) + 1 for p in pieces])
        cut_a, cut_b = (4 * np.searchsorted(np.cumsum(size[ids]), ends, "right") for ids, size in ((a, self.a_size), (b, self.b_size)))
        a, b, i, j = a.tobytes(), b.tobytes(), 0, 0
        for piece, p, q in zip(pieces, cut_a.tolist(), cut_b.tolist()):
            self.seen[piece] = a[i:p], b[j:q]
            i, j = p, q

    def pieces(self, text: str, size: int = 1 << 18) -> Iterator[list[str]]:
        """The text's pieces, about ``size`` characters at a time."""
        if not self.cuts:
            yield [text]
            return
        at = 0
        while at < len(text):
            m = CUT.search(text, at + size)
            part = text[at:m.start()] if m else text[at:]
            at = m.end() if m else len(text)
            odd = part[0].isspace() or part[-1].isspace() or BESIDE.search(part)
            yield CUT.split(part) if odd else part.split(" ")

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        found = list(map(self.seen.get, pieces))
        if None in found:
            if len(self.seen) > self.most:
                self.seen.clear()
            self.learn(list(dict.fromkeys(p for p in pieces if p not in self.seen)))
            found = list(map(self.seen.get, pieces))
            for p in filter(lambda p: len(p) > 64, pieces):
                self.seen.pop(p, None)      # long ones don't come again
        if False in found:
            return None
        a, b = zip(*found)
        return np.frombuffer(b"".join(a), np.uint32), np.frombuffer(b"".join(b), np.uint32)

    def aligned(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, bytes]:
        """The pairs linked, and the groups as text, each with a semicolon behind it."""
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        both = np.zeros(a_ends[-1] + 1, np.int8)
        both[a_ends] = 1
        both[b_ends] += 1
        a_last, b_last = both[a_ends] == 2, both[b_ends] == 2
        at_a, at_b = np.flatnonzero(a_last), np.flatnonzero(b_last)
        pairs = a[at_a].astype(np.int64) * self.n_b + b[at_b]
        # a token's place: its number, and how many of the other side are in the groups before
        # (for B, in its own too)
        b_before, a_before = np.append(0, at_b + 1), at_a + 1
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + b_before[np.cumsum(a_last) - a_last]] = 2 * a.astype(np.int64) + a_last
        codes[np.arange(len(b)) + a_before[np.cumsum(b_last) - b_last]] = 2 * (b.astype(np.int64) + self.n_a) + b_last
        return pairs, b"".join(map(self.written.__getitem__, codes.tolist()))

    def text(self, text: str | None) -> tuple[int, int, np.ndarray, str] | None:
        """Numbers of A and B tokens, the pairs linked, and the digest of the groups."""
        if not text:
            return None
        n_a, n_b, pairs, digest, held = 0, 0, [], hashlib.sha256(), b""
        for pieces in self.pieces(text):
            found = self.ids(pieces)
            if found is None:
                return None
            linked, groups = self.aligned(*found)
            n_a, n_b = n_a + len(found[0]), n_b + len(found[1])
            pairs.append(linked)
            digest.update(held)
            held = groups
        digest.update(held[:-1])
        return n_a, n_b, np.concatenate(pairs), digest.hexdigest()


_loaded: dict[tuple[str, str], Aligner] = {}


def load(a_path: str, b_path: str) -> Aligner:
    """One per worker process and pair of files."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Aligner(a_path, b_path)
    return _loaded[a_path, b_path]


def packed(listed: bytes) -> bytes:
    """A bitmap from its sorted 16-bit numbers: they themselves, or the bits and one more
    byte, whose odd length tells them apart."""
    if len(listed) <= 2 * MOST_LISTED:
        return listed
    bits = np.zeros(1 << CONTAINER_BITS, np.uint8)
    bits[np.frombuffer(listed, "<u2")] = 1
    return np.packbits(bits, bitorder="little").tobytes() + b"\0"


def unpacked(bitmap: bytes) -> np.ndarray:
    if len(bitmap) % 2:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap[:-1], np.uint8), bitorder="little"))
    return np.frombuffer(bitmap, "<u2")


ROW = pa.schema([("at", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()),
                 ("groups_sha256", pa.string()), ("pair", pa.int64()), ("container", pa.int64()), ("plane", pa.int32()), ("docs", pa.binary())])


def block_bitmaps(pairs: np.ndarray, low: np.ndarray, container: int) -> Iterator[pa.RecordBatch]:
    """Bitmaps of a block of documents: one row per pair and plane."""
    keys, times = np.unique(pairs << CONTAINER_BITS | low, return_counts=True)
    for plane in range(int(times.max()).bit_length()):
        chosen = keys[times >> plane & 1 == 1]
        if not len(chosen):
            continue
        first = np.flatnonzero(np.diff(chosen >> CONTAINER_BITS, prepend=-1))
        ends = np.append(first, len(chosen)).astype("<i4") * 2
        docs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer((chosen & 0xFFFF).astype("<u2"))])
        n = len(first)
        cols = [pa.nulls(n, t) for t in ROW.types[:6]]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(chosen[first] >> CONTAINER_BITS), pa.array(np.full(n, container)),
                                          pa.array(np.full(n, plane, np.int32)), docs], schema=ROW)


def encoded(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of two kinds, from one pass: per document ``at``, its counts and digest; per
    block, pair and plane the documents (``pair`` is not null)."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load(a_path, b_path)
        pairs, low, held, container = [], [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if held:
                yield from block_bitmaps(np.concatenate(pairs), np.concatenate(low), container)
            pairs.clear(), low.clear()
            held = 0

        for batch in batches:
            rows = []
            for at, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = aligner.text(text.as_py())
                if found is None:
                    rows.append((at, doc_id, 0, 0, 0, ""))
                    continue
                n_a, n_b, links, digest = found
                rows.append((at, doc_id, n_a, n_b, len(links), digest))
                if at >> CONTAINER_BITS != container or held >= BLOCK_LINKS:
                    yield from flush()
                    container = at >> CONTAINER_BITS
                pairs.append(links)
                low.append(np.full(len(links), at & 0xFFFF))
                held += len(links)
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), ROW.types)]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.nulls(len(rows), t) for t in ROW.types[6:]]], schema=ROW)
        yield from flush()

    numbered = docs.select(F.monotonically_increasing_id().alias("at"), "doc_id", "text")
    return numbered.mapInArrow(run, "at long, doc_id long, n_a long, n_b long, n_links long, groups_sha256 string, "
                                    "pair long, container long, plane int, docs binary")


INDEX = pa.schema([("pair", pa.int64()), ("container", pa.int64()), ("n_docs", pa.int64()), ("n_links", pa.int64()),
                   ("planes", pa.list_(pa.binary()))])


def pair_index(blocks: DataFrame) -> DataFrame:
    """The inverted index: the blocks' bitmaps ORed per pair, container and plane.
    ``planes[k]`` is empty if no document has the binary place k."""
    common.ship(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def merged() -> Iterator[tuple]:
            for (pair, container), group in itertools.groupby(rows(), key=itemgetter(0, 1)):
                planes: list[bytes] = []
                for _, _, plane, docs in group:
                    planes += [b""] * (plane + 1 - len(planes))
                    planes[plane] += docs       # lists of different documents
                counts = [len(p) // 2 for p in planes]
                n_docs = counts[0] if len(planes) == 1 else len(np.unique(np.frombuffer(b"".join(planes), "<u2")))
                yield pair, container, n_docs, sum(n << k for k, n in enumerate(counts)), [*map(packed, planes)]

        yield from record_batches(merged(), INDEX)

    dealt = (blocks.filter("pair is not null").select("pair", "container", "plane", "docs").repartition("pair")
             .sortWithinPartitions("pair", "container", "plane"))
    return dealt.mapInArrow(run, "pair long, container long, n_docs long, n_links long, planes array<binary>")


def record_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    while held := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def pair_scores(index: DataFrame, n_b: int) -> DataFrame:
    """(pair, a_id, b_id, n_docs, n_links, best) of each pair of ids; ``best``: no A id is
    linked more often with this B id."""
    pairs = index.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    pairs = pairs.select("pair", F.expr(f"pair div {n_b}").alias("a_id"), (F.col("pair") % n_b).alias("b_id"), "n_docs", "n_links")
    highest = pairs.groupBy("b_id").agg(F.max("n_links").alias("highest"))
    return pairs.join(highest, "b_id").select("pair", "a_id", "b_id", "n_docs", "n_links", (F.col("n_links") == F.col("highest")).alias("best"))


def document_scores(index: DataFrame, pairs: DataFrame, parts: int = 4) -> DataFrame:
    """(at, n_best, count_sum) of each document with links: the pairs' figures go along the
    postings, and are summed per container in ``parts`` dense arrays, then per document."""
    common.ship(index.sparkSession)
    schema = pa.schema([("at", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        for (container, _), group in itertools.groupby(rows(), key=itemgetter(0, 1)):
            best, total = np.zeros((2, 1 << CONTAINER_BITS), np.int64)
            for _, _, planes, count, is_best in group:
                for k, bitmap in enumerate(planes):
                    if bitmap:
                        docs = unpacked(bitmap)
                        total[docs] += count << k
                        if is_best:
                            best[docs] += 1 << k
            met = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(met + (container << CONTAINER_BITS)), pa.array(best[met]), pa.array(total[met])],
                                             schema=schema)

    scored = index.select("pair", "container", "planes").join(pairs.select("pair", "n_links", "best"), "pair")
    dealt = (scored.select("container", F.pmod(F.hash("pair"), F.lit(parts)).alias("part"), "planes", "n_links", "best")
             .repartition("container", "part").sortWithinPartitions("container", "part"))
    sums = dealt.mapInArrow(run, "at long, n_best long, count_sum long")
    return sums.groupBy("at").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_corpus(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """Per document its counts, digest and scores; and the pairs with their figures."""
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    rows = common.saved(encoded(docs, a_path, b_path), "aligned")
    index = common.saved(pair_index(rows), "pair-index")
    pairs = common.saved(pair_scores(index, n_b), "pairs")
    texts = rows.filter("pair is null").select("at", "doc_id", "n_a", "n_b", "n_links", "groups_sha256")
    found = texts.join(document_scores(index, pairs), "at", "left")
    return found.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links",
                        F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"),
                        "groups_sha256"), pairs
