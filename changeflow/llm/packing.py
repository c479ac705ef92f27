"""Sum-of-squares packing of documents into windows of a fixed number of tokens.

Each task packs the documents of its partition in one pass, and hands the windows
that are open at its end on: a tree of tasks, FAN to one, packs their pieces on,
the longest first, until one task is left. What a task hands on is ``max_open``
windows at most, however much it read, and no key can be hot. ``n[h]`` is the number of open windows filled to
level ``h``. An item of ``s`` tokens goes to the level (0 opens a window) where
the sum of the squared counts of partially filled windows gets smallest, which
keeps the levels even, so that later items find a window they fill exactly.
Documents longer than a window give whole windows and one item for the rest.

Only what is open at the root of the tree, and whatever exceeds ``max_open`` before,
is cut anew into full windows; one window in all is padded.

Defined results: a null or empty text has the closing id only; null ids are kept
as they are; repeated rows are packed one by one; an empty table gives no row;
columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.llm import bpe, common

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
FAN = 16                    # tasks whose open windows one task goes on with
ROUND_BITS, TASK_BITS = 54, 30      # of a sequence's number: round, task, count
Piece = tuple  # (doc_id, start, packed ids, doc_tokens)


class SumOfSquares:
    """Online packer. ``add`` and ``close`` return the windows that were filled,
    each a list of pieces."""

    def __init__(self, capacity: int, max_open: int = 4096):
        self.capacity, self.max_open = capacity, max_open
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.at: list[list[list[Piece]]] = [[] for _ in range(capacity + 1)]
        self.open = 0

    def level_for(self, size: int) -> int:
        n, top = self.counts, self.capacity - size
        gain = 2 * n[size:] + 1         # of the level reached
        gain[top] = 0                   # a full window leaves the sum
        loss = 1 - 2 * n[:top + 1]      # of the level left
        loss[0] = 0                     # a new window leaves none
        change = gain + loss
        change[1:][n[1:top + 1] == 0] = np.iinfo(np.int64).max
        best = change.min()
        return int(np.flatnonzero(change == best)[-1])

    def add(self, piece: Piece) -> list[list[Piece]]:
        size = len(piece[2]) // 4
        h = self.level_for(size)
        if h:
            window = self.at[h].pop()
            self.counts[h] -= 1
            self.open -= 1
        else:
            window = []
        window.append(piece)
        if h + size == self.capacity:
            return [window]
        self.at[h + size].append(window)
        self.counts[h + size] += 1
        self.open += 1
        return self.close(keep_rest=True) if self.open > self.max_open else []

    def close(self, keep_rest: bool = False) -> list[list[Piece]]:
        """Cut the pieces of all open windows anew into full windows and a last one."""
        out: list[list[Piece]] = []
        window: list[Piece] = []
        room = self.capacity
        for level in range(self.capacity, 0, -1):
            for pieces in self.at[level]:
                for doc_id, start, ids, total in pieces:
                    while ids:
                        part, ids = ids[:4 * room], ids[4 * room:]
                        window.append((doc_id, start, part, total))
                        start += len(part) // 4
                        room -= len(part) // 4
                        if not room:
                            out.append(window)
                            window, room = [], self.capacity
            self.at[level] = []
        self.counts[:] = 0
        self.open = 0
        if window and keep_rest:
            level = self.capacity - room
            self.at[level].append(window)
            self.counts[level], self.open = 1, 1
        elif window:
            out.append(window)
        return out


def numbered(windows: list[list[Piece]], first: int) -> Iterator[tuple]:
    """The rows of full windows, numbered from ``first``."""
    for k, window in enumerate(windows):
        offset = 0
        for doc_id, start, ids, total in window:
            yield doc_id, start, len(ids) // 4, ids, total, first + k, offset, None
            offset += len(ids) // 4


def handed_on(packer: SumOfSquares, task: int) -> Iterator[tuple]:
    """The pieces of open windows: no sequence yet, but the task they come from."""
    for level in packer.at:
        for window in level:
            for doc_id, start, ids, total in window:
                yield doc_id, start, len(ids) // 4, ids, total, None, None, task


def pack_partitions(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, max_open: int) -> DataFrame:
    """Pieces of the windows that each task fills, and those it hands on (``task``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, end = bpe.load(tokenizer), np.array([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        packer = SumOfSquares(capacity, max_open)

        def rows() -> Iterator[tuple]:
            full, number = 4 * capacity, task << TASK_BITS
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = coder.encode(text.as_py()) + end
                    total, cut = len(ids) // 4, len(ids) - len(ids) % full
                    done = [[(doc_id, k // 4, ids[k:k + full], total)] for k in range(0, cut, full)]
                    if cut < len(ids):
                        done += packer.add((doc_id, cut // 4, ids[cut:], total))
                    yield from numbered(done, number)
                    number += len(done)
            yield from handed_on(packer, task)

        yield from batched(rows(), PACKED_ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, PACKED)


def pack_handed_on(pieces: DataFrame, turn: int, root: bool, capacity: int, max_open: int) -> DataFrame:
    """One level of the tree: the pieces of FAN tasks go on in one, the longest first;
    the root cuts what stays open."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            node, packer, number = None, SumOfSquares(capacity, max_open), 0

            def end() -> Iterator[tuple]:
                if root:
                    yield from numbered(packer.close(), number)
                elif node is not None:
                    yield from handed_on(packer, node)

            for batch in batches:
                for doc_id, start, ids, total, task in zip(*(c.to_pylist() for c in batch.columns)):
                    if task != node:
                        yield from end()
                        node, packer, number = task, SumOfSquares(capacity, max_open), turn << ROUND_BITS | task << TASK_BITS
                    done = packer.add((doc_id, start, ids, total))
                    yield from numbered(done, number)
                    number += len(done)
            yield from end()

        yield from batched(rows(), PACKED_ARROW)

    dealt = pieces.select("doc_id", "start", "ids", "doc_tokens", F.expr(f"task div {FAN}").alias("task"))
    return dealt.repartition("task").sortWithinPartitions("task", F.length("ids").desc(), "doc_id", "start", "ids").mapInArrow(run, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0,
                   max_open: int = 4096) -> DataFrame:
    """One row per piece: its document, place in the document, packed ids
    (little-endian 32-bit), and place in a sequence."""
    common.ship(docs.sparkSession)
    made = common.saved(pack_partitions(docs, tokenizer, capacity, end_id, max_open), "packed")
    packed, turn = made.filter("task is null"), 0
    while True:
        most = made.agg(F.max("task")).first()[0]
        if most is None:
            return packed.drop("task")
        turn += 1
        made = common.saved(pack_handed_on(made.filter("task is not null"), turn, most < FAN, capacity, max_open), "packed-on")
        packed = packed.unionByName(made.filter("task is null"))


SCHEMA_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                          ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PACKED, PACKED_ARROW = f"{SCHEMA}, task long", SCHEMA_ARROW.append(pa.field("task", pa.int64()))


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
