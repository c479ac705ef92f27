"""Distinct sampled segmentations of texts over a SentencePiece vocabulary.

A text's lattice has an arc for each piece that fits at a place. The pieces' scores
give each segmentation a probability; the inside sums of the lattice make the
probability of the next piece exact. Perturbed A-star search (Gumbel top-k): every
set of segmentations that share a beginning has the largest Gumbel-perturbed log
probability of its members, drawn under the one of the set it was split from. The
best set is split until one segmentation is left; the first k to arrive are a sample
without replacement. A segmentation's inclusion score is its chance to be above the
first one that isn't returned; for long texts it is under 5e-324, so its logarithm
is returned beside it. Of the sets split off, only as many as can still be
returned are kept. Once these are full and a set's chance to come before the last of
them is under rounding (2 ** -53), the rest of a segmentation is drawn word by word,
so that a long text takes time in proportion to its length and no memory for its sets.
``sample`` does this for one text; ``lockstep`` does the same for many texts at a time,
with the same random numbers and the same results.

Pieces hold blanks at their beginning only, one or a run of them, so the lattice is a
chain of the lattices of words, each with the whole run of blanks before it; these are
remembered. A vocabulary with a piece that holds a blank further on gets one lattice
for the whole text. The vocabulary gives ranks, not probabilities; piece r has one in
proportion to 1 / (r + 2). A character that no piece has is spelled by its UTF-8 bytes.

Defined results: a null or empty text has one empty segmentation with score 1; if a
text has fewer than k segmentations, all are returned; the seed is the row's key, so
equal keys and texts draw the same, and null keys are drawn as the word null; an empty
table gives no row; columns besides the keys and ``text`` aren't read.
"""

from __future__ import annotations

import re
from array import array
from bisect import insort
from collections.abc import Iterator, Sequence
from functools import cached_property
from math import exp, expm1, log
from random import Random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from changeflow.llm import common, lockstep
from changeflow.llm.packing import batched

BLANK = "▁"
STAND_IN = "\ud800"       # for BLANK in a text: no text of Spark's has a lone surrogate
SPELLED = {STAND_IN: BLANK}
WORD = re.compile(f"{BLANK}+[^{BLANK}]*")     # with the run of blanks before it
REMEMBERED = 1_500_000      # arcs and pieces of words that are remembered
SHORT_WORD = 40           # signs up to which a word's sums are plain products
LEAST = 1e-200            # and the least of these that may be
LONG_WORD = 2048          # signs from which on a word's arcs are made as they are asked for
UNDER = 40.0              # in logs, more than the 53 bits of a random number
OUT_IDS = 1 << 18         # ids in a batch of results
TOGETHER, MOST_TEXTS = 3_000_000, 4096      # signs and texts that are drawn together
LONG_TEXT = 1 << 20       # signs from which on a text is drawn by itself
Arc = tuple     # (end, piece ids, chance)
_loaded: dict[str, "Pieces"] = {}


class Word:
    """A word's lattice: the arcs from each place that lead to its end, with their chances."""

    __slots__ = ("arcs",)

    def __init__(self, arcs: Sequence[list[Arc]]):
        self.arcs = arcs

    def draw(self, at: int, ids: list[int], random: Random) -> float:
        """Draw a segmentation from a place on into ``ids``; its log probability."""
        score = 0.0
        while at < len(self.arcs):
            arcs = self.arcs[at]
            arc = arcs[0]
            if len(arcs) > 1:
                r = random.random()
                for arc in arcs:
                    r -= arc[2]
                    if r < 0:
                        break
                score += log(arc[2])
            ids += arc[1]
            at = arc[0]
        return score


class Places(Sequence):
    """The arcs of a long word, made from its inside sums as they are asked for."""

    def __init__(self, pieces: "Pieces", word: str, inside: array):
        self.pieces, self.word, self.inside = pieces, word, inside

    def __len__(self) -> int:
        return len(self.word)

    def __getitem__(self, i: int) -> list[Arc]:
        return [(j, ids, exp(s - self.inside[i])) for j, ids, s in self.pieces.arcs(self.word, i, self.inside)]


class Pieces:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.of_byte = {i: bytes([b]) for b, i in self.byte_ids.items()}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        plain.sort(key=lambda i: (-sp.get_score(i), i))
        self.text = {i: sp.id_to_piece(i) for i in plain}
        total = log(sum(1 / (r + 2) for r in range(n)))
        self.pieces = {self.text[i]: ((i,), -log(r + 2) - total, exp(-log(r + 2) - total)) for r, i in enumerate(plain)}
        # no piece goes from one word into the next, unless one holds a blank further on
        self.word = WORD if all(BLANK not in p.lstrip(BLANK) for p in self.pieces) else re.compile("(?s).+")
        self.longest = max(map(len, self.pieces))
        self.byte_score = -log(n + 2) - total
        self.spelled = {i: t.replace(BLANK, " ").encode() for i, t in self.text.items()} | self.of_byte
        self.bytes_of = np.array([self.spelled.get(i, b"") for i in range(n)], object)
        self.words: dict[str, Word] = {}
        self._held = 0

    @cached_property
    def tables(self) -> lockstep.Tables:
        return lockstep.Tables(self, SHORT_WORD, LEAST, LONG_WORD)

    def spelling(self, sign: str) -> tuple[int, ...]:
        """The pieces of a sign's bytes."""
        return tuple(self.byte_ids[b] for b in SPELLED.get(sign, sign).encode())

    def arcs(self, word: str, i: int, inside: Sequence[float]) -> list[tuple]:
        """(end, piece ids, log weight of all that begins so) from a place of a word."""
        found = []
        for j in range(i + 1, min(len(word), i + self.longest) + 1):
            piece = self.pieces.get(word[i:j])
            if piece:
                found.append((j, piece[0], piece[1] + inside[j]))
        if not found or found[0][0] > i + 1:
            ids = self.spelling(word[i])
            found.append((i + 1, ids, self.byte_score * len(ids) + inside[i + 1]))
        return found

    def short(self, word: str) -> list[list[Arc]]:
        """The arcs of a short word by plain products, or none if these get too small."""
        n = len(word)
        inside, arcs, get, longest = [0.0] * n + [1.0], [[] for _ in word], self.pieces.get, self.longest
        for i in range(n - 1, -1, -1):
            found = []
            for j in range(i + 1, min(n, i + longest) + 1):
                piece = get(word[i:j])
                if piece:
                    found.append((j, piece[0], piece[2] * inside[j]))
            if not found or found[0][0] > i + 1:
                ids = self.spelling(word[i])
                found.append((i + 1, ids, exp(self.byte_score * len(ids)) * inside[i + 1]))
            total = 0.0
            for f in found:
                total += f[2]
            if total < LEAST:
                return []
            inside[i] = total
            arcs[i] = [(j, ids, x / total) for j, ids, x in found]
        return arcs

    def lattice(self, word: str) -> Word:
        if word in self.words:
            return self.words[word]
        n = len(word)
        arcs: Sequence[list[Arc]] = self.short(word) if n < SHORT_WORD else []
        size = sum(map(len, arcs))
        if not arcs:
            inside, size = array("d", bytes(8 * (n + 1))), n
            arcs = Places(self, word, inside)
            for i in range(n - 1, -1, -1):
                found = self.arcs(word, i, inside)
                top = max(f[2] for f in found)
                inside[i] = top + log(sum(exp(f[2] - top) for f in found))
            if n < LONG_WORD:
                arcs = [arcs[i] for i in range(n)]
                size = sum(map(len, arcs))
        self.remember(size)
        self.words[word] = Word(arcs)
        return self.words[word]

    def remember(self, size: int) -> None:
        self._held += size
        if self._held > REMEMBERED:
            self.words.clear()
            self._held = size

    def held(self, text: str) -> str:
        """The text as its lattice has it. The sign that stands for a blank in the
        vocabulary is spelled by its bytes, so that it stays itself."""
        return BLANK + text.replace(BLANK, STAND_IN).replace(" ", BLANK)

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(self.bytes_of[np.asarray(ids, np.int64)].tolist()).decode()[1:]


def load(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def below(location: float, top: float, random: Random) -> float:
    """A Gumbel variable at ``location``, given that it is under ``top``."""
    return location - log(exp(location - top) - log(1 - random.random() or 1e-300))


def sample(pieces: Pieces, text: str, k: int, random: Random) -> list[tuple[list[int], float, float, float]]:
    """Up to ``k`` distinct segmentations (ids, log probability, perturbed, inclusion and
    its logarithm), best perturbed first."""
    held = pieces.held(text)
    at_word = pieces.word.match

    def word_at(start: int) -> tuple[Word, int]:
        found = at_word(held, start)
        return pieces.lattice(found[0]), found.end()

    # a set: its best perturbed score, a number, the path before, the log probability of
    # that, where its word starts, its place there, and the arcs that it may go on by
    best = -log(-log(1 - random.random() or 1e-300) or 1e-300)
    waiting: list[tuple] = [(-best, 0, None, 0.0, 0, 0, word_at(0)[0].arcs[0])]
    made = 1
    out: list[tuple] = []
    while waiting and len(out) < k:
        top, _, path, score, start, at, arcs = waiting.pop(0)
        top = -top
        room = k - len(out)         # those still to return, and the first one that isn't
        del waiting[room:]
        word, end = word_at(start)
        while True:
            if len(arcs) == 1:
                arc = arcs[0]
            else:
                r = random.random() * sum(a[2] for a in arcs)
                for arc in arcs:
                    r -= arc[2]
                    if r < 0:
                        break
                mass = sum(a[2] for a in arcs if a is not arc)
                if mass > 0:
                    g = below(score + log(mass), top, random)
                    if len(waiting) < room or -g < waiting[-1][0]:
                        insort(waiting, (-g, made, path, score, start, at, [a for a in arcs if a is not arc]))
                        made += 1
                        del waiting[room:]
            path, score, at = (path, arc[1]), score + log(arc[2]), arc[0]
            if at == len(word.arcs):
                start, at = end, 0
                if start == len(held):
                    break
                word, end = word_at(start)
            if len(waiting) == room and score < -waiting[-1][0] - UNDER:
                break
            arcs = word.arcs[at]
        parts = []
        while path:
            path, part = path
            parts.append(part)
        ids = [i for part in reversed(parts) for i in part]
        if start < len(held):
            score += word.draw(at, ids, random) + draw_words(pieces, held, end, ids, random)
        out.append((ids, score, top))
    bound = -waiting[0][0] if waiting else None
    found = []
    for ids, s, g in out:
        chance = 1.0 if bound is None else -expm1(-exp(min(s - bound, 50.0)))
        # far under the bound, 1 - exp(-x) is x
        found.append((ids, s, g, chance, log(chance) if chance > 1e-200 else s - bound))
    return found


def draw_words(pieces: Pieces, held: str, start: int, ids: list[int], random: Random) -> float:
    """Draw segmentations of the words from ``start`` on into ``ids``; their log probability.
    What is remembered of words met before never changes which random numbers are used, so
    a key and a text draw the same on any task."""
    score, words = 0.0, pieces.words
    for found in pieces.word.finditer(held, start):
        word = words.get(found[0]) or pieces.lattice(found[0])
        score += word.draw(0, ids, random)
    return score


def together(pieces: Pieces, k: int, seed: int, batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple]:
    """The rows of ``sample_segmentations``, for texts of ``TOGETHER`` signs at a time."""
    rows, size = [], 0
    for batch in batches:
        texts = batch.column(n_keys)
        for n, key in enumerate(zip(*(c.to_pylist() for c in batch.columns[:n_keys]))):
            rows.append((key, texts[n].as_py()))
            size += len(rows[-1][1] or "")
            if size > TOGETHER or len(rows) == MOST_TEXTS:
                yield from drawn(pieces, k, seed, rows)
                rows, size = [], 0
    yield from drawn(pieces, k, seed, rows)


def drawn(pieces: Pieces, k: int, seed: int, rows: list[tuple]) -> Iterator[tuple]:
    seeds = [xxhash.xxh3_64_intdigest(":".join("null" if x is None else str(x) for x in (seed, *key))) for key, _ in rows]
    many = [n for n, (_, text) in enumerate(rows) if text and len(text) < LONG_TEXT]
    batch = lockstep.draw(pieces.tables, [pieces.word.findall(pieces.held(rows[n][1])) for n in many], [seeds[n] for n in many], k, UNDER)
    at = {n: d for d, n in enumerate(many) if not batch.alone[d]}
    for n, (key, text) in enumerate(rows):
        if not text:
            yield *key, 1, [], 0.0, 0.0, 1.0, 0.0, ""
            continue
        found = batch.scored(at[n]) if n in at else sample(pieces, text, k, Random(seeds[n]))
        for rank, (ids, *scores) in enumerate(found, 1):
            yield *key, rank, ids, *scores, pieces.decode(ids)


def sample_segmentations(table: DataFrame, keys: list[str], vocabulary: str, k: int = 4, seed: int = 7) -> DataFrame:
    """(*keys, rank, ids, log_prob, perturbed, inclusion, log_inclusion, decoded) for each text; the
    keys are long numbers; ``decoded`` is read back from the ids."""
    common.ship(table.sparkSession)
    schema = pa.schema([*((c, pa.int64()) for c in keys), ("rank", pa.int32()), ("ids", pa.list_(pa.int32())),
                        ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("log_inclusion", pa.float64()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(vocabulary)
        held, size = [], 0
        for row in together(pieces, k, seed, batches, len(keys)):
            held.append(row)
            size += len(row[len(keys) + 1])
            if size > OUT_IDS or len(held) == 1024:
                yield from batched(iter(held), schema)
                held, size = [], 0
        yield from batched(iter(held), schema)

    return table.select(*keys, "text").mapInArrow(
        run, ", ".join(f"{c} long" for c in keys) + ", rank int, ids array<int>, log_prob double, perturbed double, "
                                                    "inclusion double, log_inclusion double, decoded string")
