"""Many texts' segmentations drawn together, each by exactly the steps of ``sampling.sample``.

A step takes every text of a batch one arc further, as arrays. Words' lattices are held as
tables of the places with several arcs ("nodes"); pieces that are the only way on go with
the arc, or the word, before them. Each text has its own stream of random numbers, the one
that ``random.Random`` draws for its seed, used in the same order: the results are those of
``sampling.sample``, bit by bit, whatever texts are drawn together.
"""

from __future__ import annotations

from bisect import insort
from itertools import chain
from math import exp, expm1, inf, log
from random import Random

import numpy as np

WIDE = 8                  # thresholds in a row of a node's table; a node has one arc more at most
MOST_ARCS = 1_500_000     # arcs of remembered words; a batch's own words may exceed it
BLOCK = 128               # steps between two looks at the random streams
FEW, FEW_SETS = 40, 64    # texts under which the rest is drawn, or split, one by one
CHUNK = 20_000            # words whose lattices are made at once
CLOSE = 1e-6              # more than the rounding of approximate scores
CODES = 1 << 21           # more than any sign
END = CODES - 1           # after a word


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type, *shape: int):
        self.held, self.n = np.empty((1024, *shape), kind), 0

    def add(self, more: np.ndarray) -> None:
        end = self.n + len(more)
        if end > len(self.held):
            held = np.empty((max(end, len(self.held) * 3 // 2), *self.held.shape[1:]), self.held.dtype)
            held[:self.n] = self.held[:self.n]
            self.held = held
        self.held[self.n:end] = more
        self.n = end


class Stream:
    """The random numbers of ``random.Random(seed)``, many at once."""

    __slots__ = ("source", "held", "at")

    def __init__(self, seed: int):
        if seed >> 32:
            self.source = np.random.RandomState(np.array([seed & 0xFFFFFFFF, seed >> 32], np.uint32))
        else:       # numpy seeds otherwise by one word
            self.source = np.random.RandomState()
            state = Random(seed).getstate()[1]
            self.source.set_state(("MT19937", np.array(state[:-1], np.uint32), state[-1]))
        self.held, self.at = self.source.random_sample(2 * BLOCK), 0

    def ahead(self, n: int) -> np.ndarray:
        if self.at + n > len(self.held):
            self.held = np.concatenate([self.held[self.at:], self.source.random_sample(max(n, 2 * BLOCK))])
            self.at = 0
        return self.held[self.at:self.at + n]

    def random(self) -> float:
        value = float(self.ahead(1)[0])
        self.at += 1
        return value


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each span, one span after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Trie:
    """The pieces as a table of (state, sign) -> state, by open addressing."""

    def __init__(self, pieces: dict):
        states, of, held = {}, {"": 0}, [(-1, 0.0)]
        for text, (ids, _, chance) in pieces.items():
            for n in range(1, len(text) + 1):
                if text[:n] not in of:
                    of[text[:n]] = len(held)
                    states[of[text[:n - 1]] * CODES + ord(text[n - 1])] = len(held)
                    held.append((-1, 0.0))
            held[of[text]] = (ids[0], chance)
        self.ids = np.array([x[0] for x in held], np.int32)
        self.chances = np.array([x[1] for x in held])
        self.shift = np.uint64(64 - max(12, (4 * len(states)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.to = np.full(size + 256, -1, np.int64), np.full(size + 256, -1, np.int32)
        for key, to in states.items():
            at = int(self.slots(np.array([key]))[0])
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.to[at] = key, to

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, states: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none."""
        keys = states * CODES + signs
        at = self.slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.to[at], -1)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            at[todo] += 1
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.to[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out


class Tables:
    """The lattices of the words met so far."""

    def __init__(self, pieces, short_word: int, least: float, long_word: int):
        self.pieces, self.short_word, self.least, self.long_word = pieces, short_word, least, long_word
        self.trie = Trie(pieces.pieces)
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.first, self.rows = Grown(np.int32), Grown(np.float64, WIDE)
        # of arcs: the threshold, chance, its log, the next node or -1, whether its own piece ends the word
        self.over, self.chance, self.log, self.next, self.exact = Grown(np.float64), Grown(np.float64), Grown(np.float64), Grown(np.int32), Grown(bool)
        self.ids, self.at, self.size = Grown(np.int32), Grown(np.int64), Grown(np.int32)       # of arcs
        self.root, self.word_at, self.word_size = Grown(np.int32), Grown(np.int64), Grown(np.int32)     # -1: one way; -2: not held

    def add(self, words: list[str]) -> None:
        new = sorted(words, key=len)
        for k in range(0, len(new), CHUNK):
            part = new[k:k + CHUNK]
            short = [w for w in part if len(w) < self.short_word]
            slow = [w for w in part if len(w) >= self.short_word]
            slow += self.many(short) if short else []
            if slow:
                self.singly(slow)

    def name(self, words: list[str], roots, at, size) -> None:
        n = len(self.words)
        self.words.update(zip(words, range(n, n + len(words))))
        self.root.add(roots)
        self.word_at.add(at)
        self.word_size.add(size)

    def singly(self, words: list[str]) -> None:
        """Words' lattices, arc by arc."""
        held, starts, ends, places, found, total = [], [], [], [], [], 0
        for word in words:
            arcs = self.pieces.lattice(word).arcs if len(word) < self.long_word else None
            if arcs is None or any(len(a) > WIDE + 1 or min(x[2] for x in a) <= 0 for a in arcs):
                self.name([word], [-2], [0], [0])
                continue
            held.append(word)
            starts.append(total)
            for i, a in enumerate(arcs, total):
                places += [i] * len(a)
                found += [(total + to, *x) for to, *x in a]
            ends.append(total + len(word))
            total += len(word) + 1
        if held:
            flat = np.fromiter(chain.from_iterable(f[1] for f in found), np.int32)
            self.build(held, np.array(starts), np.array(ends), np.array(places), np.array([f[0] for f in found]),
                       np.array([f[2] for f in found]), flat, np.array([len(f[1]) for f in found]), total)

    def many(self, words: list[str]) -> list[str]:
        """Short words' lattices by plain products; returns those that have none so."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        signs = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        signs[ends] = END
        total, longest = len(signs), min(self.pieces.longest, int(sizes.max()))
        # a column for each length of a piece, and the last one for a sign spelled by its bytes
        ids, chances = np.full((longest + 1, total), -1, np.int32), np.zeros((longest + 1, total))
        at = np.flatnonzero(signs != END)
        states = np.zeros(len(at), np.int64)
        for k in range(longest):
            states = self.trie.step(states, signs[at + k])
            alive = states >= 0
            at, states = at[alive], states[alive].astype(np.int64)
            if not len(at):
                break
            ids[k, at], chances[k, at] = self.trie.ids[states], self.trie.chances[states]
        bare = np.flatnonzero((ids[0] < 0) & (signs != END))
        kinds, kind = np.unique(signs[bare], return_inverse=True)
        spelled = [self.pieces.spelling(chr(c)) for c in kinds.tolist()]
        ids[longest, bare] = kind
        chances[longest, bare] = np.array([exp(self.pieces.byte_score * len(x)) for x in spelled])[kind] if spelled else 0
        inside = np.zeros(total)
        inside[ends] = 1.0
        for d in range(1, int(sizes.max()) + 1):
            p = ends[np.searchsorted(sizes, d):] - d       # the words are sorted by size
            summed = np.zeros(len(p))
            for k in [*range(min(d, longest)), longest]:
                chances[k, p] = x = chances[k, p] * inside[p + (k + 1 if k < longest else 1)]
                summed += x
            inside[p] = summed
        has = ids >= 0
        bad = (inside < self.least) | (has.sum(0) > WIDE + 1) | (has & ~(chances > 0)).any(0)
        bad[ends] = False
        ok = np.add.reduceat(bad, starts) == 0
        slow = [w for w, good in zip(words, ok.tolist()) if not good]
        if slow:
            has[:, ~np.repeat(ok, sizes + 1)] = False
        place, k = np.nonzero(has.T)
        by_bytes = k == longest
        own_size, own = np.ones(len(place), np.int64), ids[k, place]
        if by_bytes.any():
            own_size[by_bytes] = np.array([len(x) for x in spelled])[own[by_bytes]]
            flat = np.empty(int(own_size.sum()), np.int32)
            at = np.cumsum(own_size) - own_size
            flat[at[~by_bytes]] = own[~by_bytes]
            flat[spans(at[by_bytes], own_size[by_bytes])] = np.fromiter(chain.from_iterable(spelled[x] for x in own[by_bytes].tolist()), np.int32)
            own = flat
        self.build([w for w, good in zip(words, ok.tolist()) if good], starts[ok], ends[ok], place, place + np.where(by_bytes, 1, k + 1),
                   chances[k, place] / inside[place], own, own_size, total)
        return slow

    def build(self, words, starts, ends, place, to, chance, own, own_size, total) -> None:
        """Add lattices whose arcs go from ``place`` to ``to`` with pieces ``own``."""
        degree = np.bincount(place, minlength=total)
        own_at = np.cumsum(own_size) - own_size
        first = np.cumsum(degree) - degree
        one, node = degree == 1, degree > 1
        # from each place, the next one that isn't left by one arc alone, and the pieces till there
        onward = np.arange(total)
        only = np.flatnonzero(one)
        onward[only] = to[first[only]]
        length = np.zeros(total, np.int64)
        length[only] = own_size[first[only]]
        jump = onward.copy()
        while True:
            far = jump[jump]
            if np.array_equal(far, jump):
                break
            jump = far
        sums = np.zeros(total, np.int64)
        walk = only
        cursor = only.copy()
        while len(walk):
            sums[walk] += length[cursor]
            cursor = onward[cursor]
            more = one[cursor]
            walk, cursor = walk[more], cursor[more]
        number = np.cumsum(node) - 1 + self.first.n
        target = np.where(node, number, -1)
        base = self.over.n
        kept = node[place]
        arc_first = np.cumsum(np.where(node, degree, 0)) - np.where(node, degree, 0)
        nodes = np.flatnonzero(node)
        a_to, a_chance = to[kept], chance[kept]
        self.first.add(arc_first[nodes] + base)
        # thresholds: sums of the chances up to an arc, none for the last
        column = np.arange(len(a_to)) - arc_first[place[kept]]
        row = number[place[kept]] - self.first.n + len(nodes)
        table = np.zeros((len(nodes), WIDE + 1))
        table[row, column] = a_chance
        for k in range(1, WIDE + 1):
            table[:, k] += table[:, k - 1]
        last = degree[nodes] - 1
        table[np.arange(WIDE + 1) >= last[:, None]] = inf
        self.rows.add(table[:, :WIDE])
        self.over.add(table[row, column])
        self.chance.add(a_chance)
        self.log.add(np.fromiter(map(log, a_chance.tolist()), np.float64, len(a_chance)))
        self.next.add(target[jump[a_to]])
        is_end = np.zeros(total, bool)
        is_end[ends] = True
        self.exact.add(is_end[a_to])
        # the pieces: an arc's own, then those of the only ways on; for words, the latter alone
        arcs = np.flatnonzero(kept)
        lead = np.concatenate([own_size[arcs], np.zeros(len(starts), np.int64)])
        lead_at = np.concatenate([own_at[arcs], np.zeros(len(starts), np.int64)])
        follow = np.concatenate([a_to, starts])
        size = lead + sums[follow]
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int32)
        out[spans(at, lead)] = own[spans(lead_at, lead)]
        fill, cursor = at + lead, follow
        going = np.flatnonzero(one[cursor])
        while len(going):
            arc = first[cursor[going]]
            n = own_size[arc]
            out[spans(fill[going], n)] = own[spans(own_at[arc], n)]
            fill[going] += n
            cursor[going] = onward[cursor[going]]
            going = going[one[cursor[going]]]
        at += self.ids.n
        self.ids.add(out)
        self.at.add(at[:len(arcs)])
        self.size.add(size[:len(arcs)])
        self.name(words, target[jump[starts]], at[len(arcs):], size[len(arcs):])


def draw(tables: Tables, texts: list[list[str]], seeds: list[int], k: int, under: float) -> "Batch":
    """The segmentations of texts given as their words; ``alone`` tells which texts have none
    here, as they have a word whose lattice isn't held."""
    known = tables.words
    new = set(chain.from_iterable(texts)).difference(known)
    if new:
        if tables.over.n > MOST_ARCS:
            tables.clear()
            known, new = tables.words, set(chain.from_iterable(texts))
        tables.add(list(new))
    every = [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in texts]
    root_of = tables.root.held
    alone = [bool((root_of[w] == -2).any()) for w in every]
    return Batch(tables, every, alone, seeds, k, under)


class Batch:
    def __init__(self, tables: Tables, every: list[np.ndarray], alone: list[bool], seeds: list[int], k: int, under: float):
        self.t, self.every, self.alone, self.k, self.under = tables, every, alone, k, under
        n = len(every)
        choice = [not alone[d] and bool((tables.root.held[every[d]] >= 0).any()) for d in range(n)]
        self.live = [d for d in range(n) if choice[d]]
        self.streams = [Stream(seeds[d]) if choice[d] else None for d in range(n)]
        # the texts' words with nodes, one after the other, each text ended by -1
        seq, number, self.begin, at = [], [], np.zeros(n, np.int64), 0
        for d in self.live:
            roots = tables.root.held[every[d]]
            with_nodes = np.flatnonzero(roots >= 0)
            self.begin[d] = at
            at += len(with_nodes) + 1
            seq += [roots[with_nodes], [-1]]
            number += [with_nodes, [len(roots) + 1]]
        self.seq = np.concatenate(seq).astype(np.int32) if seq else np.zeros(0, np.int32)
        self.number = np.concatenate(number) if number else np.zeros(0, np.int64)
        self.out: list[list[tuple]] = [[] for _ in range(n)]
        self.bound: list[float | None] = [None] * n
        for d in range(n):
            if not alone[d] and not choice[d]:      # one way from end to end
                self.out[d] = [(np.zeros(0, np.int32), 0.0, -log(-log(1 - Random(seeds[d]).random() or 1e-300) or 1e-300))]
        self.run()

    def run(self) -> None:
        k = self.k
        n = len(self.every)
        waiting: list[list[tuple]] = [[] for _ in range(n)]
        made = [1] * n
        for d in self.live:
            best = -log(-log(1 - self.streams[d].random() or 1e-300) or 1e-300)
            node = int(self.seq[self.begin[d]])
            waiting[d] = [(-best, 0, np.zeros(0, np.int32), 0.0, int(self.begin[d]), node, self.arcs(node))]
        going = self.live
        for rank in range(k):
            going = [d for d in going if waiting[d]]
            if not going:
                break
            self.round(going, waiting, made, k - rank)
        for d in self.live:
            self.bound[d] = -waiting[d][0][0] if waiting[d] else None

    def arcs(self, node: int) -> list[int]:
        start = int(self.t.first.held[node])
        return list(range(start, start + int(np.isfinite(self.t.rows.held[node]).sum()) + 1))

    def split(self, d: int, arcs: list[int], arc: int, score: float, top: float, u: float | None, waiting, made, room, path, at, node) -> None:
        """Put the set of what doesn't go on by ``arc`` among those waiting."""
        rest = [a for a in arcs if a != arc]
        chance = self.t.chance.held
        mass = sum(float(chance[a]) for a in rest)
        if mass > 0:
            location = score + log(mass)
            u = self.streams[d].random() if u is None else u
            g = location - log(exp(location - top) - log(1 - u or 1e-300))
            if len(waiting[d]) < room or -g < waiting[d][-1][0]:
                insort(waiting[d], (-g, made[d], path, score, at, node, rest))
                made[d] += 1
                del waiting[d][room:]

    def round(self, going: list[int], waiting, made, room: int) -> None:
        """The next segmentation of each of the texts: by splitting sets, then by plain draws."""
        t = self.t
        chance, logs, nexts, seq, firsts, rows = t.chance.held, t.log.held, t.next.held, self.seq, t.first.held, t.rows.held
        firsts_of, over_of, nexts_of, seq_of, chances_of, logs_of = map(memoryview, (firsts, t.over.held, nexts, seq, chance, logs))
        before, tops = {}, {}
        m = len(going)
        texts = np.array(going)
        node, at, score, top, last = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m), np.zeros(m), np.zeros(m, np.int64)
        for x, d in enumerate(going):
            best, _, path, s, a, nd, arcs = waiting[d].pop(0)
            best = -best
            del waiting[d][room:]
            arc = arcs[0]
            if len(arcs) > 1:
                r = self.streams[d].random() * sum(float(chance[c]) for c in arcs)
                for arc in arcs:
                    r -= float(chance[arc])
                    if r < 0:
                        break
                self.split(d, arcs, arc, s, best, None, waiting, made, room, path, a, nd)
            before[d], tops[d] = np.append(path, np.int32(arc)), best
            s += float(logs[arc])
            nd = int(nexts[arc])
            if nd < 0:
                a += 1
                nd = int(seq[a])
            node[x], at[x], score[x], top[x], last[x] = nd, a, s, best, arc
        full = np.array([-waiting[d][-1][0] if len(waiting[d]) == room else -inf for d in going])
        # sets are split until the text ends, or the rest can't come before those waiting
        lanes = np.arange(m)
        ended_score, ended_last, taken = score.copy(), last.copy(), np.zeros(m, np.int64)
        ended_node, ended_at = node.copy(), at.copy()
        trace: list[tuple[np.ndarray, np.ndarray]] = []
        step = 0
        stay = (node >= 0) & ~(score < full - self.under)
        lanes, node, at, score, top, full, last = (v[stay] for v in (lanes, node, at, score, top, full, last))
        while len(lanes) >= FEW_SETS:
            block = np.stack([self.streams[d].ahead(2 * BLOCK) for d in texts[lanes].tolist()])
            held, column = lanes, np.arange(len(lanes))
            used = np.full(len(lanes), BLOCK)
            for b in range(BLOCK):
                u, v = block[column, 2 * b], block[column, 2 * b + 1]
                arc = firsts[node] + np.bitwise_count((u[:, None] >= rows.take(node, 0)).view(np.uint64).ravel())
                # not under the score of the set of what doesn't go on by the arc
                place = score + np.log(np.maximum(1 - chance[arc], 1e-12) * 1.001)
                g = place - np.log(np.exp(np.minimum(place - top, 700.0)) - np.log(1 - v) + 1e-300)
                for x in np.flatnonzero(~(g < full - CLOSE)).tolist():
                    d, nd = going[lanes[x]], int(node[x])
                    count = made[d]
                    self.split(d, self.arcs(nd), int(arc[x]), float(score[x]), float(top[x]), float(v[x]), waiting, made, room, (step,), int(at[x]), nd)
                    if made[d] > count and len(waiting[d]) == room:
                        full[x] = -waiting[d][-1][0]
                trace.append((lanes, arc))
                step += 1
                score = score + logs[arc]
                node = nexts[arc].astype(np.int64)
                over = node < 0
                at = at + over
                node = np.where(over, seq[at], node)
                leave = (node < 0) | (score < full - self.under)
                if leave.any():
                    gone = lanes[leave]
                    ended_score[gone], ended_last[gone], taken[gone], ended_node[gone], ended_at[gone] = score[leave], arc[leave], step, node[leave], at[leave]
                    used[column[leave]] = b + 1
                    stay = ~leave
                    lanes, node, at, score, top, full, column = (w[stay] for w in (lanes, node, at, score, top, full, column))
                    if not len(lanes):
                        break
            for x, n in zip(held.tolist(), used.tolist()):
                self.streams[going[x]].at += 2 * n
        taken[lanes] = step
        alone = {}
        for x, nd, a, s, best, least in zip(*(v.tolist() for v in (lanes, node, at, score, top, full))):
            d, stream, drawn = going[x], self.streams[going[x]], []
            while nd >= 0 and not s < least - self.under:
                u, v = stream.ahead(2).tolist()
                stream.at += 2
                start = arc = firsts_of[nd]
                while u >= over_of[arc]:
                    arc += 1
                end = arc + 1
                while over_of[end - 1] < inf:
                    end += 1
                others = chances_of[start:end].tolist()
                others.pop(arc - start)
                place = s + log(sum(others))
                if not place - log(exp(place - best) - log(1 - v or 1e-300)) < least - CLOSE:
                    self.split(d, list(range(start, end)), arc, s, best, v, waiting, made, room, (step + len(drawn),), a, nd)
                    if len(waiting[d]) == room:
                        least = -waiting[d][-1][0]
                drawn.append(arc)
                s += logs_of[arc]
                nd = nexts_of[arc]
                if nd < 0:
                    a += 1
                    nd = seq_of[a]
            alone[x] = np.array(drawn, np.int32)
            ended_score[x], ended_node[x], ended_at[x] = s, nd, a
            if drawn:
                ended_last[x] = drawn[-1]
        found, off = gathered(trace, taken)
        parts = [found[off[x]:off[x + 1]] if x not in alone else np.concatenate([found[off[x]:off[x + 1]], alone[x]]) for x in range(m)]
        for x, d in enumerate(going):
            for n, w in enumerate(waiting[d]):
                if isinstance(w[2], tuple):
                    waiting[d][n] = (*w[:2], np.concatenate([before[d], parts[x][:w[2][0]]]), *w[3:])
        # the rest, word by word
        trace, taken = [], np.zeros(m, np.int64)
        lanes = np.flatnonzero(ended_node >= 0)
        node, at = ended_node[lanes].astype(np.int64), ended_at[lanes]
        step, tail = 0, {}
        while len(lanes) >= FEW:
            block = np.ascontiguousarray(np.stack([self.streams[d].ahead(BLOCK) for d in texts[lanes].tolist()]).T)
            held, column = lanes, None
            used = np.full(len(lanes), BLOCK)
            for b in range(BLOCK):
                u = block[b] if column is None else block[b][column]
                arc = firsts[node] + np.bitwise_count((u[:, None] >= rows.take(node, 0)).view(np.uint64).ravel())
                trace.append((lanes, arc))
                step += 1
                node = nexts.take(arc)
                over = node < 0
                at = at + over
                node = np.where(over, seq.take(at), node)
                if node.min() < 0:
                    stay = node >= 0
                    column = np.arange(len(held)) if column is None else column
                    taken[lanes[~stay]] = step
                    used[column[~stay]] = b + 1
                    lanes, node, at, column = lanes[stay], node[stay], at[stay], column[stay]
                    if not len(lanes):
                        break
            for x, n in zip(held.tolist(), used.tolist()):
                self.streams[going[x]].at += n
        taken[lanes] = step
        for x, nd, a in zip(lanes.tolist(), node.tolist(), at.tolist()):
            stream, drawn = self.streams[going[x]], []
            while nd >= 0:
                n = 0
                for r in stream.ahead(BLOCK).tolist():
                    n += 1
                    arc = firsts_of[nd]
                    while r >= over_of[arc]:
                        arc += 1
                    drawn.append(arc)
                    nd = nexts_of[arc]
                    if nd < 0:
                        a += 1
                        nd = seq_of[a]
                        if nd < 0:
                            break
                stream.at += n
            tail[x] = np.array(drawn, np.int32)
        drawn, off = gathered(trace, taken)
        for x, d in enumerate(going):
            plain = drawn[off[x]:off[x] + taken[x]]
            if x in tail:
                plain = np.concatenate([plain, tail[x]])
            path = np.concatenate([before[d], parts[x], plain])
            total = float(ended_score[x])
            if ended_node[x] >= 0:
                a, arc = int(ended_at[x]), int(ended_last[x])
                # whether the word that comes first is summed by itself
                apart = nexts[arc] >= 0 or bool(t.exact.held[arc]) and self.number[a] == self.number[a - 1] + 1
                total += summed(logs[plain], nexts[plain] < 0, apart)
            self.out[d].append((path, total, tops[d]))

    def ids(self, d: int) -> list[tuple[np.ndarray, float, float]]:
        """(ids, log probability, perturbed) of a text's segmentations."""
        t, words, found = self.t, self.every[d], []
        number = self.number[self.begin[d]:]
        for path, total, top in self.out[d]:
            # what is spelled: each word's only way at its start, then its arcs
            ends = t.next.held[path] < 0
            of = number[np.cumsum(ends) - ends]
            spelled = np.empty(len(words) + len(path), np.int64)
            size = np.empty(len(spelled), np.int64)
            place = np.arange(len(path)) + of + 1
            mine = np.ones(len(spelled), bool)
            mine[place] = False
            spelled[place], size[place] = t.at.held[path], t.size.held[path]
            spelled[mine], size[mine] = t.word_at.held[words], t.word_size.held[words]
            found.append((t.ids.held[spans(spelled, size)], total, top))
        return found

    def scored(self, d: int) -> list[tuple]:
        bound, found = self.bound[d], []
        for ids, s, g in self.ids(d):
            chance = 1.0 if bound is None else -expm1(-exp(min(s - bound, 50.0)))
            found.append((ids, s, g, chance, log(chance) if chance > 1e-200 else s - bound))
        return found


def gathered(trace: list[tuple[np.ndarray, np.ndarray]], taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The arcs of each lane one after the other, and where each lane's begin."""
    off = np.concatenate([[0], np.cumsum(taken)])
    out = np.empty(int(off[-1]), np.int32)
    for step, (lanes, arcs) in enumerate(trace):
        out[off[lanes] + step] = arcs
    return out, off


def summed(logs: np.ndarray, ends: np.ndarray, apart: bool) -> float:
    """The words' sums, added one after the other; the first word's after the others', if ``apart``."""
    if not len(logs):
        return 0.0
    word = np.cumsum(ends) - ends
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    sizes = np.diff(np.append(starts, len(logs)))
    words = np.zeros(len(starts))
    for k in range(int(sizes.max())):
        has = sizes > k
        words[has] += logs[starts[has] + k]
    if not apart:
        return float(np.add.accumulate(words)[-1])
    return float(words[0]) + (float(np.add.accumulate(words[1:])[-1]) if len(words) > 1 else 0.0)
