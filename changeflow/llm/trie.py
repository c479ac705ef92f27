"""Prefix trie over conversations that are rebuilt from stored turns.

A conversation ``c`` is rebuilt as the first ``h`` turns of its family's base
``c - c % 5`` (``h`` is given per conversation), then its own turns after its first
``h``. No rebuilt text is ever made. A run of turns has the fingerprint
``sum(t_i * B^i)`` modulo four primes, ``t_i`` being taken from a turn's hash, and runs
compose as a monoid: (f, n) . (g, m) = (f + B^n g, n + m). Every prefix of a rebuilt
conversation is the base head's product, then the quotient of two products of its own
turns, moved by a power of ``B``: one multiplication and one addition per stored turn.

Equal (depth, fingerprint) make a node. That equal fingerprints mean equal turns is
checked, not assumed: each hash of a turn must stand for one role and text, and the
members of a node must refer to one stored turn and come from one parent, from which
equality of the whole prefixes follows by depth. If the check fails, all is done again
with other bases.

Sums over subtrees need no walk down the tree. A node's weight is put at its smallest
member's place; as deeper nodes hold subsets of the members, a subtree's sum is the sum
of its members' weights at that depth or below. These are suffix sums per conversation,
taken over fixed slices of the depth and then over the slices, as are all running sums
here, so a conversation that holds a third of all rows is spread over tasks.

Defined results: turns are ordered by turn (null first), then role and text, and
repeated rows all stay; a null role or text is empty; rows with a null conv_id are no
conversation; ``%`` keeps the sign, so -3 belongs to base 0; an empty table has no
node; other columns aren't read. The digest of the members that end at a node is one
stream by its nature: a task reads them in order, thousands to a row, and holds one row.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeflow.llm import common
from changeflow.llm.chat import rows_of
from changeflow.llm.packing import batched

#: fixed values: the largest primes below 2^31
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
FAMILY, MOST_HEAD = 5, 8
SLICE_BITS = 12                 # running sums go over slices of 4,096 turns
ENDS_BITS = 13                  # ids that end at a node are joined by 8,192
NODE = ("depth", "fa", "fb")
FS = tuple(f"f{i}" for i in range(len(PRIMES)))


def bases(seed: int) -> list[int]:
    """One base per prime, drawn from the seed."""
    return [int.from_bytes(hashlib.sha256(f"{seed}:{p}".encode()).digest()[:8], "big") % (p - 2 ** 21) + 2 ** 20 for p in PRIMES]


def power(base: int, prime: int, exponent: str) -> str:
    """SQL for ``base ^ exponent mod prime``, 0 <= exponent < 2^40: a factor per four bits."""
    out = "1L"
    for k in range(10):
        table = ", ".join(f"{pow(base, d << 4 * k, prime)}L" for d in range(16))
        out = f"{out} * element_at(array({table}), cast((shiftright({exponent}, {4 * k}) & 15) + 1 as int)) % {prime}"
    return out


def coefficient(i: int) -> str:
    """A turn's coefficient for prime ``i``: 31 bits of its hash, never 0."""
    key, shift = ("k1", "k2")[i // 2], (0, 32)[i % 2]
    return f"((shiftrightunsigned({key}, {shift}) & 2147483647) % {PRIMES[i] - 1} + 1)"


def running_sums(df: DataFrame, key: str, slice_col: str, order: Sequence[Column], along: Column, values: Sequence[str]) -> DataFrame:
    """Each of ``values`` becomes its sum over the rows of ``key`` up to and with this one:
    by ``order`` within a slice, on top of the totals of the slices before (``along``)."""
    inside = Window.partitionBy(key, slice_col).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(key, slice_col).agg(*[F.sum(v).alias(v) for v in values]).select(
        key, slice_col, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_{v}") for v in values])
    summed = df.withColumns({v: F.sum(v).over(inside) for v in values}).join(totals, [key, slice_col])
    return summed.withColumns({v: F.col(v) + F.col(f"_{v}") for v in values}).drop(*[f"_{v}" for v in values])


def stored_turns(conversations: DataFrame, seed: int) -> DataFrame:
    """(conv_id, k1, k2, n_bytes, at): every turn's hash and length; ``at`` grows with
    the order of turns and has the number of its range in the upper bits."""
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.expr("coalesce(role, '') as role"),
        F.expr("coalesce(text, '') as text"), F.monotonically_increasing_id().alias("tie"))
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("tie")]
    dealt = turns.repartitionByRange(*by).sortWithinPartitions(*by)
    return common.saved(dealt.select("conv_id", *turn_hash(seed), F.octet_length("text").cast("long").alias("n_bytes"),
                                     F.monotonically_increasing_id().alias("at")), "turns")


def turn_hash(seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * seed + i), "role", "text").alias(f"k{i + 1}") for i in range(2)]


def mixed_hashes(conversations: DataFrame, seed: int) -> DataFrame:
    """Hashes of turns that stand for several roles or texts."""
    said = F.struct("role", "text")
    turns = conversations.filter("conv_id is not null").select(F.expr("coalesce(role, '') as role"), F.expr("coalesce(text, '') as text"))
    return (turns.select("*", *turn_hash(seed)).groupBy("k1", "k2").agg(F.min(said).alias("a"), F.max(said).alias("b"))
            .filter("a <> b").select("k1", "k2"))


def own_products(turns: DataFrame, seed: int) -> DataFrame:
    """(conv_id, pos, k1, k2, n_bytes, f0..f3): the fingerprint of each conversation's own
    first ``pos`` turns."""
    part = F.shiftrightunsigned("at", 33)
    pieces = turns.groupBy("conv_id", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1 - F.col("first")).alias("shift"))
    placed = (turns.withColumn("part", part).join(pieces, ["conv_id", "part"])
              .withColumn("pos", F.col("at") + F.col("shift")).withColumn("slice", F.shiftright("pos", SLICE_BITS)))
    terms = {f: F.expr(f"{coefficient(i)} * ({power(b, PRIMES[i], 'pos')}) % {PRIMES[i]}")
             for i, (f, b) in enumerate(zip(FS, bases(seed)))}
    summed = running_sums(placed.select("conv_id", "pos", "slice", "k1", "k2", "n_bytes", *[c.alias(f) for f, c in terms.items()]),
                          "conv_id", "slice", [F.col("pos").asc()], F.col("slice").asc(), FS)
    return common.saved(summed.select("conv_id", "pos", "k1", "k2", "n_bytes", *[(F.col(f) % p).alias(f) for f, p in zip(FS, PRIMES)]),
                        "products")


def head_length() -> Column:
    """How many turns a conversation takes from its base: crc32 of its id, modulo 9."""
    return F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_HEAD + 1)


def joints(own: DataFrame, seed: int) -> DataFrame:
    """Per conversation, how its rebuilt form is composed: ``head`` (the base's turns it
    takes), ``skip`` (its own first turns left out), ``n_turns``, and per prime the affine
    map (``m``, ``g``) that takes an own product to the rebuilt one."""
    # at most eight elements per conversation
    turn = F.when(F.col("pos") <= MOST_HEAD, F.struct("pos", "k1", "k2", "n_bytes", *FS))
    convs = own.groupBy("conv_id").agg(F.max("pos").alias("n"), F.sort_array(F.collect_list(turn)).alias("first"))
    convs = common.saved(convs.select("*", head_length().alias("skip"), F.expr(f"conv_id - conv_id % {FAMILY} as base")), "heads")
    base = convs.select(F.col("conv_id").alias("base"), F.col("first").alias("base_first"))
    c = convs.join(base, "base", "left").withColumn("head", F.expr("slice(coalesce(base_first, array()), 1, cast(skip as int))"))
    c = c.withColumn("n_head", F.size("head").cast("long"))
    maps = {}
    for i, (f, b, p) in enumerate(zip(FS, bases(seed), PRIMES)):
        inverse = ", ".join(f"{pow(b, -k, p)}L" for k in range(MOST_HEAD + 1))
        maps[f"m{i}"] = F.expr(f"element_at(array({inverse}), cast(skip - n_head + 1 as int))")
        maps[f"g{i}"] = F.expr(f"pmod(if(n_head = 0, 0L, element_at(head, cast(greatest(n_head, 1) as int)).{f})"
                               f" - if(skip = 0 or n < skip, 0L, element_at(first, cast(greatest(skip, 1) as int)).{f}) * m{i} % {p}, {p})")
    c = c.withColumns({k: v for k, v in maps.items() if k[0] == "m"})
    c = c.withColumns({k: v for k, v in maps.items() if k[0] == "g"})
    return c.select("conv_id", "base", "skip", "n_head", F.expr("n_head + greatest(n - skip, 0) as n_turns"), "head", *maps)


def prefixes(own: DataFrame, joined: DataFrame, seed: int) -> DataFrame:
    """A row per prefix of each rebuilt conversation, the empty one included: depth, packed
    fingerprint (fa, fb), its parent's (pa, pb), and the last turn's hash and place."""
    row = ["conv_id", "depth", "k1", "k2", "n_bytes", *FS, "turn_conv_id", "turn_pos", "n_turns"]
    root = joined.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in row[1:-3]],
                         *[F.lit(None).cast("long").alias(c) for c in row[-3:-1]], "n_turns")
    head = joined.select("conv_id", "base", "n_turns", F.explode("head").alias("t")).select(
        "conv_id", F.col("t.pos").alias("depth"), *[f"t.{c}" for c in row[2:-3]], F.col("base").alias("turn_conv_id"),
        F.col("t.pos").alias("turn_pos"), "n_turns")
    maps = [f"{x}{i}" for i in range(len(PRIMES)) for x in "mg"]
    tail = own.join(joined.select("conv_id", "skip", "n_head", "n_turns", *maps), "conv_id").filter("pos > skip")
    tail = tail.select("conv_id", F.expr("pos - skip + n_head as depth"), "k1", "k2", "n_bytes",
                       *[F.expr(f"({f} * m{i} + g{i}) % {p} as {f}") for i, (f, p) in enumerate(zip(FS, PRIMES))],
                       F.col("conv_id").alias("turn_conv_id"), F.col("pos").alias("turn_pos"), "n_turns")
    rows = root.unionByName(head).unionByName(tail)
    parent = [F.expr(f"if(depth = 0, 0L, pmod(f{i} - {coefficient(i)} * ({power(b, p, 'depth')}) % {p}, {p}))").alias(f"p{i}")
              for i, (b, p) in enumerate(zip(bases(seed), PRIMES))]
    rows = rows.select("*", *parent)
    packed = [F.expr(f"shiftleft({a}0, 32) | {a}1 as {b}a") for a, b in (("f", "f"), ("p", "p"))]
    packed += [F.expr(f"shiftleft({a}2, 32) | {a}3 as {b}b") for a, b in (("f", "f"), ("p", "p"))]
    return common.saved(rows.select("conv_id", "depth", *packed, "k1", "k2", "n_bytes", "turn_conv_id", "turn_pos",
                                    (F.col("depth") == F.col("n_turns")).alias("ends")), "prefixes")


def grouped(rows: DataFrame) -> DataFrame:
    """One row per node; ``sound`` tells that its members share the last turn and parent."""
    checked = ("pa", "pb", "k1", "k2")
    low = F.min(F.struct("conv_id", "turn_conv_id", "turn_pos"))
    nodes = rows.groupBy(*NODE).agg(low.alias("low"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
                                    *[F.min(c).alias(c) for c in checked], *[F.max(c).alias(f"max_{c}") for c in checked])
    return common.saved(nodes.select(*NODE, "low.*", "n_convs", "n_bytes", "pa", "pb",
                                     F.expr(" and ".join(f"{c} = max_{c}" for c in checked)).alias("sound")), "nodes")


def with_children(nodes: DataFrame) -> DataFrame:
    children = (nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("fa"), F.col("pb").alias("fb"))
                .agg(F.count("*").alias("n_children")))
    return nodes.join(children, list(NODE), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def subtree_sums(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(depth, fa, fb, n_leaves, saved_tokens) of each node, summed over its subtree."""
    sums = ("n_leaves", "saved_tokens")
    weight = nodes.select("conv_id", "depth", F.lit(None).cast("long").alias("fa"), F.lit(None).cast("long").alias("fb"),
                          F.expr("cast(n_children = 0 as long) as n_leaves"), F.expr("(n_convs - 1) * n_bytes as saved_tokens"))
    both = rows.select("conv_id", *NODE, *[F.lit(0).cast("long").alias(c) for c in sums]).unionByName(weight)
    both = running_sums(both.withColumn("slice", F.shiftright("depth", SLICE_BITS)), "conv_id", "slice",
                        [F.col("depth").desc()], F.col("slice").desc(), sums)
    return both.filter("fa is not null").groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in sums])


def ends_digests(rows: DataFrame) -> DataFrame:
    """(depth, fa, fb, ends_sha256) of the nodes at which conversations end."""
    common.ship(rows.sparkSession)
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))
    joined = rows.filter("ends").groupBy(*NODE, F.shiftright("conv_id", ENDS_BITS).alias("slice")).agg(F.array_join(ids, ",").alias("ids"))
    schema = pa.schema([*((c, pa.int64()) for c in NODE), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[tuple]:
            for node, rows in itertools.groupby(rows_of(batches), key=lambda r: r[:3]):
                digest, comma = hashlib.sha256(), ""
                for *_, ids in rows:
                    digest.update(f"{comma}{ids}".encode())
                    comma = ","
                yield *node, digest.hexdigest()

        yield from batched(digests(), schema)

    dealt = joined.repartition(*NODE).sortWithinPartitions(*NODE, "slice").select(*NODE, "ids")
    return dealt.mapInArrow(run, "depth long, fa long, fb long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, tries: int = 4) -> DataFrame:
    """One row per node: smallest member, depth, the parent's smallest member, counts,
    subtree sums, the digest of the members that end there, and the stored turn that is
    its last (``turn_conv_id``, ``turn_pos``)."""
    for seed in range(tries):
        own = own_products(stored_turns(conversations, seed), seed)
        rows = prefixes(own, joints(own, seed), seed)
        nodes = grouped(rows)
        if nodes.filter("not sound").isEmpty() and mixed_hashes(conversations, seed).isEmpty():
            break
    else:
        raise RuntimeError(f"fingerprints of different prefixes met with each of {tries} bases")
    nodes = with_children(nodes)
    parents = nodes.select(F.col("depth").alias("_depth"), F.col("fa").alias("_fa"), F.col("fb").alias("_fb"),
                           F.col("conv_id").alias("parent_conv_id"))
    above = (F.col("depth") - 1 == F.col("_depth")) & (F.col("pa") == F.col("_fa")) & (F.col("pb") == F.col("_fb"))
    found = nodes.join(parents, above, "left").drop("_depth", "_fa", "_fb")
    found = found.join(subtree_sums(rows, nodes), list(NODE)).join(ends_digests(rows), list(NODE), "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
                        "turn_conv_id", "turn_pos")
