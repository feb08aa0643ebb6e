"""Prefix trie of conversations, summed up over subtrees by the Euler-tour technique.

A turn's hash is tagged with its place, and a prefix is known by the exclusive or of its
turns' tagged hashes (two of 64 bits), so prefixes come from running sums that any piece
of a conversation can begin. Rows with equal prefixes form a node, named by its smallest
member and its depth. Each node has an enter and an exit arc; a node's enter arc leads to
its first child's (or its own exit), an exit arc to the next sibling's enter (or the
parent's exit). The tour is ranked as a linked list by contraction: each task
shortens the chains that lie within its range of arcs to one arc each, the short list is
contracted again, and ranks are then handed back level by level. Arcs carry weights (one,
leaf, saved characters), so a rank is a prefix sum at the arc's place, and a subtree's
total is the difference of its exit's and its enter's.

Order within a conversation and among siblings comes from range partitions whose borders
are mended by small tables of pieces, so a conversation, or a parent, that holds a third
of all rows is spread over tasks. The decimal ids of a node's ends are hashed in ascending
order: by SQL where they are at most `MANY`, else as a stream of joined stretches.

A null role or text is empty. Turns go by number, null first; equal numbers by role and text.
Repeated rows are turns of their own. Rows without a conv_id belong to no conversation.
Very long texts are hashed whole, conversations may have any length, an empty table has no
node. Extra columns of any name are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

BLOCK = 4096
MANY = 10_000
PIECE = 16_384
TASKS = 20_000
SHRINK = 0.7


def _ordered(rows: DataFrame, keys: list, order: list, name: str) -> DataFrame:
    """`rows` written in order, with `at` ascending over the whole table; its upper bits (`part`) tell the task."""
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*order)
    return written(sorted_rows.withColumn("at", F.monotonically_increasing_id()), name).withColumn("part", F.shiftright("at", 33))


def numbered(conversations: DataFrame) -> DataFrame:
    """Per turn: conv_id, pos (from 1), two hashes of (role, text) and the text's code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    tie = F.concat(role, F.lit("\0"), text)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), tie.alias("tie"), F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit(7), text, role).alias("k2"), F.length(text).cast("long").alias("chars"))
    keys = ["conv_id", "turn", F.substring("tie", 1, 64)]
    own = rows.repartitionByRange(*keys).sortWithinPartitions("conv_id", "turn", "tie")
    turns = written(own.select("conv_id", "k1", "k2", "chars", F.monotonically_increasing_id().alias("at")), "trie-turns").withColumn("part", F.shiftright("at", 33))
    pieces = turns.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = turns.join(pieces.withColumn("before", before), ["conv_id", "part"])
    return placed.select("conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"), "k1", "k2", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (c, total) and their turns (c, d, t1, t2, chars, total): the first h of c - c % 100, then the own ones after the first h; h is crc32(c) % 6."""
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    base = F.col("c") - F.col("c") % 100
    own = lengths.select(F.col("conv_id").alias("c"), "n").withColumns({"b": base, "h": F.crc32(F.col("c").cast("string")) % 6})
    met = own.join(lengths.select(F.col("conv_id").alias("b"), F.col("n").alias("base_n")), "b", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = written(met.select("c", "b", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "trie-convs")
    heads = convs.where("k > 0").join(turns.where("pos <= 5").withColumnRenamed("conv_id", "b"), "b").where("pos <= k").select("c", F.col("pos").alias("d"), "k1", "k2", "chars", "total")
    rest = turns.withColumnRenamed("conv_id", "c").join(convs, "c").where("pos > h").select("c", (F.col("k") + F.col("pos") - F.col("h")).alias("d"), "k1", "k2", "chars", "total")
    tagged = lambda salt, x, y: F.xxhash64(F.lit(salt), "d", x, y)
    return convs.select("c", "total"), heads.union(rest).select("c", "d", tagged(1, "k1", "k2").alias("t1"), tagged(2, "k2", "k1").alias("t2"), "chars", "total")


def prefixes(turns: DataFrame) -> DataFrame:
    """Adds the hashes of the prefix that ends with the turn (x1, x2) and of the one before it (p1, p2)."""
    turns = turns.withColumn("block", F.floor((F.col("d") - 1) / BLOCK))
    run = Window.partitionBy("c", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    summed = turns.withColumns({f"x{i}": F.bit_xor(f"t{i}").over(run) for i in (1, 2)})
    long = turns.where(F.col("total") > BLOCK).groupBy("c", "block").agg(*[F.bit_xor(f"t{i}").alias(f"s{i}") for i in (1, 2)])
    earlier = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = long.select("c", "block", *[F.coalesce(F.bit_xor(f"s{i}").over(earlier), F.lit(0)).alias(f"c{i}") for i in (1, 2)])
    more = summed.where(F.col("total") > BLOCK).join(carried, ["c", "block"]).withColumns({f"x{i}": F.col(f"x{i}").bitwiseXOR(F.col(f"c{i}")) for i in (1, 2)})
    both = summed.where(F.col("total") <= BLOCK).union(more.select(summed.columns))
    return both.select("c", "d", "x1", "x2", F.col("x1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("t2")).alias("p2"), "chars", (F.col("d") == F.col("total")).alias("last"))


def _siblings(linked: DataFrame) -> DataFrame:
    """Per node but the root: (conv_id, depth) and `next`, the conv_id of the next child of its parent, null for the last."""
    order = ["parent_conv_id", "depth", "conv_id"]
    rows = _ordered(linked.where("depth > 0").select(*order), order, order, "trie-siblings")
    within = Window.partitionBy("parent_conv_id", "depth", "part").orderBy("at")
    pieces = rows.groupBy("parent_conv_id", "depth", "part").agg(F.min("conv_id").alias("first"))
    over = pieces.select("parent_conv_id", "depth", "part", F.lead("first").over(Window.partitionBy("parent_conv_id", "depth").orderBy("part")).alias("later"))
    led = rows.withColumn("own", F.lead("conv_id").over(within)).join(over, ["parent_conv_id", "depth", "part"])
    return led.select("conv_id", "depth", F.coalesce("own", "later").alias("next"))


def _chains(c: np.ndarray, a: np.ndarray, nc: np.ndarray, na: np.ndarray, there: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of list elements in order of (c, a): each one's chain head, the weights between the two, and each one's local successor (-1: none)."""
    n = len(c)
    names, rank = np.unique(c, return_inverse=True)
    width = int(a.max()) + 1
    key = rank.astype(np.int64) * width + a
    at = np.minimum(np.searchsorted(names, nc), len(names) - 1)
    wanted = at.astype(np.int64) * width + na
    place = np.minimum(np.searchsorted(key, wanted), n - 1)
    local = np.where(there & (names[at] == nc) & (na < width) & (key[place] == wanted), place, -1)
    head = np.arange(n)
    inner = local >= 0
    head[local[inner]] = np.flatnonzero(inner)
    off = np.where((head != np.arange(n))[:, None], weights[head], 0)
    while True:  # every round doubles the distance covered
        far = head[head]
        if (far == head).all():
            return head, off, local
        off = off + off[head]
        head = far


def contract(links: DataFrame, parts: int, name: str) -> DataFrame:
    """Shortens a list of (c, a), its successor (nc, na) and the weights w, task by task.

    Per element: its chain's head (hc, ha) and the weights between them; for a head also the
    chain's successor and weight, which make the shorter list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None  # a range of bounded size
        if table is None or not table.num_rows:
            return
        number = lambda k: table[k].fill_null(0).to_numpy()
        c, a, nc, na = (number(k) for k in ("c", "a", "nc", "na"))
        weights = np.stack([number(k) for k in ("w0", "w1", "w2")], axis=1)
        head, off, local = _chains(c, a, nc, na, table["nc"].is_valid().to_numpy(), weights)
        tail = np.flatnonzero(local < 0)
        end = np.full(len(c), -1)
        end[head[tail]] = tail
        is_head = head == np.arange(len(c))
        last = np.where(is_head, end, 0)
        total = off[last] + weights[last]
        ends = ~table["nc"].is_valid().to_numpy()[last]
        masked = lambda v, none: pa.array(v, pa.int64(), mask=none)
        columns = [c, a, c[head], a[head], *off.T]
        yield from pa.Table.from_arrays(
            [*[pa.array(np.ascontiguousarray(v), pa.int64()) for v in columns], pa.array(is_head), masked(nc[last], ends | ~is_head), masked(na[last], ends | ~is_head), *[masked(np.ascontiguousarray(t), ~is_head) for t in total.T]],
            ["c", "a", "hc", "ha", "o0", "o1", "o2", "head", "nc", "na", "w0", "w1", "w2"],
        ).to_batches(10_000)

    dealt = links.repartitionByRange(parts, "c", "a") if parts > 1 else links.repartition(1)
    fields = "c long, a long, hc long, ha long, o0 long, o1 long, o2 long, head boolean, nc long, na long, w0 long, w1 long, w2 long"
    return written(dealt.sortWithinPartitions("c", "a").mapInArrow(run, fields), name)


def splice(links: DataFrame, salt: int, name: str) -> DataFrame:
    """As `contract`, whatever the order of the elements: about a quarter of them, chosen by coin, join the one before them."""
    coin = F.pmod(F.xxhash64(F.lit(salt), "c", "a"), F.lit(2))
    told = written(links.withColumn("coin", coin), f"{name}-coins")
    gone = told.where("coin = 1").select(F.col("c").alias("nc"), F.col("a").alias("na"), F.col("nc").alias("gc"), F.col("na").alias("ga"), *[F.col(f"w{i}").alias(f"g{i}") for i in range(3)])
    met = written(told.where("coin = 0").join(gone.withColumn("took", F.lit(True)), ["nc", "na"], "left").select(told.columns + ["gc", "ga", "g0", "g1", "g2", "took"]), f"{name}-met")
    took = F.coalesce("took", F.lit(False))
    zero = [F.lit(0).cast("long").alias(f"o{i}") for i in range(3)]
    stay = met.select("c", "a", F.col("c").alias("hc"), F.col("a").alias("ha"), *zero, F.lit(True).alias("head"), F.when(took, F.col("gc")).otherwise(F.col("nc")).alias("nc"), F.when(took, F.col("ga")).otherwise(F.col("na")).alias("na"), *[(F.col(f"w{i}") + F.coalesce(f"g{i}", F.lit(0))).alias(f"w{i}") for i in range(3)])
    none = [F.lit(None).cast("long").alias(k) for k in ("nc", "na", "w0", "w1", "w2")]
    went = met.where(took).select(F.col("nc").alias("c"), F.col("na").alias("a"), F.col("c").alias("hc"), F.col("a").alias("ha"), *[F.col(f"w{i}").alias(f"o{i}") for i in range(3)], F.lit(False).alias("head"), *none)
    ones = told.where("coin = 1").join(went.select("c", "a"), ["c", "a"], "left_anti").select("c", "a", F.col("c").alias("hc"), F.col("a").alias("ha"), *zero, F.lit(True).alias("head"), "nc", "na", "w0", "w1", "w2")
    return written(stay.union(went).union(ones), name)


def list_ranks(links: DataFrame, piece: int = PIECE, name: str = "tour") -> DataFrame:
    """Per element (c, a) of a linked list with successors (nc, na; null at the end): the weights w0, w1, w2 of all elements before it."""
    levels, n = [], links.count()
    while n > piece:
        level = contract(links, min(TASKS, -(-n // piece)), f"{name}-{len(levels)}")
        levels.append(level)
        links = level.where("head").select("c", "a", "nc", "na", "w0", "w1", "w2")
        before, n = n, links.count()
        if n > piece and n > SHRINK * before:  # the order of the elements says little about the list
            level = splice(links, len(levels), f"{name}-{len(levels)}")
            levels.append(level)
            links = level.where("head").select("c", "a", "nc", "na", "w0", "w1", "w2")
            n = links.count()
    ranks = contract(links, 1, f"{name}-last").select("c", "a", *[F.col(f"o{i}").alias(f"b{i}") for i in range(3)])
    for level in reversed(levels):
        host = ranks.select(F.col("c").alias("hc"), F.col("a").alias("ha"), "b0", "b1", "b2")
        ranks = level.join(host, ["hc", "ha"]).select("c", "a", *[(F.col(f"o{i}") + F.col(f"b{i}")).alias(f"b{i}") for i in range(3)])
    return ranks


def _joined(key: list[str]) -> tuple:
    """Batch functions for sorted rows (key.., c): stretches of joined ids per key, and the SHA-256 of each key's stretches."""

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        keys = np.stack([batch.column(k).to_numpy() for k in range(len(key))], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield a, b

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole in range(0, batch.num_rows, 1000):
                part = batch.slice(whole, 1000)
                cuts = list(runs(part))
                ids = part.column(len(key)).to_pylist()
                first = pa.array([a for a, _ in cuts], pa.int64())
                text = pa.array([",".join(map(str, ids[a:b])) for a, b in cuts])
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(first) for k in range(len(key))], part.column(len(key)).take(first), text], [*key, "c", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hasher = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int64()) for k in now], pa.array([hasher.hexdigest()])], [*key, "ends_sha256"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[: len(key)] != now:
                    if now is not None:
                        yield done()
                    now, hasher = row[: len(key)], hashlib.sha256()
                    hasher.update(row[-1].encode())
                else:
                    hasher.update(b"," + row[-1].encode())
        if now is not None:
            yield done()

    return stretches, digests


def ends_digest(ends: DataFrame, nodes: DataFrame, many: int = MANY) -> DataFrame:
    """Per node (depth, x1, x2) at which conversations c end: the SHA-256 of their ids in ascending order, comma-joined."""
    key = ["depth", "x1", "x2"]
    big = nodes.where(F.col("n_ends") > many).select(*key)
    ids: Column = F.array_join(F.sort_array(F.collect_list("c")), ",")
    few = ends.join(big, key, "left_anti").groupBy(*key).agg(F.sha2(ids, 256).alias("ends_sha256"))
    stretches, digests = _joined(key)
    fields = "depth long, x1 long, x2 long"
    rows = ends.join(big, key, "left_semi").select(*key, "c").repartitionByRange(*key, "c").sortWithinPartitions(*key, "c")
    text = rows.mapInArrow(stretches, f"{fields}, c long, ids string")
    lots = text.repartition(*key).sortWithinPartitions(*key, "c").select(*key, "ids").mapInArrow(digests, f"{fields}, ends_sha256 string")
    return few.union(lots)


def trie(conversations: DataFrame, piece: int = PIECE, many: int = MANY) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, turns = rebuilt(written(numbered(conversations), "trie-places"))
    rows = written(prefixes(written(turns, "trie-rebuilt")), "trie-prefixes")
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if(F.col("total") == 0).alias("n_ends")).where("n_convs > 0")
    grouped = rows.groupBy(F.col("d").alias("depth"), "x1", "x2").agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if("last").alias("n_ends"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("chars").alias("chars"))
    root = root.select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv_id", "n_convs", "n_ends", F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("chars"))
    nodes = written(grouped.union(root), "trie-nodes")

    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    linked = written(nodes.join(above, ["depth", "p1", "p2"], "left").drop("p1", "p2"), "trie-linked")
    children = linked.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.min("conv_id").alias("child"), F.count(F.lit(1)).alias("n_children"))
    full = written(linked.join(children, ["conv_id", "depth"], "left").join(_siblings(linked), ["conv_id", "depth"], "left"), "trie-full")

    leaf = F.col("child").isNull()
    place = lambda conv, arc: F.struct(conv.alias("c"), arc.cast("long").alias("a"))
    depth, own = F.col("depth"), F.col("conv_id")
    enter = F.struct(place(own, 2 * depth).alias("at"), F.when(leaf, place(own, 2 * depth + 1)).otherwise(place(F.col("child"), 2 * depth + 2)).alias("to"), leaf.cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    up = F.when(F.col("next").isNotNull(), place(F.col("next"), 2 * depth)).when(depth > 0, place(F.col("parent_conv_id"), 2 * depth - 1))
    leave = F.struct(place(own, 2 * depth + 1).alias("at"), up.alias("to"), zero.alias("leaves"), zero.alias("saved"))
    arcs = full.select(F.explode(F.array(enter, leave)).alias("arc")).select("arc.at.*", F.col("arc.to.c").alias("nc"), F.col("arc.to.a").alias("na"), F.lit(1).cast("long").alias("w0"), F.col("arc.leaves").alias("w1"), F.col("arc.saved").alias("w2"))
    ranks = list_ranks(written(arcs, "trie-arcs"), piece)
    at = lambda k, kind: F.max(F.when(F.col("a") % 2 == kind, F.col(k)))
    sums = ranks.groupBy(F.col("c").alias("conv_id"), F.floor(F.col("a") / 2).alias("depth")).agg(*[(at(k, 1) - at(k, 0)).alias(name) for k, name in (("b1", "n_leaves"), ("b2", "saved_tokens"))])

    ends = rows.where("last").select(F.col("d").alias("depth"), "x1", "x2", "c").union(convs.where("total = 0").select(zero, zero, zero, "c"))
    hashed = ends_digest(ends, nodes, many)
    out = full.join(sums, ["conv_id", "depth"]).join(hashed, ["depth", "x1", "x2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
