"""Components of a similarity graph from inverted lists, without all pairs of a list.

Every list is first compared with one of its members only: the hub, which is
the member with the longest lists, as the least altered one of a group of
near copies is. So a list of any length costs one pair a member, and what
these verified links join is one component. Pairs inside a component need no
comparison any more. Of the lists that still mix components, those of at most
``SHORT`` members give all their pairs, a bounded number a member. The members
of longer ones are compared by an exact prefix filter over their own sets:
values are ordered by how many of these members hold them, rarest first, and a
pair that links must share a value so early in either order that what follows
still suffices. Values that a whole group holds thus pair only members that
could link, so no link between different components is lost and no list is
paired with itself.

Members that lists connect form a block. A block of at most ``BLOCK_VALUES``
values is filtered in one task, where whole sets are compared at once; the blocks beyond go through joins by value.
There, which sizes of a partner suffice at a place is part of the join key,
and of each key's rows those of its most frequent component are never paired
with each other. Both ways lead to the same components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

SAMPLE = 512
SHORT = 8
BLOCK_VALUES = 1 << 21
#: Pairs of a block that are judged at once, and judged pairs that are remembered (others may be judged again).
FLUSH = 1 << 16
KNOWN = 1 << 21
#: Partner sizes are told apart by this many classes to a factor of e.
CLASSES = 50
_EPS = 1e-6


def top(level: int) -> int:
    """Greatest 63-bit value of a level's sample."""
    return (1 << (63 - level)) - 1


def sample(values: np.ndarray) -> tuple[int, np.ndarray]:
    """(level, held) of a set of sorted 63-bit hash values.

    At most about SAMPLE values lie up to top(level), all of a smaller set at
    level 0. Held are those up to top(level - 1), so that a set also has the
    values by which sets of the level below are judged.
    """
    level = max(0, (len(values) - 1) // SAMPLE).bit_length()
    return level, values[: np.searchsorted(values, np.uint64(top(max(0, level - 1))), "right")]


def block_pairs(node: np.ndarray, comp: np.ndarray, level: np.ndarray, held: list[np.ndarray], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a block's nodes from different components, in parts: links that join what is apart so far, and what may link.

    A pair is judged at the finest level that both nodes hold. Whole sets are
    compared here, so of their pairs only links are returned, and only those
    that join components; sampled ones are returned if they may link. Pairs
    are judged as soon as FLUSH of them are found, so that a block of near
    copies never holds all its pairs; links found by then spare later ones.
    """
    names, at = np.unique(comp, return_inverse=True)
    up, of_node = list(range(len(names))), at.tolist()

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    def roots() -> np.ndarray:
        """The component so far of each node."""
        now = np.array(up)
        while (now[now] != now).any():
            now = now[now]
        return now[at]

    def judge(found: list[np.ndarray], known: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """(pairs to return, known): known are pairs that have been judged at this level, not always all."""
        pairs, now = _once(found), roots()
        pairs = pairs[:, now[pairs[0]] != now[pairs[1]]]
        keys = pairs[0] << 32 | pairs[1]
        if len(known):
            new = known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] != keys
            pairs, keys = pairs[:, new], keys[new]
        known = keys if len(known) + len(keys) > KNOWN else np.sort(np.concatenate([known, keys]))
        if not whole:
            return pairs, known
        kept: list[tuple[int, int]] = []
        for lo in range(0, pairs.shape[1], 1 << 14):
            for x, y in pairs[:, lo : lo + (1 << 14)].T.tolist():
                a, b = root(of_node[x]), root(of_node[y])
                if a == b:
                    continue
                both = np.intersect1d(held[x], held[y], assume_unique=True).size
                if den * both >= num * (len(held[x]) + len(held[y]) - both):
                    up[max(a, b)] = min(a, b)
                    kept.append((x, y))
        return np.array(kept, np.int64).reshape(-1, 2).T, known

    t = num / den
    for lv in np.unique(np.r_[level, np.maximum(level - 1, 0)]):
        mine = np.flatnonzero((level == lv) | (level == lv + 1))
        sets = [held[i][: np.searchsorted(held[i], np.uint64(top(int(lv))), "right")] for i in mine]
        m = np.array([len(x) for x in sets])
        if m.sum() < 2:
            continue
        _, v, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        del sets
        of = np.repeat(np.arange(len(mine)), m)
        order = np.lexsort((v, often[v], of))
        v, left = v[order], np.repeat(np.cumsum(m), m) - np.arange(len(v))
        low = np.full(len(m), t) if lv == 0 else np.maximum(t - 5 * np.sqrt(t * (1 - t) / np.maximum(m, 1)), 0.05)
        early = (often[v] > 1) & (left >= low[of] * m[of] - _EPS)
        of, v, left = of[early], v[early], left[early]
        order = np.argsort(v, kind="stable")
        of, v, left = of[order], v[order], left[order]
        r, c_ = (low / (1 + low))[of], roots()[mine][of]
        size, coarse = m[of], (level[mine][of] > lv) | (lv == 0)
        found, size_found, known = [], 0, np.zeros(0, np.int64)

        def fits(x, y, size=size, left=left, r=r, c_=c_, coarse=coarse):
            return (c_[x] != c_[y]) & (coarse[x] | coarse[y]) & (np.minimum(left[x], left[y]) >= np.minimum(r[x], r[y]) * (size[x] + size[y]) - _EPS)

        first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)
        count = np.diff(np.r_[first, len(v)])
        near = np.flatnonzero(np.repeat(count <= 32, count))
        for d in range(1, 32):
            x = near[:-d] if len(near) > d else near[:0]
            y = x + d
            x = x[(y < len(v)) & (v[np.minimum(y, len(v) - 1)] == v[x])] if len(x) else x
            x = x[fits(x, x + d)]
            found.append(np.stack([mine[of[x]], mine[of[x + d]]]))
            size_found += len(x)
            if size_found > FLUSH:
                pairs, known = judge(found, known, lv == 0)
                yield node[pairs[0]], node[pairs[1]]
                c_[:] = roots()[mine][of]
                found, size_found = [], 0
        for lo, k in zip(first[count > 32].tolist(), count[count > 32].tolist(), strict=True):
            kinds, kind, often_ = np.unique(c_[lo : lo + k], return_inverse=True, return_counts=True)
            if len(kinds) > 1:
                every = np.arange(lo, lo + k)
                for x in every[kind != often_.argmax()].tolist():
                    y = every[fits(np.full(k, x), every)]
                    found.append(np.stack([np.full(len(y), mine[of[x]]), mine[of[y]]]))
                    size_found += len(y)
                    if size_found > FLUSH:
                        pairs, known = judge(found, known, lv == 0)
                        yield node[pairs[0]], node[pairs[1]]
                        c_[:] = roots()[mine][of]
                        found, size_found = [], 0
        if size_found:
            pairs, _ = judge(found, known, lv == 0)
            yield node[pairs[0]], node[pairs[1]]


def _once(found: list[np.ndarray]) -> np.ndarray:
    """The distinct pairs of numbers below 2**31."""
    a, b = np.sort(np.concatenate(found, 1), 0)
    both = np.unique(a << 32 | b)
    return np.stack([both >> 32, both & 0xFFFFFFFF])


def _blocks(num: int, den: int):
    """(x, y) of rows (block, node, comp, level, held) that come sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def finish() -> Iterator[pa.RecordBatch]:
            _, node, comp, level, held = zip(*rows, strict=True)
            rows.clear()
            for x, y in block_pairs(np.array(node), np.array(comp), np.array(level), list(held), num, den):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])

        for batch in batches:
            off, flat = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy().view(np.uint64)
            held = [flat[a:b].copy() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            for row in zip(*[batch.column(i).to_pylist() for i in range(4)], held, strict=True):
                if rows and row[0] != rows[-1][0]:
                    yield from finish()
                rows.append(row)
        if rows:
            yield from finish()

    return run


def _far_pairs(lists: DataFrame, values: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """(x, y): all pairs from different components that may link, of the nodes in lists(key, node, comp)."""
    ends = lists.groupBy("key").agg(F.min("node").alias("end"))
    block = c.connected_components(lists.join(ends, "key").select(F.col("node").alias("a"), F.col("end").alias("b")))
    nodes = c.saved(lists.select("node", "comp").distinct().join(block.withColumnRenamed("comp", "block"), "node"), "far")
    # sets are large: they carry their block from here on, so that no join moves them to it
    sets = c.saved(values(nodes).select("block", "node", "comp", "level", "held"), "samples")
    large = c.saved(sets.groupBy("block").agg(F.sum(F.size("held")).alias("n")).where(F.col("n") > BLOCK_VALUES).select("block"), "large-blocks")
    some = large.limit(1).count()
    whole = sets.join(large, "block", "left_anti") if some else sets
    pairs = whole.repartition("block").sortWithinPartitions("block").select("block", "node", "comp", "level", "held").mapInArrow(_blocks(num, den), "x long, y long")
    if some:
        rest = c.saved(sets.join(large, "block", "left_semi").select("node", "comp", "level", "held"), "large")
        pairs = pairs.unionByName(_prefix_pairs(rest, num, den))
    return pairs


def _prefix_pairs(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y): all pairs from different components of sets(node, comp, level, held) that may link, by joins.

    A whole set is judged exactly; of a sampled one the threshold is taken
    five standard deviations lower.
    """
    # a pair is judged at the finest level that both hold: one of the two is coarser there, or has it all
    levels = sets.withColumn("lv", F.explode(F.when(F.col("level") > 0, F.array("level", F.col("level") - 1)).otherwise(F.array("level"))))
    upto = F.expr(f"shiftright({top(0)}L, lv)")
    coarse = sets.select("node", "comp", F.col("level").alias("own"))
    at_level = levels.select("node", "lv", F.filter("held", lambda v: v <= upto).alias("s")).where(F.size("s") > 0)
    tokens = at_level.select("node", "lv", F.size("s").alias("m"), F.explode("s").alias("v"))
    often = tokens.groupBy("lv", "v").agg(F.count("*").alias("df")).where("df > 1")
    ordered = tokens.join(often, ["lv", "v"]).groupBy("node", "lv", "m").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("t"))
    # values that one member holds alone come first and meet no one
    place = ordered.select("node", "lv", "m", (F.col("m") - F.size("t")).alias("alone"), F.posexplode("t").alias("i", "t"))
    t = num / den
    low = F.when(F.col("lv") == 0, F.lit(t)).otherwise(F.lit(t) - 5 * F.sqrt(F.lit(t * (1 - t)) / F.col("m")))
    low = F.greatest(low, F.lit(0.05))
    rows = place.select("node", "lv", F.col("t.v").alias("v"), "m", (F.col("m") - F.col("alone") - F.col("i")).alias("left"), (low / (1 + low)).alias("r"), low.alias("low"))
    rows = rows.where(F.col("left") >= F.col("low") * F.col("m") - _EPS).join(coarse, "node")
    rows = rows.withColumn("coarse", (F.col("own") > F.col("lv")) | (F.col("lv") == 0)).drop("own")
    rows = c.saved(rows, "prefixes")
    met = rows.groupBy("lv", "v").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("lv", "v")
    rows = rows.join(met, ["lv", "v"])

    def size_class(m):
        return F.floor(F.log(m) * CLASSES).cast("int")

    less = rows.where(F.col("left") >= 2 * F.col("r") * F.col("m") - _EPS).withColumn("size", size_class(F.col("m")))
    most = F.col("left") / F.col("r") - F.col("m") + _EPS
    first, last = size_class(F.greatest(F.col("low") * F.col("m") - _EPS, F.lit(1.0))), F.least(size_class(F.col("m")), size_class(F.greatest(most, F.lit(1.0))))
    more = rows.withColumn("size", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    key = ["lv", "v", "size"]
    kinds = less.select(*key, "comp").unionByName(more.select(*key, "comp")).groupBy(*key, "comp").agg(F.count("*").alias("k"))
    mixed = kinds.groupBy(*key).agg(F.max_by("comp", F.struct("k", "comp")).alias("mode"), F.count("*").alias("kinds")).where("kinds > 1").select(*key, "mode")

    def side(part: DataFrame, s: str) -> DataFrame:
        part = part.join(mixed, key)
        return part.select(*key, F.col("node").alias(s), F.col("comp").alias(f"c{s}"), F.col("m").alias(f"m{s}"), F.col("left").alias(f"l{s}"), F.col("r").alias(f"r{s}"), F.col("coarse").alias(f"k{s}"), (F.col("comp") != F.col("mode")).alias(f"o{s}"))

    small, large = side(less, "x"), side(more, "y")
    fits = (F.col("cx") != F.col("cy")) & ((F.col("mx") < F.col("my")) | ((F.col("mx") == F.col("my")) & (F.col("x") < F.col("y"))))
    fits &= (F.col("kx") | F.col("ky")) & (F.least("lx", "ly") >= F.least("rx", "ry") * (F.col("mx") + F.col("my")) - _EPS)
    one = small.where("ox").join(large, key).where(fits).select("x", "y")
    two = small.where("not ox").join(large.where("oy"), key).where(fits).select("x", "y")
    return one.unionByName(two)


def _cross_pairs(sized: DataFrame, label: DataFrame, values: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """(a, b): pairs of different components, from lists(key, node, k) that mix some, which may link."""
    placed = c.saved(sized.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key")
    rest = c.saved(c.narrow(placed.join(mixed, "key"), placed.count()), "mixed")
    x, y = (rest.where(F.col("k") <= SHORT).select("key", F.col("node").alias(s), F.col("comp").alias(f"c{s}")) for s in "xy")
    pairs = x.join(y, "key").where("x < y and cx <> cy").select("x", "y")
    far = rest.where(F.col("k") > SHORT)
    if far.limit(1).count():
        pairs = pairs.unionByName(_far_pairs(far.select("key", "node", "comp"), values, num, den))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(lists: DataFrame, verify: Callable[[DataFrame], DataFrame], values: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """(node, comp) of the nodes that have a verified link, from lists(key, node).

    verify takes distinct pairs (a, b) with a < b and returns those that
    link, that is den * intersection >= num * union of their sets; values
    takes nodes(node, comp, block) and returns them with (level, held), see sample.
    """
    lists = lists.select("key", "node").distinct()
    sizes = lists.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    sized = c.saved(lists.join(sizes, "key"), "lists")
    size = sized.count()
    weight = sized.groupBy("node").agg(F.sum("k").alias("w"))
    hubs = c.narrow(sized.join(weight, "node"), size).groupBy("key").agg(F.max(F.struct("w", "node")).alias("hub")).select("key", F.col("hub.node").alias("hub"))
    pairs = c.narrow(sized.join(hubs, "key").where("node <> hub"), size)
    first = c.saved(c.narrow(pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), size), "hub-pairs")
    links = c.saved(c.narrow(verify(first), 8 * first.count()), "hub-links")
    label = c.connected_components(links)
    second = c.saved(_cross_pairs(sized, label, values, num, den).join(first, ["a", "b"], "left_anti"), "cross-pairs")
    if second.limit(1).count() == 0:
        return label
    more = c.saved(c.narrow(verify(second), 8 * second.count()), "cross-links")
    if more.limit(1).count() == 0:
        return label
    return c.connected_components(links.unionByName(more))
