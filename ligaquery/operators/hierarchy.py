"""Parent-child links to full hierarchies: leaf peeling, reverse peel order, cycles in what is left.

Leaves are peeled: a node whose child links are all peeled hands the list of its descendants and its
subtree size to its parents. Read backwards, the peel order assigns each node the paths of its
parents plus its own id. Nodes that are never peeled lie on or above a cycle; peeled from the top,
those above go, and on the rest the strongly connected ones are the cycles.

Links fall into families (connected components). Families
of at most ``FAMILY`` links are peeled inside tasks, many families a task, so the number of Spark
jobs grows with the logarithm of the depth. A larger family, and only such, is peeled by rounds over
the whole cluster, one aggregation and one join a round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligaquery.operators.clustering import components
from ligaquery.session import settle

#: Links of a family that one task peels, and links a task is given on average.
FAMILY, TASK_LINKS = 200_000, 100_000
BATCH = 20_000
WAYS = "feature_id STRING, root_id STRING, depth INT, feature_path STRING, n_ways_down BIGINT"
PAIRS = "feature_id STRING, descendant_id STRING"
MOST = (1 << 63) - 1


# ---- inside a task: whole families ----


class Family:
    """Nodes as numbers, links both ways, the peel order, and what is left of it."""

    def __init__(self, parents: list[str], children: list[str]) -> None:
        number: dict[str, int] = {}
        ends = [(number.setdefault(p, len(number)), number.setdefault(c, len(number))) for p, c in zip(parents, children, strict=True)]
        self.names = list(number)
        self.up: list[list[int]] = [[] for _ in number]
        self.down: list[list[int]] = [[] for _ in number]
        for p, c in ends:
            self.down[p].append(c)
            self.up[c].append(p)
        every = range(len(number))
        self.peeled = self._peel(every, self.down, self.up)
        done = set(self.peeled)
        self.left = [x for x in every if x not in done]
        kept = set(self.left)
        within = lambda side: {x: [y for y in side[x] if y in kept] for x in self.left}
        down, up = within(self.down), within(self.up)
        self.above = self._peel(self.left, up, down)
        core = kept - set(self.above)
        self.ring = self._rings(core, down)

    @staticmethod
    def _peel(nodes, waits, frees) -> list[int]:
        """The nodes in an order in which each comes after all of its ``waits``; those that never come are left out."""
        open_ = {x: len(waits[x]) for x in nodes}
        order = [x for x, n in open_.items() if not n]
        for x in order:
            for y in frees[x]:
                open_[y] -= 1
                if not open_[y]:
                    order.append(y)
        return order

    @staticmethod
    def _rings(core: set[int], down: dict[int, list[int]]) -> set[int]:
        """The nodes of ``core`` on a cycle: one search numbers nodes by finish, a second goes back from the last finished."""
        back: dict[int, list[int]] = {x: [] for x in core}
        for x in core:
            for y in down[x]:
                if y in core:
                    back[y].append(x)
        finish, seen = [], set()
        for start in core:
            todo = [] if start in seen else [(start, iter(down[start]))]
            seen.add(start)
            while todo:
                x, rest = todo[-1]
                nxt = next((y for y in rest if y in core and y not in seen), None)
                if nxt is None:
                    finish.append(todo.pop()[0])
                else:
                    seen.add(nxt)
                    todo.append((nxt, iter(down[nxt])))
        ring, taken = {x for x in core if x in down[x]}, set()
        for start in reversed(finish):
            if start not in taken:
                taken.add(start)
                group = [start]
                for x in group:
                    new = [y for y in back[x] if y not in taken]
                    taken.update(new)
                    group += dict.fromkeys(new)
                if len(group) > 1:
                    ring.update(group)
        return ring

    def ways(self) -> Iterator[tuple]:
        """One row per node and way down to it, with the number of ways on (null on, below and above cycles)."""
        size = dict.fromkeys(self.peeled, 0)
        for x in self.peeled:
            for p in self.up[x]:
                if p in size:
                    size[p] += size[x] + 1
        got: dict[int, list[tuple]] = {}
        bad = {x: -1 if x in self.ring else -2 for x in set(self.left) - set(self.above)}
        for x, depth in bad.items():
            yield self.names[x], "", depth, "", None
        for x in [*self.above, *reversed(self.peeled)]:
            if any(p in bad for p in self.up[x]):
                bad[x] = -2
                yield self.names[x], "", -2, "", None
                continue
            own, n = self.names[x], size.get(x)
            rows = [(own, 0, own)] if not self.up[x] else [(r, d + 1, f"{path}/{own}") for p in self.up[x] for r, d, path in got[p]]
            if self.down[x]:
                got[x] = rows
            for root, depth, path in rows:
                yield own, root, depth, path, n if n is not None and n <= MOST else None

    def descendants(self) -> Iterator[tuple[str, str]]:
        """Each node with each other node below it, once a pair."""
        lists: dict[int, set[int]] = {}
        for x in self.peeled:
            own = lists.pop(x, set())
            yield from ((self.names[x], self.names[y]) for y in own)
            for p in self.up[x]:
                lists.setdefault(p, set()).update(own, (x,))
        for x in self.left:
            seen, todo = {x}, [x]
            for y in todo:
                new = [z for z in self.down[y] if z not in seen]
                seen.update(new)
                todo += dict.fromkeys(new)
            yield from ((self.names[x], self.names[y]) for y in todo[1:])


def _in_tasks(rows: Callable[[Family], Iterator[tuple]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [(b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches]
        family = Family([x for p, _ in given for x in p], [x for _, c in given for x in c])
        held: list[tuple] = []
        for row in rows(family):
            held.append(row)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return run


_TEXT = pa.string()
_WAYS = pa.schema([("feature_id", _TEXT), ("root_id", _TEXT), ("depth", pa.int32()), ("feature_path", _TEXT), ("n_ways_down", pa.int64())])
_PAIRS = pa.schema([("feature_id", _TEXT), ("descendant_id", _TEXT)])


def _tasks(small: DataFrame, n_links: int) -> DataFrame:
    """(p, c) of ``small`` (k, p, c) with each family in one partition, about TASK_LINKS a partition."""
    n = max(int(small.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_links // TASK_LINKS))
    return small.repartition(n, "k").select("p", "c")


# ---- over the cluster: families beyond FAMILY ----


def peel(links: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(parts, residual) of the distinct links (p, c), by rounds.

    A part holds the links (p, c, acc) of one round; ``acc`` is the number of ways down from c, c
    itself included (null if it exceeds a BIGINT). The residual links (p, c) lie on or above a cycle.
    """
    now, done = links.select("p", "c", F.lit(1).cast("bigint").alias("acc")), []
    while True:
        inner = now.select(F.col("p").alias("q")).distinct()
        off = settle(now.join(inner, F.col("c") == F.col("q"), "left_anti"))
        if off.isEmpty():
            return done, now.select("p", "c")
        done.append(off)
        sent = off.groupBy(F.col("p").alias("q")).agg(F.try_sum("acc").alias("got"))
        rest = now.join(off.select(F.col("c").alias("g")).distinct(), F.col("c") == F.col("g"), "left_anti")
        now = settle(rest.join(sent, F.col("c") == F.col("q"), "left").select("p", "c", F.try_add("acc", F.coalesce("got", F.lit(0).cast("bigint"))).alias("acc")))


def _flip(links: DataFrame) -> DataFrame:
    return links.select(F.col("c").alias("p"), F.col("p").alias("c"))


def _nodes(links: DataFrame) -> DataFrame:
    return links.select(F.col("p").alias("x")).union(links.select("c")).distinct()


def _reach(start: DataFrame, links: DataFrame) -> DataFrame:
    """(x): ``start`` (x) and all nodes below it, a level a round."""
    found = front = settle(start.distinct())
    while not front.isEmpty():
        front = settle(front.join(links, F.col("x") == F.col("p")).select(F.col("c").alias("x")).distinct().join(found, "x", "left_anti"))
        found = settle(found.union(front))
    return found


def on_cycles(links: DataFrame) -> DataFrame:
    """(x): the nodes on a cycle of ``links``.

    Families of the residue are searched inside tasks. In a larger one, the node of the smallest id
    of each family is taken: what it reaches both ways is its cycle, and the three parts into which
    it splits the rest are searched on their own.
    """
    found = [links.where("p = c").select(F.col("p").alias("x"))]
    rest = settle(links.where("p <> c").distinct())
    while not rest.isEmpty():
        rest = settle(_flip(peel(_flip(peel(rest)[1]))[1]))
        small, large, n = families(rest)
        if n:
            spec = pa.schema([("x", _TEXT)])
            found.append(_tasks(small, n).mapInArrow(_in_tasks(lambda f: ((f.names[x],) for x in f.ring), spec), "x STRING"))
        if large is None:
            break
        pivot = large.groupBy("k").agg(F.min("p").alias("x")).select("x")
        down, up = _reach(pivot, large), _reach(pivot, _flip(large))
        both = settle(down.join(up, "x"))
        # a single node reaches itself; self-links are counted above
        inside = large.join(both, F.col("p") == F.col("x"), "left_semi").join(both, F.col("c") == F.col("x"), "left_semi")
        found.append(_nodes(inside))
        side = settle(_nodes(large).join(down.withColumn("d", F.lit(1)), "x", "left").join(up.withColumn("u", F.lit(1)), "x", "left").select("x", F.hash("d", "u").alias("s")))
        a, b = side.select(F.col("x").alias("p"), F.col("s").alias("sp")), side.select(F.col("x").alias("c"), F.col("s").alias("sc"))
        rest = settle(large.select("p", "c").join(a, "p").join(b, "c").where("sp = sc").select("p", "c").join(both, F.col("p") == F.col("x"), "left_anti"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.distinct()


def _ways_by_rounds(links: DataFrame) -> DataFrame:
    """The rows of ``Family.ways`` for the nodes of ``links``.

    Sizes come up with the peel rounds; paths go down a level a round, each way once, so a round
    reads only the ways of the level before.
    """
    parts, residual = peel(links)
    upper, core = peel(_flip(residual))
    core = settle(core)
    nodes, heads = settle(_nodes(links)), links.select(F.col("c").alias("q")).distinct()
    if core.isEmpty():
        bad = settle(nodes.limit(0).withColumn("depth", F.lit(0)))
    else:
        ring = settle(on_cycles(_flip(core)))
        below = _reach(ring, links).join(ring.withColumnRenamed("x", "r"), F.col("x") == F.col("r"), "left")
        bad = settle(below.select("x", F.when(F.col("r").isNull(), -2).otherwise(-1).alias("depth")))
    clean = settle(links.join(bad, F.col("c") == F.col("x"), "left_anti"))
    front = nodes.join(heads, F.col("x") == F.col("q"), "left_anti").select(F.col("x").alias("feature_id"), F.col("x").alias("root_id"), F.lit(0).alias("depth"), F.col("x").alias("feature_path"))
    front = settle(front.join(bad, F.col("feature_id") == F.col("x"), "left_anti"))
    out = bad.select(F.col("x").alias("feature_id"), F.lit("").alias("root_id"), "depth", F.lit("").alias("feature_path"))
    while not front.isEmpty():
        out = out.unionByName(front)
        front = settle(front.join(clean, F.col("feature_id") == F.col("p")).select(F.col("c").alias("feature_id"), "root_id", (F.col("depth") + 1).alias("depth"), F.concat_ws("/", "feature_path", "c").alias("feature_path")))
    size = None
    for part in parts:
        size = part.select("p", "acc") if size is None else size.unionByName(part.select("p", "acc"))
    above = _nodes(residual).withColumn("n", F.lit(None).cast("bigint")).withColumn("left_over", F.lit(True))
    known = above if size is None else size.join(above.select(F.col("x").alias("a")), F.col("p") == F.col("a"), "left_anti").groupBy(F.col("p").alias("x")).agg(F.try_sum("acc").alias("n")).withColumn("left_over", F.lit(False)).unionByName(above)
    n = F.when((F.col("depth") >= 0) & ~F.coalesce("left_over", F.lit(False)), F.when(F.col("left_over").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("n")))
    return out.join(known, F.col("feature_id") == F.col("x"), "left").select("feature_id", "root_id", "depth", "feature_path", n.alias("n_ways_down"))


def _descendants_by_rounds(links: DataFrame) -> DataFrame:
    """The rows of ``Family.descendants``: with each peel round the lists of the peeled nodes go to their parents, as rows."""
    parts, residual = peel(links)
    live, out = None, []
    for part in parts:
        sent = part.select("p", F.col("c").alias("d"))
        if live is not None:
            met = settle(live.join(part.select("p", F.col("c").alias("g")), F.col("a") == F.col("g"), "left"))
            out.append(met.where("g IS NOT NULL").select("a", "d").distinct())
            sent = sent.union(met.where("g IS NOT NULL").select("p", "d")).union(met.where("g IS NULL").select("a", "d"))
        live = settle(sent.select(F.col("p").alias("a"), "d").distinct())
    if live is not None:
        out.append(live)
    if not residual.isEmpty():
        found = front = settle(residual.select(F.col("p").alias("a"), F.col("c").alias("x")))
        while not front.isEmpty():
            front = settle(front.join(residual, F.col("x") == F.col("p")).select("a", F.col("c").alias("x")).distinct().join(found, ["a", "x"], "left_anti"))
            found = settle(found.union(front))
        out.append(found.select("a", F.col("x").alias("d")))
        if live is not None:
            out.append(found.join(live.withColumnRenamed("a", "b"), F.col("x") == F.col("b")).select("a", "d"))
    pairs = out[0]
    for o in out[1:]:
        pairs = pairs.union(o)
    return pairs.where("a <> d").select(F.col("a").alias("feature_id"), F.col("d").alias("descendant_id")).distinct()


# ---- both ----


def families(links: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """(small, large, number of small ones) of the distinct links: (k, p, c) with the family's label k; large is None without any."""
    number = settle(_nodes(links).withColumn("v", F.monotonically_increasing_id()))  # written, so the same in each use
    a, b = number.select(F.col("x").alias("p"), F.col("v").alias("a")), number.select(F.col("x").alias("c"), F.col("v").alias("b"))
    pairs = settle(links.select("p", "c").join(a, "p").join(b, "c"), number)
    labels = components(pairs.select(F.explode(F.array("a", "b")).alias("v")), pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    marked = settle(pairs.join(labels, F.col("a") == F.col("v")).select(F.col("root").alias("k"), "p", "c"), pairs, labels)
    sizes = marked.groupBy("k").agg(F.count(F.lit(1)).alias("n")).groupBy((F.col("n") > FAMILY).alias("large")).agg(F.sum("n").alias("n"))
    counted = {r.large: r.n for r in sizes.collect()}  # at most two rows
    if not counted.get(True):
        return marked, None, counted.get(False, 0)
    big = marked.groupBy(F.col("k").alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FAMILY).select("b")
    return marked.join(big, F.col("k") == F.col("b"), "left_anti"), settle(marked.join(big, F.col("k") == F.col("b"), "left_semi")), counted.get(False, 0)


def _known(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = settle(nodes.where("x IS NOT NULL").select("x").distinct())
    links = links.where("p IS NOT NULL AND c IS NOT NULL").select("p", "c").distinct()
    return nodes, settle(links.join(nodes, F.col("p") == F.col("x"), "left_semi").join(nodes, F.col("c") == F.col("x"), "left_semi"))


def hierarchy(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(feature_id, root_id, depth, feature_path, n_ways_down) of ``nodes`` (x) and ``links`` (p, c).

    One row per node and way down to it from a root. A node on a cycle has one row with empty
    root_id and feature_path and depth -1; one below a cycle the same with depth -2. Null ids are no
    nodes; repeated rows and links count once; links from or to unknown nodes are ignored; empty
    tables give an empty result. ``n_ways_down`` is the number of ways that go on below the row; it is
    null on and below cycles, and above them, where it has no bound, or if it exceeds a BIGINT.
    """
    nodes, links = _known(nodes, links)
    small, large, n = families(links)
    alone = nodes.join(_nodes(links).withColumnRenamed("x", "l"), F.col("x") == F.col("l"), "left_anti")
    out = alone.select(F.col("x").alias("feature_id"), F.col("x").alias("root_id"), F.lit(0).alias("depth"), F.col("x").alias("feature_path"), F.lit(0).cast("bigint").alias("n_ways_down"))
    out = out.unionByName(_tasks(small, n).mapInArrow(_in_tasks(Family.ways, _WAYS), WAYS)) if n else out
    return out if large is None else out.unionByName(_ways_by_rounds(large.select("p", "c")))


def descendants(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(feature_id, descendant_id): each node with each other node below it on some way, once a pair.

    Nodes on and above cycles have theirs too; a node is no descendant of itself. Nulls, repeats, unknown
    nodes and empty tables are treated as in ``hierarchy``.
    """
    nodes, links = _known(nodes, links)
    small, large, n = families(links)
    out = _tasks(small, n).mapInArrow(_in_tasks(Family.descendants, _PAIRS), PAIRS) if n else None
    rounds = None if large is None else _descendants_by_rounds(large.select("p", "c"))
    if out is None or rounds is None:
        found = out if rounds is None else rounds
        return links.select(F.col("p").alias("feature_id"), F.col("c").alias("descendant_id")).limit(0) if found is None else found
    return out.unionByName(rounds)
