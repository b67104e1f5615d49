"""How many steps lead from a source to each node, and which paths do.

The plan follows what a document's graph measures. Where all edges lead from one tier to a lower, or all to a higher, rounds of joins are as few as the tiers. Else a document whose edges fit a task (``GATHERED``) is searched in it, all such documents in one pass. A larger one is first contracted:
nodes with one edge in and one out hang together in chains, whose places are found by pointer jumping (each round doubles what is known, so a chain of a million nodes
takes twenty rounds), and only the arcs between chains are searched in rounds.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.plans.stage import cut, parts

GATHERED = 100_000  # edges of a document that one task may hold
NODE = ["doc", "node"]


def _nearest(steps: DataFrame) -> DataFrame:
    return steps.groupBy("doc", "node").agg(F.min("steps").alias("steps"))


def _search(starts: list[tuple], edges: list[tuple], cap: int | None) -> dict[tuple, int]:
    """Steps to each node that is reached within ``cap``, by breadth."""
    out: dict[tuple, list[tuple]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    found = dict.fromkeys(starts, 0)
    queue = deque(found)
    while queue:
        v = queue.popleft()
        n = found[v] + 1
        if cap is None or n <= cap:
            for w in out.get(v, ()):
                if w not in found:
                    found[w] = n
                    queue.append(w)
    return found


def _in_tasks(source: DataFrame, pairs: DataFrame, cap: int | None) -> DataFrame:
    flat = lambda c: F.struct(F.col(f"{c}.t").alias("t"), F.col(f"{c}.i").alias("i"))
    starts = source.groupBy("doc").agg(F.collect_list(flat("node")).alias("starts"))
    edges = pairs.groupBy("doc").agg(F.collect_list(F.struct(F.col("node.t").alias("a"), F.col("node.i").alias("b"), F.col("next.t").alias("c"), F.col("next.i").alias("d"))).alias("edges"))
    rows = starts.join(edges, "doc", "left")
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                ends = [x.values() for x in one.column("edges").to_pylist()[0] or []]
                found = _search([(x["t"], x["i"]) for x in one.column("starts").to_pylist()[0]], [((a, b), (c, d)) for a, b, c, d in ends], cap)
                doc = one.column("doc").take(pa.array(np.zeros(len(found), np.int64)))
                t, i = pa.array([n[0] for n in found], pa.int32()), pa.array([n[1] for n in found], pa.int64())
                yield pa.RecordBatch.from_arrays([doc, t, i, pa.array(list(found.values()), pa.int64())], ["doc", "t", "i", "steps"])

    flat_rows = rows.mapInArrow(run, f"doc {kind}, t int, i bigint, steps bigint")
    return flat_rows.select("doc", F.struct("t", "i").alias("node"), "steps")


def chains(pairs: DataFrame, stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, arcs) of the contracted graph. places: doc, node, head, away: how far a node lies behind the head of its chain, for nodes that aren't heads. arcs: doc, node, next, away:
    the edges between chains, from head to head. ``stops`` (doc, node) are heads always."""
    pairs = cut(pairs.distinct())
    single_out = pairs.groupBy("doc", "node").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("doc", "node")
    single_in = pairs.groupBy("doc", F.col("next").alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("doc", "node").join(stops, NODE, "left_anti")
    links = pairs.join(single_out, NODE, "left_semi").join(single_in.withColumnRenamed("node", "next"), ["doc", "next"], "left_semi")
    jump = cut(links.select("doc", F.col("next").alias("node"), F.col("node").alias("head"), F.lit(1).cast("bigint").alias("away")))
    rounds = max(1, jump.count()).bit_length() + 1
    for _ in range(rounds):
        further = jump.select("doc", F.col("node").alias("head"), F.col("head").alias("__head"), F.col("away").alias("__away"))
        moved = jump.join(further, ["doc", "head"], "left")
        if moved.where("__head IS NOT NULL").isEmpty():
            break
        jump = cut(moved.select("doc", "node", F.coalesce("__head", "head").alias("head"), (F.col("away") + F.coalesce("__away", F.lit(0))).alias("away")))
    # a ring of links has no head: nothing leads into it, so it is never reached
    places = jump.join(jump.select("doc", F.col("node").alias("head")), ["doc", "head"], "left_anti").select("doc", "node", "head", "away")
    rest = pairs.join(links.select("doc", "node", "next"), ["doc", "node", "next"], "left_anti").join(places, NODE, "left")
    arcs = rest.select("doc", F.coalesce("head", "node").alias("node"), "next", (F.coalesce("away", F.lit(0)) + 1).alias("away"))
    return places, arcs


def _contracted(source: DataFrame, pairs: DataFrame, cap: int | None) -> DataFrame:
    places, arcs = chains(pairs, source)
    places, arcs = cut(places), cut(arcs)
    near = lambda rows: rows if cap is None else rows.where(F.col("steps") <= cap)
    known = frontier = cut(source.select("doc", "node", F.lit(0).cast("bigint").alias("steps")))
    while True:
        step = _nearest(near(frontier.join(arcs, NODE).select("doc", F.col("next").alias("node"), (F.col("steps") + F.col("away")).alias("steps"))))
        better = step.join(known.withColumnRenamed("steps", "__known"), NODE, "left").where("__known IS NULL OR steps < __known").select("doc", "node", "steps")
        frontier = cut(better)
        if frontier.isEmpty():
            break
        known = cut(_nearest(known.unionByName(frontier)))
    inside = places.join(known.withColumnRenamed("node", "head"), ["doc", "head"]).select("doc", "node", (F.col("steps") + F.col("away")).alias("steps"))
    return near(known.unionByName(inside))


TIERS = 16  # the most tiers that a walk takes in rounds


def tiers(rows: DataFrame, column: str) -> list[int]:
    """The tiers that a column of nodes has; a corpus has few."""
    return sorted(r.t for r in rows.select(F.col(f"{column}.t").alias("t")).distinct().collect())


def _between_tiers(source: DataFrame, pairs: DataFrame, cap: int | None) -> DataFrame | None:
    """Where all edges lead up or all lead down the tiers, no walk is longer than there are tiers: a round is one join of the tiers that its frontier has. None for other graphs."""
    rise = F.col("next.t") - F.col("node.t")
    low, high = pairs.agg(F.min(rise), F.max(rise)).first()
    if low is None or low <= 0 <= high or len(tiers(pairs, "node")) > TIERS:
        return None
    frontier = found = source.withColumn("steps", F.lit(0).cast("bigint"))
    inner, n = set(tiers(pairs, "node")), 0
    while (cap is None or n < cap) and (here := [t for t in tiers(frontier, "node") if t in inner]):
        n += 1
        near, far = frontier.where(F.col("node.t").isin(here)), pairs.where(F.col("node.t").isin(here))
        k = parts(pairs.sparkSession, far.count())
        step = near.repartition(k, *NODE).join(far.repartition(k, *NODE), NODE)
        frontier = cut(step.select("doc", F.col("next").alias("node")).distinct().withColumn("steps", F.lit(n).cast("bigint")))
        found = found.unionByName(frontier)
    return _nearest(found)


def distances(source: DataFrame, pairs: DataFrame, cap: int | None = None, gathered: int = GATHERED) -> DataFrame:
    """doc, node, steps of every node within ``cap`` steps of ``source`` (doc, node), the sources with 0. ``pairs`` has doc, node, next."""
    source, pairs = cut(source.select("doc", "node").distinct()), cut(pairs.select("doc", "node", "next"))
    layered = _between_tiers(source, pairs, cap)
    if layered is not None:
        return layered
    size = pairs.groupBy("doc").agg(F.count(F.lit(1)).alias("__n"))
    large = cut(size.where(F.col("__n") > gathered).select("doc"))
    if large.isEmpty():
        return _in_tasks(source, pairs, cap)
    small = _in_tasks(source.join(large, "doc", "left_anti"), pairs.join(large, "doc", "left_anti"), cap)
    return small.unionByName(_contracted(source.join(large, "doc", "left_semi"), pairs.join(large, "doc", "left_semi"), cap))


# --- heights


def _heights(l: list[int], r: list[int], nodes: int) -> list[int]:
    """Each node's longest way down, from the last nodes up; -1 on and above cycles."""
    left, into, high = [0] * nodes, [[] for _ in range(nodes)], [0] * nodes
    for a, b in zip(l, r):
        left[a] += 1
        into[b].append(a)
    free = [v for v in range(nodes) if not left[v]]
    for v in free:  # grows while it is read
        for a in into[v]:
            left[a] -= 1
            high[a] = max(high[a], high[v] + 1)
            if not left[a]:
                free.append(a)
    return [-1 if n else h for n, h in zip(left, high)]


def graded(edges: DataFrame, gathered: int = GATHERED) -> DataFrame:
    """doc, l, r, lh, rh: the edges (doc, l, r) with the heights of their ends, 0 for nodes without edges out. Documents of at most ``gathered`` edges are settled in a task each,
    larger ones in a round for each height. Raises ValueError where there is a cycle."""
    edges = cut(edges.select("doc", "l", "r"))
    large = cut(edges.groupBy("doc").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > gathered).select("doc"))
    own = edges.join(large, "doc", "left_anti").groupBy("doc").agg(F.collect_list(F.struct(F.col("l.t").alias("a"), F.col("l.i").alias("b"), F.col("r.t").alias("c"), F.col("r.i").alias("d"))).alias("e"))
    kind = own.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                group, number = batch.column("e")[k].values, {}
                a, b, c, d = (group.field(x) for x in "abcd")
                l, r = ([number.setdefault(n, len(number)) for n in zip(t.to_pylist(), i.to_pylist())] for t, i in ((a, b), (c, d)))
                high = np.array(_heights(l, r, len(number)), np.int32)
                doc = batch.column("doc").take(pa.array(np.full(len(group), k, np.int64)))
                yield pa.RecordBatch.from_arrays([doc, a, b, c, d, pa.array(high[l]), pa.array(high[r])], ["doc", "a", "b", "c", "d", "lh", "rh"])

    node = lambda t, i, name: F.struct(F.col(t).alias("t"), F.col(i).alias("i")).alias(name)
    out = cut(own.mapInArrow(run, f"doc {kind}, a int, b bigint, c int, d bigint, lh int, rh int").select("doc", node("a", "b", "l"), node("c", "d", "r"), "lh", "rh"))
    if not out.where("lh < 0").isEmpty():
        raise ValueError("the relation has a cycle")
    if large.isEmpty():
        return out
    whole = rest = cut(edges.join(large, "doc", "left_semi"))
    high, h, n = None, 0, rest.count()
    while n:
        h += 1
        inner = rest.select("doc", F.col("l").alias("node")).distinct()
        after = cut(rest.join(inner.withColumnRenamed("node", "r"), ["doc", "r"], "left_semi").select("doc", "l", "r"))
        ended = cut(inner.join(after.select("doc", F.col("l").alias("node")), NODE, "left_anti").withColumn("h", F.lit(h)))
        high = ended if high is None else high.unionByName(ended)
        rest, left = after, after.count()
        if left == n:
            raise ValueError("the relation has a cycle")
        n = left
    far = whole.join(high.select("doc", F.col("node").alias("l"), F.col("h").alias("lh")), ["doc", "l"]).join(high.select("doc", F.col("node").alias("r"), F.col("h").alias("rh")), ["doc", "r"], "left")
    return out.unionByName(far.select("doc", "l", "r", "lh", F.coalesce("rh", F.lit(0)).alias("rh")))


# --- the paths themselves


def path_counts(edges: DataFrame) -> DataFrame:
    """doc, node, n: how many paths lead from each node of an acyclic graph to nodes without edges out; parallel edges are different paths. One round for each height: a
    node is counted once, when all its children are."""
    edges = cut(edges.select("doc", "l", "r"))
    nodes = edges.select("doc", F.col("l").alias("node")).union(edges.select("doc", F.col("r").alias("node"))).distinct()
    one = F.lit(1).cast("decimal(38,0)")
    done = cut(nodes.join(edges.select("doc", F.col("l").alias("node")), NODE, "left_anti").withColumn("n", one))
    known, rest, partial = done, edges, None
    while True:
        # edges to what is counted become sums at their upper ends; a node is ready when no edge of it is left
        hit = rest.join(done.select("doc", F.col("node").alias("r"), "n"), ["doc", "r"])
        sums = hit.groupBy("doc", F.col("l").alias("node")).agg(F.sum("n").cast("decimal(38,0)").alias("n"))
        rest = cut(rest.join(done.select("doc", F.col("node").alias("r")), ["doc", "r"], "left_anti"))
        waiting = rest.select("doc", F.col("l").alias("node")).distinct().withColumn("__wait", F.lit(True))
        partial = sums if partial is None else partial.unionByName(sums)
        partial = cut(partial.groupBy(*NODE).agg(F.sum("n").cast("decimal(38,0)").alias("n")).join(waiting, NODE, "left"))
        done = cut(partial.where("__wait IS NULL").drop("__wait"))
        partial = cut(partial.where("__wait IS NOT NULL").drop("__wait"))
        if done.isEmpty():
            if not rest.isEmpty():
                raise ValueError("paths are counted in acyclic graphs only")
            return known
        known = known.unionByName(done)


def _listed(l: list[int], r: list[int], n: int) -> list[int]:
    """How many paths lead from each of ``n`` nodes to nodes without edges out; 0 on or above a cycle."""
    left, into, count = [0] * n, [[] for _ in range(n)], [0] * n
    for a, b in zip(l, r):
        left[a] += 1
        into[b].append(a)
    free = [v for v in range(n) if not left[v]]
    for v in free:
        count[v] = 1
    for v in free:  # grows while it is read
        for a in into[v]:
            count[a] += count[v]
            left[a] -= 1
            if not left[a]:
                free.append(a)
    return [0 if k else c for k, c in zip(left, count)]


def _first(out: list[list[int]], r: list[int], count: list[int], start: int, skip: int) -> Iterator[list[int]]:
    """The paths from ``start`` as places of edges, in order, from the ``skip``th on; what lies before is passed over by its counts."""
    path, stack = [], [iter(out[start])]
    if not out[start] and not skip:
        yield []
    while stack:
        e = next(stack[-1], None)
        if e is None:
            stack.pop()
            path[-1:] = []
        elif skip >= count[r[e]]:
            skip -= count[r[e]]
        elif out[r[e]]:
            path.append(e)
            stack.append(iter(out[r[e]]))
        else:
            yield [*path, e]


def _paths_in_tasks(edges: DataFrame, origins: DataFrame, cap: int) -> DataFrame:
    """``paths`` of documents whose edges fit a task, all in one pass."""
    n = parts(edges.sparkSession, edges.count(), 1 << 18)
    end = F.struct("ord", F.col("l.t").alias("a"), F.col("l.i").alias("b"), F.col("r.t").alias("c"), F.col("r.i").alias("d"), F.col("name").cast("string").alias("name"))
    own = edges.repartition(n, "doc").groupBy("doc").agg(F.sort_array(F.collect_list(end)).alias("e"))
    own = own.select("doc", F.transform("e", lambda x: F.struct(x.a, x.b, x.c, x.d, x["name"])).alias("e"))
    starts = origins.repartition(n, "doc").groupBy("doc").agg(F.collect_list(F.struct(F.col("origin.t").alias("t"), F.col("origin.i").alias("i"))).alias("o"))
    rows = starts.join(own, "doc", "full")
    kind = rows.schema["doc"].dataType.simpleString()
    flat = f"doc {kind}, t int, i bigint, rank bigint, path array<string>, refused boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, t, i, ranks, ends, places, refusals = [], [], [], [], [0], [], []
            e = batch.column("e")
            sides, names = [e.values.field(j).to_numpy(zero_copy_only=False) for j in range(4)], e.values.field(4)
            begin, known = e.offsets.to_numpy(), e.is_valid().to_numpy(zero_copy_only=False)

            def made() -> pa.RecordBatch:
                own = [batch.column("doc").take(pa.array(docs, pa.int64())), pa.array(t, pa.int32()), pa.array(i, pa.int64()), pa.array(ranks, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(places, pa.int64()))), pa.array(refusals, pa.bool_())]  # noqa: B023
                for x in (docs, t, i, ranks, ends, places, refusals):  # noqa: B023
                    x.clear()
                ends.append(0)  # noqa: B023
                return pa.RecordBatch.from_arrays(own, ["doc", "t", "i", "rank", "path", "refused"])

            for k in range(batch.num_rows):
                l, r, number, base = [], [], {}, int(begin[k])
                if known[k]:
                    a, b, c, d = (x[base : begin[k + 1]].tolist() for x in sides)
                    l, r = ([number.setdefault(v, len(number)) for v in zip(*x)] for x in ((a, b), (c, d)))
                here = [tuple(x.values()) for x in batch.column("o")[k].as_py() or []]
                for v in here:
                    number.setdefault(v, len(number))
                out = [[] for _ in number]
                for at, v in enumerate(l):
                    out[v].append(at)
                count = _listed(l, r, len(number))
                if not all(count):
                    raise ValueError("paths are counted in acyclic graphs only")
                for v in here:
                    more = count[number[v]] > cap
                    for rank, path in enumerate(_first(out, r, count, number[v], cap if more else 0), cap if more else 0):
                        docs.append(k)
                        t.append(v[0])
                        i.append(v[1])
                        ranks.append(rank)
                        places += [base + at for at in path]
                        ends.append(len(places))
                        refusals.append(more)
                        if len(docs) == 4096:
                            yield made()
                        if more:
                            break
            yield made()

    return rows.mapInArrow(run, flat).select("doc", F.struct("t", "i").alias("origin"), "rank", "path", "refused")


def paths(edges: DataFrame, origins: DataFrame, cap: int, gathered: int = GATHERED) -> DataFrame:
    """doc, origin, rank, path, refused: every path from each origin (doc, node) to a node without edges out, as the names of its edges, where there are at most ``cap``; else
    one row, refused, with the first path that the cap leaves out. ``edges`` has doc, ord, l, r, name; paths are ranked by the order of their edges.

    Paths are counted first, so a refusal lists nothing; then each rank finds its own way down: at a node, the counts of the children before it tell which edge a rank takes.
    Work is the length of what is returned. Documents of at most ``gathered`` edges are settled in a task each, larger ones in rounds of joins.
    """
    if cap < 0:
        raise ValueError("the cap must not be negative")
    edges, origins = cut(edges.select("doc", "ord", "l", "r", "name")), origins.select("doc", F.col("node").alias("origin")).distinct()
    large = cut(edges.groupBy("doc").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > gathered).select(F.col("doc").alias("__doc")))
    if large.isEmpty():
        return _paths_in_tasks(edges, origins, cap)
    split = lambda rows, how: rows.join(large, rows["doc"] == large["__doc"], how)
    near = _paths_in_tasks(split(edges, "left_anti"), split(origins, "left_anti"), cap)
    return near.unionByName(_paths_in_rounds(cut(split(edges, "left_semi")), split(origins, "left_semi"), cap))


def _paths_in_rounds(edges: DataFrame, origins: DataFrame, cap: int) -> DataFrame:
    counts = cut(path_counts(edges))
    wide = lambda c: c.cast("decimal(38,0)")
    order = Window.partitionBy("doc", "l").orderBy("ord", "r", "name")
    steps = edges.join(counts.select("doc", F.col("node").alias("r"), "n"), ["doc", "r"])
    steps = steps.withColumn("to", wide(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))).withColumn("from", wide(F.col("to") - F.col("n")))
    steps = cut(steps.select("doc", F.col("l").alias("at"), F.col("r").alias("next"), "name", "from", "to"))
    total = origins.join(counts.select("doc", F.col("node").alias("origin"), "n"), ["doc", "origin"], "left").withColumn("n", F.coalesce("n", F.lit(1).cast("decimal(38,0)")))
    refused = F.col("n") > cap
    ranks = F.when(refused, F.array(F.lit(cap).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint") - 1))
    going = cut(total.select("doc", "origin", refused.alias("refused"), F.explode(ranks).alias("rank")).withColumn("at", F.col("origin")).withColumn("left", wide(F.col("rank"))).withColumn("path", F.array().cast("array<string>")))
    ended, inner = None, steps.select("doc", "at").distinct()
    while True:
        here = going.join(inner, ["doc", "at"], "left_anti").select("doc", "origin", "rank", "path", "refused")
        ended = here if ended is None else ended.unionByName(here)
        going = going.join(steps, ["doc", "at"]).where((F.col("left") >= F.col("from")) & (F.col("left") < F.col("to")))
        going = cut(going.select("doc", "origin", "refused", "rank", F.col("next").alias("at"), wide(F.col("left") - F.col("from")).alias("left"), F.concat("path", F.array(F.col("name").cast("string"))).alias("path")))
        if going.isEmpty():
            return ended

