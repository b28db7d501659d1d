"""Graphs as vertices(id, ...) and edges(src, dst, ...): degrees, distances, components, rank, paths, communities, patterns.

Undirected kernels work on neighbours(edges), the distinct symmetric pairs; counts of edges count parallel edges. Loops
are ignored. Iterative kernels are joins and aggregates whose lineage is cut by checkpoint() in the shared folder.
"""

from __future__ import annotations

import atexit
import math
import re
import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TMP: list[tempfile.TemporaryDirectory] = []


def _checkpoint_dir(context) -> str:
    """The shared folder. Where none is set, a local session gets a temporary one; on a cluster, where that would split the data over machines, it is an error."""
    if not context._jsc.sc().getCheckpointDir().isDefined():
        found = context.getConf().get("spark.checkpoint.dir")
        if not found and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not found:
            _TMP.append(tempfile.TemporaryDirectory(prefix="checkpoint_"))
            atexit.register(_TMP[-1].cleanup)
            found = _TMP[-1].name
        context.setCheckpointDir(found)
    return context._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_checkpoint_dir(spark.sparkContext)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    _checkpoint_dir(df.sparkSession.sparkContext)
    return df.checkpoint()


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, other): distinct symmetric pairs without loops."""
    own = edges.where("src is not null and dst is not null and src != dst").select(F.col("src").alias("id"), F.col("dst").alias("other"))
    return own.union(own.select("other", "id")).distinct()


def pair_weights(edges: DataFrame) -> DataFrame:
    """(a, b, n, strength): edges and summed strength of each unordered pair."""
    return edges.where("src != dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"), F.sum("strength").alias("strength"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, edge_count, degree_centrality): distinct neighbours, incident edges, and degree over N - 1."""
    n = vertices.agg(F.count("*").alias("n"))
    near = neighbours(edges).groupBy("id").agg(F.count("*").alias("degree"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("edge_count"))
    out = vertices.select("id").join(near, "id", "left").join(ends, "id", "left").fillna(0, ["degree", "edge_count"]).join(F.broadcast(n))
    return out.select("id", "degree", "edge_count", F.round(F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(0.0), 4).alias("degree_centrality"))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable; isolates are their own.

    Each round takes a vertex to its least neighbour if that is smaller, follows such steps to their ends, and goes on with
    the distinct pairs of different ends. So every vertex with a smaller neighbour is gone after a round, pairs inside a
    group are read once, and only what still lies between groups is read again. A round's steps are followed by doubling.
    """
    ends = edges.where("src is not null and dst is not null and src != dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    ends, known = cut(ends), None
    while not ends.isEmpty():
        step = cut(ends.groupBy("v").agg(F.min("u").alias("low")))
        while True:
            further = step.select(F.col("v").alias("low"), F.col("low").alias("next"))
            after = cut(step.join(further, "low", "left").select("v", F.coalesce("next", "low").alias("low"), "next"))
            if after.where("next is not null").isEmpty():
                break
            step = after.drop("next")
        known = step if known is None else cut(_stepped(known, "low", step).unionByName(step))
        ends = cut(_stepped(_stepped(ends, "v", step), "u", step).where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    if known is None:
        return vertices.select("id", F.col("id").alias("component"))
    return vertices.select("id").join(known.select(F.col("v").alias("id"), "low"), "id", "left").select("id", F.coalesce("low", "id").alias("component"))


def _stepped(rows: DataFrame, column: str, step: DataFrame) -> DataFrame:
    """rows with the column's values taken to where step(v, low) leads."""
    to = step.select(F.col("v").alias(column), F.col("low").alias("_to"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def community_ids(labels: DataFrame) -> DataFrame:
    """labels(id, component) with community_id 1, 2, ... by size, then by smallest member."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("size"))
    from caseloom.operators.ranking import ranked

    numbered = ranked(sizes, F.desc("size"), "component", name="community_id")
    return labels.join(numbered.select("component", "community_id"), "component")


def communities(vertices: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per component of vertices(id, type, risk): nodes, edges inside, density, dominant type (ties: first by name), mean risk and four key members by degree."""
    own = vertices.join(labels, "id")
    inside = edges.where("src != dst").join(labels.withColumnRenamed("id", "src"), "src").groupBy("component").agg(F.count("*").alias("edge_count"))
    by_type = own.groupBy("component", "type").agg(F.count("*").alias("n")).groupBy("component").agg(F.min_by("type", F.struct(-F.col("n"), "type")).alias("dominant_type"))
    near = neighbours(edges).groupBy("id").agg(F.count("*").alias("degree"))
    ranked = own.join(near, "id", "left").fillna(0, ["degree"]).withColumn("n", F.row_number().over(Window.partitionBy("component").orderBy(F.desc("degree"), "id"))).where("n <= 4")
    key = ranked.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("key_members"))
    k = F.col("node_count")
    base = own.groupBy("component").agg(F.count("*").alias("node_count"), F.round(F.avg("risk"), 0).alias("average_risk"))
    out = base.join(inside, "component", "left").fillna(0, ["edge_count"]).join(by_type, "component").join(key, "component")
    return out.withColumn("density", F.when(k > 1, F.round(F.col("edge_count") * 2 / (k * (k - 1)), 3)).otherwise(1.0))


def graph_stats(vertices: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, mean degree, components, isolates."""
    v = vertices.agg(F.count("*").alias("nodes"))
    e = edges.agg(F.count("*").alias("edges"))
    near = neighbours(edges).select("id").distinct()
    alone = vertices.join(near, "id", "left_anti").agg(F.count("*").alias("isolates"))
    c = labels.agg(F.count_distinct("component").alias("components"))
    n = F.col("nodes")
    return v.join(e).join(alone).join(c).withColumns({"density": F.when(n > 1, F.round(F.col("edges") * 2 / (n * (n - 1)), 4)).otherwise(0.0), "average_degree": F.when(n > 0, F.round(2 * F.col("edges") / n, 2)).otherwise(0.0)})


def distances(vertices: DataFrame, edges: DataFrame, sources: DataFrame | None = None, depth: int | None = None, paths: bool = False) -> DataFrame:
    """(source, id, dist[, sigma]) from sources(id) (all vertices if None) to what they reach, themselves at 0; sigma counts shortest paths.

    Breadth first for all sources at once; each level is one join and one anti-join.
    """
    near = cut(neighbours(edges))
    start = (sources if sources is not None else vertices).select("id").distinct()
    seen = front = cut(start.select(F.col("id").alias("source"), "id", F.lit(0).alias("dist"), F.lit(1.0).alias("sigma")))
    level = 0
    while depth is None or level < depth:
        level += 1
        step = front.join(near, "id").groupBy("source", F.col("other").alias("id")).agg(F.sum("sigma").alias("sigma"))
        front = cut(step.join(seen.select("source", "id"), ["source", "id"], "left_anti").select("source", "id", F.lit(level).alias("dist"), "sigma"))
        if not front.limit(1).count():
            break
        seen = cut(seen.union(front))
    return seen if paths else seen.drop("sigma")


#: 64-bit words of source bits in a row, and rows of bits for each vertex in a pass of closeness().
WORDS, BLOCKS = 8, 1024


def _numbered(near: DataFrame) -> DataFrame:
    """(id, component, number, size): the ends of near(id, other) numbered from 0, components one after the other, so that most tiles between them are empty; size is the component's."""
    from caseloom.operators.ranking import ranked

    labels = components(near.select("id").distinct(), near.where("id < other").select(F.col("id").alias("src"), F.col("other").alias("dst")))
    own = cut(ranked(labels, "component", F.xxhash64("id"), "id", name="number").withColumn("number", F.col("number") - 1))
    sizes = own.groupBy("component").agg(F.count("*").alias("size"))
    return cut(own.join(sizes, "component").select("id", "component", "number", "size"))


def _passes(numbers: DataFrame, sources: int, most: int) -> DataFrame:
    """(s, pass): rows of so many sources, dealt out into passes that reach about `most` vertices, counted once for each source."""
    from caseloom.operators.ranking import running_sum

    rows = numbers.groupBy(F.floor(F.col("number") / sources).alias("s")).agg(F.sum("size").alias("cells"))
    return cut(running_sum(rows, "s", "cells", "before").select("s", F.floor(F.col("before") / most).alias("pass")))


def closeness(vertices: DataFrame, edges: DataFrame, words: int = WORDS, blocks: int = BLOCKS, size: int | None = None) -> DataFrame:
    """(id, closeness): reached share times reached over the sum of distances; 0 without neighbours.

    Components that fit a task are searched there (see parts.py); those that do not, and all if a `size` of blocks is given, over tiles.
    """
    from caseloom.operators import parts as P

    near = cut(neighbours(edges))
    numbers = _numbered(near)
    if numbers.isEmpty():
        return vertices.select("id", F.lit(0.0).alias("closeness"))
    found = []
    if size is None:
        parts, near = P.divided(near, numbers)
        found.append(P.searched(parts, P.reached, r=np.int64, d=np.int64).join(numbers, "number").select("id", "r", "d"))
        near = cut(near)
        numbers = None if near.isEmpty() else _numbered(near)
    if numbers is not None:
        found.append(_reached_by_tiles(near, numbers, words, blocks, size))
    n = vertices.agg(F.count("*").alias("n"))
    score = F.round(F.col("r") / (F.col("n") - 1) * (F.col("r") / F.col("d")), 4)
    return vertices.select("id").join(reduce(DataFrame.union, found), "id", "left").join(F.broadcast(n)).select("id", F.coalesce(score, F.lit(0.0)).alias("closeness"))


def _reached_by_tiles(near: DataFrame, numbers: DataFrame, words: int, blocks: int, size: int | None) -> DataFrame:
    """(id, r, d): how many vertices each reaches, and the sum of their distances.

    Breadth first for 64 x `words` sources in a row: a vertex's bits tell which of them have reached it, a level is one
    step over the tiles of neighbours and a bitwise or. As distances are symmetric, the new bits of a vertex count the vertices
    at that distance from it. A pass takes `blocks` such rows for each vertex, so its state is bounded; passes add up.
    """
    from caseloom.operators import tiles as T

    linked = numbers.count()
    size, many = min(size or T.VERTICES, linked), 64 * words
    links = T.tiles(near, numbers, size)
    passes = _passes(numbers, many, many * blocks * linked)
    number = F.col("number")
    place = numbers.select(F.floor(number / many).alias("s"), F.floor(number / size).alias("v"), (number % many).cast("int").alias("bit"), (number % size).cast("int").alias("at"))
    schema = "s long, v long, seen binary, r binary, d binary, x binary"

    def start(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros((words, size), np.uint64)
        bit, at = (table.column(c).to_numpy() for c in ("bit", "at"))
        bits[bit // 64, at] = np.uint64(1) << (bit % 64).astype(np.uint64)
        none = T.packed(np.zeros(size, np.int64))
        return pa.table({"s": [key[0].as_py()], "v": [key[1].as_py()], "seen": pa.array([T.packed(bits)], pa.binary()), "r": pa.array([none], pa.binary()), "d": pa.array([none], pa.binary()), "x": pa.array([T.packed(bits)], pa.binary())})

    def reached(level: int):
        def run(key: tuple, sums: pa.Table, state: pa.Table) -> pa.Table:
            new = T.met(sums, np.uint64, words, size)
            if len(state):
                seen, r, d = (T.unpacked(state.column(c)[0].as_buffer(), k, *shape) for c, k, shape in (("seen", np.uint64, (words, size)), ("r", np.int64, (size,)), ("d", np.int64, (size,))))
            else:
                seen, r, d = np.zeros((words, size), np.uint64), np.zeros(size, np.int64), np.zeros(size, np.int64)
            new &= ~seen
            counts = np.bitwise_count(new).sum(axis=0, dtype=np.int64)
            held = [T.packed(y) for y in (seen | new, r + counts, d + level * counts)]
            return pa.table({"s": [key[0].as_py()], "v": [key[1].as_py()], **{c: pa.array([y], pa.binary()) for c, y in zip(("seen", "r", "d"), held, strict=True)}, "x": pa.array([T.packed(new) if counts.any() else None], pa.binary())})

        return run

    out = []
    for (which,) in passes.select("pass").distinct().orderBy("pass").collect():
        mine = place.join(passes.where(F.col("pass") == which), "s").select("s", "v", "bit", "at")
        state, level = cut(mine.groupBy("s", "v").applyInArrow(start, schema)), 0
        while not state.where("x is not null").isEmpty():
            level += 1
            state = cut(T.together(T.spread(state, links, np.uint64, words, size), state, reached(level), schema))
        out.append(cut(T.values(state, size, r=np.int64, d=np.int64)))
    return reduce(DataFrame.union, out).groupBy("number").agg(F.sum("r").alias("r"), F.sum("d").alias("d")).join(numbers, "number").select("id", "r", "d")


#: Rows of a task of dealt(), about.
DEALT = 1 << 19


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """About n rows dealt out by keys, so many to a task, however many there are; few rows are left to Spark's own number."""
    if n <= 8 * DEALT:
        return rows.repartition(*keys)
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // DEALT)), *keys)


def diameter_estimate(vertices: DataFrame, edges: DataFrame, sources: int = 15) -> DataFrame:
    """The longest distance from the first vertices in id order.

    Breadth first with a bit for each source: a vertex has one row for each 63 sources, whichever of them reach it. Neighbours are
    dealt out and sorted once, in tasks of bounded size, for all levels.
    """
    near = cut(neighbours(edges))
    near = dealt(near, near.count(), "id").sortWithinPartitions("id").persist(StorageLevel.DISK_ONLY)
    first = vertices.select("id").orderBy("id").limit(sources).withColumn("n", F.row_number().over(Window.orderBy("id")) - 1)
    bit = F.expr("shiftleft(1L, n % 63)")
    seen = front = cut(first.groupBy("id", F.expr("cast(n div 63 as int)").alias("word")).agg(F.bit_or(bit).alias("bits")))
    level = None if seen.isEmpty() else 0
    while level is not None:
        sent = near.join(front, "id").groupBy(F.col("other").alias("id"), "word").agg(F.bit_or("bits").alias("bits"))
        own = seen.select("id", "word", F.col("bits").alias("held"))
        front = cut(sent.join(own, ["id", "word"], "left").select("id", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("held", F.lit(0)))).alias("bits")).where("bits != 0"))
        if front.isEmpty():
            break
        level += 1
        seen = cut(seen.union(front).groupBy("id", "word").agg(F.bit_or("bits").alias("bits")))
    near.unpersist()
    return edges.sparkSession.range(1).select(F.lit(level).cast("int").alias("diameter_estimate"))


#: Sources whose numbers stand in one row of betweenness(), rows of a vertex in a pass, and numbers in a pass at most.
SOURCES, ROWS, CELLS = 64, 128, 1 << 29


def betweenness(vertices: DataFrame, edges: DataFrame, sources: int = SOURCES, rows: int = ROWS, size: int | None = None) -> DataFrame:
    """(id, betweenness): the share of shortest paths through a vertex, unweighted, over (N - 1)(N - 2), 6 digits.

    Components that fit a task are searched there (see parts.py); those that do not, and all if a `size` of blocks is given, over tiles.
    """
    from caseloom.operators import parts as P

    near = cut(neighbours(edges))
    numbers, n = _numbered(near), vertices.count()
    if numbers.isEmpty():
        return vertices.select("id", F.lit(0.0).alias("betweenness"))
    factor = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    found = []
    if size is None:
        parts, near = P.divided(near, numbers)
        found.append(P.searched(parts, P.between, share=np.float64).join(numbers, "number").select("id", "share"))
        near = cut(near)
        numbers = None if near.isEmpty() else _numbered(near)
    if numbers is not None:
        found += _shares_by_tiles(near, numbers, sources, rows, size)
    if not found:
        return vertices.select("id", F.lit(0.0).alias("betweenness"))
    return vertices.select("id").join(reduce(DataFrame.union, found), "id", "left").select("id", F.round(F.coalesce("share", F.lit(0.0)) * factor, 6).alias("betweenness"))


def _shares_by_tiles(near: DataFrame, numbers: DataFrame, sources: int, rows: int, size: int | None) -> list[DataFrame]:
    """[(id, share)]: the shares of shortest paths that pass each vertex; empty if no path has a vertex inside.

    Breadth first for `sources` sources in a row, by blocks of vertices: the distance and the number of shortest paths
    from each. A level forward is one step over the tiles of neighbours (see tiles.py); a level
    back, the same with each vertex's (1 + share) / paths, multiplied by the paths of the level before. A pass takes
    `rows` rows for each vertex and about CELLS numbers at most, so what is kept of it is bounded, and what is added up of it is a number a vertex.
    """
    from caseloom.operators import tiles as T

    linked = numbers.count()
    size = min(size or T.VERTICES, linked)
    links = T.tiles(near, numbers, size)
    passes = _passes(numbers, sources, min(sources * rows * linked, CELLS))
    number = F.col("number")
    place = numbers.select(F.floor(number / sources).alias("s"), F.floor(number / size).alias("v"), (number % sources).cast("int").alias("row"), (number % size).cast("int").alias("at"))
    names = ("dist", "paths", "x")
    forward, back = "s long, v long, dist binary, paths binary, x binary", "s long, v long, share binary, x binary"
    shape = (sources, size)

    def row(key: tuple, **held: bytes | None) -> pa.Table:
        return pa.table({"s": [key[0].as_py()], "v": [key[1].as_py()], **{c: pa.array([y], pa.binary()) for c, y in held.items()}})

    def start(key: tuple, table: pa.Table) -> pa.Table:
        dist, paths = np.full(shape, -1, np.int32), np.zeros(shape)
        at = tuple(table.column(c).to_numpy() for c in ("row", "at"))
        dist[at], paths[at] = 0, 1
        return row(key, **dict(zip(names, (T.packed(dist), T.packed(paths), T.packed(paths)), strict=True)))

    def held(state: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return tuple(T.unpacked(state.column(c)[0].as_buffer(), k, *shape) for c, k in (("dist", np.int32), ("paths", np.float64)))

    def ahead(level: int):
        def run(key: tuple, sums: pa.Table, state: pa.Table) -> pa.Table:
            dist, paths = held(state) if len(state) else (np.full(shape, -1, np.int32), np.zeros(shape))
            sent = T.met(sums, np.float64, *shape)
            fresh = (sent > 0) & (dist < 0)
            dist[fresh], paths[fresh] = level, sent[fresh]
            return row(key, dist=T.packed(dist), paths=T.packed(paths), x=T.packed(np.where(fresh, sent, 0)) if fresh.any() else None)

        return run

    def behind(level: int):
        def run(key: tuple, sums: pa.Table, state: pa.Table) -> pa.Table:
            if not len(state):  # what was reached from here lies further back
                return row(key, share=None, x=None).slice(0, 0)
            dist, paths = held(state)
            mine = dist == level
            share = np.where(mine, paths * T.met(sums, np.float64, *shape), 0)
            x = np.divide(1 + share, paths, out=np.zeros(shape), where=mine)
            return row(key, share=T.packed(share.sum(axis=0)), x=T.packed(x) if mine.any() else None)

        return run

    shares = []
    for (which,) in passes.select("pass").distinct().orderBy("pass").collect():
        mine = place.join(passes.where(F.col("pass") == which), "s").select("s", "v", "row", "at")
        state, level = cut(mine.groupBy("s", "v").applyInArrow(start, forward)), 0
        while not state.where("x is not null").isEmpty():
            level += 1
            state = cut(T.together(T.spread(state, links, np.float64, sources, size), state, ahead(level), forward))
        # The last level that was reached is the one before; its vertices pass nothing on.
        none, gained = state.select("s", "v", F.lit(None).cast("binary").alias("sums")).limit(0), []
        below = cut(T.together(none, state.drop("x"), behind(level - 1), back))
        for deep in range(level - 2, 0, -1):
            below = cut(T.together(T.spread(below, links, np.float64, sources, size), state.drop("x"), behind(deep), back))
            gained.append(below.select("v", "share"))
        if gained:
            shares.append(cut(T.values(reduce(DataFrame.union, gained), size, share=np.float64)))
    if not shares:
        return []
    return [reduce(DataFrame.union, shares).groupBy("number").agg(F.sum("share").alias("share")).join(numbers, "number").select("id", "share")]


def pagerank(vertices: DataFrame, edges: DataFrame, iterations: int = 40, damping: float = 0.85, digits: int = 4, links: int | None = None) -> DataFrame:
    """(id, pagerank): undirected, a fixed number of rounds; vertices without neighbours share their rank among all.

    Nothing is sent to a vertex without neighbours, so all of them have one rank, a number that the driver carries on. The
    others are numbered by a hash and cut into blocks, and each pair of neighbours lies in the tile of its two blocks, about `links` to a
    tile (see tiles.py). Tiles are dealt out once; a round moves the blocks' ranks to their tiles and the tiles' sums back,
    which is vertices times the square root of the tiles, never the links.
    """
    from caseloom.operators import tiles as T
    from caseloom.operators.ranking import ranked

    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    pairs = cut(edges.where("src is not null and dst is not null and src != dst").select(low.alias("src"), high.alias("dst")).distinct())
    ids = pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct()
    numbers = cut(ranked(ids, F.xxhash64("id"), "id", name="number").select("id", (F.col("number") - 1).alias("number")))
    n, linked = vertices.count(), numbers.count()
    if not linked:
        return vertices.select("id", F.round(F.lit(1 / max(n, 1)), digits).alias("pagerank"))
    blocks = min(linked, math.ceil(math.sqrt(2 * pairs.count() / (links or T.EDGES))))
    size = math.ceil(linked / blocks)
    blocks = math.ceil(linked / size)
    tiles = T.pair_tiles(pairs, numbers, size, blocks)
    schema, own = "v long, x binary", [F.col("v").alias("own_v"), F.col("x").alias("k")]

    def of_block(key: tuple, x: np.ndarray) -> pa.Table:
        return pa.table({"v": [key[0].as_py()], "x": pa.array([T.packed(x)], pa.binary())})

    def counted(key: tuple, sums: pa.Table) -> pa.Table:
        return of_block(key, T.met(sums, np.float64, 1, size)[0])

    def passed_on(base: float, last: bool):
        def run(key: tuple, sums: pa.Table, held: pa.Table) -> pa.Table:
            k = T.unpacked(held.column("k")[0].as_buffer(), np.float64, size)
            rank = base + damping * T.met(sums, np.float64, 1, size)[0] if len(sums) else np.full(size, base)
            return of_block(key, rank if last else rank / np.maximum(k, 1))

        return run

    # With a 1 at each vertex, a round gives the numbers of neighbours.
    ones = edges.sparkSession.range(0, blocks, 1, 1).select(F.col("id").alias("v"), F.lit(T.packed(np.ones(size))).alias("x"))
    degree = cut(T.both_ways(ones, tiles, size, blocks).repartition(blocks, "v").groupBy("v").applyInArrow(counted, schema)).select(*own)
    alone, lone = n - linked, 1 / max(n, 1)
    nothing = ones.select("v", F.col("x").alias("sums")).limit(0)
    state = T.cogrouped(nothing, degree, blocks, passed_on(lone, iterations == 0), schema)
    for i in range(iterations):
        base = (1 - damping + damping * alone * lone) / max(n, 1)
        state = T.cogrouped(T.both_ways(state, tiles, size, blocks), degree, blocks, passed_on(base, i == iterations - 1), schema)
        lone = base
        if i % 5 == 4:
            state = cut(state)
    rank = cut(T.values(state, size, x=np.float64)).join(numbers, "number").select("id", F.col("x").alias("rank"))
    tiles.unpersist()
    return vertices.select("id").join(rank, "id", "left").select("id", F.round(F.coalesce("rank", F.lit(lone)), digits).alias("pagerank"))


def importance(degree: DataFrame, between: DataFrame, close: DataFrame, rank: DataFrame) -> DataFrame:
    """All metrics by id, with importance 3.5 degree + 3.5 betweenness + 1.5 closeness + 1.5 N pagerank and its rank (ties by id)."""
    n = degree.agg(F.count("*").alias("nodes"))
    out = degree.join(between, "id").join(close, "id").join(rank, "id").join(F.broadcast(n))
    score = F.round(3.5 * F.col("degree_centrality") + 3.5 * F.col("betweenness") + 1.5 * F.col("closeness") + 1.5 * F.col("pagerank") * F.col("nodes"), 2)
    from caseloom.operators.ranking import ranked

    return ranked(out.withColumn("importance", score).drop("nodes"), F.desc("importance"), "id")


def importance_reason(metrics: DataFrame) -> DataFrame:
    """metrics(degree, betweenness, pagerank, community_id) with a sentence on why a vertex ranks where it does."""
    d, b = F.col("degree"), F.col("betweenness")
    # The sentences and their limits.
    own = F.when(d >= 4, F.format_string("High direct connectivity with %d direct links (Hub Entity).", d)).when(d > 1, F.format_string("Moderate connectivity with %d links in Cluster #%d.", d, F.col("community_id"))).when(d == 1, F.format_string("Single peripheral relationship in Cluster #%d.", F.col("community_id"))).otherwise("Isolated node with no active recorded relationships.")
    bridge = F.when(b >= 0.15, "Critical network bridge routing high-frequency multi-hop interactions.").when(b > 0.05, "Intermediary broker connecting multiple sub-graphs.")
    influence = F.when(F.col("pagerank") > 0.1, "High PageRank influence propagated from neighboring central nodes.")
    return metrics.withColumn("reason", F.concat_ws(" ", own, bridge, influence))


def patterns(metrics: DataFrame, groups: DataFrame) -> DataFrame:
    """(type, id, severity): up to three hubs (degree 3+) and bridges (betweenness over .1, degree 2+) by rank, and dense cells (3+ nodes, density .5+)."""
    first = lambda rows: rows.orderBy("rank").limit(3)
    hubs = first(metrics.where("degree >= 3")).select(F.lit("HUB_ENTITY").alias("type"), F.col("id").cast("string").alias("id"), F.when(F.col("degree") >= 5, "CRITICAL").otherwise("HIGH").alias("severity"))
    bridges = first(metrics.where("betweenness > 0.1 and degree >= 2")).select(F.lit("BRIDGE_NODE"), F.col("id").cast("string"), F.lit("HIGH"))
    dense = groups.where("node_count >= 3 and density >= 0.5").select(F.lit("DENSE_CELL"), F.col("component").cast("string"), F.lit("MEDIUM"))
    return hubs.union(bridges).union(dense)


def ego_network(edges: DataFrame, center: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """(members(id, hop), edges among them) within so many hops of center(id)."""
    members = distances(center, edges, center, hops).groupBy("id").agg(F.min("dist").alias("hop"))
    ids = members.select("id")
    return members, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def _half_paths(both: DataFrame, start, hops: int, avoid) -> list[DataFrame]:
    """[(at, path, edge_ids)] by length 0 to hops: paths from start that repeat no vertex and do not pass `avoid`."""
    out = [both.sparkSession.range(1).select(F.lit(start).alias("at"), F.array(F.lit(start)).alias("path"), F.array().cast(f"array<{dict(both.dtypes)['edge_id']}>").alias("edge_ids"))]
    for _ in range(hops):
        step = out[-1].join(both, "at").where((F.col("next") != avoid) & ~F.array_contains("path", F.col("next")))
        out.append(cut(step.select(F.col("next").alias("at"), F.array_append("path", F.col("next")).alias("path"), F.array_append("edge_ids", F.col("edge_id")).alias("edge_ids"))))
    return out


def simple_paths(edges: DataFrame, start, end, longest: int = 4) -> DataFrame:
    """(path, edge_ids, hops): all paths of at most so many edges that repeat no vertex; parallel edges give paths of their own.

    Paths grow from both ends, each by half the length, and meet at a middle vertex if they share no other one. So what is
    held is the paths of half the length and not all beginnings, most of which never reach the end.
    """
    if start == end:
        return edges.limit(0).select(F.array("src").alias("path"), F.array("edge_id").alias("edge_ids"), F.lit(0).alias("hops"))
    own = edges.where("src != dst")
    both = cut(own.select(F.col("src").alias("at"), F.col("dst").alias("next"), "edge_id").union(own.select("dst", "src", "edge_id")))
    ahead, back = _half_paths(both, start, (longest + 1) // 2, end), _half_paths(both, end, longest // 2, start)
    direct = both.where((F.col("at") == start) & (F.col("next") == end)).select(F.array("at", "next").alias("path"), F.array("edge_id").alias("edge_ids"))
    found = [direct]
    for hops in range(2, longest + 1):
        left = ahead[(hops + 1) // 2]
        right = back[hops // 2].select("at", F.reverse("path").alias("rest"), F.reverse("edge_ids").alias("rest_ids"))
        met = left.join(right, "at").where(F.size(F.array_intersect("path", "rest")) == 1)
        found.append(met.select(F.concat("path", F.slice("rest", 2, longest)).alias("path"), F.concat("edge_ids", "rest_ids").alias("edge_ids")))
    return reduce(DataFrame.union, found).select("path", "edge_ids", F.size("edge_ids").alias("hops"))


def shortest_path(edges: DataFrame, start, end, longest: int | None = 4) -> DataFrame:
    """(path, hops): one shortest path, that of the smallest vertices from the start on; no row if there is none."""
    near = cut(neighbours(edges))
    front = near.where(F.col("id") == start).select(F.col("other").alias("id"), F.array("id", "other").alias("path"))
    seen = near.where(F.col("id") == start).select("id").distinct()
    hops = 1
    while True:
        front = cut(front.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        hit = front.where(F.col("id") == end)
        if hit.limit(1).count() or not front.limit(1).count() or hops == longest:
            return hit.select("path", (F.size("path") - 1).alias("hops"))
        seen = cut(seen.union(front.select("id")))
        front = front.join(near, "id").select(F.col("other").alias("id"), F.array_append("path", F.col("other")).alias("path"))
        hops += 1


def common_neighbours(edges: DataFrame, a, b) -> DataFrame:
    """One row: the number of common neighbours of a and b, and the Jaccard coefficient of their neighbourhoods."""
    near = neighbours(edges).where(F.col("id").isin(a, b)).groupBy("other").agg(F.count("*").alias("n"))
    return near.agg(F.count_if(F.col("n") == 2).alias("common"), F.round(F.coalesce(F.count_if(F.col("n") == 2) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 4).alias("jaccard"))


def induced(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the vertices."""
    ids = vertices.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def merged_vertices(*parts: DataFrame) -> DataFrame:
    """All vertices of the parts(id, ...); of one id the first part's row stays, and in a part the one of the least name."""
    out = None
    for i, p in enumerate(parts):
        own = p.withColumn("part", F.lit(i))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in ("id", "part")]
    return out.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("part", "name")).alias("v")).select("id", *(F.col(f"v.{c}").alias(c) for c in rest))


def search_network(vertices: DataFrame, edges: DataFrame, text: str, types: list[str] | None = None, least_risk: int = 0) -> tuple[DataFrame, DataFrame]:
    """Vertices whose fields hold the text, case aside, and their neighbours, filtered by type and risk, with the edges among them.

    An edge that says so in its evidence (record, detail) brings in both its ends; its id, type and strength are no text.
    """
    fields = F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in vertices.columns)))
    hits = vertices.where(fields.contains(text.lower())).select("id")
    if told := [c for c in ("record", "detail") if c in edges.columns]:
        by_edge = edges.where(F.lower(F.concat_ws(" ", *told)).contains(text.lower()))
        hits = hits.union(by_edge.select("src")).union(by_edge.select("dst"))
    hits = hits.distinct()
    around = neighbours(edges).join(hits, "id", "left_semi").select(F.col("other").alias("id"))
    kept = vertices.join(hits.union(around).distinct(), "id", "left_semi").where(F.coalesce("risk", F.lit(0)) >= least_risk)
    if types:
        kept = kept.where(F.upper("type").isin([t.upper() for t in types]))
    return kept, induced(kept, edges)


def capped(vertices: DataFrame, edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """What a view of bounded size shows: the first vertices by id, and twice as many edges by edge_id."""
    return vertices.orderBy("id").limit(most), edges.orderBy("edge_id").limit(2 * most)
