"""Graph operators over edge tables: iterative joins, with intermediate tables cut by checkpoint()."""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.sources.files import shared_folder

#: Edges up to which an algorithm without a distributed form may run on one machine.
LOCAL_EDGES = 200_000
#: Vectors held at once, and restarts, of the search for the second eigenvalue.
LANCZOS_STEPS, LANCZOS_ROUNDS = 40, 200


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the session's folder (a new one where none is set, as in tests)."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="gristmill-"))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, and with sizes from which joins are planned."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bfs(edges: DataFrame, seeds: DataFrame, hops: int, directed: bool = False, cap: int | None = None) -> DataFrame:
    """(id, hop) of nodes within `hops` of the seeds; with a cap the first by (hop, id)."""
    links = edges.select("src", "dst")
    if not directed:
        links = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    links = stored(links.distinct()) if hops > 1 else links  # every hop reads them
    seen = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for hop in range(1, hops + 1):
        step = frontier.select(F.col("id").alias("src")).join(links, "src").select(F.col("dst").alias("id")).distinct()
        frontier = step.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        frontier = stored(frontier) if hop < hops else frontier
        seen = seen.unionByName(frontier)
    return seen if cap is None else seen.orderBy("hop", "id").limit(cap)


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes, and each end's degree there."""
    from gristmill.operators.joins import both_ends

    own = both_ends(edges.select("src", "dst").distinct(), nodes, "src", "dst", "id")
    ends = own.select(F.col("src").alias("id")).unionByName(own.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    return own.join(ends.select(F.col("id").alias("src"), F.col("degree").alias("src_degree")), "src").join(ends.select(F.col("id").alias("dst"), F.col("degree").alias("dst_degree")), "dst")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, degree, centrality) on the simple undirected graph; in_degree on the directed one."""
    simple = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    deg = simple.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    n = deg.agg(F.count("*").alias("n"))
    out = deg.join(into, "id", "left").join(F.broadcast(n))  # one row
    return out.select("id", F.coalesce("in_degree", F.lit(0).cast("bigint")).alias("in_degree"), "degree", F.round(F.col("degree") / F.greatest(F.col("n") - 1, F.lit(1)), 6).alias("centrality"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id that can be reached, by alternating large-star and small-star steps."""
    pairs = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    mark = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = cut(large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        mark = now


def canonical(members: DataFrame, links: str, name: str) -> DataFrame:
    """(root, keeper): of each component the member with most links, then the shortest name, then the smallest id."""
    w = Window.partitionBy("root").orderBy(F.col(links).desc(), F.length(name), "id")
    return members.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("root", F.col("id").alias("keeper"))


def repointed(edges: DataFrame, mapping: DataFrame, drop_loops: bool = False) -> DataFrame:
    """Edges with both ends replaced by mapping (id, keeper), each once."""
    m = mapping.select("id", "keeper")
    out = edges.select("src", "dst").join(m.select(F.col("id").alias("src"), F.col("keeper").alias("s")), "src", "left").join(m.select(F.col("id").alias("dst"), F.col("keeper").alias("t")), "dst", "left")
    out = out.select(F.coalesce("s", "src").alias("src"), F.coalesce("t", "dst").alias("dst")).distinct()
    return out.where("src <> dst") if drop_loops else out


def weighted(pairs: DataFrame, directed: DataFrame, extra: float = 2.0) -> DataFrame:
    """(a, b, w): co-occurrence weights plus `extra` per directed edge, on unordered pairs."""
    one = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("w").cast("double").alias("w"))
    two = directed.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.lit(extra).alias("w"))
    return one.unionByName(two).groupBy("a", "b").agg(F.sum("w").alias("w"))


def hubs(adjacency: DataFrame, k: int) -> DataFrame:
    ends = adjacency.select(F.explode(F.array("a", "b")).alias("id"), "w")
    return ends.groupBy("id").agg(F.sum("w").alias("w")).orderBy(F.col("w").desc(), "id").limit(k)


def communities(adjacency: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community) by weighted label propagation: each node takes its neighbours' heaviest label, ties to the smallest."""
    links = adjacency.select("a", "b", "w").unionByName(adjacency.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    links = cut(links)
    labels = cut(links.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id")))
    for step in range(rounds):
        votes = links.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("a").agg(F.min(F.struct((-F.col("w")).alias("m"), "label"))["label"].alias("next"))
        # Half of the nodes move in a round, so that two sides of a graph don't swap labels for ever.
        moved = labels.join(best, labels["id"] == best["a"], "left").select("id", "label", F.when(F.pmod(F.xxhash64("id", F.lit(step)), F.lit(2)) == 0, F.coalesce("next", "label")).otherwise(F.col("label")).alias("next"))
        moved = cut(moved)
        labels = moved.select("id", F.col("next").alias("label"))
    return labels.select("id", F.col("label").alias("community"))


def modularity(links: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of labels (id, label) on links (a, b, w) that hold both directions; 0 for no links."""
    at = links.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
    parts = at.groupBy("la").agg(F.sum("w").alias("all"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0.0)).alias("own"))
    whole, own, squares = parts.agg(F.sum("all"), F.sum("own"), F.sum(F.col("all") * F.col("all"))).first()
    return own / whole - resolution * squares / whole**2 if whole else 0.0


def _labelled(links: DataFrame, labels: DataFrame) -> DataFrame:
    """links with la and lb, the labels of their ends."""
    return links.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")


def _settle(links: DataFrame, resolution: float, rounds: int, labels: DataFrame | None = None, inside: DataFrame | None = None) -> DataFrame:
    """(id, label): each node in the community that gains most, by rounds in which about half of the nodes may move.

    Nodes begin alone or with `labels`; with `inside` (id, label) they join neighbours of their own label there only.
    """
    nodes = links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k"))
    nodes = stored(nodes.withColumn("label", F.col("id")) if labels is None else nodes.join(labels, "id"))
    if inside is not None:
        links = stored(_labelled(links, inside).where("la = lb").select("a", "b", "w"))
    whole = nodes.agg(F.sum("k")).first()[0] or 1.0
    still = 0
    for step in range(rounds):
        sizes = nodes.groupBy("label").agg(F.sum("k").alias("all"), F.count("*").alias("n"))
        near = links.where("a <> b").join(nodes.select(F.col("id").alias("b"), "label"), "b").select(F.col("a").alias("id"), "label", "w")
        near = near.unionByName(nodes.select("id", "label", F.lit(0.0).alias("w")))  # staying is a choice
        votes = near.groupBy("id", "label").agg(F.sum("w").alias("w")).join(sizes, "label").join(nodes.select("id", "k", F.col("label").alias("old")), "id")
        own = F.col("label") == F.col("old")
        gain = F.col("w") - resolution * F.col("k") * (F.col("all") - F.when(own, F.col("k")).otherwise(0.0)) / whole
        best = votes.groupBy("id", "k", "old").agg(
            F.min(F.struct((-F.round(gain, 9)).alias("g"), (~own).alias("far"), "label", "n")).alias("x"), F.max(F.when(own, F.col("n"))).alias("n"))
        # Of two single nodes that would change places only one moves.
        free = (F.pmod(F.xxhash64("id", F.lit(step)), F.lit(2)) == 0) & ~((F.col("n") == 1) & (F.col("x.n") == 1) & (F.col("x.label") > F.col("old")))
        nodes = stored(best.select("id", "k", F.when(free, F.col("x.label")).otherwise(F.col("old")).alias("label"), "old"))
        moved = nodes.where("label <> old").count()
        nodes = nodes.drop("old")
        still = 0 if moved else still + 1
        if still == 2:
            break
    return nodes.select("id", "label")


def modular_communities(adjacency: DataFrame, min_size: int = 1, resolution: float = 1.0, levels: int = 4, rounds: int = 8) -> DataFrame:
    """(id, community) of communities with at least min_size nodes, by greedy modularity on a graph that shrinks level by level.

    adjacency: (a, b, w), undirected; a community is named by its smallest node. A level that does
    not raise the modularity is given up and ends the search. Every step is a join or an aggregate.
    """
    way = adjacency.select("a", "b", F.col("w").cast("double").alias("w"))
    links = stored(way.unionByName(way.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w")))
    members = stored(links.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id")))
    best = modularity(links, members, resolution)
    for _ in range(levels):
        labels = _settle(links, resolution, rounds)
        value = modularity(links, labels, resolution)
        if value <= best + 1e-9:
            break
        best = value
        members = stored(members.withColumnRenamed("label", "_l").join(labels.withColumnRenamed("id", "_l"), "_l").select("id", "label"))
        links = stored(_labelled(links, labels).groupBy(F.col("la").alias("a"), F.col("lb").alias("b")).agg(F.sum("w").alias("w")))
    named = members.groupBy("label").agg(F.min("id").alias("community"), F.count("*").alias("n")).where(F.col("n") >= min_size)
    return members.join(named, "label").select("id", "community")


def _whole(links: DataFrame, labels: DataFrame) -> DataFrame:
    """labels with each community's connected parts as communities of their own, named by their smallest node."""
    own = _labelled(links.where("a < b"), labels).where("la = lb").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return stored(labels.select("id").join(components(own), "id", "left").select("id", F.coalesce("root", "id").alias("label")))


def leiden(adjacency: DataFrame, min_size: int = 1, resolution: float = 1.0, levels: int = 2, rounds: int = 6) -> DataFrame:
    """(id, community) by moving, refining and shrinking, level by level; every community is connected.

    The search begins with modular_communities. Nodes move to the community that gains most (RB configuration). Then each community is refined: its
    nodes begin alone again and join each other inside of it only, and what does not hang together is
    parted. The graph shrinks to the refined parts, which begin the next level in the community that
    they came from, so that a part can still leave it. adjacency: (a, b, w), undirected. Every step is
    a join or an aggregate; a level that doesn't raise the modularity ends the search.
    """
    way = adjacency.select("a", "b", F.col("w").cast("double").alias("w"))
    links = stored(way.unionByName(way.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w")))
    place = stored(links.select(F.col("a").alias("id")).distinct().withColumn("node", F.col("id")))
    labels = stored(modular_communities(adjacency, 1, resolution).select("id", F.col("community").alias("label")))
    members, best = labels, -1.0
    for _ in range(levels):
        tried = [_whole(links, labels), _whole(links, _settle(links, resolution, rounds, labels))]
        values = [modularity(links, t, resolution) for t in tried]
        value, parts = max(values), tried[values.index(max(values))]
        if value <= best + 1e-9:
            break
        best = value
        members = stored(place.join(parts.select(F.col("id").alias("node"), "label"), "node").select("id", "label"))
        refined = _whole(links, _settle(links, resolution, rounds, inside=parts))
        place = stored(place.join(refined.select(F.col("id").alias("node"), F.col("label").alias("to")), "node").select("id", F.col("to").alias("node")))
        came = refined.withColumnRenamed("label", "to").join(parts, "id")
        name = came.groupBy("label").agg(F.min("to").alias("name"))
        labels = stored(came.join(name, "label").select(F.col("to").alias("id"), F.col("name").alias("label")).distinct())
        links = stored(_labelled(links, refined).groupBy(F.col("la").alias("a"), F.col("lb").alias("b")).agg(F.sum("w").alias("w")))
    named = members.groupBy("label").agg(F.min("id").alias("community"), F.count("*").alias("n")).where(F.col("n") >= min_size)
    return members.join(named, "label").select("id", "community")


def betweenness_by_levels(edges: DataFrame, states: int = 20_000_000) -> DataFrame:
    """(id, betweenness) as betweenness() gives it, for graphs of any size: searches of many sources at once, level by level, as joins.

    A level holds (source, node, number of shortest paths). In an undirected graph the next one has only
    nodes that aren't in the last two, so that no table of all seen nodes is kept. Dependencies go back
    along the same levels. Sources are dealt in batches, so that one holds `states` rows at most.
    """
    simple = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    links = stored(simple.unionByName(simple.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    nodes = stored(links.select(F.col("a").alias("id")).distinct())
    n = nodes.count()
    batches, sums = max(1, -(-n * n // states)), []
    for batch in range(batches):
        front = stored(nodes.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == batch).select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")))
        levels = [front]
        while not front.isEmpty():
            step = front.withColumnRenamed("v", "a").join(links, "a").groupBy("s", F.col("b").alias("v")).agg(F.sum("paths").alias("paths"))
            for near in levels[-2:]:
                step = step.join(near.select("s", "v"), ["s", "v"], "left_anti")
            front = stored(step)
            levels.append(front)
        depend = levels.pop().select("s", "v", F.lit(0.0).alias("d"))  # empty
        for far, near in zip(reversed(levels[1:]), reversed(levels[:-1]), strict=True):
            own = stored(far.join(depend, ["s", "v"], "left").select("s", "v", "paths", F.coalesce("d", F.lit(0.0)).alias("d")))
            sums.append(own.groupBy(F.col("v").alias("id")).agg(F.sum("d").alias("d")))
            share = own.select("s", F.col("v").alias("a"), ((1 + F.col("d")) / F.col("paths")).alias("part")).join(links, "a").select("s", F.col("b").alias("v"), "part")
            depend = share.join(near, ["s", "v"]).groupBy("s", "v").agg(F.sum(F.col("part") * F.col("paths")).alias("d"))
        sums = [stored(_sum(sums))] if sums else []
    total = sums[0] if sums else nodes.select("id", F.lit(0.0).alias("d"))
    return nodes.join(total, "id", "left").select("id", F.round(F.coalesce("d", F.lit(0.0)) / 2, 4).alias("betweenness"))


def _sum(parts: list[DataFrame]) -> DataFrame:
    """(id, d): the sums of d over all parts."""
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every.groupBy("id").agg(F.sum("d").alias("d"))


def betweenness(edges: DataFrame) -> DataFrame:
    """(id, betweenness) of the simple undirected graph, exact: one search per source, sources dealt over the tasks.

    The adjacency of up to LOCAL_EDGES edges goes to every task; a larger graph is searched by joins.
    """
    simple = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    rows = simple.limit(LOCAL_EDGES + 1).toPandas()
    if len(rows) > LOCAL_EDGES:
        return betweenness_by_levels(edges)
    near: dict[int, list[int]] = {}
    for a, b in zip(rows["a"].tolist(), rows["b"].tolist(), strict=True):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    shared = edges.sparkSession.sparkContext.broadcast(near)
    nodes = simple.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def run(batches):
        near, total = shared.value, {}
        for batch in batches:
            for s in batch["id"].tolist():
                order, paths, far, parents = [], {s: 1.0}, {s: 0}, {s: []}
                queue = [s]
                for v in queue:
                    order.append(v)
                    for w in near[v]:
                        if w not in far:
                            far[w], paths[w], parents[w] = far[v] + 1, 0.0, []
                            queue.append(w)
                        if far[w] == far[v] + 1:
                            paths[w] += paths[v]
                            parents[w].append(v)
                depend = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in parents[w]:
                        depend[v] += paths[v] / paths[w] * (1 + depend[w])
                    if w != s:
                        total[w] = total.get(w, 0.0) + depend[w]
        yield pd.DataFrame({"id": list(total), "b": list(total.values())})

    sums = nodes.mapInPandas(run, "id bigint, b double").groupBy("id").agg(F.sum("b").alias("b"))
    return nodes.join(sums, "id", "left").select("id", F.round(F.coalesce("b", F.lit(0.0)) / 2, 4).alias("betweenness"))


def fiedler(adjacency: DataFrame) -> tuple[float, pd.DataFrame]:
    """Second eigenvalue of the normalised Laplacian and the sign of its vector per node; for up to LOCAL_EDGES edges.

    Lanczos steps on the edge list, so that memory grows with nodes and edges and not with their square.
    """
    rows = adjacency.limit(LOCAL_EDGES + 1).toPandas()
    if len(rows) > LOCAL_EDGES:
        raise ValueError(f"the spectrum is for graphs of up to {LOCAL_EDGES} edges")
    ids = np.unique(rows[["a", "b"]].to_numpy())
    a, b = np.searchsorted(ids, rows["a"]), np.searchsorted(ids, rows["b"])
    n, w = len(ids), rows["w"].to_numpy(float)
    total = np.bincount(a, w, n) + np.bincount(b, w, n)
    w = w / np.sqrt(np.maximum(total[a] * total[b], 1e-24))
    first = np.sqrt(total) / max(1e-12, float(np.sqrt(total.sum())))  # the vector of eigenvalue 0

    def times(v: np.ndarray) -> np.ndarray:
        """(1 + normalised adjacency) v without the part along `first`: its largest eigenvalue is 2 less the second of the Laplacian."""
        out = v + np.bincount(a, w * v[b], n) + np.bincount(b, w * v[a], n)
        return out - first * (first @ out)

    v = np.random.default_rng(0).standard_normal(n)
    value = 0.0
    for _ in range(LANCZOS_ROUNDS):
        v = v - first * (first @ v)
        v = v / max(1e-12, float(np.linalg.norm(v)))
        basis = [v]
        while len(basis) < min(LANCZOS_STEPS, n - 1):
            q = np.array(basis)
            x = times(basis[-1])
            for _ in range(2):  # twice, against rounding
                x = x - q.T @ (q @ x)
            size = float(np.linalg.norm(x))
            if size < 1e-10:
                break
            basis.append(x / size)
        q = np.array(basis)
        inside, vectors = np.linalg.eigh(q @ np.array([times(x) for x in basis]).T)
        value, v = float(inside[-1]), vectors[:, -1] @ q
        if np.linalg.norm(times(v) - value * v) < 1e-8:
            break
    return 2.0 - value, pd.DataFrame({"id": ids, "side": np.sign(v)})


def chains(edges: DataFrame, longest: int = 4) -> DataFrame:
    """Directed paths of at least three nodes from nodes without predecessors, no node twice, none that another one begins with."""
    links = edges.select("src", "dst").distinct()
    starts = links.select("src").distinct().join(links.select(F.col("dst").alias("src")), "src", "left_anti")
    paths = starts.select(F.array("src").alias("path"))
    done = None
    for _ in range(longest - 1):
        step = paths.withColumn("src", F.element_at("path", -1)).join(links, "src", "left")
        going = step.where(F.col("dst").isNotNull() & ~F.coalesce(F.array_contains("path", F.col("dst")), F.lit(False))).select(F.concat("path", F.array("dst")).alias("path"))
        ended = step.where(F.col("dst").isNull()).select("path")
        done = ended if done is None else done.unionByName(ended)
        paths = going
    return done.unionByName(paths).where(F.size("path") >= 3).distinct()


def all_chains(edges: DataFrame) -> DataFrame:
    """(path) of every way from a node without predecessors on to its end, of at least three nodes; without a bound on its length.

    A path ends at a node without successors, or with the first node that it meets again. If every node has a
    predecessor, the smallest node begins. No path is part of another one: it begins with a node that has no
    predecessor, and where it ends nothing goes on. Null ends are no edges. There are as many rows as ways, which
    in dense graphs is many; each step is a join of the growing paths with the edges.
    """
    links = stored(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    starts = links.select("src").distinct().join(links.select(F.col("dst").alias("src")), "src", "left_anti")
    if starts.isEmpty():
        starts = links.agg(F.min(F.least("src", "dst")).alias("src")).where("src is not null")
    going, done = stored(starts.select(F.array("src").alias("path"))), []
    while not going.isEmpty():
        step = stored(going.withColumn("src", F.element_at("path", -1)).join(links, "src", "left").select(
            F.when(F.col("dst").isNull(), F.col("path")).otherwise(F.concat("path", F.array("dst"))).alias("path"),
            (F.col("dst").isNull() | F.array_contains("path", F.col("dst"))).alias("ends")))
        done.append(step.where("ends and size(path) >= 3").select("path"))
        going = step.where("not ends").select("path")
    out = going if not done else done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
