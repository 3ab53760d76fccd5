"""Graph measures (O61-O67, O20, O58) of the simple graph of a triple set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokes.operators.triples import inferred_pairs, undirected_edges, unique_entities
from spokes.storage import drop_saved, save

#: Kernels hold the adjacency of one graph or component in memory up to so many edges.
MOST_EDGES = 5_000_000
#: Node colours by community.
PALETTE = ["#e41a1c", "#377eb8", "#4daf4a", "#984ea3", "#ff7f00", "#ffff33", "#a65628", "#f781bf"]


def degree(triples: DataFrame) -> DataFrame:
    """(node, degree) in the simple undirected graph; a self-loop counts two."""
    e = undirected_edges(triples)
    return e.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def _numbered(edges: DataFrame):
    """(names, neighbours by index) on the driver or in a task, after a check of the size."""
    import numpy as np

    if edges.limit(MOST_EDGES + 1).count() > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} edges: run by component, or pass fewer")
    t = edges.toArrow()
    a, b = (np.array(t.column(k).to_pylist(), object) for k in ("a", "b"))
    names = sorted(set(a) | set(b))
    at = {n: i for i, n in enumerate(names)}
    near: list[set[int]] = [set() for _ in names]
    for x, y in zip(a, b, strict=True):
        if x != y:
            near[at[x]].add(at[y])
            near[at[y]].add(at[x])
    return names, [sorted(s) for s in near]


def betweenness(triples: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(node, betweenness): shortest paths through a node, normalized for the whole graph.

    Sources are dealt to tasks, each of which walks the graph from its own and adds
    up; the adjacency is sent to them, up to MOST_EDGES edges. ``sources`` (node)
    restricts the walks, for graphs on which all of them take too long.
    """
    spark = triples.sparkSession
    names, near = _numbered(undirected_edges(triples))
    n = len(names)
    sent = spark.sparkContext.broadcast((names, near))
    nodes = spark.range(n).withColumnRenamed("id", "at")
    if sources is not None:
        index = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "node string, at long")
        nodes = index.join(sources, "node", "left_semi").select("at")

    def walk(batches):
        import numpy as np
        import pyarrow as pa

        names, near = sent.value
        total = np.zeros(len(names))
        for batch in batches:
            for s in batch.column(0).to_pylist():
                dist, paths, order, before = {s: 0}, {s: 1.0}, [s], {s: []}
                for v in order:
                    for w in near[v]:
                        if w not in dist:
                            dist[w], paths[w], before[w] = dist[v] + 1, 0.0, []
                            order.append(w)
                        if dist[w] == dist[v] + 1:
                            paths[w] += paths[v]
                            before[w].append(v)
                owed = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in before[w]:
                        owed[v] += paths[v] / paths[w] * (1 + owed[w])
                    if w != s:
                        total[w] += owed[w]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in some], pa.string()), pa.array(total[some], pa.float64())], names=["node", "part"])

    parts = nodes.mapInArrow(walk, "node string, part double").groupBy("node").agg(F.sum("part").alias("part"))
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return unique_entities(triples).withColumnRenamed("entity", "node").join(parts, "node", "left").select("node", (F.coalesce("part", F.lit(0.0)) * scale).alias("betweenness"))


def eigenvector(triples: DataFrame, rounds: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """(node, eigenvector) by power iteration on A + I; 0.5 for all nodes if it doesn't converge or there is no edge."""
    import numpy as np

    spark = triples.sparkSession
    e = undirected_edges(triples)
    nodes = unique_entities(triples).withColumnRenamed("entity", "node")
    if e.limit(MOST_EDGES + 1).count() <= MOST_EDGES:
        t = e.toArrow()
        a, b = t.column("a").to_pylist(), t.column("b").to_pylist()
        names = sorted({*a, *b})
        at = {x: i for i, x in enumerate(names)}
        i, j = (np.array([at[x] for x in c], np.int64) for c in (a, b))
        loop = i == j
        n = len(names)
        x = np.full(n, 1 / max(n, 1))
        for _ in range(rounds):
            y = x + np.bincount(i, x[j], n) + np.bincount(j[~loop], x[i[~loop]], n)
            y /= np.linalg.norm(y) or 1
            done, x = np.abs(y - x).sum() < n * tolerance, y
            if done:
                return spark.createDataFrame([(k, float(v)) for k, v in zip(names, x, strict=True)], "node string, eigenvector double")
        return nodes.withColumn("eigenvector", F.lit(0.5))
    both = save(e.union(e.where("a <> b").select("b", "a")).toDF("node", "near"), "adjacency")
    n = nodes.count()
    x = save(nodes.withColumn("x", F.lit(1.0 / n)), "vector")
    for _ in range(rounds):
        step = both.join(x.withColumnRenamed("node", "near"), "near").groupBy("node").agg(F.sum("x").alias("s"))
        raw = save(x.join(step, "node", "left").select("node", F.col("x").alias("old"), (F.col("x") + F.coalesce("s", F.lit(0.0))).alias("y")), "vector")
        norm = raw.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0] or 1.0
        change = raw.agg(F.sum(F.abs(F.col("y") / norm - F.col("old")))).first()[0]
        drop_saved(x)
        x = raw.select("node", (F.col("y") / norm).alias("x"))
        if change < n * tolerance:
            return x.withColumnRenamed("x", "eigenvector")
    return nodes.withColumn("eigenvector", F.lit(0.5))


def louvain(triples: DataFrame, components: DataFrame) -> DataFrame:
    """(node, community) that raises modularity; communities never cross components, so each is solved alone.

    Nodes are visited by name, and a move needs a gain over 1e-12; of equal gains the
    least community wins. A community is named by its least node.
    """
    e = undirected_edges(triples).where("a <> b")
    m = e.count()
    keyed = e.join(components.withColumnRenamed("node", "a"), "a").select("component", "a", "b")

    def solve(pdf):
        import pandas as pd

        names = sorted({*pdf["a"], *pdf["b"]})
        at = {x: i for i, x in enumerate(names)}
        graph: list[dict[int, float]] = [{} for _ in names]
        for x, y in zip(pdf["a"], pdf["b"], strict=True):
            graph[at[x]][at[y]] = graph[at[y]][at[x]] = 1.0
        member = list(range(len(names)))
        while True:
            weight = [sum(g.values()) for g in graph]
            home, total = list(range(len(graph))), list(weight)
            moved_ever = moved = True
            moved_ever = False
            while moved:
                moved = False
                for v, g in enumerate(graph):
                    to: dict[int, float] = {}
                    for w, k in g.items():
                        if w != v:
                            to[home[w]] = to.get(home[w], 0.0) + k
                    own = home[v]
                    total[own] -= weight[v]
                    gain = lambda c: to.get(c, 0.0) - total[c] * weight[v] / (2 * m)  # noqa: B023, E731
                    best = own
                    for c in sorted(to):
                        if gain(c) > gain(best) + 1e-12:
                            best = c
                    total[best] += weight[v]
                    if best != own:
                        home[v], moved, moved_ever = best, True, True
            if not moved_ever:
                break
            label = {c: i for i, c in enumerate(dict.fromkeys(home))}
            merged: list[dict[int, float]] = [{} for _ in label]
            for v, g in enumerate(graph):
                for w, k in g.items():
                    a, b = label[home[v]], label[home[w]]
                    merged[a][b] = merged[a].get(b, 0.0) + k
            member = [label[home[c]] for c in member]
            graph = merged
        least: dict[int, str] = {}
        for x, c in zip(names, member, strict=True):
            least.setdefault(c, x)
        return pd.DataFrame({"node": names, "community": [least[c] for c in member]})

    found = keyed.groupBy("component").applyInPandas(solve, "node string, community string")
    nodes = unique_entities(triples).withColumnRenamed("entity", "node")
    return nodes.join(found, "node", "left").select("node", F.coalesce("community", "node").alias("community"))


def degree_communities(triples: DataFrame) -> DataFrame:
    """O64's fallback: degree modulo eight."""
    return degree(triples).select("node", F.pmod(F.col("degree"), F.lit(8)).cast("int").alias("community"))


def numbered_communities(communities: DataFrame) -> DataFrame:
    """(node, community) with numbers from 0 by the least node of each."""
    from pyspark.sql import Window

    names = communities.select("community").distinct().withColumn("k", F.row_number().over(Window.orderBy("community")) - 1)
    return communities.join(names, "community").select("node", F.col("k").cast("int").alias("community"))


def node_sizes(nodes: DataFrame) -> DataFrame:
    """``nodes`` (node, degree, betweenness, eigenvector) with ``size`` from 10 to 30."""
    top = nodes.agg(*(F.max(c).alias(f"max_{c}") for c in ("degree", "betweenness", "eigenvector")))
    part = lambda c: F.coalesce(F.try_divide(F.col(c), F.nullif(F.col(f"max_{c}"), F.lit(0))), F.lit(0.0))
    both = nodes.withColumn("_k", F.lit(1)).join(top.withColumn("_k", F.lit(1)), "_k")
    return both.select(*nodes.columns, (10 + 20 * (0.5 * part("degree") + 0.3 * part("betweenness") + 0.2 * part("eigenvector"))).alias("size"))


def node_view(triples: DataFrame, components: DataFrame) -> DataFrame:
    """One row per node with its measures, community, colour, size and tooltip."""
    base = unique_entities(triples).withColumnRenamed("entity", "node")
    both = base.join(degree(triples), "node", "left").join(betweenness(triples), "node", "left").join(eigenvector(triples), "node", "left")
    full = both.select("node", F.coalesce("degree", F.lit(1)).alias("degree"), F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"), F.coalesce("eigenvector", F.lit(0.0)).alias("eigenvector"))
    sized = node_sizes(full).join(numbered_communities(louvain(triples, components)), "node", "left").withColumn("community", F.coalesce("community", F.lit(0)))
    return sized.withColumns({"color": color(F.col("community")), "title": F.concat("node", F.lit(" - Connections: "), F.col("degree").cast("string"))})


def color(community):
    return F.element_at(F.array(*map(F.lit, PALETTE)), F.pmod(community, F.lit(len(PALETTE))).cast("int") + 1)


def stats(triples: DataFrame, communities: DataFrame) -> DataFrame:
    """One row; original edges are all rows less the distinct inferred pairs, as the statistic is defined."""
    one = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("_k", F.lit(1))
    parts = [one(unique_entities(triples), "nodes"), one(triples, "edges"), one(inferred_pairs(triples), "inferred_edges"), one(communities.select("community").distinct(), "communities")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "_k")
    return out.select("nodes", "edges", (F.col("edges") - F.col("inferred_edges")).alias("original_edges"), "inferred_edges", "communities")
