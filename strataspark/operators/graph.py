"""Graphs as edge tables: components, spanning trees, cliques, cycles, triangles."""

from __future__ import annotations

import atexit
import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _shared_top(spark: SparkSession) -> str:
    """The application's folder below the one that spark.checkpoint.dir names, which driver and executors share. A
    temporary one only where none is named and they are one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = _OWN.setdefault("top", tempfile.mkdtemp(prefix="strataspark-"))
    top = f"{named if re.match('[a-z0-9]+:', named) else 'file://' + named}/tables-{spark.sparkContext.applicationId}"
    if top not in _OWN:
        _OWN[top] = top
        atexit.register(_remove, spark, top)
    return top


_OWN: dict[str, str] = {}


def _remove(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended; its folder then stays
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder. A checkpoint would keep the plan's estimate of its size, which
    multiplies at every join of a loop; a table has the size of its files."""
    path = f"{_shared_top(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by a key into as many parts as shuffles have. Adaptive execution puts small parts together, by bytes;
    groups that take long for their bytes would be one task's work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def undirected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct edges a < b, without loops."""
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()


def _to_least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) -> (u, v, m) with m the least of u and its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return pairs.join(least, pairs.u == least.k).select("u", "v", "m")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the least node reachable. nodes: a column node that also gets its own component.

    Alternating steps: each greater neighbour of a node is joined to the least node that it knows (large star), then
    the lesser neighbours and the node itself are (small star). The edges end as stars around the least node of each
    component, in a logarithmic number of rounds on paths too."""
    e = undirected(edges)
    e = cut_lineage(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _to_least(large)
        e = cut_lineage(small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    if nodes is None:
        return found
    alone = nodes.select("node").where("node IS NOT NULL").distinct().join(found.select("node"), "node", "left_anti")
    return found.unionByName(alone.withColumn("component", F.col("node")))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), a < b < c, for every three nodes that are all joined. Edges point from the node of lesser degree,
    so that no node has more out-edges than the square root of twice their number."""
    e = undirected(edges)
    degree = e.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("deg"))
    ranked = e.join(degree.select(F.col("node").alias("a"), F.col("deg").alias("da")), "a").join(degree.select(F.col("node").alias("b"), F.col("deg").alias("db")), "b")
    swap = F.struct("da", "a") > F.struct("db", "b")
    out = ranked.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("u"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("v"))
    first, second = out.select("u", F.col("v").alias("p")), out.select("u", F.col("v").alias("q"))
    wedge = first.join(second, "u").where(F.col("p") < F.col("q"))
    closed = wedge.join(e.select(F.col("a").alias("p"), F.col("b").alias("q")), ["p", "q"])
    three = F.sort_array(F.array("u", "p", "q"))
    return closed.select(three[0].alias("a"), three[1].alias("b"), three[2].alias("c"))


def _kruskal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The spanning forest's edges among all of a task's."""
    parent: dict = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    held = list(batches)
    if not held:
        return
    e = pd.concat(held).sort_values(["w", "a", "b"])
    kept = []
    for a, b in zip(e["a"].tolist(), e["b"].tolist(), strict=True):
        x, y = find(a), find(b)
        kept.append(x != y)
        parent[x] = y
    yield e[kept]


def spanning_forest(edges: DataFrame, most_small: int = 0) -> DataFrame:
    """Edges (a, b, w) of a minimum spanning forest by Boruvka's rounds, ties by (w, a, b). Each round contracts the
    graph: the edges are then between components, the least one for each two. most_small: number of edges (between
    whole numbers) up to which one task sorts and settles them."""
    e = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").where("a < b").groupBy("a", "b").agg(F.min("w").alias("w")))
    if most_small and e.count() <= most_small:
        return e.coalesce(1).mapInPandas(_kruskal, "a long, b long, w double")
    left = e.select(F.col("a").alias("p"), F.col("b").alias("q"), F.struct("w", "a", "b").alias("e"))
    chosen = []
    while left.limit(1).count():
        new = cut_lineage(left.select(F.explode(F.array("p", "q")).alias("c"), "p", "q", "e").groupBy("c").agg(F.min(F.struct("e", "p", "q")).alias("m")).select("m.*").distinct())
        chosen.append(new.select("e.a", "e.b", "e.w"))
        label = cut_lineage(components(new.select(F.col("p").alias("a"), F.col("q").alias("b"))))
        to = lambda c, label=label: label.select(F.col("node").alias(c), F.col("component").alias(f"{c}2"))
        moved = left.join(to("p"), "p").join(to("q"), "q").where("p2 <> q2")
        left = cut_lineage(moved.groupBy(F.least("p2", "q2").alias("p"), F.greatest("p2", "q2").alias("q")).agg(F.min("e").alias("e")))
    return functools.reduce(DataFrame.unionByName, chosen, e.limit(0)).select("a", "b", "w")


def signs(tree: DataFrame, root_of: DataFrame, flip: str = "flip") -> DataFrame:
    """(node, sign): products of the edges' flips (+1, -1) along the tree's paths from the roots (column node, one a
    tree). Every node stands twice, once a sign, and an edge joins what goes together: a tree then has two components,
    and a node's sign is told by the one that it is in. Trees of any depth take a logarithmic number of rounds."""
    at = lambda c, s: F.struct(F.col(c).alias("node"), F.lit(s).alias("side"))
    pairs = F.explode(F.when(F.col(flip) > 0, F.array(*[F.struct(at("a", s).alias("a"), at("b", s).alias("b")) for s in (0, 1)])).otherwise(F.array(*[F.struct(at("a", s).alias("a"), at("b", 1 - s).alias("b")) for s in (0, 1)]))).alias("e")
    alone = root_of.select(at("node", 0).alias("node"))
    label = cut_lineage(components(tree.select(pairs).select("e.a", "e.b"), alone))
    plus = label.where("node.side = 0").select("node.node", F.col("component.node").alias("tree"), (1 - 2 * F.col("component.side")).alias("sign"))
    rooted = plus.join(root_of.select("node"), "node").select("tree", F.col("sign").alias("root_sign"))
    return plus.join(rooted, "tree").select("node", (F.col("sign") * F.col("root_sign")).cast("int").alias("sign"))


def _neighbours(pdf: pd.DataFrame) -> dict:
    out: dict = {}
    for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def cliques_of(adjacent: dict, least: int, base: tuple = (), may: set | None = None, done: set | None = None) -> list[list]:
    """Maximal cliques of at least `least` nodes that hold the nodes of base: extended by nodes of `may` (all by
    default), and maximal if no node of `done` joins all of them. Branches leave out the neighbours of a node of many
    candidates."""
    found: list[list] = []
    stack = [(list(base), set(adjacent) if may is None else set(may), set(done or ()))]
    while stack:
        clique, may, done = stack.pop()
        if not may:
            if not done and len(clique) >= least:
                found.append(sorted(clique))
            continue
        pivot = max(sorted(may | done), key=lambda v: len(may & adjacent[v]))
        for v in sorted(may - adjacent[pivot]):
            stack.append(([*clique, v], may & adjacent[v], done & adjacent[v]))
            may, done = may - {v}, done | {v}
    return sorted(found, key=lambda c: (-len(c), c))


def maximal_cliques(edges: DataFrame, least: int = 3) -> DataFrame:
    """(component, clique) for every maximal clique of at least `least` nodes (two or more).

    Nodes are in order of degree, and a node's task finds the cliques in which it comes first: among its later
    neighbours, of which there are no more than the square root of twice the number of edges, less those that an earlier
    neighbour joins. What a task needs to know, the edges between a node's neighbours, are the graph's triangles."""
    e = cut_lineage(undirected(edges).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("deg")))
    side = lambda n: degree.select(F.col("node").alias(n), F.struct("deg", "node").alias(f"r_{n}"))
    beside = both.join(side("a"), "a").join(side("b"), "b").select(F.col("a").alias("v"), F.col("b").alias("p"), (F.col("r_b") > F.col("r_a")).alias("later"))
    firsts = cut_lineage(beside.groupBy("v").agg(F.count(F.when(F.col("later"), 1)).alias("n")).where(F.col("n") >= least - 1).select("v"))
    around = triangles(e).select(F.explode(F.array(*[F.struct(F.col(v).alias("v"), F.col(p).alias("p"), F.col(q).alias("q")) for v, p, q in ("abc", "bac", "cab")])).alias("t")).select("t.*")
    rows = beside.select("v", "p", F.lit(None).cast("long").alias("q"), "later").unionByName(around.withColumn("later", F.lit(None).cast("boolean"))).join(firsts, "v", "left_semi")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = int(pdf["v"].iloc[0])
        own, between = pdf[pdf["q"].isna()], pdf[pdf["q"].notna()]
        adjacent: dict = {int(p): set() for p in own["p"]}
        for p, q in zip(between["p"].astype("int64"), between["q"].astype("int64"), strict=True):
            adjacent[p].add(q)
            adjacent[q].add(p)
        later = own["later"].astype(bool)
        found = cliques_of(adjacent, least, (v,), set(own["p"][later].astype("int64")), set(own["p"][~later].astype("int64")))
        return pd.DataFrame({"first": [v] * len(found), "clique": pd.Series(found, dtype=object)})

    found = cut_lineage(rows.groupBy("v").applyInPandas(run, "first long, clique array<long>"))
    label = components(e).select(F.col("node").alias("first"), "component")
    return found.join(label, "first").select("component", "clique")


def exclusive_cliques(edges: DataFrame, least: int = 3) -> DataFrame:
    """(block_id, component, clique): cliques taken greedily, largest first, each less what is taken, while at least
    `least` nodes are left. Block ids count over components, then the order of taking. The order of taking makes a
    component's cliques one task's work; they are found by maximal_cliques()."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set = set()
        rows = []
        for clique in sorted((list(map(int, c)) for c in pdf["clique"]), key=lambda c: (-len(c), c)):
            free = [v for v in clique if v not in used]
            if len(free) >= least:
                used.update(free)
                rows.append(free)
        return pd.DataFrame({"component": [pdf["component"].iloc[0]] * len(rows), "place": list(range(len(rows))), "clique": pd.Series(rows, dtype=object)})

    taken = maximal_cliques(edges, least).groupBy("component").applyInPandas(run, "component long, place int, clique array<long>")
    return taken.withColumn("block_id", F.row_number().over(Window.orderBy("component", "place")) - 1).select("block_id", "component", "clique")


def cycles(edges: DataFrame, longest: int = 8) -> DataFrame:
    """(nodes) for every simple cycle of 3 to `longest` nodes, once: from its least node, towards the lesser of that
    node's two neighbours. Paths grow by one equi-join a step and keep only nodes greater than their start."""
    e = undirected(edges)
    both = cut_lineage(e.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(e.select(F.col("b").alias("src"), F.col("a").alias("dst"))))
    path = e.select(F.array("a", "b").alias("nodes"))
    found = None
    for _ in range(longest - 2):
        step = path.join(both, F.element_at("nodes", -1) == F.col("src")).where((F.col("dst") > F.col("nodes")[0]) & ~F.array_contains("nodes", F.col("dst")))
        path = step.select(F.concat("nodes", F.array("dst")).alias("nodes"))
        closed = path.join(both, (F.element_at("nodes", -1) == F.col("src")) & (F.col("nodes")[0] == F.col("dst"))).where(F.col("nodes")[1] < F.element_at("nodes", -1)).select("nodes")
        found = closed if found is None else found.unionByName(closed)
    return found


def cycle_basis_of(adjacent: dict) -> list[list]:
    """A cycle for each edge outside a breadth-first tree."""
    parent: dict = {}
    depth: dict = {}
    rings = []
    for root in sorted(adjacent):
        if root in parent:
            continue
        parent[root], depth[root] = root, 0
        queue = [root]
        for u in queue:
            for v in sorted(adjacent[u]):
                if v not in parent:
                    parent[v], depth[v] = u, depth[u] + 1
                    queue.append(v)
    tree = {frozenset((v, p)) for v, p in parent.items() if v != p}
    for u in sorted(adjacent):
        for v in sorted(adjacent[u]):
            if u < v and frozenset((u, v)) not in tree:
                left, right = [u], [v]
                while left[-1] != right[-1]:
                    side = left if depth[left[-1]] >= depth[right[-1]] else right
                    side.append(parent[side[-1]])
                rings.append(left + right[-2::-1])
    return rings


def cycle_bases(edges: DataFrame, by: str) -> DataFrame:
    """(by, ring) over the edges (by, a, b) of each facet."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = cycle_basis_of(_neighbours(pdf))
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(rings), "ring": pd.Series(rings, dtype=object)})

    return edges.select(by, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).groupBy(by).applyInPandas(run, f"{by} {dict(edges.dtypes)[by]}, ring array<long>")


def share_two(corners: DataFrame, key: str = "corner", planes: str = "planes") -> DataFrame:
    """Edges a < b between rows whose arrays of three share two members: different arrays are joined on each pair of
    members, and rows meet by their arrays, so that every edge is made once. There are as many edges as the square of the
    rows of an array: one side is dealt, the other goes to every part."""
    pairs = [(0, 1), (0, 2), (1, 2)]
    salts = 16  # parts that the rows of one array are dealt to
    rows = cut_lineage(corners.select(key, F.col(planes).alias("_own")))
    flat = rows.select("_own").distinct().select("_own", F.explode(F.array(*[F.struct(F.col("_own")[i].alias("p"), F.col("_own")[j].alias("q")) for i, j in pairs])).alias("pair"))
    meet = cut_lineage(flat.join(flat.select(F.col("_own").alias("_other"), "pair"), "pair").select("_own", "_other").distinct())
    left = rows.join(meet, "_own").select(F.col(key).alias("a"), "_other", F.pmod(F.xxhash64(key), F.lit(salts).cast("long")).alias("_salt"))
    right = rows.select(F.col(key).alias("b"), F.col("_own").alias("_other"), F.explode(F.array(*[F.lit(k).cast("long") for k in range(salts)])).alias("_salt"))
    by = ("_other", "_salt")
    return dealt(left, *by).join(dealt(right, *by).hint("merge"), list(by)).where("a < b").select("a", "b")


def half_faces(faces: DataFrame) -> DataFrame:
    """(face, i, j) for each directed edge of faces (face, ids array)."""
    n = F.size("ids")
    return faces.select("face", F.posexplode("ids").alias("at", "i"), "ids", n.alias("n")).select("face", "i", F.col("ids")[F.pmod(F.col("at") + 1, F.col("n"))].alias("j"))


def face_adjacency(faces: DataFrame) -> DataFrame:
    """(a, b, i, j): faces that share an undirected edge."""
    e = half_faces(faces).select("face", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return e.select(F.col("face").alias("a"), "i", "j").join(e.select(F.col("face").alias("b"), "i", "j"), ["i", "j"]).where("a < b").select("a", "b", "i", "j").distinct()


def closed(faces: DataFrame, by: str) -> DataFrame:
    """(by, closed): whether every edge of a body is used exactly twice."""
    e = faces.select(by, "face", "ids")
    edges = half_faces(e.withColumn("face", F.struct(F.col(by).alias("body"), "face"))).select(F.col("face.body").alias(by), F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return edges.groupBy(by, "i", "j").count().groupBy(by).agg(F.bool_and(F.col("count") == 2).alias("closed"))


