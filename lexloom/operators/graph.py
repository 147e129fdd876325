"""Property-graph operators over edge tables (src, dst, rel_type, confidence)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.sources.folders import shared_folder


def shared(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's checkpoint folder, so that loops over levels don't grow the plan.

    Where no folder is named, a local session gets a temporary one; on a cluster that is an error, as machines don't share it.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def hop(edges: DataFrame, start: DataFrame, direction: str = "out") -> DataFrame:
    """Edges that leave (out), reach (in) or touch (both) the nodes of ``start`` (column node)."""
    out = edges.join(start.withColumnRenamed("node", "src"), "src", "left_semi")
    into = edges.join(start.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns)
    return {"out": out, "in": into, "both": out.unionByName(into).distinct()}[direction]


def paths(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(seed, node, length, trail): every walk of 1..depth edges from a seed that uses no edge twice.

    ``trail`` is the array of edges used, each a struct (s, d, t). Levels are joined one after another on the frontier.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = edges.select(F.col(a).alias("node"), F.col(b).alias("next"), F.struct(F.col("src").alias("s"), F.col("dst").alias("d"), F.col("rel_type").alias("t")).alias("edge"))
    kind = step.schema["edge"].dataType.simpleString()
    front = seeds.select(F.col("node").alias("seed"), "node", F.array().cast(f"array<{kind}>").alias("trail"))
    levels = []
    for length in range(1, depth + 1):
        front = front.join(step, "node").where(~F.array_contains("trail", F.col("edge"))).select("seed", F.col("next").alias("node"), F.concat("trail", F.array("edge")).alias("trail"))
        levels.append(front.withColumn("length", F.lit(length)))
    return reduce(lambda x, y: x.unionByName(y), levels).select("seed", "node", "length", "trail")


def walk_counts(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(seed, node, length, walks): how many walks of 1..depth edges lead from a seed to a node and use no edge twice.

    ``depth`` is at most 3. Walks are counted by products of multiplicities, aggregated by node at each level, so that nothing
    grows with their number; those that repeat an edge are then taken off. Two consecutive edges are the same only
    where a loop is walked twice; the first and third are the same only where the second leads back to the seed. So all that
    is taken off stands among the seeds' direct neighbours.
    """
    if not 1 <= depth <= 3:
        raise ValueError("walks are counted without their trails up to three edges")
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = shared(edges.groupBy(F.col(a).alias("node"), F.col(b).alias("next")).agg(F.count("*").alias("m")))
    start = seeds.select(F.col("node").alias("seed"), "node", F.lit(1).cast("long").alias("n")).distinct()
    onward = lambda front: front.join(step, "node").groupBy("seed", F.col("next").alias("node")).agg(F.sum(F.col("n") * F.col("m")).alias("n"))
    one = shared(onward(start))
    levels = [one.select("seed", "node", F.lit(1).alias("length"), F.col("n").alias("walks"))]
    if depth > 1:
        two = onward(one)
        loops = step.where("node = next").select("node", "m")
        # of a seed's neighbours: loops at the seed and at the neighbour, and edges back
        near = one.join(loops.select(F.col("node").alias("seed"), F.col("m").alias("at_seed")), "seed", "left").join(loops.withColumnRenamed("m", "at_node"), "node", "left")
        back = step.select("node", F.col("next").alias("seed"), F.col("m").alias("back"))
        near = near.join(back, ["node", "seed"], "left").fillna(0, ["at_seed", "at_node", "back"])
        home = F.when(F.col("node") == F.col("seed"), F.col("at_seed")).otherwise(0)
        near = near.select("seed", "node", home.alias("off_two"), (F.col("n") * (F.col("at_seed") + F.col("at_node") + F.col("back")) - 2 * home).alias("off_three"))
        less = lambda found, off, length: found.join(near.select("seed", "node", off), ["seed", "node"], "left").select("seed", "node", F.lit(length).alias("length"), (F.col("n") - F.coalesce(off, F.lit(0))).alias("walks")).where("walks > 0")
        levels.append(less(two, "off_two", 2))
    if depth > 2:
        levels.append(less(onward(two), "off_three", 3))
    return reduce(lambda x, y: x.unionByName(y), levels)


def impact_by_paths(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(node, impact_level, path_count): what is reached against the edges, the shortest distance, and how many walks.

    No edge is used twice in a walk. Up to three edges walks are counted without being kept; longer ones keep their trails.
    """
    if depth <= 3:
        return walk_counts(edges, seeds, depth, reverse=True).groupBy("node").agg(F.min("length").alias("impact_level"), F.sum("walks").alias("path_count"))
    found = paths(edges, seeds, depth, reverse=True)
    return found.groupBy("node").agg(F.min("length").alias("impact_level"), F.count("*").alias("path_count"))


def impact_score(impact: DataFrame) -> DataFrame:
    """min(0.7 / (0.5 * level) + 0.3 * min(paths / 10, 1), 1) and its band."""
    score = F.least(0.7 / (0.5 * F.col("impact_level")) + 0.3 * F.least(F.col("path_count") / 10, F.lit(1.0)), F.lit(1.0))
    return impact.withColumn("score", F.round(score, 6)).withColumn("band", F.when(F.col("score") >= 0.7, "high").when(F.col("score") >= 0.4, "medium").otherwise("low"))


#: What kind of impact an edge type stands for.
IMPACT_TYPES = {"APPLIES": "DirectApplication", "APPLY": "DirectApplication", "REPLACE": "TextReplacement", "REPLACES": "TextReplacement", "DEEM": "LegalFiction", "EXCEPT": "Exception"}


def impact_by_levels(edges: DataFrame, seeds: DataFrame, depth: int = 3, least: float = 0.7, indirect: bool = True) -> DataFrame:
    """(node, depth, confidence, impact_type, path): breadth-first against the edges, the first visit counts.

    Confidence is the edge's times 0.9 for each level before it. Of edges that reach a node on the same level the
    strongest counts, then the least source. Seeds aren't marked as visited, so a cycle can bring a seed back.
    """
    kind = F.create_map(*[F.lit(x) for kv in IMPACT_TYPES.items() for x in kv])
    # one edge a pair of nodes, stored once: the strongest, then the last type by name
    used = edges.where(F.col("confidence") >= least).groupBy(F.col("dst").alias("at"), F.col("src").alias("next")).agg(F.max(F.struct(F.col("confidence").alias("c"), "rel_type")).alias("e"))
    used = shared(used.select("at", "next", "e.c", "e.rel_type"))
    front = seeds.select(F.col("node").alias("at"), F.array("node").alias("path")).distinct()
    visited = None
    for level in range(depth if indirect else 1):
        reached = front.join(used, "at")
        if visited is not None:
            reached = reached.join(visited.select(F.col("node").alias("next")), "next", "left_anti")
        found = reached.groupBy(F.col("next").alias("node")).agg(F.min_by(F.struct("c", "rel_type", "path"), F.struct(-F.col("c"), F.col("at"))).alias("e"))
        found = found.select("node", F.lit(level + 1).alias("depth"), F.round(F.col("e.c") * 0.9**level, 6).alias("confidence"), F.coalesce(kind[F.col("e.rel_type")], F.lit("General")).alias("impact_type"), F.concat("e.path", F.array("node")).alias("path"))
        found = shared(found)
        visited = found if visited is None else visited.unionByName(found)
        front = found.select(F.col("node").alias("at"), "path")
    return visited


def degrees(edges: DataFrame, without_loops: bool = True) -> DataFrame:
    """(node, in_degree, out_degree) of every node with an edge; one pass over the edges, aggregated map-side."""
    e = edges.where("src != dst") if without_loops else edges
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select(F.col("dst").alias("node_id")))
    return nodes.join(ends, "node_id", "left_anti")


def mutual_pairs(edges: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of nodes with edges both ways, each pair once, by one aggregation instead of a self-join."""
    e = edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).cast("int").alias("up"))
    return e.groupBy("a", "b").agg(F.min("up").alias("lo"), F.max("up").alias("hi")).where("lo = 0 and hi = 1").select("a", "b")


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c): directed cycles a -> b -> c -> a with a < b and a < c, each once.

    Each cycle is found at its node of least degree: only edges to nodes of higher degree meet there, at most some root
    of twice the edges for any node, so a hub's edges are not paired with one another.
    """
    e = shared(edges.where("src != dst").select("src", "dst").distinct())
    degree = e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    at = lambda end: degree.select(F.col("node").alias(end), F.struct("n", F.col("node").alias("id")).alias(f"{end}_rank"))
    ranked = shared(e.join(at("src"), "src").join(at("dst"), "dst"))
    out = ranked.where("src_rank < dst_rank").select(F.col("src").alias("v"), F.col("dst").alias("w"))
    into = ranked.where("src_rank > dst_rank").select(F.col("dst").alias("v"), F.col("src").alias("u"))
    closed = out.join(into, "v").where("u != w").join(e.select(F.col("src").alias("w"), F.col("dst").alias("u")), ["w", "u"], "left_semi")
    turn = lambda x, y, z: F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.col(z).alias("c"))
    least = F.least("v", "w", "u")
    return closed.select(F.when(F.col("v") == least, turn("v", "w", "u")).when(F.col("w") == least, turn("w", "u", "v")).otherwise(turn("u", "v", "w")).alias("t")).select("t.*")


def density(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """(law_a, law_b, n): edges between different owners; ``owner`` has node_id and law."""
    a = owner.select(F.col("node_id").alias("src"), F.col("law").alias("law_a"))
    b = owner.select(F.col("node_id").alias("dst"), F.col("law").alias("law_b"))
    return edges.join(a, "src").join(b, "dst").where("law_a != law_b").groupBy("law_a", "law_b").agg(F.count("*").alias("n"))


def connected(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component): weakly connected components, the least node naming each, by label propagation with jumps."""
    both = shared(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct())
    labels = shared(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
    for _ in range(max_rounds):
        heard = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("heard"))
        nearer = labels.join(heard, "node").select("node", F.least("component", "heard").alias("component"))
        jumped = nearer.join(nearer.select(F.col("node").alias("component"), F.col("component").alias("further")), "component", "left").select("node", F.coalesce(F.least("component", "further"), "component").alias("component"))
        jumped = shared(jumped)
        same = jumped.join(labels.withColumnRenamed("component", "was"), "node").where("component != was").limit(1).count() == 0
        labels = jumped
        if same:
            return labels
    raise RuntimeError("components did not settle")


def census(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, label, n): nodes by kind and edges by type."""
    a = nodes.groupBy(F.col("kind").alias("label")).agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "label", "n")
    b = edges.groupBy(F.col("rel_type").alias("label")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "label", "n")
    return a.unionByName(b)


def subgraph(spark: SparkSession, edges: DataFrame, nodes: DataFrame, law: str, most_nodes: int = 50) -> DataFrame:
    """Edges that touch the first ``most_nodes`` nodes of a law (a display limit), with both ends' titles."""
    chosen = nodes.where(F.col("law") == law).orderBy("number", "node_id").limit(most_nodes).select(F.col("node_id").alias("node"))
    title = lambda end: nodes.select(F.col("node_id").alias(end), F.col("title").alias(f"{end}_title"))
    return hop(edges, chosen, "both").join(title("src"), "src").join(title("dst"), "dst")
