"""Coverage of commits by recorded sessions, and reachability in the commit graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.functions.text import percent
from provenir.runtime import materialize


def paths_of(parents: DataFrame) -> DataFrame:
    """(node, path, depth): the graph's nodes in disjoint paths along first parents.

    A node's first parent is its least one, and each parent continues the path of its least
    such child, so every node lies on one path; ``path`` is the node where it ends and
    ``depth`` the steps to there.  Pointers double, so the rounds are the log of the longest
    path, and no path ever meets in one task.  A graph with cycles may close such a path to
    a ring: one that still moves after as many steps as there are nodes.  A ring is cut at
    its least node, which then is where its path ends.
    """
    first = parents.groupBy("child").agg(F.min("parent").alias("parent"))
    up = first.groupBy("parent").agg(F.min("child").alias("node")).select("node", F.col("parent").alias("path"))
    nodes = parents.select(F.col("child").alias("node")).unionByName(parents.select(F.col("parent").alias("node"))).distinct()
    jumps = materialize(nodes.join(up, "node", "left"), "paths")
    done, rings = _doubled(jumps, jumps.count())
    if rings.isEmpty():
        return done
    rings = materialize(rings, "rings")
    kept = up.join(rings.filter("node != low").select("node"), "node", "left_semi")
    opened = materialize(rings.select("node").join(kept, "node", "left"), "paths")
    return done.unionByName(_doubled(opened, opened.count())[0])


def _doubled(jumps: DataFrame, nodes: int) -> tuple[DataFrame, DataFrame]:
    """Pointers (node, path) followed to their ends: (node, path, depth), and (node, low) of those
    without one, low being the least node of their ring."""
    depth = F.when(F.col("path").isNull(), 0).otherwise(1).cast("long")
    path = F.coalesce("path", "node")
    jumps = jumps.select("node", path.alias("path"), depth.alias("depth"), F.least("node", path).alias("low"))
    ended = None

    def double(j: DataFrame) -> DataFrame:
        far = j.select(F.col("node").alias("path"), F.col("path").alias("end"), F.col("depth").alias("more"), F.col("low").alias("far_low"))
        return j.join(far, "path").select("node", F.col("end").alias("path"), (F.col("depth") + F.col("more")).alias("depth"), F.least("low", "far_low").alias("low"), (F.col("more") > 0).alias("moved"))

    reach = 1
    while True:  # two steps between two writes
        jumps = materialize(double(double(jumps).drop("moved")), "paths")
        reach *= 4
        ended = jumps.filter("not moved").select("node", "path", "depth")
        if reach > 4 * nodes or jumps.filter("moved").isEmpty():
            # what still moves after more steps than there are nodes goes round in a ring
            return ended, jumps.filter("moved").select("node", "low")
        jumps = jumps.drop("moved")


#: Hops that are tried from the starts before paths are contracted.
HOPS = 16


def reachable(starts: DataFrame, parents: DataFrame, steps: int = 4, hops: int = HOPS) -> DataFrame:
    """(root, node): every ancestor of each start, itself included, at any depth.

    starts is (root, node), parents (child, parent).  What ends within ``hops`` steps is
    found from the starts, at a cost that follows what they reach.  A deeper graph is
    contracted: along a path of first parents all nodes below a reached one are reached, so
    a root's state is one depth a path; rounds follow the edges that leave a path, ``steps``
    of them between two writes, until no state moves.  A history as long as the input costs
    the log of its length, and its merges as many rounds as lie on one way through them.
    Cycles close: depths only grow, and no further than a path is long.
    """
    starts, parents = starts.select("root", "node").distinct(), materialize(parents.select("child", "parent").filter("child is not null and parent is not null").distinct(), "parents")
    edges = parents.withColumnRenamed("child", "node")
    seen = materialize(starts, "seen")
    count = seen.count()
    for _ in range(0, hops, steps):
        near = seen
        for _ in range(steps):
            # a row stays and brings its parents: one chain, nothing is computed twice
            near = near.join(edges, "node", "left").select("root", F.explode(F.array("node", F.coalesce("parent", "node"))).alias("node")).distinct()
        seen = materialize(near, "seen")
        last, count = count, seen.count()
        if count == last:
            return seen
    return _contracted(seen, parents, steps)


def _contracted(starts: DataFrame, parents: DataFrame, steps: int) -> DataFrame:
    paths = paths_of(parents)
    at = lambda c: paths.select(F.col("node").alias(c), F.col("path").alias(f"{c}_path"), F.col("depth").alias(f"{c}_depth"))
    # in an opened ring an edge may also lead further up its own path
    leads = (F.col("child_path") != F.col("parent_path")) | (F.col("parent_depth") > F.col("child_depth"))
    crossing = parents.join(at("child"), "child").join(at("parent"), "parent").filter(leads)
    crossing = crossing.groupBy("child_path", "parent_path", "child_depth").agg(F.max("parent_depth").alias("parent_depth"))
    crossing = materialize(crossing.withColumnRenamed("child_path", "path"), "crossing")
    # a start that no edge knows is a path of its own
    state = starts.join(paths, "node", "left").select("root", F.coalesce("path", "node").alias("path"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
    state, last = materialize(state.groupBy("root", "path").agg(F.max("depth").alias("depth")), "state"), None
    own, far = F.struct("path", "depth"), F.struct(F.col("parent_path").alias("path"), F.col("parent_depth").alias("depth"))
    while True:
        # a way through k crossings takes k steps; depths only grow
        total = state.agg(F.count("*"), F.sum(F.col("depth").cast("decimal(38,0)"))).first()
        if total == last:
            break
        last = total
        for _ in range(steps):
            met = state.join(crossing, "path", "left")
            both = F.explode(F.when(F.col("child_depth") <= F.col("depth"), F.array(own, far)).otherwise(F.array(own))).alias("x")
            state = met.select("root", both).select("root", "x.*").groupBy("root", "path").agg(F.max("depth").alias("depth"))
        state = materialize(state, "state")
    found = state.withColumnRenamed("depth", "reached").join(paths, "path").filter("depth <= reached").select("root", "node")
    return found.unionByName(starts).distinct()


def with_reachability(captured: DataFrame, refs: DataFrame, parents: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``reachable`` to captured (ref, sha): true, false, or null where it can't be told.

    refs is (ref, sha), parents (child, parent), known (sha) the commits that are there.  A
    commit in a ref's closure is reachable.  Any other one is not, unless the closure meets
    a commit that isn't there: behind it may be anything, and unknown is not "no".
    """
    closure = materialize(reachable(refs.select(F.col("ref").alias("root"), F.col("sha").alias("node")), parents), "closure")
    cut = closure.join(known.select(F.col("sha").alias("node")), "node", "left_anti").select(F.col("root").alias("ref")).distinct().withColumn("cut_", F.lit(True))
    inside = closure.select(F.col("root").alias("ref"), F.col("node").alias("sha"), F.lit(True).alias("inside_"))
    answer = F.coalesce("inside_", F.when(F.col("cut_").isNull(), F.lit(False)))
    return captured.join(inside, ["ref", "sha"], "left").join(cut, "ref", "left").withColumn("reachable", answer).drop("inside_", "cut_")


def coverage(commits: DataFrame, edges: DataFrame) -> DataFrame:
    """The coverage unit per ref: rate, its parts, and the grade mix.

    commits is (ref, sha, in_window, reachable, successor) with successor exact, probable or
    null; edges (sha, grade).  The window selects only the empty state; the rate covers the
    whole ref.  Edges are reduced to one row per commit before they meet the commits.  A
    captured commit whose reachability is null refuses the ref: state ``unknown``, no rate.
    """
    count = lambda g: F.count_if(F.col("grade") == g)
    held = edges.groupBy("sha").agg(count("derived").alias("derived"), count("observed").alias("observed"), count("declared").alias("declared"))
    met = commits.join(held, "sha", "left")
    captured = F.col("derived").isNotNull()
    unit = met.groupBy("ref").agg(
        F.count_if("in_window").alias("window_commits"),
        F.count_if(captured).alias("edges_held"),
        F.count_if(captured & F.col("reachable")).alias("reachable"),
        F.count_if(captured & F.col("reachable").isNull()).alias("unknown"),
        F.count_if(captured & (F.col("successor") == "exact")).alias("exact_successors"),
        F.count_if(captured & (F.col("successor") == "probable")).alias("probable_count"),
        *(F.coalesce(F.sum(g), F.lit(0)).alias(f"grade_{g}") for g in ("derived", "observed", "declared")),
    )
    told = F.col("unknown") == 0
    unit = unit.withColumn("reachable", F.when(told, F.col("reachable"))).drop("unknown")
    counted = F.col("reachable") + F.col("exact_successors")
    state = F.when(F.col("window_commits") == 0, "no_commits").when(F.col("edges_held") == 0, "no_sessions").when(F.col("reachable").isNull(), "unknown").when(counted > F.col("edges_held"), "malformed").otherwise("coverage")
    return unit.withColumns({"counted": counted, "percent": percent(counted, F.col("edges_held")), "state": state})


def grade_floors(edges: DataFrame, by: str = "sha") -> DataFrame:
    """The weakest grade of each commit; a commit without edges has no row."""
    from provenir.functions.text import grade_rank

    return edges.groupBy(by).agg(F.min_by("grade", grade_rank(F.col("grade"))).alias("floor"), F.count("*").alias("edges"))
