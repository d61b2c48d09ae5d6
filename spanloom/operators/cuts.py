"""What a graph falls into without each of its nodes: cut vertices found by joins, so that no component is one task.

After Tarjan and Vishkin: a spanning forest by hooking and pointer doubling, a tour around its trees ranked by doubling,
preorder numbers and subtree sizes from that, the least and greatest number that a subtree's other edges lead to from a
table of doubled runs, and components of an auxiliary graph on the tree edges, which are the graph's blocks. A node's
removal leaves one piece for each block whose top it is, made of whole subtrees, and what lies above it.

Nodes are longs. Every step takes a logarithmic number of rounds in the number of nodes, however long the paths are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .ranks import positioned
from .scans import Scan
from .tables import dropped, stored, stored_with_count


def _compressed(up: DataFrame) -> DataFrame:
    """``c, p``: the end of each chain of ``c -> p``, by pointer doubling; chains have no cycle."""
    while True:
        then = up.select(F.col("c").alias("p"), F.col("p").alias("q"))
        moved, n = stored_with_count(up.join(then, "p", "left").select("c", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "forest-up", F.col("moved"))
        up = moved.select("c", "p")
        if not n:
            return up


def spanning_forest(edges: DataFrame) -> DataFrame:
    """``a, b``: the edges of a spanning forest of the undirected ``edges(a, b)``.

    Each round every tree hooks itself to a neighbour with a smaller hash (another one each round), by one edge each; hashes fall
    along the hooks, so these make no cycle, and about half of the trees vanish.
    """
    live, n = stored_with_count(edges.where("a <> b").select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")), "forest-edges", F.lit(True))
    found, k = live.select("a", "b").limit(0), 0
    while n:
        rank = lambda c, k=k: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("n"))
        both = live.select(F.col("ca").alias("c"), F.col("cb").alias("o"), "a", "b").unionByName(live.select(F.col("cb").alias("c"), F.col("ca").alias("o"), "a", "b"))
        least = both.where(rank("o") < rank("c")).groupBy("c").agg(F.min(F.struct(rank("o").alias("o"), "a", "b")).alias("m"))
        hooks = stored(least.select("c", F.col("m.o.n").alias("p"), "m.a", "m.b"), "forest-hooks")
        found = found.unionByName(hooks.select("a", "b"))
        up = _compressed(hooks.select("c", "p"))
        moved = live.join(up.select(F.col("c").alias("ca"), F.col("p").alias("pa")), "ca", "left").join(up.select(F.col("c").alias("cb"), F.col("p").alias("pb")), "cb", "left")
        after, n = stored_with_count(moved.select("a", "b", F.coalesce("pa", "ca").alias("ca"), F.coalesce("pb", "cb").alias("cb")).where("ca <> cb"), "forest-edges", F.lit(True))
        dropped(live)
        live, k = after, k + 1
    return found


def _ranked(arcs: DataFrame) -> DataFrame:
    """``u, v, left``: how many arcs of the tour come after each, by pointer doubling over ``u, v, nu, nv`` (the next arc; null at the end)."""
    now, n = stored_with_count(arcs.withColumn("left", F.col("nu").isNotNull().cast("long")), "tour", F.col("nu").isNotNull())
    while n:
        then = now.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("nu").alias("mu"), F.col("nv").alias("mv"), F.col("left").alias("more"))
        further = now.join(then, ["nu", "nv"], "left").select("u", "v", F.col("mu").alias("nu"), F.col("mv").alias("nv"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"))
        after, n = stored_with_count(further, "tour", F.col("nu").isNotNull())
        dropped(now)
        now = after
    return now.select("u", "v", "left")


def rooted(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """``v, comp, parent, size, g``: the forest ``tree(a, b)`` hung from each component's smallest node, with subtree sizes and preorder numbers.

    ``nodes`` has ``v, comp``. Numbers run over all components, each one's in a row, so a subtree is ``g`` to ``g + size - 1``.
    """
    arcs = tree.select(F.col("a").alias("u"), F.col("b").alias("v")).union(tree.select("b", "a"))
    near = stored(positioned(arcs, [F.col("u")], ("v",), "n").join(arcs.groupBy("v").agg(F.count("*").alias("degree")), "v"), "tour-near")
    follow = near.select("v", F.col("n").alias("m"), F.col("u").alias("w"))
    tops = nodes.groupBy("comp").agg(F.min("v").alias("root"), F.count("*").alias("total"))
    turned = near.withColumn("m", F.col("n") % F.col("degree") + 1).join(follow, ["v", "m"])
    last = (F.col("n") == F.col("degree")) & F.col("root").isNotNull()  # back at the root for good
    step = turned.join(tops.select("root"), F.col("v") == F.col("root"), "left")
    ranked = stored(_ranked(step.select("u", "v", F.when(~last, F.col("v")).alias("nu"), F.when(~last, F.col("w")).alias("nv"))), "tour-ranked")
    back = ranked.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("left").alias("after"))
    down = ranked.join(back, ["u", "v"]).where("left > after").select("v", F.col("u").alias("parent"), ((F.col("left") - F.col("after") + 1) / 2).cast("long").alias("size"), "left")
    hung = nodes.join(down, "v", "left").join(tops, "comp").select("v", "comp", "parent", F.coalesce("size", "total").alias("size"), F.coalesce("left", F.lit(1 << 62)).alias("left"))
    return stored(positioned(hung, [F.col("comp"), F.desc("left")], name="g").drop("left"), "tour-nodes")


def _over_subtrees(hung: DataFrame) -> DataFrame:
    """``v, low, high``: extremes of ``lo`` and ``hi`` over each node's subtree, from runs of doubled length."""
    level = lambda c: F.length(F.bin(c)) - 1
    runs = stored(hung.select("g", F.col("lo").alias("low"), F.col("hi").alias("high")), "runs")
    deepest = hung.agg(F.max(level(F.col("size")))).first()[0] or 0
    out = None
    for k in range(deepest + 1):
        own = hung.where(level(F.col("size")) == k).select("v", "g", (F.col("g") + F.col("size") - (1 << k)).alias("h"))
        end = runs.select(F.col("g").alias("h"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        found = stored(own.join(runs, "g").join(end, "h").select("v", F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high")), "runs-found")
        out = found if out is None else out.unionByName(found)
        if k < deepest:
            ahead = runs.select((F.col("g") - (1 << k)).alias("g"), F.col("low").alias("low2"), F.col("high").alias("high2"))
            runs = stored(runs.join(ahead, "g").select("g", F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high")), "runs")
    return out


def blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``v, comp, parent, size, g, block, top``: the rooted forest with the block of the edge above each node, and the block's highest node.

    ``nodes`` has ``v, comp`` and ``edges`` has each undirected edge ``a, b`` inside a component once; two edges are in one block
    if a cycle without repeated nodes holds both. Roots have no block.
    """
    tree = stored(spanning_forest(edges), "forest")
    hung = rooted(tree, nodes)
    place = hung.select("v", "g", "size")
    side = lambda c: place.select(F.col("v").alias(c), F.col("g").alias(f"g{c}"), F.col("size").alias(f"s{c}"))
    pair = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    others = pair(edges).join(pair(tree), ["a", "b"], "left_anti").join(side("a"), "a").join(side("b"), "b")
    others = stored(others, "forest-others")
    reach = others.select(F.col("a").alias("v"), F.col("gb").alias("to")).union(others.select("b", "ga"))
    local = hung.join(reach.groupBy("v").agg(F.min("to").alias("lo"), F.max("to").alias("hi")), "v", "left")
    local = stored(local.select(*hung.columns, F.least("g", "lo").alias("lo"), F.greatest("g", "hi").alias("hi")), "forest-local")
    reaching = _over_subtrees(local)
    # Edges between unrelated nodes join the tree edges above both; a subtree with a way past its parent joins the edge above that.
    first, second = F.least("ga", "gb"), F.greatest("ga", "gb")
    apart = first + F.when(F.col("ga") < F.col("gb"), F.col("sa")).otherwise(F.col("sb")) <= second
    above = hung.where("parent IS NOT NULL")
    upper = above.select(F.col("v").alias("parent"), F.col("g").alias("pg"), F.col("size").alias("ps"))
    past = above.join(reaching, "v").join(upper, "parent").where((F.col("low") < F.col("pg")) | (F.col("high") >= F.col("pg") + F.col("ps"))).select(F.col("v").alias("src"), F.col("parent").alias("dst"))
    joined = components(others.where(apart).select(F.col("a").alias("src"), F.col("b").alias("dst")).union(past))
    named = stored(above.join(joined.select(F.col("node").alias("v"), F.col("component").alias("block")), "v", "left").withColumn("block", F.coalesce("block", "v")), "blocks")
    tops = named.groupBy("block").agg(F.min_by("parent", "g").alias("top"))
    return hung.join(named.join(tops, "block").select("v", "block", "top"), "v", "left")


def pieces(found: DataFrame, files: DataFrame, calls: DataFrame, parts: int) -> DataFrame:
    """``v, comp, block, size, other, called``: what is left without each node of at least ``parts`` pieces; a null ``block`` is what lies above.

    ``found`` comes from :func:`blocks`, ``files`` has ``v, file`` and ``calls`` has ``v, x``: v calls x. ``other``: whether a member lies
    in another file than v; ``called``: whether v calls a member.
    """
    down = found.where("top = parent").groupBy(F.col("parent").alias("v"), "block").agg(F.sum("size").alias("size"))
    degree = down.groupBy("v").agg(F.count("*").alias("below"), F.sum("size").alias("covered"))
    totals = found.groupBy("comp").agg(F.count("*").alias("total"))
    own = found.select("v", "comp", F.col("parent").isNotNull().cast("int").alias("above")).join(degree, "v").where(F.col("below") + F.col("above") >= parts).join(totals, "comp")
    own = stored(own.join(files, "v"), "cut-nodes")
    # How many members of a node's own file lie below each of its children: counts of that file's nodes before two numbers.
    kids = found.where("top = parent").select(F.col("parent").alias("v"), "block", "g", "size").join(own.select("v", "comp", "file"), "v")
    marks = found.join(files, "v").select("comp", "file", (F.col("g") * 2).alias("at"), F.lit(1).alias("n"))
    asked = kids.select("comp", "file", F.explode(F.array(F.col("g") * 2 - 1, (F.col("g") + F.col("size")) * 2 - 1)).alias("at")).distinct().withColumn("n", F.lit(0))
    scan = Scan(marks.unionByName(asked), ["comp", "file"], "at")
    before = stored(scan.running(scan.rows, {"__n": ("sum", "n")}).where("n = 0").select("comp", "file", "at", "__n"), "cut-counts")
    at = lambda name, place: before.select("comp", F.col("file").alias("__f"), F.col("at").alias(place), F.col("__n").alias(name))
    kids = kids.withColumn("from", F.col("g") * 2 - 1).withColumn("to", (F.col("g") + F.col("size")) * 2 - 1)
    kids = kids.join(at("n1", "from"), ["comp", "from"]).where(F.col("file").eqNullSafe(F.col("__f"))).drop("__f").join(at("n2", "to"), ["comp", "to"]).where(F.col("file").eqNullSafe(F.col("__f")))
    below = kids.groupBy("v", "block").agg(F.sum(F.col("n2") - F.col("n1")).alias("same"))
    per_file = found.join(files, "v").groupBy("comp", "file").agg(F.count("*").alias("in_file"))
    lower = own.join(down, "v").join(below, ["v", "block"]).select("v", "comp", "block", "size", "same")
    sums = below.groupBy("v").agg(F.sum("same").alias("same_below"))
    joined = own.where("above = 1").join(sums, "v").join(per_file.withColumnRenamed("file", "__f"), "comp").where(F.col("file").eqNullSafe(F.col("__f")))
    upper = joined.select("v", "comp", F.lit(None).cast("long").alias("block"), (F.col("total") - 1 - F.col("covered")).alias("size"), (F.col("in_file") - 1 - F.col("same_below")).alias("same"))
    every = lower.unionByName(upper)
    seen = calls.join(own.select("v"), "v").join(found.select(F.col("v").alias("x"), "block", "top"), "x").select("v", F.when(F.col("top") == F.col("v"), F.col("block")).alias("block")).distinct()
    seen = seen.select(F.col("v").alias("__v"), F.col("block").alias("__block"), F.lit(True).alias("called"))
    return every.join(seen, (F.col("v") == F.col("__v")) & F.col("block").eqNullSafe(F.col("__block")), "left").select("v", "comp", "block", "size", (F.col("size") > F.col("same")).alias("other"), F.coalesce("called", F.lit(False)).alias("called"))
