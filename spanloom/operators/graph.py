"""Walks over edge tables ``src -> dst``: components, bounded reach, shortest entries, path trees, roots, closures.

Iterative operators keep a frontier and what was visited, write both to the shared folder each round, and stop when nothing
new appears. A bound on rounds is part of the question (depth); what a bound leaves open is reported, never dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bits
from .ranking import top_per_group
from .tables import dropped, stored, stored_with_count


#: At most so many nodes have their edges joined by broadcast in a round of :func:`components`.
_HUBS = 10_000


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` (smallest node reachable when direction is ignored) for every end of an edge.

    Alternating large-star and small-star steps: each hangs a node's neighbours on the smallest of them, and the graph
    becomes stars in a logarithmic number of steps. A node's smallest neighbour is aggregated before it is shuffled. Nodes
    with more than a ten-thousandth of the edges are few, so what they need to know is broadcast and their edges stay where
    they are; the edges of the others are joined by hash.

    ``edges`` is computed once. What a step reads more than once is stored first: a plan that repeats it for each reader
    takes the driver more memory than the rows take the tasks.
    """
    pairs = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
    pairs = stored(pairs.distinct(), "components")
    apart, hashed = F.expr("a <> b"), F.xxhash64("a", "b").cast("decimal(38,0)")
    looped, *state = pairs.agg(F.count_if(F.expr("a = b")), F.count_if(apart), F.sum(F.when(apart, hashed))).first()
    current, spent = pairs.where(apart), [] if looped else [pairs]  # loops are read from the first table at the end
    while state[0]:
        most = max(100, -(-2 * state[0] // _HUBS))
        flipped = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
        both = current.select(F.inline(F.array(F.struct("a", "b"), flipped)))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "components-least")
        # Rows have a > b, so the neighbours above a node are the rows read from their other end.
        large = stored(_by_hub(current.select("b", "a").toDF("a", "b"), least, most).select(F.col("b").alias("a"), F.col("m").alias("b")), "components-large")
        lower = stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "components-least")
        hung = _by_hub(large, lower, most).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stored(hung.union(lower.select("a", F.col("m").alias("b"))).distinct(), "components")
        before, state = state, list(after.agg(F.count("*"), F.sum(hashed)).first())
        for table in (least, large, lower, *spent):
            dropped(table)
        current, spent = after, [after]
        if state == before:
            break
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    if not looped:
        return nodes
    alone = pairs.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(alone.join(nodes.select("node"), "node", "left_anti"))


def _by_hub(rows: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """``rows(a, b)`` with the ``m`` of ``a`` from ``least(a, m, n)``. Nodes with ``n > most`` rows are at most :data:`_HUBS`: they are broadcast."""
    hubs = F.broadcast(least.where(F.col("n") > most).select(F.col("a").alias("hub"), F.col("m").alias("hub_m")))
    seen = rows.join(hubs, F.col("a") == F.col("hub"), "left")
    few = seen.where("hub IS NULL").select("a", "b").join(least.where(F.col("n") <= most).select("a", "m"), "a").select("a", "b", "m")
    return few.union(seen.where("hub IS NOT NULL").select("a", "b", F.col("hub_m").alias("m")))


def reach(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """``start, node, depth``: nodes within ``depth`` steps of each start, at their shortest depth; the start itself is left out.

    ``starts`` has ``start``; ``edges`` has ``src, dst``, also more than once. Breadth first, so a node found late on one path is still
    expanded from its shortest depth. Nodes are held as bits (:mod:`~spanloom.operators.bits`) until they are returned.
    """
    kind = edges.schema["dst"].dataType
    return bits.unpacked(_reached(starts, edges, depth), kind).select("start", "node", "depth")


def _reached(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    adjacent = stored(bits.packed(edges, ["src"], "dst"), "reach-adjacent")
    first = starts.select("start", F.col("start").alias("node")).distinct()
    return bits.levels(first, adjacent, depth, edges.schema["dst"].dataType)


def _first_steps(step: DataFrame, most: int) -> DataFrame:
    """At most ``most`` distinct targets of each source. A walk that may admit fewer nodes than that is full behind any source with more."""
    return top_per_group(step.distinct(), ["src"], [F.col("dst")], most)


def reach_within(starts: DataFrame, edges: DataFrame, depth: int, budget: int) -> DataFrame:
    """``start, reached, capped``: how many nodes lie within ``depth`` steps of each start, the start itself if a way leads back to it.

    Breadth first. A start with ``budget`` nodes is full: it leaves the walk before the next join, with ``reached`` the budget
    and ``capped``, which is a lower bound. A level thus has at most ``budget`` squared rows a start, whatever the degrees.
    """
    step = stored(_first_steps(edges.select("src", "dst").where("src <> dst"), budget), "within-steps")
    done = None
    frontier = starts.select("start", F.col("start").alias("node")).distinct()
    seen = frontier.limit(0)
    for _ in range(depth):
        new = frontier.join(step, frontier.node == step.src).select("start", F.col("dst").alias("node")).distinct()
        new = stored(new.join(seen, ["start", "node"], "left_anti"), "within-new")
        if new.isEmpty():
            break
        total = seen.unionByName(new).groupBy("start").agg(F.count("*").alias("n"))
        full = stored(total.where(F.col("n") >= budget).select("start", F.lit(budget).cast("long").alias("reached"), F.lit(True).alias("capped")), "within-full")
        done = full if done is None else done.unionByName(full)
        open_ = lambda df: df.join(full.select("start"), "start", "left_anti")  # noqa: E731, B023
        seen, frontier = stored(open_(seen.unionByName(new)), "within-seen"), open_(new)
    rest = seen.groupBy("start").agg(F.count("*").alias("reached")).withColumn("capped", F.lit(False))
    known = rest if done is None else done.unionByName(rest)
    return starts.select("start").distinct().join(known, "start", "left").select("start", F.coalesce("reached", F.lit(0)).alias("reached"), F.coalesce("capped", F.lit(False)).alias("capped"))


#: Callers that a search for tests may visit, and why it is not sure.
REACH_BUDGET = 120
UNFINISHED = "a caller query did not finish"


def reach_states(starts: DataFrame, edges: DataFrame, facts: DataFrame, depth: int, budget: int = REACH_BUDGET) -> DataFrame:
    """Test reach of every start, ``start, state, test_depth, reason``: ``covered`` if a test calls a searched node, else ``unknown`` if the search stopped at its
    budget or met a node whose callers are incomplete, else ``uncovered``. ``facts`` has ``node, is_test, complete``; a node without
    facts is complete and no test.

    Breadth first: nodes less than ``depth`` steps away are searched, level by level. A test among a level's callers counts whatever
    the budget has left; without one, more than ``budget`` callers in all stop the search. The start leaves as soon as it is settled.
    """
    step = edges.select("src", "dst").where("src <> dst").distinct()
    known = facts.select("node", F.coalesce("is_test", F.lit(False)).alias("is_test"), F.coalesce("complete", F.lit(True)).alias("complete"))
    tests = step.join(known.where("is_test").select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), F.lit(True).alias("tested")).distinct()
    notes = stored(known.where("NOT complete").select("node", F.lit(True).alias("partial")).join(tests, "node", "full_outer"), "reach-notes")
    step = stored(_first_steps(step, budget + 1), "reach-steps")
    frontier = starts.select("start", F.col("start").alias("node")).distinct()
    seen, noted, done = frontier, frontier.select("start").limit(0), None
    row = lambda df, state, at, why: df.select("start", F.lit(state).alias("state"), F.lit(at).cast("int").alias("test_depth"), F.lit(why).cast("string").alias("reason"))
    add = lambda done, df: df if done is None else done.unionByName(df)
    for d in range(1, depth + 1):
        level = frontier.join(notes, "node", "left").groupBy("start").agg(F.bool_or(F.coalesce("tested", F.lit(False))).alias("tested"), F.bool_or(F.coalesce("partial", F.lit(False))).alias("partial"))
        level = stored(level, "reach-level")
        covered = level.where("tested").select("start")
        done = add(done, row(covered, "covered", d, None))
        noted = stored(noted.unionByName(level.where("partial AND NOT tested").select("start")).distinct(), "reach-noted")
        new = frontier.join(covered, "start", "left_anti").join(step, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        new = stored(new.join(seen, ["start", "node"], "left_anti"), "reach-new")
        # The start is seen and was not admitted.
        over = stored(seen.unionByName(new).join(covered, "start", "left_anti").groupBy("start").agg((F.count("*") - 1).alias("n")).where(F.col("n") > budget).select("start"), "reach-over")
        first = over.join(noted, "start", "left_semi")
        done = add(done, row(first, "unknown", None, UNFINISHED)).unionByName(row(over.join(noted, "start", "left_anti"), "unknown", None, f"the budget of {budget} visited callers stopped the walk"))
        settled = covered.unionByName(over)
        noted = stored(noted.join(settled, "start", "left_anti"), "reach-noted")
        seen, frontier = stored(seen.unionByName(new).join(settled, "start", "left_anti"), "reach-seen"), new.join(settled, "start", "left_anti")
        if new.isEmpty():
            break
    rest = seen.select("start").distinct()
    done = add(done, row(rest.join(noted, "start", "left_semi"), "unknown", None, UNFINISHED)).unionByName(row(rest.join(noted, "start", "left_anti"), "uncovered", None, None))
    return done


def shortest_entries(starts: DataFrame, edges: DataFrame, entries: DataFrame, depth: int) -> DataFrame:
    """``start, entry, depth``: entry nodes at their shortest depth; a walk does not go on behind an entry."""
    stops = entries.select(F.col("node").alias("entry")).distinct()
    onward = edges.join(stops, edges.src == stops.entry, "left_anti")
    found = bits.within(_reached(starts, onward, depth), bits.packed(stops, [], "entry"))
    return bits.unpacked(found, edges.schema["dst"].dataType, "entry").select("start", "entry", "depth")


def path_tree(starts: DataFrame, edges: DataFrame, depth: int = 3, children: int = 8) -> DataFrame:
    """Paths from each start as arrays, cut where a node repeats (``cycle``) and to the first ``children`` of a node.

    ``dst`` orders the children; ``more`` tells how many were left out below the path's last node.
    """
    step = edges.select("src", "dst").distinct()
    from pyspark.sql import Window

    ranked = step.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("dst")))
    counts = step.groupBy("src").agg(F.greatest(F.count("*") - children, F.lit(0)).alias("more"))
    allowed = ranked.where(F.col("n") <= children).select("src", "dst")
    level = starts.select(F.array("start").alias("path"), F.lit(False).alias("cycle"))
    out = level
    for _ in range(depth):
        live = level.where("NOT cycle").withColumn("last", F.element_at("path", -1))
        level = live.join(allowed, F.col("last") == F.col("src")).select(F.concat("path", F.array("dst")).alias("path"), F.array_contains("path", F.col("dst")).alias("cycle"))
        level = stored(level, "paths")
        out = out.unionByName(level)
    out = out.withColumn("last", F.element_at("path", -1))
    return out.join(counts.withColumnRenamed("src", "last"), "last", "left").select("path", (F.size("path") - 1).alias("depth"), "cycle", F.coalesce("more", F.lit(0)).alias("more"))


def closure(edges: DataFrame, depth: int) -> DataFrame:
    """``src, dst`` pairs joined by a path of at most ``depth`` edges (supertypes of supertypes, say)."""
    starts = edges.select(F.col("src").alias("start")).distinct()
    return reach(starts, edges, depth).select(F.col("start").alias("src"), F.col("node").alias("dst"), "depth")


def resolved(aliases: DataFrame, depth: int = 16) -> DataFrame:
    """End of each chain of ``name -> target`` and its length; a chain that comes back, or is longer than ``depth``, ends nowhere (null)."""
    current = aliases.select("name", "target", F.lit(1).alias("hops"))
    nxt = aliases.select(F.col("name").alias("target"), F.col("target").alias("then"))
    for _ in range(depth):
        joined = stored(current.join(nxt, "target", "left").select("name", F.coalesce("then", "target").alias("target"), F.when(F.col("then").isNull(), F.col("hops")).otherwise(F.col("hops") + 1).alias("hops"), F.col("then").isNotNull().alias("moved")), "chains")
        current = joined.select("name", "target", "hops")
        if joined.where("moved").isEmpty():
            return current
    ends = nxt.select("target").distinct()
    return current.join(ends.withColumn("open", F.lit(True)), "target", "left").select("name", F.when(F.col("open").isNull(), F.col("target")).alias("target"), "hops")


def strong_components(edges: DataFrame, trims: int = 8) -> DataFrame:
    """``node, scc`` for every node of a directed graph; ``scc`` is the smallest node of its strongly connected component.

    Chains are contracted first: nodes with one way out (then those with one way in, and so on while that shortens much) point
    to where their chain ends, by pointer doubling, so chains and rings take a logarithmic number of rounds however long they are.
    The rest is trimmed and coloured: every node takes the smallest node that reaches it as its colour, those that reach
    their colour's node backwards form one component and leave, and what is left goes again. Contracted nodes then get the
    component of their chain's end if a way from that component leads through them. Only colours and pointers are carried,
    never the quadratic closure.
    """
    nodes = stored(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "scc-nodes")
    step = stored(edges.select("src", "dst").where("src <> dst").distinct(), "scc-edges")
    frames, out, idle, n = [], True, 0, nodes.count()
    while n and idle < 2:
        frame = _contracted(nodes, step, out, n)
        idle, out = (0, not out) if frame else (idle + 1, not out)
        if frame:
            frames.append(frame)
            nodes, step, n = frame["nodes"], frame["step"], frame["count"]
    found = _coloured(nodes, step, trims)
    for frame in reversed(frames):
        found = _unfolded(frame, stored(found, "scc-folded"))
    return found


def _contracted(nodes: DataFrame, step: DataFrame, out: bool, n: int) -> dict | None:
    """The graph without its nodes of one way out (or in), whose edges go on to where their chains end; None if these are under a twentieth."""
    flow = step if out else step.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ones = flow.groupBy("src").agg(F.count("*").alias("k"), F.min("dst").alias("to")).where("k = 1").select(F.col("src").alias("v"), "to")
    ones, many = stored_with_count(ones, "scc-chains", F.lit(True))
    if not many or many * 20 < n:
        return None
    # ``to``: where so many steps lead; ``done``: that is no chain node; ``low``: the least node passed on the way.
    chain = ones.select(F.col("v").alias("to"), F.lit(True).alias("__on"))
    now, left = stored_with_count(ones.join(chain, "to", "left").select("v", "to", F.col("__on").isNull().alias("done"), F.col("v").alias("low")), "scc-jumps", ~F.col("done"))
    levels, steps = [now], 1
    while left and steps < many:
        then = now.select(F.col("v").alias("to"), F.col("to").alias("far"), F.col("done").alias("ends"), F.col("low").alias("below"))
        open_ = now.where("NOT done").join(then, "to").select("v", F.col("far").alias("to"), F.col("ends").alias("done"), F.least("low", "below").alias("low"))
        now, left = stored_with_count(open_.unionByName(now.where("done")), "scc-jumps", ~F.col("done"))
        levels.append(now)
        steps *= 2
    rings = now.where("NOT done").select(F.col("to").alias("v")).distinct().join(now.select("v", "low"), "v").select(F.col("v").alias("node"), F.col("low").alias("scc"))
    kept = stored(nodes.join(ones.select(F.col("v").alias("node")), "node", "left_anti"), "scc-nodes")
    entering = flow.join(ones.select(F.col("v").alias("src")), "src", "left_anti")
    ends = now.select(F.col("v").alias("dst"), F.col("to").alias("end"), "done")
    moved = stored(entering.join(ends, "dst", "left").where("done IS NULL OR done").select("src", "dst", F.coalesce("end", "dst").alias("end"), F.col("end").isNotNull().alias("through")), "scc-entering")
    after = moved.where("src <> end").select("src", F.col("end").alias("dst")).distinct()
    after = stored(after if out else after.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "scc-edges")
    return {"nodes": kept, "step": after, "count": n - many, "levels": levels, "rings": stored(rings, "scc-rings"), "through": moved.where("through").select("src", F.col("dst").alias("v"), "end")}


def _unfolded(frame: dict, found: DataFrame) -> DataFrame:
    """Components of a graph from those of its contraction: a chain node is in its end's component if a way from there enters the chain at or before it."""
    side = lambda c, name: found.select(F.col("node").alias(c), F.col("scc").alias(name))
    entered = frame["through"].join(side("src", "a"), "src").join(side("end", "b"), "end").where("a = b").select("v").distinct()
    marked, n = stored_with_count(entered, "scc-marked", F.lit(True))
    for level in reversed(frame["levels"]) if n else ():
        ahead = marked.join(level.where("NOT done"), "v").select(F.col("to").alias("v"))
        marked = stored(marked.union(ahead).distinct(), "scc-marked")
    last = frame["levels"][-1]
    inside = stored(marked.join(last.where("done").select("v", F.col("to").alias("end")), "v").join(side("end", "scc"), "end").select(F.col("v").alias("node"), "scc"), "scc-inside")
    lowest = inside.groupBy("scc").agg(F.min("node").alias("low"))
    joined = found.unionByName(inside).join(lowest, "scc", "left").select("node", F.least("scc", "low").alias("scc"))
    settled = inside.select("node").union(frame["rings"].select("node"))
    alone = last.select(F.col("v").alias("node")).join(settled, "node", "left_anti").withColumn("scc", F.col("node"))
    return joined.unionByName(frame["rings"]).unionByName(alone)


def _coloured(nodes: DataFrame, step: DataFrame, trims: int) -> DataFrame:
    """Components by trimming and colouring, round by round along the ways that are left."""
    done = nodes.limit(0).withColumn("scc", F.col("node"))
    while True:
        size = step.count()
        for _ in range(trims if size else 0):
            inner = step.select("src").intersect(step.select("dst")).withColumnRenamed("src", "node")
            kept = step.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi")
            step = stored(kept, "scc-edges")
            before, size = size, step.count()
            if size == before:
                break
        core = step.select(F.col("src").alias("node")).union(step.select("dst")).distinct()
        single = nodes.join(core, "node", "left_anti")
        done = done.unionByName(stored(single.withColumn("scc", F.col("node")), "scc-members"))
        if not size:
            return done
        nodes = stored(core, "scc-nodes")
        colour = _least_over(nodes, step)
        inside = step.join(colour.withColumnRenamed("node", "src").withColumnRenamed("colour", "c1"), "src").join(colour.withColumnRenamed("node", "dst").withColumnRenamed("colour", "c2"), "dst").where("c1 = c2").select("src", "dst")
        back = stored(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "scc-back")
        members = _marked_from(colour.where("node = colour").select("node"), back).join(colour, "node").select("node", F.col("colour").alias("scc"))
        members = stored(members, "scc-members")
        done = done.unionByName(members)
        nodes = stored(nodes.join(members, "node", "left_anti"), "scc-nodes")
        step = stored(step.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi"), "scc-edges")


def _least_over(nodes: DataFrame, step: DataFrame) -> DataFrame:
    colour = nodes.withColumn("colour", F.col("node"))
    while True:
        offered = step.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("offered"))
        after = stored(colour.join(offered, "node", "left").select("node", F.least("colour", F.coalesce("offered", "colour")).alias("colour"), (F.col("offered") < F.col("colour")).alias("moved")), "colours")
        colour = after.select("node", "colour")
        if after.where("moved").isEmpty():
            return colour


def _marked_from(starts: DataFrame, step: DataFrame) -> DataFrame:
    seen = frontier = starts
    while True:
        new = step.join(frontier.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct()
        frontier = stored(new.join(seen, "node", "left_anti"), "marks")
        if frontier.isEmpty():
            return seen
        seen = stored(seen.unionByName(frontier), "marks")


def roots(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """Roots of the forest in which a caller hangs below what it calls: ``node`` with ``promoted`` for one of a cycle.

    ``edges`` is ``src`` (callee) to ``dst`` (caller); ``ranks`` has ``node, score, label``. A node that calls no other node
    is a root; a strongly connected component that calls nothing outside is represented by its best (score, label) member.
    """
    scc = strong_components(edges)
    outward = edges.join(scc.withColumnRenamed("node", "src").withColumnRenamed("scc", "callee"), "src").join(scc.withColumnRenamed("node", "dst").withColumnRenamed("scc", "caller"), "dst").where("callee <> caller")
    top = scc.join(outward.select(F.col("caller").alias("scc")).distinct(), "scc", "left_anti")
    named = top.join(ranks, "node")
    best = named.groupBy("scc").agg(F.min(F.struct((-F.col("score")).alias("s"), "label", "node")).alias("b"), F.count("*").alias("n"))
    return best.select(F.col("b.node").alias("node"), (F.col("n") > 1).alias("promoted"))


def seams(edges: DataFrame, groups: DataFrame, via: int = 5) -> DataFrame:
    """Edges between different groups, per unordered pair: the first ``via`` edges and their count. ``groups`` has ``node, grp``."""
    from .ranking import capped_list

    a = edges.join(groups.select(F.col("node").alias("src"), F.col("grp").alias("ga")), "src").join(groups.select(F.col("node").alias("dst"), F.col("grp").alias("gb")), "dst").where("ga <> gb")
    pairs = a.select(F.least("ga", "gb").alias("group_a"), F.greatest("ga", "gb").alias("group_b"), "src", "dst").distinct()
    return capped_list(pairs, ["group_a", "group_b"], F.struct("src", "dst"), [F.col("src"), F.col("dst")], via)


def meetings(callers: DataFrame, groups: DataFrame, least: int = 2) -> DataFrame:
    """Unchanged callers that reach at least ``least`` groups: ``caller, groups``. ``callers`` has ``caller, node``."""
    outside = callers.join(groups.select(F.col("node").alias("caller")).distinct(), "caller", "left_anti")
    met = outside.join(groups, "node").select("caller", "grp").distinct()
    return met.groupBy("caller").agg(F.array_sort(F.collect_list("grp")).alias("groups")).where(F.size("groups") >= least)
