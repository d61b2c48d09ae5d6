"""Answers to an agent's questions, over landed tables. Every list tells whether it is complete, and why not.

Tables: ``cards(id, label, kind)``, ``members(card, change, ord)``, ``changes(id, label, path, start_line, end_line, kinds,
base_sig, head_sig, score, callers_complete, reason, deleted)``, ``callers(change, path, line, label, is_test, call_state)``,
``lines(side, path, line, text)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evidence, graph, hints, impact, orders, ranking, review, sets

MOST_SOURCE_LINES = 400
MOST_HITS = 200


def list_cards(cards: DataFrame, members: DataFrame, changes: DataFrame, callers: DataFrame, page: int | None = None, size: int | None = None, impact_rows: DataFrame | None = None, seams: DataFrame | None = None) -> DataFrame:
    """Cards with their statistics, those with the highest scoring member first; with their impact and their seams by kind where these are given."""
    states = evidence.caller_states(callers, ["change"])
    rows = members.join(changes, members.change == changes.id).select("card", "change", "score", "kinds", "callers_complete").join(states, "change", "left").fillna(0, ["callers", "stale", "stale_changed", "tests"])
    stats = rows.groupBy("card").agg(
        F.count("*").alias("members"), F.sum("callers").alias("callers"), F.sum("stale").alias("stale"), F.sum("tests").alias("tests"),
        F.count_if(evidence.is_finding(F.col("kinds"))).alias("risky"), F.count_if(~F.col("callers_complete")).alias("incomplete"), F.max("score").alias("top_score"))
    joined = cards.join(stats, cards.id == stats.card, "left").drop("card").fillna(0)
    if impact_rows is not None:
        own = impact_rows.select(F.col("card").alias("id"), "entry_points", F.col("complete").alias("impact_complete"), F.col("reasons").alias("impact_reasons"))
        joined = joined.join(own, "id", "left")
    if seams is not None:
        kinds = hints.seam_counts(seams).groupBy(F.col("card").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("seams"))
        joined = joined.join(kinds, "id", "left")
    return ranking.page(joined, [F.desc("top_score"), F.col("id")], page, size)


def get_card(card: str, members: DataFrame, changes: DataFrame, page: int | None = None, size: int | None = None) -> DataFrame:
    rows = members.where(F.col("card") == card).join(changes, F.col("change") == F.col("id")).select("id", "label", "path", "start_line", "end_line", "kinds", "score")
    return ranking.page(rows, [F.desc("score"), F.col("id")], page, size)


def card_facts(card: str, impact_rows: DataFrame, ends: DataFrame, members: DataFrame, seams: DataFrame, hints_: DataFrame, most_seams: int = 30, most_hints: int = 10) -> dict[str, DataFrame]:
    """What a card's answer has beside its members: ``impact`` (one row), ``entries``, ``paths``, ``seams`` and ``hints``, each in its order.

    ``impact_rows`` is :func:`~spanloom.operators.impact.card_impact`, ``ends`` and ``members`` what it was made from; ``seams`` has ``type,
    cards, place, via_count``, ``hints_`` is :func:`~spanloom.operators.hints.hints`, of which six pieces of evidence are shown.
    """
    own = members.where(F.col("card") == card)
    reached = ends.join(own.select(F.col("change").alias("id")), "id", "left_semi")
    shown = seams.where(F.array_contains("cards", card)).orderBy(F.array_position(F.array(*[F.lit(x) for x in hints.SEAM_TYPES]), F.col("type")), F.transform("cards", hints.card_order), F.coalesce("place", F.lit(""))).limit(most_seams)
    together = hints_.where((F.col("a") == card) | (F.col("b") == card)).orderBy("position").limit(most_hints).select("a", "b", "strength", F.slice("evidence", 1, 6).alias("evidence"))
    return {
        "impact": impact_rows.where(F.col("card") == card), "entries": impact.card_entries(own, reached).orderBy("position"), "paths": impact.card_paths(own, reached).orderBy("position"),
        "seams": shown, "hints": together,
    }


def get_change(change: str, changes: DataFrame, callers: DataFrame, hunks: DataFrame | None = None, calls: DataFrame | None = None, reach: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """One row: signatures, kinds, caller counts; a deleted change is incomplete, with the reason.

    Where they are given also ``hunk, hunk_complete`` (:func:`~spanloom.sources.changes.function_hunks`), calls gained and lost
    (:func:`~spanloom.functions.code.call_changes` by ``id``), the test reach (:func:`~spanloom.operators.graph.reach_states`) and the ``paths``
    shown (:func:`~spanloom.operators.impact.top_paths`). A deleted change has none of them: its former callers are not searched.
    """
    row = changes.where(F.col("id") == change)
    states = evidence.caller_states(callers.where(F.col("change") == change), ["change"])
    complete = F.col("callers_complete") & ~F.col("deleted")
    reasons = F.array_compact(F.array(F.when(F.col("deleted"), F.lit("deleted: callers were not searched")), F.when(~F.col("callers_complete"), F.coalesce("reason", F.lit("search did not finish")))))
    joined = row.join(states, row.id == states.change, "left").fillna(0, ["callers", "stale", "tests"])
    out = joined.select("id", "label", "path", "base_sig", "head_sig", "kinds", "callers", "stale", "tests", "deleted", complete.alias("complete"), reasons.alias("reasons"))
    live = ~F.coalesce("deleted", F.lit(False))
    only = lambda df, key: df.where(F.col(key) == change).withColumnRenamed(key, "id")
    if hunks is not None:
        out = out.join(only(hunks, "id").select("id", F.col("text").alias("__hunk"), F.col("complete").alias("__whole")), "id", "left").select(*out.columns, F.when(live, F.col("__hunk")).alias("hunk"), (live & F.coalesce("__whole", F.lit(False))).alias("hunk_complete"))
    if calls is not None:
        fields = ["added", "added_more", "removed", "removed_more"]
        out = out.join(only(calls, "id").select("id", *[F.col(c).alias(f"__{c}") for c in fields]), "id", "left").select(*out.columns, *[F.when(live, F.col(f"__{c}")).alias(f"calls_{c}") for c in fields])
    if reach is not None:
        out = out.join(only(reach, "start").select("id", F.col("state").alias("__state"), F.col("reason").alias("__why")), "id", "left").select(*out.columns, F.when(live, F.coalesce("__state", F.lit("unknown"))).alias("test_state"), F.when(live, F.col("__why")).alias("test_reason"))
    if paths is not None:
        listed = only(paths, "id").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "end", "via", "through_stale"))), lambda p: F.struct(p["end"].alias("end"), p["via"].alias("via"), p["through_stale"].alias("through_stale"))).alias("__paths"))
        out = out.join(listed, "id", "left").select(*out.columns, F.when(live, F.col("__paths")).alias("paths"))
    return out.drop("deleted")


def callers_of(path: str, line: int, changes: DataFrame, callers: DataFrame, name: str | None = None) -> DataFrame:
    """Callers of the innermost change that holds a line, or has the name; tests last, then those not updated first."""
    at = changes.where((F.col("path") == path) & (F.col("start_line") <= line) & (F.col("end_line") >= line))
    if name:
        at = at.where((F.col("label") == name) | F.col("label").endswith("." + name))
    best = at.orderBy(F.col("end_line") - F.col("start_line"), "id").limit(1).select(F.col("id").alias("change"), F.col("callers_complete").alias("complete"))
    order = F.when(F.col("is_test"), 3).when(F.col("call_state") == "unchanged", 0).when(F.col("call_state") == "changed-elsewhere", 1).otherwise(2)
    return callers.join(F.broadcast(best), "change").withColumn("order", order).orderBy("order", "path", "line", "label")  # best is one row


def validate_cards(answer: DataFrame, required: DataFrame) -> DataFrame:
    """Errors of a card set: changes that are missing, unknown or placed twice, and cards without a title."""
    placed = sets.placement_errors(required.select("change"), answer.select("change"), "change").select(F.col("change").alias("subject"), "error")
    untitled = answer.where("title IS NULL OR trim(title) = ''").select(F.col("card").alias("subject"), F.lit("no title").alias("error")).distinct()
    return placed.union(untitled)


def _mention(line, name, call: bool = False):
    """Whether code names something as a whole word; with ``call``, before a bracket."""
    tail = F.lit(r"\s*(?:<[^>]*>)?\s*\(") if call else F.lit(r"(?![\w$])")
    return F.regexp_like(line, F.concat(F.lit(r"(?<![\w$])\Q"), name, F.lit(r"\E"), tail))


def check_evidence(claims: DataFrame, lines: DataFrame) -> DataFrame:
    """Whether each claim (``path, line, callee``) holds: ``ok`` if the line or one beside it names the callee outside a comment, ``call`` if before a bracket.

    ``complete`` is false where the file has no such line.
    """
    near = claims.withColumn("at", F.explode(F.array(F.col("line") - 1, F.col("line"), F.col("line") + 1)))
    head = lines.where("side = 'head'")
    text = head.select("path", F.col("line").alias("at"), F.regexp_replace("text", r"//.*$|#.*$", "").alias("code"))
    sizes = head.join(claims.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.max("line").alias("size"))
    found = near.join(text, ["path", "at"], "left").groupBy("path", "line", "callee").agg(
        F.coalesce(F.bool_or(_mention(F.col("code"), F.col("callee"))), F.lit(False)).alias("ok"), F.coalesce(F.bool_or(_mention(F.col("code"), F.col("callee"), True)), F.lit(False)).alias("call"))
    return found.join(sizes, "path", "left").select("path", "line", "callee", "ok", "call", (F.col("line") <= F.coalesce("size", F.lit(0))).alias("complete"))


def get_source(lines: DataFrame, path: str, first: int, last: int, side: str = "head") -> DataFrame:
    """Lines of a file, at most 400; ``cut`` tells whether more were asked for."""
    end = min(last, first + MOST_SOURCE_LINES - 1)
    return lines.where((F.col("side") == side) & (F.col("path") == path) & F.col("line").between(first, end)).select("line", "text", F.lit(last > end).alias("cut")).orderBy("line")


def list_files(lines: DataFrame, prefix: str = "", page: int | None = None, size: int | None = 200) -> DataFrame:
    files = lines.where((F.col("side") == "head") & F.col("path").startswith(prefix)).groupBy("path").agg(F.count("*").alias("lines"))
    return ranking.page(files, [F.col("path")], page, size)


def search_code(lines: DataFrame, text: str, prefix: str = "", most: int = MOST_HITS) -> DataFrame:
    """Head lines that hold a fixed string, in order, at most ``most``; ``capped`` tells whether there are more."""
    hits = lines.where((F.col("side") == "head") & F.col("path").startswith(prefix) & F.col("text").contains(text)).select("path", "line", "text")
    first = hits.orderBy("path", "line").limit(most + 1)
    return first.orderBy("path", "line").limit(most).withColumn("capped", first.agg(F.count("*") > most).scalar())


def submitted(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """The store with new payloads appended: an equal payload for the same head and kind is not stored twice."""
    key = F.sha2(F.concat_ws("\n", "head", "kind", "payload"), 256)
    fresh = incoming.withColumn("digest", key).dropDuplicates(["digest"]).join(store.select("digest"), "digest", "left_anti")
    return store.unionByName(fresh.select(*store.columns))


def latest(store: DataFrame) -> DataFrame:
    """Newest payload of each head and kind; of equally new ones the one submitted last."""
    return store.groupBy("head", "kind").agg(F.max_by("payload", F.struct("stored_at", "ord")).alias("payload"), F.max("stored_at").alias("stored_at"))


def find_references(path: str, line: int, changes: DataFrame, sites: DataFrame, name: str | None = None, page: int | None = None, size: int | None = None) -> DataFrame:
    """References to the innermost function at a line, a page of ``path, line, label`` in order, with ``call_sites_only`` and ``complete``.

    ``sites`` has ``change, path, line, label, is_call``. An index that holds call sites only cannot show other uses: its list is never complete.
    """
    best = _innermost_change(path, line, changes, name)
    found = sites.join(F.broadcast(best.select("change", "searched")), "change")  # one row
    calls_only = ~F.coalesce(sites.agg(F.bool_or(~F.col("is_call"))).scalar(), F.lit(False))
    rows = found.select("path", "line", "label", calls_only.alias("call_sites_only"), (F.col("searched") & ~calls_only).alias("complete"))
    return ranking.page(rows, [F.col("path"), F.col("line"), F.col("label")], page, size)


def _innermost_change(path: str, line: int, changes: DataFrame, name: str | None) -> DataFrame:
    at = changes.where((F.col("path") == path) & (F.col("start_line") <= line) & (F.col("end_line") >= line))
    if name:
        at = at.where((F.col("label") == name) | F.col("label").endswith("." + name))
    return at.orderBy(F.col("end_line") - F.col("start_line"), "id").limit(1).select(F.col("id").alias("change"), F.col("label"), F.col("callers_complete").alias("searched"))


def impact_paths(path: str, line: int, changes: DataFrame, edges: DataFrame, facts: DataFrame, name: str | None = None, max_depth: int = 8, max_nodes: int = 300) -> DataFrame:
    """Paths from the innermost function at a line up to entry points, and whether they are all: the ends of :func:`~spanloom.operators.impact.walked`."""
    start = _innermost_change(path, line, changes, name).select(F.col("change").alias("id"), F.col("change").alias("node"), F.lit(False).alias("risky"))
    ends = impact.walked(start, edges, facts, max_depth, max_nodes)
    return ends.join(impact.summary(ends, starts=start).select("id", "complete", "reasons"), "id", "right")


#: Kinds of callers an answer may name.
CALLER_KINDS = ("call", "reference", "registration", "dispatch")


def checked_callers(answer: DataFrame, functions: DataFrame, lines: DataFrame, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """Submitted callers as rows ``function, path, line, kind`` that hold, each once, and the errors ``function, path, line, error``.

    ``answer`` has ``function, path, line, kind`` (null: call), ``functions`` ``id, name, deleted``. A caller needs a relative path, a line
    that exists, a known kind, and the function's name on that line or beside it; a function must be known and not deleted. One error
    rejects its row, and a caller of the result should take no rows of a submission with errors.
    """
    kind = F.coalesce("kind", F.lit("call"))
    named = answer.withColumn("kind", kind).join(functions.select(F.col("id").alias("function"), F.col("name").alias("callee"), F.coalesce("deleted", F.lit(False)).alias("deleted"), F.lit(True).alias("known")), "function", "left")
    counts = answer.groupBy("function").agg(F.count("*").alias("n"))
    relative = F.coalesce(~F.col("path").rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)|\\\\|^$"), F.lit(False))
    early = (
        F.when(F.col("known").isNull(), "unknown function").when(F.col("deleted"), "callers of a deleted function are not accepted").when(F.col("n") > most, f"more than {most} callers")
        .when(~relative, "not a repository-relative path").when(~F.coalesce(F.col("line") >= 1, F.lit(False)), "not a line number").when(~F.col("kind").isin(*CALLER_KINDS), "unknown kind")
    )
    first = named.join(counts, "function").withColumn("error", early)
    held = check_evidence(first.where("error IS NULL").select("path", "line", "callee").distinct(), lines)
    late = F.when(~F.col("complete"), "no such file or line").when(~F.col("ok"), "the function is not named there")
    judged = first.join(held, ["path", "line", "callee"], "left").withColumn("error", F.coalesce("error", late))
    return judged.where("error IS NULL").select("function", "path", "line", "kind").distinct(), judged.where("error IS NOT NULL").select("function", "path", "line", "error")


def facts_within(rows: DataFrame, budget: int, steps: tuple[int, ...] = (6000, 2000, 500, 0)) -> DataFrame:
    """Rows ``ord, text, hunk`` with hunks cut at the first of ``steps`` characters at which all fit the budget, and how much was cut; the last step is taken if none does."""
    sizes = rows.agg(*[F.sum(F.length("text") + F.least(F.length(F.coalesce("hunk", F.lit(""))), F.lit(s))).alias(f"at{s}") for s in steps])
    chosen = F.lit(steps[-1])
    for s in reversed(steps[:-1]):
        chosen = F.when(sizes.select(F.coalesce(f"at{s}", F.lit(0)) <= budget).scalar(), s).otherwise(chosen)
    hunk = F.coalesce("hunk", F.lit(""))
    return rows.select("ord", "text", F.substring(hunk, F.lit(1), chosen.cast("int")).alias("hunk"), F.greatest(F.length(hunk) - chosen, F.lit(0)).cast("int").alias("cut"))


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON documents, sets and arrays as lists, nulls kept: what a run hands to other programs."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))


def report(findings: DataFrame, deleted: DataFrame, reach: DataFrame, skipped: DataFrame) -> DataFrame:
    """A text report as ordered lines ``section, position, line``: ranked findings, deleted functions, what entry points are reached, and what was not analysed.

    ``findings`` has ``score, label, path, line, callers, stale``, ``deleted`` ``label, path``, ``reach`` ``label, type, name, depth``, ``skipped`` ``path, reason``.
    """
    def section(n: int, df: DataFrame, line, order: list) -> DataFrame:
        return df.select(F.lit(n).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("position"), line.alias("line"))

    text = lambda *cs: F.concat(*[F.lit(c[1:]) if c.startswith("'") else F.col(c).cast("string") for c in cs])
    return (
        section(1, findings, text("score", "'  ", "label", "'  ", "path", "':", "line", "'  ", "stale", "' of ", "callers", "' callers not updated"), [F.desc("score"), F.col("label")])
        .unionByName(section(2, deleted, text("'deleted ", "label", "'  ", "path"), [F.col("path"), F.col("label")]))
        .unionByName(section(3, reach, text("label", "' reaches ", "type", "': ", "name", "' (", "depth", "')"), [F.col("label"), F.col("depth"), F.col("name")]))
        .unionByName(section(4, skipped, text("'not analysed ", "path", "': ", "reason"), [F.col("path")]))
    )


def run(changes: DataFrame, callers: DataFrame, edges: DataFrame, facts: DataFrame, *, roots: int = 6, depth: int = 1, impact_paths: bool = False, max_depth: int = 8, max_nodes: int = 300) -> dict[str, DataFrame]:
    """A whole review by name: ``findings`` ranked, ``roots`` with their blast radius, ``subsets``, and with ``impact_paths`` the ``ends`` and ``impact`` of every finding.

    ``changes`` has ``id, label, path, kinds, score, test_state, caller_state``, ``callers`` as in :func:`get_change`, ``edges`` and ``facts`` as in the walk.
    """
    depth, roots = ranking.whole_number(depth, 1, 6, "depth"), ranking.whole_number(roots, 6, 50, "roots")
    states = evidence.caller_states(callers, ["change"])
    scored = changes.join(states, changes.id == states.change, "left").drop("change").fillna(0, ["callers", "stale", "stale_changed", "tests"])
    findings = orders.changes(scored.where(evidence.is_finding(F.col("kinds"))).withColumn("ord", F.col("id")))
    called = edges.join(changes.select(F.col("id").alias("dst")), "dst", "left_semi").join(changes.select(F.col("id").alias("src")), "src", "left_semi")
    ranks = changes.select(F.col("id").alias("node"), "score", "label")
    # A change that calls no other change is a root; one of each ring that calls nothing outside stands for it.
    lone = ranks.join(called.select(F.col("src").alias("node")).union(called.select("dst")).distinct(), "node", "left_anti").select("node")
    tops = lone.union(graph.roots(called.select("src", "dst"), ranks).select("node")) if not called.isEmpty() else lone
    ranked = tops.join(ranks, "node").select("node", "score")
    out = {"findings": findings, "roots": impact.shown_roots(ranked, impact.blast_radius(ranked.select(F.col("node").alias("start")), edges, depth), roots), "subsets": review.state_subsets(changes)}
    if impact_paths:
        starts = findings.select("id", F.col("id").alias("node"), F.lit(True).alias("risky"))
        out["ends"] = impact.walked(starts, edges, facts, max_depth, max_nodes)
        out["impact"] = impact.summary(out["ends"], starts=starts)
    return out
