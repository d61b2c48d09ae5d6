"""Review models: verdicts, attention, roll-ups over folders, thread counts, agreement and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import stabbed
from .tables import stored, stored_with_count


def verdict_level(risky: Column, stale: Column, complete: Column, state: Column, has_graph: Column | None = None) -> Column:
    """0 breaks callers, 1 risk unknown, 2 risk handled, 3 reaches callers, 4 quiet, 5 no graph.

    ``state`` is resolved, none, di or unknown; only the first two are answers. ``complete`` is null in old results, which read
    as complete. A risky change whose search is finished is handled, with callers or without; a change of the body alone is
    quiet only if a finished search found no caller.
    """
    known, missing = F.coalesce(state.isin("resolved", "none"), F.lit(False)), ~F.coalesce(complete, F.lit(True))
    of_risky = F.when(stale > 0, 0).when(missing | ~known, 1).otherwise(2)
    of_body = F.when(known & (state == "none") & ~missing, 4).otherwise(3)
    level = F.when(risky, of_risky).otherwise(of_body)
    return level if has_graph is None else F.when(~has_graph, 5).otherwise(level)


def attention(level: Column, named_by_agent: Column, analysed: Column) -> Column:
    return (level <= 1) | F.coalesce(named_by_agent, F.lit(False)) | ~analysed


def parents_with_matching_children(parents: DataFrame, children: DataFrame, key: str, keep: Column) -> DataFrame:
    return parents.join(children.where(keep).select(key).distinct(), key, "left_semi")


#: What the list of files may be filtered by.
FILTERS = ("all", "attention", "unreviewed", "threads")


def filtered_files(files: DataFrame, rows: DataFrame, mode: str = "all") -> tuple[DataFrame, DataFrame]:
    """The files that pass a filter, and the rows that do: ``attention`` (needs attention and is not reviewed), ``unreviewed``, ``threads`` (has open ones) or ``all``.

    ``files`` has ``path, threads`` (open threads that sit on none of its rows), ``rows`` ``path, attention, reviewed, threads``. A file
    stays if one of its rows passes; by threads also if it has open ones of its own. A null counts as no, or none.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    some = F.coalesce("threads", F.lit(0)) > 0
    passes = {"all": F.lit(True), "attention": yes("attention") & ~yes("reviewed"), "unreviewed": ~yes("reviewed"), "threads": some}[mode]
    kept = rows.where(passes)
    here = kept.select("path").union(files.where(some).select("path")) if mode == "threads" else kept.select("path")
    return files.join(here.distinct(), "path", "left_semi"), kept


def review_counts(rows: DataFrame) -> DataFrame:
    """Totals of rows with ``reviewed`` and ``attention``."""
    return rows.agg(F.count("*").alias("total"), F.count_if(~F.col("reviewed")).alias("unreviewed"), F.count_if("attention").alias("attention"), F.count_if(F.col("attention") & ~F.col("reviewed")).alias("attention_left"))


def ancestors(path: Column) -> Column:
    """All folders above a path, from the top: ``a/b/c.x`` gives ``a`` and ``a/b``."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def folder_rollup(files: DataFrame, path: str = "path", level: str = "level", weight: str = "attention", row: str | None = None) -> DataFrame:
    """Each folder's file count, worst (least) level and summed attention over everything below it; ``worst_row`` where ``row`` names the rows.

    The worst row is the one of the least level, of several the one that comes first in the order of ``row``.
    """
    worst = [F.min_by(F.col(row), F.struct(level, row)).alias("worst_row")] if row else []
    return files.withColumn("folder", F.explode(ancestors(F.col(path)))).groupBy("folder").agg(F.count("*").alias("files"), F.min(level).alias("worst"), F.sum(weight).alias("attention"), *worst)


def compacted_folders(rollup: DataFrame, direct: DataFrame) -> DataFrame:
    """The folders that are shown, ``rollup``'s columns with ``name``, ``shown_parent`` and ``depth``: chains of single folders are one row.

    A folder without files of its own and with one subfolder is drawn as part of that one's name (``a/b``). ``rollup`` has ``folder`` (a row
    for every folder that holds anything below it), ``direct`` has ``folder, files`` that lie in the folder itself. ``shown_parent`` is
    the shown folder above (null at the top) and ``depth`` the number of shown folders above. Both follow from pointer doubling up
    the folders, so deep paths take few rounds.
    """
    parent = F.nullif(F.regexp_extract("folder", r"^(.*)/[^/]+$", 1), F.lit(""))
    known = rollup.select("folder", parent.alias("parent"))
    subs = known.where("parent IS NOT NULL").groupBy(F.col("parent").alias("folder")).agg(F.count("*").alias("subfolders"))
    own = direct.groupBy("folder").agg(F.sum("files").alias("own"))
    marked = known.join(subs, "folder", "left").join(own, "folder", "left").withColumn("folds", (F.coalesce("subfolders", F.lit(0)) == 1) & (F.coalesce("own", F.lit(0)) == 0))
    marked = marked.join(marked.select(F.col("folder").alias("parent"), F.lit(True).alias("there")), "parent", "left")
    now = stored(marked.select("folder", "folds", F.when(F.col("there"), F.col("parent")).alias("up")), "folders")
    near, n = now.select("folder", "up"), 1
    while n:  # a folder that folds points as far up as it has come, so the way that is left halves
        above = near.join(now.select("folder", "folds"), "folder").select(F.col("folder").alias("up"), F.col("folds").alias("moved"), F.col("up").alias("next"))
        moved = near.join(above, "up", "left").select("folder", F.when(F.col("moved"), F.col("next")).otherwise(F.col("up")).alias("up"), F.coalesce("moved", F.lit(False)).alias("moved"))
        moved, n = stored_with_count(moved, "folders-near", F.col("moved"))
        near = moved.select("folder", "up")
    tree = near.join(now.where("NOT folds").select("folder"), "folder", "left_semi").select("folder", F.col("up").alias("shown_parent"))
    deep, n = tree.select("folder", F.col("shown_parent").alias("up"), F.col("shown_parent").isNotNull().cast("int").alias("depth")), 1
    while n:
        step = deep.select(F.col("folder").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        further = deep.join(step, "up", "left").select("folder", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        deep, n = stored_with_count(further, "folders-depth", F.col("up").isNotNull())
    named = tree.join(deep.select("folder", "depth"), "folder")
    name = F.when(F.col("shown_parent").isNull(), F.col("folder")).otherwise(F.substr("folder", F.length("shown_parent") + 2))
    return rollup.join(named.select("folder", name.alias("name"), "shown_parent", "depth"), "folder")


def nearest_config(paths: DataFrame, configs: DataFrame, path: str = "path", folder: str = "folder") -> DataFrame:
    """Deepest folder above each path that has a config; null where none has."""
    wanted = paths.select(path).distinct().withColumn("__f", F.explode_outer(ancestors(F.col(path))))
    known = configs.select(F.col(folder).alias("__f")).distinct().withColumn("__known", F.lit(True))
    found = wanted.join(known, "__f", "left")
    return found.groupBy(path).agg(F.max_by(F.when(F.col("__known"), F.col("__f")), F.when(F.col("__known"), F.length("__f"))).alias(folder))


def thread_counts(comments: DataFrame, thread: list[str]) -> DataFrame:
    """Per thread: posted and pending comments, and whether it is open (unresolved with a posted comment).

    ``comments`` has ``pending`` and ``resolved``.
    """
    posted = ~F.col("pending")
    return comments.groupBy(*thread).agg(F.count_if(posted).alias("posted"), F.count_if("pending").alias("pending"), (~F.bool_or("resolved") & F.bool_or(posted)).alias("open"))


def agreed(rows: DataFrame, group: list[str], status: str, reason: str) -> DataFrame:
    """The one status of a group's lines (:func:`~spanloom.functions.text.status_line`): ``none`` lines do not count, and a single other one stands.

    Several must agree in status and reason and be readable; else the group is ``unreadable``.
    """
    said = F.col(status) != "none"
    one = F.struct(F.col(status).alias("status"), F.col(reason).alias("reason"))
    found = rows.groupBy(*group).agg(F.count_if(said).alias("n"), F.min(F.when(said, one)).alias("low"), F.max(F.when(said, one)).alias("high"))
    same = F.col("low").eqNullSafe(F.col("high")) & (F.col("low.status") != "unreadable")
    lone = (F.col("n") == 1) | same
    status_ = F.when(F.col("n") == 0, "none").when(lone, F.col("low.status")).otherwise("unreadable")
    reason_ = F.when(F.col("n") == 0, F.lit(None).cast("string")).when(lone, F.col("low.reason")).otherwise("conflicting status lines")
    return found.select(*group, status_.alias("status"), reason_.alias("reason"))


def completeness(parts: DataFrame, group: list[str]) -> DataFrame:
    """Complete only if every part is; reasons once each, in order. ``parts`` has ``complete`` and ``reason``."""
    reasons = F.array_sort(F.collect_set(F.when(~F.col("complete"), F.col("reason"))))
    return parts.groupBy(*group).agg(F.bool_and("complete").alias("complete"), reasons.alias("reasons"))


def rederived_state(before: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Caller state after a filter: ``resolved`` with callers left, ``none`` if the search was complete, else ``unknown``."""
    left = kept.groupBy(key).agg(F.count("*").alias("callers"))
    state = F.when(F.coalesce("callers", F.lit(0)) > 0, "resolved").when(F.col("complete"), "none").otherwise("unknown")
    return before.join(left, key, "left").select(key, state.alias("state"), F.coalesce("callers", F.lit(0)).alias("callers"))


def merge_state(pulls: DataFrame, checks: DataFrame) -> DataFrame:
    """``number, tone, reasons, retry`` of each pull request; never ``clean`` when unsure.

    ``pulls`` has ``number, state, loaded, is_draft, mergeable, merge_status, review_decision, checks_read, queue, head_moved``, ``checks``
    ``number, name, state, required, ord``. The first case that fits decides: done, not loaded, draft, conflicts, unknown,
    blocked (with why), behind, unstable, else clean. Notes on the queue and a newer head follow.
    """
    needed = checks.where("required")
    said = F.when(F.col("state") == "failed", F.struct(F.lit(0).alias("k"), "ord", F.concat(F.lit("Required check "), "name", F.lit(" failed")).alias("t"))).when(
        F.col("state") == "pending", F.struct(F.lit(1).alias("k"), "ord", F.concat(F.lit("Required check "), "name", F.lit(" has not finished")).alias("t")))
    why = needed.select("number", said.alias("s")).where("s IS NOT NULL").groupBy("number").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]).alias("of_checks"))
    rows = pulls.join(why, "number", "left")
    texts = lambda *items: F.array_compact(F.array(*items))
    none = F.array().cast("array<string>")
    asked = F.concat(F.coalesce("of_checks", none), texts(F.when(F.col("review_decision") == "CHANGES_REQUESTED", F.lit("Changes were requested")), F.when(F.col("review_decision") == "REVIEW_REQUIRED", F.lit("An approving review is required"))))
    unread = F.when(F.col("checks_read"), F.lit("Branch protection blocks the merge")).otherwise(F.lit("The required checks could not all be read"))
    blocked = F.when(F.size(asked) > 0, asked).otherwise(F.array(unread))
    status, mergeable = F.col("merge_status"), F.col("mergeable")
    cases = [
        (F.col("state").isin("MERGED", "CLOSED"), "done", none, False), (~F.col("loaded"), "unknown", none, True),
        (F.col("is_draft") | (status == "DRAFT"), "blocked", F.array(F.lit("Mark it ready for review")), False),
        ((mergeable == "CONFLICTING") | (status == "DIRTY"), "conflict", F.array(F.lit("Resolve the conflicts")), False),
        ((mergeable == "UNKNOWN") | (status == "UNKNOWN"), "unknown", none, True), (status == "BLOCKED", "blocked", blocked, False),
        (status == "BEHIND", "blocked", F.array(F.lit("The branch must be updated first")), False), (status == "UNSTABLE", "clean", F.array(F.lit("Some checks that are not required fail")), False),
    ]
    tone, reasons, retry = F.lit("clean"), none, F.lit(False)
    for condition, name, texts_, again in reversed(cases):
        fits = F.coalesce(condition, F.lit(False))
        tone, reasons, retry = F.when(fits, name).otherwise(tone), F.when(fits, texts_).otherwise(reasons), F.when(fits, F.lit(again)).otherwise(retry)
    notes = texts(F.when(F.col("queue"), F.lit("Merge through the queue")), F.when(F.col("head_moved"), F.lit("There is a newer head than the one reviewed")))
    answered = F.col("loaded") & ~F.col("state").isin("MERGED", "CLOSED")
    return rows.select("number", tone.alias("tone"), F.concat(reasons, F.when(answered, notes).otherwise(none)).alias("reasons"), retry.alias("retry"))


#: The order of reviewers by state.
REVIEWER_STATES = ("CHANGES_REQUESTED", "AWAITING", "APPROVED", "COMMENTED", "DISMISSED")


def reviewers(requested: DataFrame, reviewed: DataFrame, authors: DataFrame) -> DataFrame:
    """``number, kind, name, state, position``: everyone asked or heard, once, in order of :data:`REVIEWER_STATES` and name.

    ``requested`` has ``number, kind (user or team), name``, ``reviewed`` ``number, name, state, ord`` (the last of a name counts),
    ``authors`` ``number, author``. A request wins over an older review; pending reviews and the author's own do not count.
    """
    asked = requested.select("number", "kind", "name").distinct().withColumn("state", F.lit("AWAITING"))
    own = authors.select("number", F.col("author").alias("__author"))
    heard = reviewed.join(own, "number", "left").where((F.col("state") != "PENDING") & ~F.col("name").eqNullSafe(F.col("__author")))
    last = heard.groupBy("number", "name").agg(F.max_by("state", "ord").alias("state")).withColumn("kind", F.lit("user"))
    new = last.join(asked.select("number", "kind", "name"), ["number", "kind", "name"], "left_anti")
    both = asked.unionByName(new)
    rank = F.array_position(F.array(*[F.lit(s) for s in REVIEWER_STATES]), F.col("state"))
    return both.withColumn("position", F.row_number().over(Window.partitionBy("number").orderBy(rank, "name", "kind")))


#: How far a caller is behind, worst last.
CALL_STATES = ("updated-at-call", "changed-elsewhere", "unchanged")


def file_groups(callers: DataFrame, group: list[str], path: str = "path") -> DataFrame:
    """Callers of a change by file: ``callers, call_state`` (the worst), ``changed, is_test`` (all are), ``sites``, and ``flat`` where one caller stands alone.

    ``callers`` has ``call_state, changed, is_test, sites int``.
    """
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in CALL_STATES]), F.col("call_state")), F.lit(0))
    return callers.groupBy(*group, path).agg(
        F.count("*").alias("callers"), F.max_by("call_state", F.struct(rank.alias("r"), "call_state")).alias("call_state"), F.bool_or("changed").alias("changed"),
        F.bool_and("is_test").alias("is_test"), F.sum(F.coalesce("sites", F.lit(0))).alias("sites")).withColumn("flat", F.col("callers") == 1)


def threads_of_range(threads: DataFrame, ranges: DataFrame) -> DataFrame:
    """Threads on head lines of a range: ``ranges(row, path, lo, hi)`` with the threads in it that are on the right, current and of a line.

    ``threads`` has ``thread, path, side, line, outdated, file_level``.
    """
    here = threads.where("side = 'RIGHT' AND NOT outdated AND NOT file_level AND line IS NOT NULL").select("thread", "path", "line")
    return stabbed(here, ranges.select("row", "path", "lo", "hi"), ["path"], "line", [F.col("row").alias("row")]).select("row", "thread", "path", "line")


def threads_of_side(threads: DataFrame, side: str) -> DataFrame:
    """Threads drawn on one side of each file, in order of line and id: those on a line of the current diff."""
    shown = threads.where((F.col("side") == side) & ~F.col("outdated") & ~F.col("file_level") & F.col("line").isNotNull())
    return shown.withColumn("position", F.row_number().over(Window.partitionBy("path").orderBy("line", "thread")))


#: Schema of landed review data: a JSON document a pull request.
REVIEW = "number long, state string, threads array<struct<id:string,path:string,side:string,line:int,outdated:boolean,file_level:boolean,resolved:boolean,comments:array<struct<id:string,body:string,pending:boolean>>>>"


def review_rows(landed: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Landed review JSON as typed rows of comments, ``number, thread, path, side, line, outdated, file_level, resolved, comment, body, pending``, and the
    documents that cannot be read (no JSON, no number, or a side that is neither LEFT nor RIGHT)."""
    read = landed.withColumn("__r", F.from_json(text, REVIEW))
    odd = F.exists("__r.threads", lambda t: ~F.coalesce(t["side"].isin("LEFT", "RIGHT"), F.lit(True)) | t["id"].isNull() | t["path"].isNull())
    good = F.col("__r").isNotNull() & F.col("__r.number").isNotNull() & ~F.coalesce(odd, F.lit(False))
    threads = read.where(good).select("__r.number", F.explode("__r.threads").alias("t"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    rows = threads.select("number", F.col("t.id").alias("thread"), "t.path", "t.side", "t.line", flag(F.col("t.outdated")).alias("outdated"), flag(F.col("t.file_level")).alias("file_level"), flag(F.col("t.resolved")).alias("resolved"), F.explode_outer("t.comments").alias("c"))
    rows = rows.select(*[c for c in rows.columns if c != "c"], F.col("c.id").alias("comment"), "c.body", flag(F.col("c.pending")).alias("pending"))
    return rows, read.where(~good).drop("__r")


def is_incomplete(result: dict[str, DataFrame]) -> Column:
    """Whether anything of a run is incomplete: any of the tables (each with ``complete``) has a row that is not."""
    parts = [F.coalesce(t.agg(F.bool_or(~F.coalesce("complete", F.lit(True)))).scalar(), F.lit(False)) for t in result.values()]
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


#: Subsets of changes by state.
STATE_SUBSETS = {"untested": "test_state = 'uncovered'", "test_unknown": "test_state = 'unknown'", "unknown_callers": "caller_state IN ('unknown', 'di')"}


def state_subsets(changes: DataFrame) -> DataFrame:
    """``subset, id`` for each of :data:`STATE_SUBSETS`; a change may be in several."""
    names = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in STATE_SUBSETS.items()]))
    return changes.select(F.explode(names).alias("subset"), "id")
