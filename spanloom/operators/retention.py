"""Retention: which snapshots, results and keys to drop, by ordered rules with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import positioned


def older_than(created: Column, now: Column, milliseconds: int) -> Column:
    """Strictly older: a row of exactly that age stays."""
    return (now - created) > milliseconds


def cleanup_plan(snapshots: DataFrame, live_branches: DataFrame | None, *, now_ms: int, keep: int = 2, max_age_ms: int = 30 * 86_400_000, grace_ms: int = 3_600_000, current: str | None = None, include_current: bool = False) -> DataFrame:
    """Adds ``action`` and ``reason`` to ``snapshots(id, sha, round, branch, created_ms)``; the first rule that fits decides.

    The current snapshot stays unless it is asked for. A snapshot without a round was replaced by a newer one and goes once
    it is over ``grace_ms`` old. The newest ``keep`` snapshots with a round stay, over all branches, gone ones too. Others go when
    strictly older than ``max_age_ms``, then when their branch is gone, which is known only where ``live_branches`` is given.
    """
    is_current = F.col("sha").eqNullSafe(F.lit(current)) & F.lit(current is not None)
    counted = F.col("round").isNotNull() & ~(is_current & F.lit(include_current))
    newest_ = snapshots.where(counted).orderBy(F.desc("created_ms"), "id").limit(keep).select(F.col("id").alias("__newest"))
    rows = snapshots.join(F.broadcast(newest_), F.col("id") == F.col("__newest"), "left")  # ``keep`` rows
    if live_branches is None:
        gone = F.lit(False)
    else:
        live = live_branches.select(F.col("branch").alias("__live")).distinct()
        rows = rows.join(live, F.col("branch") == F.col("__live"), "left")
        gone = F.col("branch").isNotNull() & F.col("__live").isNull()
    age = lambda ms: older_than(F.col("created_ms"), F.lit(now_ms), ms)
    reason = (
        F.when(is_current, "current").when(F.col("round").isNull(), F.when(age(grace_ms), "replaced").otherwise("just replaced"))
        .when(F.col("__newest").isNotNull(), "newest").when(age(max_age_ms), "too old").when(gone, "branch gone").otherwise("kept")
    )
    goes = reason.isin("replaced", "too old", "branch gone") | ((reason == "current") & F.lit(include_current))
    return rows.select(*[F.col(c) for c in snapshots.columns], F.when(goes, "delete").otherwise("keep").alias("action"), reason.alias("reason"))


def key_plan(keys: DataFrame, live_branches: DataFrame | None, *, now_ms: int, max_age_ms: int = 90 * 86_400_000, active: str | None = None) -> DataFrame:
    """``action, reason`` for review keys ``key, branch, last_used_ms``: the active one stays, a key without a stamp never ages, then gone branches."""
    rows, gone = keys, F.lit(False)
    if live_branches is not None:
        live = live_branches.select(F.col("branch").alias("__live")).distinct()
        rows = keys.join(live, F.col("branch") == F.col("__live"), "left")
        gone = F.col("branch").isNotNull() & F.col("__live").isNull()
    old = F.coalesce(older_than(F.col("last_used_ms"), F.lit(now_ms), max_age_ms), F.lit(False))
    reason = F.when(F.col("key").eqNullSafe(F.lit(active)), "active").when(old, "unused").when(gone, "branch gone").otherwise("kept")
    return rows.select(*[F.col(c) for c in keys.columns], F.when(reason.isin("unused", "branch gone"), "delete").otherwise("keep").alias("action"), reason.alias("reason"))


def summary(plan: DataFrame, size: str) -> DataFrame:
    return plan.groupBy("action", "reason").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))


def newest(df: DataFrame, group: list[str], order: str, n: int, tie: str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(order), F.desc(tie)))).where(F.col("__n") <= n).drop("__n")


def newest_heads(results: DataFrame, head: str = "head", stored_at: str = "stored_at", tie: str = "id", per_head: int = 20, heads: int = 10) -> DataFrame:
    """At most ``per_head`` results of each head, and of the ``heads`` heads whose latest result is newest."""
    latest = results.groupBy(head).agg(F.max(stored_at).alias("latest")).orderBy(F.desc("latest"), F.desc(head)).limit(heads)
    return newest(results.join(latest.select(head), head, "left_semi"), [head], stored_at, per_head, tie)


def upsert_rounds(rounds: DataFrame, incoming: DataFrame, number: str = "round", keep: int = 5) -> DataFrame:
    """Rounds with the same number are replaced by the incoming ones; the newest ``keep`` numbers stay."""
    kept = rounds.join(incoming.select(number).distinct(), number, "left_anti").unionByName(incoming)
    return kept.join(kept.select(number).distinct().orderBy(F.desc(number)).limit(keep), number, "left_semi")


def chosen_remote(remotes: DataFrame, setting: str | None) -> DataFrame:
    """``repo, kind, remote``: of usable remotes ``repo, name`` the one that is set; a setting that names none is ``bad-setting``, without a fallback.

    Without a setting upstream, else origin, else the only one; several others are ``ambiguous``, and none at all (rows with a
    null name) is ``none``.
    """
    has = lambda name: F.max(F.when(F.col("name") == name, F.col("name")))
    if setting:
        found = remotes.groupBy("repo").agg(has(setting).alias("remote"))
        return found.select("repo", F.when(F.col("remote").isNull(), "bad-setting").otherwise("ok").alias("kind"), "remote")
    found = remotes.groupBy("repo").agg(F.countDistinct("name").alias("n"), F.coalesce(has("upstream"), has("origin"), F.when(F.countDistinct("name") == 1, F.min("name"))).alias("remote"))
    kind = F.when(F.col("n") == 0, "none").when(F.col("remote").isNull(), "ambiguous").otherwise("ok")
    return found.select("repo", kind.alias("kind"), "remote")


def used_keys(keys: DataFrame, usage: DataFrame, most: int = 1000) -> DataFrame:
    """Review keys ``key`` with when they were last used, from the ``most`` newest stamps of ``usage(key, last_used_ms)``; keys without a stamp have null."""
    stamped = usage.where("last_used_ms IS NOT NULL").groupBy("key").agg(F.max("last_used_ms").alias("last_used_ms"))
    return keys.select("key").distinct().join(stamped.orderBy(F.desc("last_used_ms"), "key").limit(most), "key", "left")


def recent(uses: DataFrame, most: int = 5) -> DataFrame:
    """Most recently used values of ``user, value, ord``, newest first, each once: ``user, value, position``."""
    last = uses.groupBy("user", "value").agg(F.max("ord").alias("ord"))
    return last.withColumn("position", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("ord")))).where(F.col("position") <= most).select("user", "value", "position")


#: Picker sections in order.
PICKER_GROUPS = ("recent", "requested", "own", "others")


def picker_rows(pulls: DataFrame, recent_numbers: DataFrame) -> DataFrame:
    """Rows of a picker: recent ones first in their order, then requested, own and others in display order: ``section, number, position``.

    ``pulls`` has ``number, grp, ord`` (:func:`~spanloom.operators.callers.grouped_requests`), ``recent_numbers`` has ``number, position``. A
    pull request is listed once.
    """
    last = pulls.join(recent_numbers.select("number", F.col("position").alias("__recent")), "number", "left")
    section = F.when(F.col("__recent").isNotNull(), "recent").otherwise(F.col("grp"))
    rank = F.array_position(F.array(*[F.lit(x) for x in PICKER_GROUPS]), section)
    listed = last.select(section.alias("section"), "number", rank.alias("__rank"), F.coalesce("__recent", "ord").alias("__ord"))
    return positioned(listed, [F.col("__rank"), F.col("__ord"), F.col("number")]).select("section", "number", "position")


def round_rows(items: DataFrame, statuses: DataFrame, changed: DataFrame) -> DataFrame:
    """Items of a feedback round with status, reason, code change and whether they need attention.

    ``items`` has ``round, item``, ``statuses`` ``round, item, status, reason``, ``changed`` ``round, item, change`` (changed, unchanged, unknown). An
    item that no status is known of is unreadable, one without a change unknown. Only two pairs are fine: the code changed, and
    the answer is done or says nothing.
    """
    rows = items.join(statuses, ["round", "item"], "left").join(changed, ["round", "item"], "left")
    status, change = F.coalesce("status", F.lit("unreadable")), F.coalesce("change", F.lit("unknown"))
    reason = F.when(F.col("status").isNull(), "not in the status list").otherwise(F.col("reason"))
    fine = (change == "changed") & status.isin("done", "none")
    return rows.select("round", "item", status.alias("status"), reason.alias("reason"), change.alias("change"), (~fine).alias("attention"))


def view_state(repo: Column, phase: Column, busy: Column, has_state: Column, has_result: Column, early: Column, problem: Column, error: Column, unanalysable: Column, unchanged: Column) -> Column:
    """What a view shows; the first case that fits. ``early`` marks a result that may be read while the run still works on it."""
    working = phase.isin("analysing", "preparing") | busy
    return (
        F.when(repo != "ok", repo).when(working & has_result & early, "shown").when(phase.isin("starting", "preparing", "analysing", "checkingOut") | busy, "busy")
        .when(has_state & problem, "problem").when(~has_state | (~has_result & ~error), "idle").when(error, "error").when(unanalysable, "noTypeScript")
        .when(unchanged, "nothingChanged").otherwise("shown")
    )
