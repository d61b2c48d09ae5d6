"""Caller lists: merging answers of several searches, type relations, bus edges, and users that a search did not list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import names_match


def merged(lists: DataFrame) -> DataFrame:
    """Rows of several answers as one per ``change, path, pos``: all call sites once, and the label only if all agree on it.

    ``lists`` has ``change, path, pos, label, sites array<int>, complete, reason``; ``complete`` is true only if all parts are.
    """
    label = F.when(F.countDistinct("label") <= 1, F.min("label"))
    reasons = F.array_sort(F.collect_set(F.when(~F.col("complete"), F.col("reason"))))
    return lists.groupBy("change", "path", "pos").agg(label.alias("label"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sites")))).alias("sites"), F.bool_and("complete").alias("complete"), reasons.alias("reasons"))


def preferred(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; where a key is in both, those of the first."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def related_types(targets: DataFrame, closure: DataFrame, overrides: DataFrame) -> DataFrame:
    """``target, type`` for the target itself, its sub- and supertypes, without types that declare the method anew.

    ``closure`` has ``sub, sup``; ``overrides`` has ``target, type``.
    """
    own = targets.select("target", F.col("target").alias("type"))
    below = targets.join(closure, targets.target == closure.sup).select("target", F.col("sub").alias("type"))
    above = targets.join(closure, targets.target == closure.sub).select("target", F.col("sup").alias("type"))
    other = below.union(above).distinct().join(overrides, ["target", "type"], "left_anti")
    return own.union(other).distinct()


def without_inherited(callers: DataFrame, site_types: DataFrame, declaring: DataFrame, related: DataFrame) -> DataFrame:
    """Drops a caller only if an ancestor declares the method, every site of the caller has a type, and none is related.

    ``callers`` has ``change, path, pos, target``; ``site_types`` has ``change, path, pos, type`` (null: not known);
    ``declaring`` lists targets whose ancestor declares the method; ``related`` is :func:`related_types`. What is not
    determined stays.
    """
    keys = ["change", "path", "pos"]
    typed = callers.select(*keys, "target").join(declaring.select("target").distinct(), "target", "left_semi").join(site_types, keys)
    hit = typed.join(related.withColumn("hit", F.lit(True)), ["target", "type"], "left")
    drop = hit.groupBy(*keys).agg(F.bool_and(F.col("type").isNotNull()).alias("all_typed"), F.bool_or(F.coalesce("hit", F.lit(False))).alias("any")).where("all_typed AND NOT any")
    return callers.join(drop.select(*keys), keys, "left_anti")


def bus_edges(handlers: DataFrame, dispatches: DataFrame, direct: DataFrame) -> DataFrame:
    """Edges from handlers to those who dispatch their command, with direct callers of a handler's method taken out.

    ``handlers`` has ``handler, command``, ``dispatches`` has ``caller, command``, ``direct`` has ``src, dst``. A handler is
    called by the bus, so what calls its method by name alone is a false caller.
    """
    bus = handlers.join(dispatches, "command").select(F.col("handler").alias("src"), F.col("caller").alias("dst")).distinct()
    return direct.join(handlers.select(F.col("handler").alias("src")).distinct(), "src", "left_anti").select("src", "dst").unionByName(bus)


def unseen_users(names: DataFrame, mentions: DataFrame, imports: DataFrame, listed: DataFrame, most: int = 200) -> DataFrame:
    """Files that mention a changed name and import its module but are not listed as callers.

    ``names`` has ``change, name, module``, ``mentions`` ``path, name``, ``imports`` ``path, module``, ``listed`` ``change, path``.
    The first ``most`` candidates by path are checked for the import; ``unchecked`` counts the rest, which are not users and
    not non-users.
    """
    candidates = mentions.join(names, "name").join(listed, ["change", "path"], "left_anti").select("change", "module", "path").distinct()
    ranked = candidates.withColumn("n", F.row_number().over(Window.partitionBy("change").orderBy("path"))).withColumn("unchecked", F.greatest(F.count("*").over(Window.partitionBy("change")) - most, F.lit(0)))
    return ranked.where(F.col("n") <= most).join(imports.select("path", "module").distinct(), ["path", "module"], "left_semi").select("change", "path", "unchecked")


def unlisted_hits(hits: DataFrame, listed: DataFrame, resolved: DataFrame) -> DataFrame:
    """Call-shaped hits of a name at no listed site: resolved to another target, or counted as unresolved.

    ``hits`` has ``name, path, offset``, ``listed`` the same of known sites, ``resolved`` ``path, offset, target`` (null: no answer).
    """
    rest = hits.join(listed, ["name", "path", "offset"], "left_anti").join(resolved, ["path", "offset"], "left")
    return rest.groupBy("name").agg(F.count_if(F.col("target").isNull()).alias("unresolved"), F.count_if(F.col("target").isNotNull()).alias("elsewhere"))


def covered_cards(answer: DataFrame, cards: DataFrame) -> DataFrame:
    """Engine cards whose members all lie in one card of the answer: ``card, answer_card``. Both have ``card, change``."""
    total = cards.groupBy("card").agg(F.count("*").alias("total"))
    shared = cards.join(answer.select(F.col("card").alias("answer_card"), "change"), "change").groupBy("card", "answer_card").agg(F.countDistinct("change").alias("n"))
    return shared.join(total, "card").where("n = total").select("card", "answer_card")


def grouped_requests(prs: DataFrame, teams: DataFrame | None, login: str | None) -> DataFrame:
    """Pull requests by who must act: ``own`` first, then ``requested`` of the user or one of the teams (or a parent team), else ``others``.

    ``prs`` has ``number, author, reviewers array<string>, teams array<struct<id: long, name: string>>``; ``teams`` has ``id, parent_id``
    of the user's teams, null if they could not be loaded. Logins are compared without case. ``via`` says why: ``you``, then the teams' names in their order.
    """
    me = F.lower(F.lit(login)) if login else F.lit(None).cast("string")
    own = F.coalesce(F.lower("author") == me, F.lit(False))
    direct = F.coalesce(F.exists("reviewers", lambda r: F.lower(r) == me), F.lit(False))
    if teams is None:
        rows = prs.withColumn("__teams", F.array().cast("array<string>"))
    else:
        mine = teams.select("id").union(teams.where("parent_id IS NOT NULL").select("parent_id")).distinct()
        asked = prs.select("number", F.posexplode("teams").alias("at", "t")).join(mine, F.col("t.id") == F.col("id"))
        asked = asked.groupBy("number").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "t.name"))), lambda x: x["name"]).alias("__teams"))
        rows = prs.join(asked, "number", "left").withColumn("__teams", F.coalesce("__teams", F.array().cast("array<string>")))
    via = F.concat(F.when(direct, F.array(F.lit("you"))).otherwise(F.array().cast("array<string>")), F.col("__teams"))
    group = F.when(own, "own").when(F.size(via) > 0, "requested").otherwise("others")
    return rows.select("number", group.alias("grp"), F.when(group == "requested", via).otherwise(F.array().cast("array<string>")).alias("via"))


def called_by_name(affected: DataFrame, callers: DataFrame) -> DataFrame:
    """Callers that an agent's words name: ``change, name`` of what is affected with ``change, label`` of callers, where one holds the other."""
    return affected.join(callers.select("change", "label"), "change").where(names_match(F.col("label"), F.col("name"))).select("change", "name", "label")


def changed_keys(symbols: DataFrame) -> DataFrame:
    """``key, id``: where a changed symbol is met as a caller, ``path#pos``; a constructor also at its class's name. The first of a key counts.

    ``symbols`` has ``id, path, name_pos, class_name_pos, is_constructor, ord``.
    """
    at = lambda c: F.concat("path", F.lit("#"), F.col(c).cast("string"))
    own = symbols.select(at("name_pos").alias("key"), "id", F.struct(F.lit(0).alias("k"), "ord").alias("o"))
    made = symbols.where("is_constructor AND class_name_pos IS NOT NULL").select(at("class_name_pos").alias("key"), "id", F.struct(F.lit(1).alias("k"), "ord").alias("o"))
    return own.unionByName(made).groupBy("key").agg(F.min_by("id", "o").alias("id"))


def change_edges(callers: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges between changes, ``callee, caller``, each once: callers ``change, path, pos, is_test`` that are changed themselves, without tests and loops."""
    seen = callers.where("NOT is_test").select(F.col("change").alias("callee"), F.concat("path", F.lit("#"), F.col("pos").cast("string")).alias("key"))
    return seen.join(keys, "key").select("callee", F.col("id").alias("caller")).where("callee <> caller").distinct()


def worktree_files(changed: DataFrame, untracked: DataFrame, mode: str) -> DataFrame:
    """Changed files ``path, status, ord`` with the untracked ones as added, which only modes that diff the worktree see; a listed path is not added again."""
    if mode not in ("working", "checkpoint"):
        return changed
    new = untracked.select("path").distinct().join(changed.select("path"), "path", "left_anti")
    return changed.unionByName(new.select("path", F.lit("added").alias("status"), F.lit(None).cast(changed.schema["ord"].dataType).alias("ord")))


def routed(files: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``files`` with ``language`` and ``is_test``: rules ``(language, pattern of its files, pattern of its tests)``, of which the first that matches a path owns it."""
    language, test = F.lit(None).cast("string"), F.lit(False)
    for name, own, tests in reversed(rules):
        fits = F.col("path").rlike(own)
        language, test = F.when(fits, name).otherwise(language), F.when(fits, F.col("path").rlike(tests)).otherwise(test)
    return files.withColumn("language", language).withColumn("is_test", test)


#: Fixed values by language: files, names that generators give, the header that is searched, and the mark in it.
GENERATED = (
    (r"\.go$", r"(\.pb\.go|\.pb\.gw\.go|_gen\.go|_generated\.go)$|(^|/)zz_generated[^/]*\.go$", r"(?ms)\A(.*?)(?:^\s*package\s|\z)", r"(?m)^// Code generated .* DO NOT EDIT\.\r?$"),
    (r"\.pyi?$", r"_pb2(_grpc)?\.pyi?$", r"\A((?:[ \t]*+(?:#[^\n]*+)?(?:\n|\z))*+)", r"(?m)^\s*#\s*Generated by\b|^\s*#.*@generated\b"),
    (r"\.cs$", r"(?i)\.(g|g\.i|designer|generated)\.cs$", r"(?s)\A((?:[\s\x{FEFF}]|//[^\n]*+|/\*.*?\*/|#[^\n]*+|(?:global\s+)?using\s[^;]*+;|extern\s+alias\s[^;]*+;)*+)", r"(?s)(//[^\n]*|/\*.*)<auto-generated"),
)


def is_generated(path: Column, text: Column, head: int = 8192) -> Column:
    """Whether a file is generated: by its name, or by its language's mark in what comes before the first code, of the first ``head`` characters."""
    out, first = F.lit(False), F.substring(text, 1, head)
    for files, names, header, mark in reversed(GENERATED):
        out = F.when(path.rlike(files), path.rlike(names) | F.coalesce(F.regexp_extract(first, header, 1).rlike(mark), F.lit(False))).otherwise(out)
    return out


def with_cards(changes: DataFrame, group: str, least: int = 4) -> DataFrame:
    """Groups (runs) that get cards at all: those with ``least`` changes."""
    return changes.groupBy(group).agg(F.count("*").alias("changes")).where(F.col("changes") >= least)


def caller_rows(sites: DataFrame, most: int = 5) -> DataFrame:
    """A row a caller with the lines of its first ``most`` call sites and how many there are: ``change, path, pos, label, lines, total``.

    ``sites`` has ``change, path, pos, label, line``.
    """
    lines = F.array_sort(F.collect_list("line"))
    return sites.groupBy("change", "path", "pos").agg(F.first("label").alias("label"), F.slice(lines, 1, most).alias("lines"), F.count("line").alias("total"))
