"""Seams between cards, and hints that two cards belong together.

``members`` has ``card, change`` with the changes' columns; cards are named by a letter and a number (``K12``), and ordered by it.
All evidence is a table ``a, b, type, counted, n, payload`` with a before b, so a pair's evidence is one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evidence import broad_commit, weak_commit
from .ranking import capped_list
from .ranks import positioned

#: The most pieces of a kind listed for a pair, the files a rare word may lie in, and when a commit is large.
MOST = {"commit": 5, "token": 5, "pattern": 3, "signature-change": 3, "test": 5}
RARE_FILES, LARGE_COMMIT = 20, 30
#: Kinds of seams and of evidence in order.
SEAM_TYPES = ("call", "meeting", "type", "mirror")
EVIDENCE_TYPES = ("commit", "token", "pattern", "signature-change", "test", "folder")


def card_order(card: Column) -> Column:
    """Sort key of a card's name: its letter, its number as a number, and the name itself, which tells names without a number apart."""
    return F.struct(F.substring(card, 1, 1).alias("letter"), F.regexp_extract(card, r"^.(\d{1,38})$", 1).try_cast("decimal(38,0)").alias("number"), card.alias("name"))


def in_pairs(owners: DataFrame, item: list[str], card: str = "card") -> DataFrame:
    """``item, a, b``: every pair of cards that share an item, a before b. Items are rows ``item, card``; an item lies in few cards."""
    own = owners.select(*item, F.col(card).alias("a")).distinct()
    other = owners.select(*[F.col(c).alias(f"__{c}") for c in item], F.col(card).alias("b")).distinct()
    same = F.lit(True)
    for c in item:
        same = same & (F.col(c) == F.col(f"__{c}"))
    return own.join(other, same & (card_order(F.col("a")) < card_order(F.col("b")))).select(*item, "a", "b")


def commit_evidence(commits: DataFrame, card_files: DataFrame, changed_files: int | None) -> DataFrame:
    """Commits that touch files of both cards. ``commits`` has ``sha, subject, path`` with a row a file; ``card_files`` ``card, path``.

    A weak commit (by its subject) and a broad one (over half of the changed files) are listed and do not count.
    """
    sizes = commits.groupBy("sha").agg(F.first("subject").alias("subject"), F.countDistinct("path").alias("files"))
    touched = commits.select("sha", "path").join(card_files.select("card", "path").distinct(), "path").select("sha", "card")
    found = in_pairs(touched, ["sha"]).join(sizes, "sha")
    weak = weak_commit(F.col("subject")) | broad_commit(F.col("files"), F.lit(changed_files).cast("int"))
    rank = F.struct(weak.alias("weak"), (F.col("files") > LARGE_COMMIT).alias("large"), F.col("sha").alias("name"))
    return found.select("a", "b", F.lit("commit").alias("type"), (~weak).alias("counted"), rank.alias("rank"))


def token_evidence(tokens: DataFrame, card_files: DataFrame, file_counts: DataFrame) -> DataFrame:
    """Rare words added in exactly the two cards. ``tokens`` has ``path, token``, ``file_counts`` ``token, files`` over the whole repository; a word that was
    not counted is no evidence. Longer words come first."""
    owned = tokens.select("path", "token").distinct().join(card_files.select("card", "path").distinct(), "path").select("token", "card").distinct()
    two = owned.groupBy("token").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(card_order(F.col("card")).alias("o"), "card"))).alias("cards")).where("n = 2")
    rare = two.join(file_counts, "token").where(F.col("files") <= RARE_FILES)
    rank = F.struct(F.lit(False).alias("weak"), F.lit(False).alias("large"), F.concat(F.lpad((10_000 - F.length("token")).cast("string"), 5, "0"), F.col("token")).alias("name"))
    return rare.select(F.col("cards")[0]["card"].alias("a"), F.col("cards")[1]["card"].alias("b"), F.lit("token").alias("type"), F.lit(True).alias("counted"), rank.alias("rank"))


def shared_evidence(owners: DataFrame, item: str, type_: str, counted: bool = True) -> DataFrame:
    """Things that both cards hold: repeated patterns, signature changes, tests that call both, folders. ``owners`` has ``card`` and the item."""
    found = in_pairs(owners.where(F.col(item).isNotNull()), [item])
    rank = F.struct(F.lit(False).alias("weak"), F.lit(False).alias("large"), F.col(item).alias("name"))
    return found.select("a", "b", F.lit(type_).alias("type"), F.lit(counted).alias("counted"), rank.alias("rank"))


def hints(evidence: list[DataFrame]) -> DataFrame:
    """``a, b, strength, pieces, omitted, evidence, position``: pairs by strength, then by the pieces listed, then by card numbers.

    Of each kind the first pieces are listed (:data:`MOST`; of folders the first); ``omitted`` counts the commits beyond. All
    tests of a pair are one piece. Strength is the number of kinds among the listed pieces that count, and pairs without any go.
    """
    every = evidence[0]
    for part in evidence[1:]:
        every = every.unionByName(part)
    every = every.distinct()
    at = F.row_number().over(Window.partitionBy("a", "b", "type").orderBy("rank"))
    limit = F.create_map(*[F.lit(x) for kind, n in (MOST | {"folder": 1}).items() for x in (kind, n)])
    ranked = every.withColumn("at", at).withColumn("shown", F.col("at") <= limit[F.col("type")])
    kind = F.array_position(F.array(*[F.lit(x) for x in EVIDENCE_TYPES]), F.col("type"))
    listed = F.when(F.col("shown"), F.struct(kind.alias("kind"), "at", F.concat_ws(":", "type", "rank.name").alias("text")))
    pieces = F.count_if(F.col("shown") & (F.col("type") != "test")) + F.max((F.col("type") == "test").cast("int"))
    found = ranked.groupBy("a", "b").agg(
        F.countDistinct(F.when(F.col("shown") & F.col("counted"), F.col("type"))).alias("strength"), pieces.cast("long").alias("pieces"),
        F.count_if(~F.col("shown") & (F.col("type") == "commit")).alias("omitted"), F.transform(F.array_sort(F.collect_list(listed)), lambda x: x["text"]).alias("evidence")).where("strength > 0")
    return positioned(found, [F.desc("strength"), F.desc("pieces"), card_order(F.col("a")), card_order(F.col("b"))])


def type_seams(members: DataFrame, via: int = 10, least_name: int = 3) -> DataFrame:
    """Pairs of cards where one changes methods of a type that a signature in the other names: ``a, b, directions, types, type_count, via, via_count``.

    ``members`` has ``card, change, class_name, signature, deleted``. Types of three cards and more link everything and are left
    out; so are names shorter than ``least_name``. A mention is no proof of use.
    """
    owners = members.where(F.length("class_name") >= least_name).select(F.col("class_name").alias("word"), F.col("card").alias("owner")).distinct()
    few = owners.join(owners.groupBy("word").agg(F.count("*").alias("n")).where("n < 3").select("word"), "word")
    words = members.where("NOT deleted").select("card", "change", F.explode(F.array_distinct(F.regexp_extract_all("signature", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0)))).alias("word"))
    met = words.join(few, "word").where("owner <> card")
    first = card_order(F.col("owner")) < card_order(F.col("card"))
    pair = met.select(F.when(first, F.col("owner")).otherwise(F.col("card")).alias("a"), F.when(first, F.col("card")).otherwise(F.col("owner")).alias("b"), F.concat("owner", F.lit(">"), "card").alias("direction"), "word", "change")
    types = capped_list(pair.select("a", "b", "word").distinct(), ["a", "b"], F.col("word"), [F.col("word")], via).withColumnRenamed("total", "type_count").withColumnRenamed("items", "types")
    changes = capped_list(pair.select("a", "b", "change").distinct(), ["a", "b"], F.col("change"), [F.col("change")], via).withColumnRenamed("total", "via_count").withColumnRenamed("items", "via")
    directions = pair.groupBy("a", "b").agg(F.array_sort(F.collect_set("direction")).alias("directions"))
    return directions.join(types, ["a", "b"]).join(changes, ["a", "b"])


def seam_order(seams: DataFrame) -> DataFrame:
    """``seams(type, cards array, place, ...)`` with ``position``: by kind, then the cards' numbers, then the place."""
    rank = F.array_position(F.array(*[F.lit(x) for x in SEAM_TYPES]), F.col("type"))
    return positioned(seams, [rank, F.transform("cards", card_order), F.coalesce("place", F.lit(""))])


def seam_counts(seams: DataFrame) -> DataFrame:
    """Seams of each card by kind: ``card, type, n``; a seam counts for every card it joins."""
    return seams.select(F.explode("cards").alias("card"), "type").groupBy("card", "type").agg(F.count("*").alias("n"))
