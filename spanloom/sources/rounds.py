"""Feedback rounds as Markdown files: written from items, and read back with what the answers say."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import one_line, status_line
from ..operators.review import agreed

#: The marks of a round's file, behind the word that a tool signs them with.
HEADER = r"(?m)^<!--\s*{mark} feedback v1 round=(\d+) checkpoint=(none|[0-9a-fA-F]{{4,64}})\s*-->\s*$"
ANY_HEADER, OTHER_VERSION = r"(?m)^<!--\s*{mark} feedback\b", r"(?m)^<!--\s*{mark} feedback v(?!1\b)"
ITEM = r"^<!--\s*item id=([A-Za-z0-9_-]{1,64})\s*-->\s*$"
MOST_BYTES = 4 << 20


def read(files: DataFrame, mark: str = "review") -> tuple[DataFrame, DataFrame]:
    """``path, round, item, status, reason`` of the items of landed files ``path, text``, and the files that cannot be read, with a ``reason``.

    A line counts only at its start: a mark opens an item, a heading or another mark closes it, and lines ``Status:`` inside are
    what was said of it. An item whose mark is there twice is unreadable.
    """
    word = re.escape(mark)
    header, any_header, other = (p.format(mark=word) for p in (HEADER, ANY_HEADER, OTHER_VERSION))
    text = F.regexp_replace("text", r"\r\n?", "\n")
    number = F.regexp_extract(text, header, 1)
    why = (
        F.when(F.col("text").isNull(), "not text").when(F.octet_length("text") > MOST_BYTES, "too large").when(~text.rlike(any_header), "header marker missing")
        .when(number == "", F.when(text.rlike(other), "unknown format version").otherwise("malformed header")).when(F.length(number) > 9, "malformed header").when(number.cast("int") < 1, "malformed header")
    )
    judged = files.withColumn("reason", why)
    good = judged.where("reason IS NULL").select("path", number.cast("int").alias("round"), F.posexplode(F.split(text, "\n")).alias("n", "line"))
    item = F.regexp_extract("line", ITEM, 1)
    opens = F.when(item != "", item).when(F.col("line").rlike(rf"^## |^<!--\s*(?:item|{word})"), "")
    upto = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = good.withColumn("item", F.last(opens, ignorenulls=True).over(upto)).where("item <> ''")
    said = F.regexp_extract("line", r"(?i)^ {0,3}Status:(.*)$", 1)
    is_status = F.col("line").rlike(r"(?i)^ {0,3}Status:")
    lines = inside.withColumn("s", status_line(F.when(is_status, said).otherwise(F.lit("")))).select("path", "round", "item", (item != "").alias("mark"), "s.status", "s.reason")
    marks = lines.groupBy("path", "round", "item").agg(F.count_if("mark").alias("marks"))
    one = agreed(lines, ["path", "round", "item"], "status", "reason").join(marks, ["path", "round", "item"])
    twice = F.col("marks") > 1
    items = one.select("path", "round", "item", F.when(twice, "unreadable").otherwise(F.col("status")).alias("status"), F.when(twice, "duplicate item marker").otherwise(F.col("reason")).alias("reason"))
    return items, judged.where("reason IS NOT NULL").select("path", "reason")


def escaped(body: Column) -> Column:
    """Text that cannot be taken for a mark, a heading or a status: a backslash before the first character of such a line."""
    return F.regexp_replace(F.regexp_replace(body, r"\r\n?", "\n"), r"(?im)^( {0,3})(?=<!--|#|Status:|>)", r"$1\\\\")


def written(rounds: DataFrame, items: DataFrame, mark: str = "review") -> DataFrame:
    """``round, text``: a file for each round, its items in order. ``rounds`` has ``round, sent, branch, mode, checkpoint``, ``items`` ``round, ord, item, path, line, symbol, quote, body``."""
    place = F.concat("path", F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")), F.coalesce(F.concat(F.lit(" · "), one_line(F.col("symbol"))), F.lit("")))
    quote = F.when(F.coalesce("quote", F.lit("")) != "", F.concat(F.regexp_replace(F.rtrim("quote"), "(?m)^", "> "), F.lit("\n"))).otherwise("")
    body = F.when(F.coalesce("body", F.lit("")) != "", F.concat(escaped(F.col("body")), F.lit("\n"))).otherwise("")
    listed = items.groupBy("round").agg(F.array_sort(F.collect_list(F.struct("ord", "item", place.alias("place"), quote.alias("quote"), body.alias("body")))).alias("xs"))
    blocks = F.transform("xs", lambda x, i: F.concat(F.lit("\n## "), (i + 1).cast("string"), F.lit(". "), x["place"], F.lit("\n<!-- item id="), x["item"], F.lit(" -->\n"), x["quote"], x["body"], F.lit("Status:\n")))
    head = F.concat(
        F.lit("# Feedback round "), F.col("round").cast("string"), F.lit(" · "), F.date_format("sent", "yyyy-MM-dd HH:mm"), F.lit(f"\n<!-- {mark} feedback v1 round="), F.col("round").cast("string"),
        F.lit(" checkpoint="), F.coalesce("checkpoint", F.lit("none")), F.lit(" -->\nBranch: "), F.coalesce(one_line(F.col("branch")), F.lit("detached HEAD")), F.lit(" · Reviewed: "), one_line(F.col("mode")), F.lit("\n"))
    return rounds.join(listed, "round", "left").select("round", F.concat(head, F.coalesce(F.array_join(blocks, ""), F.lit(""))).alias("text"))
