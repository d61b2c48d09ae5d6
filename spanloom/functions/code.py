"""Source lines: comments taken out across lines, calls on a line, words that a line adds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import possibly_in
from ..operators.tables import stored

#: File types by the comments they have.
HASH_FILES = re.compile(r"\.(py|sh|rb|ya?ml|toml)$")
SLASH_FILES = re.compile(r"\.(go|[cm]?[jt]sx?|java|kt|rs|c|h|cc|cpp|cs|swift|php|scala)$")
#: Words before a bracket that are no calls.
NO_CALLS = frozenset("""
    if for while switch catch return typeof function def func elif with
    assert in of not and or lambda yield await else do case throw
    sizeof instanceof void delete except select go defer super this synchronized
""".split())
#: Methods of a language's own strings, lists and promises.
HELPER_METHODS = frozenset("""
    map filter reduce forEach some every find findIndex flatMap flat includes indexOf
    lastIndexOf slice splice concat join split push pop shift unshift sort reverse
    keys values entries trim trimStart trimEnd startsWith endsWith toLowerCase toUpperCase
    padStart padEnd replace replaceAll match matchAll test exec toString toFixed charAt
    charCodeAt codePointAt at fill then catch finally bind call apply append extend
    strip lower upper format items pipe
""".split())
#: A language's own functions and namespaces.
HELPERS = frozenset("""
    String Number Boolean BigInt Symbol Array Object JSON Math Reflect parseInt parseFloat
    isNaN isFinite encodeURIComponent decodeURIComponent len str int float bool list dict
    set tuple isinstance range enumerate zip sorted append make cap copy panic
""".split())
#: A dotted name with optional type arguments before a bracket, what makes it a declaration, and a quoted string.
CALL = re.compile(r"([A-Za-z_$][\w$]*(?:\s*\??\.\s*[A-Za-z_$][\w$]*)*)\s*(?:<[\w$.,\s<>[\]|&?]*>)?\s*\(", re.A)
DECLARED = re.compile(r"(?:\bfunction\s*\*?|\bdef|\bfunc(?:\s*\([^)]*\))?|\bclass|\binterface|\btype)\s*$", re.A)
QUOTED = re.compile(r"""(["'`])(?:\\.|(?!\1).)*\1""")

_STRING = r""""(?:\\.?|[^"\\])*"?|'(?:\\.?|[^'\\])*'?|`(?:\\.?|[^`\\])*`?"""
_IN_SLASH = re.compile(rf"{_STRING}|(?P<open>/\*)|(?P<rest>//.*)", re.S)
_IN_HASH = re.compile(rf"{_STRING}|(?P<rest>#.*)", re.S)


@dataclass
class Open:
    """What is open at the end of a line: a block comment, or a docstring by its quotes."""

    block: bool = False
    doc: str = ""


def without_comments(line: str, path: str, open_: Open) -> str:
    """A line without comments; strings stay. ``open_`` is carried from line to line of a file. Other file types stay as they are."""
    if HASH_FILES.search(path):
        text = line.strip()
        if open_.doc:
            open_.doc = "" if open_.doc in line else open_.doc
            return ""
        for quotes in ('"""', "'''"):
            if text.startswith(quotes):
                open_.doc = "" if quotes in text[3:] else quotes
                return ""
        return _IN_HASH.sub(lambda m: "" if m["rest"] else m[0], line)
    if not SLASH_FILES.search(path):
        return line
    out, at = [], 0
    while at < len(line):
        if open_.block:
            end = line.find("*/", at)
            if end < 0:
                break
            open_.block, at = False, end + 2
            continue
        m = _IN_SLASH.search(line, at)
        if not m:
            out.append(line[at:])
            break
        out.append(line[at : m.start()])
        if m["rest"]:
            break
        if m["open"]:
            open_.block = True
        else:
            out.append(m[0])
        at = m.end()
    return "".join(out)


def calls_on(line: str, own_name: str | None = None, hash_comments: bool = False) -> list[str]:
    """Names called on a line, in order, dotted ones whole; without declarations, the function itself, calls on a result, and a language's own helpers."""
    code = QUOTED.sub('""', re.sub(r"/\*.*?\*/", " ", line)).split("//", 1)[0]
    if hash_comments:
        code = code.split("#", 1)[0]
    found = []
    for m in CALL.finditer(code):
        parts = re.sub(r"\s+", "", m[1]).replace("?.", ".").split(".")
        name, before = ".".join(parts), code[: m.start()]
        helper = parts[0] in HELPERS or len(parts) > 1 and parts[-1] in HELPER_METHODS and not parts[-2][:1].isupper()
        if name in NO_CALLS or parts[-1] == own_name or helper or DECLARED.search(before) or before.rstrip().endswith("."):
            continue
        found.append(name)
    return found


LINES = "path string, line int, code string, calls array<string>"


def code_lines(files: DataFrame) -> DataFrame:
    """``path, line, code, calls`` of every line of ``files(path, text)``; a file is read in order, as comments span lines."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, text in zip(frame["path"], frame["text"], strict=True):
                rows, open_, hashes = [], Open(), bool(HASH_FILES.search(path or ""))
                for n, line in enumerate((text or "").split("\n"), 1):
                    code = without_comments(line, path or "", open_)
                    rows.append((path, n, code, list(dict.fromkeys(calls_on(code, hash_comments=hashes)))))
                yield pd.DataFrame(rows, columns=["path", "line", "code", "calls"])

    return files.select("path", "text").mapInPandas(parse, LINES)


#: Words that added lines share everywhere.
_WORD, _LITERAL = re.compile(r"[A-Za-z_$][\w$]{5,}", re.A), re.compile(r"""\"([^"\\\n]{6,60})\"|'([^'\\\n]{6,60})'""")


def words_of(code: str, common: frozenset[str] = frozenset()) -> list[str]:
    """Words of six characters and more on a line of code, and short string literals with a letter, without the ``common`` ones."""
    literals = [a or b for a, b in _LITERAL.findall(code)]
    return [w for w in [*_WORD.findall(code), *(x for x in literals if re.search("[A-Za-z]", x))] if w not in common]


ADDED = "run_id string, path string, token string"


def added_words(hunk_rows: DataFrame, common: list[str] = ()) -> DataFrame:
    """``run_id, path, token``: the distinct words that the added lines of each file hold, comments left out across a file's hunks in order.

    ``hunk_rows`` is :func:`~spanloom.sources.changes.hunks`. A file's hunks are read in one task: they are one patch.
    """
    skip = frozenset(common)

    def read(frame: pd.DataFrame) -> pd.DataFrame:
        found, open_ = set(), Open()
        for added in frame.sort_values("hunk_no")["added"]:
            for line in added:
                found.update(words_of(without_comments(line, frame["path"].iloc[0], open_), skip))
        return pd.DataFrame({"run_id": frame["run_id"].iloc[0], "path": frame["path"].iloc[0], "token": sorted(found)}, columns=["run_id", "path", "token"])

    return hunk_rows.where("path IS NOT NULL").select("run_id", "path", "hunk_no", "added").groupBy("run_id", "path").applyInPandas(read, ADDED)


def postings(files: DataFrame) -> DataFrame:
    """``word, path, at, before, after, opens, closes, next, behind, next_closes``: every word of ``files(path, text)`` with its number among the file's pieces, and what stands around it.

    Pieces are words and the runs of other characters between them; ``before`` and ``after`` are such runs (null at the text's ends), and
    ``opens`` and ``closes`` tell that no word lies beyond them; ``next`` is the word that follows, with what is ``behind`` it. Texts go no further than their scan. Stored by word
    (``bucketBy``), this is an index for :func:`word_files`.
    """
    parts = files.where("text IS NOT NULL").select("path", F.regexp_extract_all("text", F.lit(r"\w+|\W+"), F.lit(0)).alias("p"))
    sides = lambda i: (F.when(i > 0, F.get("p", i - 1)).alias("before"), F.get("p", i + 1).alias("after"), (i <= 1).alias("opens"), (i + 2 >= F.size("p")).alias("closes"), F.get("p", i + 2).alias("next"), F.get("p", i + 3).alias("behind"), (i + 4 >= F.size("p")).alias("next_closes"))
    each = F.filter(F.transform("p", lambda x, i: F.struct(x.alias("word"), i.alias("at"), *sides(i))), lambda e: e["word"].rlike(r"^\w"))
    return parts.select("path", F.explode(each).alias("e")).select("e.word", "path", "e.at", "e.before", "e.after", "e.opens", "e.closes", "e.next", "e.behind", "e.next_closes")


def word_files(wanted: DataFrame, files: DataFrame | None = None, truncated: bool = False, index: DataFrame | None = None) -> DataFrame:
    """``token, files, partial``: in how many files each wanted word or phrase occurs; 0 where in none.

    ``files`` has ``path, text``; ``index`` are their :func:`postings`, if they were stored. An occurrence has no word character before it
    nor behind it. Words are looked up by an equi join, and phrases by two words that follow each other with what is between them, so a
    phrase of common words meets only its own occurrences. A longer phrase is verified on its pairs' places. Only occurrences of wanted words leave the scan, behind a bitmap. ``partial``: the files
    are known to be cut short, or the token has no word or a line break, and was not searched.
    """
    tokens = wanted.select("token").where("token IS NOT NULL").distinct()
    parts = tokens.select("token", F.regexp_extract_all("token", F.lit(r"\w+|\W+"), F.lit(0)).alias("p"))
    parts = stored(parts.withColumn("sought", F.exists("p", lambda x: x.rlike(r"^\w")) & ~F.col("token").contains("\n")), "word-tokens")
    # Pieces of a token: its only word, or each two words that follow each other. The first has what stands before it in the token, the last what is behind.
    piece = lambda x, i, n: F.struct(x.alias("word"), i.alias("i"), F.when(i == 1, F.get("p", i - 1)).alias("lead"), F.get("p", i + n + 1).alias("tail"), F.get("p", i + 1).alias("between"), F.get("p", i + 2).alias("next"), F.lit(n).alias("n"), (i + n + 2 < F.size("p")).alias("more"))
    each = F.filter(F.transform("p", lambda x, i: F.when(F.size(F.filter("p", lambda w: w.rlike(r"^\w"))) == 1, piece(x, i, 0)).otherwise(piece(x, i, 2))), lambda e: e["word"].rlike(r"^\w") & ((e["n"] == 0) | e["next"].isNotNull()))
    words = parts.where("sought").select("token", F.explode(each).alias("e")).select("token", "e.*")
    words = stored(words.withColumn("__h", F.when(F.col("n") == 0, F.xxhash64("word")).otherwise(F.xxhash64("word", "between", "next"))), "word-parts")
    counted = words.groupBy("token").agg(F.count("*").alias("k"))
    occurring = (postings(files) if index is None else index).withColumnRenamed("word", "__w").withColumnRenamed("next", "__next")
    found = None
    for n in sorted(r.n for r in words.select("n").distinct().collect()):
        hashed = F.xxhash64("__w") if n == 0 else F.xxhash64("__w", "after", "__next")
        own = words.where(F.col("n") == n)
        here = possibly_in(occurring.where(F.lit(n == 0) | F.col("__next").isNotNull()).withColumn("__g", hashed), "__g", own, "__h")
        rest, closed = ("after", "closes") if n == 0 else ("behind", "next_closes")
        here = here.select("__g", "__w", "path", "at", "before", "opens", F.col("after").alias("__between"), "__next", F.col(rest).alias("__rest"), F.col(closed).alias("__closed"))
        equal = (F.col("__g") == F.col("__h")) & (F.col("__w") == F.col("word"))
        met = here.join(own, equal if n == 0 else equal & (F.col("__between") == F.col("between")) & (F.col("__next") == F.col("next")))
        found = met if found is None else found.unionByName(met)
    if found is None:
        return parts.select("token", F.lit(0).cast("long").alias("files"), (F.lit(truncated) | ~F.col("sought")).alias("partial"))
    before, after = F.coalesce("before", F.lit("")), F.coalesce("__rest", F.lit(""))
    starts = F.col("lead").isNull() | (before.endswith(F.col("lead")) & ((F.length(before) > F.length("lead")) | F.col("opens")))
    ends = F.col("tail").isNull() | F.when(F.col("more"), after == F.col("tail")).otherwise(after.startswith(F.col("tail")) & ((F.length(after) > F.length("tail")) | F.col("__closed")))
    met = found.where(starts & ends).select("token", "path", (F.col("at") - F.col("i")).alias("start"))
    whole = met.groupBy("token", "path", "start").agg(F.count("*").alias("n")).join(counted, "token").where("n = k").select("token", "path").distinct()
    counts = whole.groupBy("token").agg(F.count("*").alias("files"))
    return parts.join(counts, "token", "left").select("token", F.coalesce("files", F.lit(0)).alias("files"), (F.lit(truncated) | ~F.col("sought")).alias("partial"))


def call_changes(base: DataFrame, head: DataFrame, keys: list[str], most: int = 12) -> DataFrame:
    """Calls that each function gained and lost between two sides; both have the keys and ``line, calls``."""
    from ..operators.sets import both_ways

    def all_calls(df: DataFrame, name: str) -> DataFrame:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", "calls"))), lambda x: x["calls"])
        return df.groupBy(*keys).agg(F.array_distinct(F.flatten(ordered)).alias(name))

    none = F.array().cast("array<string>")
    sides = all_calls(base, "b").join(all_calls(head, "h"), keys, "full_outer")
    return sides.select(*keys, both_ways(F.coalesce("b", none), F.coalesce("h", none), most).alias("d")).select(*keys, "d.*")
