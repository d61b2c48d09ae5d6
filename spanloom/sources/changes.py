"""Diffs, patches, logs and rounds as tables.

Each reader takes a DataFrame of landed texts and returns rows. A text that cannot be read gives a row in the rejects
with a reason, so absence is never inferred from a failed read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import meeting

HUNKS = "run_id string, path string, hunk_no int, old_start int, old_count int, new_start int, new_count int, removed array<string>, added array<string>"
_HEADER = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def unquoted(path: str) -> str:
    """A path as git quotes it: in double quotes, with C escapes and octal bytes."""
    if len(path) < 2 or path[0] != '"' or path[-1] != '"':
        return path
    known = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13}
    out = bytearray()
    for m in re.finditer(r"\\([0-7]{1,3})|\\(.)|([^\\]+)", path[1:-1], re.S):
        octal, escape, plain = m.groups()
        if octal:
            out.append(int(octal, 8) & 255)
        elif escape:
            out += bytes([known[escape]]) if escape in known else escape.encode()
        else:
            out += plain.encode()
    return out.decode(errors="replace")


def parsed_diff(text: str) -> Iterator[tuple]:
    """Hunks of a unified diff. Body lines are taken by the header's counts, so a body line that looks like a header is body."""
    lines, at, path, number = (text or "").split("\n"), 0, None, 0
    while at < len(lines):
        line = lines[at]
        at += 1
        if line.startswith("diff --git "):
            path, number = None, 0
        elif line.startswith("--- ") and path is None:
            name = unquoted(line[4:].split("\t")[0])
            path = name[2:] if name.startswith("a/") else None
        elif line.startswith("+++ "):
            name = unquoted(line[4:].split("\t")[0])
            path = name[2:] if name.startswith("b/") else path
        elif m := _HEADER.match(line):
            old_start, new_start = int(m[1]), int(m[3])
            old, new = (int(x) if x is not None else 1 for x in (m[2], m[4]))
            gone, come, left, right = [], [], old, new
            while (left or right) and at < len(lines):
                body = lines[at]
                at += 1
                if body.startswith("-"):
                    gone.append(body[1:])
                    left -= 1
                elif body.startswith("+"):
                    come.append(body[1:])
                    right -= 1
                elif not body.startswith("\\"):
                    left, right = left - 1, right - 1
            yield path, number, old_start, old, new_start, new, gone, come
            number += 1


def hunks(diffs: DataFrame) -> DataFrame:
    """``diffs(run_id, text)`` as hunk rows."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(run, *row) for run, text in zip(frame["run_id"], frame["text"], strict=True) for row in parsed_diff(text)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HUNKS.split(", ")])

    return diffs.select(F.col("run_id").cast("string"), "text").mapInPandas(parse, HUNKS)


def changed_ranges(hunk_rows: DataFrame) -> DataFrame:
    """Head-side changed spans on doubled lines: ``2 a .. 2 b`` for lines, ``2 n + 1`` for a pure deletion after line n."""
    gap = F.col("new_count") == 0
    lo = F.when(gap, 2 * F.col("new_start") + 1).otherwise(2 * F.col("new_start"))
    hi = F.when(gap, lo).otherwise(2 * (F.col("new_start") + F.col("new_count") - 1))
    return hunk_rows.select("run_id", "path", lo.alias("lo"), hi.alias("hi"))


def deletions(hunk_rows: DataFrame) -> DataFrame:
    return hunk_rows.where("new_count = 0").select("run_id", "path", (2 * F.col("new_start") + 1).alias("at2"), "old_start", (F.col("old_start") + F.col("old_count") - 1).alias("old_end"))


PATCH = "run_id string, path string, known boolean, lo int, hi int"


def patch_ranges(patches: DataFrame) -> DataFrame:
    """As :func:`changed_ranges`, from patches with context lines (``run_id, path, patch``); ``known`` is false where there is no patch.

    The lines decide, not the header's spans: added lines are a span, and removed lines without added ones a gap.
    """

    def spans(patch: str) -> Iterator[tuple[int, int]]:
        line, start, gone = 0, None, False
        for text in [*patch.split("\n"), "@@ -0,0 +0,0 @@"]:
            m = _HEADER.match(text)
            if text.startswith("+") and not m:
                start = line if start is None else start
                line += 1
                continue
            if text.startswith("-") and not m:
                gone = True
                continue
            if text.startswith("\\"):
                continue
            if start is not None:
                yield 2 * start, 2 * (line - 1)
            elif gone:
                yield 2 * (line - 1) + 1, 2 * (line - 1) + 1
            start, gone = None, False
            line = int(m[3]) + (1 if m[4] == "0" else 0) if m else line + 1

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for run, path, patch in zip(frame["run_id"], frame["path"], frame["patch"], strict=True):
                if patch is None:
                    rows.append((run, path, False, None, None))
                else:
                    rows += [(run, path, True, *s) for s in spans(patch)]
            yield pd.DataFrame(rows, columns=["run_id", "path", "known", "lo", "hi"]).astype({"lo": "Int32", "hi": "Int32"})

    return patches.select(F.col("run_id").cast("string"), "path", "patch").mapInPandas(parse, PATCH)


#: What other services call the four file states.
STATUS_NAMES = {"removed": "deleted", "copied": "added", "changed": "modified"}


def normalised_status(status):
    """File status in the engine's own words; unknown words pass."""
    out = F.lower(status)
    for theirs, ours in STATUS_NAMES.items():
        out = F.when(out == theirs, ours).otherwise(out)
    return out


def changed_files(listings: DataFrame) -> DataFrame:
    """``run_id, text`` of ``git diff --name-status -z`` as ``status, similarity, old_path, path, ord``. A copy counts as added.

    Fields end with NUL; renames and copies have two paths.
    """
    fields = F.split(F.regexp_replace("text", "\u0000$", ""), "\u0000")
    start = F.struct(F.lit(0).alias("left"), F.lit("").alias("code"), F.lit(None).cast("string").alias("old"), F.array().cast("array<struct<code:string,old:string,path:string>>").alias("rows"))

    def step(acc, f):
        two = acc["code"].rlike("^[RC]")
        opened = F.struct(F.when(f.rlike("^[RC]"), 2).otherwise(1).alias("left"), f.alias("code"), F.lit(None).cast("string").alias("old"), acc["rows"].alias("rows"))
        first = F.struct(F.lit(1).alias("left"), acc["code"].alias("code"), f.alias("old"), acc["rows"].alias("rows"))
        row = F.struct(acc["code"].alias("code"), F.when(two, acc["old"]).alias("old"), f.alias("path"))
        closed = F.struct(F.lit(0).alias("left"), F.lit("").alias("code"), F.lit(None).cast("string").alias("old"), F.concat(acc["rows"], F.array(row)).alias("rows"))
        return F.when(acc["left"] == 0, opened).when(acc["left"] == 2, first).otherwise(closed)

    rows = listings.where("length(text) > 0").select("run_id", F.posexplode(F.aggregate(fields, start, step, lambda acc: acc["rows"])).alias("ord", "r"))
    code = F.substring("r.code", 1, 1)
    status = F.when(code.isin("A", "C"), "added").when(code == "D", "deleted").when(code == "R", "renamed").otherwise("modified")
    similarity = F.regexp_extract("r.code", r"^[RC](\d+)$", 1)
    return rows.select("run_id", F.col("r.path").alias("path"), F.when(code == "R", F.col("r.old")).alias("old_path"), status.alias("status"), F.when(similarity != "", similarity.cast("int")).alias("similarity"), "ord")


def commits(logs: DataFrame, most: int = 2000) -> DataFrame:
    """``run_id, text`` of a log with records ``\\x01sha\\x02subject`` and one file a line, newest first, as commits with files.

    At most ``most`` commits of a run; ``truncated`` tells whether there were more.
    """
    records = F.filter(F.split("text", "\u0001"), lambda r: F.length(F.trim(r)) > 0)
    rows = logs.select("run_id", (F.size(records) > most).alias("truncated"), F.posexplode(F.slice(records, 1, most)).alias("ord", "record"))
    head = F.split(F.substring_index("record", "\n", 1), "\u0002")
    files = F.filter(F.slice(F.split("record", "\n"), 2, F.size(F.split("record", "\n"))), lambda f: F.length(f) > 0)
    return rows.select("run_id", F.element_at(head, 1).alias("sha"), F.coalesce(F.try_element_at(head, F.lit(2)), F.lit("")).alias("subject"), files.alias("files"), "ord", "truncated")


def valid_and_rejected(records: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Splits records by rules (SQL conditions by name): valid rows, and rejected ones with the names of the rules they break."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    judged = records.withColumn("reasons", broken)
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def picked_files(files: DataFrame, names: DataFrame, most_files: int = 3000, most_bytes: int = 64 << 20) -> DataFrame:
    """Files to index: all where they are few and small, else the kept ones and those that mention a changed name; adds ``not_indexed``.

    ``files`` has ``run_id, path, text, keep``; ``names`` has ``run_id, name``.
    """
    totals = files.groupBy("run_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    words = files.select("run_id", "path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("name"))
    mention = words.join(names.distinct(), ["run_id", "name"], "left_semi").select("run_id", "path").distinct().withColumn("mentions", F.lit(True))
    judged = files.join(totals, "run_id").join(mention, ["run_id", "path"], "left")
    small = (F.col("n") <= most_files) & (F.col("bytes") <= most_bytes)
    taken = judged.withColumn("taken", small | F.col("keep") | F.coalesce("mentions", F.lit(False)))
    counts = taken.groupBy("run_id").agg(F.count_if(~F.col("taken")).alias("not_indexed"))
    return taken.where("taken").select("run_id", "path", "text").join(counts, "run_id")


def zero_context(patches: DataFrame) -> DataFrame:
    """``run_id, path, text, known``: patches with context lines as diffs without, a header and hunks of the changed lines only.

    ``patches`` has ``run_id, path, old_path, status, patch``. An empty side names the line before it. Without a patch there is no
    text, and ``known`` is false.
    """

    def diff(path: str, old: str | None, status: str, patch: str) -> str:
        out = [f"diff --git a/{old or path} b/{path}", "--- /dev/null" if status == "added" else f"--- a/{old or path}", "+++ /dev/null" if status in ("removed", "deleted") else f"+++ b/{path}"]
        at, begin, run = [0, 0], [0, 0], ([], [])

        def emit() -> None:
            if run[0] or run[1]:
                sides = [f"{begin[k] - (not run[k])},{len(run[k])}" for k in (0, 1)]
                out.append(f"@@ -{sides[0]} +{sides[1]} @@")
                out.extend([*(f"-{x}" for x in run[0]), *(f"+{x}" for x in run[1])])
                run[0].clear()
                run[1].clear()

        for line in patch.split("\n"):
            if m := _HEADER.match(line):
                emit()
                at = [int(m[1]) + (m[2] == "0"), int(m[3]) + (m[4] == "0")]
            elif line[:1] in ("-", "+"):
                if not run[0] and not run[1]:
                    begin = list(at)
                k = int(line[0] == "+")
                run[k].append(line[1:])
                at[k] += 1
            elif line[:1] == " ":
                emit()
                at = [at[0] + 1, at[1] + 1]
        emit()
        return "\n".join(out)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(r.run_id, r.path, None if r.patch is None else diff(r.path, r.old_path, r.status, r.patch), r.patch is not None) for r in frame.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["run_id", "path", "text", "known"])

    return patches.select(F.col("run_id").cast("string"), "path", "old_path", "status", "patch").mapInPandas(parse, "run_id string, path string, text string, known boolean")


def file_diffs(diffs: DataFrame) -> DataFrame:
    """``run_id, n, text``: whole diffs split into one text a file, in order; what stands before the first header goes."""
    parts = F.filter(F.split("text", r"(?m)(?=^diff --git )"), lambda p: p.startswith("diff --git "))
    return diffs.select("run_id", F.posexplode(parts).alias("n", "text"))


def function_hunks(functions: DataFrame, diffs: DataFrame, most_chars: int = 6000) -> DataFrame:
    """``id, text, complete``: the hunks of a file's diff that meet a function's lines, cut at ``most_chars``; null and incomplete where there is no diff.

    ``functions`` has ``id, path, start_line, end_line``, ``diffs`` ``path, text``.
    """
    each = diffs.select("path", F.lit(True).alias("__known"), F.posexplode(F.split("text", r"\n(?=@@ )")).alias("__n", "__h"))
    start = F.regexp_extract("__h", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
    count = F.regexp_extract("__h", r"^@@ -\d+(?:,\d+)? \+\d+,(\d+) @@", 1)
    lo = F.when(start != "", start.cast("int"))
    hi = lo + F.greatest(F.when(count != "", count.cast("int")).otherwise(1) - 1, F.lit(0))
    own = functions.select("path", "id", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"))
    placed = each.withColumn("lo", lo).withColumn("hi", hi).where("lo IS NOT NULL").select("path", F.struct("__n", "__h").alias("id"), "lo", "hi")
    met = meeting(own, placed, ["path"]).groupBy(F.col("left_id").alias("id")).agg(F.array_sort(F.collect_list("right_id")).alias("hs"))
    there = each.select("path", "__known").distinct()
    found = functions.select("id", "path").join(there, "path", "left").join(met, "id", "left").select("id", F.col("__known").alias("known"), F.coalesce("hs", F.array().cast(met.schema["hs"].dataType)).alias("hs"))
    text = F.array_join(F.transform("hs", lambda x: x["__h"]), "\n")
    cut = F.length(text) > most_chars
    shown = F.when(cut, F.concat(F.substring(text, 1, most_chars), F.lit(f"\n… (cut at {most_chars} characters)"))).otherwise(text)
    known = F.coalesce("known", F.lit(False))
    return found.select("id", F.when(known, shown).alias("text"), (known & ~cut).alias("complete"))


def package_facts(files: DataFrame) -> DataFrame:
    """Facts of landed configuration files ``path, text``: ``path, kind, name, entries``: a package's name and programs, a module's name, a project's.

    JSON, with comments allowed, is read by Spark; of TOML and go.mod the few lines that name a project.
    """
    base, text = F.substring_index("path", "/", -1), F.col("text")
    js = base.isin("package.json", "tsconfig.json", "jsconfig.json")
    read = F.from_json(text, "name string, main string, bin string", {"allowComments": "true"})
    first = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    kind = F.when(js, "javascript").when(base == "go.mod", "go").when(base == "pyproject.toml", "python").when(base.endswith(".csproj"), "csharp")
    name = F.when(js, read["name"]).when(kind == "go", first(r"(?m)^module[ \t]+(\S+)")).when(kind == "python", first(r"(?ms)^\[project\][^\[]*?^name[ \t]*=[ \t]*[\"']([^\"']+)")).otherwise(first("(?s)<AssemblyName>([^<]+)</AssemblyName>"))
    programs = F.regexp_extract_all(F.coalesce(read["bin"], F.lit("")), F.lit(r"\"([^\"]+)\"\s*:"), F.lit(1))
    return files.where(kind.isNotNull()).select("path", kind.alias("kind"), name.alias("name"), F.when(js, programs).otherwise(F.array().cast("array<string>")).alias("entries"))


def toml_strings(text, key: str):
    """Strings of a one- or many-line TOML array ``key = ["a", 'b']``; null without the key, comments left out."""
    body = F.regexp_extract(text, rf"(?ms)^[ \t]*{re.escape(key)}[ \t]*=[ \t]*\[(.*?)^?[^\]]*?\]", 0)
    plain = F.regexp_replace(F.regexp_replace(body, r"(?m)^[ \t]*#.*$", ""), r"^[^=]*=", "")
    return F.when(body != "", F.transform(F.regexp_extract_all(plain, F.lit(r"\"([^\"]*)\"|'([^']*)'"), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2)))
