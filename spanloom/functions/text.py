"""Text functions: tokens, names, paths, status lines, sizes, positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: an identifier, a number, a quoted string, or one other character that is no space.
TOKEN = r"""[A-Za-z_$][\w$]*|\d+(?:\.\d+)?|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|[^\s\w]"""
WORD = r"[A-Za-z_][A-Za-z0-9_]*"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def words(text: Column, pattern: str = WORD) -> Column:
    """Distinct words in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def shape(parts: Column, keywords: list[str]) -> Column:
    """Tokens with every identifier that is no keyword as ``$``."""
    kept = F.array(*[F.lit(k) for k in keywords]) if keywords else F.array().cast("array<string>")
    return F.transform(parts, lambda t: F.when(t.rlike(r"^[A-Za-z_$]") & ~F.array_contains(kept, t), F.lit("$")).otherwise(t))


ARROW = " → "


def edit_key(removed: Column, added: Column, most: int = 6) -> Column:
    """``removed → added`` as text; null if a side has more than ``most`` tokens."""
    text = F.concat(F.array_join(removed, " "), F.lit(ARROW), F.array_join(added, " "))
    return F.when((F.size(removed) <= most) & (F.size(added) <= most), text)


def shape_key(edits: Column, keywords: list[str], most: int = 6, largest: int = 40) -> Column:
    """One key for all edits of a hunk, ``array<struct<removed, added>>``: identifiers as ``$``, edits joined by `` | ``.

    An edit of more than ``most`` tokens a side counts by its sizes. Null without edits, with a side over ``largest``
    tokens, or if no edit holds a keyword, a number or a string.
    """
    big = lambda e: (F.size(e["removed"]) > most) | (F.size(e["added"]) > most)
    sizes = lambda e: F.concat(F.lit("⟪"), F.size(e["removed"]).cast("string"), F.lit(ARROW), F.size(e["added"]).cast("string"), F.lit("⟫"))
    side = lambda c: F.array_join(shape(c, keywords), " ")
    part = lambda e: F.when(big(e), sizes(e)).otherwise(F.concat(side(e["removed"]), F.lit(ARROW), side(e["added"])))
    known = lambda t: t.rlike("^[0-9\"'`]") | (F.array_contains(F.array(*[F.lit(k) for k in keywords]), t) if keywords else F.lit(False))
    says = F.exists(edits, lambda e: F.exists(F.concat(e["removed"], e["added"]), known))
    huge = F.exists(edits, lambda e: (F.size(e["removed"]) > largest) | (F.size(e["added"]) > largest))
    return F.when((F.size(edits) > 0) & ~huge & says, F.array_join(F.transform(edits, part), " | "))


def shape_words(part: Column) -> Column:
    """One edit of a shape key in words: what was added, removed or replaced; a part of another form as it is."""
    numbers = F.transform(F.regexp_extract_all(part, F.lit(r"\d+"), F.lit(0)), lambda n: n.cast("int"))
    gone, come = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    many = lambda n: F.concat(n.cast("string"), F.when(n == 1, " token").otherwise(" tokens"))
    counted = F.when(gone == 0, F.concat(many(come), F.lit(" added"))).when(come == 0, F.concat(many(gone), F.lit(" removed"))).otherwise(F.concat(many(gone), F.lit(" replaced by "), come.cast("string")))
    before, after = F.trim(F.substring_index(part, ARROW, 1)), F.trim(F.regexp_extract(part, f"(?s)^.*?{ARROW}(.*)$", 1))
    quoted = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    words_ = F.when((before != "") & (after != ""), F.concat(quoted(before), F.lit(" replaced by "), quoted(after))).when(after != "", F.concat(F.lit("added "), quoted(after))).otherwise(F.concat(F.lit("removed "), quoted(before)))
    return F.when(part.rlike(rf"^⟪\d+{ARROW}\d+⟫$"), counted).when(~part.contains(ARROW), part).otherwise(words_)


def informative(key: Column, least: int = 2) -> Column:
    """Whether both sides together have ``least`` tokens that are identifiers, numbers or strings."""
    return F.size(F.filter(tokens(F.replace(key, F.lit("→"), F.lit(" "))), lambda t: t.rlike("^[A-Za-z0-9_$\"'`]"))) >= least


#: What a ``throw`` makes, and what it calls.
_MADE = r"^new\s+([\p{L}_$][\p{L}\p{N}_$]*(?:\s*\.\s*[\p{L}_$][\p{L}\p{N}_$]*)*)"
_CALLED = r"^([\p{L}_$][\p{L}\p{N}_$]*(?:\s*\.\s*[\p{L}_$][\p{L}\p{N}_$]*)*)\s*(?:<[^()]*>\s*)?\("


def throw_key(text: Column) -> Column:
    """What a thrown expression is paired by: its constructor, the function it calls, or its own text."""
    plain = lambda c: F.regexp_replace(c, r"\s+", "")
    made, called = F.regexp_extract(text, _MADE, 1), F.regexp_extract(text, _CALLED, 1)
    return F.when(made != "", F.concat(F.lit("new "), plain(made))).when(called != "", F.concat(plain(called), F.lit("(…)"))).otherwise(text)


def one_line(text: Column, most: int = 200) -> Column:
    """Control characters and runs of space as one space, trimmed, cut to ``most`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"[\x00-\x20\x7F]+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def first_line(text: Column, most: int = 120) -> Column:
    """First line that is not blank, trimmed and cut."""
    return F.substring(F.trim(F.regexp_extract(text, r"(?m)^[ \t]*(\S[^\n]*)$", 1)), 1, most)


def top_folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("")


def tail(path: Column) -> Column:
    """The path below its top folder."""
    return F.regexp_replace(path, r"^[^/]*/", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def container_and_name(label: Column) -> Column:
    """``A.b.c`` as container ``A.b`` and name ``c``."""
    return F.struct(F.regexp_extract(label, r"^(.*)\.[^.]+$", 1).alias("container"), F.regexp_extract(label, r"([^.]*)$", 1).alias("name"))


#: Words that mark test support.
TEST_WORDS = ("test", "tests", "fake", "fakes", "mock", "mocks", "spy", "spies", "stub", "stubs", "fixture", "fixtures")


def is_test_like(text: Column) -> Column:
    """Whether a path or name has one of :data:`TEST_WORDS` as a word, also inside camelCase."""
    return F.exists(F.regexp_extract_all(text, F.lit("[A-Z]+[a-z0-9]*|[a-z0-9]+"), F.lit(0)), lambda w: F.lower(w).isin(*TEST_WORDS))


def classified(name: Column, families: list[tuple[str, str]], other: str = "other") -> Column:
    """Label of the first pattern that matches; ``unknown`` for null or blank, ``other`` if none does."""
    out = F.when(F.trim(F.coalesce(name, F.lit(""))) == "", "unknown")
    for pattern, label in families:
        out = out.when(name.rlike(pattern), label)
    return out.otherwise(other)


def status_line(text: Column, most: int = 500) -> Column:
    """What stands behind ``Status:``: ``none`` if nothing, ``done``, ``skipped`` with its reason, else ``unreadable`` with the reason why.

    Emphasis around the text does not count.
    """
    t = F.regexp_replace(F.trim(text), r"^[*_`\s]+", "")
    rest = F.regexp_extract(t, r"(?is)^skipped\s*(?:(?:—|–|--|-|:)\s*)?(.*)$", 1)
    reason = F.substring(F.trim(F.regexp_replace(rest, r"[*_`\s]+$", "")), 1, most)
    done, skipped = (t.rlike(rf"(?is)^{word}($|[^\p{{L}}\p{{N}}_])") for word in ("done", "skipped"))
    status = F.when(t == "", "none").when(done, "done").when(skipped, "skipped").otherwise("unreadable")
    why = F.when(status == "unreadable", F.concat(F.lit("unrecognised status: "), F.substring(t, 1, 60))).when((status == "skipped") & (reason != ""), reason)
    return F.struct(status.alias("status"), why.alias("reason"))


def formatted_bytes(n: Column) -> Column:
    """Bytes in units of 1024: B and KB whole, MB and GB with one decimal; nothing below zero."""
    v = F.when(n > 0, n.cast("double")).otherwise(0.0)
    whole = lambda x: F.floor(x + 0.5).cast("string")
    one = lambda x: F.format_string("%.1f", x)
    return (
        F.when(v < 1024, F.concat(whole(v), F.lit(" B"))).when(v < 1024**2, F.concat(whole(v / 1024), F.lit(" KB")))
        .when(v < 1024**3, F.concat(one(v / 1024**2), F.lit(" MB"))).otherwise(F.concat(one(v / 1024**3), F.lit(" GB")))
    )


def clamped(value: Column, most: int, fallback: int, least: int = 1) -> Column:
    """A whole number from ``least`` to ``most``, and a warning where it was not one.

    Fractions round down. Null takes the fallback without a warning, a number below the range takes it with one.
    """
    whole = F.floor(value)
    bad = value.isNotNull() & (~(whole >= least) | F.isnan(value.cast("double")))
    number = F.when(value.isNull() | bad, F.lit(fallback)).when(whole > most, F.lit(most)).otherwise(whole)
    warning = F.when(bad, "not a number in range").when(whole > most, "above the maximum")
    return F.struct(number.cast("long").alias("value"), warning.alias("warning"))


def content_id(text: Column) -> Column:
    """SHA-256 of the text; of absent text a value of its own."""
    return F.sha2(F.coalesce(text, F.lit("<absent>")), 256)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def line_starts(text: Column) -> Column:
    """Offset of each line's first character, from 0."""
    sizes = F.transform(F.split(text, "\n", -1), lambda line: F.length(line) + 1)
    return F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)), lambda acc: F.slice(acc, F.lit(1), F.size(acc) - 1))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def header_range(line: Column) -> Column:
    """Both ranges of a hunk header ``@@ -a,b +c,d @@``; an omitted count is 1."""
    part = lambda g: F.regexp_extract(line, r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", g)
    number = lambda g: F.when(part(g) != "", part(g).cast("int"))
    return F.struct(number(1).alias("old_start"), F.coalesce(number(2), F.lit(1)).alias("old_count"), number(3).alias("new_start"), F.coalesce(number(4), F.lit(1)).alias("new_count"))


def glob_regex(spec: str) -> str:
    """Regular expression of a glob over ``/`` paths, which matches what it names and everything below.

    A part ``**`` stands for any folders, ``*`` for a run inside a name and ``?`` for one character of it.
    """
    spec = spec.replace("\\", "/")
    while spec.startswith("./"):
        spec = spec[2:].lstrip("/") if spec[2:].startswith("/") else spec[2:]
    spec = spec.rstrip("/")
    if spec in ("", "."):
        return "^"
    out, parts = "", spec.split("/")
    for at, part in enumerate(parts):
        last = at == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            out += "".join({"*": "[^/]*", "?": "[^/]"}.get(c, f"\\{c}" if c in ".+^${}()|[]\\" else c) for c in part) + ("" if last else "/")
    return f"^{out}(?:/.*)?$"


def offset_of(text: Column, line: Column, character: Column) -> Column:
    """0-based offset of a character of a 1-based line; past a line's end its end, past the text's end the text's."""
    starts = line_starts(text)
    start = F.coalesce(F.try_element_at(starts, F.greatest(line, F.lit(1)).cast("int")), F.length(text))
    end = F.coalesce(F.try_element_at(starts, (F.greatest(line, F.lit(1)) + 1).cast("int")) - 1, F.length(text))
    return F.least(start + F.greatest(character, F.lit(0)), end)


def whole_range(text: Column) -> Column:
    """Lines 1 to the last of a text; a trailing line feed ends the last line and starts none."""
    n = F.size(F.split(text, "\n", -1)) - F.endswith(text, F.lit("\n")).cast("int")
    return F.struct(F.lit(1).alias("lo"), F.greatest(n, F.lit(1)).alias("hi"))


def names_match(known: Column, written: Column) -> Column:
    """Whether one name contains the other, whatever the case; both have two characters at least."""
    a, b = F.lower(known), F.lower(written)
    return (F.length(a) > 1) & (F.length(b) > 1) & (a.contains(b) | b.contains(a))


def pull_number(query: Column) -> Column:
    """The number of a query ``482`` or ``#482``, from 1; null for any other."""
    digits = F.regexp_extract(F.trim(query), r"^#?\s*(\d{1,9})$", 1)
    return F.when(F.try_to_number(digits, F.lit("999999999")) >= 1, digits.cast("int"))


def suggestion_blocks(body: Column) -> Column:
    """Texts of the closed ``suggestion`` fences of a comment in Markdown, in order; null for an empty one."""
    found = F.regexp_extract_all(F.replace(body, F.lit("\r\n"), F.lit("\n")), F.lit(r"(?ms)^ {0,3}(?:```+|~~~+)[ \t]*suggestion[ \t]*\n(.*?)^ {0,3}(?:```+|~~~+)[ \t]*$"), F.lit(1))
    return F.transform(found, lambda b: F.when(b != "", F.regexp_replace(b, r"\n\z", "")))


def model_version(name: Column, families: list[tuple[str, str]]) -> Column:
    """Family of a model's name by the first pattern that matches, and its first version number; eight digits are a date, no version."""
    low = F.lower(F.trim(name))
    family = classified(low, families)
    found = F.regexp_extract(low, r"(?:^|[^\d])(\d{1,2}(?:[.-]\d{1,2})?)(?!\d)", 1)
    version = F.when(~family.isin("unknown", "other") & (found != ""), F.replace(found, F.lit("-"), F.lit(".")))
    return F.struct(family.alias("family"), version.alias("version"))


def round_file(created: Column, n: Column) -> Column:
    """Name of a round's file, ``YYYY-MM-DD-n.md``, by the session's time zone."""
    return F.concat(F.date_format(created, "yyyy-MM-dd"), F.lit("-"), n.cast("string"), F.lit(".md"))


def next_round(names: Column) -> Column:
    """Aggregate: one more than the largest number among names of :func:`round_file`; others do not count."""
    found = F.regexp_extract(names, r"^\d{4}-\d{2}-\d{2}-(\d{1,9})\.md$", 1)
    return F.coalesce(F.max(F.when(found != "", found.cast("int"))), F.lit(0)) + 1


def signature(params: Column, returns: Column) -> Column:
    """A signature as text from ``array<struct<name, type, optional, rest, default>>``: ``(a: T, b?: U, ...c) => R``."""
    def one(p):
        name = F.concat(F.when(p["rest"], "...").otherwise(""), p["name"], F.when(p["optional"] & p["default"].isNull(), "?").otherwise(""))
        return F.concat(name, F.coalesce(F.concat(F.lit(": "), p["type"]), F.lit("")), F.coalesce(F.concat(F.lit(" = "), p["default"]), F.lit("")))

    return F.concat(F.lit("("), F.array_join(F.transform(params, one), ", "), F.lit(")"), F.coalesce(F.concat(F.lit(" => "), returns), F.lit("")))


def canonical_json(text: Column) -> Column:
    """Equal text for equal JSON values: keys in order at every depth, types kept, numbers in one form; null for what is no JSON or repeats a key."""
    return F.to_json(F.try_parse_json(text))


#: A JSON string, which may hold what looks like a comment or a comma.
_JSON_STRING = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")'


def commented_json(text: Column) -> Column:
    """JSON with comments and commas behind the last element, as a variant; null for what is no JSON even so."""
    plain = F.regexp_replace(text, _JSON_STRING + r"|//[^\n]*+|(?s:/\*.*?\*/)", "$1")
    return F.try_parse_json(F.regexp_replace(plain, _JSON_STRING + r"|,(?=\s*[}\]])", "$1"))


def symbol_identity(path: Column, key: Column, prefix: Column, text: Column) -> Column:
    """Identity of a reviewed symbol: digest of its place and of what it says, so that a change of either asks for a new review."""
    return F.sha2(F.concat_ws("\n", path, key, F.coalesce(prefix, F.lit("")), content_id(text)), 256)


def worktree_identity(head: Column, path: Column, stamp: Column) -> Column:
    """Aggregate: digest of a worktree from its head and its files' paths and stamps (size and times, null for a missing file), whatever their order."""
    files = F.array_sort(F.collect_list(F.concat(path, F.lit("\u0000"), F.coalesce(stamp, F.lit("missing")), F.lit("\u0000"))))
    return F.sha2(F.concat(F.coalesce(F.max(head), F.lit("")), F.array_join(files, "")), 256)
