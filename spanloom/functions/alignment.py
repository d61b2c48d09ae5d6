"""Token alignment by longest common subsequence, and the cost of a changed parameter list, as Pandas UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most cells of the alignment table; longer inputs get null, which callers must report as not compared.
MOST_CELLS = 250_000
EDITS = "array<struct<removed:array<string>,added:array<string>>>"


def edits(a: list[str], b: list[str]) -> list[dict] | None:
    """Replaced runs that turn ``a`` into ``b``; common ends are cut off first, and of equal alignments removal comes first."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    if not x and not y:
        return []
    if len(x) * len(y) > MOST_CELLS:
        return None
    common = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    codes = {t: n for n, t in enumerate(dict.fromkeys([*x, *y]))}
    right = np.array([codes[t] for t in y])
    for i in range(len(x) - 1, -1, -1):
        # best[j] = max over k >= j of what row i offers, which is a running maximum from the right
        offered = np.where(right == codes[x[i]], common[i + 1, 1:] + 1, common[i + 1, :-1])
        common[i, :-1] = np.maximum.accumulate(offered[::-1])[::-1]
    out, removed, added, i, j = [], [], [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j] and common[i, j] == common[i + 1, j + 1] + 1:
            if removed or added:
                out.append({"removed": removed, "added": added})
                removed, added = [], []
            i, j = i + 1, j + 1
        elif i < len(x) and (j == len(y) or common[i + 1, j] >= common[i, j + 1]):
            removed.append(x[i])
            i += 1
        else:
            added.append(y[j])
            j += 1
    if removed or added:
        out.append({"removed": removed, "added": added})
    return out


def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edits(list(x) if x is not None else [], list(y) if y is not None else []) for x, y in zip(a, b, strict=True)])


def parameter_cost(base: list[str], head: list[str]) -> int:
    """Least number of names to add, drop or replace that turns one parameter list into another."""
    row = list(range(len(head) + 1))
    for i, name in enumerate(base, 1):
        before, row = row, [i]
        for j, other in enumerate(head, 1):
            row.append(min(before[j - 1] + (name != other), before[j] + 1, row[-1] + 1))
    return row[-1]


def _aligned(base: list[dict], head: list[dict]) -> list[tuple[int | None, int | None]]:
    """Pairs of positions of a cheapest alignment by name, from the front: a pair before an addition, an addition before a removal."""
    rest = [[0] * (len(head) + 1) for _ in range(len(base) + 1)]  # costs of what is left behind both positions
    for i in range(len(base), -1, -1):
        for j in range(len(head), -1, -1):
            ways = [rest[i + 1][j + 1] + (base[i]["name"] != head[j]["name"])] if i < len(base) and j < len(head) else []
            ways += ([rest[i][j + 1] + 1] if j < len(head) else []) + ([rest[i + 1][j] + 1] if i < len(base) else [])
            rest[i][j] = min(ways, default=0)
    out, i, j = [], 0, 0
    while i < len(base) or j < len(head):
        both = i < len(base) and j < len(head)
        if both and rest[i][j] == rest[i + 1][j + 1] + (base[i]["name"] != head[j]["name"]):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j < len(head) and rest[i][j] == rest[i][j + 1] + 1:
            out.append((None, j))
            j += 1
        else:
            out.append((i, None))
            i += 1
    return out


def signature_changes(base: dict | None, head: dict) -> list[str]:
    """Kinds of change between two signatures ``{params, returns, async}``, each once, in the order they are met; none without a base."""
    if base is None:
        return []
    found = ["async-changed"] if bool(base["async"]) != bool(head["async"]) else []
    old, new = list(base["params"] if base["params"] is not None else []), list(head["params"] if head["params"] is not None else [])
    for i, j in _aligned(old, new):
        if i is None:
            found.append("optional-param" if new[j]["optional"] or new[j]["rest"] else "required-param")
        elif j is None:
            found.append("param-removed")
        else:
            a, b = old[i], new[j]
            if a["type"] != b["type"]:
                found.append("type-changed")
            if bool(a["optional"]) != bool(b["optional"]):
                found.append("optional-param-changed" if b["optional"] else "required-param")
            elif a["default"] is not None and b["default"] is not None and a["default"] != b["default"]:
                found.append("default-changed")
    found = list(dict.fromkeys(found))
    return found + (["return-changed"] if (base["returns"] or None) != (head["returns"] or None) else [])


def _kinds(base: pd.DataFrame, head: pd.DataFrame) -> pd.Series:
    known = base["params"].notna() | base["returns"].notna() | base["async"].notna()
    return pd.Series([signature_changes(b if k else None, h) for b, h, k in zip(base.to_dict("records"), head.to_dict("records"), known, strict=True)])


def signature_kinds(base: Column, head: Column) -> Column:
    """Kinds of change of two structs ``params array<struct<name, type, optional, rest, default>>, returns, async``.

    ``base`` is null, or has ``async`` null, where a function is new. The alignment is by names, so an added parameter does not
    change those behind it. Lists of parameters are short; a task holds one pair at a time.
    """
    return F.pandas_udf(_kinds, "array<string>")(base, head)


def token_edits(a, b) -> Column:
    """Edits between two token arrays; null where the pair is over the work limit."""
    return F.pandas_udf(_edits, EDITS)(a, b)
