"""Text as arrays: code points, words and their 64-bit hashes, many documents at a time.

These are the inner loops of the operators' Arrow functions. A batch of texts becomes one array of folded code points in
which 0 separates words; word hashes come from one cumulative sum over that array, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Code points handled at once; longer texts are taken in pieces that end at a separator.
PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_TOP = 0x33000  # no letters are assigned beyond this code point


@lru_cache(maxsize=None)
def letters() -> np.ndarray:
    """Lower-case letter for each code point, 0 for what is no letter."""
    return np.array([ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 0 for c in map(chr, range(_TOP))], np.uint32)


@lru_cache(maxsize=None)
def alphanumerics() -> np.ndarray:
    """As :func:`letters`, with digits."""
    return np.array([ord(c.lower()) if c.isalnum() and len(c.lower()) == 1 else ord(c) if c.isalnum() else 0 for c in map(chr, range(_TOP))], np.uint32)


def fold(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(codes, _TOP - 1)]


def fold_spaced(codes: np.ndarray) -> np.ndarray:
    """Words end at the six ASCII space characters only, and only A-Z is lower-cased. Values are one above the code."""
    out = codes + np.uint32(1)
    out[(codes >= 65) & (codes <= 90)] += np.uint32(32)
    out[(codes == 32) | ((codes >= 9) & (codes <= 13))] = 0
    return out


def fold_alnum(codes: np.ndarray) -> np.ndarray:
    """Words are runs of letters and digits, lower-cased."""
    return fold(codes, alphanumerics())


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values, after Stafford's variant 13."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=None)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for any piece but those longer than PIECE."""
    return _powers_of(PIECE + 1)


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64)))) for b in (_BASE, inverse))


def slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Rows of an Arrow batch some million characters at a time: where they begin, and their texts (null as empty)."""
    texts, begin, size = [], 0, 0
    for i, value in enumerate(batch.column(column)):
        text = value.as_py() or ""
        if texts and size + len(text) > limit:
            yield begin, texts
            texts, begin, size = [], i, 0
        texts.append(text)
        size += len(text)
    if texts:
        yield begin, texts


def _pieces(texts: list[str], fold_codes) -> Iterator[tuple[list[int], list[str]]]:
    """Documents' numbers and texts, about PIECE code points at a time; only a text longer than that is cut, at a separator."""
    numbers, parts, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > PIECE:
            window = fold_codes(codepoints(text[at : at + PIECE]))
            ends = np.flatnonzero(window == 0)
            end = at + (int(ends[-1]) if len(ends) and ends[-1] else PIECE - 1)
            if not len(ends) or not ends[-1]:  # one word fills the window: look further for its end
                while end < len(text) and fold_codes(codepoints(text[end]))[0]:
                    end += 1
            if numbers:
                yield numbers, parts
                numbers, parts, size = [], [], 0
            yield [i], [text[at:end]]
            at = end
        rest = text[at:] if at else text
        if size + len(rest) > PIECE and numbers:
            yield numbers, parts
            numbers, parts, size = [], [], 0
        numbers.append(i)
        parts.append(rest)
        size += len(rest) + 1
    if numbers:
        yield numbers, parts


def word_hashes(texts: list[str], fold_codes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and where each text's words start (one entry more than texts)."""
    hashes, owners = [], []
    with np.errstate(over="ignore"):
        for numbers, parts in _pieces(texts, fold_codes):
            codes = fold_codes(codepoints("\n".join(parts)))
            inside = np.concatenate((np.zeros(1, np.int8), (codes != 0).view(np.int8), np.zeros(1, np.int8)))
            edges = np.diff(inside)
            start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            if not len(start):
                continue
            up, down = _powers() if len(codes) <= PIECE else _powers_of(len(codes))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(codes.astype(np.uint64)) * up[: len(codes)])))
            hashes.append(mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)))
            begins = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
            owners.append(np.asarray(numbers)[np.searchsorted(begins, start, "right") - 1])
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def windows(h: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside one text, and where each text's runs start."""
    counts = np.maximum(np.diff(starts) - n + 1, 0)
    out = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    at = np.arange(out[-1]) + np.repeat(starts[:-1] - out[:-1], counts)
    return run_hash(h, at, range(n)), out


def run_hash(h: np.ndarray, at: np.ndarray, offsets) -> np.ndarray:
    """Hash of the words at ``at + o`` for each offset o, in order."""
    with np.errstate(over="ignore"):
        total = np.full(len(at), np.uint64(len(offsets)))
        for k, o in enumerate(offsets):
            total = mixed(total * np.uint64(0xD6E8FEB86659FD93) + h[at + o] + np.uint64(k))
        return total
