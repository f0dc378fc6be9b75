"""Operator 7: rules on the words of a text, and repetition by suffix arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import annotate, free_name, group_sums, mix, prefix_sums, slices, span_hashes, text_bytes, word_spans

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

FIELDS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "repeat_covered": pa.int64(), "longest_repeat": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_()}


@dataclass(frozen=True)
class Limits:
    """Base rules: at least ``min_words``; at most ``max_repeat_percent`` of words in repeated windows of ``window`` words.

    Suffix-array rule: repeated substrings of ``min_repeat`` words or more may cover ``max_covered_percent`` of a text's words, and
    the longest (counted in words) may be up to ``max_longest_percent`` of them, or up to ``free_repeat`` words in any text.
    """

    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    min_repeat: int = 4
    max_covered_percent: int = 40
    max_longest_percent: int = 25
    free_repeat: int = 50


def word_ranks(h: np.ndarray, doc: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each word position the place, in the order of all positions, of the first that starts with the same ``reach`` words; how many
    do; and ``reach``, the largest power of two up to ``least``.  Words are ordered by hash; a text's end comes before any word."""
    n, place = len(h), np.arange(len(h))
    values, rank = np.unique(h, return_inverse=True)
    reach = 1
    while 2 * reach <= least:
        later = place + reach
        second = np.where(later < ends[doc], rank[np.minimum(later, n - 1)] + 1, 0)
        values, rank = np.unique(rank * (len(values) + 1) + second, return_inverse=True)
        reach *= 2
    count = np.bincount(rank, minlength=len(values))
    return (np.cumsum(count) - count)[rank], count[rank], reach


def sparse_suffixes(h: np.ndarray, doc: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the word positions that may start a repeat of ``least`` words in their text, and the common prefix (in words) of each with the one before it.

    ``h``: the words' hashes; ``doc``: each word's text; ``ends``: each text's end.  Left out are suffixes whose first words, as many as the
    largest power of two up to ``least``, occur once in the text.  Suffixes of different texts share nothing.
    Ranks double in length each round, as for a full suffix array, but only where they tie.
    """
    n = len(h)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rank, count, reach = word_ranks(h, doc, ends, least)
    at = np.flatnonzero((count > 1) & (np.arange(n) + reach <= ends[doc]))
    key = doc[at] * (n + 1) + rank[at]
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    sa, key = at[order[twice]], key[twice]
    if not len(sa):
        return sa, sa
    first = np.concatenate(([True], key[1:] != key[:-1]))
    while not first.all():
        later = sa + reach
        second = np.where(later < ends[doc[sa]], rank[np.minimum(later, n - 1)] + 1, 0)
        group = np.cumsum(first)
        order = np.lexsort((second, group))
        sa, second = sa[order], second[order]
        split = np.concatenate(([True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])))
        place = np.arange(len(sa))
        # a tied group's places in the order of all positions are enough for its parts
        rank[sa] += np.maximum.accumulate(np.where(split, place, 0)) - np.maximum.accumulate(np.where(first, place, 0))
        first = split
        reach *= 2
    return sa, common_prefixes(prefix_sums(h), doc, ends, sa)


def common_prefixes(prefix: np.ndarray, doc: np.ndarray, ends: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Words that each suffix of ``sa`` shares with the one before it; by bisection on span hashes."""
    a, b = sa[:-1], sa[1:]
    low = np.zeros(len(a), np.int64)
    high = np.where(doc[a] == doc[b], np.minimum(ends[doc[a]] - a, ends[doc[b]] - b), 0)
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = span_hashes(prefix, a, a + mid) == span_hashes(prefix, b, b + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return np.concatenate(([0], low))


def intervals(sa: np.ndarray, lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(from, to, length): the LCP intervals of at least ``least`` words: sa[from:to] start with the same ``length`` words, and not all with more."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []  # (from, length)
    values = lcp.tolist()
    for i, x in enumerate([*values[1:], 0], 1):
        start = i - 1
        while stack and stack[-1][1] > x:
            start, length = stack.pop()
            if length >= least:
                out.append((start, i, length))
        if x >= least and (not stack or stack[-1][1] < x):
            stack.append((start, x))
    return out


def maximal_repeats(words: list[str], least: int = 2) -> list[tuple[list[int], int]]:
    """(positions, length) of each maximal repeated substring of at least ``least`` words: longer ones don't occur at all its positions."""
    h = np.array([hash(x) & ((1 << 63) - 1) for x in words], np.uint64)
    sa, lcp = sparse_suffixes(h, np.zeros(len(h), np.int64), np.array([len(h)], np.int64), least)
    out = []
    for low, high, length in intervals(sa, lcp, least):
        at = sorted(sa[low:high].tolist())
        if len({words[i - 1] if i else None for i in at}) > 1 or 0 in at:  # else one word more fits on the left
            out.append((at, length))
    return sorted(out)


def repeated_windows(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Which of the windows of ``size`` words that start at ``at`` are found twice or more in their text; windows are compared whole, by ranks of their halves."""
    if not len(at):
        return np.empty(0, bool)
    rank, reach = ids, 1
    while reach < size:
        step = min(reach, size - reach)  # the second part may overlap the first
        rank = np.unique(rank[: len(rank) - step] * (len(ids) + 1) + rank[step:], return_inverse=True)[1]
        reach += step
    key = doc[at] * (len(ids) + 1) + rank[at]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    return count[back] > 1


def repeated_lines(text: bytes) -> int:
    """Lines with a word that are equal to an earlier one."""
    lines = text.split(b"\n")
    if len(lines) == 1:
        return 0
    inked = [x for x in lines if x and not x.isspace()]
    return len(inked) - len(set(inked))


def measure(raw: np.ndarray, bounds: np.ndarray, limits: Limits) -> dict[str, np.ndarray]:
    """FIELDS for the texts between ``bounds``."""
    start, end, at = word_spans(raw, bounds)
    n, words = np.diff(at), len(start)
    lead = (raw & 0xC0) != 0x80
    chars = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(lead, out=chars[1:])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    symbols = group_sums(symbol[raw], bounds)
    word_chars = group_sums(chars[end] - chars[start], at)
    doc = np.repeat(np.arange(len(n)), n)
    data = raw.tobytes()
    texts = [data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    # words by number, so that no two different ones are taken for the same
    split = [t.split() for t in texts]
    number = {w: i for i, w in enumerate(set().union(*split))}
    ids = np.fromiter((i for part in split for i in map(number.__getitem__, part)), np.int64, words)
    h = mix(ids.astype(np.uint64) + np.uint64(1))
    ends = at[1:]

    def covered(position: np.ndarray, length: np.ndarray) -> np.ndarray:
        edge = np.zeros(words + 1, np.int64)
        np.add.at(edge, position, 1)
        np.add.at(edge, position + length, -1)
        return group_sums(np.cumsum(edge[:-1]) > 0, at)

    window = np.flatnonzero(np.arange(words) + limits.window <= ends[doc]) if words else np.empty(0, np.int64)
    twice = repeated_windows(ids, doc, ends, window, limits.window)
    repeated = covered(window[twice], np.full(int(twice.sum()), limits.window))

    sa, lcp = sparse_suffixes(h, doc, ends, limits.min_repeat)
    longest, spans, lengths = np.zeros(len(n), np.int64), [], []
    for low, high, length in intervals(sa, lcp, limits.min_repeat):
        spans.append(sa[low:high])
        lengths.append(np.full(high - low, length))
        d = doc[sa[low]]
        longest[d] = max(longest[d], length)
    spread = covered(np.concatenate(spans), np.concatenate(lengths)) if spans else np.zeros(len(n), np.int64)

    dups = np.array([repeated_lines(t) for t in texts], np.int64)

    base = (n < limits.min_words) | (100 * repeated > limits.max_repeat_percent * n)
    bad = (100 * spread > limits.max_covered_percent * n) | ((longest > limits.free_repeat) & (100 * longest > limits.max_longest_percent * n))
    return {"n_words": n, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dups, "n_repeat_words": repeated, "repeat_covered": spread, "longest_repeat": longest, "base_failed": base, "kept": ~base & ~bad}


def judge(docs: DataFrame, text_col: str = "text", limits: Limits = Limits(), as_: str = "rules") -> DataFrame:
    """docs, columns unchanged, with a struct column ``as_`` of FIELDS, row by row, in one pass without a shuffle.

    ``base_failed``: the base rules of :class:`Limits`; ``kept``: no base rule and no rule of the method fails.
    Null and empty texts have no word, so they fail; a text of any length is measured whole; repeated rows get equal results; an empty table stays
    empty; other columns are carried along, whatever their names (``as_`` must be new).
    """

    def worker():
        def apply(texts: pa.Array) -> dict:
            raw, bounds = text_bytes(texts)
            parts = [measure(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], limits) for a, b in slices(bounds)]
            return {k: np.concatenate([p[k] for p in parts]) for k in FIELDS}

        return apply

    return annotate(docs, F.col(text_col), worker, FIELDS, as_)


def keep_good(docs: DataFrame, text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that :func:`judge` keeps, columns unchanged."""
    name = free_name(docs.columns, "rules")
    return judge(docs, text_col, limits, name).where(F.col(f"{name}.kept")).drop(name)
