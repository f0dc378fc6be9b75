"""Operator 8: token counts by rank-synchronous merging of ragged arrays of symbols."""

from __future__ import annotations

import functools
import heapq
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import annotate, slices, text_bytes

#: Pre-tokens whose counts a worker remembers; the characters of the longest it does; and the symbols merged at once.
REMEMBERED, LONGEST, AT_ONCE = 500_000, 64, 1 << 19
#: Longer pre-tokens, in characters, are merged each by itself.
LONG = 2048
#: Pairs of one rank that are merged at once in a long pre-token.
CHUNK = 4096
#: How a piece file writes the space.
SPACE_MARK = "▁"


class PieceCounter:
    """Counts the pieces of a sentencepiece BPE model whose normaliser is the identity: read from its pieces and scores alone.

    A text gets a space in front; pre-tokens start at a space that follows another character.  No piece has a space after another
    character, so merges never cross their bounds, and what happens in one doesn't depend on others.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {}
        for i in range(model.vocab_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[model.id_to_piece(i)] = model.get_score(i)
        if any(SPACE_MARK in x.lstrip(SPACE_MARK) for x in pieces):
            raise ValueError("a piece has a space after another character")
        # ids by score, best first; pieces with equal scores share a rank
        names = sorted(pieces, key=lambda x: -pieces[x])
        self.symbol = {x: i for i, x in enumerate(names)}
        _, back = np.unique([-pieces[x] for x in names], return_inverse=True)
        self.rank = back.astype(np.int64)
        left, right, made = [], [], []
        for x, i in self.symbol.items():
            for cut in range(1, len(x)):
                if x[:cut] in self.symbol and x[cut:] in self.symbol:
                    left.append(self.symbol[x[:cut]])
                    right.append(self.symbol[x[cut:]])
                    made.append(i)
        self.size = len(names) + 1
        key = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        order = np.argsort(key)
        self.pairs, self.made = key[order], np.array(made, np.int64)[order]
        self.never = int(self.rank.max()) + 1
        # symbols of characters: a byte each if it isn't a piece
        self.unknown = self.size - 1

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that each pair makes; -1: none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], -1)

    def counts(self, pretokens: list[str]) -> np.ndarray:
        """The number of tokens of each, space marks written out."""
        lengths = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        out = np.zeros(len(pretokens), np.int64)
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        for low, high in slices(bounds, AT_ONCE):
            out[low:high] = self._counts("".join(pretokens[low:high]), bounds[low : high + 1] - bounds[low])
        return out

    def _counts(self, text: str, bounds: np.ndarray) -> np.ndarray:
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        values, back = np.unique(code, return_inverse=True)
        symbols = np.array([self.symbol.get(chr(x), self.unknown) for x in values], np.int64)[back]
        # a character that is no piece counts as its bytes
        extra = np.where(symbols == self.unknown, (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000), 0)
        n = np.diff(bounds)
        whole = np.concatenate(([0], np.cumsum(extra)))
        out = n + whole[bounds[1:]] - whole[bounds[:-1]]
        seq = np.repeat(np.arange(len(n)), n)
        if (n > LONG).any():
            for i in np.flatnonzero(n > LONG):
                out[i] -= self._merges(symbols[bounds[i] : bounds[i + 1]])
            short = (n <= LONG)[seq]
            symbols, seq = symbols[short], seq[short]
        made = np.full(len(symbols), -1, np.int64)
        if len(symbols) > 1:
            made[:-1] = np.where(seq[:-1] == seq[1:], self.merged(symbols[:-1], symbols[1:]), -1)
        while True:
            # only sequences that still have a pair to merge
            alive = np.zeros(len(n), bool)
            alive[seq[made >= 0]] = True
            keep = alive[seq]
            if not keep.any():
                return out
            symbols, seq, made = symbols[keep], seq[keep], made[keep]
            rank = np.where(made >= 0, self.rank[made], self.never)
            start = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            size = np.diff(np.append(start, len(seq)))
            lowest = np.repeat(np.minimum.reduceat(rank, start), size)
            chosen = (rank == lowest) & (made >= 0)
            chosen = apart(chosen)
            symbols, seq, made, unsafe = self._apply(symbols, seq, made, chosen, lowest, out, False)
            if unsafe is not None:
                # where a new pair would come first, only the leftmost merge of this rank is made now
                place = np.where(chosen, np.arange(len(seq)), len(seq))
                leftmost = np.repeat(np.minimum.reduceat(place, start), size) == np.arange(len(seq))
                chosen &= leftmost | ~unsafe[seq]
                symbols, seq, made, _ = self._apply(symbols, seq, made, chosen, lowest, out, True)

    def _merges(self, symbols: np.ndarray) -> int:
        """The number of merges in one long sequence: rank by rank as the others, but positions wait in a list for each rank, and only pairs next to a merge
        are made anew.  CHUNK positions of a rank are merged at once, from the left, and only up to one whose new pair would come before the next."""
        n = len(symbols)
        symbols = symbols.copy()
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, self.never)
        made = np.full(n, -1)
        fresh: dict[int, list[np.ndarray]] = {}
        sorted_: dict[int, deque[np.ndarray]] = {}
        ranks: list[int] = []
        count = 0

        def pair_of(first: np.ndarray, second: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            pair = np.where(there, self.merged(first, second), -1)
            return pair, np.where(pair >= 0, self.rank[pair], self.never)

        def wait(at: np.ndarray) -> None:
            """Makes the pairs that start at ``at`` anew."""
            second = after[at]
            pair, own = pair_of(symbols[at], symbols[np.minimum(second, n - 1)], second < n)
            made[at], rank[at] = pair, own
            at, own = at[pair >= 0], own[pair >= 0]
            if not len(at):
                return
            order = np.argsort(own, kind="stable")
            at, own = at[order], own[order]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
                r = int(own[a])
                if r not in fresh and r not in sorted_:
                    heapq.heappush(ranks, r)
                fresh.setdefault(r, []).append(at[a:b])

        wait(np.arange(n))
        while ranks:
            r = ranks[0]
            if r in fresh:
                every = np.unique(np.concatenate([*fresh.pop(r), *sorted_.pop(r, ())]))
                sorted_[r] = deque(every[i : i + CHUNK] for i in range(0, len(every), CHUNK))
            if not sorted_[r]:
                del sorted_[r]
                heapq.heappop(ranks)
                continue
            every = sorted_[r].popleft()
            every = every[rank[every] == r]
            if not len(every):
                continue
            # of pairs that overlap, every other one, from the first
            start = np.concatenate(([True], after[every[:-1]] != every[1:]))
            place = np.arange(len(every))
            at = every[(place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0]
            # the pairs that each merge makes, once those on its left are made
            right, left, new = after[at], before[at], made[at]
            far = after[right]
            beside = symbols[np.maximum(left, 0)]
            beside[1:] = np.where(far[:-1] == at[1:], new[:-1], beside[1:])
            _, low = pair_of(beside, new, left >= 0)
            _, high = pair_of(new, symbols[np.minimum(far, n - 1)], far < n)
            early = np.flatnonzero(np.minimum(low, high) <= r)
            if len(early) or every[-1] > at[-1]:
                last = int(early[0]) if len(early) else len(at) - 1
                sorted_[r].appendleft(every[every > at[last]])
                at, right, far, new = at[: last + 1], right[: last + 1], far[: last + 1], new[: last + 1]
            symbols[at] = new
            rank[right] = self.never
            after[at] = far
            inner = far < n
            before[far[inner]] = at[inner]
            count += len(at)
            left = before[at]
            wait(np.unique(np.concatenate((at, left[left >= 0]))))
        return count

    def _apply(self, symbols, seq, made, chosen, lowest, out, final):
        """Merges at ``chosen``.  Unless ``final``, nothing is done if any new pair has the rank at hand or a lower one; then the last value
        flags those sequences."""
        gone = np.zeros(len(seq), bool)
        gone[1:] = chosen[:-1]
        stay = ~gone
        new = np.where(chosen, made, symbols)[stay]
        s, was, low = seq[stay], made[stay], lowest[stay]
        fresh = chosen[stay]
        # pairs with a merged symbol on either side are new
        renew = fresh.copy()
        renew[:-1] |= fresh[1:]
        renew[-1] = False
        at = np.flatnonzero(renew)
        at = at[s[at] == s[at + 1]]
        pair = self.merged(new[at], new[at + 1])
        if not final:
            early = at[(pair >= 0) & (np.where(pair >= 0, self.rank[pair], self.never) <= low[at])]
            if len(early):
                unsafe = np.zeros(len(out), bool)
                unsafe[s[early]] = True
                return symbols, seq, made, unsafe
        was = np.where(renew | fresh, -1, was)
        was[at] = pair
        out -= np.bincount(seq[chosen], minlength=len(out))
        return new, s, was, None


def apart(chosen: np.ndarray) -> np.ndarray:
    """Of runs of chosen positions next to each other, every other one, from the first."""
    start = chosen & ~np.concatenate(([False], chosen[:-1]))
    place = np.arange(len(chosen))
    first = np.maximum.accumulate(np.where(start, place, -1))
    return chosen & ((place - first) % 2 == 0)


def parts_of(text: str) -> list[str]:
    """The pre-tokens of a text, each with its spaces in front, without the first of them (so a part ``x`` stands for `` x``)."""
    # a space mark in the text itself is no different from a space
    parts = text.replace(SPACE_MARK, " ").split(" ")
    if "" not in parts:
        return parts
    out, spaces = [], 0
    for part in parts[:-1]:
        if part:
            out.append(" " * spaces + part)
            spaces = 0
        else:
            spaces += 1
    out.append(" " * spaces + parts[-1])
    return out


@functools.lru_cache(maxsize=1)
def counter(path: str) -> tuple[PieceCounter, dict[str, int]]:
    return PieceCounter(path), {}


FIELDS = {"n_bytes": pa.int64(), "n_tokens": pa.int64()}


def count_tokens(docs: DataFrame, model_path: str, text_col: str = "text", as_: str = "tokens") -> DataFrame:
    """docs, columns unchanged, with a struct column ``as_`` of FIELDS for each whole text, row by row, without a shuffle.

    Null and empty texts have 0 bytes and 0 tokens.  ``model_path`` must exist on the executors.  Repeated rows get equal results, an empty table
    stays empty, other columns are carried along whatever their names.
    """

    def worker():
        pieces, known = counter(model_path)

        def apply(texts: pa.Array) -> dict:
            _, bounds = text_bytes(texts)
            out = np.zeros(len(texts), np.int64)
            for low, high in slices(bounds, 4 << 20):
                split = [parts_of(t) if (t := texts[i].as_py()) else [] for i in range(low, high)]
                new: dict[str, int] = {}
                for parts in split:
                    for part in parts:
                        if part not in known:
                            new[part] = 0
                names = list(new)
                found = pieces.counts([SPACE_MARK + x.replace(" ", SPACE_MARK) for x in names])
                new = dict(zip(names, found.tolist(), strict=True))
                if len(known) + len(new) > REMEMBERED:
                    kept = {p: known[p] for parts in split for p in parts if p in known}
                    known.clear()
                    known.update(kept)
                known.update(new)
                for i, parts in enumerate(split, low):
                    out[i] = sum(map(known.__getitem__, parts))
                for part in new:
                    if len(part) > LONGEST:
                        del known[part]
            return {"n_bytes": np.diff(bounds), "n_tokens": out}

        return apply

    return annotate(docs, F.col(text_col), worker, FIELDS, as_)
