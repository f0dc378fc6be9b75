"""Operator 6: byte-level BPE by a queue of merge ranks kept as a hierarchical bitmap."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import annotate

#: Pre-tokens and space-separated parts that a worker remembers, and the characters of the longest it does.
REMEMBERED, LONGEST = 600_000, 48
#: Marks that make a pre-token of their own after a word.
MARKS = tuple(".,;:!?")
#: Texts with more characters are split by a running match, so that their parts aren't all held at once.
LONG_TEXT = 1 << 20


class Remembering(dict):
    """make(key) for each key, remembered; emptied when full."""

    def __init__(self, make, most: int = REMEMBERED, longest: int = LONGEST):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


#: A space next to other white space: there the parts between spaces aren't independent.  It starts with a plain space, which is found fast.
BESIDE = re.compile(r" (?:\s|(?<=\s ))")


class Codec:
    """Encodes and decodes by a file of ranks: lines of a base64 token and its rank.

    The merges of a pre-token come from a queue by rank.  A bit of ``words[rank >> 8]`` is set for each rank whose bucket holds positions, and
    a bit of ``tops`` for each word with a bit, so two find-first-sets give the lowest rank.  A bucket holds the positions (of the left
    symbol, in the list linked by ``end`` and ``before``) whose pair had that rank when they were put in; those that changed since are skipped.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token = {str(b): a for a, b in self.ranks.items()}
        #: rank of each pair of bytes; -1: none
        self.byte_pairs = [[self.ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)]
        self.words = [0] * ((max(self.ranks.values()) >> 8) + 1)
        self.find = regex.compile(pattern)
        self.pieces = Remembering(self._piece)
        self.parts = Remembering(self._part)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token, in time n log n of its n bytes."""
        ranks, words, buckets, tops = self.ranks, self.words, {}, 0
        get = ranks.get
        if (whole := get(piece)) is not None:
            return [whole]
        n = len(piece)
        pair = [self.byte_pairs[a][b] for a, b in zip(piece, piece[1:], strict=False)]  # rank of this symbol and the next
        for i, r in enumerate(pair):
            if r in buckets:
                self._more(buckets, r, i)
            elif r >= 0:
                buckets[r] = i
                words[r >> 8] |= 1 << (r & 255)
                tops |= 1 << (r >> 8)
        pair.append(-1)
        end = list(range(1, n + 1))  # of the symbol that starts here
        before = list(range(-1, n))  # where the symbol to the left starts
        while tops:
            w = (tops & -tops).bit_length() - 1
            own = words[w]
            low = own & -own
            r = (w << 8) + low.bit_length() - 1
            i = buckets.pop(r)
            if i.__class__ is list:
                bucket, i = i, heappop(i)
                if bucket:
                    buckets[r] = bucket
            if r not in buckets:
                words[w] = own = own ^ low
                if not own:
                    tops &= tops - 1
            if pair[i] != r:
                continue  # stale
            middle = end[i]
            stop = end[i] = end[middle]
            pair[middle] = -1
            before[stop] = i
            if stop < n:
                r = pair[i] = get(piece[i : end[stop]], -1)
                if r in buckets:
                    self._more(buckets, r, i)
                elif r >= 0:
                    buckets[r] = i
                    words[r >> 8] |= 1 << (r & 255)
                    tops |= 1 << (r >> 8)
            else:
                pair[i] = -1
            i = before[i]
            if i >= 0:
                r = pair[i] = get(piece[i:stop], -1)
                if r in buckets:
                    self._more(buckets, r, i)
                elif r >= 0:
                    buckets[r] = i
                    words[r >> 8] |= 1 << (r & 255)
                    tops |= 1 << (r >> 8)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    @staticmethod
    def _more(buckets: dict, rank: int, position: int) -> None:
        """A bucket of one position is that number; of several a heap."""
        own = buckets[rank]
        if own.__class__ is list:
            heappush(own, position)
        else:
            buckets[rank] = [min(own, position), max(own, position)]

    def _part(self, part: str) -> str:
        """The ids of a part between spaces, and the space before it."""
        if part.isalpha():
            return self.pieces[" " + part]
        stem, mark = part[:-1], part[-1:]
        if mark in MARKS and stem.isalpha():
            return f"{self.pieces[' ' + stem]} {self.pieces[mark]}"
        return " ".join(map(self.pieces.__getitem__, self.find.findall(" " + part)))

    def _piece(self, piece: str) -> str:
        return " ".join(map(str, self.merge(piece.encode())))

    def encode(self, text: str):
        """Decimal ids, joined by single spaces, in one or more strings."""
        if not text:
            return
        if len(text) > LONG_TEXT or BESIDE.search(text):
            pieces = (m[0] for m in self.find.finditer(text)) if len(text) > LONG_TEXT else iter(self.find.findall(text))
            while block := list(islice(pieces, 1 << 16)):
                yield " ".join(map(self.pieces.__getitem__, block))
            return
        # every space starts a pre-token here, and none reaches past the next one
        first, *parts = text.split(" ")
        head = " ".join(map(self.pieces.__getitem__, self.find.findall(first)))
        yield " ".join(filter(None, (head, *map(self.parts.__getitem__, parts))))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.split(" ")))


@functools.lru_cache(maxsize=1)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


FIELDS = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def digests(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", as_: str = "bpe") -> DataFrame:
    """docs, columns unchanged, with a struct column ``as_`` of FIELDS, row by row, without a shuffle: the whole text encoded
    (null and empty: no ids), and the ids decoded again.  ``ranks_path`` must exist on the executors.  Repeated rows get equal results,
    an empty table stays empty, other columns are carried along whatever their names."""

    def worker():
        own = codec(ranks_path, pattern)

        def apply(texts: pa.Array) -> dict:
            n, ids, plain = np.zeros(len(texts), np.int64), [], []
            for i, text in enumerate(texts):
                a, b = hashlib.sha256(), hashlib.sha256()
                for block in own.encode(text.as_py() or ""):
                    if n[i]:
                        a.update(b" ")
                    a.update(block.encode())
                    b.update(own.decode(block))
                    n[i] += block.count(" ") + 1
                ids.append(a.hexdigest())
                plain.append(b.hexdigest())
            return {"n_tokens": n, "ids_sha256": ids, "decoded_sha256": plain}

        return apply

    return annotate(docs, F.col(text_col), worker, FIELDS, as_)


def encoded(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", as_: str = "bpe") -> DataFrame:
    """docs with a struct column ``as_`` of one field, ``ids`` array<int>; else as :func:`digests`."""

    def worker():
        own = codec(ranks_path, pattern)

        def apply(texts: pa.Array) -> dict:
            return {"ids": pa.array([[int(x) for block in own.encode(t.as_py() or "") for x in block.split(" ")] for t in texts], pa.list_(pa.int32()))}

        return apply

    return annotate(docs, F.col(text_col), worker, {"ids": pa.list_(pa.int32())}, as_)


def decoded(docs: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """docs with ``decoded`` binary: the bytes of the ids in ``ids_col`` (null: none)."""

    def worker():
        own = codec(ranks_path, pattern)

        def apply(ids: pa.Array) -> dict:
            return {"bytes": pa.array([own.decode(x.as_py()) if x.as_py() else b"" for x in ids], pa.binary())}

        return apply

    joined = F.array_join(F.col(ids_col).cast("array<string>"), " ")
    return annotate(docs, joined, worker, {"bytes": pa.binary()}, "decoded_").withColumn("decoded", F.col("decoded_.bytes")).drop("decoded_")
