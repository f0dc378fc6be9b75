"""Operator 5: documents in the order of a space-filling curve, packed into sequences without padding."""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import Written, annotate, map_batches, mix, slices, small_batches, spark_schema, text_bytes

#: Places of the hashed vectors, the dimensions they are projected to, and the bits of each in a curve key.
PLACES, DIMENSIONS, BITS = 1024, 4, 12
#: Pre-tokens whose ids a worker remembers, and the characters of the longest it does; pre-tokens that are encoded as one text.
REMEMBERED, LONGEST, JOINED = 600_000, 48, 128
#: Documents whose vectors are held at once.
VECTORS = 512
#: Code points below this are told apart by tables here; parts of texts with others, or whose lower case is such, go to the tokenizer as they stand.
PLAIN = 0x250
#: The endings that the tokenizer splits off, and how its special tokens begin.
ENDINGS, SPECIAL = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"), "<|"


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place along the Hilbert curve of each row of whole numbers below 2**bits, as one number (dimensions * bits below 64).

    Skilling's transform, for all rows at once.
    """
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > 1:
        p = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ t)
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = one << np.uint64(bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.view(np.int64)


@functools.lru_cache(maxsize=1)
def projection() -> np.ndarray:
    """Fixed pseudo-random directions, PLACES x DIMENSIONS."""
    h = mix(np.arange(1, PLACES * DIMENSIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.where(h >> np.uint64(63), np.float32(1), np.float32(-1)).reshape(PLACES, DIMENSIONS)


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """The curve key of each document's ids: hashed counts, scaled to length 1, projected, and cut into 2**BITS steps per dimension."""
    out = [np.empty(0, np.int64)]
    for at in range(0, len(ids), VECTORS):
        part = ids[at : at + VECTORS]
        vectors = np.zeros((len(part), PLACES), np.float32)
        for row, own in zip(vectors, part, strict=True):
            row += np.sqrt(np.bincount(places()[own], minlength=PLACES))
        vectors /= np.maximum(1e-9, np.sqrt((vectors * vectors).sum(1, keepdims=True)))
        spread = np.arctan(vectors @ projection()) / np.pi + 0.5
        out.append(hilbert_keys(np.clip(spread * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)))
    return np.concatenate(out)


@functools.lru_cache(maxsize=1)
def places() -> np.ndarray:
    """The place in the hashed vectors of each 16-bit id."""
    return (mix(np.arange(1 << 16, dtype=np.uint64)) >> np.uint64(54)).astype(np.int16)


def spans(chars: list[str]) -> str:
    """A class of characters for a pattern."""
    code = sorted(map(ord, chars))
    first = [c for i, c in enumerate(code) if not i or code[i - 1] != c - 1]
    last = [c for i, c in enumerate(code) if i + 1 == len(code) or code[i + 1] != c + 1]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(first, last, strict=True))


@functools.lru_cache(maxsize=1)
def patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern, re.Pattern]:
    """Of lower-case text: its pre-tokens, the same for Latin-1 and for ASCII alone; and what texts hold that these don't know."""
    plain = [c for c in map(chr, range(PLAIN)) if len(c.lower()) == 1 and ord(c.lower()) < PLAIN]
    kind = {c: unicodedata.category(c)[0] for c in plain}
    space = {*map(chr, range(0x09, 0x0E)), " ", "\x85", "\xa0"}
    ends = "|".join(ENDINGS)

    def pattern(below: int) -> re.Pattern:
        own = [c for c in plain if ord(c) < below and c not in space]
        letters, numbers, rest = ([c for c in own if (kind[c] if kind[c] in "LN" else "") == k] for k in ("L", "N", ""))
        return re.compile(f"[{spans(letters)}]+|{ends}|[{spans(numbers)}]|[{spans(rest)}]+")

    return pattern(PLAIN), pattern(0x100), pattern(0x80), re.compile(f"[^{spans(plain)}]|{re.escape(SPECIAL)}")


class Memo(dict):
    """A dictionary that gives None for what it doesn't hold, and notes it in ``new``."""

    def __init__(self):
        self.new: set[str] = set()

    def __missing__(self, key: str) -> None:
        self.new.add(key)


class Ids:
    """The ids of whole texts, as unsigned 16-bit numbers, by the tokenizer of a file like word_bpe_49k.json: NFC, lower case, pre-tokens of
    letters, of one number, and of marks, white space dropped.

    Pre-tokens are found here, and their ids remembered, since the tokenizer looks at each by itself.  Parts between spaces that hold any character
    that isn't plain, or what may be a special token, are encoded whole, as they stand.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        # for pre-tokens with spaces between
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: whether an id ends a word
        self.last = np.zeros(1 << 16, bool)
        self.last[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith("</w>")]] = True
        self.known = Memo()

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of a text; for parts that aren't plain a space and the part."""
        every, latin, ascii_, odd = patterns()
        if SPECIAL not in text:
            if text.isascii():
                return ascii_.findall(text.lower())
            try:
                text.encode("latin-1")
                return latin.findall(text.lower())
            except UnicodeEncodeError:
                if not odd.search(text):
                    return every.findall(text.lower())
        out: list[str] = []
        for part in text.replace("\n", " ").split(" "):
            if odd.search(part):
                out.append(" " + part)
            elif part:
                out += every.findall(part.lower())
        return out

    def __call__(self, texts: list[str], last: int) -> list[bytes]:
        known = self.known
        split = [self.pretokens(t) for t in texts]
        found = [list(map(known.__getitem__, parts)) for parts in split]
        new, known.new = known.new, set()
        if len(known) + len(new) > REMEMBERED:
            known.clear()
        made: dict[str, bytes] = {}
        self.encode(sorted(p for p in new if p[0] != " "), made, JOINED)
        self.encode([p for p in new if p[0] == " "], made, 1)
        end = np.array([last], np.uint16).tobytes()
        out = [b"".join([made[p] if x is None else x for p, x in zip(parts, own, strict=True)]) + end for parts, own in zip(split, found, strict=True)]
        known.update((p, x) for p, x in made.items() if len(p) <= LONGEST)
        return out

    def encode(self, names: list[str], made: dict[str, bytes], joined: int) -> None:
        """Puts ids in ``made``; ``joined`` pre-tokens go as one text, whose ids are cut after those that end a word."""
        texts = [" ".join(names[at : at + joined]) for at in range(0, len(names), joined)] if joined > 1 else names
        tokenizer = self.words if joined > 1 else self.tokenizer
        for at in range(0, len(texts), 1024):
            block = texts[at : at + 1024]
            for i, found in enumerate(tokenizer.encode_batch_fast(block, add_special_tokens=False), at):
                ids = np.array(found.ids, np.uint16)
                flat = ids.tobytes()
                if joined == 1:
                    made[names[i]] = flat
                    continue
                own = names[i * joined : (i + 1) * joined]
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) != len(own) or ends[-1] != len(ids):
                    self.encode(own, made, 1)
                    continue
                low = 0
                for name, high in zip(own, (2 * ends).tolist(), strict=True):
                    made[name] = flat[low:high]
                    low = high


@functools.lru_cache(maxsize=1)
def ids_by(path: str) -> Ids:
    return Ids(path)


TOKENS = {"key": pa.int64(), "n": pa.int64(), "ids": pa.binary()}


def tokenized(docs: DataFrame, tokenizer_path: str, text_col: str = "text", last: int = 2, as_: str = "tokens") -> DataFrame:
    """docs with a struct column ``as_``: ``ids`` (unsigned 16-bit, little-endian, ending in ``last``), their number ``n``, the curve ``key``."""

    def worker():
        own = ids_by(tokenizer_path)

        def apply(texts: pa.Array) -> dict:
            _, bounds = text_bytes(texts)
            ids, keys = [], []
            for low, high in slices(bounds):
                part = own([t.as_py() or "" for t in texts[low:high]], last)
                ids += part
                keys.append(curve_keys([np.frombuffer(x, np.uint16) for x in part]))
            return {"key": np.concatenate(keys), "n": np.array([len(x) // 2 for x in ids], np.int64), "ids": pa.array(ids, pa.binary())}

        return apply

    return annotate(docs, F.col(text_col), worker, TOKENS, as_)


def tail(total: int, length: int) -> np.ndarray:
    """Bounds of the sequences after the last full one: powers of two, largest first, so that none needs padding."""
    at = total - total % length
    bounds = [at]
    for b in range(length.bit_length(), -1, -1):
        if (total % length) >> b & 1:
            at += 1 << b
            bounds.append(at)
    return np.array(bounds, np.int64)


PIECES = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}


def pack(docs: DataFrame, tokenizer_path: str, length: int = 4096, last: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PIECES: one row per piece of a document in a sequence; ``ids`` are little-endian unsigned 32-bit numbers.

    Documents are laid end to end in the order of (curve key, id, text order of the input) and cut at every ``length`` ids; the rest is cut
    into powers of two.  So no sequence is padded, each id lies in one piece, and documents that share sequences are near each other on
    the curve.

    Only keys, ids of documents and token counts are range-sorted.  Hot keys (copies) are split by id and row.  Null text
    counts as empty: one piece with the last id alone, as for empty texts.  Rows with equal or null ids are packed each on its own.  Texts of any
    length are cut.  An empty table gives no rows.  Other columns, whatever their names, are not looked at.  ids of documents must be whole numbers.
    """
    spark = docs.sparkSession
    small_batches(spark)
    written = Written(spark, "packing")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(tokenized(slim, tokenizer_path, "text", last).select("doc_id", "tokens.key", "tokens.n", "tokens.ids", F.monotonically_increasing_id().alias("row")))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens before each row in its partition."""
        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.column(1).to_numpy()
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends - n), pa.array(np.full(len(n), part, np.int64)), batch.column(1)], names=["row", "before", "part", "n"])
            at = int(ends[-1]) if len(n) else at

    ordered = rows.select("key", "doc_id", "row", "n").repartitionByRange("key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row").select("row", "n")
    starts = written(ordered.mapInArrow(summed, spark_schema({"row": pa.int64(), "before": pa.int64(), "part": pa.int64(), "n": pa.int64()})))
    # one row per partition
    parts = starts.groupBy("part").agg(F.sum("n").alias("all")).select("part", "all", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("base"))
    parts = written(parts)
    total = parts.agg(F.max(F.col("base") + F.col("all"))).first()[0] or 0
    ends = tail(total, length)
    placed = rows.join(starts.join(parts, "part").select("row", (F.col("before") + F.col("base")).alias("at")), "row").select("doc_id", "n", "ids", "at")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in PIECES]
        for doc, n, ids, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            own = np.frombuffer(ids.as_buffer(), np.uint16).astype("<u4")
            done = 0
            while done < n:
                g = at + done
                if g < ends[0]:
                    seq = g // length
                    low, high = seq * length, (seq + 1) * length
                else:
                    k = int(np.searchsorted(ends, g, "right")) - 1
                    seq, low, high = int(ends[0]) // length + k, int(ends[k]), int(ends[k + 1])
                m = min(n - done, high - g)
                for column, value in zip(out, (doc, done, m, own[done : done + m].tobytes(), n, seq, g - low), strict=True):
                    column.append(value)
                done += m
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, PIECES.values(), strict=True)], names=list(PIECES))

    return map_batches(placed, cut, spark_schema(PIECES)).withColumnRenamed("doc_id", id_col)
