"""Operator 3: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import SPACE, annotate, crc32_of, free_name, hash_spans, mix, slices, text_bytes

FIELDS = {"score": pa.float64()}

#: Classes of bytes: 0 white space, 1 letters (A-Z, a-z and all beyond ASCII), 2 digits, 3 other.
_KIND = np.full(256, 3, np.uint8)
_KIND[0x80:] = 1
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[SPACE] = 0


#: The hash of a pair that repeats a feature.
AGAIN = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Settings:
    """``max_rows``: the most labelled ids that training reads, half of each class at most; those with the lowest hashes are
    taken.  Features: runs of letters, of digits or of other characters, alone and in pairs, hashed to 2**bits places; a text's
    value at a place is its share of the text's features times ``scale``."""

    bits: int = 18
    max_rows: int = 6000
    epochs: int = 2
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    scale: float = 64.0


def features(raw: np.ndarray, bounds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all n-grams of the texts between ``bounds``, text by text, and n + 1 bounds of each text's."""
    kind = _KIND[raw]
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[bounds] = True
    cut = np.flatnonzero(edge)
    start, end = cut[:-1], cut[1:]
    ink = kind[start] > 0 if len(start) else np.empty(0, bool)
    start, end = start[ink], end[ink]
    at = np.searchsorted(start, bounds)
    one = hash_spans(raw, start, end)
    n = np.diff(at)
    # of each text first all single ones, then its pairs
    pairs = np.maximum(n - 1, 0)
    to = np.concatenate(([0], np.cumsum(n + pairs)))
    out = np.empty(to[-1], np.uint64)
    text = np.repeat(np.arange(len(n)), n)
    local = np.arange(len(one)) - at[text]
    out[to[text] + local] = one
    inner = np.flatnonzero(local[1:] > 0)
    two = mix(one[inner] * np.uint64(3) + (one[inner + 1] ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    # whatever is said again at once, or after one other, makes one and the same n-gram
    two[one[inner] == one[inner + 1]] = AGAIN
    third = np.minimum(inner + 2, len(one) - 1)
    two[(one[inner] == one[third]) & (third > inner + 1) & (text[inner] == text[third])] = AGAIN + np.uint64(1)
    out[to[text[inner]] + n[text[inner]] + local[inner]] = two
    return (out & np.uint64((1 << bits) - 1)).astype(np.int64), to


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias after FTRL-proximal updates over (places, values) of each example, in the order given; no examples: all 0."""
    z, n, w = np.zeros((1 << s.bits) + 1), np.zeros((1 << s.bits) + 1), np.zeros((1 << s.bits) + 1)
    for _ in range(s.epochs):
        for (places, values), y in zip(examples, labels, strict=True):
            i, x = np.append(places, 1 << s.bits), np.append(values, 1.0)
            zi, ni = z[i], n[i]
            own = np.where(np.abs(zi) <= s.l1, 0.0, -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2))
            g = (_sigmoid(own @ x) - y) * x
            more = ni + g * g
            z[i] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / s.alpha * own
            n[i] = more
    w = np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))
    return w[:-1], float(w[-1])


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def sample(docs: DataFrame, labels: DataFrame, s: Settings, id_col: str, text_col: str, label_col: str) -> list[tuple[bytes, int]]:
    """At most s.max_rows (text, label), in an order that depends on rows alone; ids whose crc32 leaves 1 modulo 3 are never among them."""
    named = labels.where(crc32_of(F.col(id_col)) % 3 != 1).where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null")
    picked = None
    for y in (0, 1):
        half = named.where(F.col("y") == y).distinct().orderBy(F.xxhash64("id"), "id").limit(s.max_rows // 2)
        picked = half if picked is None else picked.union(half)
    # s.max_rows ids and labels at most
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    found = found.withColumn("h", F.xxhash64("id", "text")).orderBy("h", "id", "y").limit(2 * s.max_rows)
    return [((r.text or "").encode(), r.y) for r in found.select("text", "y").collect()]


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float]:
    """Weights and bias.  Labels other than 0 and 1 and null ids are left out; no labelled text: weights 0, so that every score is 0.5."""
    rows = sample(docs, labels, settings, id_col, text_col, label_col)
    examples = []
    for text, _ in rows:
        places, _ = features(np.frombuffer(text, np.uint8), np.array([0, len(text)]), settings.bits)
        values, counts = np.unique(places, return_counts=True)
        examples.append((values, counts * (settings.scale / max(1, len(places)))))
    return train(examples, np.array([y for _, y in rows]), settings)


def score(docs: DataFrame, model: tuple[np.ndarray, float], settings: Settings = Settings(), text_col: str = "text", as_: str = "quality") -> DataFrame:
    """docs, columns unchanged, with a struct column ``as_`` of ``score`` (0 to 1), row by row, without a shuffle: the sparse dot product of each
    whole text's n-grams with the weights.

    Null and empty texts get the score of no features, by the bias alone.  Only the text is looked at, so repeated rows get equal
    scores; other columns are carried along whatever their names.  The weights, 2**bits doubles at any input size, are broadcast.
    """
    weights = docs.sparkSession.sparkContext.broadcast(model[0].astype(np.float32))
    bias = model[1]

    def worker():
        def apply(texts: pa.Array) -> dict:
            raw, bounds = text_bytes(texts)
            out = np.full(len(texts), bias)
            for low, high in slices(bounds):
                places, to = features(raw[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low], settings.bits)
                total = np.concatenate(([0.0], np.cumsum(weights.value[places], dtype=np.float64)))
                n = np.diff(to)
                out[low:high] += (total[to[1:]] - total[to[:-1]]) * (settings.scale / np.maximum(n, 1))
            return {"score": _sigmoid(out)}

        return apply

    return annotate(docs, F.col(text_col), worker, FIELDS, as_)


def keep_better(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with a score of at least ``threshold``, columns unchanged."""
    name = free_name(docs.columns, "quality")
    model = fit(docs, labels, settings, id_col, text_col)
    return score(docs, model, settings, text_col, name).where(F.col(f"{name}.score") >= threshold).drop(name)
