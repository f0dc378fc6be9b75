"""Operator 2: fuzzy line dedup over the whole corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm import wide
from sluice.llm.common import BASE, Written, free_name, hash_spans, map_batches, mix, slices, small_batches, spark_schema, text_bytes, word_spans
from sluice.llm.components import components
from sluice.llm.tiles import grouped

LINES = {"line": pa.int32(), "h1": pa.int64(), "h2": pa.int64()} | dict.fromkeys(wide.COLUMNS, pa.int64())

#: Written tables are read soon and hold hashes, ids and texts, which a dictionary doesn't make smaller.
OPTIONS = {"parquet.compression.codec.zstd.level": "1", "parquet.enable.dictionary": "false"}
#: Lists are gathered by hash for up to so many documents before Spark sorts rows instead (its own figure is 128).
GATHERED = {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": str(1 << 16)}


@dataclass(frozen=True)
class Near:
    """Lines link if their fingerprints of 256 bits share a block of ``width`` bits (``tables`` orders of the bits, each cut into blocks), differ in at
    most ``most_64`` of 64 bits and in at most ``most`` of all, and the edit similarity of their normal forms is ``percent`` of a hundred or more."""

    width: int = 19
    tables: int = 1
    most_64: int = 16
    most: int = 64
    percent: int = 80


def normal(line: str) -> str:
    """Lower case, words (``[^\\x20\\x09-\\x0D]+``) joined by single spaces."""
    return b" ".join(line.lower().encode().split()).decode()


def once(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each entry is the one that stands for all with its owner and hash.

    Each writes its number where a mix of both says, and compares itself with whose number is there; where another one's is, again with the next mix.
    """
    keep = np.zeros(len(h), bool)
    bits = max(4, (4 * len(h)).bit_length())
    table = np.empty(1 << bits, np.int64)
    left = np.arange(len(h))
    mixed = mix(h + owner.astype(np.uint64) * np.uint64(BASE))
    while len(left):
        at = (mixed >> np.uint64(64 - bits)).astype(np.int64)
        table[at] = left
        held = table[at]
        keep[held] = True
        other = np.flatnonzero((h[held] != h[left]) | (owner[held] != owner[left]))
        left, mixed = left[other], mix(mixed[other] + np.uint64(BASE))
    return keep


def lines_of(texts: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """For every line with a word: the text it is in, and LINES: its number there, a 128-bit BLAKE2 digest of its normal form, and the SimHash of
    its different words, so that one that comes again and again, such as a bullet, doesn't decide it."""
    own = [t.lower().encode() for t in texts]
    whole = b"\n".join(own)
    raw = np.frombuffer(whole, np.uint8)
    ends = np.append(np.flatnonzero(raw == 0x0A), len(raw))
    low = np.concatenate(([0], ends[:-1] + 1))
    start, end, _ = word_spans(raw, np.array([0, len(raw)]))
    words = np.diff(np.searchsorted(start, np.append(low, len(raw) + 1)))
    some = np.flatnonzero(words)
    if not len(some):
        empty = np.empty(0, np.int64)
        return empty, {"line": empty.astype(np.int32)} | dict.fromkeys(list(LINES)[1:], empty)
    low, ends, words = low[some], ends[some], words[some]
    bounds = np.concatenate(([0], np.cumsum(words)))
    top = np.cumsum([0] + [len(x) + 1 for x in own[:-1]])
    text = np.searchsorted(top, low, "right") - 1
    newlines = np.concatenate(([0], np.cumsum([x.count(b"\n") + 1 for x in own[:-1]], dtype=np.int64)))
    # a line is its normal form if all its white space is one 0x20 between two words
    changed = ends - low != np.add.reduceat(end - start, bounds[:-1]) + words - 1
    tabs = np.flatnonzero((raw >= 0x09) & (raw <= 0x0D) & (raw != 0x0A))
    changed |= np.searchsorted(tabs, low) != np.searchsorted(tabs, ends)
    normals = [whole[a:b] for a, b in zip(low.tolist(), ends.tolist(), strict=True)]
    for i in np.flatnonzero(changed).tolist():
        normals[i] = b" ".join(normals[i].split())
    digests = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in normals]), np.int64).reshape(-1, 2)
    h, line = hash_spans(raw, start, end), np.repeat(np.arange(len(some)), words)
    keep = once(line, h)
    prints = wide.majority(h[keep], np.searchsorted(line[keep], np.arange(len(some) + 1))).view(np.int64)
    return text, {"line": (some - newlines[text]).astype(np.int32), "h1": digests[:, 0], "h2": digests[:, 1]} | {k: prints[:, i] for i, k in enumerate(wide.COLUMNS)}


#: Characters after which :func:`within` looks whether too many edits are needed already.
CHUNK = 32


def within(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` insertions, deletions and substitutions of characters make b of a: Myers' bit vectors on what differs."""
    if abs(len(a) - len(b)) > most:
        return False
    if a == b:
        return True
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return max(len(a), len(b)) <= most
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    full = (1 << m) - 1
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    up, down = full, 0  # bits above m never come down; up has none
    for k in range(0, n, CHUNK):
        for eq in [where.get(c, 0) for c in b[k : k + CHUNK]]:
            eq |= down
            across = (((eq & up) + up) ^ up) | eq
            plus = (down | (full & ~(across | up))) << 1 | 1
            down = plus & across
            up = full & ((up & across) << 1 | ~(plus | across))
        read = min(n, k + CHUNK)
        distance = read + up.bit_count() - (down & full).bit_count()
        if distance - (n - read) > most:
            return False
    return distance <= most


#: How many words ahead :func:`at_most` looks for the next common one.
AHEAD = 6


def at_most(x: list[str], y: list[str], enough: int) -> int:
    """A number of edits that makes the words y of x (with a space between any two), not always the least: words in common are walked through, what differs between two counts by its longer side;
    over ``enough`` if that is over it."""
    i = j = edits = 0
    n, m = len(x), len(y)
    while i < n and j < m:
        if x[i] == y[j]:
            i += 1
            j += 1
            continue
        found = -1
        for far in range(1, AHEAD + 1):
            for k in range(max(0, far - m + j + 1), min(far + 1, n - i)):
                if x[i + k] == y[j + far - k]:
                    found = k
                    break
            if found >= 0:
                break
        else:
            found = min(AHEAD // 2, n - i, m - j)
            far = 2 * found
        left, right = x[i : i + found], y[j : j + far - found]
        i, j = i + found, j + far - found
        edits += max(sum(map(len, left)) + len(left), sum(map(len, right)) + len(right))
        if edits > enough:
            return edits
    left, right = x[i:], y[j:]
    return edits + max(sum(map(len, left)) + len(left), sum(map(len, right)) + len(right))


def similar(a: str, b: str, percent: int) -> bool:
    """Whether 1 - edits / characters of the longer is at least ``percent`` of a hundred."""
    most = max(len(a), len(b)) * (100 - percent) // 100
    return abs(len(a) - len(b)) <= most and (at_most(a.split(" "), b.split(" "), most) <= most or within(a, b, most))


def counts(lines: list[str], kinds: int = 128) -> np.ndarray:
    """How often each line has each kind of two characters on end; an edit changes at most two in either line."""
    out = np.zeros((len(lines), kinds), np.int32)
    for i, x in enumerate(lines):
        c = np.frombuffer(x.encode("utf-32-le"), np.uint32)
        out[i] = np.bincount((c[1:] * np.uint32(31) + c[:-1]) % kinds, minlength=kinds)
    return out


def alike(texts: list[str], prints: np.ndarray, near: Near) -> Iterator[np.ndarray]:
    """The connected groups (of two and more) of texts with near ``prints`` that are :func:`similar`, as lists of positions."""
    size = np.array([len(x) for x in texts])
    words: dict[int, list[str]] = {}
    pairs: dict[int, np.ndarray] = {}

    def split(i: int) -> list[str]:
        if i not in words:
            words[i] = texts[i].split(" ")
        return words[i]

    def kinds(i: int) -> np.ndarray:
        if i not in pairs:
            pairs[i] = counts([texts[i]])[0]
        return pairs[i]

    def most(i: int, others: np.ndarray) -> np.ndarray:
        return np.maximum(size[others], size[i]) * (100 - near.percent) // 100

    def surely(i: int, others: np.ndarray) -> np.ndarray:
        own = most(i, others)
        out = np.abs(size[others] - size[i]) <= own
        for k in np.flatnonzero(out).tolist():
            out[k] = at_most(split(i), split(int(others[k])), enough := int(own[k])) <= enough
        return out

    # groups by links that the bound over words accepts; then what else links these
    found = list(wide.walk(prints, near.most, surely))
    label = np.arange(len(texts))
    for group in found:
        label[group] = group[0]
    members = dict(zip(range(len(texts)), np.arange(len(texts)).reshape(-1, 1), strict=True)) | {int(g[0]): g for g in found}
    left = np.arange(len(texts))
    while len(left):
        group = [members[int(label[left[0]])]]
        left = left[label[left] != label[left[0]]]
        queue = group[0].tolist()
        while queue and len(left):
            i = queue.pop()
            close = left[np.bitwise_count(prints[left] ^ prints[i]).sum(1, dtype=np.int64) <= near.most]
            own = most(i, close)
            fits = np.abs(size[close] - size[i]) <= own
            gone: set[int] = set()
            for j, enough in zip(close[fits].tolist(), own[fits].tolist(), strict=True):
                other = int(label[j])
                if other not in gone and np.abs(kinds(j) - kinds(i)).sum() <= 4 * enough and within(texts[i], texts[j], enough):
                    gone.add(other)
                    group.append(members[other])
                    queue.extend(members[other].tolist())
            if gone:
                left = left[~np.isin(label[left], list(gone))]
        if len(whole := np.concatenate(group)) > 1:
            yield whole


def occurrences_of(slim: DataFrame) -> DataFrame:
    """(id, row, *LINES) of all lines with a word of slim (id, row, text)."""

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, own, texts = batch.columns
        _, bounds = text_bytes(texts)
        rows, parts = [], []
        for low, high in slices(bounds):
            text, made = lines_of([t.as_py() or "" for t in texts[low:high]])
            rows.append(text + low)
            parts.append(made)
        at = pa.array(np.concatenate(rows))
        arrays = [ids.take(at), own.take(at), *(pa.array(np.concatenate([p[k] for p in parts]), kind) for k, kind in LINES.items())]
        return pa.RecordBatch.from_arrays(arrays, names=["id", "row", *LINES])

    return map_batches(slim, split, T.StructType([slim.schema["id"], slim.schema["row"], *spark_schema(LINES).fields]))


def edges_of(slim: DataFrame, lines: DataFrame, near: Near, written: Written) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) between the nodes of ``lines`` (node, id, row, line, *wide.COLUMNS: different lines, each with some occurrence) whose closure is that of
    all links of ``near``, and the rows of ``lines`` that may have any.

    ``slim``: (row, of, text), in buckets by row and of, :func:`of` the id."""
    small_batches(slim.sparkSession)
    found = wide.groups(lines.select("node", *wide.COLUMNS), written, near.width, near.tables, near.most_64)
    wanted = written(lines.join(found.select("node").distinct().hint("shuffle_hash"), "node", "left_semi"))
    place = F.struct("node", "line", *wide.COLUMNS)
    asked = written(wanted.groupBy("row", of("id").alias("of")).agg(F.collect_list(place).alias("asked")))
    schema = {"node": pa.int64(), "text": pa.string()} | dict.fromkeys(wide.COLUMNS, pa.int64())

    def fetch(batch: pa.RecordBatch) -> pa.RecordBatch:
        asked = batch.column(1)
        n = np.diff(asked.offsets.to_numpy())
        flat = asked.flatten()
        numbers, texts = iter(flat.field("line").to_pylist()), []
        for text, k in zip(batch.column(0), n.tolist(), strict=True):
            parts = (text.as_py() or "").split("\n")
            texts += [normal(parts[next(numbers)]) for _ in range(k)]
        columns = {"node": flat.field("node"), "text": pa.array(texts, pa.string())} | {k: flat.field(k) for k in wide.COLUMNS}
        return pa.RecordBatch.from_arrays([columns[k] for k in schema], names=list(schema))

    # the texts stream by what is asked of their bucket, so they need no sort
    matched = slim.join(asked.hint("shuffle_hash"), ["row", "of"]).select("text", "asked")
    # rows with one id and one text give their lines again
    texts = map_batches(matched, fetch, spark_schema(schema)).dropDuplicates(["node"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, 1):
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            prints = wide.prints_in(batch, 3)
            out: list[list[np.ndarray]] = [[], []]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            last = np.append(first[1:], len(key))
            pair = first[last - first == 2]
            pair = pair[np.bitwise_count(prints[pair] ^ prints[pair + 1]).sum(1) <= near.most]
            texts = batch.column(2)
            two = zip(texts.take(pa.array(pair)).to_pylist(), texts.take(pa.array(pair + 1)).to_pylist(), strict=True)
            pair = pair[np.fromiter((similar(a, b, near.percent) for a, b in two), bool, len(pair))]
            if len(pair):
                out[0].append(node[pair])
                out[1].append(node[pair + 1])
            for low, high in zip(first[last - first > 2].tolist(), last[last - first > 2].tolist(), strict=True):
                for g in alike(texts.slice(low, high - low).to_pylist(), prints[low:high], near):
                    out[0].append(node[low + g[:-1]])
                    out[1].append(node[low + g[1:]])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["a", "b"])

    rows = found.join(texts, "node").select("key", "node", "text", *wide.COLUMNS)
    linked = rows.repartition("key").sortWithinPartitions("key").mapInArrow(verify, spark_schema({"a": pa.int64(), "b": pa.int64()}))
    return written(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), wanted


def gone_of(occurrences: DataFrame, lines: DataFrame, edges: DataFrame, wanted: DataFrame, written: Written) -> DataFrame:
    """(id, row, line): all occurrences but the first of each connected group, which is a line with its copies or holds different lines."""
    marked = lines.where("n > 1")
    if not edges.isEmpty():
        labels = components(edges, written)
        alone = marked.join(labels, "node", "left_anti").select("h1", "h2", F.col("node").alias("label"))
        marked = alone.union(wanted.join(labels, "node").select("h1", "h2", "label"))
    else:
        marked = marked.select("h1", "h2", F.col("node").alias("label"))
    members = written(occurrences.select("id", "row", "line", "h1", "h2").join(written(marked).hint("shuffle_hash"), ["h1", "h2"]).select("label", "id", "row", "line"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "line")
    tops = written(members.groupBy("label").agg(F.min(place).alias("first")))
    return members.join(tops, "label").where(place != F.col("first")).select("id", "row", "line")


def of(id_col: str) -> Column:
    """A hash of the id, never null; with the row (:func:`numbered`) it tells documents apart, by 128 bits."""
    return F.xxhash64(F.col(id_col))


def numbered(docs: DataFrame, id_col: str, text_col: str, as_: str, written: Written) -> DataFrame:
    """docs with a long ``as_``: a hash of the text; for rows with a null id a number, written once, that no other such row has."""
    known = docs.where(F.col(id_col).isNotNull()).withColumn(as_, F.xxhash64(text_col))
    unknown = docs.where(F.col(id_col).isNull())
    if unknown.isEmpty():
        return known
    return known.union(written(unknown.withColumn(as_, F.monotonically_increasing_id())))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: Near = Near(), as_: str = "lines") -> DataFrame:
    """docs with the texts' repeated lines taken out, columns unchanged but for ``text_col``, and a struct column ``as_``: ``n`` lines before
    (split at \\n; null text: 0), ``kept`` lines after.

    Lines link if their normal forms (:func:`normal`) are equal, or if they are near and similar as :class:`Near` says.  Of each connected group over the
    whole corpus one occurrence stays: that with the smallest id, then the first in its text.  Lines without a word always stay.

    Copies count once from the first shuffle on; links are searched among different lines only, by block keys; texts of lines are fetched
    for those with a near fingerprint.  Texts are shuffled once, into a bucketed copy of docs that both joins with it read in place.  Null text stays null, empty stays empty.  Rows with one id and one text count as one document, so each keeps
    the same lines; rows with one id and different texts (by 64 bits of hash) are documents of their own, in the order of the hashes.  So are all rows with a
    null id, which are written with their numbers first; null is the last id.  Other columns are carried along whatever their names (``as_`` must be new).  An empty
    table stays empty.
    """
    if as_ in docs.columns:
        raise ValueError(f"column {as_} exists")
    written = Written(docs.sparkSession, "lines", OPTIONS, GATHERED)
    row, id_hash, drop = (free_name(docs.columns, x) for x in ("row", "of", "gone"))
    columns, void = docs.columns, [c for c, kind in docs.dtypes if kind == "void"]  # these can't be written
    docs = numbered(docs, id_col, text_col, row, written).withColumn(id_hash, of(id_col)).drop(*void)
    docs = written.bucketed(docs, row, id_hash)
    occurrences = written(occurrences_of(docs.select(F.col(id_col).alias("id"), F.col(row).alias("row"), F.col(text_col).alias("text"))))
    slim = docs.select(F.col(row).alias("row"), F.col(id_hash).alias("of"), F.col(text_col).alias("text"))
    # of each different line some occurrence, from one row as all are aggregated alike; no least one, so that fixed-width ids are aggregated by hash
    some = [F.first(k).alias(k) for k in ("id", "row", "line")]
    lines = occurrences.groupBy("h1", "h2").agg(*some, F.count(F.lit(1)).alias("n"), *(F.min(k).alias(k) for k in wide.COLUMNS))
    lines = written(lines.withColumn("node", F.monotonically_increasing_id()))
    gone = gone_of(occurrences, lines, *edges_of(slim, lines, near, written), written)
    gone = written(gone.groupBy(F.col("row").alias(row), of("id").alias(id_hash)).agg(F.collect_set("line").alias(drop)))
    written.drop_but(docs, gone)
    joined = docs.join(gone.hint("shuffle_hash"), [row, id_hash], "left").drop(row, id_hash).withColumns({c: F.lit(None) for c in void})
    return _with_lines(joined, columns, text_col, drop, as_)


def _with_lines(joined: DataFrame, columns: list[str], text_col: str, drop: str, as_: str) -> DataFrame:
    text, gone = F.col(text_col), F.col(drop)
    some = gone.isNotNull()
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    newlines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    n = F.when(text.isNull(), 0).otherwise(F.coalesce(newlines, F.lit(0)) + 1).cast("long")
    kept = n - F.when(some, F.size(gone)).otherwise(0)
    news = {c: F.when(some, left).otherwise(text) if c == text_col else F.col(c) for c in columns}
    return joined.select(*(v.alias(k) for k, v in news.items()), F.struct(n.alias("n"), kept.alias("kept")).alias(as_))


def keep_new_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`dedup_lines`, columns unchanged, without the documents that it leaves without a word though they had one."""
    name = free_name(docs.columns, "lines")
    out = dedup_lines(docs, id_col, text_col, as_=name)
    emptied = (F.col(f"{name}.kept") < F.col(f"{name}.n")) & ~F.col(text_col).rlike("[^\\x20\\x09-\\x0D]")
    return out.where(~F.coalesce(emptied, F.lit(False))).drop(name)
