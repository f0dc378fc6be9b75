"""The operators on Spark: brute force, edge cases, and the registered queries against the contract."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import byte_bpe, chat, classifier, line_dedup, nearest, packing, quality_rules, registry, simhash, token_counts, url_filter, wide
from sluice.llm.common import Written, hash_spans, mix, prefix_sums, span_hashes, word_spans
from sluice.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in any column, empty and long texts, repeated rows, equal ids.
ODD = [
    (1, "One plain line of text that is long enough to have many words in it, and so on.\nAnd another one.", "en", "s", 9),
    (2, None, None, None, None),
    (3, "", "en", "s", 0),
    (4, " \n\t ", "en", "s", 4),
    (5, "x" * 30000, "en", "s", 1),
    (6, "word " * 8000, "en", "s", 1),
    (None, "a text without an id", "en", "s", 1),
    (7, "repeated row", "en", "s", 1),
    (7, "repeated row", "en", "s", 1),
    (8, "REPEATED  row", "en", "s", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def texts():
    return dict(zip(*[c.to_pylist() for c in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).columns], strict=True))


def clashing(df):
    """With further columns whose names the operators use inside."""
    return df.selectExpr("*", "1 AS id", "'x' AS `print`", "2 AS label", "3 AS rules", "4 AS quality", "5 AS lines", "6 AS tokens", "7 AS kept_id", "8 AS gone", "9 AS `of`")


def groups_of(pairs, nodes):
    label = {n: n for n in nodes}

    def top(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        label[y] = x
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(200 + i, 201 + i) for i in range(40)]
    df = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    got = {r.node: r.label for r in components(df, Written(spark, "t")).collect()}
    want = groups_of(pairs, {x for p in pairs for x in p})
    assert got.keys() == want.keys()
    assert len({(got[n], want[n]) for n in want}) == len(set(want.values())) == len(set(got.values()))
    assert components(df.where("false"), Written(spark, "t")).count() == 0


def test_simhash(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(60)) for _ in range(4)]
    rows = []
    for b in base:
        for _ in range(12):
            w = b.split()
            w[rng.randrange(len(w))] = "changed"
            rows.append(" ".join(w))
    rows += [base[0]] * 5 + ["", None, "one two"]
    df = clashing(spark.createDataFrame(list(enumerate(rows, 10)), "doc_id long, text string"))
    got = {r.doc_id: (r["print"] & (2**64 - 1), r.component_id) for r in simhash.near_groups(df).collect()}
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in enumerate(rows, 10)}
    links = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 4]
    want = groups_of(links, prints)
    assert got == {i: (prints[i], want[i]) for i in prints}
    kept = {r.doc_id for r in simhash.keep_one(df, words=4).collect()}
    assert kept == set(groups_of(document_links(dict(enumerate(rows, 10)), 4), prints).values())


def document_links(texts, words=5, near=simhash.Near()):
    """All links of documents by comparing every two, as the docstring of Near defines them."""
    prints, hashes = {}, {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        k = min(words, len(w))
        own = [" ".join(w[i : i + k]).encode() for i in range(len(w) - k + 1)] if w else []
        for x in own:
            if x not in hashes:
                raw = np.frombuffer(x, np.uint8)
                start, end, _ = word_spans(raw, np.array([0, len(raw)]))
                hashes[x] = span_hashes(prefix_sums(hash_spans(raw, start, end)), np.array([0]), np.array([len(start)]))[0]
        ones = np.zeros(256, int)
        for x in own:
            ones += np.unpackbits(mix(hashes[x] ^ wide.SEEDS).view(np.uint8), bitorder="little")
        prints[d] = np.packbits(2 * ones > len(own), bitorder="little").view(np.uint64)
    keys = {d: wide.block_keys(p[None], near.width, near.tables)[0] for d, p in prints.items()}
    word = wide.weights(near.width, near.tables)[1]

    def linked(a, b):
        differ = np.bitwise_count(prints[a] ^ prints[b])
        return differ.sum() <= near.most and ((keys[a] == keys[b]) & (differ[word] <= near.most_64)).any()

    return [(a, b) for a in prints for b in prints if a < b and linked(a, b)]


def test_simhash_odd(spark, docs):
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(ODD)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.component_id)
    assert by[2] == by[3] == by[4] == {2} and by[7] == by[8] == {7} and by[None] == {None}
    kept = sorted((r.doc_id for r in simhash.keep_one(docs).collect()), key=str)
    assert kept == sorted([1, 2, 5, 6, None, 7], key=str)
    rows = [(7, "a b c d e f"), (7, "g h i j k l"), (None, "m n o p q r"), (None, "m n o p q r"), (None, "a b c d e f"), (3, "g h i j k l")]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted([(3, "g h i j k l"), (7, "a b c d e f"), (None, "m n o p q r")], key=str)
    assert simhash.keep_one(docs).columns == docs.columns
    assert simhash.near_groups(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    from sluice.llm import tiles

    monkeypatch.setattr(tiles, "TILE", 8)
    rng = random.Random(3)
    center = rng.getrandbits(62)
    prints = sorted({center ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for _ in range(60)})
    written = Written(spark, "t")
    table = written(spark.createDataFrame([(x,) for x in prints], "print long"))
    labels = {r.node: r.label for r in components(tiles.paths(table, written), written).collect()}
    want = groups_of([(a, b) for a in prints for b in prints if a < b and bin(a ^ b).count("1") <= 4], prints)
    assert len(set(labels.values())) == len({v for v in want.values() if list(want.values()).count(v) > 1})


def line_links(names, near=line_dedup.Near()):
    """All links of lines by comparing every two, as the docstring of Near defines them."""
    prints = {x: np.array([line_dedup.lines_of([x])[1][k][0] for k in wide.COLUMNS]).view(np.uint64) for x in names}
    keys = {x: wide.block_keys(p[None], near.width, near.tables)[0] for x, p in prints.items()}
    word = wide.weights(near.width, near.tables)[1]

    def linked(a, b):
        differ = np.bitwise_count(prints[a] ^ prints[b])
        met = (keys[a] == keys[b]) & (differ[word] <= near.most_64)
        return met.any() and differ.sum() <= near.most and line_dedup.similar(a, b, near.percent)

    return [(a, b) for a in names for b in names if a < b and linked(a, b)]


def brute_lines(rows):
    """Kept (row, line) by comparing every two lines."""
    lines = [(i, j, line_dedup.normal(x)) for i, (_, t, *_) in enumerate(rows) for j, x in enumerate((t or "").split("\n")) if x.split()]
    names = list({x for _, _, x in lines})
    links = line_links(names)
    group = groups_of(links, names)
    first = {}
    for i, j, x in lines:
        key = (rows[i][0] is None, rows[i][0] or 0, j)
        first[group[x]] = min(first.get(group[x], key), key)
    kept = {(i, j) for i, j, x in lines if (rows[i][0] is None, rows[i][0] or 0, j) == first[group[x]]}
    return kept, {(i, j) for i, j, _ in lines}


def test_line_dedup(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))) for _ in range(25)]
    for x in lines[:12]:
        w = x.split()
        w[rng.randrange(len(w))] = "zzz"
        lines.append(" ".join(w).upper())
    rows = [(i, "\n".join(rng.choice([*lines, "", "  "]) for _ in range(rng.randint(1, 8))), "en", "s", 1) for i in range(40)] + [r for r in ODD if r[0] != 7 or r[1] != "repeated row"] + [ODD[7]]
    rows = [(r[0] if i < 40 or r[0] is None else r[0] + 100, *r[1:]) for i, r in enumerate(rows)]
    out = line_dedup.dedup_lines(clashing(spark.createDataFrame(rows, DOCS)).drop("lines"), as_="lines_")
    got = {(r.doc_id, r.text, r.lines_.n, r.lines_.kept) for r in out.collect()}
    kept, eligible = brute_lines(rows)
    want = set()
    for i, (d, t, *_) in enumerate(rows):
        parts = t.split("\n") if t is not None else []
        left = [x for j, x in enumerate(parts) if (i, j) in kept or (i, j) not in eligible]
        want.add((d, "\n".join(left) if t is not None else None, len(parts), len(left)))
    assert got == want


def test_line_dedup_odd(spark, docs):
    out = line_dedup.keep_new_lines(docs)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    # rows with one id keep the same lines; the same line under a larger id goes, and its document with it
    assert got.count((7, "repeated row")) == 2 and 8 not in {i for i, _ in got}
    assert (2, None) in got and (3, "") in got and (4, " \n\t ") in got and (None, "a text without an id") in got
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_by_edits(spark):
    """Lines with one or two changed words, from 20 to 40 words: links by edit similarity alone that the blocks find, and the lines kept."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    lines = []
    for n in (20, 30, 40) * 20:
        parts = [word() for _ in range(n)]
        other = list(parts)
        for _ in range(1 if n < 40 else 2):
            other[rng.randrange(n)] = word()
        lines += [" ".join(parts), " ".join(other)]
    every = [(a, b) for a, b in zip(lines[::2], lines[1::2], strict=True) if a != b and line_dedup.similar(a, b, 80)]
    found = line_links(lines)
    assert len(found) >= 0.75 * len(every)
    group = groups_of(found, lines)
    first = {}
    for i, x in enumerate(lines):
        first.setdefault(group[x], i)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.dedup_lines(df).collect() if r.lines.kept} == set(first.values())


def exchanges(df):
    """The nodes of a query's plan that move rows."""
    return re.findall(r"(?m)Exchange .*$", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture
def tables(spark, monkeypatch):
    """Where operators write, as lists of the tables that are there; joins broadcast next to nothing."""
    made = []
    monkeypatch.setattr(Written, "__init__", lambda self, *a, f=Written.__init__: (f(self, *a), made.append(self.path.removeprefix("file:")))[0])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    yield lambda: [sorted(x.name for x in Path(path).iterdir()) for path in made]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_line_dedup_moves_texts_once(spark, tables):
    """The result reads a bucketed copy of the documents where it lies, and no other table but that of removed lines is left."""
    rng = random.Random(6)
    lines = [" ".join(str(rng.getrandbits(40)) for _ in range(8)) for _ in range(1500)]
    rows = [(i if i % 100 else None, "\n".join((x, rng.choice(lines[:300])))) for i, x in enumerate(lines, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"none": F.lit(None), "of": F.lit("of")})
    out = line_dedup.dedup_lines(df)
    assert "Bucketed: true" in out._jdf.queryExecution().executedPlan().toString()
    assert len(exchanges(out)) == 1 and len(tables()[0]) == 2 and not spark.catalog.listTables()
    got = out.collect()
    kept, _ = brute_lines(rows)
    want = {(d, "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) in kept)) for i, (d, t) in enumerate(rows)}
    assert len(got) == len(rows) and {(r.doc_id, r.text) for r in got} == want
    assert out.columns == [*df.columns, "lines"] and all((r["none"], r.of) == (None, "of") for r in got)


def test_line_dedup_sorts_no_texts(spark, tables, monkeypatch):
    """Texts meet what is asked of them, and removed lines, by hash; different lines with ids of a fixed width are gathered by hash; settings are as before."""
    plans = []
    monkeypatch.setattr(Written, "__call__", lambda self, df, f=Written.__call__: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(self, df))
    before = {r.key: r.value for r in spark.sql("SET").collect()}
    rows = [(i, f"line {i // 2} of these\nanother {i} line") for i in range(300)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    result = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in result and not re.search(r"\bSort\b|SortMergeJoin", result)
    own = [x for x in plans if "keys=[h1#" in x]
    assert len(own) == 1 and "HashAggregate(keys=[h1#" in own[0] and "SortAggregate" not in own[0]
    assert {r.key: r.value for r in spark.sql("SET").collect()}.items() - before.items() <= {("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))}
    kept, _ = brute_lines(rows)
    want = {(i, "\n".join(left), 2, len(left)) for i, t in rows for left in [[x for j, x in enumerate(t.split("\n")) if (i, j) in kept]]}
    assert {(r.doc_id, r.text, r.lines.n, r.lines.kept) for r in out.collect()} == want


def test_keep_one_moves_no_texts(spark, tables):
    """Where few documents go, all others stay where they are; no other table but that of the documents and of those that go is left."""
    rng = random.Random(9)
    texts = [" ".join(str(rng.getrandbits(40)) for _ in range(12)) for _ in range(6000)]
    df = spark.createDataFrame([*enumerate(texts), (6000, texts[5])], "doc_id long, text string")
    out = simhash.keep_one(df)
    assert not [x for x in exchanges(out) if "Broadcast" not in x] and len(tables()[0]) == 2
    assert {r.doc_id for r in out.collect()} == set(range(6000))


def test_line_digests():
    """Words that polynomial hashes modulo 2**64 don't tell apart make different lines."""
    a = "ab"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    _, made = line_dedup.lines_of([a, a.translate(str.maketrans("ab", "ba"))])
    assert len(set(made["h1"].tolist())) == len(set(made["h2"].tolist())) == 2


def test_wide_tiles(spark, monkeypatch):
    """Keys dealt out as tiles give the groups of brute force."""
    monkeypatch.setattr(wide, "TILE", 40)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, (3, 4))
    prints = np.concatenate([base.repeat([400, 30, 1], axis=0) ^ (1 << rng.integers(0, 62, (431, 4))), rng.integers(0, 1 << 62, (300, 4))])
    written = Written(spark, "test")
    df = written(spark.createDataFrame([(i, *map(int, p)) for i, p in enumerate(prints)], "node long, p0 long, p1 long, p2 long, p3 long"))
    found = wide.groups(df, written, 19, 1, 16).toPandas()
    sizes = found.groupby("key").size()
    assert sizes.min() > 1 and sizes.max() <= 200
    keys, differ = wide.block_keys(prints.view(np.uint64), 19, 1), np.bitwise_count(prints[:, None] ^ prints[None])
    met = ((keys[:, None] == keys[None]) & (differ[:, :, wide.weights(19, 1)[1]] <= 16)).any(2)
    links = [(i, j) for i in range(len(prints)) for j in range(i) if met[i, j]]
    paths = [(g[0], x) for g in found.groupby("key").node.apply(list) for x in g]
    want, got = groups_of(links, range(len(prints))), groups_of(paths, range(len(prints)))
    assert {frozenset(k for k in want if want[k] == v) for v in want.values()} == {frozenset(k for k in got if got[k] == v) for v in got.values()}


def test_line_dedup_rows_of_one_id(spark):
    """Rows with one id, or none, lose no line that is nowhere else; of copies without an id one stays."""
    rows = [(1, "x"), (None, "x\nu"), (None, "v\nw"), (None, "same"), (None, "same"), (7, "x\na b"), (7, "c d\nx"), (7, "c d\nx")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((str(r.doc_id), r.text) for r in out.collect())
    assert got == sorted([("1", "x"), ("None", "u"), ("None", "v\nw"), ("None", "same"), ("None", ""), ("7", "a b"), ("7", "c d"), ("7", "c d")])


def test_chat(spark):
    rows = [(1, 0, "system", "[NEXT] \\ <s>"), (1, 2, "user", None), (1, 1, "user", "hi <"), (1, 3, "assistant", "a[/INST]"), (1, 4, "assistant", ""), (1, 4, "assistant", ""), (1, 5, None, "\\["), (1, None, "user", "first"), (2, 0, "assistant", "é🎉" * 3000), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS id", "2 AS turns", "3 AS formatted")
    chats = chat.format_chats(df)
    back = chats.select("conv_id", "formatted", "loss", chat.read_chats(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss")).alias("masked"))
    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((r or "", x or ""))
    for r in back.collect():
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id]
        assert r.masked == "".join(x for role, x in want[r.conv_id] if role == "assistant")
        assert len(r.loss) == sum(role == "assistant" for role, _ in want[r.conv_id])
        runs = 1 + sum(a[0] != b[0] for a, b in zip(want[r.conv_id], want[r.conv_id][1:], strict=False))
        for mark, n in (("<s>", 1), ("</s>", 1), ("[INST]", runs), ("[/INST]", runs), ("[SAYS]", runs), ("[NEXT]", len(want[r.conv_id]) - runs)):
            assert r.formatted.count(mark) == n
    assert chat.format_chats(df.limit(0)).count() == 0


def test_urls(spark):
    def page(i, url, *links):
        return (i, url, "".join(f"<A HREF = '{x}'>x</a>" for x in links))

    good, bad = url_filter.Rule("allow", "good.org", ""), url_filter.Rule("block", "bad.com", "")
    rows = [
        page(1, "http://good.org/a", "http://friend.net/x", "/inside"),
        page(2, "https://FRIEND.net?x", "//pal.net/y"),
        page(3, "http://pal.net#z"),
        page(4, "http://farm.biz/1", "https://www.bad.com/", "http://bad.com/q"),
        page(5, "http://feeder.biz/1", "http://farm.biz/"),
        page(6, "http://www.bad.com/1"),
        page(7, "http://bad.com/1"),
        (8, None, None),
        (9, "no scheme", "x"),
        page(10, "x://lonely"),
        page(10, "x://lonely"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS host", "3 AS n")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r["by"]) for r in url_filter.judge_urls(df, [good, bad]).collect()}
    assert got[1] == ("good.org", "/a", "good.org", "allow", "rule") and got[6][2:] == ("bad.com", "block", "rule")
    assert got[2] == ("friend.net", "", None, "allow", "links") and got[3][3] == "allow"
    assert got[4][3:] == ("block", "links") and got[5][3:] == ("block", "links")
    assert got[8] == got[9] == ("", "", None, "allow", "links") and got[10][3] == "allow"
    assert url_filter.judge_urls(df, [good, bad]).count() == len(rows) and url_filter.judge_urls(df.limit(0), [bad]).count() == 0


def test_mixed_hosts_are_seeds(spark, tmp_path):
    """Of a host without links, whose pages the rules decide both ways, the pages without a rule follow the larger share."""
    rows = [(i, f"http://a.com{path}", None) for i, path in enumerate(["/en/1", "/en/2", "/en/3", "/x"])] + [(9, "http://b.net/de/1", None), (10, "http://b.net/x", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.verdict, r["by"]) for r in registry.queries()["op4_url_filter"](spark, str(tmp_path)).collect()}
    assert got[3] == ("block", "links") and got[10] == ("allow", "links")


def test_pages_have_host_edges(spark):
    """On the table given, scores of hosts decide pages without a rule both ways."""
    got = [r.verdict for r in registry.queries()["op4_url_filter"](spark, SF).collect() if r["by"] == "links"]
    assert {"allow", "block"} == set(got)


def test_propagation(spark):
    """Against plain personalised PageRank."""
    rng = random.Random(5)
    hosts = [f"h{i}" for i in range(12)]
    links = {(a, b): float(rng.randint(1, 4)) for a in hosts for b in hosts if a != b and rng.random() < 0.2}
    s = url_filter.Spread(tolerance=0.3)
    seeds = {"h0": (3.0, 0.0), "h1": (1.0, 2.0)}
    want = {}
    for kind in (0, 1):
        edges = links if kind == 0 else {(b, a): n for (a, b), n in links.items()}
        total = sum(v[kind] for v in seeds.values())
        base = {h: (1 - s.damping) * seeds.get(h, (0, 0))[kind] / total for h in hosts}
        score = dict(base)
        for _ in range(s.rounds):
            new = dict(base)
            for (a, b), n in edges.items():
                new[b] += s.damping * score[a] * n / sum(m for (x, _), m in edges.items() if x == a)
            score = new
        want[kind] = score
    got = url_filter.propagate(spark.createDataFrame([(a, b, n) for (a, b), n in links.items()], "source string, target string, n double"), spark.createDataFrame([(h, *v) for h, v in seeds.items()], "host string, trust double, distrust double"), s, Written(spark, "t"))
    for r in got.collect():
        assert (r.trust, r.distrust) == pytest.approx((want[0][r.host], want[1][r.host]))


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    path = P.path("word_bpe_49k.json")
    for rows, length in (([(i, t) for i, t in texts.items()], 4096), ([(r[0], r[1]) for r in ODD], 64)):
        df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
        pieces = packing.pack(df, path, length).collect()
        sequences = defaultdict(list)
        of_doc = defaultdict(list)
        for r in pieces:
            assert len(r.ids) == 4 * r.length > 0
            sequences[r.sequence_id].append((r.offset, r.length))
            of_doc[r.doc_id].append(r)
        for s, own in sequences.items():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at == length or at & (at - 1) == 0, (s, at)
        want = defaultdict(list)
        for d, t in rows:
            want[d].append([*library.encode(t or "", add_special_tokens=False).ids, 2])
        for d, own in of_doc.items():
            ids = sorted(x for seq in want[d] for x in seq)
            assert sorted(np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist()) == ids
            if len(want[d]) == 1:
                joined = b"".join(bytes(r.ids) for r in sorted(own, key=lambda r: r.start))
                assert np.frombuffer(joined, "<u4").tolist() == want[d][0] and own[0].doc_tokens == len(want[d][0])
        assert of_doc.keys() == want.keys()
    assert packing.pack(docs.limit(0), path).count() == 0


def test_byte_bpe(spark, docs):
    path = P.path("byte_bpe_50k.tiktoken")
    out = byte_bpe.digests(clashing(docs), path, P.PATTERN).collect()
    assert len(out) == len(ODD)
    for r in out:
        assert r.bpe.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert (r.bpe.n_tokens == 0) == (not r.text)
    ids = byte_bpe.encoded(docs, path, P.PATTERN).select("text", "bpe.ids")
    assert all((r.text or "").encode() == bytes(r.decoded) for r in byte_bpe.decoded(ids, path, P.PATTERN).collect())
    assert byte_bpe.digests(docs.limit(0), path, P.PATTERN).count() == 0


def test_rules_and_counts(spark, docs):
    wide = clashing(docs).drop("rules", "tokens")
    by_id = defaultdict(list)
    for r in quality_rules.judge(wide).collect():
        by_id[r.doc_id].append(r.rules)
    assert by_id[2][0].n_words == by_id[3][0].n_words == 0 and by_id[2][0].base_failed and len(by_id[7]) == 2
    assert by_id[6][0].n_words == by_id[6][0].n_repeat_words == 8000 and not by_id[6][0].kept
    assert quality_rules.keep_good(clashing(docs)).columns == clashing(docs).columns and quality_rules.keep_good(docs.limit(0)).count() == 0
    counted = token_counts.count_tokens(wide, P.path("piece_bpe_32k.model")).collect()
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r in counted:
        assert r.tokens.n_bytes == len((r.text or "").encode()) and r.tokens.n_tokens == len(model.encode(r.text or "", num_threads=1))
    assert token_counts.count_tokens(docs.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_classifier(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(3, None), (None, 1), (4, 7)], "doc_id long, quality int")
    table = spark.createDataFrame([(i, "a fine text indeed" if i % 2 else "%%% bad *** text ###") for i in range(50)], "doc_id long, text string")
    model = classifier.fit(table, labels)
    scores = {r.doc_id: r.quality.score for r in classifier.score(clashing(table).drop("quality"), model).collect()}
    assert all((s >= 0.5) == bool(i % 2) for i, s in scores.items())
    # held-out labels don't matter
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert classifier.fit(table, flipped)[1] == model[1]
    assert len(classifier.keep_better(docs, labels).columns) == len(docs.columns)
    none = classifier.score(docs, classifier.fit(docs, labels.limit(0)))
    assert {r.quality.score for r in none.collect()} == {0.5} and none.count() == len(ODD)
    assert classifier.score(docs.limit(0), model).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 8)).astype(np.float32)
    v[30:60] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(100, None), (120, []), (140, [0.0] * 8), (160, [float("nan")] * 8), (161, [1.0, None] * 4), (180, [1.0, 2.0]), (181, [3.0, 1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS dim", "3 AS n")
    got = defaultdict(list)
    for r in nearest.nearest(df).orderBy("query_id", "rank").collect():
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    x = v.astype(np.float64)
    assert got.keys() == {0, 20, 40, 60, 80, 180}
    for q in (0, 20, 40, 60, 80):
        s = nearest.dot(np.repeat(x[q : q + 1], 90, 0), x)
        assert got[q] == [(i, s[i]) for i in sorted((i for i in range(90) if i != q), key=lambda i: (-s[i], i))[:20]]
    assert got[180] == [(181, 5.0)]
    assert nearest.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op1_chat_format", "op4_url_filter", "op9_nearest"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    assert sorted(map(str, (tuple(r[c] for c in order) for r in df.collect()))) == sorted(map(str, (tuple(r[names.index(c)] for c in order) for r in found.fetchall())))


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = dict(zip(*[c.to_pylist() for c in pq.read_table(f"{sf}/labels.parquet", columns=["doc_id", "quality"]).columns], strict=True))
    rows = registry.op3_quality_classifier(spark, sf).collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_pipeline(spark, texts):
    """Each stage on what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    written = Written(spark, "t")
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert rows == texts
    for (name, stage), n in zip(corpus_pipeline.STAGES[:-1], (7, 3, 2, 10), strict=True):
        out = written(stage(spark, docs, SF))
        assert out.dtypes == docs.dtypes, name
        kept = {r.doc_id: r.text for r in out.collect()}
        assert kept.keys() <= rows.keys() and len(kept) == out.count()
        if n == 7:
            verdict = {r.doc_id for r in quality_rules.judge(docs).where("rules.kept").collect()}
            assert kept.keys() == verdict
        if n == 2:
            kept_lines, eligible = brute_lines([(i, t) for i, t in rows.items()])
            want = {}
            for i, (d, t) in enumerate(rows.items()):
                left = "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) in kept_lines or (i, j) not in eligible)
                if left == t or re.search(r"[^\x20\x09-\x0D]", left):
                    want[d] = left
            assert kept == want
        elif n == 10:
            assert kept.keys() == set(groups_of(document_links(rows), rows).values())
        else:
            assert all(rows[d] == t for d, t in kept.items())
        docs, rows = out, kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.collect()} == rows.keys()
