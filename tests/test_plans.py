"""The driver's graph, flows, versions, streams and sinks."""

import pytest
from pyspark.sql import functions as F

from sluice import sources as src
from sluice import streaming
from sluice.model import LifeTime
from sluice.plans import Flow, Graph, Processor, diff, replace_processor, sink
from sluice.plans.graph import Path
from sluice.streaming.app import batch_equal


def chain(*nodes):
    path = Path(nodes[0])
    for n in nodes[1:]:
        path.to(n)
    return path


def test_order_and_levels():
    g = Graph(chain("A", "B", "C"), chain("A", "C"), chain("D", "E", "F"), chain("D", "F"), chain("C", "E"))
    order = list(g.topological_order())
    level = g.levels()
    for a, _, b in g.edges():
        assert order.index(a) < order.index(b) and level[a] < level[b]
    assert not g.has_cycle() and g.in_degree("C") == 2 and g.out_degree("A") == 2


def test_cycles():
    g = Graph(chain(0, 1, 3, 4, 6, 5, 7), chain(4, 1), chain(1, 2, 4), chain(7, 6), chain(8, 2), chain(6, 9), chain(4, 10))
    assert g.has_cycle()
    assert sorted(map(sorted, g.components())) == [[0], [1, 2, 3, 4], [5, 6, 7], [8], [9], [10]]
    order = list(g.topological_order())
    assert order.index(0) < order.index(1) < order.index(6) < order.index(9)
    level = Graph(chain(0, 1, 2, 3, 4), chain(3, 1)).levels()
    assert level[0] < level[1] < level[2] < level[3] < level[4]


def test_graph_edits():
    g = Graph(chain("A", "B"))
    assert not g.has_duplicated_edge()
    g.add_edge("A", "second", "B")
    assert g.has_duplicated_edge()
    copy = g.copy()
    copy.add_vertex("C")
    assert "C" not in g.vertices()
    moved = Graph(chain("A", "B", "C")).replace_vertex("B", "D")
    assert moved.in_degree("D") == moved.out_degree("D") == 1 and "B" not in moved.vertices()
    assert set(Graph(chain("A", "B", "C"), chain("A", "C")).subgraph("C").vertices()) == {"A", "B", "C"}
    g.remove_edge("A", "second", "B")
    g.remove_vertex("A")
    assert g.edges() == [] and not g.is_empty()
    assert Graph().add_graph(copy).edges() == copy.edges()


def make(name, fn, **kw):
    return Processor(name, fn, **kw)


def test_flow(spark):
    one = make("one", lambda s: s.range(3).toDF("v"))
    two = make("two", lambda s: s.range(2).toDF("v"))
    count = make("count", lambda df: df.groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    flow = Flow("f", chain(one, count), chain(two, count))
    assert {r.v: r.n for r in flow.evaluate(spark)["count"].collect()} == {0: 2, 1: 2, 2: 1}
    assert flow.ids()["count"] == 2
    with pytest.raises(ValueError, match="cycle"):
        Flow("bad", chain(one, count, one))
    with pytest.raises(ValueError, match="one name"):
        Flow("bad", chain(one, make("one", lambda d: d, parallelism=2)))


def test_replacement(spark):
    def rows(s):
        return s.createDataFrame([(i, i * 50) for i in range(4)], "v long, ts_ms long").withColumn("ts", F.expr("timestampadd(MILLISECOND, ts_ms, timestamp_ntz'1970-01-01 00:00:00')"))

    old = make("old", lambda df: df.withColumn("by", F.lit("old")))
    flow = Flow("f", chain(make("source", rows), old, make("sink", lambda df: df)))
    new = flow.replaced("old", make("new", lambda df: df.withColumn("by", F.lit("new")), life=LifeTime(100)))
    assert new.version == 1
    got = {r.v: r.by for r in new.evaluate(spark, "ts")["sink"].collect()}
    assert got == {0: "old", 1: "old", 2: "new", 3: "new"}
    switch = replace_processor(rows(spark), 100, {"by": F.lit("old")}, {"by": F.lit("new")})
    assert {r.v: r.by for r in switch.collect()} == got


def test_sink(spark):
    seen = []
    end = sink("end", lambda df: seen.extend(r.v for r in df.collect()))
    flow = Flow("f", chain(make("one", lambda s: s.range(3).toDF("v")), end, make("after", lambda df: df)))
    assert flow.evaluate(spark)["after"].count() == 3 and sorted(seen) == [0, 1, 2]


def test_diff():
    a, b, c, d = (make(x, None) for x in "abcd")
    a2 = make("a", None, description="changed")
    before = Flow("f", chain(a, b), chain(a, c))
    after = Flow("f", chain(a2, b), chain(a2, c, d))
    assert diff(before, after) == {"added": {"d"}, "modified": {"a"}, "impacted": {"c"}}


def test_text_sink_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([(f"w{i % 3}",) for i in range(12)], "value string")
    assert src.write_text(rows, str(tmp_path / "lines")).count() == 12
    stream = src.read_unbounded(spark, str(tmp_path / "lines"), "value string", "text", batch_files=1)
    app = streaming.submit("copy", src.file_stream(stream, str(tmp_path / "copy"), str(tmp_path / "check")))
    assert app.wait() == "succeeded"
    assert batch_equal(spark.read.parquet(str(tmp_path / "copy")), rows)
    # a second run finds nothing new: each row once
    assert streaming.submit("copy2", src.file_stream(stream, str(tmp_path / "copy"), str(tmp_path / "check"))).wait() == "succeeded"
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 12


def test_replayable_source(spark, tmp_path):
    src.register_replayable(spark)

    def run(start, name):
        df = spark.readStream.format("sluice_replayable").option("rows", 10).option("step_ms", 100).option("start_ms", start).option("batch", 4).option("parallelism", 2).load()
        got = []
        q = src.foreach_batch(df, lambda b, i: got.extend(r.id for r in b.collect()), str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return sorted(got)

    assert run(0, "a") == list(range(10))
    assert run(450, "b") == list(range(5, 10))


def test_failed_and_killed(spark, tmp_path):
    def fail(batch, number):
        raise ValueError("no")

    rows = spark.createDataFrame([("x",)], "value string")
    src.write_text(rows, str(tmp_path / "in"))
    stream = src.read_unbounded(spark, str(tmp_path / "in"), "value string", "text")
    app = streaming.submit("bad", src.foreach_batch(stream, fail, str(tmp_path / "c1")))
    assert app.wait() == "failed" and "no" in app.info()["error"]
    app = streaming.submit("ticks", src.memory(src.ticking(spark), "ticks"), once=False)
    assert app.status() == "active"
    app.kill()
    assert app.status() == "terminated"
