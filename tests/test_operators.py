"""Small cases with known results."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sluice import functions as fn
from sluice import model
from sluice import sources as src
from sluice.operators import aggregate as agg
from sluice.operators import clock, metrics, state
from sluice.operators import graph as gr
from sluice.operators import partition as part
from sluice.operators import transforms as tr
from sluice.operators import windows as win


def ts(ms):
    return datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=ms)


def kv(spark, *rows):
    return src.create_timestamped(spark, rows, "k string, v int, ts_ms long")


def test_create_and_upper(spark):
    out = tr.upper(src.create_values(spark, ["alpha", "beta"]), "value")
    assert sorted(r.value for r in out.collect()) == ["ALPHA", "BETA"]


def test_keyed_sum(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, v int")
    assert {r.k: r.value for r in agg.combine(rows, "k", "v", "sum").collect()} == {"a": 3, "b": 5}
    assert {r.k: r["values"] for r in agg.group_by_key(rows, "k", "v").collect()} == {"a": [1, 2], "b": [5]}


def test_fixed_windows(spark):
    out = agg.combine(kv(spark, ("a", 1, 0), ("a", 2, 5000), ("a", 5, 15000)), "k", "v", "sum", win.Strategy(size="10 seconds"))
    assert sorted(r.value for r in out.collect()) == [3, 5]


def test_rewindow_keeps_an_element_once(spark):
    rows = win.rewindow(kv(spark, ("a", 1, 5000)), [win.Strategy(size="10 seconds", every="5 seconds"), win.Strategy(size="10 seconds")])
    assert [r.v for r in rows.collect()] == [1]


@pytest.mark.parametrize(("combiner", "ms"), [("earliest", 1000), ("latest", 5000), ("end_of_window", 9999)])
def test_group_time(spark, combiner, ms):
    out = agg.combine(kv(spark, ("a", 1, 1000), ("a", 2, 5000)), "k", "v", "sum", win.Strategy(size="10 seconds", combiner=combiner))
    assert [(r.value, r.ts) for r in out.collect()] == [(3, ts(ms))]


@pytest.mark.parametrize("bad", [{"gap": "5 seconds"}, {"trigger": "each_element"}, {"lateness_ms": 1}, {"accumulation": "accumulating"}, {"closing": "always"}, {"on_time": "never"}])
def test_rejected_strategies(spark, bad):
    with pytest.raises(NotImplementedError, match="fires once|sessions"):
        agg.group_by_key(kv(spark, ("a", 1, 0)), "k", "v", win.Strategy(**bad))


def test_side_inputs_are_rejected():
    tr.no_side_inputs([])
    with pytest.raises(NotImplementedError):
        tr.no_side_inputs(["x"])


def test_same_group_same_partition(spark):
    people = spark.createDataFrame([("Mark", "male"), ("Tom", "male"), ("Michelle", "female")], "name string, gender string")
    out = {r.name: r.partition_id for r in part.group_by_partition(people, 10, F.col("gender")).collect()}
    assert out["Mark"] == out["Tom"] and all(0 <= p < 10 for p in out.values())


def test_string_hash(spark):
    def fold(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return h

    texts = ["", "a", "click", "purchase of something long"]
    got = [r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fn.string_hash(F.col("t")).alias("h")).collect()]
    assert got == [fold(t) for t in texts]


@pytest.mark.parametrize("n", [1, 3, 7])
def test_round_robin_and_grouping(spark, n):
    rows = spark.range(50).withColumnRenamed("id", "event_id")
    order, index = ["event_id"], F.col("event_id")
    assert {r.event_id: r.row for r in fn.numbered(rows, order, index, size=4).collect()} == {i: i for i in range(50)}
    dealt = {r.event_id: r.partition_id for r in part.shuffle_partition(rows, n, order, index, 1).collect()}
    assert dealt == {i: (i + 1) % n for i in range(50)}
    grouped = sorted((r.event_id, r.partition_id) for r in part.shuffle_grouping_partition(rows, n, order, index).collect())
    for low in range(0, 50 - n + 1, n):
        assert sorted(p for _, p in grouped[low : low + n]) == list(range(n))


def test_broadcast_and_unicast(spark):
    rows = spark.range(4)
    assert part.broadcast_partition(rows, 3).count() == 12
    assert part.unicast(rows, F.when(F.col("id") == 2, -1).otherwise(F.col("id"))).count() == 3


def test_tags(spark):
    rows = tr.par_do_tagged(spark.range(6), {"even": F.col("id") % 2 == 0, "small": F.col("id") < 2})
    assert sorted(r.id for r in tr.select_tag(rows, "even").collect()) == [0, 2, 4]
    assert sorted(r.id for r in tr.select_tag(rows, "small").collect()) == [0, 1]
    assert tr.select_tag(rows, "unknown").count() == 0


def test_bundle_finish(spark):
    import pyarrow as pa

    class Count:
        def __init__(self):
            self.n = 0

        def __call__(self, batch):
            self.n += batch.num_rows
            return iter(())

        def finish(self):
            yield pa.RecordBatch.from_arrays([pa.array([self.n])], names=["n"])

    assert tr.par_do_bundle(spark.range(10).repartition(2), Count, "n long").agg(F.sum("n")).first()[0] == 10


def test_lifetime(spark):
    rows = kv(spark, ("a", 1, 0), ("a", 2, 99), ("a", 3, 100))
    assert tr.lifetime_filter(rows, model.LifeTime(0, 0)).count() == 0
    assert [r.v for r in tr.lifetime_filter(rows, model.LifeTime(0, 100)).orderBy("v").collect()] == [1, 2]
    assert model.LifeTime(0, 10).cross(model.LifeTime(5, 20)) == model.LifeTime(5, 10)


def test_task_id_round_trip():
    t = model.TaskId(7, 123)
    assert model.TaskId.unpack(t.packed()) == t


def test_cogroup(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "k string, v int")
    b = spark.createDataFrame([("x", 10), ("z", 20)], "k string, v int")
    out = {r.k: (r.left, r.right) for r in agg.cogroup({"left": a, "right": b}, "k", "v").collect()}
    assert out == {"x": (3, 10), "y": (3, None), "z": (None, 20)}


def test_combine_custom(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 3), ("b", 5)], "k string, v int")
    out = agg.combine_custom(rows, "k", "v", F.lit(1), lambda x, y: x * y)
    assert {r.k: r.value for r in out.collect()} == {"a": 6, "b": 5}


def test_slices(spark):
    """Slices hold their time, touch one another, lie in whole windows, and no checkpoint is inside one."""
    rng = random.Random(7)
    for _ in range(4):
        size, step = rng.randint(1, 60), rng.randint(1, 60)
        step = min(step, size)
        at = rng.randint(0, 200)
        rows = spark.range(200).select(F.col("id").alias("ms"))
        low, high = win.interval_slice(F.col("ms"), size, step, F.lit(at))
        out = {r.ms: (r.low, r.high) for r in rows.select("ms", low.alias("low"), high.alias("high")).collect()}
        bounds = {k * step for k in range(600)} | {k * step + size for k in range(600)} | {at}
        for ms, (a, b) in out.items():
            assert a <= ms < b and not any(a < x < b for x in bounds), (size, step, at, ms, a, b)
        cuts = sorted({a for a, _ in out.values()} | {b for _, b in out.values()})
        assert all(x in bounds for x in cuts)
    low, high = win.interval_slice(F.lit(7), 10, 4)
    assert spark.range(1).select(low, high).first() == (4, 8)


def test_slide(spark):
    rows = spark.createDataFrame([(0, 10, 3), (17, 10, 3), (9, 2, 5)], "ms long, size int, step int")
    for r in rows.collect():
        low, high = win.slide_to(F.lit(r.ms), r.size, r.step)
        a, b = spark.range(1).select(low, high).first()
        assert a <= r.ms < a + max(r.size, r.step) and b == a + r.size


def test_windows_of(spark):
    for ms in (0, 7, 13):
        got = spark.range(1).select(win.windows_of("ts", 10, 4, F.lit(ms)).alias("w")).first().w
        assert sorted(got) == [s for s in range(-12, 20, 4) if s <= ms < s + 10]


def test_checkpoints(spark):
    rng = random.Random(3)
    for _ in range(20):
        t, interval = rng.randint(0, 1000), rng.randint(100, 10000)
        first = spark.range(1).select(state.first_checkpoint(F.lit(t), interval)).first()[0]
        assert first - interval <= t < first and first % interval == 0
        newer = first + rng.randint(0, 3 * interval)
        nxt = spark.range(1).select(state.next_checkpoint(F.lit(first), F.lit(newer), interval)).first()[0]
        assert nxt is None if newer == first else newer < nxt <= newer + interval


def test_snapshot(spark):
    out = state.snapshot_left_right(kv(spark, ("a", 1, 99), ("a", 2, 100), ("a", 4, 101)), ["k"], F.col("v"), F.col("ts_ms"), 100).first()
    assert (out.left, out.right, out.total) == (1, 6, 7)


def test_global_checkpoint(spark):
    def of(*rows):
        return state.global_checkpoint(spark.createDataFrame(list(rows), "task int, t_ms long"), 2).first()[0]

    assert of((3, 100), (4, 100)) == 100
    assert of((3, 100), (4, 100), (3, 200), (4, 300)) == 100
    assert of((3, 100), (4, 100), (3, 200), (4, 300), (3, 300)) == 300
    assert of((3, 100)) is None


def test_clocks(spark):
    def tasks(*rows):
        return spark.createDataFrame(list(rows), "processor int, task int, clock_ms long")

    assert clock.min_clock(tasks((0, 0, 101), (1, 0, 100))).first()[0] == 100
    assert clock.min_clock(tasks((0, 0, 101), (1, 0, 102), (1, 1, 103))).first()[0] == 101
    stuck = [(r.processor, r.task) for r in clock.stalling_tasks(tasks((0, 0, 0), (1, 0, 0))).collect()]
    assert stuck == [(0, 0)]
    stuck = [(r.processor, r.task) for r in clock.stalling_tasks(tasks((0, 0, 10), (1, 0, 0))).collect()]
    assert stuck == [(1, 0)]
    assert clock.task_watermark(5, 100, 80, [90, 70], model.UNREACHABLE_MS) == 70
    assert clock.task_watermark(5, 100, 80, None, model.UNREACHABLE_MS) == 80
    assert clock.start_clock([], 7) == 7 and clock.start_clock([3, 9], 7) == 3


def test_histograms_and_meters(spark):
    cols = "time_ms long, kind string, name string, mean double, stddev double, median double, p95 double, p99 double, p999 double"
    name = "app0.processor0.task{}:receiveLatency"
    rows = [(200, "histogram", name.format(0), 1.0, 2.0, 3.0, 4.0, 5.0, 6.0), (100, "histogram", name.format(1), 5.0, 6.0, 7.0, 8.0, 9.0, 10.0)]
    out = metrics.processor_histograms(spark.createDataFrame(rows, cols), None).first()
    assert (out.time_ms, out.mean, out.stddev, out.median, out.p95, out.p99, out.p999) == (100, 3, 4, 5, 6, 7, 8)
    rows = [(200, "meter", name.format(0), 1, 1.0, 3.0), (100, "meter", name.format(1), 2, 5.0, 7.0), (100, "gauge", name.format(1), 2, 5.0, 7.0), (100, "meter", "app0.processor0/task1", 2, 5.0, 7.0)]
    out = metrics.processor_meters(spark.createDataFrame(rows, "time_ms long, kind string, name string, count long, mean_rate double, m1 double"), None).collect()
    assert [(r["name"], r.time_ms, r["count"], r.mean_rate, r.m1) for r in out] == [("app0.processor0:receiveLatency", 100, 3, 6, 10)]


def test_task_filter(spark):
    rows = [(0, "meter", f"app0.processor{p}.task{t}:throughput") for p in range(10) for t in range(10)]
    df = spark.createDataFrame(rows, "time_ms long, kind string, name string")
    assert metrics.task_filter(df, (3, 6), (3, 6), ["name"]).count() == 9
    assert metrics.task_filter(df, (3, 6), (3, 6), ["name"], 3).count() == 3
    assert metrics.task_filter(df, (0, 10), (0, 10), ["name"], 10).count() == 10
    names = [r["name"] for r in metrics.task_filter(df, (3, 6), (3, 6), ["name"], 3).collect()]
    assert names == sorted(names, reverse=True)


def test_retention(spark):
    rows = [(t, "counter", "metric.counter", i) for i, t in enumerate([0, 1, 10, 11, 20, 21], 1)]
    df = spark.createDataFrame(rows, "time_ms long, kind string, name string, value long")
    kept = metrics.read_retained(df, (10, 2), ["time_ms"]).orderBy("time_ms")
    assert [r.value for r in kept.collect()] == [3, 5]
    assert [r.value for r in metrics.read_latest(df, ["time_ms"]).collect()] == [6]
    assert [r.value for r in metrics.in_range(df, 25, (10, 1)).orderBy("value").collect()] == [3, 4]


def test_paths(spark):
    df = spark.createDataFrame([("metric.counter",), ("metric.meter",), ("metric.histogram",), ("other",), ("metricXcounter",)], "name string")
    assert metrics.by_path(df, "metric.").count() == 3
    assert metrics.by_path(df, "metric?c*r").count() == 2


def test_sampling(spark):
    rows = spark.createDataFrame([("a", i, 1) for i in range(10)], "k string, i int, v int")
    assert metrics.sampled_counter(rows, ["k"], ["i"], F.col("v"), 4).first().counter == 8
    marks = metrics.sampled_meter(rows, ["k"], ["i"], F.col("i"), 4).orderBy("mark").collect()
    assert [(r.mark, r.amount) for r in marks] == [(0, 6), (1, 22)]
    kept = metrics.sampled_histogram(rows, ["k"], ["i"], F.col("i"), 4).first()
    assert (kept.n, kept.low, kept.high, kept.mean) == (2, 3, 7, 5.0)
    assert metrics.sampled_histogram(rows, ["k"], ["i"], F.col("i"), 11).count() == 0


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def test_graph_tables(spark):
    e = edges(spark, ("A", "B"), ("B", "C"), ("A", "C"), ("A", "B"))
    assert {r.id: (r.in_degree, r.out_degree) for r in gr.degrees(e).collect()} == {"A": (0, 3), "B": (2, 1), "C": (2, 0)}
    assert [(r.src, r.dst, r.n) for r in gr.duplicate_edges(e).collect()] == [("A", "B", 2)]
    assert gr.subgraph(e, "C").count() == 2 and gr.edges_of(e, "A", "out").count() == 3
    assert gr.union_graphs(e, e).count() == 3
    renamed = gr.replace_vertex(e, "B", "D")
    assert {(r.src, r.dst) for r in renamed.collect()} == {("A", "D"), ("D", "C"), ("A", "C")}


def test_levels(spark):
    pairs = [("A", "B"), ("B", "C"), ("A", "C"), ("D", "E"), ("E", "F"), ("D", "F"), ("C", "E")]
    for f in (gr.levels, lambda e: gr.levels_sql(spark, e)):
        out = {r.id: r.level for r in f(edges(spark, *pairs)).collect()}
        assert all(out[a] < out[b] for a, b in pairs) and out["A"] == 0
    with pytest.raises(ValueError, match="cycle"):
        gr.levels(edges(spark, ("S", "A"), ("A", "B"), ("B", "A")), rounds=5)


def test_pagerank(spark):
    pairs = [("a", "b"), ("a", "c"), ("a", "d"), ("b", "a"), ("b", "d"), ("d", "b"), ("d", "c"), ("c", "b"), ("c", "e")]
    nodes = sorted({x for p in pairs for x in p})
    out = {n: [b for a, b in pairs if a == n] for n in nodes}
    w = dict.fromkeys(nodes, 1.0)
    for _ in range(7):
        new = dict.fromkeys(nodes, 0.0)
        for n in nodes:
            for m in out[n] or nodes:
                new[m] += w[n] / len(out[n] or nodes)
        w = new
    vertices = spark.createDataFrame([(n,) for n in nodes], "id string")
    got = {r.id: r.weight for r in gr.pagerank(vertices, edges(spark, *pairs), 7, 0).collect()}
    assert got == pytest.approx(w)
    settled = {r.id: r.weight for r in gr.pagerank(vertices, edges(spark, *pairs), 100, 0.001).collect()}
    assert sum(settled.values()) == pytest.approx(len(nodes))
