"""The queries of the core: one per operator, each with its SQL where SQL can express it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
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
from sluice.plans import Flow, Graph, Processor, diff, from_json, replace_processor, sink
from sluice.plans.graph import Path

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: A time in the middle of the events, in ms and as a timestamp.
SPLIT_MS, SPLIT_TS = 1_705_276_800_000, "2024-01-15 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return src.read_bounded(spark, f"{sf_dir}/{name}.parquet", columns or None)


CENTS = "round(value * 100)::BIGINT"
HOUR = "time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01')"


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "events", *columns)


def money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, "event_id", "ts", "user_id", "event_type", "value").withColumn("cents", fn.cents(F.col("value")))


# --- sources ---------------------------------------------------------------------------


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def read_bounded(spark, sf_dir):
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity")


@query("SELECT * FROM (VALUES (0::BIGINT, 'alpha', 0), (1, 'beta', 1), (2, 'gamma', 2), (3, 'delta', 0), (4, 'epsilon', 1)) t(idx, value, stripe)")
def create_values(spark, sf_dir):
    return src.create_values(spark, ["alpha", "beta", "gamma", "delta", "epsilon"], parallelism=3)


@query("SELECT * FROM (VALUES ('a', 1, TIMESTAMP '1970-01-01 00:00:00'), ('a', 2, TIMESTAMP '1970-01-01 00:00:05'), ('a', 5, TIMESTAMP '1970-01-01 00:00:15')) t(k, v, ts)")
def create_timestamped(spark, sf_dir):
    return src.create_timestamped(spark, [("a", 1, 0), ("a", 2, 5000), ("a", 5, 15000)], "k string, v int, ts_ms long").drop("ts_ms")


@query("SELECT 0::BIGINT AS n_bytes")
def impulse(spark, sf_dir):
    return src.impulse(spark).select(F.length("value").cast("long").alias("n_bytes"))


@query("SELECT NULL::VARCHAR AS k, NULL::BIGINT AS v WHERE false")
def empty_source(spark, sf_dir):
    return src.empty(spark, "k string, v long")


@query(f"SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '{SPLIT_TS}'")
def replay_from(spark, sf_dir):
    return src.replay_from(events(spark, sf_dir, "event_id", "ts"), F.expr(f"timestamp_ntz'{SPLIT_TS}'"))


@query("SELECT word, count(*) * 3 AS n FROM (SELECT unnest(string_split('rivers run past mills and past barns', ' ')) AS word) GROUP BY word")
def sentence_source(spark, sf_dir):
    return agg.word_count(src.sentence_words(spark, "rivers run past mills and past barns", rounds=3))


@query("SELECT word, count(*) * 2 AS n FROM (SELECT unnest(string_split('a  b c  ', ' ')) AS word) GROUP BY word")
def sentence_single_spaces(spark, sf_dir):
    return agg.word_count(src.sentence_words(spark, "a  b c  ", rounds=2, single_spaces=True))


@query("SELECT count(*) AS n, 100 * count(*) AS chars, true AS digits FROM nation")
def load_generator(spark, sf_dir):
    made = src.digit_strings(spark, table(spark, sf_dir, "nation").count())
    return made.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("chars"), F.bool_and(F.col("value").rlike("^[0-8]+$")).alias("digits"))


@query("SELECT 'end' AS sink, 'start|middle' AS path")
def demo_dag(spark, sf_dir):
    first = tr.append_name(src.vector_source(spark, "start", 5), "list", "middle")
    return src.capture_first(first, "end").select("sink", F.concat_ws("|", "list").alias("path"))


# --- per-record transforms -------------------------------------------------------------


@query("SELECT c_custkey, upper(c_mktsegment) AS segment FROM customer")
def par_do_map(spark, sf_dir):
    return tr.par_do(table(spark, sf_dir, "customer"), c_custkey=F.col("c_custkey"), segment=F.upper("c_mktsegment"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def par_do_flat_map(spark, sf_dir):
    return tr.extract_words(table(spark, sf_dir, "documents", "text"), "text").groupBy("word").agg(F.sum("n").alias("n"))


@query("SELECT event_type || '=' || user_id::VARCHAR AS line FROM events")
def par_do_format(spark, sf_dir):
    return events(spark, sf_dir, "event_type", "user_id").select(tr.format_pair(F.col("event_type"), F.col("user_id")).alias("line"))


@query("SELECT o_orderkey, sum(length(p_name))::BIGINT AS chars FROM (SELECT l_orderkey AS o_orderkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1")
def par_do_bundle(spark, sf_dir):
    import pyarrow as pa
    import pyarrow.compute as pc

    def make():
        def process(batch):
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.utf8_length(batch.column(1)), pa.int64())], names=["o_orderkey", "chars"])

        return process

    named = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").join(table(spark, sf_dir, "part", "p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return tr.par_do_bundle(named.select("l_orderkey", "p_name"), make, "o_orderkey long, chars long").groupBy("o_orderkey").agg(F.sum("chars").alias("chars"))


def _tagged(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    return tr.par_do_tagged(orders, {"open": F.col("o_orderstatus") == "O", "done": F.col("o_orderstatus") == "F", "large": F.col("o_totalprice") > 200000})


_TAG_SQL = "SELECT o_orderkey, 'open' AS tag FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'done' FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'large' FROM orders WHERE o_totalprice > 200000"


@query(f"SELECT tag, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM ({_TAG_SQL}) GROUP BY tag")
def par_do_multi_output(spark, sf_dir):
    return _tagged(spark, sf_dir).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def select_tag(spark, sf_dir):
    return tr.select_tag(_tagged(spark, sf_dir), "done").select("o_orderkey")


@query(f"SELECT event_id, ts FROM events WHERE (epoch_us(ts) // 1000) >= {SPLIT_MS} AND (epoch_us(ts) // 1000) < {SPLIT_MS + 86_400_000}")
def lifetime_filter(spark, sf_dir):
    return tr.lifetime_filter(events(spark, sf_dir, "event_id", "ts"), model.LifeTime(SPLIT_MS, SPLIT_MS + 86_400_000))


@query("SELECT event_id, user_id % 7 - 1 AS p FROM events WHERE user_id % 7 - 1 <> -1")
def drop_partition(spark, sf_dir):
    return tr.drop_unrouted(events(spark, sf_dir, "event_id", "user_id").withColumn("p", F.col("user_id") % 7 - 1), F.col("p")).drop("user_id")


@query("SELECT p_partkey, p_brand || '|second|third' AS path FROM part")
def append_vector(spark, sf_dir):
    rows = table(spark, sf_dir, "part", "p_partkey", "p_brand").withColumn("list", F.array("p_brand"))
    return tr.append_name(tr.append_name(rows, "list", "second"), "list", "third").select("p_partkey", F.concat_ws("|", "list").alias("path"))


@query("SELECT s_suppkey, s_name FROM supplier")
def pass_through(spark, sf_dir):
    return tr.pass_through(table(spark, sf_dir, "supplier", "s_suppkey", "s_name"))


@query("SELECT 1 AS route, count(*) AS n FROM orders WHERE o_orderkey % 3 = 1")
def output_to_one(spark, sf_dir):
    routed = tr.route(table(spark, sf_dir, "orders", "o_orderkey"), F.col("o_orderkey") % 3, 3)
    return routed[1].agg(F.lit(1).alias("route"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '{SPLIT_TS}'")
def time_filter(spark, sf_dir):
    return tr.time_filter(events(spark, sf_dir, "event_id", "ts"), F.expr(f"timestamp_ntz'{SPLIT_TS}'"))


@query("SELECT event_id, coalesce(CASE WHEN user_id % 2 = 0 THEN ts END, TIMESTAMP '1970-01-01') AS at FROM events")
def default_timestamp(spark, sf_dir):
    rows = events(spark, sf_dir, "event_id", "user_id", "ts")
    return model.message(rows, F.when(F.col("user_id") % 2 == 0, F.col("ts")), "at").select("event_id", "at")


# --- fan-in and fan-out ----------------------------------------------------------------


@query("SELECT c_name AS name, c_nationkey AS nationkey FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier")
def flatten(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.col(f"{c}_name").alias("name"), F.col(f"{c}_nationkey").alias("nationkey")) for t, c in (("customer", "c"), ("supplier", "s"))]
    return tr.flatten(parts)


@query("SELECT s_name AS name FROM supplier")
def flatten_one(spark, sf_dir):
    return tr.flatten([table(spark, sf_dir, "supplier", "s_name").withColumnRenamed("s_name", "name")])


@query("SELECT NULL::VARCHAR AS name WHERE false")
def flatten_none(spark, sf_dir):
    return tr.flatten([], "name string", spark)


@query("SELECT 'status' AS kind, o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def fan_out(spark, sf_dir):
    # both consumers in one pass: each row once per consumer, counted before the shuffle
    orders = table(spark, sf_dir, "orders", "o_orderstatus", "o_orderpriority")
    copies = F.array(F.struct(F.lit("status").alias("kind"), F.col("o_orderstatus").alias("k")), F.struct(F.lit("priority").alias("kind"), F.col("o_orderpriority").alias("k")))
    return orders.select(F.explode(copies).alias("c")).groupBy("c.kind", "c.k").agg(F.count(F.lit(1)).alias("n"))


# --- partitioners ----------------------------------------------------------------------


def _hash_sql(text: str, n: int) -> str:
    return f"((list_reduce(list_prepend(0::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) & 4294967295)) & 2147483647) % {n}"


@query(f"SELECT event_type, {_hash_sql('event_type', 4)} AS partition_id, count(*) AS n FROM events GROUP BY 1, 2")
def hash_partition(spark, sf_dir):
    return part.hash_partition(events(spark, sf_dir, "event_type"), 4).groupBy("event_type", "partition_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT partition_id, count(*) AS n FROM (SELECT {_hash_sql('c_mktsegment', 10)} AS partition_id FROM customer) GROUP BY 1")
def group_by_partition(spark, sf_dir):
    return part.group_by_partition(table(spark, sf_dir, "customer", "c_mktsegment"), 10, F.col("c_mktsegment")).groupBy("partition_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT partition_id, count(*) AS n, sum(event_id)::BIGINT AS ids FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1 + 1) % 4 AS partition_id FROM events) GROUP BY 1")
def shuffle_partition(spark, sf_dir):
    dealt = part.shuffle_partition(events(spark, sf_dir, "event_id"), 4, ["event_id"], F.col("event_id"))
    return dealt.groupBy("partition_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT count(*) AS n, 5::BIGINT AS partitions, true AS even FROM events")
def shuffle_grouping(spark, sf_dir):
    dealt = part.shuffle_grouping_partition(events(spark, sf_dir, "event_id"), 5, ["event_id"], F.col("event_id"))
    counts = dealt.groupBy("partition_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("partitions"), (F.max("n") - F.min("n") <= 1).alias("even"))


@query("SELECT n_nationkey, p::INTEGER AS partition_id FROM nation CROSS JOIN range(3) t(p)")
def broadcast_partition(spark, sf_dir):
    return part.broadcast_partition(table(spark, sf_dir, "nation", "n_nationkey"), 3)


@query("SELECT n_nationkey, unnest([n_nationkey % 3, n_nationkey % 3 + 1]) AS partition_id FROM nation")
def multicast_partition(spark, sf_dir):
    return part.multicast_partition(table(spark, sf_dir, "nation", "n_nationkey"), F.array(F.col("n_nationkey") % 3, F.col("n_nationkey") % 3 + 1))


@query("SELECT n_nationkey, n_regionkey AS partition_id FROM nation")
def colocation(spark, sf_dir):
    return part.co_location(table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey"), F.col("n_regionkey")).drop("n_regionkey")


@query("SELECT n_nationkey, n_nationkey % 4 - 1 AS partition_id FROM nation WHERE n_nationkey % 4 - 1 <> -1")
def custom_partition(spark, sf_dir):
    return part.unicast(table(spark, sf_dir, "nation", "n_nationkey"), F.col("n_nationkey") % 4 - 1)


# --- grouping and combining ------------------------------------------------------------


@query("SELECT event_type, array_to_string(list_sort(list(user_id)), ',') AS users FROM events GROUP BY 1")
def group_by_key(spark, sf_dir):
    return agg.group_by_key(events(spark, sf_dir, "event_type", "user_id"), "event_type", "user_id").select("event_type", F.concat_ws(",", F.col("values").cast("array<string>")).alias("users"))


def _combine(how: str, sql: str) -> None:
    def run(spark, sf_dir):
        return agg.combine(money(spark, sf_dir), "event_type", "cents", how)

    run.__name__ = f"combine_{how}"
    query(f"SELECT event_type, {sql} AS value FROM (SELECT event_type, {CENTS} AS cents FROM events) GROUP BY 1")(run)


for _how, _sql in {"sum": "sum(cents)::BIGINT", "min": "min(cents)", "max": "max(cents)", "count": "count(cents)", "mean": "sum(cents) / count(cents)"}.items():
    _combine(_how, _sql)


@query("SELECT o_orderstatus, bit_xor(o_orderkey) AS value FROM orders GROUP BY 1")
def combine_custom(spark, sf_dir):
    return agg.combine(table(spark, sf_dir, "orders", "o_orderstatus", "o_orderkey"), "o_orderstatus", "o_orderkey", F.bit_xor)


@query(f"SELECT event_type, array_to_string(list_sort(list(DISTINCT user_id)), ',') AS users, sum(cents)::BIGINT - min(cents) AS rest FROM (SELECT *, {CENTS} AS cents FROM events) GROUP BY 1")
def monoids(spark, sf_dir):
    m = agg.monoids()
    rows = money(spark, sf_dir).groupBy("event_type").agg(m["set"].of(F.col("user_id")).alias("u"), m["sum"].of(F.col("cents")).alias("s"), m["min"].of(F.col("cents")).alias("least"))
    return rows.select("event_type", F.concat_ws(",", F.sort_array("u").cast("array<string>")).alias("users"), m["sum"].minus(F.col("s"), F.col("least")).alias("rest"))


@query(r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def word_count(spark, sf_dir):
    return agg.word_count(table(spark, sf_dir, "documents", "text").select(F.explode(fn.words(F.col("text"))).alias("word")))


@query("""SELECT coalesce(a.k, b.k) AS k, a.v AS orders, b.v AS customers FROM
  (SELECT o_custkey AS k, count(*) AS v FROM orders GROUP BY 1) a FULL JOIN (SELECT c_custkey AS k, count(*) AS v FROM customer WHERE c_acctbal > 0 GROUP BY 1) b ON a.k = b.k""")
def cogroup_via_flatten(spark, sf_dir):
    one = F.lit(1).cast("long").alias("v")
    orders = table(spark, sf_dir, "orders", "o_custkey").select(F.col("o_custkey").alias("k"), one)
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), one)
    return agg.cogroup({"orders": orders, "customers": customers}, "k", "v")


# --- windows ---------------------------------------------------------------------------


@query(f"SELECT {HOUR} AS window_start, count(*) AS n FROM events GROUP BY 1")
def fixed_windows(spark, sf_dir):
    return win.fixed(events(spark, sf_dir, "ts"), "1 hour").groupBy("window").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "n")


_SLIDES = "SELECT time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') - to_minutes(15 * unnest([0, 1, 2, 3])) AS window_start, event_type, {c} AS cents FROM events"


@query(f"SELECT window_start, count(*) AS n FROM ({_SLIDES.format(c='0')}) GROUP BY 1")
def sliding_windows(spark, sf_dir):
    return win.sliding(events(spark, sf_dir, "ts"), "1 hour", "15 minutes").groupBy("window").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "n")


@query(f"SELECT {HOUR} AS window_start, count(*) AS n FROM events GROUP BY 1")
def rewindow(spark, sf_dir):
    rows = win.rewindow(events(spark, sf_dir, "ts"), [win.Strategy(size="2 hours", every="1 hour"), win.Strategy(size="1 hour")])
    return rows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "n")


@query("SELECT count(*) AS n, sum(user_id)::BIGINT AS users FROM events")
def global_window(spark, sf_dir):
    rows = win.assign(events(spark, sf_dir, "ts", "user_id"), win.Strategy())
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))


@query(f"SELECT event_type, {HOUR} AS window_start, {HOUR} + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND AS ts, sum({CENTS})::BIGINT AS total FROM events GROUP BY 1, 2, 3")
def windowed_keyed_sum(spark, sf_dir):
    out = agg.combine(money(spark, sf_dir), "event_type", "cents", "sum", win.Strategy(size="1 hour"), as_="total")
    return out.select("event_type", F.col("window.start").alias("window_start"), "ts", "total")


def _combiner(name: str, sql: str) -> None:
    def run(spark, sf_dir):
        out = agg.combine(money(spark, sf_dir), "event_type", "cents", "sum", win.Strategy(size="1 hour", combiner=name), as_="total")
        return out.select("event_type", F.col("window.start").alias("window_start"), "ts", "total")

    run.__name__ = f"ts_combiner_{name}"
    query(f"SELECT event_type, w AS window_start, {sql} AS ts, sum(cents)::BIGINT AS total FROM (SELECT event_type, ts, {HOUR} AS w, {CENTS} AS cents FROM events) GROUP BY 1, 2")(run)


for _name, _sql in {"earliest": "min(ts)", "latest": "max(ts)", "end_of_window": "w + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND"}.items():
    _combiner(_name, _sql)


@query("""SELECT event_id, greatest(s, CASE WHEN e >= 10000 THEN e ELSE 0 END) AS slice_start, least(s + 4000, greatest(e + 4000, 10000)) AS slice_end FROM
  (SELECT event_id, ms // 4000 * 4000 AS s, (ms - 2000) // 4000 * 4000 + 2000 AS e FROM (SELECT event_id, (epoch_us(ts) // 1000) AS ms FROM events))""")
def interval_slices(spark, sf_dir):
    rows = events(spark, sf_dir, "event_id", "ts").withColumn("ms", model.millis("ts"))
    low, high = win.interval_slice(F.col("ms"), 10_000, 4_000)
    return rows.select("event_id", low.alias("slice_start"), high.alias("slice_end"))


@query("SELECT event_id, ms // 900000 * 900000 AS range_start, ms // 900000 * 900000 + 3600000 AS range_end FROM (SELECT event_id, (epoch_us(ts) // 1000) AS ms FROM events)")
def window_slide(spark, sf_dir):
    rows = events(spark, sf_dir, "event_id", "ts").withColumn("ms", model.millis("ts"))
    low, high = win.slide_to(F.col("ms"), 3_600_000, 900_000)
    return rows.select("event_id", low.alias("range_start"), high.alias("range_end"))


# --- state, checkpoints, clocks --------------------------------------------------------


@query(f"SELECT event_type, window_start, sum(cents)::BIGINT AS state FROM ({_SLIDES.format(c=CENTS)}) GROUP BY 1, 2")
def window_state_value(spark, sf_dir):
    out = state.window_state(money(spark, sf_dir), ["event_type"], F.col("cents"), "1 hour", "15 minutes", agg.monoids()["sum"])
    return out.select("event_type", F.col("window.start").alias("window_start"), "state")


@query(f"SELECT event_id, user_id, sum({CENTS}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS state FROM events")
def non_window_state(spark, sf_dir):
    return state.running(money(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("cents")).select("event_id", "user_id", "state")


@query(f"SELECT event_type, sum(CASE WHEN (epoch_us(ts) // 1000) < {SPLIT_MS} THEN c ELSE 0 END)::BIGINT AS \"left\", sum(CASE WHEN (epoch_us(ts) // 1000) >= {SPLIT_MS} THEN c ELSE 0 END)::BIGINT AS \"right\", sum(c)::BIGINT AS total FROM (SELECT *, {CENTS} AS c FROM events) GROUP BY 1")
def snapshot_left_right(spark, sf_dir):
    return state.snapshot_left_right(money(spark, sf_dir), ["event_type"], F.col("cents"), model.millis("ts"), SPLIT_MS)


@query("SELECT event_id, (1 + ms // 10000) * 10000 AS first_ms, CASE WHEN ms > 1000000000000 THEN 1000000000000 + (1 + (ms - 1000000000000) // 10000) * 10000 END AS next_ms FROM (SELECT event_id, (epoch_us(ts) // 1000) AS ms FROM events)")
def checkpoint_times(spark, sf_dir):
    rows = events(spark, sf_dir, "event_id", "ts").withColumn("ms", model.millis("ts"))
    return rows.select("event_id", state.first_checkpoint(F.col("ms"), 10_000).alias("first_ms"), state.next_checkpoint(F.lit(1_000_000_000_000), F.col("ms"), 10_000).alias("next_ms"))


@query("SELECT max(t_ms) AS checkpoint_ms FROM (SELECT t_ms FROM (SELECT DISTINCT user_id % 7 AS task, (epoch_us(ts) // 1000) // 86400000 * 86400000 AS t_ms FROM events) GROUP BY t_ms HAVING count(*) = 7)")
def global_checkpoint(spark, sf_dir):
    reports = events(spark, sf_dir, "user_id", "ts").select((F.col("user_id") % 7).alias("task"), fn.floor_to(model.millis("ts"), 86_400_000).alias("t_ms"))
    return state.global_checkpoint(reports, 7)


_TASKS = "SELECT user_id % 3 AS processor, user_id % 5 AS task, max((epoch_us(ts) // 1000)) AS clock_ms FROM events GROUP BY 1, 2"


def _task_clocks(spark, sf_dir):
    return events(spark, sf_dir, "user_id", "ts").groupBy((F.col("user_id") % 3).alias("processor"), (F.col("user_id") % 5).alias("task")).agg(F.max(model.millis("ts")).alias("clock_ms"))


@query(f"SELECT min(clock_ms) AS clock_ms FROM (SELECT processor, min(clock_ms) AS clock_ms FROM ({_TASKS}) GROUP BY 1)")
def clock_min(spark, sf_dir):
    return clock.min_clock(_task_clocks(spark, sf_dir))


@query(f"WITH t AS ({_TASKS}), p AS (SELECT processor, min(clock_ms) AS c FROM t GROUP BY 1), f AS (SELECT processor, c FROM p ORDER BY c, processor LIMIT 1) SELECT t.processor, t.task, t.clock_ms FROM t JOIN f ON t.processor = f.processor AND t.clock_ms = f.c")
def stalling_tasks(spark, sf_dir):
    return clock.stalling_tasks(_task_clocks(spark, sf_dir))


@query("SELECT n_nationkey, n_regionkey::BIGINT * 4294967296 + n_nationkey AS task_id FROM nation")
def task_ids(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", model.packed_task(F.col("n_regionkey"), F.col("n_nationkey")).alias("task_id"))


# --- metrics history -------------------------------------------------------------------


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points of metrics of 3 processors with 5 tasks each."""
    own = F.concat(F.lit("app0.processor"), F.col("user_id") % 3, F.lit(".task"), F.col("user_id") % 5, F.lit(":"), F.col("event_type"))
    kind = F.when(F.col("event_type").isin("click", "view", "purchase"), "meter").otherwise("histogram")
    c = F.col("cents")
    return money(spark, sf_dir).select("event_id", model.millis("ts").alias("time_ms"), kind.alias("kind"), own.alias("name"), F.lit(1).cast("long").alias("count"), c.alias("mean_rate"), c.alias("m1"), c.alias("mean"))


_POINTS = f"""(SELECT event_id, (epoch_us(ts) // 1000) AS time_ms, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'meter' ELSE 'histogram' END AS kind,
  'app0.processor' || (user_id % 3)::VARCHAR || '.task' || (user_id % 5)::VARCHAR || ':' || event_type AS name, user_id % 3 AS processor, user_id % 5 AS task, event_type AS metric, 1::BIGINT AS count, {CENTS} AS cents FROM events)"""


@query(f"SELECT event_id, name FROM {_POINTS} WHERE regexp_matches(name, '^app0\\.processor.\\.task2:.*c')")
def metrics_glob(spark, sf_dir):
    return metrics.by_path(metrics.stored(points(spark, sf_dir)), "app0.processor?.task2:*c").select("event_id", "name")


@query(f"SELECT name, time_ms, event_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY time_ms DESC, event_id DESC) AS r FROM {_POINTS}) WHERE r = 1")
def metrics_read_latest(spark, sf_dir):
    return metrics.read_latest(points(spark, sf_dir), ["time_ms", "event_id"]).select("name", "time_ms", "event_id")


def _retained(size: int, kept: int) -> str:
    return f"""SELECT name, time_ms, event_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY b DESC) AS n FROM
  (SELECT *, time_ms // {size} AS b, row_number() OVER (PARTITION BY name, time_ms // {size} ORDER BY time_ms, event_id) AS r FROM {_POINTS}) WHERE r = 1) WHERE n <= {kept}"""


@query(_retained(*metrics.RECENT))
def metrics_read_recent(spark, sf_dir):
    return metrics.read_retained(points(spark, sf_dir), metrics.RECENT, ["time_ms", "event_id"]).select("name", "time_ms", "event_id")


@query(_retained(*metrics.HISTORY))
def metrics_read_history(spark, sf_dir):
    return metrics.read_retained(points(spark, sf_dir), metrics.HISTORY, ["time_ms", "event_id"]).select("name", "time_ms", "event_id")


_SLOT = f"SELECT time_ms // 3600000 AS slot, 'app0.processor' || processor::VARCHAR || ':' || metric AS name, min(time_ms) AS time_ms, {{f}} FROM {_POINTS} WHERE kind = '{{k}}' GROUP BY 1, 2"


@query(_SLOT.format(f='sum("count")::BIGINT AS "count", sum(cents)::BIGINT AS mean_rate, sum(cents)::BIGINT AS m1', k="meter"))
def processor_aggregate_meter(spark, sf_dir):
    return metrics.processor_meters(points(spark, sf_dir), 3_600_000)


@query(_SLOT.format(f=", ".join(f"sum(cents + {i}) / count(*) AS {x}" for i, x in enumerate(("mean", "stddev", "median", "p95", "p99", "p999"))), k="histogram"))
def processor_aggregate_histogram(spark, sf_dir):
    rows = points(spark, sf_dir)
    fields = ("stddev", "median", "p95", "p99", "p999")
    return metrics.processor_histograms(rows.withColumns({x: F.col("mean") + i for i, x in enumerate(fields, 1)}), 3_600_000)


@query(f"SELECT name, event_id FROM {_POINTS} WHERE time_ms >= {SPLIT_MS} - 24 * 3600000 AND time_ms < {SPLIT_MS}")
def metrics_in_range(spark, sf_dir):
    return metrics.in_range(points(spark, sf_dir), SPLIT_MS, (3_600_000, 24)).select("name", "event_id")


_LATEST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY time_ms DESC, event_id DESC) AS r FROM {_POINTS}) WHERE r = 1)"


@query(f"SELECT name, time_ms FROM {_LATEST} WHERE processor >= 1 AND processor < 3 AND task >= 0 AND task < 4 ORDER BY name LIMIT 20")
def task_filter(spark, sf_dir):
    latest = metrics.read_latest(points(spark, sf_dir), ["time_ms", "event_id"])
    return metrics.task_filter(latest, (1, 3), (0, 4), ["name"], 20).select("name", "time_ms")


@query(f"SELECT name, event_id FROM {_POINTS} WHERE false")
def unknown_aggregator(spark, sf_dir):
    return metrics.aggregated(points(spark, sf_dir), "none_such").select("name", "event_id")


@query(f"SELECT event_type, n, sum(CASE WHEN r <= n - n % 7 THEN cents ELSE 0 END)::BIGINT AS counter FROM (SELECT event_type, {CENTS} AS cents, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1, 2")
def counter_sampling(spark, sf_dir):
    return metrics.sampled_counter(money(spark, sf_dir), ["event_type"], ["ts", "event_id"], F.col("cents"), 7)


_UPDATES = f"(SELECT event_type, {CENTS} AS cents, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)"


@query(f"SELECT event_type, (r - 1) // 7 AS mark, sum(cents)::BIGINT AS amount FROM {_UPDATES} WHERE r <= n - n % 7 GROUP BY 1, 2")
def meter_sampling(spark, sf_dir):
    return metrics.sampled_meter(money(spark, sf_dir), ["event_type"], ["ts", "event_id"], F.col("cents"), 7)


@query(f"SELECT event_type, count(*) AS n, min(cents) AS low, max(cents) AS high, sum(cents) / count(*) AS mean FROM {_UPDATES} WHERE r % 7 = 0 GROUP BY 1")
def histogram_sampling(spark, sf_dir):
    return metrics.sampled_histogram(money(spark, sf_dir), ["event_type"], ["ts", "event_id"], F.col("cents"), 7)


@query(f"SELECT time_ms // 3600000 * 3600000 AS bucket_ms, sum(cents)::BIGINT AS sum_m1, sum(cents) / count(*) AS mean_mean FROM {_POINTS} GROUP BY 1")
def dashboard_series(spark, sf_dir):
    return metrics.series(points(spark, sf_dir), 3_600_000, ("m1",), ("mean",))


@query(f"SELECT processor::INTEGER AS processor, count(DISTINCT task) AS tasks FROM {_POINTS} GROUP BY 1")
def tasks_per_executor(spark, sf_dir):
    return metrics.task_counts(points(spark, sf_dir))


# --- graphs ----------------------------------------------------------------------------


def _links(spark, sf_dir):
    return table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))


_LINKS = "(SELECT 'p' || l_partkey::VARCHAR AS src, 's' || l_suppkey::VARCHAR AS dst FROM lineitem)"


@query(f"SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM {_LINKS} UNION ALL SELECT dst, 1, 0 FROM {_LINKS}) GROUP BY 1")
def graph_degree(spark, sf_dir):
    return gr.degrees(_links(spark, sf_dir))


@query(f"SELECT src, dst, count(*) AS n FROM {_LINKS} GROUP BY 1, 2 HAVING count(*) > 1")
def graph_duplicate_edges(spark, sf_dir):
    return gr.duplicate_edges(_links(spark, sf_dir))


@query(f"SELECT DISTINCT src, dst FROM {_LINKS} WHERE src = 'p7' OR dst = 'p7'")
def graph_subgraph(spark, sf_dir):
    return gr.subgraph(_links(spark, sf_dir), "p7").distinct()


@query(f"SELECT CASE WHEN src = 'p7' THEN 'p0' ELSE src END AS src, dst, count(*) AS n FROM {_LINKS} GROUP BY 1, 2")
def graph_replace_vertex(spark, sf_dir):
    return gr.replace_vertex(_links(spark, sf_dir), "p7", "p0").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


#: A fixed small acyclic graph.
DAG = [("A", "B"), ("B", "C"), ("A", "C"), ("D", "E"), ("E", "F"), ("D", "F"), ("C", "E")]
_DAG = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in DAG) + ") e(src, dst)"


@query(f"WITH RECURSIVE w(id, level) AS (SELECT DISTINCT src, 0 FROM {_DAG} WHERE src NOT IN (SELECT dst FROM {_DAG}) UNION ALL SELECT e.dst, w.level + 1 FROM w JOIN {_DAG} ON e.src = w.id) SELECT id, max(level) AS level FROM w GROUP BY id")
def graph_levels(spark, sf_dir):
    return gr.levels(spark.createDataFrame(DAG, "src string, dst string"))


RANK_ROUNDS = 6


def _rank_sql() -> str:
    steps, last = [], "r0"
    for i in range(1, RANK_ROUNDS + 1):
        steps.append(f"r{i} AS (SELECT e.dst AS id, sum(r.weight / d.n) AS weight FROM e JOIN {last} r ON e.src = r.id JOIN d ON d.src = e.src GROUP BY 1)")
        last = f"r{i}"
    return f"""WITH b AS (SELECT DISTINCT src, dst FROM {_LINKS}), e AS (SELECT src, dst FROM b UNION ALL SELECT dst, src FROM b), d AS (SELECT src, count(*) AS n FROM e GROUP BY 1),
  r0 AS (SELECT src AS id, 1.0::DOUBLE AS weight FROM d), {", ".join(steps)} SELECT id, round(weight, 6) AS weight FROM {last}"""


@query(_rank_sql())
def pagerank(spark, sf_dir):
    """Six rounds, which is as far as the SQL goes; names are numbers on the way, which are cheaper to shuffle."""
    number = lambda c: (F.substring(c, 2, 20).cast("long") * 2 + (F.substring(c, 1, 1) == "s").cast("long")).alias(c)
    one_way = _links(spark, sf_dir).select(number("src"), number("dst")).distinct()
    both = gr.cut(one_way.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*"))
    ranks = gr.pagerank(both.select(F.col("src").alias("id")).distinct(), both, RANK_ROUNDS, 0)
    name = F.concat(F.when(F.col("id") % 2 == 0, "p").otherwise("s"), (F.col("id") / 2).cast("long").cast("string"))
    return ranks.select(name.alias("id"), F.round("weight", 6).alias("weight"))


# --- plans and streams -----------------------------------------------------------------


@query(f"SELECT event_id, CASE WHEN (epoch_us(ts) // 1000) < {SPLIT_MS} THEN upper(event_type) ELSE event_type || '_v2' END AS label FROM events")
def replace_operator(spark, sf_dir):
    rows = events(spark, sf_dir, "event_id", "ts", "event_type")
    return replace_processor(rows, SPLIT_MS, {"label": F.upper("event_type")}, {"label": F.concat("event_type", F.lit("_v2"))}).select("event_id", "label")


@query("SELECT c_nationkey AS k, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def json_flow(spark, sf_dir):
    plan = {
        "name": "nations",
        "processors": [{"name": "customers", "run": "read", "args": {"name": "customer", "key": "c_nationkey"}}, {"name": "suppliers", "run": "read", "args": {"name": "supplier", "key": "s_nationkey"}}, {"name": "count", "run": "count"}],
        "edges": [["customers", "count"], ["suppliers", "count"]],
    }
    registry = {
        "read": lambda name, key: lambda session: table(session, sf_dir, name, key).select(F.col(key).alias("k")),
        "count": lambda: lambda df: df.groupBy("k").agg(F.count(F.lit(1)).alias("n")),
    }
    return from_json(json.dumps(plan), registry).evaluate(spark)["count"]


@query("SELECT upper(n_name) AS line, count(*) AS n FROM nation GROUP BY 1")
def sink_processor(spark, sf_dir):
    """A flow that ends in a sink of text lines; what the sink wrote, and that as many rows went on."""
    place = _place(spark, "lines")
    names = Processor("names", lambda session: table(session, sf_dir, "nation", "n_name").select(F.upper("n_name").alias("value")))
    lines = sink("lines", lambda df: src.write_text(df, place))
    passed = Flow("names", Path(names).to(lines)).evaluate(spark)["lines"]
    written = spark.read.text(place).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))
    return written.join(passed.select(F.col("value").alias("line")).distinct(), "line")


def _plan_graph() -> Graph:
    return Graph(*(Path(a).to(b, f"{a}{b}") for a, b in DAG))


@query(f"""SELECT v AS id, (SELECT count(*) FROM {_DAG} WHERE dst = v) AS in_degree, (SELECT count(*) FROM {_DAG} WHERE src = v) AS out_degree,
  (SELECT count(*) FROM {_DAG} WHERE src = v OR dst = v) AS subgraph_edges FROM (SELECT DISTINCT unnest([src, dst]) AS v FROM {_DAG})""")
def plan_degrees(spark, sf_dir):
    graph = _plan_graph()
    rows = [(v, graph.in_degree(v), graph.out_degree(v), len(graph.subgraph(v).edges())) for v in graph.vertices()]
    return spark.createDataFrame(rows, "id string, in_degree long, out_degree long, subgraph_edges long")


@query(f"SELECT src, dst, true AS rises, false AS cycle, false AS doubled FROM {_DAG}")
def plan_order(spark, sf_dir):
    """Whether each edge leads on in the plan's topological order."""
    graph = _plan_graph()
    at = {v: i for i, v in enumerate(graph.topological_order())}
    rows = [(a, b, at[a] < at[b], graph.has_cycle(), graph.has_duplicated_edge()) for a, _, b in graph.edges()]
    return spark.createDataFrame(rows, "src string, dst string, rises boolean, cycle boolean, doubled boolean")


@query("SELECT * FROM (VALUES ('added', 'd'), ('modified', 'a'), ('impacted', 'c')) t(change, processor)")
def plan_diff(spark, sf_dir):
    def node(name: str, description: str = "") -> Processor:
        return Processor(name, lambda df: df, description=description)

    before = Flow("f", Path(node("a")).to(node("b")), Path(node("a")).to(node("c")))
    after = Flow("f", Path(node("a", "new")).to(node("b")), Path(node("a", "new")).to(node("c")).to(node("d")))
    rows = [(change, name) for change, names in diff(before, after).items() for name in sorted(names)]
    return spark.createDataFrame(rows, "change string, processor string")


def _place(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, or in a local one where the master is local."""
    import uuid

    return f"{gr.shared_dir(spark)}/sluice-{name}-{uuid.uuid4().hex}"


def _run(stream: DataFrame, place: str, mode: str, fail_at: int | None = None) -> str:
    """The stream until it has seen all that is there, each micro-batch a folder of its own in place/out; how it ended.  With ``fail_at`` that micro-batch
    fails after it is written."""
    import uuid

    from sluice.streaming import submit

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")
        if number == fail_at:
            raise RuntimeError("failed on purpose")

    writer = src.foreach_batch(stream, keep, f"{place}/checkpoint").outputMode(mode)
    return submit(f"stream_{uuid.uuid4().hex}", writer).wait()


def _stream(spark: SparkSession, sf_dir: str, name: str, build: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """All of the events through a stream that ends, and its result as a table."""
    place = _place(spark, name)
    stream = src.read_unbounded(spark, sf_dir, events(spark, sf_dir).schema, pathGlobFilter="events.parquet")
    if (status := _run(build(stream), place, mode)) != "succeeded":
        raise RuntimeError(status)
    return spark.read.parquet(f"{place}/out")


@query(f"SELECT event_type, {HOUR} AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_equals_batch(spark, sf_dir):
    def build(stream: DataFrame) -> DataFrame:
        return stream.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").alias("window_start"), "n")

    out = _stream(spark, sf_dir, "windows", build, "complete")
    last = out.agg(F.max("batch")).first()[0]
    return out.where(F.col("batch") == last).drop("batch")


@query("SELECT event_type, count(*) AS total FROM events GROUP BY 1")
def stateful_count(spark, sf_dir):
    from sluice.streaming import counting
    from sluice.streaming.stateful import STORE, use_rocksdb

    before = spark.conf.get(STORE)
    use_rocksdb(spark)
    try:
        out = _stream(spark, sf_dir, "counts", lambda s: counting(s.select("event_type"), "event_type"), "update")
    finally:
        spark.conf.set(STORE, before)
    return out.groupBy("event_type").agg(F.max_by("total", "batch").alias("total"))


@query("SELECT r AS id, r * 1000 AS ts_ms FROM range(100, (SELECT 100 + count(*) FROM nation)) t(r)")
def replayable_stream(spark, sf_dir):
    """The numbered source from second 100 on, in micro-batches of 10 rows, as far as there are nations."""
    src.register_replayable(spark)
    place = _place(spark, "replay")
    rows = 100 + table(spark, sf_dir, "nation").count()
    options = {"rows": rows, "start_ms": 100_000, "batch": 10, "parallelism": 2}
    stream = spark.readStream.format("sluice_replayable").options(**options).load()
    query = src.file_stream(stream, f"{place}/out", f"{place}/checkpoint").start()
    query.processAllAvailable()
    query.stop()
    return spark.read.schema("id long, ts_ms long").parquet(f"{place}/out")


@query(f"""WITH w AS (SELECT event_type, (epoch_us({HOUR}) // 1000) + 3600000 AS end_ms, sum({CENTS})::BIGINT AS total FROM events GROUP BY 1, 2)
SELECT * FROM w WHERE end_ms < (SELECT epoch_us(max(ts)) // 1000 FROM events)""")
def timer_flush(spark, sf_dir):
    """Hourly sums that a timer gives out once the watermark is past the hour; hours that aren't over give none."""
    from sluice.streaming import flush_by_timer
    from sluice.streaming.stateful import STORE, use_rocksdb

    before = spark.conf.get(STORE)
    use_rocksdb(spark)
    try:
        place = _place(spark, "timers")
        rows = events(spark, sf_dir, "ts", "event_type", "value")
        early = F.expr(f"ts < timestamp_ntz'{SPLIT_TS}'")
        for i, part_of in enumerate((early, ~early)):
            rows.where(part_of).write.parquet(f"{place}/in/part={i}")
            stream = src.read_unbounded(spark, f"{place}/in/part=*", rows.schema, ts_col="ts").withColumn("cents", fn.cents(F.col("value")))
            if (status := _run(flush_by_timer(stream.select("ts", "event_type", "cents"), "event_type", "cents", 3_600_000), place, "append")) != "succeeded":
                raise RuntimeError(status)
    finally:
        spark.conf.set(STORE, before)
    return spark.read.parquet(f"{place}/out").drop("batch")


_LATE = f"event_id % 50 = 0 AND ts < TIMESTAMP '{SPLIT_TS}'"


@query(f"""WITH seen AS (SELECT * FROM events WHERE NOT ({_LATE})), w AS (SELECT event_type, {HOUR} AS window_start, count(*) AS n FROM seen GROUP BY 1, 2)
SELECT * FROM w WHERE window_start + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM seen)""")
def late_rows(spark, sf_dir):
    """Hourly counts of a stream that starts again after each of three parts: a window is out once, when the watermark has passed its end, and rows that
    come after that (the last part) count nowhere."""
    place = _place(spark, "late")
    rows = events(spark, sf_dir, "event_id", "ts", "event_type")
    late, early = F.expr(_LATE.replace("TIMESTAMP", "timestamp_ntz")), F.expr(f"ts < timestamp_ntz'{SPLIT_TS}'")
    for i, part_of in enumerate((early & ~late, ~early, late)):
        rows.where(part_of).write.parquet(f"{place}/in/part={i}")
        stream = src.read_unbounded(spark, f"{place}/in/part=*", rows.schema, ts_col="ts")
        counts = stream.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
        if (status := _run(counts.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n"), place, "append")) != "succeeded":
            raise RuntimeError(status)
    return spark.read.parquet(f"{place}/out").drop("batch")


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1")
def restart_exactly_once(spark, sf_dir):
    """Rows of a stream whose second micro-batch fails after it was written, and which is started again from its checkpoint: each counts once."""
    place = _place(spark, "restart")
    rows = events(spark, sf_dir, "event_id", "ts", "event_type")
    early = F.expr(f"ts < timestamp_ntz'{SPLIT_TS}'")
    ends = []
    for i, (part_of, fail_at) in enumerate(((early, None), (~early, 1), (None, None))):
        if part_of is not None:
            rows.where(part_of).write.parquet(f"{place}/in/part={i}")
        stream = src.read_unbounded(spark, f"{place}/in/part=*", rows.schema)
        ends.append(_run(stream.select("event_id", "event_type"), place, "append", fail_at))
    if ends != ["succeeded", "failed", "succeeded"]:
        raise RuntimeError(str(ends))
    return spark.read.parquet(f"{place}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
