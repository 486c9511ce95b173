"""Streaming forms against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions import secure
from tidemill.operators import aggregates, policy, window_join
from tidemill.sources import readers
from tidemill.streaming import sinks, stateful, windows


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def stream(spark, tmp_path, data, ddl, files=3):
    df = spark.createDataFrame(data, ddl)
    path = str(tmp_path / "in")
    n = -(-len(data) // files)
    for i in range(files):
        spark.createDataFrame(data[i * n : (i + 1) * n], ddl).coalesce(1).write.mode("append").parquet(path)
    return df, readers.parquet_stream(spark, path, df.schema, files_per_trigger=1)


EVENTS = [(i, f"2024-01-01 00:00:{i // 2 % 60:02d}.{i % 2 * 500:03d}", i % 4, "lr"[i % 3 % 2], i * 37 % 50) for i in range(90)]
DDL = "id bigint, at string, k int, side string, v bigint"


def both(spark, tmp_path):
    batch, live = stream(spark, tmp_path, EVENTS, DDL)
    at = F.col("at").cast("timestamp_ntz")
    b = batch.select("id", "k", "side", "v", at.alias("at")).withColumn("ms", F.unix_millis(F.col("at").cast("timestamp")))
    return b, windows.event_time(live.select("id", "k", "side", "v", at.alias("at")), "at", "1 hour")


def test_sliding_join_equals_batch(spark, tmp_path, rows):
    batch, live = both(spark, tmp_path)
    t0 = batch.agg(F.min("ms")).first()[0]
    expected = window_join.symmetric_sliding_join(batch.filter("side = 'l'"), batch.filter("side = 'r'"), "k", "ms", "id", 5000, 1000)
    got = windows.symmetric_sliding_join(live.filter("side = 'l'"), live.filter("side = 'r'"), "k", "id", 5000, 1000, t0)
    assert rows(run(got.select("l_id", "r_id"), "sym")) == rows(expected, "l_id", "r_id")


def test_theta_join_equals_batch(spark, tmp_path, rows):
    batch, live = both(spark, tmp_path)
    t0 = batch.filter("side = 'l'").agg(F.min("ms")).first()[0]
    expected = window_join.sliding_theta_join(batch.filter("side = 'l'"), batch.filter("side = 'r'"), "lt", "v", "ms", "id", 5000, 1000)
    got = windows.sliding_theta_join(live.filter("side = 'l'"), live.filter("side = 'r'"), "lt", "v", "id", 5000, 1000, t0)
    assert rows(run(got.select("l_id", "r_id"), "theta")) == rows(expected, "s_id", "p_id")


def test_hopping_and_running_counts(spark, tmp_path, rows):
    batch, live = both(spark, tmp_path)
    got = run(windows.hopping_group_count(live, "k", 4000, 2000), "hop", "complete")
    expected = batch.groupBy(F.window(F.col("at").cast("timestamp"), "4 seconds", "2 seconds").alias("w"), "k").count().select("k", F.unix_millis("w.start"), "count")
    assert rows(got) == rows(expected)


def test_stateful_count_windows(spark, tmp_path, rows):
    batch, live = stream(spark, tmp_path, EVENTS, DDL)
    sums, seen = {}, {}
    for i, _, k, _, v in EVENTS:
        seen.setdefault(k, []).append(v)
    for k, vs in seen.items():
        for b in range(len(vs) // 5):
            sums[k, b] = sum(vs[5 * b : 5 * b + 5])
    assert rows(run(stateful.tumbling_sum(live, "k", "id", "v", 5), "tumble")) == sorted(((k, b, s) for (k, b), s in sums.items()), key=repr)


def test_stateful_join_and_bounded_groups(spark, tmp_path, rows):
    _, live = stream(spark, tmp_path, EVENTS, DDL)
    held, expected = {}, []
    for i, _, k, side, _ in EVENTS:
        h = held.setdefault(k, {"l": [], "r": []})
        expected += [(k, i, o) if side == "l" else (k, o, i) for o in h["r" if side == "l" else "l"]]
        h[side] = [*h[side], i][-3:]
    assert rows(run(stateful.count_window_join(live, "k", "id", "side", 3), "cwj")) == sorted(expected, key=repr)
    names, counts, want = [], [], []
    for i, _, k, _, _ in EVENTS:
        if str(k) not in names:
            names.append(str(k))
            counts.append(0)
            if len(names) > 3:
                names.pop(0), counts.pop(0)
        counts[names.index(str(k))] += 1
        want.append((i, str(k), counts[names.index(str(k))]))
    one = live.select(F.lit(0).alias("s"), "id", F.col("k").cast("string").alias("k"))
    assert rows(run(stateful.bounded_group_count(one, "s", "k", "id", 2), "bounded"), "id", "k", "n") == sorted(want, key=repr)


def test_progress_log_and_metric_lines(spark, tmp_path):
    out = []
    log = sinks.ProgressLog(out.append, every=0)
    spark.streams.addListener(log)
    _, live = stream(spark, tmp_path, EVENTS, DDL)
    run(live.select("id"), "plain")
    spark.streams.removeListener(log)
    df = spark.createDataFrame([("t1", 1, "latency", 2.0)], "task string, ts bigint, metric string, value double")
    sinks.metric_lines(df, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m")).count() == 1


def test_one_sided_join_equals_batch(spark, tmp_path, rows):
    batch, live = both(spark, tmp_path)
    t0 = batch.filter("side = 'l'").agg(F.min("ms")).first()[0]
    expected = window_join.sliding_equi_join(batch.filter("side = 'l'"), batch.filter("side = 'r'"), "k", "ms", "id", 5000, 999)
    got = windows.sliding_equi_join(live.filter("side = 'l'"), live.filter("side = 'r'"), "k", "id", 5000, 999, t0)
    assert rows(run(got.select("l_id", "r_id"), "one")) == rows(expected, "s_id", "p_id")
    with pytest.raises(ValueError):
        windows.sliding_equi_join(live, live, "k", "id", 5000, 1300, t0)


def test_sliding_group_count_equals_batch(spark, tmp_path, rows):
    batch, live = both(spark, tmp_path)
    t0 = batch.agg(F.min("ms")).first()[0]
    for window, slide in ((5000, 1000), (4000, 1300)):
        expected = aggregates.sliding_group_count(batch, "k", "ms", "id", window, slide)
        got = stateful.sliding_group_count(live.drop("ts"), "k", "ms", "id", window, slide, t0)
        assert rows(run(got, f"sgc{slide}"), "id", "k", "ms", "n") == rows(expected, "id", "k", "ms", "n")


def test_side_window_equals_batch(spark, tmp_path, rows):
    batch, live = stream(spark, tmp_path, EVENTS, DDL)
    expected = window_join.count_window_join(batch.filter("side = 'l'").select("id", "k"), batch.filter("side = 'r'").select("id", "k"), "k", "id", 7)
    got = stateful.side_window_join(live.withColumn("s", F.lit("only")), "s", "k", "id", "side", 7)
    assert rows(run(got, "side"), "k", "l_order", "r_order") == rows(expected, "key", "l_id", "r_id")


def test_tumbling_windows_equal_batch(spark, tmp_path, rows):
    batch, live = stream(spark, tmp_path, EVENTS, DDL)
    one = live.withColumn("s", F.lit("only"))
    expected = aggregates.tumbling_count_if(batch, "id", 8, "v", "lt", 25)
    assert rows(run(stateful.tumbling_count_if(one, "s", "id", F.col("v") < 25, 8), "tci"), "block", "n") == rows(expected, "block", "n")
    key = secure.Paillier.generate(128, seed=3)
    cipher = {v: str(key.encrypt(v, random.Random(v))) for v in range(50)}
    coded = F.create_map(*[F.lit(x) for kv in cipher.items() for x in kv])[F.col("v")]
    got = run(stateful.tumbling_product(one.withColumn("c", coded), "s", "id", "c", 8, key.n**2), "prod").collect()
    sums = aggregates.tumbling_sum(batch, "id", 8, F.col("v"))
    assert sorted(((r.block, key.decrypt(int(r.product))) for r in got), key=repr) == rows(sums, "block", "total")


def test_policies_in_force_on_a_stream(spark, tmp_path, rows):
    data = [(i, i % 3, i % 7 == 0, i * 5 % 11 if i % 7 == 0 else None) for i in range(60)]
    _, live = stream(spark, tmp_path, data, "id bigint, k int, sps boolean, t bigint")
    now, want = {}, []
    for i, k, sps, t in data:
        if sps:
            now[k] = t
        else:
            want.append((i, k, now.get(k)))
    assert rows(run(stateful.in_force(live, "k", "id", "sps", "t"), "force"), "id", "k", "t") == sorted(want, key=repr)


def test_punctuations_on_a_stream(spark, tmp_path, rows):
    lines = [(f"SPS,s,{i % 5},p,f,k" if i % 4 == 0 else f"{i},x",) for i in range(40)]
    _, live = stream(spark, tmp_path, lines, "value string")
    data, policies = policy.split_punctuations(live)
    assert run(data, "data").count() == 30
    assert [r[0] for r in rows(run(policy.parse_punctuations(policies).select("permission"), "pol"))] == sorted(i % 5 for i in range(0, 40, 4))


def test_metadata_tables(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/meta;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    sinks.to_jdbc(url, "things", **driver)(first, 0)
    sinks.upsert_jdbc(url, "things", ["id"], **driver)(spark.createDataFrame([(2, "c"), (3, "d")], "id int, name string"))
    look = lambda t: sorted(tuple(r) for r in sinks.from_jdbc(spark, url, t, **driver).collect())
    assert look("things") == [(1, "a"), (2, "c"), (3, "d")]
    config = readers.config_rows(spark.createDataFrame([("provider;x, y",), ("policy;0:A:B,1:C:D,bad",), ("attribute;q",), ("noise",)], "value string"))
    for _ in range(2):  # loading again empties the tables first
        sinks.load_config(config, url, **driver)
    assert look("data_provider") == [(0, "x"), (1, "y")] and look("policy") == [(0, "A,B"), (1, "C,D")] and look("attribute") == [(0, "q")]
