"""Sources, filters, metrics, graphs, policies, encryption and generators."""

import pytest
from pyspark.sql import functions as F

from tidemill.functions import secure
from tidemill.operators import metrics, policy, relational, topology, window_join
from tidemill.schemas import RELATIONS, schema
from tidemill.sources import generators, readers


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


SCHEMA = schema("a bigint, b string, c double")


def test_short_rows_are_skipped_wherever_they_stand(spark, rows, tmp_path):
    (tmp_path / "x.tbl").write_text("1|x|1.5|\n2|y\n3||\n4|z|q|\n")
    got = readers.delimited(spark, str(tmp_path / "x.tbl"), SCHEMA, columns=["b", "a"])
    assert rows(got) == [("", 3), ("x", 1), ("z", 4)]
    assert rows(readers.parse(lines(spark, "5,k"), SCHEMA, ",", mode="pad", pad="N/A"), "a", "b", "c") == [(5, "k", None)]
    with pytest.raises(ValueError):
        readers.parse(lines(spark, "x"), SCHEMA, columns=["zz"])


def test_padded_text_and_records(spark, rows):
    text = schema("one string, two string, three string")
    assert rows(readers.parse(lines(spark, "1,2", "1,2,3,4"), text, ",", mode="pad", pad="N/A")) == [("1", "2", "3"), ("1", "2", "N/A")]
    rec = schema("provider string, name string, tags string")
    assert rows(readers.records(lines(spark, "Ann//$$$//pln DET"), rec, provider="p1")) == [("p1", "Ann", "pln DET")]


def test_relations_have_the_star_columns():
    from tidemill.schemas import STAR_COLUMNS

    assert all(set(c) <= set(RELATIONS[t].names) for t, c in STAR_COLUMNS.items())


def test_provider_records_and_configuration(spark, rows):
    got = readers.provider_records(lines(spark, "id|name", "{1|Ann|pln|DET}", "2|Bob", "short"), ["id", "name"], header="id|name")
    assert rows(got) == [("1", "Ann", "pln DET pln pln pln"), ("2", "Bob", "pln pln pln pln pln")]
    assert rows(readers.config_rows(lines(spark, "policy;a, b", "none"))) == [("policy", ["a", "b"])]


def test_arrival_times(spark):
    df = spark.range(1, 7).select(readers.arrival_ms(F.col("id"), [2.0, 4.0], [0.0, 1.0]).alias("t")).orderBy("t")
    assert [r.t for r in df.collect()] == [500.0, 1000.0, 1250.0, 1500.0, 1750.0, 2000.0]


def test_filters(spark, rows):
    df = spark.createDataFrame([(1, "Captain", "7"), (2, "CAPTAIN", "x"), (3, None, "9")], "id int, name string, n string")
    assert rows(relational.select_where(df, "name", "eq", "captain", ["id"])) == [(1,), (2,)]
    assert rows(relational.select_where(df, "n", "ge", 7, ["id"])) == [(1,), (3,)]
    assert len(rows(relational.select_where(df, "name", "eq", "*"))) == 3
    assert relational.project(df, ["id", "id"]).columns == ["id", "id_2"]
    with pytest.raises(ValueError):
        relational.project(df, ["zz"])


def test_column_order_rule():
    assert window_join.ordered_columns("order", ["o"], "lineitem", ["l"]) == ["l", "o"]


def test_metric_log(spark, rows):
    log = lines(spark, "d\t1\ts1:6700\t4:join\tlatency\t2.5", "bad line", "d\t2\ts1:6700\t4:join\tlatency\t3.5")
    parsed = metrics.parse_metric_log(log)
    assert rows(metrics.metric_avg(parsed.withColumn("value", F.col("value").cast("double")), "task", "metric", "value")) == [("join", "latency", 3.0)]
    assert rows(metrics.extract_series(lines(spark, "x latency=3.5 input-rate: 7"))) == [("input_rate", 7.0), ("latency", 3.5)]


def test_disorder_and_clocks(spark, rows):
    df = spark.createDataFrame([("a", 1, 100, 1100), ("a", 2, 50, 1060), ("a", 3, 5000, 6000)], "k string, i int, ms bigint, remote bigint")
    assert rows(metrics.disorder(df, "k", "i", "ms")) == [("a", 1, 1, 1)]
    assert rows(metrics.clock_free_latency(df, "k", "i", "ms", "remote")) == [("a", 10.0)]


def test_topology(spark, rows):
    text = "a:j1,j2;b:j1,j2;j1:z;j2:z;z:"
    edges = topology.parse(spark, text)
    assert topology.serialise(edges) == text
    assert rows(topology.inverse(edges)) == [("a", ""), ("b", ""), ("j1", "a,b"), ("j2", "a,b"), ("z", "j1,j2")]
    assert rows(topology.layers(edges)) == [("a,b", "z", "j1,j2")]
    assert rows(topology.minimal_active(edges)) == [("a",), ("b",), ("j1",), ("z",)]


def test_policies(spark, rows):
    log = lines(spark, "SPS,s,2,p,f,k1", "data", "SPS,s,x,p,f,k2", "SPS,short")
    data, rules = policy.split_punctuations(log)
    assert rows(data) == [("data",)]
    assert rows(policy.parse_punctuations(rules), "permission", "key") == [(2, "k1"), (None, "k2")]
    facts = spark.createDataFrame([("p", 5, "v5"), ("p", 20, "v20"), ("q", 9, "v9")], "provider string, ms bigint, v string")
    valid = spark.createDataFrame([("p", 10, 2), ("p", 15, 0)], "provider string, ms bigint, permission int")
    now = policy.in_force(facts, valid, ["provider"], "ms", "ms", "permission")
    assert rows(now, "provider", "v", "permission") == [("p", "v20", 0), ("p", "v5", None), ("q", "v9", None)]


def test_deterministic_encryption(spark, rows):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "v string").select("v", secure.det_encrypt(F.col("v"), "0123456789abcdef").alias("c"))
    assert df.select("c").distinct().count() == 3
    assert all(r.v == r.p for r in df.select("v", secure.det_decrypt(F.col("c"), "0123456789abcdef").alias("p")).collect())


def test_paillier(spark, rows):
    key = secure.Paillier.generate(128, seed=1)
    assert key.decrypt(key.encrypt(-7) * key.encrypt(3) % key.n**2) == -4
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate([5, -2, None, 7, 1, 8])], "g bigint, v bigint").select("g", secure.paillier_encrypt(key, 3)("v").alias("c"))
    got = secure.paillier_sum(df, "g", "c", key).select("g", secure.paillier_decrypt(key)("product").alias("s"))
    assert rows(got) == [(0, "12"), (1, "-1"), (2, "8")]


def test_generators(spark, rows):
    assert generators.balanced(spark, 5, 2).collect()[-1] == ("1", 5)
    share = generators.phases(spark, 100).groupBy("phase").agg(F.count_if(F.col("key") == "1").alias("n"))
    assert rows(share) == [(0, 95), (1, 50), (2, 5), (3, 50)]
    df = spark.createDataFrame([(i,) for i in range(4)], "id bigint")
    assert [r[0] for r in generators.expand(df, "id", 2.25).orderBy("copy_id").collect()] == [0, 1, 2, 3, 0, 1, 2, 3, 0]
