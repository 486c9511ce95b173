"""Named queries over the test tables, each with DuckDB SQL for the same rows.

Arrival order is ``event_id``; times are epoch milliseconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import secure
from ..operators import aggregates, metrics, policy, relational, topology, window_join
from ..operators.sequencing import millis, with_sequence
from ..sources import generators, readers
from ..sources.readers import parquet
from . import star

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

HOUR = 3_600_000
W, S = 6 * HOUR, HOUR
#: A window whose ring of buckets ends before the window does.
W_CAPPED, S_CAPPED = 6_000_000, 1_860_000
#: Ten operators: four sources, three dispatchers, three joins.
GRAPH = (
    "customer:disp_co;order:disp_co;lineitem:disp_ls;supplier:disp_ls;disp_co:join_co;disp_ls:join_ls;join_co:disp_final;join_ls:disp_final;disp_final:join_final;join_final:"
)
KEY = "0123456789abcdef"
TAGS = {"view": "pln", "click": "DET RND", "purchase": "HOM DET", "signup": "OPE", "error": "pln zzz"}

_E = "e AS (SELECT event_id, user_id, event_type, value, CAST(floor(value) AS BIGINT) AS v, CAST(floor(value * 100) AS BIGINT) AS cents, epoch_us(ts) // 1000 AS ms FROM events)"


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    e = parquet(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", F.floor("value").cast("bigint").alias("v"), F.floor(F.col("value") * 100).cast("bigint").alias("cents"), millis("ts").alias("ms")
    )
    return e.filter(F.col("event_type").isin(*types)) if types else e


# -- projection and filters ----------------------------------------------------------------
@query("SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) // 1000 AS order_ms FROM orders")
def project_orders(spark, d):
    o = relational.project(parquet(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderdate"])
    return o.select("o_orderkey", "o_custkey", millis("o_orderdate").alias("order_ms"))


@query("SELECT event_id, event_type FROM events WHERE lower(event_type) = lower('CLICK')")
def filter_eq_ci(spark, d):
    return relational.filter_equal(parquet(spark, d, "events"), "event_type", "CLICK", relational.ignore_case).select("event_id", "event_type")


for _op, _sign in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    query(f"SELECT p_partkey, p_size FROM part WHERE p_size {_sign} 25", f"select_{_op}")(lambda spark, d, op=_op: relational.select_where(parquet(spark, d, "part"), "p_size", op, 25, ["p_partkey", "p_size"]))
query("SELECT event_id, user_id FROM events WHERE lower(event_type) = 'signup'", "select_eq")(lambda spark, d: relational.select_where(parquet(spark, d, "events"), "event_type", "eq", "SignUp", ["event_id", "user_id"]))
query("SELECT p_partkey, p_size FROM part", "select_any")(lambda spark, d: relational.select_where(parquet(spark, d, "part"), "p_size", "eq", "*", ["p_partkey", "p_size"]))


@query("SELECT event_id, event_type || '!!!' AS word FROM events")
def exclaim_words(spark, d):
    return relational.exclaim(parquet(spark, d, "events", ["event_id", "event_type"]), "event_type", "word").select("event_id", "word")


# -- plain joins --------------------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, l_suppkey, o_orderkey, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def order_lineitem_join(spark, d):
    return star.order_lineitem(spark, d)


_CORE = "customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey"


@query(f"SELECT c_custkey, c_nationkey, o_orderkey, epoch_us(o_orderdate) // 1000 AS order_ms, l_extendedprice, l_discount, s_suppkey, s_nationkey FROM {_CORE}")
def q5_join_core(spark, d):
    return star.star_core(spark, d).select("c_custkey", "c_nationkey", "o_orderkey", millis("o_orderdate").alias("order_ms"), "l_extendedprice", "l_discount", "s_suppkey", "s_nationkey")


@query(f"""SELECT n_name, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round((1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS revenue_e4
FROM {_CORE} JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_nationkey = s_nationkey AND r_name = 'ASIA' GROUP BY n_name""")
def q5_revenue(spark, d):
    return star.local_revenue(spark, d)


def _paced(name: str, table: str, columns: str, order: str, source: int, sources: int = 4) -> str:
    """A relation of a paced source: 1000 rows a second, so the arrival time is the row number."""
    return f"{name} AS (SELECT {columns}, ms, ms * {sources} + {source} AS arrival FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS ms FROM {table}))"


def _windowed(name: str, left: str, right: str, on: str, columns: str, w: int = star.WINDOW, s: int = star.SLIDE) -> str:
    """Relations ``name``: pairs of x of ``left`` and y of ``right`` whose earlier row is in the ring at the later one."""
    first = f"(SELECT min(ms) FROM (SELECT ms FROM {left} UNION ALL SELECT ms FROM {right}))"
    b = lambda x: f"(({x}.ms - {first}) // {s + 1})"
    alive = lambda x, y: f"{x}.arrival < {y}.arrival AND {first} + {b(x)} * {s + 1} + {w} > {y}.ms AND {b(y)} - {b(x)} < {w // s}"
    return f"{name} AS (SELECT {columns}, greatest(x.ms, y.ms) AS ms, greatest(x.arrival, y.arrival) AS arrival FROM {left} x JOIN {right} y ON {on} WHERE ({alive('x', 'y')}) OR ({alive('y', 'x')}))"


_ORDER_LINE = ", ".join((
    _paced("o", "orders", "o_orderkey, o_custkey", "o_orderkey", 0, 2),
    _paced("l", "lineitem", "l_orderkey, l_linenumber, l_suppkey", "l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice", 1, 2),
    _windowed("ol", "o", "l", "o_orderkey = l_orderkey", "o_orderkey, o_custkey, l_orderkey, l_linenumber, l_suppkey"),
))


@query(f"WITH {_ORDER_LINE} SELECT l_orderkey, l_linenumber, l_suppkey, o_orderkey, o_custkey, ms FROM ol")
def order_lineitem_windowed(spark, d):
    return star.order_lineitem_windowed(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", "o_orderkey", "o_custkey", "ms")


_CORE_WINDOWED = ", ".join((
    _paced("c", "customer", "c_custkey, c_nationkey", "c_custkey", 0),
    _paced("o", "orders", "o_orderkey, o_custkey, o_orderdate", "o_orderkey", 1),
    _paced("l", "lineitem", "l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_discount", "l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice", 2),
    _paced("s", "supplier", "s_suppkey, s_nationkey", "s_suppkey", 3),
    _windowed("co", "c", "o", "c_custkey = o_custkey", "c_custkey, c_nationkey, o_orderkey, o_orderdate"),
    _windowed("ls", "l", "s", "l_suppkey = s_suppkey", "l_orderkey, l_linenumber, l_extendedprice, l_discount, s_suppkey, s_nationkey"),
    _windowed("core", "co", "ls", "o_orderkey = l_orderkey", "c_custkey, c_nationkey, o_orderkey, l_linenumber, l_extendedprice, l_discount, s_suppkey, s_nationkey"),
))


@query(f"WITH {_CORE_WINDOWED} SELECT c_custkey, c_nationkey, o_orderkey, l_linenumber, l_extendedprice, l_discount, s_suppkey, s_nationkey, ms FROM core")
def q5_join_core_windowed(spark, d):
    return star.star_core_windowed(spark, d).select("c_custkey", "c_nationkey", "o_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "s_suppkey", "s_nationkey", "ms")


@query(f"""WITH {_CORE_WINDOWED} SELECT n_name, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round((1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS revenue_e4
FROM core JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_nationkey = s_nationkey AND r_name = 'ASIA' GROUP BY n_name""")
def q5_revenue_windowed(spark, d):
    return star.local_revenue_windowed(spark, d)


# -- sliding-window joins -------------------------------------------------------------------
_RING = "t AS (SELECT min(ms) AS t0 FROM e WHERE event_type IN ({types})), b AS (SELECT e.*, t0, (ms - t0) // {s1} AS b, t0 + (ms - t0) // {s1} * {s1} AS start FROM e, t)"
_VIEW_CLICK = "'view', 'click'"


def _alive(w: int, s: int, x: str, y: str) -> str:
    return f"{x}.event_id < {y}.event_id AND {x}.start + {w} > {y}.ms AND {y}.b - {x}.b < {w // s}"


@query(f"""WITH {_E}, {_RING.format(types="'view'", s1=S + 1)}
SELECT x.user_id AS key, x.event_id AS s_event_id, y.event_id AS p_event_id FROM b x JOIN b y ON x.user_id = y.user_id AND {_alive(W, S, "x", "y")}
WHERE x.event_type = 'view' AND y.event_type = 'click'""")
def sliding_equi_join_one_sided(spark, d):
    out = window_join.sliding_equi_join(events(spark, d, "view"), events(spark, d, "click"), "user_id", "ms", "event_id", W, S)
    return out.select("key", "s_event_id", "p_event_id")


@query(f"""WITH {_E}, {_RING.format(types="'view'", s1=S_CAPPED + 1)},
n AS (SELECT *, max(CASE WHEN event_type = 'view' THEN b END) OVER (ORDER BY event_id) AS newest FROM b)
SELECT x.user_id AS key, x.event_id AS s_event_id, y.event_id AS p_event_id FROM n x JOIN n y
ON x.user_id = y.user_id AND x.event_id < y.event_id AND x.start + {W_CAPPED} > y.ms AND y.newest - x.b < {W_CAPPED // S_CAPPED}
WHERE x.event_type = 'view' AND y.event_type = 'click'""")
def sliding_equi_join_capped(spark, d):
    out = window_join.sliding_equi_join(events(spark, d, "view"), events(spark, d, "click"), "user_id", "ms", "event_id", W_CAPPED, S_CAPPED)
    return out.select("key", "s_event_id", "p_event_id")


@query(f"""WITH {_E}, {_RING.format(types=_VIEW_CLICK, s1=S + 1)}, p AS (
  SELECT x.user_id AS key, x.event_id AS l_event_id, y.event_id AS r_event_id FROM b x JOIN b y ON x.user_id = y.user_id AND {_alive(W, S, "x", "y")} WHERE x.event_type = 'view' AND y.event_type = 'click'
  UNION ALL SELECT x.user_id, y.event_id, x.event_id FROM b x JOIN b y ON x.user_id = y.user_id AND {_alive(W, S, "x", "y")} WHERE x.event_type = 'click' AND y.event_type = 'view')
SELECT * FROM p""")
def sliding_equi_join_symmetric(spark, d):
    out = window_join.symmetric_sliding_join(events(spark, d, "view"), events(spark, d, "click"), "user_id", "ms", "event_id", W, S)
    return out.select("key", "l_event_id", "r_event_id")


@query(f"""WITH {_E}, {_RING.format(types=_VIEW_CLICK, s1=S + 1)},
k AS (SELECT * FROM b WHERE event_type IN ({_VIEW_CLICK}) QUALIFY row_number() OVER (PARTITION BY event_type, user_id, b, v // 50 ORDER BY event_id) = 1)
SELECT x.user_id AS key, CASE WHEN x.event_type = 'view' THEN x.event_id ELSE y.event_id END AS l_event_id, CASE WHEN x.event_type = 'view' THEN y.event_id ELSE x.event_id END AS r_event_id
FROM k x JOIN b y ON x.user_id = y.user_id AND {_alive(W, S, "x", "y")} WHERE x.event_type <> y.event_type AND y.event_type IN ({_VIEW_CLICK})""")
def sliding_equi_join_dedup(spark, d):
    side = lambda t: events(spark, d, t).select("event_id", "user_id", "ms", F.floor(F.col("v") / 50).alias("v"))
    out = window_join.symmetric_sliding_join(side("view"), side("click"), "user_id", "ms", "event_id", W, S, dedup=True)
    return out.select("key", "l_event_id", "r_event_id")


for _op, _sign in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    query(
        f"""WITH {_E}, {_RING.format(types="'purchase'", s1=HOUR // 6 + 1)}
SELECT x.event_id AS s_event_id, y.event_id AS p_event_id FROM b x JOIN b y ON {_alive(HOUR, HOUR // 6, "x", "y")} AND x.v {_sign} y.v WHERE x.event_type = 'purchase' AND y.event_type = 'click'""",
        f"sliding_theta_join_{_op}",
    )(lambda spark, d, op=_op: window_join.sliding_theta_join(events(spark, d, "purchase"), events(spark, d, "click"), op, "v", "ms", "event_id", HOUR, HOUR // 6).select("s_event_id", "p_event_id"))


# -- count-window joins ------------------------------------------------------------------------
def _count_sql(rel: str, n: int) -> str:
    return f"""q AS (SELECT *, sum(CAST(side = 0 AS INT)) OVER (ORDER BY event_id) AS nl, sum(CAST(side = 1 AS INT)) OVER (ORDER BY event_id) AS nr FROM {rel}),
j AS (SELECT l.key, l.event_id AS l_event_id, r.event_id AS r_event_id FROM q l JOIN q r ON l.side = 0 AND r.side = 1 AND l.key = r.key
  AND ((l.event_id < r.event_id AND l.nl > r.nl - {n}) OR (r.event_id < l.event_id AND r.nr > l.nr - {n})))"""


@query(f"WITH {_E}, r AS (SELECT event_id, user_id AS key, CAST(event_type = 'click' AS INT) AS side FROM e WHERE event_type IN ({_VIEW_CLICK})), {_count_sql('r', 200)} SELECT * FROM j")
def count_window_join(spark, d):
    side = lambda t: events(spark, d, t).select("event_id", "user_id")
    return window_join.count_window_join(side("view"), side("click"), "user_id", "event_id", 200)


@query("""WITH q AS (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) AS seq FROM events)
SELECT a.user_id AS key, a.event_id AS a_order, b.event_id AS b_order FROM q a JOIN q b ON a.user_id = b.user_id AND a.seq < b.seq AND a.seq >= b.seq - 500""")
def self_count_join(spark, d):
    return window_join.self_count_join(parquet(spark, d, "events", ["event_id", "user_id"]), "user_id", "event_id", 500)


@query("""WITH q AS (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) AS seq FROM events)
SELECT y.user_id AS key, y.event_id AS l_order, x.event_id AS r_order FROM q x JOIN q y ON x.user_id = y.user_id AND x.seq BETWEEN y.seq - 200 AND y.seq - 1
UNION ALL SELECT y.user_id, x.event_id, y.event_id FROM q x JOIN q y ON x.user_id = y.user_id AND x.seq BETWEEN y.seq - 199 AND y.seq""")
def stream_self_join(spark, d):
    return window_join.stream_self_join(parquet(spark, d, "events", ["event_id", "user_id"]), "user_id", "event_id", 200)


@query(f"""WITH {_E}, r AS (SELECT event_id, 'u' || user_id AS key, CAST(event_type = 'click' AS INT) AS side FROM e WHERE (event_type = 'view' AND trunc(value) > 50) OR event_type = 'click'),
{_count_sql('r', 100)} SELECT * FROM j""")
def select_join_client(spark, d):
    left = relational.select_where(events(spark, d, "view"), "value", "gt", 50).select("event_id", F.concat(F.lit("U"), "user_id").alias("name"))
    right = relational.select_where(events(spark, d), "event_type", "eq", "CLICK").select("event_id", F.concat(F.lit("u"), "user_id").alias("name"))
    return window_join.count_window_join(left, right, "name", "event_id", 100, relational.ignore_case)


# -- aggregates ----------------------------------------------------------------------------------
@query("SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events")
def running_count(spark, d):
    return aggregates.running_count(parquet(spark, d, "events", ["event_id"]), "event_id").select("event_id", "n")


@query(f"WITH {_E} SELECT event_id, CAST(sum(cents) OVER (ORDER BY event_id) AS BIGINT) AS total FROM e")
def running_sum(spark, d):
    return aggregates.running_sum(events(spark, d), "event_id", F.col("cents")).select("event_id", "total")


@query("SELECT event_id, first_value(event_type) OVER (PARTITION BY lower(event_type) ORDER BY event_id) AS key, count(*) OVER (PARTITION BY lower(event_type) ORDER BY event_id) AS n FROM events")
def group_running_count(spark, d):
    return aggregates.group_running_count(parquet(spark, d, "events", ["event_id", "event_type"]), ["event_type"], "event_id")


def _group_count_sql(types: str) -> str:
    return f"""WITH e0 AS (SELECT * FROM events WHERE event_type IN ({types})), {_E.replace("FROM events", "FROM e0")}, {_RING.format(types=types, s1=S + 1)}
SELECT y.event_id, y.user_id, y.ms, count(*) AS n FROM b x JOIN b y ON x.user_id = y.user_id AND x.event_id <= y.event_id AND x.start + {W} > y.ms AND y.b - x.b < {W // S} GROUP BY ALL"""


_ALL_TYPES = "'view', 'click', 'purchase', 'signup', 'error'"


@query(_group_count_sql(_ALL_TYPES))
def sliding_group_count(spark, d):
    return aggregates.sliding_group_count(events(spark, d), "user_id", "ms", "event_id", W, S)


@query(f"WITH {_E} SELECT event_id, user_id, ms, count(*) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS n FROM e")
def sliding_group_count_range(spark, d):
    return aggregates.sliding_group_count_range(events(spark, d), "user_id", "ms", "event_id", W)


@query(f"""WITH {_E}, w AS (SELECT user_id, ms // {S} - unnest(range(0, {W // S})) AS k FROM e) SELECT user_id, k * {S} AS window_start, count(*) AS n FROM w GROUP BY ALL""")
def hopping_group_count(spark, d):
    return aggregates.hopping_group_count(events(spark, d), "user_id", "ms", W, S)


@query(_group_count_sql(_VIEW_CLICK))
def union_group_count(spark, d):
    return aggregates.sliding_group_count(relational.union_all(events(spark, d, "view"), events(spark, d, "click")), "user_id", "ms", "event_id", W, S)


def _blocks(n: int, value: str, rel: str = "e") -> str:
    return f"WITH {_E}, q AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS k, count(*) OVER () AS c FROM {rel}) SELECT k // {n} AS block, {value} FROM q WHERE k < c // {n} * {n} GROUP BY ALL"


for _op, _sign in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    query(_blocks(50, f"count(*) FILTER (v {_sign} 40) AS n"), f"tumbling_count_if_{_op}")(lambda spark, d, op=_op: aggregates.tumbling_count_if(events(spark, d), "event_id", 50, "v", op, 40))
query(_blocks(50, "count(*) FILTER (event_type = 'view') AS n"), "tumbling_count_if_eq")(lambda spark, d: aggregates.tumbling_count_if(events(spark, d), "event_id", 50, "event_type", "eq", "VIEW"))


@query(_blocks(50, "CAST(sum(cents) AS BIGINT) AS total"))
def tumbling_sum(spark, d):
    return aggregates.tumbling_sum(events(spark, d), "event_id", 50, F.col("cents"))


@query(_blocks(50, "CAST(sum(cents) AS BIGINT) AS total", "(SELECT * FROM e WHERE event_type = 'purchase')"))
def select_tumbling_sum(spark, d):
    return aggregates.tumbling_sum(relational.select_where(events(spark, d), "event_type", "eq", "Purchase"), "event_id", 50, F.col("cents"), positive_only=True)


@query(f"""WITH {_E}, r AS (SELECT event_id, user_id AS key, CAST(event_type = 'click' AS INT) AS side FROM e WHERE event_type IN ({_VIEW_CLICK})), {_count_sql('r', 200)} SELECT key, count(*) AS n FROM j GROUP BY key""")
def join_group_count(spark, d):
    return count_window_join(spark, d).groupBy("key").agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) AS seq FROM events)
SELECT a.user_id AS key, count(*) AS n FROM q a JOIN q b ON a.user_id = b.user_id AND a.seq < b.seq AND a.seq >= b.seq - 100 GROUP BY ALL""")
def selfjoin_group_count(spark, d):
    return window_join.self_count_join(parquet(spark, d, "events", ["event_id", "user_id"]), "user_id", "event_id", 100).groupBy("key").agg(F.count("*").alias("n"))


# -- operational analytics ---------------------------------------------------------------------------
@query(f"WITH {_E} SELECT event_id, avg(cents) OVER (PARTITION BY event_type ORDER BY event_id ROWS 4 PRECEDING) AS mean FROM e")
def rolling_mean(spark, d):
    return metrics.rolling_mean(events(spark, d), "event_type", "event_id", "cents", 5).select("event_id", "mean")


@query(f"WITH {_E} SELECT event_id, avg(cents) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS mean FROM e")
def cumulative_mean(spark, d):
    return metrics.cumulative_mean(events(spark, d), "event_type", "event_id", "cents").select("event_id", "mean")


@query(f"""WITH {_E}, g AS (SELECT event_id, abs(value - lag(value) OVER w) AS dv, ms - lag(ms) OVER w AS dt FROM e WINDOW w AS (PARTITION BY event_type ORDER BY event_id))
SELECT event_id, round(dv / nullif(dt, 0) * 1000, 6) AS slope FROM g""")
def slope(spark, d):
    return metrics.slope(events(spark, d), "event_type", "event_id", "ms", "value").select("event_id", F.round(F.col("slope") * 1000, 6).alias("slope"))


@query(f"WITH {_E} SELECT event_type, ms // {HOUR} * {HOUR} AS interval_start, count(*) AS n FROM e GROUP BY ALL")
def per_second_rate(spark, d):
    return metrics.rate(events(spark, d), "ms", HOUR, ("event_type",))


@query(f"WITH {_E} SELECT user_id, event_type, avg(cents) AS mean FROM e GROUP BY ALL")
def metric_avg(spark, d):
    return metrics.metric_avg(events(spark, d), "user_id", "event_type", "cents")


@query("SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS idx FROM events")
def metric_series(spark, d):
    return metrics.metric_series(events(spark, d), ["user_id", "event_type"], "event_id").select("event_id", "user_id", "event_type", "idx")


@query(f"""WITH {_E}, t AS (SELECT event_type AS operator, user_id, avg(value) AS value, avg(cents) AS cents FROM e GROUP BY ALL)
SELECT operator, round(avg(value), 6) AS mean_value, round(avg(cents), 4) AS mean_cents, count(*) AS tasks FROM t GROUP BY ALL""")
def two_level_stats(spark, d):
    out = metrics.two_level_means(events(spark, d), F.col("event_type"), "user_id", ["value", "cents"])
    return out.select("operator", F.round("mean_value", 6).alias("mean_value"), F.round("mean_cents", 4).alias("mean_cents"), "tasks")


@query(f"WITH {_E} SELECT event_type, avg(cents) AS mean, min(cents) AS low, max(cents) AS high, " + ", ".join(f"round(quantile_cont(cents, {p / 100}), 6) AS p{p}" for p in (25, 50, 75, 90, 99)) + " FROM e GROUP BY ALL")
def latency_percentiles(spark, d):
    out = metrics.latency_summary(events(spark, d), "event_type", "cents")
    return out.select("event_type", "mean", "low", "high", *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75", "p90", "p99")])


@query(f"WITH {_E}, g AS (SELECT ms, lag(ms) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e) SELECT count(*) FILTER (abs(before - ms) < 600000) AS n FROM g")
def close_pairs_count(spark, d):
    return metrics.close_neighbours(events(spark, d), "user_id", "event_id", "ms", 600_000)


@query(f"""WITH {_E}, g AS (SELECT user_id, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY v, event_id) AS gap FROM e)
SELECT user_id, count(*) FILTER (gap < 0) AS backwards, count(*) FILTER (abs(gap) < 1000000) AS within, count(*) FILTER (abs(gap) >= 1000000) AS beyond FROM g GROUP BY ALL""")
def disorder_counts(spark, d):
    return metrics.disorder(events(spark, d), "user_id", ["v", "event_id"], "ms", 1_000_000)


@query(f"""WITH {_E}, g AS (SELECT event_type, abs((ms - lag(ms) OVER w) - (ms * 2 - lag(ms * 2) OVER w)) AS d FROM e WINDOW w AS (PARTITION BY event_type ORDER BY event_id))
SELECT event_type, avg(d) AS latency FROM g GROUP BY ALL""")
def clock_free_latency(spark, d):
    e = events(spark, d).withColumn("remote", F.col("ms") * 2)
    return metrics.clock_free_latency(e, "event_type", "event_id", "ms", "remote")


@query(f"WITH {_E} SELECT event_id, ms - lag(ms) OVER (PARTITION BY event_type ORDER BY event_id) - {HOUR} AS latency FROM e")
def tick_latency(spark, d):
    return metrics.tick_latency(events(spark, d), "event_type", "event_id", "ms", HOUR).select("event_id", "latency")


@query(f"WITH {_E} SELECT ms, event_id, cents, NULL AS scaled FROM e WHERE event_type = 'view' UNION ALL SELECT ms, event_id, NULL, user_id FROM e WHERE event_type = 'error'")
def replay_merge(spark, d):
    stats = events(spark, d, "view").select("ms", "event_id", "cents")
    return metrics.replay(stats, events(spark, d, "error").select("ms", "event_id", F.col("user_id").alias("scaled")), "ms")


@query(f"WITH k AS (SELECT user_id, count(*) AS c FROM events GROUP BY ALL) SELECT user_id % 8 AS task, CAST(sum(c) AS BIGINT) AS n, count(*) AS keys FROM k GROUP BY ALL")
def key_load_histogram(spark, d):
    return metrics.key_load(parquet(spark, d, "events", ["user_id"]), "user_id", 8)


# -- operator graphs ------------------------------------------------------------------------------------
_EDGES = "g(parent, child) AS (VALUES " + ", ".join(f"('{p}', '{c}')" for p, _, cs in (x.partition(":") for x in GRAPH.split(";")) for c in cs.split(",") if c) + ")"
_NEIGHBOURS = f"""{_EDGES}, t AS (SELECT parent AS task FROM g UNION SELECT child FROM g),
i AS (SELECT task, coalesce((SELECT string_agg(parent, ',' ORDER BY parent) FROM g WHERE child = task), '') AS parents, coalesce((SELECT string_agg(child, ',' ORDER BY child) FROM g WHERE parent = task), '') AS children FROM t)"""


@query(f"WITH {_NEIGHBOURS} SELECT task, parents FROM i")
def inverse_topology(spark, d):
    return topology.inverse(topology.parse(spark, GRAPH))


@query(f"WITH {_NEIGHBOURS} SELECT parents, children, string_agg(task, ',' ORDER BY task) AS tasks FROM i WHERE parents <> '' AND children <> '' GROUP BY ALL")
def topology_layers(spark, d):
    return topology.layers(topology.parse(spark, GRAPH))


@query(f"WITH {_NEIGHBOURS} SELECT parent || ':' || a AS parent, child || ':' || b AS child FROM g, (SELECT unnest(range(1, 4)) AS a) x, (SELECT unnest(range(1, 4)) AS b) y WHERE a <= length(parent) % 3 + 1 AND b <= length(child) % 3 + 1")
def task_expansion(spark, d):
    edges = topology.parse(spark, GRAPH)
    return topology.expand_tasks(edges, topology.nodes(edges).select("task", (F.length("task") % 3 + 1).alias("n")))


# -- policies and encryption -------------------------------------------------------------------------------
@query("SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TAGS.items()) + " END, ' ')) AS tag FROM events) WHERE tag IN ('pln', 'RND', 'DET', 'OPE', 'HOM') GROUP BY tag")
def enc_tag_counts(spark, d):
    tag = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])
    return policy.tag_counts(parquet(spark, d, "events", ["event_type"]).select(F.element_at(tag, F.col("event_type")).alias("tags")), "tags")


@query("SELECT user_id AS provider, event_type AS field, arg_max(event_id % 5, event_id) AS permission FROM events GROUP BY ALL")
def policy_latest(spark, d):
    e = parquet(spark, d, "events").select(F.col("user_id").alias("provider"), F.col("event_type").alias("field"), "event_id", (F.col("event_id") % 5).alias("permission"))
    return policy.latest(e, ["provider", "field"], "event_id", ["permission"])


@query(f"""WITH {_E} SELECT y.event_id, y.user_id, (SELECT arg_max(x.event_id % 5, x.ms) FROM e x WHERE x.event_type = 'signup' AND x.user_id = y.user_id AND x.ms <= y.ms) AS permission FROM e y WHERE y.event_type = 'click'""")
def policy_in_force(spark, d):
    rules = events(spark, d, "signup").select("user_id", "ms", (F.col("event_id") % 5).alias("permission"))
    return policy.in_force(events(spark, d, "click").select("event_id", "user_id", "ms"), rules, ["user_id"], "ms", "ms", "permission").select("event_id", "user_id", "permission")


@query(f"""WITH {_E}, p AS (SELECT y.event_id, y.user_id, y.v, (SELECT arg_max(x.event_id % 60, x.ms) FROM e x WHERE x.event_type = 'signup' AND x.user_id = y.user_id AND x.ms <= y.ms) AS t FROM e y WHERE y.event_type = 'click')
SELECT event_id, user_id, v FROM p WHERE t IS NULL OR v > t""")
def policy_predicate(spark, d):
    rules = events(spark, d, "signup").select("user_id", "ms", (F.col("event_id") % 60).alias("t"))
    return policy.select_in_force(events(spark, d, "click").select("event_id", "user_id", "ms", "v"), rules, ["user_id"], "ms", "ms", "t", "v").select("event_id", "user_id", "v")


@query(f"""WITH {_E}, p AS (SELECT y.event_id, y.user_id, y.event_type, (SELECT arg_max(x.event_id % 4, x.ms) FROM e x WHERE x.event_type = 'signup' AND x.user_id = y.user_id AND x.ms <= y.ms) AS permission FROM e y WHERE y.event_type <> 'signup')
SELECT event_id, user_id FROM p WHERE event_type = 'click' AND coalesce(permission, 0) IN (0, 2)""")
def policy_equality(spark, d):
    rules = events(spark, d, "signup").select("user_id", "ms", (F.col("event_id") % 4).alias("permission"))
    data = policy.in_force(events(spark, d).filter("event_type <> 'signup'").select("event_id", "user_id", "ms", "event_type"), rules, ["user_id"], "ms", "ms", "permission")
    # what a provider sends: text, or a cipher while its policy says so
    sent = F.when(F.coalesce("permission", F.lit(0)) == 0, F.col("event_type")).otherwise(secure.det_encrypt(F.col("event_type"), KEY))
    data = data.select("event_id", "user_id", "ms", sent.alias("sent"))
    return policy.select_equal_in_force(data, rules, ["user_id"], "ms", "ms", "permission", "sent", "click", KEY).select("event_id", "user_id")


@query("""WITH p AS (SELECT user_id, arg_max(event_id % 3, event_id) AS permission FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT event_id, user_id, CASE WHEN coalesce(permission, 0) = 0 THEN event_type END AS shown FROM events LEFT JOIN p USING (user_id)""")
def policy_reveal(spark, d):
    e = parquet(spark, d, "events", ["event_id", "user_id", "event_type"])
    rules = policy.latest(e.filter("event_type = 'signup'").select("user_id", "event_id", (F.col("event_id") % 3).alias("permission")), ["user_id"], "event_id", ["permission"])
    hidden = e.select("event_id", "user_id", secure.det_encrypt(F.col("event_type"), KEY).alias("c"))
    return policy.reveal(hidden, rules, ["user_id"], "c", secure.det_decrypt(F.col("c"), KEY), "shown")


@query("SELECT event_id FROM events WHERE event_type = 'click'")
def det_select(spark, d):
    hidden = parquet(spark, d, "events").select("event_id", secure.det_encrypt(F.col("event_type"), KEY).alias("c"))
    return hidden.filter(F.col("c") == secure.det_encrypt(F.lit("click"), KEY)).select("event_id")


@query("""WITH q AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS seq FROM events)
SELECT event_id, CASE WHEN seq <= 2400 THEN seq * 10.0 ELSE 24000 + (seq - 2400) * 5.0 END::DOUBLE AS arrival_ms FROM q""")
def paced_arrival(spark, d):
    numbered, _ = with_sequence(parquet(spark, d, "events", ["event_id"]), "event_id")
    return numbered.select("event_id", readers.arrival_ms(F.col("seq"), [100, 200], [0, 24]).alias("arrival_ms"))


@query("SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey")
def det_join(spark, d):
    o = parquet(spark, d, "orders", ["o_orderkey", "o_custkey"]).select("o_orderkey", secure.det_encrypt(F.col("o_custkey"), KEY).alias("k"))
    c = parquet(spark, d, "customer", ["c_custkey"]).select(secure.det_encrypt(F.col("c_custkey"), KEY).alias("k"))
    return o.join(c, "k").select("o_orderkey", secure.det_decrypt(F.col("k"), KEY).cast("bigint").alias("c_custkey"))


@query(f"WITH {_E} SELECT user_id % 10 AS bucket, CAST(sum(cents) AS BIGINT) AS total FROM e WHERE event_type = 'purchase' GROUP BY ALL")
def paillier_sum(spark, d):
    key = secure.Paillier.generate(256, seed=11)
    hidden = events(spark, d, "purchase").select((F.col("user_id") % 10).alias("bucket"), secure.paillier_encrypt(key, seed=5)("cents").alias("c"))
    return secure.paillier_sum(hidden, "bucket", "c", key).select("bucket", secure.paillier_decrypt(key)("product").cast("bigint").alias("total"))


@query(_blocks(50, "CAST(sum(cents) AS BIGINT) AS total", "(SELECT * FROM e WHERE event_type = 'purchase')"))
def paillier_tumbling_sum(spark, d):
    key = secure.Paillier.generate(256, seed=11)
    hidden = events(spark, d, "purchase").select("event_id", secure.paillier_encrypt(key, seed=5)("cents").alias("c"))
    return secure.paillier_tumbling_sum(hidden, "event_id", "c", 50, key).select("block", secure.paillier_decrypt(key)("product").cast("bigint").alias("total"))


@query("SELECT 'u' || user_id AS operator, event_id::DOUBLE AS latency, user_id::DOUBLE AS throughput, (event_id % 7)::DOUBLE AS memory, 5.0::DOUBLE AS hom FROM events WHERE event_id % 5 <> 0")
def statistics_lines(spark, d):
    e = parquet(spark, d, "events", ["event_id", "user_id", "value"])
    fields = ["value", F.col("event_id") % 7, "event_id", "user_id", F.lit(0.5), *map(F.lit, (1, 2, 3, 4)), F.when(F.col("event_id") % 5 == 0, F.lit("x")).otherwise(F.lit("5"))]
    lines = e.select(F.concat(F.lit("u"), "user_id").alias("operator"), F.concat_ws(",", *[(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]).alias("value"))
    return metrics.parse_statistics(lines).select("operator", "latency", "throughput", "memory", "hom")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 3 > 0")
def delimited_rows(spark, d):
    # lines of a delimited file, a third of them too short
    e = parquet(spark, d, "events", ["event_id", "user_id", "event_type", "value"])
    line = F.when(F.col("event_id") % 3 > 0, F.concat_ws("|", "event_id", "user_id", "event_type", "value")).otherwise(F.concat_ws("|", "event_id", "user_id"))
    return readers.parse(e.select(line.alias("value")), e.schema, "|")


@query("SELECT CAST(event_id AS VARCHAR) AS stream, CAST(event_id % 5 AS INT) AS permission, 'p' || user_id AS provider, event_type AS field FROM events WHERE event_id % 2 = 0")
def punctuation_lines(spark, d):
    e = parquet(spark, d, "events", ["event_id", "user_id", "event_type"])
    sps = F.concat_ws(",", F.lit("SPS"), "event_id", F.col("event_id") % 5, F.concat(F.lit("p"), "user_id"), "event_type", F.lit("k"))
    lines = e.select(F.when(F.col("event_id") % 2 == 0, sps).otherwise(F.concat_ws(",", "event_id", "event_type")).alias("value"))
    return policy.parse_punctuations(policy.split_punctuations(lines)[1]).select("stream", "permission", "provider", "field")


@query("SELECT event_id, event_type, 'pln DET pln pln pln' AS enc FROM events")
def provider_lines(spark, d):
    e = parquet(spark, d, "events", ["event_id", "event_type"])
    lines = e.select(F.concat(F.lit("{"), F.concat_ws("|", "event_id", "event_type", F.lit(""), F.lit("DET")), F.lit("}")).alias("value"))
    return readers.provider_records(lines, ["id", "event_type"]).select(F.col("id").cast("bigint").alias("event_id"), "event_type", "enc")


@query("SELECT user_id::INT AS task_id, event_type AS metric, event_id AS ts, CAST(value AS DOUBLE) AS value FROM events")
def metric_log_lines(spark, d):
    e = parquet(spark, d, "events", ["event_id", "user_id", "event_type", "value"])
    lines = e.select(F.concat_ws("\t", F.lit("2024-01-01"), "event_id", F.lit("host:6700"), F.concat(F.col("user_id"), F.lit(":t")), "event_type", "value").alias("value"))
    out = metrics.parse_metric_log(lines.union(e.select(F.lit("noise").alias("value"))))
    return out.select(F.col("task_id").cast("int").alias("task_id"), "metric", "ts", F.col("value").cast("double").alias("value"))


@query("SELECT 'latency' AS series, CAST(event_id AS DOUBLE) AS value FROM events UNION ALL SELECT 'throughput', CAST(user_id AS DOUBLE) FROM events")
def log_series(spark, d):
    e = parquet(spark, d, "events", ["event_id", "user_id"])
    return metrics.extract_series(e.select(F.concat(F.lit("x latency="), "event_id", F.lit(" throughput: "), "user_id").alias("value")))


# -- generators ------------------------------------------------------------------------------------------------
@query("SELECT CAST(i % 7 + 1 AS VARCHAR) AS key, i + 1 AS cnt FROM range(0, 1000) t(i)")
def inner_outer_gen(spark, d):
    return generators.balanced(spark, 1000, 7)


@query("""WITH i AS (SELECT CAST(i % 7 + 1 AS VARCHAR) AS key, i + 1 AS i_cnt FROM range(0, 500) t(i)), o AS (SELECT CAST(i % 5 + 1 AS VARCHAR) AS key, i + 1 AS o_cnt FROM range(0, 300) t(i))
SELECT * FROM i JOIN o USING (key)""")
def inner_outer_join(spark, d):
    left, right = generators.balanced(spark, 500, 7).withColumnRenamed("cnt", "i_cnt"), generators.balanced(spark, 300, 5).withColumnRenamed("cnt", "o_cnt")
    return left.join(right, "key")


@query(f"""WITH i AS (SELECT CAST(i % 7 + 1 AS VARCHAR) AS i_key, i + 1 AS i_cnt, i + 1 AS ms, (i + 1) * 2 AS arrival FROM range(0, 500) t(i)),
o AS (SELECT CAST(i % 5 + 1 AS VARCHAR) AS o_key, i + 1 AS o_cnt, i + 1 AS ms, (i + 1) * 2 + 1 AS arrival FROM range(0, 300) t(i)),
{_windowed("j", "i", "o", "i_key = o_key", "i_key, i_cnt, o_cnt", 100, 20)} SELECT i_key AS key, i_cnt, o_cnt FROM j""")
def inner_outer_windowed(spark, d):
    side = lambda n, keys, p, source: generators.balanced(spark, n, keys).select(F.col("key").alias(f"{p}_key"), F.col("cnt").alias(f"{p}_cnt"), F.col("cnt").alias("ms"), (F.col("cnt") * 2 + source).alias("arrival"))
    return star.windowed(side(500, 7, "i", 0), side(300, 5, "o", 1), "i_key", "o_key", 100, 20).select(F.col("i_key").alias("key"), "i_cnt", "o_cnt")


@query("""WITH p AS (SELECT i AS id, CAST(i // 200 AS INT) AS phase, i % 200 AS k FROM range(0, 800) t(i))
SELECT id, phase, CASE WHEN floor((k + 1) * s) > floor(k * s) THEN '1' ELSE '2' END AS key FROM (SELECT *, CAST([0.95, 0.5, 0.05, 0.5][phase + 1] AS DOUBLE) AS s FROM p)""")
def skew_phases(spark, d):
    return generators.phases(spark, 200)


@query("""WITH q AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS k, count(*) OVER () AS n FROM nation)
SELECT i AS copy_id, n_nationkey FROM range(0, 63) t(i) JOIN q ON q.k = i % q.n""")
def expand_relation(spark, d):
    return generators.expand(parquet(spark, d, "nation", ["n_nationkey"]), "n_nationkey", 2.5)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
