"""Queries on the traces of ``events``: one for each user, samples in order of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.operators import traces as tr
from glintframe.plans.catalog import register

FPS = 800.0
#: Groups of events within ten hours of their first.
TOLERANCE_S = 36_000
_TRACE = "tr AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS v, ts FROM events)"
_PEAK = """q AS (SELECT key, t, floor(v / 50) AS v FROM tr),
m AS (SELECT *, lag(v) OVER (PARTITION BY key ORDER BY t) AS b, max(t) OVER (PARTITION BY key) AS l FROM q),
s AS (SELECT key, t, v, l FROM m WHERE b IS NULL OR b <> v),
r AS (SELECT key, t AS t0, coalesce(lead(t) OVER (PARTITION BY key ORDER BY t) - 1, l) AS t1, v, lag(v) OVER (PARTITION BY key ORDER BY t) AS vb, lead(v) OVER (PARTITION BY key ORDER BY t) AS va FROM s)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    return tr.from_events(spark.read.parquet(f"{sf}/events.parquet"), "user_id", ["ts", "event_id"], "value")


@register(
    "movmedian_highpass",
    f"WITH {_TRACE} SELECT key, t, v, quantile_cont(v, 0.5) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) - v AS hp FROM tr",
)
def movmedian_highpass(spark: SparkSession, sf: str) -> DataFrame:
    return tr.median_highpass(events(spark, sf))


@register(
    "rolling_min_subtract",
    f"WITH {_TRACE} SELECT key, t, v, coalesce(v - min(v) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) AS fm FROM tr",
)
def rolling_min_subtract(spark: SparkSession, sf: str) -> DataFrame:
    return tr.forward_min_subtract(events(spark, sf))


@register(
    "running_mean_detrend",
    f"WITH {_TRACE} SELECT key, t, round(v - avg(v) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 9) AS detrended FROM tr",
)
def running_mean_detrend(spark: SparkSession, sf: str) -> DataFrame:
    return tr.running_mean_detrend(events(spark, sf)).select("key", "t", F.round("detrended", 9).alias("detrended"))


@register("stride", f"WITH {_TRACE} SELECT key, t, v FROM tr WHERE t % 4 = 0 AND t < 40")
def stride(spark: SparkSession, sf: str) -> DataFrame:
    return tr.stride(events(spark, sf), 4, 40)


def _coarse(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).withColumn("v", F.floor(F.col("v") / 50).cast("double"))


@register("findpeaks", f"WITH {_TRACE}, {_PEAK} SELECT key, t0 AS t, v::DOUBLE AS v FROM r WHERE vb < v AND va < v")
def findpeaks(spark: SparkSession, sf: str) -> DataFrame:
    return tr.find_peaks(_coarse(spark, sf))


@register("findpeaks_middle", f"WITH {_TRACE}, {_PEAK} SELECT key, (t0 + t1) // 2 AS t, v::DOUBLE AS v FROM r WHERE vb < v AND va < v")
def findpeaks_middle(spark: SparkSession, sf: str) -> DataFrame:
    return tr.find_peaks(_coarse(spark, sf), left_edge=False)


@register(
    "findpeaks_distance",
    f"""WITH RECURSIVE {_TRACE}, c AS (SELECT key, t, v, lag(v) OVER (PARTITION BY key ORDER BY t) AS b, max(t) OVER (PARTITION BY key) AS last FROM tr),
f AS (SELECT * FROM c WHERE b IS NULL OR b <> v), r AS (SELECT key, t, coalesce(lead(t) OVER w - 1, last) AS t1, v, lag(v) OVER w AS vb, lead(v) OVER w AS va FROM f WINDOW w AS (PARTITION BY key ORDER BY t)),
p AS (SELECT key, (t + t1) // 2 AS t, v FROM r WHERE vb < v AND va < v AND v >= 100),
o AS (SELECT key, t, v, row_number() OVER (PARTITION BY key ORDER BY v DESC, t DESC) AS i, count(*) OVER (PARTITION BY key) AS n FROM p),
g AS (SELECT key, i, n, [t] AS kept FROM o WHERE i = 1
UNION ALL SELECT o.key, o.i, o.n, CASE WHEN len(list_filter(g.kept, lambda x: abs(x - o.t) < 8)) = 0 THEN list_append(g.kept, o.t) ELSE g.kept END FROM g JOIN o ON o.key = g.key AND o.i = g.i + 1)
SELECT o.key, o.t, o.v::DOUBLE AS v FROM o JOIN g ON g.key = o.key AND g.i = g.n AND list_contains(g.kept, o.t)""",
)
def findpeaks_distance(spark: SparkSession, sf: str) -> DataFrame:
    return tr.find_peaks_distance(events(spark, sf), 100.0, 8)


@register("end_zero", f"WITH {_TRACE} SELECT key, t, CASE WHEN t >= 4 AND t < max(t) OVER (PARTITION BY key) + 1 - 4 THEN v ELSE 0 END AS v FROM tr")
def end_zero(spark: SparkSession, sf: str) -> DataFrame:
    return tr.end_zero(events(spark, sf), 4)


_GROUPS = f"""e AS (SELECT user_id AS key, epoch(ts)::BIGINT::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT, event_id) AS i FROM events),
g AS (SELECT key, i, t, t AS a FROM e WHERE i = 1 UNION ALL SELECT e.key, e.i, e.t, CASE WHEN e.t - g.a <= {TOLERANCE_S} THEN g.a ELSE e.t END FROM g JOIN e ON e.key = g.key AND e.i = g.i + 1),
h AS (SELECT key, a AS first, max(t) AS last, count(*) AS n FROM g GROUP BY key, a)"""


def _times(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("key"), seconds.cast("double").alias("t"), F.col("event_id"))


@register("tolerance_groups", f"WITH RECURSIVE {_GROUPS.replace('epoch(ts)::BIGINT', 'floor(epoch(ts))')} SELECT key, first, last, n FROM h")
def tolerance_groups(spark: SparkSession, sf: str) -> DataFrame:
    return tr.tolerance_groups(_times(spark, sf), TOLERANCE_S)


@register(
    "dedup_peaks",
    f"WITH RECURSIVE {_GROUPS.replace('epoch(ts)::BIGINT', 'floor(epoch(ts))')} SELECT user_id AS key, floor(epoch(ts))::DOUBLE AS t, event_id FROM events JOIN h ON key = user_id AND first = last AND first = floor(epoch(ts))",
)
def dedup_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return tr.dedup_close(_times(spark, sf), TOLERANCE_S)


@register("robust_sigma", f"WITH {_TRACE} SELECT key, round(1.4826e0 * mad(v), 9) AS sigma FROM tr GROUP BY key")
def robust_sigma(spark: SparkSession, sf: str) -> DataFrame:
    return tr.robust_sigma(events(spark, sf)).select("key", F.round("sigma", 9).alias("sigma"))


@register(
    "spike_detect",
    f"""WITH RECURSIVE {_TRACE},
a AS (SELECT key, t, quantile_cont(v, 0.5) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) - v AS v, max(t) OVER (PARTITION BY key) + 1 AS n FROM tr),
z AS (SELECT key, t, n, CASE WHEN t >= 4 AND t < n - 4 THEN v ELSE 0 END AS v FROM a),
f AS (SELECT *, coalesce(v - min(v) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) AS fm FROM z),
th AS (SELECT key, 1.5e0 * stddev_samp(fm) AS thr FROM f GROUP BY key),
c AS (SELECT key, t, n, CASE WHEN v < thr THEN 0 ELSE v END AS v FROM f JOIN th USING (key)),
m AS (SELECT *, lag(v) OVER (PARTITION BY key ORDER BY t) AS b FROM c),
s AS (SELECT * FROM m WHERE b IS NULL OR b <> v),
r AS (SELECT key, t, v, n, lag(v) OVER (PARTITION BY key ORDER BY t) AS vb, lead(v) OVER (PARTITION BY key ORDER BY t) AS va FROM s),
p AS (SELECT key, t, v, n FROM r WHERE vb < v AND va < v AND t > 2 AND t < n - 4),
x AS (SELECT p.key, p.t AS pt, p.v AS amplitude, c.t, row_number() OVER (PARTITION BY p.key, p.t ORDER BY c.v DESC, c.t) AS o FROM p JOIN c ON c.key = p.key AND c.t BETWEEN p.t - 3 AND p.t + 2),
y AS (SELECT key, t, amplitude, row_number() OVER (PARTITION BY key ORDER BY t, pt) AS i FROM x WHERE o = 1),
g AS (SELECT key, i, t, t AS a FROM y WHERE i = 1 UNION ALL SELECT y.key, y.i, y.t, CASE WHEN y.t - g.a <= 3 THEN g.a ELSE y.t END FROM g JOIN y ON y.key = g.key AND y.i = g.i + 1),
h AS (SELECT key, a FROM g GROUP BY key, a HAVING min(t) = max(t))
SELECT y.key, y.t, y.amplitude FROM y JOIN h ON h.key = y.key AND h.a = y.t""",
)
def spike_detect(spark: SparkSession, sf: str) -> DataFrame:
    return tr.detect_spikes(events(spark, sf), threshold_factor=1.5, min_interval=3)
