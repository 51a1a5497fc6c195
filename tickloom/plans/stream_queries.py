"""Streams in event time, drained over the events that are there; what the watermark has not passed stays in their state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.shared import new_folder
from ..streaming import jobs, stateful
from .sql import rounded

QUERIES, ORACLES = {}, {}


def query(text):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = text
        return f

    return add


def _ticks(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    x = s.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parquet*")
    return x.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))


def _drain(s, stream, name):
    """Runs a stream over what is there, into Parquet in the shared folder, and reads the result. The session's state store is changed for its start only."""
    path, store = new_folder(s, name), "spark.sql.streaming.stateStore.providerClass"
    was = s.conf.get(store)
    s.conf.set(store, stateful.PROVIDER)
    try:
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        s.conf.set(store, was)
    return s.read.schema(stream.schema).parquet(f"{path}/out")


#: Events whose hour the watermark has passed.
_SEEN = "(epoch_ms(ts) // 3600000 + 1) * 3600000 <= (SELECT epoch_ms(max(ts)) FROM events) - 300000"
_RING = "OVER (PARTITION BY event_type ORDER BY ts ROWS 29 PRECEDING)"


@query(f"WITH x AS (SELECT event_type AS symbol, ts, value AS price, count(*) {_RING} AS n, avg(value) {_RING} AS m, stddev_samp(value) {_RING} AS s FROM events) SELECT symbol, ts, price, round(m, 6) + 0.0::DOUBLE AS mean, round(s, 6) + 0.0::DOUBLE AS std, round((price - m) / nullif(s, 0), 6) + 0.0::DOUBLE AS z FROM x WHERE n = 30 AND {_SEEN}")
def r02_r04_event_time_zscore(s, d):
    x = _drain(s, stateful.zscores(_ticks(s, d), 30, every="1 hour"), "r02e")
    return rounded(x.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


_LEG = "OVER (PARTITION BY pair, leg ORDER BY ts ROWS 29 PRECEDING)"
_TURN = "CASE WHEN {was} = 0 THEN CASE WHEN b.z >= 3 THEN -1 WHEN b.z <= -3 THEN 1 ELSE 0 END WHEN abs(b.z) <= 0.5 THEN 0 ELSE {was} END"


@query(f"""WITH RECURSIVE legs AS (SELECT unnest(['click', 'view', 'error', 'login']) AS symbol, unnest(['click|view', 'click|view', 'error|login', 'error|login']) AS pair, unnest([1, 2, 1, 2]) AS leg),
e AS (SELECT pair, leg, ts, value AS v FROM events JOIN legs ON event_type = symbol),
m AS (SELECT *, CASE WHEN count(*) {_LEG} = 30 THEN (v - avg(v) {_LEG}) / nullif(stddev_samp(v) {_LEG}, 0) END AS zz, CASE WHEN count(*) {_LEG} = 30 THEN stddev_samp(v) {_LEG} END AS ss FROM e),
f AS (SELECT pair, ts, last_value(CASE WHEN leg = 1 THEN zz END IGNORE NULLS) OVER w AS z1, last_value(CASE WHEN leg = 2 THEN zz END IGNORE NULLS) OVER w AS z2, last_value(CASE WHEN leg = 1 THEN ss END IGNORE NULLS) OVER w AS s1, last_value(CASE WHEN leg = 2 THEN ss END IGNORE NULLS) OVER w AS s2
  FROM m WINDOW w AS (PARTITION BY pair ORDER BY ts, leg ROWS UNBOUNDED PRECEDING)),
q AS MATERIALIZED (SELECT pair, ts, s1 / s2 AS kappa, z1 - s1 / s2 * z2 AS z, row_number() OVER (PARTITION BY pair ORDER BY ts) AS i FROM f WHERE z1 IS NOT NULL AND z2 IS NOT NULL),
h AS (SELECT pair, i, {_TURN.format(was="0")} AS position FROM q b WHERE i = 1 UNION ALL SELECT b.pair, b.i, {_TURN.format(was="h.position")} FROM h JOIN q b ON b.pair = h.pair AND b.i = h.i + 1)
SELECT pair, ts, round(z, 6) + 0.0::DOUBLE AS z, round(kappa, 6) + 0.0::DOUBLE AS kappa, position::INT AS position FROM q JOIN h USING (pair, i) WHERE {_SEEN}""")
def r03_event_time_pairs(s, d):
    routed = jobs.route_to_pairs(_ticks(s, d), [("click", "view"), ("error", "login")])
    x = _drain(s, stateful.pair_decisions(routed, 30, every="1 hour"), "r03e")
    return rounded(x.withColumn("ts", F.col("ts").cast("timestamp_ntz")))
