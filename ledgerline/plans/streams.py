"""Streaming queries, run over the supplied event file to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import clocks
from ledgerline.plans.views import RIDES, TAPS
from ledgerline.registry import query
from ledgerline.session import fresh_path
from ledgerline.streaming import accumulate as AC
from ledgerline.streaming import pairing as PA


@query("Z01_incremental_accumulation", f"""
WITH {TAPS} SELECT (ts - INTERVAL 4 HOUR)::DATE AS service_date, station, ((us//1000000-14400)%86400)//900 AS bin, count(*) AS x FROM taps GROUP BY ALL""")
def _(t):
    keys = ["service_date", "station", "bin"]
    s = AC.file_stream(t.spark, t.sf_dir, t.events.schema, "events.parquet")
    s = s.select(clocks.service_date(F.col("ts")).alias("service_date"), (F.col("event_id") % 23).cast("int").alias("station"),
                 F.floor(clocks.service_second(F.col("ts")) / 900).alias("bin"))
    store = fresh_path(t.spark, "store")
    AC.run_to_end(AC.accumulate_counts(s, keys, store, fresh_path(t.spark, "progress")))
    return AC.read_store(t.spark, store, keys)


@query("Z02_cohort_grouping", "SELECT l_orderkey AS cohort_id, count(*) AS edges, sum(l_quantity)::BIGINT AS mass, count(DISTINCT l_suppkey) AS chains FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("cohort_id")).agg(F.count(F.lit(1)).alias("edges"), F.sum("l_quantity").cast("bigint").alias("mass"), F.count_distinct("l_suppkey").alias("chains"))


@query("Z03_stream_pairing", f"""
WITH {TAPS}, b0 AS (SELECT *, us//1000000 AS tick, CASE WHEN status=1 THEN 'ENTRY' WHEN status=0 THEN 'EXIT' ELSE 'BARRIER' END AS kind FROM taps),
 b1 AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY user_id, tick)>1 THEN 'BARRIER' ELSE kind END AS role FROM b0), b2 AS (SELECT *, lag(role) OVER w AS pr, lag(tick) OVER w AS pt, lag(station) OVER w AS ps FROM b1 WINDOW w AS (PARTITION BY user_id ORDER BY tick, event_id))
SELECT ps AS entry_station, station AS exit_station, pt AS entry_s, tick AS exit_s FROM b2 WHERE role='EXIT' AND pr='ENTRY' AND tick-pt<=21600""")
def _(t):
    """The pairs of a run over the event file, with what is still open at its end."""
    ev, schema = F.col("event_type"), t.events.schema

    def events(spark):
        return AC.file_stream(spark, t.sf_dir, schema, "events.parquet").select(
            "user_id", F.timestamp_seconds(clocks.epoch_s(F.col("ts"))).alias("ts"), clocks.epoch_s(F.col("ts")).alias("s"), F.col("event_id").alias("seq"),
            F.when(ev.isin("view", "click"), "ENTRY").when(ev.isin("purchase", "signup"), "EXIT").otherwise("BARRIER").alias("kind"), (F.col("event_id") % 23).cast("int").alias("station"))

    return PA.pair_files(t.spark, events, fresh_path(t.spark, "pairs"), fresh_path(t.spark, "progress")).drop("user_id")
