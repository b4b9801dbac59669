"""The end-to-end path: taps, journeys, hourly cohorts, duration quantiles, conservation gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import clocks
from ledgerline.operators import aggregates as A
from ledgerline.operators import quantiles as Q
from ledgerline.plans.sequence import PAIRS, pairs
from ledgerline.registry import Tables, query
from ledgerline.session import cut_lineage

SQL = f"""WITH {PAIRS}, h AS (SELECT ((entry_us//1000000)%86400)//3600 AS hr, duration_us FROM pairs)
SELECT hr, count(*) AS passenger_mass, round(quantile_cont(duration_us,0.1)/1e6,3) AS p10_s, round(quantile_cont(duration_us,0.5)/1e6,3) AS p50_s, round(quantile_cont(duration_us,0.9)/1e6,3) AS p90_s,
 (SELECT count(*) FROM pairs) AS total_mass FROM h GROUP BY 1"""


def journey_report(t: Tables) -> DataFrame:
    # read four times below: paired once, kept on shared storage
    journeys = cut_lineage(pairs(t).select(F.floor(F.floor(F.col("entry_us") / 1_000_000) % clocks.DAY_S / 3600).alias("hr"), "duration_us"))
    mass = A.cohorts(journeys, ["hr"])
    q = Q.quantiles(journeys, ["hr"], "duration_us", 600e6, {"p10_s": 0.1, "p50_s": 0.5, "p90_s": 0.9})
    q = q.select("hr", *[F.round(F.col(c) / 1e6, 3).alias(c) for c in ("p10_s", "p50_s", "p90_s")])
    return mass.join(q, "hr").withColumn("total_mass", mass.agg(F.sum("passenger_mass")).scalar())


@query("E01_journey_report", SQL)
def _(t):
    return journey_report(t)
