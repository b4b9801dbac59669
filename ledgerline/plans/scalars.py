"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import arrays, clocks, dist, geo, hashing, text
from ledgerline.registry import query



def erf_sql(x: str) -> str:
    """The rational erf of ``functions.dist`` written out as SQL."""
    t = f"(1.0::DOUBLE/(1.0::DOUBLE+0.3275911::DOUBLE*abs({x})))"
    a = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
    poly = "0.0::DOUBLE"
    for v in reversed(a):
        poly = f"(({poly} + ({v})::DOUBLE) * {t})"
    return f"(sign({x}) * (1.0::DOUBLE - {poly} * exp(-({x})*({x}))))"


def phi_sql(z: str) -> str:
    return f"(0.5::DOUBLE*(1.0::DOUBLE+{erf_sql(f'(({z})/sqrt(2.0::DOUBLE))')}))"


def lncdf_sql(x: str, median: float | str, sigma: float | str) -> str:
    return (f"(CASE WHEN ({x}) > 0 THEN "
            f"{phi_sql(f'((ln(greatest(({x}),1e-300::DOUBLE)) - ln(({median})::DOUBLE))/(({sigma})::DOUBLE))')} ELSE 0.0::DOUBLE END)")


def lnlogpdf_sql(x: str, median: float, sigma: float) -> str:
    z = f"((ln(greatest(({x}),1e-300::DOUBLE))-ln({median}::DOUBLE))/({sigma}::DOUBLE))"
    return (f"(CASE WHEN ({x}) > 0 THEN -ln(greatest(({x}),1e-300::DOUBLE)*{sigma}::DOUBLE*sqrt(2.0::DOUBLE*pi())) "
            f"- 0.5::DOUBLE*{z}*{z} END)")


def lid_sql(center: str, sd: str, median: float, sigma: float) -> str:
    """Log interval density as SQL."""
    lo = f"greatest(1e-6::DOUBLE, ({center})-1.96::DOUBLE*({sd}))"
    hi = f"(({center})+1.96::DOUBLE*({sd}))"
    p = f"greatest(0.0::DOUBLE, {lncdf_sql(hi, median, sigma)}-{lncdf_sql(lo, median, sigma)})"
    return (f"(CASE WHEN ({sd}) < 0.5 THEN {lnlogpdf_sql(center, median, sigma)} "
            f"WHEN {hi} > 0 AND {p} > 1e-300::DOUBLE THEN ln({p}/greatest(1.0::DOUBLE, {hi}-{lo})) END)")


@query("F01_string_normalise", """
SELECT p_partkey, regexp_replace(trim(CAST(CAST(p_size AS DOUBLE) AS VARCHAR)), '^(\\d+)\\.0$', '\\1') AS size_id,
  CASE WHEN length(regexp_replace(p_brand,'[^0-9]','','g'))<=4 THEN lpad(regexp_replace(p_brand,'[^0-9]','','g'),4,'0')
       ELSE right(regexp_replace(p_brand,'[^0-9]','','g'),4) END AS brand_code
FROM part""")
def _(t):
    return t.part.select("p_partkey", text.norm_id(F.col("p_size").cast("double")).alias("size_id"),
                         text.code4(F.col("p_brand")).alias("brand_code"))


# Fixed values of this query: spellings and stop words of its names.
SPELLINGS = {"&": "and", "ohare": "o hare", "harlem lake": "harlem"}
STOP_WORDS = ("station", "terminal", "cta", "line", "l")


@query("F02_name_normaliser", """
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(
  replace(replace(replace(lower(url),'&','and'),'ohare','o hare'),'harlem lake','harlem'),
  '\\([^)]*\\)',' ','g'), '\\b(station|terminal|cta|line|l)\\b',' ','g'),'[^a-z0-9]+','','g') AS name_key
FROM pages""")
def _(t):
    return t.pages.select("page_id", text.normalized_name(F.col("url"), SPELLINGS, STOP_WORDS).alias("name_key"))


@query("F03_token_parse", """
WITH x AS (SELECT event_id, (event_id % 14)::VARCHAR || CASE WHEN event_type='error' THEN '' ELSE '号线' END
   || '站' || (user_id % 20)::VARCHAR AS tok FROM events)
SELECT event_id,
  CASE WHEN regexp_matches(tok,'^(\\d+)号线(.+)$') THEN lpad(regexp_extract(tok,'^(\\d+)号线(.+)$',1),2,'0') END AS line,
  CASE WHEN regexp_matches(tok,'^(\\d+)号线(.+)$') THEN regexp_extract(tok,'^(\\d+)号线(.+)$',2) END AS station
FROM x""")
def _(t):
    token = F.concat((F.col("event_id") % 14).cast("string"),
                     F.when(F.col("event_type") == "error", "").otherwise("号线"),
                     F.lit("站"), (F.col("user_id") % 20).cast("string"))
    p = text.line_station(token)
    return t.events.select("event_id", p["line"].alias("line"), p["station"].alias("station"))


@query("F04_list_parse", """
WITH x AS (SELECT event_id, user_id, (event_id%7)::VARCHAR||'| '||(user_id%5)::VARCHAR||'||'||event_type||'|'||(event_id%7)::VARCHAR AS pipes,
   event_type||'>'||(user_id%3)::VARCHAR AS chain FROM events)
SELECT event_id,
  CASE WHEN event_id%7 = user_id%5 THEN (event_id%7)::VARCHAR
       ELSE least(event_id%7,user_id%5)::VARCHAR||','||greatest(event_id%7,user_id%5)::VARCHAR END AS ints,
  split_part(chain,'>',1) AS first_item, len(string_split(chain,'>'))::INT AS n_items FROM x""")
def _(t):
    e = t.events.select(
        "event_id",
        F.concat((F.col("event_id") % 7).cast("string"), F.lit("| "), (F.col("user_id") % 5).cast("string"), F.lit("||"),
                 F.col("event_type"), F.lit("|"), (F.col("event_id") % 7).cast("string")).alias("pipes"),
        F.concat("event_type", F.lit(">"), (F.col("user_id") % 3).cast("string")).alias("chain"))
    items = text.chevron(F.col("chain"))
    return e.select("event_id", F.array_join(text.pipe_ints(F.col("pipes")), ",").alias("ints"),
                    F.element_at(items, 1).alias("first_item"), F.size(items).alias("n_items"))


@query("F05_speed_parse", """
WITH x AS (SELECT event_id, CASE event_id%4 WHEN 0 THEN (event_id%130)::VARCHAR||' km/h' WHEN 1 THEN (event_id%130)::VARCHAR||' mph'
   WHEN 2 THEN (event_id%130)::VARCHAR ELSE 'none' END AS s FROM events),
 y AS (SELECT event_id, s, CASE WHEN s='none' THEN NULL ELSE regexp_extract(s,'(\\d+(?:\\.\\d+)?)',1)::DOUBLE END AS v FROM x)
SELECT event_id, round(CASE WHEN s LIKE '%km%' OR (s NOT LIKE '%mph%' AND v>75) THEN v/1.609344::DOUBLE ELSE v END, 6) AS mph FROM y""")
def _(t):
    n = (F.col("event_id") % 130).cast("string")
    k = F.col("event_id") % 4
    s = F.when(k == 0, F.concat(n, F.lit(" km/h"))).when(k == 1, F.concat(n, F.lit(" mph"))).when(k == 2, n).otherwise("none")
    return t.events.select("event_id", F.round(text.speed_mph(s), 6).alias("mph"))


@query("F06_gtfs_clock", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE (l_orderkey%30)*3600+(l_partkey%60)*60+(l_suppkey%60) END::INT AS sec FROM lineitem""")
def _(t):
    s = F.when(F.col("l_linenumber") == 7, F.lit("bad:clock")).otherwise(
        F.concat_ws(":", (F.col("l_orderkey") % 30).cast("string"), (F.col("l_partkey") % 60).cast("string"),
                    (F.col("l_suppkey") % 60).cast("string")))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                             clocks.gtfs_seconds(s).alias("sec"))


@query("F07_compact_timestamp", """
SELECT event_id, CASE WHEN event_type='error' THEN NULL ELSE date_trunc('second', ts) END AS parsed FROM events""")
def _(t):
    s = F.when(F.col("event_type") == "error", F.lit("2024-13")).otherwise(F.date_format("ts", "yyyyMMddHHmmss"))
    return t.events.select("event_id", clocks.compact_timestamp(s).alias("parsed"))


@query("F08_clock_arithmetic", """
WITH x AS (SELECT event_id, (event_id%102)::INT AS slot FROM events),
 y AS (SELECT *, slot*10+360 AS m FROM x)
SELECT event_id, slot, ((m//60)*10000+(m%60)*100)::INT AS start_clock, (((m+10)//60)*10000+((m+10)%60)*100)::INT AS end_clock,
 m::INT AS start_min FROM y""")
def _(t):
    e = t.events.select("event_id", (F.col("event_id") % 102).cast("int").alias("slot"))
    start = clocks.slot_start(F.col("slot"))
    return e.select("event_id", "slot", start.alias("start_clock"), clocks.slot_end(F.col("slot")).alias("end_clock"),
                    clocks.clock_to_minutes(start).alias("start_min"))


POINTS_SQL = """p AS (SELECT vec_id, label, embedding[1]::DOUBLE*10 AS lon, embedding[2]::DOUBLE*10+40 AS lat,
  embedding[3]::DOUBLE*10 AS lon2, embedding[4]::DOUBLE*10+40 AS lat2 FROM embeddings)"""


def points(t):
    """Embedding components read as two lon/lat points per row."""
    e = lambda i: F.element_at("embedding", i).cast("double") * 10
    return t.embeddings.select("vec_id", "label", e(1).alias("lon"), (e(2) + 40).alias("lat"),
                               e(3).alias("lon2"), (e(4) + 40).alias("lat2"))


@query("F09_haversine", f"""
WITH {POINTS_SQL}, q AS (SELECT vec_id, pow(sin(radians(lat2-lat)/2),2)+cos(radians(lat))*cos(radians(lat2))*pow(sin(radians(lon2-lon)/2),2) AS a FROM p)
SELECT vec_id, round(2*6371000.0::DOUBLE*asin(sqrt(a)),3) AS metres, round(2*6371.0088::DOUBLE*asin(sqrt(a)),6) AS km FROM q""")
def _(t):
    args = [F.col(c) for c in ("lat", "lon", "lat2", "lon2")]
    return points(t).select("vec_id", F.round(geo.haversine(*args), 3).alias("metres"),
                            F.round(geo.haversine(*args, radius=geo.EARTH_KM), 6).alias("km"))


@query("F10_orientation", f"""
WITH {POINTS_SQL}, q AS (SELECT vec_id, (degrees(atan2(lat2-lat, lon2-lon))+180) AS raw FROM p),
 r AS (SELECT vec_id, raw - 180*floor(raw/180) AS o FROM q), s AS (SELECT *, abs(o-45) AS d FROM r)
SELECT vec_id, round(o,6) AS orient, round(least(d,180-d),6) AS diff45 FROM s""")
def _(t):
    o = geo.orientation_deg(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))
    return points(t).select("vec_id", F.round(o, 6).alias("orient"),
                            F.round(geo.orientation_diff(o, F.lit(45.0)), 6).alias("diff45"))


@query("F11_log_sum_exp", """
WITH m AS (SELECT user_id, max(value) AS top FROM events GROUP BY 1)
SELECT e.user_id, round(max(top)+ln(sum(exp(e.value-top))),6) AS lse FROM events e JOIN m USING (user_id) GROUP BY 1""")
def _(t):
    return dist.log_sum_exp(t.events.select("user_id", "value"), ["user_id"], "value", "lse").withColumn(
        "lse", F.round("lse", 6))


@query("F12_lognormal", f"""
SELECT event_id, round({lncdf_sql('value', 60.0, 0.9)},6) AS cdf, round({lnlogpdf_sql('value', 60.0, 0.9)},6) AS log_pdf FROM events""")
def _(t):
    v, m, s = F.col("value"), F.lit(60.0), F.lit(0.9)
    return t.events.select("event_id", F.round(dist.lognormal_cdf(v, m, s), 6).alias("cdf"),
                           F.round(dist.lognormal_log_pdf(v, m, s), 6).alias("log_pdf"))


@query("F13_interval_probability", f"""
SELECT event_id, round(CASE WHEN value > greatest(0, value-20) THEN ln(greatest(1e-14::DOUBLE,
   {lncdf_sql('value', 60.0, 0.9)} - CASE WHEN value-20>0 THEN {lncdf_sql('(value-20)', 60.0, 0.9)} ELSE 0.0::DOUBLE END)) END, 6) AS log_prob FROM events""")
def _(t):
    v = F.col("value")
    return t.events.select("event_id", F.round(dist.log_interval_prob(v - 20, v, F.lit(60.0), F.lit(0.9)), 6).alias("log_prob"))


def gh_sql(mean: str, sd: str, median: float, sigma: float) -> str:
    return "(" + " + ".join(f"{w!r}::DOUBLE*{lncdf_sql(f'({mean} + ({z!r})::DOUBLE*{sd})', median, sigma)}"
                            for z, w in zip(dist.GH_NODES, dist.GH_WEIGHTS)) + ")"


@query("F14_uncertain_expectation", f"""
SELECT event_id, round({gh_sql('value', '(1.0::DOUBLE+event_id%20)', 60.0, 0.9)},6) AS expected_cdf FROM events""")
def _(t):
    sd = F.lit(1.0) + F.col("event_id") % 20
    return t.events.select("event_id", F.round(dist.expected_lognormal_cdf(
        F.col("value"), sd, F.lit(60.0), F.lit(0.9)), 6).alias("expected_cdf"))


@query("F15_softplus_loss", """
WITH x AS (SELECT event_id, -(value-100)/45.0::DOUBLE AS x FROM events)
SELECT event_id, round(CASE WHEN x>50 THEN x ELSE ln(1+exp(least(x,50))) END,6) AS loss FROM x""")
def _(t):
    return t.events.select("event_id", F.round(dist.softplus_loss(F.col("value") - 100, 45.0), 6).alias("loss"))


@query("F16_hash_bucket", """
SELECT o_orderkey, (('0x'||substr(sha256(o_orderkey::VARCHAR),1,8))::BIGINT % 50)::INT AS shard,
  (('0x'||substr(sha256('fold:'||o_orderkey::VARCHAR),1,15))::BIGINT % 2)::INT AS fold FROM orders""")
def _(t):
    k = F.col("o_orderkey").cast("string")
    return t.orders.select("o_orderkey", hashing.bucket(k, 50).alias("shard"),
                           hashing.bucket(F.concat(F.lit("fold:"), k), 2, hex_digits=15).alias("fold"))


@query("F17_stable_id", """
SELECT o_orderkey, 'C'||sha256(concat_ws('|',o_custkey::VARCHAR,o_orderpriority,o_orderstatus)) AS cohort_id FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", hashing.stable_id(
        F.col("o_custkey"), F.col("o_orderpriority"), F.col("o_orderstatus"), prefix="C").alias("cohort_id"))


@query("F18_chain_label", """
SELECT c_custkey, concat_ws('>', c_mktsegment, c_nationkey::VARCHAR, c_name) AS chain,
  c_mktsegment||':'||c_nationkey::VARCHAR||'->'||c_name AS movement FROM customer""")
def _(t):
    return t.customer.select(
        "c_custkey", arrays.chain_label(F.array("c_mktsegment", F.col("c_nationkey").cast("string"), "c_name")).alias("chain"),
        F.concat("c_mktsegment", F.lit(":"), F.col("c_nationkey").cast("string"), F.lit("->"), "c_name").alias("movement"))


@query("F19_array_map_functions", """
WITH x AS (SELECT doc_id, string_split(lang||source||'abca','') AS items FROM documents)
SELECT doc_id, len(items)::INT AS n, len(list_distinct(items))::INT AS n_distinct,
 len(list_filter(items, lambda i: i='a'))::INT AS n_a, array_to_string(list_sort(list_distinct(items)),'') AS members FROM x""")
def _(t):
    d = t.documents.select("doc_id", F.filter(F.split(F.concat("lang", "source", F.lit("abca")), ""), lambda x: x != "").alias("items"))
    c = arrays.counter(F.col("items"))
    return d.select("doc_id", F.size("items").alias("n"), F.size(F.map_keys(c)).alias("n_distinct"),
                    F.element_at(c, "a").alias("n_a"), F.array_join(F.map_keys(c), "").alias("members"))


@query("F20_overlap_ratio", """
WITH x AS (SELECT page_id, list_distinct(string_split(split_part(url,'/',3),'.')) AS a, list_distinct(string_split(split_part(url,'/',3)||'.com','.')) AS b FROM pages)
SELECT page_id, len(list_intersect(a,b))::DOUBLE/greatest(1,least(len(a),len(b))) AS overlap FROM x""")
def _(t):
    host = F.split_part("url", F.lit("/"), F.lit(3))
    return t.pages.select("page_id", arrays.overlap_ratio(
        F.split(host, r"\."), F.split(F.concat(host, F.lit(".com")), r"\.")).alias("overlap"))
