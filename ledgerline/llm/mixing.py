"""Mixing sources to target weights by a curriculum that varies over training time.

Every source has a weight schedule w(t) = w (1 + tilt (2t - 1)) over training time t in
[0, 1]; its integral is the source's share, so that the tilt moves words between early
and late training without changing the total. The cumulative demand of a source,
D(t) = target ((1 - tilt) t + tilt t^2), is inverted at the running word count of each
document copy, which gives the copy's training position; a range sort by position is
the training order. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline import skew
from ledgerline.llm.common import order_chunk, require, shuffle_order
from ledgerline.session import stage

WORD = r"[^\x20\x09-\x0D]+"


def number_sources(sources: DataFrame, source: str) -> DataFrame:
    """Adds ``rank``, from 0 by code point, null last, without a window over all sources.

    Each range partition numbers its own rows; the rows of the partitions before it are
    one small table.
    """
    ranged = sources.withColumn("__null", F.col(source).isNull().cast("int"))
    parts = ranged.repartitionByRange(F.col("__null"), F.col(source)).sortWithinPartitions("__null", source)
    local = stage(parts.withColumns({"__id": F.monotonically_increasing_id()}), "sources").withColumns({
        "__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    per = local.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # one row per range partition, however many sources there are
    before = per.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return local.join(before, "__part").withColumn("rank", F.col("__before") + F.col("__at")).drop("__part", "__at", "__before", "__id", "__null")


def fill_targets(sources: DataFrame, size: str, weight: str, max_repeats: int) -> DataFrame:
    """Adds ``target``: shares of all sizes by weight, none above ``max_repeats`` times its source.

    The excess of full sources is reshared by weight among the others until none is
    above. Every round is two small sums; a source once full stays full.
    """
    cap = F.col(size).cast("decimal(38,0)") * max_repeats
    total = sources.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    # a level is words per unit of weight; sources whose cap lies below it are full
    left, weights = int(total), int(sources.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0])
    while weights:
        over = F.col(weight).cast("decimal(38,0)") * F.lit(left) > cap * F.lit(weights)
        full = sources.where(over).agg(F.coalesce(F.sum(cap), F.lit(0)), F.coalesce(F.sum(weight), F.lit(0))).first()
        rest = (int(total) - int(full[0]), int(sources.agg(F.sum(weight)).first()[0]) - int(full[1]))
        if rest == (left, weights):
            break
        left, weights = rest
    over = F.col(weight).cast("decimal(38,0)") * F.lit(left) > cap * F.lit(weights)
    share = F.col(weight).cast("double") * F.lit(float(left)) / F.lit(float(max(weights, 1)))
    return sources.withColumn("target", F.when(F.lit(weights == 0) | over, cap.cast("double")).otherwise(share))


def curriculum(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
               weights: Sequence[int] = (1, 2, 3), tilts: Sequence[float] = (-0.5, 0.0, 0.5), max_repeats: int = 3,
               keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: how often it is taken and where in training.

    Sources in code-point order, null last, take ``weights`` and ``tilts`` in turn. A
    source of n words and target m is read floor(m / n) times whole; of one more pass
    the documents are taken whose middle lies before the words still wanted, in an order
    fixed by the document id. Reruns agree.

    Null text: no words. Null source: a source of its own, last. Documents without words
    are read with their source and take nothing. Equal rows are ties and get their
    places among each other by size. An empty table gives no rows.

    Returns ``doc_id, source, size, source_size, target, taken, copies, position`` and the
    columns of ``keep``; ``position`` is that of the first copy, null if none is taken.
    """
    require(docs, doc_id, text, source)
    facts = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                        shuffle_order(F.col(doc_id)).alias("__order"), *keep)
    facts = stage(facts, "sizes")
    sums = facts.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__rows"))
    ranked = number_sources(sums, "source")
    turn = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (F.col("rank") % len(values) + 1).cast("int"))
    sources = stage(ranked.withColumns({"weight": turn(weights, "long"), "tilt": turn(tilts, "double")}), "ranked")
    sources = fill_targets(sources, "source_size", "weight", max_repeats)
    sources = sources.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).drop("rank", "weight", "__rows")
    rows = facts.count()
    placed = skew.running(facts, ["source"], ["__order", "doc_id", "size"], order_chunk("__order", rows), {"__upto": ("sum", "size")})
    j = placed.join(skew.prefixed(sources, ["source"], "__s_"), F.col("source").eqNullSafe(F.col("__s_source")), "left").drop("__s_source")
    before = F.col("__upto") - F.col("size")
    extra = (before * 2 + F.col("size")).cast("double") <= F.col("rest") * 2
    extra = extra & (F.col("rest") > 0)
    out = j.withColumn("copies", F.col("passes") + extra.cast("long"))
    first = (before.cast("double") + F.col("size") / F.lit(2.0)) / F.col("target")
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "tilt",
                      before.alias("words_before"), F.when((F.col("copies") > 0) & (F.col("target") > 0), when_reached(first, F.col("tilt"))).alias("position"), *keep)


def when_reached(share: Column, tilt: Column) -> Column:
    """Training time at which this share of a source's demand is used up: D inverted."""
    u = F.least(share, F.lit(1.0))
    return u * 2.0 / ((F.lit(1.0) - tilt) + F.sqrt((F.lit(1.0) - tilt) * (F.lit(1.0) - tilt) + tilt * 4.0 * u))


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy, range-sorted by its own training position."""
    copy = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    share = (F.col("copy") * F.col("source_size") + F.col("words_before") + F.col("size") / F.lit(2.0)) / F.col("target")
    return copy.withColumn("position", when_reached(share, F.col("tilt"))).orderBy("position", "doc_id", "copy")


def scheduled(docs: DataFrame, **options) -> DataFrame:
    """``curriculum`` carried out: one row per document, counted from the copies in training order.

    The range-sorted copies are written; what a document takes, how often, and when it comes
    first are read from them, so a document without a copy there takes nothing.
    """
    mixed = stage(curriculum(docs.withColumn("__row", F.monotonically_increasing_id()), keep=["__row"], **options), "mixed")
    order = stage(training_order(mixed), "training-order")
    read = order.groupBy("__row").agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("taken"), F.min("position").alias("position"))
    whole = mixed.drop("copies", "taken", "position").join(read, "__row", "left").drop("__row")
    return whole.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("copies", "taken")})


#: The same rows for the given ``documents`` in DuckDB: levels by sorting sources by cap per weight.
SQL = r"""
WITH facts AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15) AS ord FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM facts GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM sums),
weighed AS (SELECT source, source_size, turn + 1 AS weight, (turn - 1) * 0.5::DOUBLE AS tilt, 3 * source_size AS cap FROM ranked),
lined AS (SELECT *, coalesce(sum(cap) OVER w, 0) AS caps, coalesce(sum(weight) OVER w, 0) AS used, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
    FROM weighed WINDOW w AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT (total - caps)::BIGINT AS rest, (weights - used)::BIGINT AS share FROM lined
    WHERE weight::HUGEINT * (total - caps) <= cap::HUGEINT * (weights - used) ORDER BY cap::DOUBLE / weight LIMIT 1),
targets AS (SELECT source, source_size, tilt, CASE WHEN weight::HUGEINT * rest > cap::HUGEINT * share THEN cap::DOUBLE ELSE weight::DOUBLE * rest::DOUBLE / share::DOUBLE END AS target
    FROM weighed, level),
passed AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM targets),
placed AS (SELECT doc_id, source, size, (sum(size) OVER (PARTITION BY source ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before FROM facts),
taken AS (SELECT p.*, s.source_size, s.target, s.tilt, s.passes + CASE WHEN target - passes * source_size > 0
    AND (2 * before + size)::DOUBLE <= 2 * (target - passes * source_size) THEN 1 ELSE 0 END AS copies
    FROM placed p JOIN passed s ON p.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, source, size, source_size, target, copies * size AS taken, copies,
    CASE WHEN copies > 0 AND target > 0 THEN u * 2.0 / ((1.0 - tilt) + sqrt((1.0 - tilt) * (1.0 - tilt) + tilt * 4.0 * u)) END AS position
FROM (SELECT *, least((before::DOUBLE + size / 2.0::DOUBLE) / target, 1.0::DOUBLE) AS u FROM taken)
"""
