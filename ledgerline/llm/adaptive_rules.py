"""Quality rules whose cutoffs are learnt for each language and source from mergeable quantile sketches.

Native throughout. The facts of a text are expressions over its row. The sketch of a
metric is a table of counts in log-linear buckets (a bucket is at most 1/16 of its value
wide, small values have buckets of their own), so sketches merge by adding counts: a
group's sketch is combined map-side, and the sketches of its language and of all
documents are sums of it. A cutoff is a fence around the middle half of the group, and
documents are joined to the cutoffs of their group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import require, text_of
from ledgerline.session import stage

SPACE = r"\x20\x09-\x0D"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: Base rules: fewest words, and the most percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Leading bits of a value that its bucket keeps.
BITS = 4
#: A group with fewer documents takes the cutoffs of its language, a language with fewer those of all documents.
LEAST_DOCUMENTS = 50
#: Cutoffs lie this many times the distance of the quartiles beyond them ...
REACH = 4
#: ... and that distance counts as at least so much, in thousandths: a metric that hardly varies has no outliers nearby.
LEAST_SPREAD = {"word_length": 400, "symbols": 60, "dup_lines": 150, "repeats": 75}
#: Metrics with a lower cutoff too.
TWO_SIDED = ("word_length",)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` with the value computed once for the row."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words in windows (of a power of two words) that occur twice or more, compared by 64-bit hashes of their words' hashes."""
    def starts(found: Column) -> Column:
        placed = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return bound(placed, lambda s: F.sort_array(F.filter(F.transform(s, lambda x, i: F.when(
            (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"])), lambda x: x.isNotNull())))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, j: F.least(F.coalesce(F.get(at, j + 1) - p, F.lit(window)), F.lit(window))), F.lit(0).cast("long"), lambda n, x: n + x)

    def doubled(width: int) -> Callable[[Column], Column]:
        """Hashes of runs of 2 x width words from those of width words."""
        return lambda hashes: F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + width)))

    def windows(hashes: Column) -> Column:
        width, found = 1, hashes
        while width < window:
            found, width = bound(found, doubled(width)), width * 2
        return F.slice(found, 1, F.size(hashes) - (window - 1))

    def count(hashes: Column) -> Column:
        return bound(windows(hashes), lambda found: F.when(F.size(F.array_distinct(found)) < F.size(found), bound(starts(found), covered)).otherwise(F.lit(0).cast("long")))

    return F.when(F.size(words) > window, bound(F.transform(words, lambda w: F.xxhash64(w)), count)).otherwise(F.lit(0).cast("long"))


def text_facts(text: Column) -> Column:
    """Struct of the counts that the rules look at."""
    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(f"[^{SPACE}]")))
        return bound(F.regexp_replace(t, f"[{SPACE}]", " "), lambda plain: bound(F.array_remove(F.split(plain, " "), ""), lambda words: bound(lines, lambda held: F.struct(
            F.size(words).cast("long").alias("n_words"), F.length(F.replace(plain, F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.size(held).cast("long").alias("n_lines"),
            (F.size(held) - F.size(F.array_distinct(held))).cast("long").alias("n_dup_lines"), repeated_words(words).alias("n_repeat_words")))))
    return bound(text, of)


def metrics() -> dict[str, Column]:
    """Whole thousandths; null without words."""
    share = lambda part, of: F.expr(f"{part} * 1000 DIV nullif({of}, 0)")
    return {"word_length": share("word_chars", "n_words"), "symbols": share("n_symbols", "n_words"),
            "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words")}


def bucket(value: Column, bits: int = BITS) -> Column:
    """Least value of the bucket of a whole number: its leading ``bits`` + 1 binary digits, the others 0."""
    shift = F.greatest(F.length(F.bin(value)) - (bits + 1), F.lit(0))
    return (value - value % F.pow(F.lit(2), shift).cast("long")).cast("long")


def sketches(facts: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, metric, bucket, docs``: the sketch of every metric of every group."""
    found = metrics()
    long = facts.select(*groups, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), c.alias("value")) for m, c in found.items()])).alias("x"))
    return (long.select(*groups, "x.metric", "x.value").where(F.col("value").isNotNull())
            .groupBy(*groups, "metric", bucket(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("docs")))


def merged(sketch: DataFrame, groups: list[str]) -> DataFrame:
    return sketch.groupBy(*groups, "metric", "bucket").agg(F.sum("docs").alias("docs"))


def cutoffs(sketch: DataFrame, groups: list[str], reach: int = REACH) -> DataFrame:
    """``groups, metric, docs, low, high``: fences from the quartiles of each sketch, as many buckets as a sketch has in a window."""
    w = Window.partitionBy(*groups, "metric")
    ranked = sketch.select("*", F.sum("docs").over(w.orderBy("bucket")).alias("upto"), F.sum("docs").over(w).alias("total"))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket")))
    quartiles = ranked.groupBy(*groups, "metric").agg(F.max("total").alias("docs"), at(1).alias("q1"), at(3).alias("q3"))
    least = F.coalesce(*[F.when(F.col("metric") == m, F.lit(v)) for m, v in LEAST_SPREAD.items()])
    spread = F.greatest(F.col("q3") - F.col("q1"), least)
    return quartiles.select(*groups, "metric", "docs", F.when(F.col("metric").isin(*TWO_SIDED), F.col("q1") - reach * spread).alias("low"), (F.col("q3") + reach * spread).alias("high"))


def _wide(table: DataFrame, groups: list[str], prefix: str) -> DataFrame:
    one = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return table.groupBy(*groups).agg(F.max("docs").alias(f"{prefix}docs"), *[F.struct(one(m, "low").alias("low"), one(m, "high").alias("high")).alias(f"{prefix}{m}") for m in LEAST_SPREAD])


def group_cutoffs(facts: DataFrame, lang: str, source: str, least: int = LEAST_DOCUMENTS, reach: int = REACH) -> DataFrame:
    """One row per language and source, with the fences of the finest level that has ``least`` documents."""
    fine = stage(sketches(facts, [lang, source]), "sketches")
    own = _wide(cutoffs(fine, [lang, source], reach), [lang, source], "o_")
    by_lang = _wide(cutoffs(merged(fine, [lang]), [lang], reach), [lang], "l_").withColumnRenamed(lang, "__lang")
    whole = _wide(cutoffs(merged(fine, []), [], reach), [], "a_")
    level = F.when(F.col("o_docs") >= least, F.lit("source")).when(F.col("l_docs") >= least, F.lit("language")).otherwise(F.lit("all"))
    pick = lambda m: F.when(F.col("level") == "source", F.col(f"o_{m}")).when(F.col("level") == "language", F.col(f"l_{m}")).otherwise(F.col(f"a_{m}"))
    met = own.join(by_lang, F.col(lang).eqNullSafe(F.col("__lang"))).withColumn("__one", F.lit(1)).join(whole.withColumn("__one", F.lit(1)), "__one")
    return met.withColumn("level", level).select(F.col(lang).alias("__lang"), F.col(source).alias("__source"), "level", *[pick(m).alias(f"cut_{m}") for m in LEAST_SPREAD])


def apply_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
                least: int = LEAST_DOCUMENTS, reach: int = REACH) -> DataFrame:
    """One row per document: ``doc_id, lang, source``, the facts, ``base_failed, level, cut_*, kept``.

    A document fails the base with fewer than 20 words, or with more than 30 % of its
    words in 8-word windows that the text repeats. Of the others a document is kept if
    every metric lies within the cutoffs of its language and source. A null text counts
    as empty and fails the base; null languages and sources are groups of their own.
    Repeated rows are separate documents; an empty table gives no rows. Texts of any
    length are worked on in their row. Other columns are not read.
    """
    require(docs, doc_id, text, lang, source)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), text_facts(text_of(text)).alias("f"))
    facts = stage(rows.select("doc_id", "lang", "source", "f.*"), "facts")
    cuts = group_cutoffs(facts, "lang", "source", least, reach)
    met = facts.join(cuts, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left").drop("__lang", "__source")
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    within = F.lit(True)
    for m, value in metrics().items():
        low, high = F.coalesce(F.col(f"cut_{m}")["low"], F.lit(-1).cast("long")), F.col(f"cut_{m}")["high"]
        within = within & F.coalesce((bucket(value) >= low) & (bucket(value) <= high), F.lit(True))
    return met.withColumns({"base_failed": failed, "kept": ~failed & within})


_SPREAD = " ".join(f"WHEN '{m}' THEN {v}" for m, v in LEAST_SPREAD.items())
_SIDES = ", ".join(f"'{m}'" for m in TWO_SIDED)


def _fences(groups: str) -> str:
    names, head = (f"{groups}, metric", f"{groups}, metric,") if groups else ("metric", "metric,")
    return f"""SELECT {head} docs, CASE WHEN metric IN ({_SIDES}) THEN q1 - {REACH} * greatest(q3 - q1, least_spread) END AS low, q3 + {REACH} * greatest(q3 - q1, least_spread) AS high
    FROM (SELECT {head} max(total) AS docs, min(b) FILTER (upto * 4 >= total) AS q1, min(b) FILTER (upto * 4 >= total * 3) AS q3, CASE metric {_SPREAD} END AS least_spread
        FROM (SELECT {head} b, sum(n) OVER (PARTITION BY {names} ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {names}) AS total
            FROM (SELECT {head} b, count(*) AS n FROM long GROUP BY {names}, b)) GROUP BY {names})"""


#: The same rows in DuckDB.
SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
p AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
wins AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS met FROM (SELECT r, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM p))),
rep AS (SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM wins WHERE met > 1) GROUP BY r),
f AS (SELECT r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM p LEFT JOIN rep USING (r)),
long AS (SELECT r, lang, source, metric, v - v % (1::BIGINT << greatest(length(bin(v)) - {BITS + 1}, 0)) AS b FROM (
    SELECT r, lang, source, unnest([{{'metric': 'word_length', 'v': 1000 * word_chars // n_words}}, {{'metric': 'symbols', 'v': 1000 * n_symbols // n_words}},
        {{'metric': 'dup_lines', 'v': 1000 * n_dup_lines // n_lines}}, {{'metric': 'repeats', 'v': 1000 * n_repeat_words // n_words}}], recursive := true) FROM f WHERE n_words > 0)),
own AS ({_fences("lang, source")}), by_lang AS ({_fences("lang")}), whole AS ({_fences("")}),
verdict AS (SELECT long.r, bool_and(b >= coalesce(CASE lvl WHEN 'source' THEN own.low WHEN 'language' THEN by_lang.low ELSE whole.low END, -1)
        AND b <= CASE lvl WHEN 'source' THEN own.high WHEN 'language' THEN by_lang.high ELSE whole.high END) AS within, min(lvl) AS level
    FROM (SELECT long.*, CASE WHEN o.docs >= {LEAST_DOCUMENTS} THEN 'source' WHEN g.docs >= {LEAST_DOCUMENTS} THEN 'language' ELSE 'all' END AS lvl FROM long
        JOIN own o ON o.metric = long.metric AND o.lang IS NOT DISTINCT FROM long.lang AND o.source IS NOT DISTINCT FROM long.source
        JOIN by_lang g ON g.metric = long.metric AND g.lang IS NOT DISTINCT FROM long.lang) long
    JOIN own ON own.metric = long.metric AND own.lang IS NOT DISTINCT FROM long.lang AND own.source IS NOT DISTINCT FROM long.source
    JOIN by_lang ON by_lang.metric = long.metric AND by_lang.lang IS NOT DISTINCT FROM long.lang
    JOIN whole ON whole.metric = long.metric GROUP BY long.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, NOT base_failed AND coalesce(within, true) AS kept, level FROM (
    SELECT f.*, within, level, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM f LEFT JOIN verdict USING (r))
"""
