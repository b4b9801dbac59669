"""Secret scans with multipart credential linking.

Strong finds stand alone: assignments, access keys and long hex strings. Weak candidates
(short or bare secrets, account names, endpoints) are noise by themselves and are only
reported where complementary parts of a credential stand together: they are placed on
the text as intervals, widened to a scope, and interval-joined per document. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import require, text_of
from ledgerline.session import stage

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # a run of 16 or more is the whole run
#: Account names and ids of access keys, in assignments.
IDENTIFIER = r"""(?i)(user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{3,})"""
#: Secrets by a weaker name, or of any length.
WEAK_SECRET = r"""(?i)(pwd|pass|credentials?|private_?key|auth)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})"""
#: Where a credential is used: addresses with a scheme, and named hosts.
ENDPOINT = r"""(?i)(?:[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+|(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/-]{3,})"""

ASSIGN_LEAST, ACCESS_LEAST = 12, 18
#: The kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "short", "secret", "identifier", "endpoint")
BASE = KINDS[:3]
#: Characters between parts of one credential.
SCOPE = 200
_SPAN = "struct<start:bigint,rank:int,end:bigint>"


def matches(text: Column, pattern: str, keep=None, group: int = 0) -> Column:
    """Array of (start, end) in code points of the leftmost non-overlapping matches.

    The pieces between matches and the matches themselves alternate, so their lengths
    give the places. ``keep`` judges a match by capture group ``group``; matches that fail are
    dropped after matching, as they still use up their text.
    """
    p = F.lit(pattern)
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0))
    judged = F.regexp_extract_all(text, p, F.lit(group)) if group else found
    parts = F.zip_with(F.slice(pieces, 1, F.size(found)), F.zip_with(found, judged, lambda m, g: F.struct(F.length(m).cast("long").alias("n"), (keep(g) if keep else F.lit(True)).alias("ok"))),
                       lambda piece, m: F.struct(F.length(piece).cast("long").alias("before"), m["n"].alias("n"), m["ok"].alias("ok")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def add(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["before"]
        end = start + m["n"]
        return F.struct(end.alias("at"), F.when(m["ok"], F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["out"]).alias("out"))

    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.when(F.regexp_like(text, p), F.aggregate(parts, zero, add, lambda acc: acc["out"])).otherwise(empty)


def ranked(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end")))


def joined(spans: str) -> Column:
    """kind:start:end, by start and then kind, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(F.col(spans)), lambda s: F.concat_ws(":", F.element_at(name, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _as_parts(spans: Column, kind: str, role: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(role).alias("role"), F.lit(KINDS.index(kind)).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(True).alias("weak")))


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak candidates with the roles of the parts around them: ``row, rank, start, end, roles``.

    ``parts`` has ``row, role, rank, start, end, weak``. The scopes of the candidates are
    joined with the parts by interval: both are cut into buckets of the scope's length, a
    part is in the buckets that it touches and a scope in those that it covers, so that a
    pair is only formed where the two are near, and a text of any length gives pairs in
    proportion to its length.
    """
    bucket = lambda c: F.floor(c / F.lit(scope)).cast("long")
    near = parts.select("row", F.col("role").alias("other"), F.col("start").alias("from"), F.col("end").alias("upto"),
                        F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))).alias("bucket"))
    wanted = parts.where("weak").select("row", "role", "rank", "start", "end", F.explode(F.sequence(bucket(F.col("start") - scope), bucket(F.col("end") + scope))).alias("bucket"))
    met = wanted.join(near, ["row", "bucket"]).where(
        (F.col("other") != F.col("role")) & (F.col("from") <= F.col("end") + scope) & (F.col("upto") >= F.col("start") - scope))
    return met.groupBy("row", "rank", "start", "end", "role").agg(F.collect_set("other").alias("roles"))


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: ``doc_id, base, spans``, arrays of (start, rank, end).

    ``base`` are the strong finds. ``spans`` adds the weak candidates that co-occur: a
    secret (a short assignment or one by a weaker name) with an identifier or endpoint
    within ``scope`` characters, an identifier with a secret, and an endpoint with both.
    A weak candidate that overlaps a strong find is that find. Places are code points, end
    exclusive. Null text is empty and has none. Rows with equal ids are separate
    documents. An empty table gives no rows. Other columns are not read.
    """
    require(docs, doc_id, text)
    t = F.col("__text")
    any_value = matches(t, ASSIGN, lambda g: F.length(g) >= 1, 2)
    long_value = matches(t, ASSIGN, lambda g: F.length(g) >= ASSIGN_LEAST, 2)
    finds = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("__text")).select(
        "doc_id", F.monotonically_increasing_id().alias("row"), long_value.alias("assign"), any_value.alias("any"),
        matches(t, ACCESS, lambda g: F.length(g) >= ACCESS_LEAST).alias("access"), matches(t, HEX).alias("hex"), matches(t, WEAK_SECRET).alias("secret"),
        matches(t, IDENTIFIER).alias("identifier"), matches(t, ENDPOINT).alias("endpoint"))
    finds = stage(finds, "finds")
    base = F.concat(*[ranked(F.col(k), k) for k in BASE])
    finds = finds.withColumns({"base": base, "short": F.array_except("any", "assign")})
    overlaps = lambda s: F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    weak = F.concat(*[_as_parts(F.filter(F.col(k), lambda s: ~overlaps(s)), k, r)
                      for k, r in (("short", "secret"), ("secret", "secret"), ("identifier", "identifier"), ("endpoint", "endpoint"))])
    # an access key names an account, the other strong finds are secrets
    strong = F.transform("base", lambda b: F.struct(F.when(b["rank"] == KINDS.index("access"), "identifier").otherwise("secret").alias("role"), b["rank"].alias("rank"),
                                                    b["start"].alias("start"), b["end"].alias("end"), F.lit(False).alias("weak")))
    parts = finds.withColumn("weak", weak).where(F.size("weak") > 0).select("row", F.explode(F.concat("weak", strong)).alias("p")).select("row", "p.*")
    linked = link_parts(parts, scope)
    has = lambda r: F.array_contains("roles", r)
    report = F.when(F.col("role") == "secret", has("identifier") | has("endpoint")).when(F.col("role") == "identifier", has("secret")).otherwise(has("secret") & has("identifier"))
    more = linked.where(report).groupBy("row").agg(F.collect_set(F.struct("start", "rank", "end")).alias("more"))
    out = finds.select("doc_id", "row", "base").join(more, "row", "left")
    return out.select("doc_id", "base", F.concat("base", F.coalesce("more", F.array().cast(f"array<{_SPAN}>"))).alias("spans"))


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(F.col(spans), lambda s: s["rank"] == KINDS.index(kind))).cast("long")


def _places(kind: str, pattern: str, group: int, condition: str) -> str:
    """DuckDB: start and end of the matches of one pattern whose group meets a condition."""
    p = pattern.replace("'", "''")
    return f"""SELECT r, '{kind}' AS kind, start, start + n AS stop FROM (SELECT r, len(found[i])::BIGINT AS n, g[i] AS g,
        (coalesce(list_sum(list_transform(pieces[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: len(x))), 0))::BIGINT AS start
        FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (SELECT r, string_split_regex(t, '{p}') AS pieces, regexp_extract_all(t, '{p}') AS found,
            regexp_extract_all(t, '{p}', {group}) AS g FROM d))) WHERE {condition}"""


#: The same rows in DuckDB: every candidate against every part of its document.
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
places AS MATERIALIZED ({" UNION ALL ".join([
    _places("assign", ASSIGN, 2, f"len(g) >= {ASSIGN_LEAST}"), _places("access", ACCESS, 0, f"len(g) >= {ACCESS_LEAST}"), _places("hex", HEX, 0, "true"),
    _places("short", ASSIGN, 2, f"len(g) < {ASSIGN_LEAST}"), _places("secret", WEAK_SECRET, 0, "true"), _places("identifier", IDENTIFIER, 0, "true"), _places("endpoint", ENDPOINT, 0, "true")])}),
roles AS (SELECT *, CASE WHEN kind IN ('identifier', 'access') THEN 'identifier' WHEN kind = 'endpoint' THEN 'endpoint' ELSE 'secret' END AS role,
    kind NOT IN {BASE} AS weak, list_position({list(KINDS)}, kind) AS rank FROM places),
kept AS (SELECT * FROM roles a WHERE NOT weak OR NOT EXISTS (SELECT 1 FROM roles b WHERE NOT b.weak AND b.r = a.r AND b.start < a.stop AND a.start < b.stop)),
near AS (SELECT a.r, a.kind, a.rank, a.start, a.stop, a.role, bool_or(b.role = 'identifier') AS i, bool_or(b.role = 'endpoint') AS e, bool_or(b.role = 'secret') AS s
    FROM kept a JOIN kept b ON a.r = b.r AND a.role <> b.role AND b.start <= a.stop + {SCOPE} AND b.stop >= a.start - {SCOPE} WHERE a.weak GROUP BY ALL),
shown AS (SELECT r, kind, rank, start, stop FROM kept WHERE NOT weak UNION
    SELECT r, kind, rank, start, stop FROM near WHERE CASE role WHEN 'secret' THEN i OR e WHEN 'identifier' THEN s ELSE s AND i END),
told AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER (kind IN {BASE}) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans FROM shown GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (r)
"""
