"""Exact duplicates by Grace hash partitioning and complete comparison.

1. Every batch of rows is folded in an open-addressing table that compares complete
   normalised contents: one record per distinct text of the batch, and for each row a
   link to its record. A group of copies with a third of all rows shrinks to a record
   per batch before anything is shuffled.
2. The records are spilled to written files, with the content on the record's row only.
3. Buckets are planned from the digests and lengths alone: a bucket whose distinct
   contents exceed the memory of a table is partitioned again by the next seed, and so
   on until each fits, so that contents move once, to their last bucket.
4. A text met in very many records is folded again in salted parts first.
5. Each bucket fits an open-addressing table, which gives every record its group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import require
from ledgerline.session import stage

#: Distinct content that one bucket's table may hold.
BUCKET_BYTES = 16 << 20
#: Records of one text that one table may have to compare; more are folded in salted parts.
RECORDS_PER_TEXT = 2_000
#: Content of one map-side table.
FOLD_BYTES = 8 << 20
FANOUT = 16
_SPACE = b" \t\n\r\x0b\x0c"


def normalise(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one space; ends are kept as one space."""
    if not text:
        return text
    inner = b" ".join(text.split())
    if not inner:
        return b" "
    return (b" " if text[:1] in _SPACE else b"") + inner + (b" " if text[-1:] in _SPACE else b"")


class ContentTable:
    """Open addressing with linear probing; a slot holds the number of a distinct content."""

    def __init__(self, expected: int):
        self.mask = (1 << max(4, (2 * expected - 1).bit_length())) - 1
        self.slots = np.full(self.mask + 1, -1, dtype=np.int64)
        self.contents: list[bytes] = []

    def add(self, key: int, content: bytes) -> tuple[int, bool]:
        """Number of the content, and whether it is new. ``key`` only picks the first slot."""
        if 2 * len(self.contents) > self.mask:
            raise OverflowError("the table was made for fewer contents")
        at = key & self.mask
        while True:
            found = int(self.slots[at])
            if found < 0:
                self.slots[at] = len(self.contents)
                self.contents.append(content)
                return len(self.contents) - 1, True
            if self.contents[found] == content:
                return found, False
            at = (at + 1) & self.mask


_RECORDS = pa.schema([("doc_id", pa.int64()), ("rep", pa.int64()), ("digest", pa.binary()), ("records", pa.int64()), ("content", pa.binary()), ("bytes", pa.int64())])
_RECORD_DDL = "doc_id long, rep long, digest binary, records long, content binary, bytes long"
#: Stands for a null id inside the fold: no rank below it exists.
_NO_ID = -(2**63)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list = []
    texts: list[bytes] = []
    held = 0

    def flush() -> pa.RecordBatch:
        table = ContentTable(len(texts))
        digests, number, rep, count = [], [], [], []
        for i, text in zip(ids, texts, strict=True):
            digest = hashlib.sha256(text).digest()
            n, new = table.add(int.from_bytes(digest[:8], "big"), text)
            number.append(n)
            if new:
                digests.append(digest)
                rep.append(i)
                count.append(1)
            else:
                count[n] += 1
                if _before(i, rep[n]):
                    rep[n] = i
        shown: set[int] = set()
        rows: list[tuple] = []
        for i, n in zip(ids, number, strict=True):
            own = i == rep[n] and n not in shown
            if own:
                shown.add(n)
            rows.append((i, rep[n], digests[n], count[n] if own else None, table.contents[n] if own else None, len(table.contents[n])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RECORDS.types, strict=True)], schema=_RECORDS)

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = normalise(text.as_py() or b"")
            ids.append(i)
            texts.append(text)
            held += len(text) + 100
            if held >= FOLD_BYTES:
                yield flush()
                ids, texts, held = [], [], 0
    if ids:
        yield flush()


def _before(a: int | None, b: int | None) -> bool:
    """Order of ids, null last."""
    return a is not None and (b is None or a < b)


def plan_buckets(texts: DataFrame, bucket_bytes: int, fanout: int = FANOUT) -> tuple[int, list[DataFrame]]:
    """From ``digest, bytes`` of the distinct contents: the number of first buckets, and per level the buckets that go on."""
    total = texts.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    first, levels = max(1, -(-int(total) * 2 // bucket_bytes)), []
    while True:
        held = in_buckets(texts, first, levels, fanout).groupBy("bucket").agg(F.sum("bytes").alias("held"), F.count(F.lit(1)).alias("texts"))
        large = stage(held.where((F.col("held") > bucket_bytes) & (F.col("texts") > 1)).select("bucket", F.lit(True).alias("__large")), "large")
        if large.isEmpty():
            return first, levels
        levels.append(large)


def in_buckets(records: DataFrame, first: int, levels: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """Adds ``bucket``: the path of hash values under one seed after another, to where the bucket fits."""
    out = records.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(first)).cast("string"))
    for seed, large in enumerate(levels, 1):
        part = F.pmod(F.xxhash64("digest", F.lit(seed)), F.lit(fanout)).cast("string")
        out = out.join(large, "bucket", "left").withColumn("bucket", F.when(F.col("__large"), F.concat("bucket", F.lit("."), part)).otherwise(F.col("bucket"))).drop("__large")
    return out


def _merge(t: pa.Table) -> pa.Table:
    """One bucket: groups of its records by complete content."""
    table = ContentTable(t.num_rows)
    number, rep, count = [], [], []
    for i, digest, n, content in zip(t["rep"].to_pylist(), t["digest"].to_pylist(), t["records"].to_pylist(), t["content"], strict=True):
        k, new = table.add(int.from_bytes(digest[:8], "big"), content.as_py())
        number.append(k)
        if new:
            rep.append(i)
            count.append(n)
        else:
            count[k] += n
            if _before(i, rep[k]):
                rep[k] = i
    return pa.table({"rep": t["rep"], "digest": t["digest"], "keep_id": pa.array([rep[k] for k in number], pa.int64()), "group_size": pa.array([count[k] for k in number], pa.int64())})


def _merge_part(t: pa.Table) -> pa.Table:
    """A salted part of a text's records: one record for each distinct content."""
    m = _merge(t)
    first: dict[tuple, int] = {}
    for at, key in enumerate(zip(m["digest"].to_pylist(), m["keep_id"].to_pylist(), strict=True)):
        first.setdefault(key, at)
    at = pa.array(list(first.values()), pa.int64())
    return pa.table({"rep": m["keep_id"].take(at), "digest": m["digest"].take(at), "records": m["group_size"].take(at), "content": t["content"].take(at)})


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES, records_per_text: int = RECORDS_PER_TEXT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after replacing each run of ASCII white space by one
    space; null counts as empty. The smallest id of a group stays, a null id only if its
    group has no other. Rows that repeat an id and text are copies of each other and all
    count: every row with the group's id is marked kept. An empty table gives no rows.
    Other columns are not read.
    """
    require(docs, doc_id, text)
    spilled = stage(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(_fold, _RECORD_DDL), "records")
    records = spilled.where(F.col("records").isNotNull())
    met = stage(records.groupBy("digest").agg(F.count(F.lit(1)).alias("met"), F.max("bytes").alias("bytes")), "met")
    first, levels = plan_buckets(met.select("digest", "bytes"), bucket_bytes)
    frequent = met.where(F.col("met") > records_per_text).select("digest", "met")
    parts = records.select("rep", "digest", "records", "content")
    lean = parts
    if not frequent.isEmpty():
        salt = F.pmod(F.xxhash64("rep", F.spark_partition_id()), F.ceil(F.col("met") / records_per_text))
        some = parts.join(frequent, "digest").withColumn("__salt", salt)
        folded = some.groupBy("digest", "__salt").applyInArrow(_merge_part, "rep long, digest binary, records long, content binary")
        lean = parts.join(frequent, "digest", "left_anti").unionByName(folded)
    grouped = in_buckets(lean, first, levels).groupBy("bucket").applyInArrow(_merge, "rep long, digest binary, keep_id long, group_size long")
    groups = stage(grouped, "groups")
    if lean is not parts:  # a record folded into a part has the group of its text
        text_group = groups.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
        reps = records.select("rep", "digest").distinct().join(text_group, "digest")
    else:
        reps = groups.distinct()
    linked = spilled.select("doc_id", F.col("rep").alias("__rep"), F.col("digest").alias("__digest")).join(
        reps, F.col("rep").eqNullSafe(F.col("__rep")) & (F.col("digest") == F.col("__digest")))
    return linked.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


#: The same rows in DuckDB.
SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents),
g AS (SELECT text, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.text) AS text_sha256 FROM n JOIN g ON n.text = g.text
"""
