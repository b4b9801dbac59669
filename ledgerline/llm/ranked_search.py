"""Ranked lexical search by a K2-treap over each shard's grid of terms and documents.

A first reading turns every text into its number of terms and the counts of those terms
that the items ask for; document frequencies are sums over these postings. Then every
task builds the grids of its shards: a quadtree whose cells, terms by documents, keep
the largest impact below them. The tree is stored level by level as one bit for each
quadrant with ranks, and maxima as differences to the parent's. An item descends along
the row paths of all its terms at once: the document range with the highest possible
score is halved first, and the search ends when no range can reach the item's best
documents so far, which carry over from shard to shard of a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import require, single
from ledgerline.llm.decontaminate import WORD_BYTES, list_blocks, read_block, words_of
from ledgerline.llm.records import blocks_of
from ledgerline.llm.wordscan import scan
from ledgerline.session import stage

MOST = 20
#: Text of the items searched in one pass over the documents.
ITEM_BYTES = 1 << 20
BLOCK_BYTES = 8 << 20
#: Cells of one grid.
SHARD_CELLS = 1 << 20
#: Document ranges halved at a time, at first and at most.
FIRST_RANGES, MOST_RANGES = 16, 1024
SALTS = 64


class K2Treap:
    """Quadtree of maxima over cells ``(row, column)``, all distinct, on a grid of ``2**depth`` rows and columns."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray):
        side = int(max(rows.max(initial=0), columns.max(initial=0))) + 1
        self.depth = max(1, (side - 1).bit_length())
        code = (self._spread(rows) << np.uint64(1)) | self._spread(columns)
        order = np.argsort(code)
        code, top = code[order], values[order].astype(np.int64)
        bits, less = [], []
        for _ in range(self.depth):
            parent = code >> np.uint64(2)
            start = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])) if len(parent) else np.zeros(0, np.int64)
            of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(parent))))
            most = np.maximum.reduceat(top, start) if len(start) else top
            level = np.zeros(4 * len(start), dtype=np.uint8)
            level[4 * of + (code & np.uint64(3)).astype(np.int64)] = 1
            bits.append(level)
            less.append(most[of] - top)
            code, top = parent[start], most
        self.top = int(top[0]) if len(top) else 0
        flat = np.concatenate(bits[::-1])
        packed = np.packbits(np.pad(flat, (0, -len(flat) % 64)), bitorder="little").view(np.uint64)
        self.bits = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.uint32)
        gaps = np.concatenate([np.zeros(1, np.int64), *less[::-1]])  # nodes in level order, the root first
        self.less = gaps.astype(np.min_scalar_type(int(gaps.max(initial=0))))

    @staticmethod
    def _spread(x: np.ndarray) -> np.ndarray:
        """A zero before every bit."""
        x = x.astype(np.uint64)
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = (x | (x << np.uint64(shift))) & np.uint64(mask)
        return x

    def child(self, nodes: np.ndarray, quadrant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a node has the quadrant, and the number of that node."""
        at = 4 * nodes + quadrant
        word, low = self.bits[at >> 6], (at & 63).astype(np.uint64)
        upto = word & ((np.uint64(2) << low) - np.uint64(1))
        return (word >> low) & np.uint64(1) != 0, self.before[at >> 6] + np.bitwise_count(upto)


@dataclass
class Best:
    """The best documents of an item so far, highest score first, then smallest id, those without id last."""

    most: int
    score: np.ndarray
    missing: np.ndarray
    doc_id: np.ndarray

    @classmethod
    def none(cls, most: int) -> Best:
        return cls(most, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))

    def add(self, score: np.ndarray, missing: np.ndarray, doc_id: np.ndarray) -> None:
        score, missing, doc_id = np.concatenate([self.score, score]), np.concatenate([self.missing, missing]), np.concatenate([self.doc_id, doc_id])
        order = np.lexsort((doc_id, missing, -score))[: self.most]
        self.score, self.missing, self.doc_id = score[order], missing[order], doc_id[order]

    def open(self, bound: np.ndarray, missing: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
        """Ranges that may still hold one of the best, by their bound and first document."""
        if len(self.score) < self.most:
            return bound > 0
        s, m, d = self.score[-1], self.missing[-1], self.doc_id[-1]
        return (bound > s) | ((bound == s) & ((missing < m) | ((missing == m) & (doc_id < d))))


def search(tree: K2Treap, rows: np.ndarray, weights: np.ndarray, best: Best, missing: np.ndarray, doc_id: np.ndarray) -> None:
    """Descends along all rows at once, the range with the highest bound first; columns are documents in the order of ``Best``."""
    depth, k = tree.depth, len(rows)
    bound, level, column = np.array([tree.top * int(weights.sum())]), np.zeros(1, np.int64), np.zeros(1, np.int64)
    nodes, tops = np.zeros((1, k), np.int64), np.full((1, k), tree.top, np.int64)
    last, wide = len(doc_id) - 1, FIRST_RANGES
    while len(bound):
        first = column << (depth - level)
        open_ = (first <= last) & best.open(bound, missing[np.minimum(first, last)], doc_id[np.minimum(first, last)])
        if not open_.all():
            bound, level, column, first, nodes, tops = bound[open_], level[open_], column[open_], first[open_], nodes[open_], tops[open_]
        if not len(bound):
            break
        order = np.lexsort((first, -bound))
        now, later = order[:wide], order[wide:]
        wide = min(2 * wide, MOST_RANGES)
        bit = 2 * ((rows[None, :] >> (depth - 1 - level[now])[:, None]) & 1)
        held, at = tops[now] > 0, nodes[now]
        parts = []
        for half in (0, 1):
            there, below = tree.child(at, bit + half)
            there &= held
            below = np.where(there, below, 0)
            top = np.where(there, tops[now] - tree.less[below], 0)
            parts.append((top @ weights, level[now] + 1, 2 * column[now] + half, below, top))
        new = [np.concatenate(x) for x in zip(*parts, strict=True)]
        some = new[0] > 0
        leaf = some & (new[1] == depth)
        if leaf.any():
            c = new[2][leaf]
            best.add(new[0][leaf], missing[c], doc_id[c])
        inner = some & (new[1] < depth)
        bound, level, column, nodes, tops = (np.concatenate([old[later], x[inner]]) for old, x in zip((bound, level, column, nodes, tops), new, strict=True))


@dataclass
class Items:
    """A block of items: their ids and the terms they ask for, numbered over the block."""

    item_ids: list
    vocabulary: list[bytes]
    terms: list[tuple[np.ndarray, np.ndarray]]  # numbers and repeats of each item's terms

    @classmethod
    def of(cls, items: list[tuple[object, bytes]]) -> Items:
        number: dict[bytes, int] = {}
        terms = []
        for _, text in items:
            asked = np.array([number.setdefault(w, len(number)) for w in words_of(text)], dtype=np.int64)
            terms.append(np.unique(asked, return_counts=True))
        return cls([i for i, _ in items], list(number), terms)

    def weighted(self, frequency: dict[int, int], documents: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Terms of each item with weights above 0, repeats included."""
        w = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency.get(t, 0) + 1))) for t in range(len(self.vocabulary))], dtype=np.int64)
        found = [(t, n * w[t]) for t, n in self.terms]
        return [(t[x > 0], x[x > 0]) for t, x in found]


def _postings(shared):
    """Number of terms of every text that has any, and the counts of the items' terms in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(shared.value, pa.binary())
        width = max(1, len(vocabulary))
        for batch in batches:
            for a, z in blocks_of(batch.column("text"), BLOCK_BYTES):
                part = batch.slice(a, z - a)
                found = scan(part.column("text").to_pylist(), WORD_BYTES)
                n = np.bincount(found.text, minlength=z - a)
                term = pc.fill_null(pc.index_in(found.words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                key, count = np.unique((found.text * width + term)[term >= 0], return_counts=True)
                ends = np.cumsum(np.concatenate([[0], np.bincount(key // width, minlength=z - a)])) * 4
                binary = lambda x, e=ends: pa.Array.from_buffers(pa.binary(), len(e) - 1, [None, pa.py_buffer(e.astype(np.int32)), pa.py_buffer(x.astype(np.int32))])
                rows = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), binary(key % width), binary(count)], ["doc_id", "n", "terms", "counts"])
                yield rows.filter(pa.array(n > 0))
    return run


def _numbers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int32).astype(np.int64)


def _frequencies(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(width, dtype=np.int64)
        for batch in batches:
            held += np.bincount(_numbers(batch.column("terms")), minlength=width)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some], pa.int64())], ["term", "docs"])
    return run


def _shards(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        for a, z in blocks_of(batch.column("terms"), 4 * cells):
            part = batch.slice(a, z - a)
            more = sum(x or 0 for x in pc.binary_length(part.column("terms")).to_pylist()) // 4
            if held and size + more > cells:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += more
    if held:
        yield pa.Table.from_batches(held)


def _searched(shared, documents: int, terms: int, most: int, cells: int):
    """The best documents of a task for every item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[tuple[np.ndarray, np.ndarray]] = shared.value
        best = [Best.none(most) for _ in items]
        for shard in _shards(batches, cells):
            ids = shard.column("doc_id")
            missing = ids.is_null().to_numpy()
            doc_id = pc.fill_null(ids, 0).to_numpy()
            order = np.lexsort((doc_id, missing))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            held = np.array(pc.binary_length(shard.column("terms")).to_pylist(), dtype=np.int64) // 4
            term, tf = _numbers(shard.column("terms")), _numbers(shard.column("counts"))
            if not len(term):
                continue
            norm = 100 - 25 + (25 * shard.column("n").to_numpy() * documents) // terms
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(norm, held))
            asked, row = np.unique(term, return_inverse=True)
            tree = K2Treap(row, np.repeat(place, held), impact)
            for mine, (wanted, weight) in zip(best, items, strict=True):
                at = np.minimum(np.searchsorted(asked, wanted), len(asked) - 1)
                there = asked[at] == wanted
                if there.any():
                    search(tree, at[there], weight[there], mine, missing[order], doc_id[order])
        for i, b in enumerate(best):
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), i), pa.int32(), safe=False), pa.array(b.doc_id, pa.int64(), mask=b.missing), pa.array(b.score, pa.int64())], ["item", "doc_id", "score"])
    return run


def ranked_search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  most: int = MOST, item_bytes: int = ITEM_BYTES, cells: int = SHARD_CELLS) -> DataFrame:
    """The ``most`` best documents of every item: ``item_id, rank, doc_id, score``.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. Scores
    are whole numbers above 0, equal ones ranked by ascending id (whole numbers; documents
    without an id last). Null texts have no terms: such documents are in no result and do
    not count, such items have no rows. Repeated documents are separate documents, and
    items with the same id are ranked each for itself. An empty table on either side
    gives no rows. Other columns are not read.
    """
    require(docs, doc_id, text)
    require(items, item_id, item_text)
    spark, kind = docs.sparkSession, items.schema[item_id].dataType
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    out = None
    for block in list_blocks(items, item_id, item_text, item_bytes):
        asked = Items.of(read_block(block))
        words = spark.sparkContext.broadcast(asked.vocabulary)
        held = stage(rows.mapInArrow(_postings(words), "doc_id long, n long, terms binary, counts binary"), "postings")
        sums = single(held.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).collect(), "sums over the documents")
        found = held.select("terms").mapInArrow(_frequencies(len(asked.vocabulary)), "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))
        weighted = spark.sparkContext.broadcast(asked.weighted({r.term: r.docs for r in found.collect()}, sums.documents))  # at most the terms of a block of items
        hits = held.mapInArrow(_searched(weighted, sums.documents, sums.terms or 1, most, cells), "item int, doc_id long, score long")
        hits = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        few = hits.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= most)
        top = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= most)
        names = spark.createDataFrame(list(enumerate(asked.item_ids)), f"item int, item_id {kind.simpleString()}")
        ranked = top.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out


#: The same rows in DuckDB.
SQL = r"""
WITH terms AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS r, * FROM documents)),
doc AS (SELECT r, doc_id, count(*) AS n FROM terms GROUP BY r, doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM doc),
asked AS (SELECT i, item_id, term, count(*) AS repeats FROM (SELECT i, item_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS i, * FROM benchmark)) GROUP BY ALL),
held AS (SELECT r, term, count(*) AS tf FROM terms SEMI JOIN asked USING (term) GROUP BY r, term),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY term), total),
scored AS (SELECT i, item_id, r, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))))::BIGINT AS score
    FROM asked JOIN held USING (term) JOIN weight USING (term) JOIN doc USING (r), total GROUP BY i, item_id, r)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
    SELECT i, item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored JOIN doc USING (r) WHERE score > 0) WHERE rank <= 20
"""
