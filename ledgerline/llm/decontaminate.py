"""Benchmark decontamination by an FM-index for each training shard.

A shard is a bounded run of documents inside one task. Its words become numbers of the
benchmark's vocabulary; a word outside the vocabulary ends a run, and runs shorter than
the shortest window cannot hold one and are left out. The runs are indexed: suffix
order, Burrows-Wheeler transform in a wavelet matrix, every eighth suffix position.
All windows are searched backward at once through ranks, their occurrences are located
by walking to sampled positions, and the hit words of a document merge into removal
spans.

The benchmark is read in blocks of bounded size, one pass over the documents for each,
so that the windows sent to the tasks do not grow with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import require
from ledgerline.llm.records import blocks_of
from ledgerline.session import stage

WINDOW = 10
#: Text of one shard's index.
SHARD_BYTES = 8 << 20
#: Benchmark text of one pass.
BLOCK_BYTES = 16 << 20
SAMPLE = 8


def _word_bytes() -> bytes:
    """Byte table: letters lower-cased, digits and bytes from 0x80 kept, the rest space."""
    table = bytearray(b" " * 256)
    for b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        table[b] = b
    for b in range(0x41, 0x5B):
        table[b] = b + 0x20
    return bytes(table)


WORD_BYTES = _word_bytes()
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class WaveletMatrix:
    """Ranks of symbols in a sequence: a bit row per level, zeros before ones in the next."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.bits = max(1, (alphabet - 1).bit_length())
        self.ranks: list[np.ndarray] = []
        self.zeros: list[int] = []
        row = symbols
        for level in reversed(range(self.bits)):
            bit = ((row >> level) & 1).astype(bool)
            ones = np.zeros(len(row) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ranks.append(ones)
            self.zeros.append(len(row) - int(ones[-1]))
            row = np.concatenate([row[~bit], row[bit]])

    def _down(self, level: int, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
        ones = self.ranks[level][at]
        return np.where(bit, self.zeros[level] + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Number of each symbol before each position."""
        lo = np.zeros_like(at)
        for level in range(self.bits):
            bit = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            at, lo = self._down(level, at, bit), self._down(level, lo, bit)
        return at - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.int64)
        for level in range(self.bits):
            bit = self.ranks[level][at + 1] > self.ranks[level][at]
            out = (out << 1) | bit
            at = self._down(level, at, bit)
        return out


class FMIndex:
    """Backward search over runs of symbols 1.. ; a 0 ends each run."""

    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = SAMPLE):
        n = len(symbols)
        ends = np.flatnonzero(symbols == 0)
        # ends differ by place, so that no comparison runs from one run into the next
        rank = symbols.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))
        order, step = np.argsort(rank, kind="stable"), 1
        rank = self._ranks(rank[order][:, None], order)
        while n and rank.max() < n - 1:
            after = np.full(n, -1, dtype=np.int64)
            after[: n - step] = rank[step:]
            key = rank * (n + 1) + after + 1
            order = np.argsort(key, kind="stable")
            rank = self._ranks(key[order][:, None], order)
            step *= 2
        before = symbols[order - 1] if n else symbols
        before = np.where(order == 0, 0, before) if n else before
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet))])
        self.wavelet = WaveletMatrix(before.astype(np.int64), alphabet)
        starts = np.ones(n, dtype=bool)
        starts[1:] = symbols[:-1] == 0
        kept = (order % sample == 0) | starts[order] if n else np.zeros(0, dtype=bool)
        self.kept = kept
        self.kept_rank = np.concatenate([[0], np.cumsum(kept)])
        self.samples = order[kept] if n else order
        self.n = n

    @staticmethod
    def _ranks(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), dtype=np.int64)
        if len(order):
            rank[order] = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])
        return rank

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of windows, right-aligned in a matrix of symbols."""
        lo, hi = np.zeros(len(windows), dtype=np.int64), np.full(len(windows), self.n, dtype=np.int64)
        width = windows.shape[1]
        for back in range(width):
            live = (lengths > back) & (lo < hi)
            if not live.any():
                break
            c = windows[live, width - 1 - back]
            lo[live] = self.first[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.first[c] + self.wavelet.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back through the text to a sampled one."""
        found, at, steps, open_ = np.empty(len(rows), dtype=np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(open_):
            here = self.kept[at]
            done = open_[here]
            found[done] = self.samples[self.kept_rank[at[here]]] + steps
            open_, at = open_[~here], at[~here]
            if len(open_):
                c = self.wavelet.access(at)
                at = self.first[c] + self.wavelet.rank(c, at)
                steps += 1
        return found


@dataclass
class Phrases:
    """The distinct windows of a block of benchmark items."""

    number: dict[bytes, int]  # vocabulary, from 1
    windows: np.ndarray  # right-aligned symbols
    lengths: np.ndarray
    items: list[list[int]]  # numbers of the items that hold each window
    item_ids: list

    @classmethod
    def of(cls, items: Sequence[tuple[object, bytes | None]], size: int = WINDOW) -> Phrases:
        number: dict[bytes, int] = {}
        seen: dict[tuple, set[int]] = {}
        for k, (_, text) in enumerate(items):
            w = [number.setdefault(x, len(number) + 1) for x in words_of(text)]
            for at in range(max(1, len(w) - size + 1) if w else 0):
                seen.setdefault(tuple(w[at : at + size]), set()).add(k)
        windows = np.zeros((len(seen), size), dtype=np.int64)
        for row, w in enumerate(seen):
            windows[row, size - len(w) :] = w
        return cls(number, windows, np.array([len(w) for w in seen], dtype=np.int64), [sorted(s) for s in seen.values()], [i for i, _ in items])

    def occurrences(self, docs: Sequence[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, word position and window of every occurrence in a shard."""
        none = np.zeros(0, dtype=np.int64)
        if not len(self.lengths):
            return none, none, none
        get = self.number.get
        sizes = np.array([len(d) + 1 for d in docs], dtype=np.int64)
        flat = np.fromiter((s for d in docs for s in (*(get(w, 0) for w in d), 0)), dtype=np.int64, count=int(sizes.sum()))
        # runs of vocabulary words that are long enough for the shortest window
        stops = np.flatnonzero(flat == 0)
        starts = np.concatenate([[0], stops[:-1] + 1])
        length = stops - starts
        long = length >= self.lengths.min()
        starts, length = starts[long], length[long] + 1  # with the 0 that ends the run
        if not len(starts):
            return none, none, none
        base = np.cumsum(length) - length
        source = np.repeat(starts - base, length) + np.arange(int(length.sum()))
        index = FMIndex(flat[source], len(self.number) + 1)
        lo, hi = index.search(self.windows, self.lengths)
        hits = np.flatnonzero(hi > lo)
        count = hi[hits] - lo[hits]
        first = np.cumsum(count) - count
        rows = np.repeat(lo[hits] - first, count) + np.arange(int(count.sum()))
        at = source[index.locate(rows)]
        doc_start = np.cumsum(sizes) - sizes
        doc = np.searchsorted(doc_start, at, side="right") - 1
        return doc, at - doc_start[doc], np.repeat(hits, count)


    def by_document(self, docs: Sequence[list[bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For every document of a shard the positions and windows of its occurrences."""
        doc, at, window = self.occurrences(docs)
        order = np.argsort(doc, kind="stable")
        at, window = at[order], window[order]
        cut = np.searchsorted(doc[order], np.arange(len(docs) + 1))
        for d in range(len(docs)):
            yield d, at[cut[d] : cut[d + 1]], window[cut[d] : cut[d + 1]]


def merged(starts: np.ndarray, lengths: np.ndarray, words: int) -> list[tuple[int, int]]:
    """Word spans, end exclusive, that cover the occurrences of one document."""
    edge = np.zeros(words + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    hit = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
    turns = np.flatnonzero(hit[1:] != hit[:-1])
    return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


def list_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark's items in blocks of about ``block_bytes`` of text, each small enough for the driver and a broadcast."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).cast("binary").alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    if blocks == 1:
        return [items]
    dealt = stage(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items", ["block"])
    return [dealt.where(F.col("block") == b) for b in range(blocks)]


def read_block(block: DataFrame) -> list[tuple[object, bytes]]:
    rows = [(r[0], bytes(r[1])) for r in block.select("item_id", "text").collect()]
    return sorted(rows, key=lambda r: (r[0] is None, str(r[0]), r[1]))


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    for batch in batches:
        for a, z in blocks_of(batch.column("text"), shard_bytes):
            yield batch, a, z


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _found(shared, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = shared.value
        for batch, a, z in _shards(batches, shard_bytes):
            docs = [words_of(t) for t in batch.column("text").slice(a, z - a).to_pylist()]
            spans, items = [], []
            for d, at, window in phrases.by_document(docs):
                spans.append([{"start": s, "end": e} for s, e in merged(at, phrases.lengths[window], len(docs[d]))])
                held = {k for w in set(window.tolist()) for k in phrases.items[w]}
                items.append(sorted({str(phrases.item_ids[k]) for k in held if phrases.item_ids[k] is not None}))
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, z - a) for c in kept], pa.array([len(d) for d in docs], pa.int64()), pa.array(spans, _SPANS),
                                              pa.array(items, pa.list_(pa.string()))], [*kept, "n_words", "spans", "items"])
    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
               block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: ``doc_id, n_words, spans, items``.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A
    window is 10 consecutive words of an item, or a shorter item whole. ``spans`` are the
    merged word spans covered by occurrences of windows, ``items`` the ids, as sorted
    strings, of the items with occurring windows; an item without an id is searched for
    but not named. Null and empty texts have no words and no spans; items without words
    have no windows. Equal rows are separate documents. An empty documents table gives no
    rows, an empty benchmark no spans. Other columns are not read.
    """
    require(docs, doc_id, text)
    require(benchmark, item_id, item_text)
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    blocks = list_blocks(benchmark, item_id, item_text, block_bytes)
    found_ddl = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"
    if len(blocks) == 1:
        return rows.mapInArrow(_found(spark.sparkContext.broadcast(Phrases.of(read_block(blocks[0]))), shard_bytes), f"doc_id {kind}, {found_ddl}")
    # the passes meet again by place, since ids may repeat
    numbered = stage(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")
    passes = [stage(numbered.mapInArrow(_found(spark.sparkContext.broadcast(Phrases.of(read_block(b))), shard_bytes), f"doc_id {kind}, __row long, {found_ddl}"), "pass")
              for b in blocks]
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    met = found.groupBy("__row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
                                     F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return met.select("doc_id", "n_words", union_spans("spans").alias("spans"), "items")


def union_spans(column: str) -> Column:
    """Overlapping and touching spans of several passes as one."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(last["end"] >= s["start"], F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(F.col(column)), empty, add)


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text.translate(WORD_BYTES))]
    out, done = [], 0
    for start, end in spans:
        out.append(text[done : at[start][0]])
        done = at[end - 1][1]
    return b"".join([*out, text[done:]])


def _cleaned(shared, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = shared.value
        for batch, a, z in _shards(batches, shard_bytes):
            texts = batch.column("text").slice(a, z - a).to_pylist()
            cut = batch.column("cut").slice(a, z - a).to_pylist()
            open_ = list(range(len(texts)))
            while open_:  # words on both sides of a cut may form a window anew
                docs = [words_of(texts[i]) for i in open_]
                again = []
                for d, at, window in phrases.by_document(docs):
                    if len(at):
                        i = open_[d]
                        texts[i] = _cut(texts[i], merged(at, phrases.lengths[window], len(docs[d])))
                        cut[i] = True
                        again.append(i)
                open_ = again
            columns = [pa.array(texts, pa.binary()) if c == "text" else pa.array(cut, pa.bool_()) if c == "cut" else batch.column(c).slice(a, z - a) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)
    return run


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents with all removal spans cut from their texts and a column ``cut``.

    Texts without an occurrence stay as they are, null ones too. A text is searched again
    after a cut until nothing is found; with several blocks of the benchmark the passes
    are repeated until none cuts anything. Equal rows are separate documents; an empty
    table gives no rows. All columns stay, but ``cut`` replaces a column of its name.
    """
    require(docs, text)
    require(benchmark, item_id, item_text)
    spark, others = docs.sparkSession, [c for c in docs.columns if c not in (text, "cut")]
    packed = docs.select(F.col(text).cast("binary").alias("text"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"), F.lit(False).alias("cut")) if others \
        else docs.select(F.col(text).cast("binary").alias("text"), F.lit(None).cast("int").alias("others"), F.lit(False).alias("cut"))
    ddl = packed.schema
    blocks = [spark.sparkContext.broadcast(Phrases.of(read_block(b))) for b in list_blocks(benchmark, item_id, item_text, block_bytes)]
    for shared in blocks:
        packed = packed.mapInArrow(_cleaned(shared, shard_bytes), ddl)
    while len(blocks) > 1:
        done = stage(packed, "cleaned")
        again = done.withColumn("cut", F.lit(False))
        for shared in blocks:
            again = again.mapInArrow(_cleaned(shared, shard_bytes), ddl)
        packed = done
        if again.where("cut").isEmpty():
            break
        packed = done
        for shared in blocks:
            packed = packed.mapInArrow(_cleaned(shared, shard_bytes), ddl)
    columns = {text: F.col("text").cast("string").alias(text)}
    return packed.select(*[columns.get(c, F.col("others")[c].alias(c)) for c in docs.columns if c != "cut"], "cut")


#: The same rows in DuckDB: every window of a document against the windows of the items.
SQL = r"""
WITH low AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS win, least(len(w), 10) AS n
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
found AS (SELECT r, i, n, win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i, array_to_string(w[i : i + n - 1], ' ') AS win FROM low, sizes WHERE len(w) >= n)
    SEMI JOIN (SELECT DISTINCT win, n FROM windows) USING (win, n)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
item AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found JOIN windows USING (win, n) WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated FROM low LEFT JOIN hit USING (r) LEFT JOIN item USING (r)
"""
