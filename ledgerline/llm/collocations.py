"""Phrases whose words stand together more often than their parts would, by partitioned (SON) mining.

The documents fall into a fixed number of shards. A phrase with a count of at least the
support has, in one shard at least, a count of at least the support times the shard's
share of all text, so mining each shard completely at its lowered support and uniting
what is found misses nothing. Candidates whose local counts, with the most they can have
in the other shards, stay below the support go again. A second reading counts every
candidate exactly.

A shard may be far larger than a task: the tasks reduce blocks of text to sorted phrase
hashes with counts, packed as binary values, and the blocks of a shard meet by ranges
of the hash, each range bounded. Single words and pairs are mined first; a longer
phrase is only looked at where all its pairs are candidates. What the tasks know of
the candidates is a bit table of bounded size: with more candidates it lets more
phrases through to the exact count, and never fewer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import require
from ledgerline.llm.records import blocks_of
from ledgerline.llm.wordscan import BREAK, SPACE, Words, scan
from ledgerline.session import stage

SUPPORT, LONGEST = 100, 5
#: A phrase goes if a longer one that holds it has this percentage of its count.
SHARE = 100
MOST = 2000
SHARDS = 8
BLOCK_BYTES = 4 << 20
#: Hashes are kept to 40 bits within a range; a range holds about so many entries of a shard.
LOW_BITS, RANGE_ROWS = 40, 2_000_000
#: Bits for each candidate in the bit table, and most bits in all (32 MB).
BITS_EACH, MOST_BITS = 16, 1 << 28
SLICE_BITS = 1 << 16
#: Counts of blocks that a task holds before it combines them.
COMBINED = 1_000_000
SALTS = 64
NO_LANG = "und"

_MUL = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _table() -> bytes:
    table = bytearray(range(256))
    for b in range(0x41, 0x5B):
        table[b] = b + 0x20
    for b in b".,;:!?\n\x0b\x0c\r":
        table[b] = BREAK
    table[9] = SPACE
    return bytes(table)


#: A-Z lower-cased, separators as full stops, tabs as spaces.
PIECES = _table()


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= _MUL[0]
    x ^= x >> np.uint64(27)
    x *= _MUL[1]
    return x ^ (x >> np.uint64(31))


def _number(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")


class Phrases:
    """Hashes of the phrases that start at each word of a block, by length, for texts of given languages."""

    def __init__(self, found: Words, langs: list[str]):
        coded = found.words.dictionary_encode()
        self.ids = coded.indices.to_numpy(zero_copy_only=False)
        own = np.fromiter((_number(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
        self.lang_names, self.lang_of_text = np.unique(np.array(langs, dtype=object), return_inverse=True) if langs else (np.array([], dtype=object), np.zeros(0, np.int64))
        seeds = np.array([_number(b"\0" + x.encode()) for x in self.lang_names], dtype=np.uint64)
        self.found, self.lang = found, self.lang_of_text[found.text]
        self.first = mix(own[self.ids] ^ seeds[self.lang]) if len(found) else np.zeros(0, np.uint64)

    def levels(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, hash and validity (inside one piece) of the phrase at each word that has so many words after it."""
        h, piece = self.first, self.found.piece
        yield 1, h, np.ones(len(h), dtype=bool)
        for m in range(2, min(longest, len(piece)) + 1):
            h = mix(h[:-1] * _MUL[2] + self.first[m - 1:])
            yield m, h, piece[: -(m - 1)] == piece[m - 1:]


class BitTable:
    """Two bits for each key; may hold keys that were not put in, never lacks one that was."""

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        h, mask = mix(keys), np.uint64(bits - 1)
        return h & mask, (h >> np.uint64(32)) & mask

    def holds(self, keys: np.ndarray) -> np.ndarray:
        a, b = self.places(keys, self.bits)
        bit = lambda p: (self.table[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
        return (bit(a) & bit(b)).astype(bool)


def _slices(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.uint64)
            at = np.unique(np.concatenate(BitTable.places(keys, bits)))
            part, low = (at // SLICE_BITS).astype(np.int32), (at % SLICE_BITS).astype(np.uint16)
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(part[cut], pa.int32()), pa.array([x.tobytes() for x in np.split(low, cut[1:])] if len(cut) else [], pa.binary())], ["part", "places"])
    return run


def _slice(table: pa.Table) -> pa.Table:
    bits = np.zeros(SLICE_BITS, dtype=np.uint8)
    for places in table.column("places"):
        bits[np.frombuffer(places.as_buffer(), dtype=np.uint16)] = 1
    return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def bit_table(candidates: DataFrame) -> BitTable:
    """The table of a frame of keys, put together by slices; at most 32 MB reach the driver, whatever the number of keys."""
    bits = SLICE_BITS
    while bits < min(candidates.count() * BITS_EACH, MOST_BITS):
        bits *= 2
    slices = candidates.mapInArrow(_slices(bits), "part int, places binary").groupBy("part").applyInArrow(_slice, "part int, bits binary")
    table = np.zeros(bits // 8, dtype=np.uint8)
    for r in slices.collect():
        table[r.part * SLICE_BITS // 8 : (r.part + 1) * SLICE_BITS // 8] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return BitTable(bits, table)


def _pack(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, : LOW_BITS // 8].tobytes()


def _unpack(packed: pa.ChunkedArray) -> np.ndarray:
    raw = np.frombuffer(b"".join(packed.to_pylist()), dtype=np.uint8).reshape(-1, LOW_BITS // 8)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, : LOW_BITS // 8] = raw
    return out.reshape(-1).view(np.uint64)


def _blocks(batches: Iterator[pa.RecordBatch], longest: int, extra: str | None = None):
    """The phrases of each block of text, and a further column by word."""
    for batch in batches:
        for a, z in blocks_of(batch.column("text"), BLOCK_BYTES):
            part = batch.slice(a, z - a)
            phrases = Phrases(scan(part.column("text").to_pylist(), PIECES), part.column("lang").to_pylist())
            yield phrases, part.column(extra).to_numpy(zero_copy_only=False)[phrases.found.text] if extra else None


def _mined(range_bits: int, longest: int, shared):
    """Sorted hashes with counts of every block, by shard and range: words and pairs, or with a bit table the phrases from three words on."""
    drop = np.uint64(64 - LOW_BITS - range_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: BitTable | None = shared.value if shared else None
        for phrases, shard in _blocks(batches, longest, "shard"):
            keys, pairs = [], None
            shard = shard.astype(np.uint64) << np.uint64(LOW_BITS + range_bits)
            for m, h, valid in phrases.levels(longest if table else 2):
                key = h >> drop
                if table is None:
                    keys.append((key | shard[: len(key)])[valid])
                elif m == 2:
                    pairs = valid & table.holds(key)
                elif m > 2:
                    for j in range(m - 1):
                        valid = valid & pairs[j : j + len(valid)]
                    keys.append((key | shard[: len(key)])[valid])
            found = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
            start = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
            count, key = np.diff(np.append(start, len(found))), found[start]
            part = (key >> np.uint64(LOW_BITS)).astype(np.int64)
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            rows = []
            for a, z in zip(cut, np.append(cut, len(part))[1:], strict=True):
                often = count[a:z] > 1
                rows.append((int(part[a]), _pack(key[a:z][~often]), _pack(key[a:z][often]), count[a:z][often].astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([],) * 4, (pa.int64(), *[pa.binary()] * 3), strict=True)], ["part", "once", "often", "counts"])
    return run


def below_support(least: float) -> int:
    """The largest count that does not reach a local support."""
    return max(0, math.ceil(least) - 1)


def _frequent(range_bits: int, least: dict[int, float]):
    """The keys of a shard's range that reach the shard's support, with their count over what a phrase that does not reach it may have."""
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        once, often = _unpack(table.column("once")), _unpack(table.column("often"))
        keys = np.concatenate([once, often])
        weight = np.concatenate([np.ones(len(once), np.int64), np.frombuffer(b"".join(table.column("counts").to_pylist()), dtype=np.uint32).astype(np.int64)])
        order = np.argsort(keys)
        keys, weight = keys[order], weight[order]
        low = keys & np.uint64((1 << LOW_BITS) - 1)
        start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.zeros(0, np.int64)
        total = np.add.reduceat(weight, start) if len(start) else weight
        below = below_support(least.get(part >> range_bits, 0.0))
        found = total > below
        key = low[start][found] | np.uint64((part & ((1 << range_bits) - 1)) << LOW_BITS)
        return pa.table({"key": pa.array(key.astype(np.int64), pa.int64()), "over": pa.array(total[found] - below, pa.int64())})
    return run


def _counted(range_bits: int, longest: int, shared):
    """Exact counts of the phrases that pass the bit table, combined over the blocks of a task; a row without words has a language's number of words."""
    drop = np.uint64(64 - LOW_BITS - range_bits)
    names = ["lang", "k", "phrase", "f"]

    def of_block(phrases: Phrases, table: BitTable) -> Iterator[pa.Table]:
        words, ids, lang = phrases.found.words, phrases.ids, phrases.lang
        sizes = np.bincount(lang, minlength=len(phrases.lang_names))
        yield pa.table([pa.array(list(phrases.lang_names), pa.string()), pa.array(np.zeros(len(sizes)), pa.int32(), safe=False), pa.array([b""] * len(sizes), pa.binary()), pa.array(sizes, pa.int64())], names)
        for m, h, valid in phrases.levels(longest):
            at = np.flatnonzero(valid & table.holds(h >> drop))
            while len(at):  # a second round only if two phrases of a block share a hash
                order = np.argsort(h[at], kind="stable")
                at = at[order]
                start = np.flatnonzero(np.concatenate([[True], h[at][1:] != h[at][:-1]]))
                first = np.repeat(at[start], np.diff(np.append(start, len(at))))
                same = lang[at] == lang[first]
                for j in range(m):
                    same &= ids[at + j] == ids[first + j]
                rep = at[start]
                texts = [words.take(pa.array(rep + j)) for j in range(m)]
                yield pa.table([pa.array(phrases.lang_names[lang[rep]].tolist(), pa.string()), pa.array(np.full(len(rep), m), pa.int32(), safe=False),
                                pc.binary_join_element_wise(*texts, b" ") if m > 1 else texts[0], pa.array(np.add.reduceat(same.astype(np.int64), start), pa.int64())], names)
                at = at[~same]

    def combined(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by(names[:3]).aggregate([("f", "sum")]).rename_columns(names)

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.set_column(2, "phrase", pc.cast(t.column("phrase"), pa.string()))
        yield from t.to_batches(max_chunksize=50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for phrases, _ in _blocks(batches, longest):
            held += of_block(phrases, shared.value)
            if sum(t.num_rows for t in held) > COMBINED:
                held = [combined(held)]
                if held[0].num_rows > COMBINED // 2:
                    yield from out(held.pop())
        if held:
            yield from out(combined(held))
    return run


def frequent_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", support: int = SUPPORT, longest: int = LONGEST,
                     shards: int = SHARDS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``lang, k, phrase, f``: every phrase of up to ``longest`` words with at least ``support`` occurrences in its language, written.

    Rows with ``k`` = 0 have the number of words of each language. Occurrences overlap and
    lie within pieces between ``. , ; : ! ?`` and line ends; A-Z are lower-cased. Null
    texts count as empty, a null language as ``und``. Repeated rows count each.
    """
    require(docs, lang, text, doc_id)
    spark = docs.sparkSession
    shard = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(shards)).cast("int")
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"), shard.alias("shard"))
    # a shard's share of the text is the share of the support that it has to reach
    sizes = {r.shard: r.size for r in rows.groupBy("shard").agg(F.sum(F.length("text")).alias("size")).collect()}
    total = sum(sizes.values())
    least = {s: support * n / total * (1 - 1e-9) for s, n in sizes.items() if n}
    range_bits = 0
    while range_bits < 20 and max(sizes.values(), default=0) / 3 / (1 << range_bits) > range_rows:  # about one word or pair for three bytes
        range_bits += 1

    def mine(table: BitTable | None) -> DataFrame:
        shared = spark.sparkContext.broadcast(table) if table else None
        packed = rows.mapInArrow(_mined(range_bits, longest, shared), "part long, once binary, often binary, counts binary")
        found = packed.groupBy("part").applyInArrow(_frequent(range_bits, least), "key long, over long").groupBy("key").agg(F.sum("over").alias("over"))
        # where a phrase was not found it has less than the local support: with all of that it must be able to reach the support
        return stage(found.where(F.col("over") >= support - sum(map(below_support, least.values()))).select("key"), "phrases")

    short = mine(None)
    candidates = short.unionByName(mine(bit_table(short))).distinct() if longest > 2 else short
    shared = spark.sparkContext.broadcast(bit_table(candidates))
    counted = rows.select("lang", "text").mapInArrow(_counted(range_bits, longest, shared), "lang string, k int, phrase string, f long")
    return stage(counted.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= support) | (F.col("k") == 0)), "frequent")


def _exact(numerator: tuple[str, str], denominator: tuple[str, str]) -> str:
    wide = lambda a, b: f"(CAST({a} AS DECIMAL(19, 0)) * CAST({b} AS DECIMAL(19, 0)))"
    return f"{wide(*numerator)} DIV {wide(*denominator)}"


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", support: int = SUPPORT, longest: int = LONGEST,
                 share: int = SHARE, most: int = MOST, shards: int = SHARDS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The first ``most`` collocations of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Candidates are phrases of 2 to ``longest`` words with a = f(phrase) of at least
    ``support``, without those inside a longer candidate with ``share`` percent of their
    count. Cut after k words they score floor(1000 a n / (l r)); the lowest cut counts,
    the smallest k on ties. Order: score and a descending, then the phrase by its bytes.
    Texts without words add nothing; an empty table gives no rows. Other columns are not
    read; equal rows are separate documents.
    """
    freq = frequent_phrases(docs, lang, text, doc_id, support, longest, shards, range_rows)
    longer = freq.where("k >= 2")
    # what lies inside a longer candidate lies at the head or the tail of one with one word more
    inner = F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring(phrase, instr(phrase, ' ') + 1)"))
    around = longer.where("k >= 3").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    left = longer.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (F.col("around") * 100 < F.col("f") * share)).select("lang", "phrase", "k", F.col("f").alias("a"))
    cut = left.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).withColumn("head", F.expr("substring_index(phrase, ' ', cut)"))
    cut = cut.withColumn("tail", F.expr("substring(phrase, length(head) + 2)"))
    words = freq.where("k > 0")
    met = cut.join(words.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(
        words.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    met = met.join(freq.where("k = 0").select("lang", F.col("f").alias("n")), "lang").withColumn("score", F.expr(_exact(("a * 1000", "n"), ("l", "r"))).cast("long"))
    best = met.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"), F.first("a").alias("a"), F.first("n").alias("n"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same rows in DuckDB.
SQL = rf"""
WITH pieces AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
freq AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, {LONGEST + 1}) AS s(k) WHERE len(w) >= k) GROUP BY ALL HAVING count(*) >= {SUPPORT}),
longer AS (SELECT *, string_split(phrase, ' ') AS w FROM freq WHERE k >= 2),
kept AS (SELECT c.lang, c.phrase, c.w, c.k, c.f AS a FROM longer c WHERE NOT EXISTS (
    SELECT 1 FROM longer o WHERE o.lang = c.lang AND o.k > c.k AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' ') AND o.f * 100 >= c.f * {SHARE})),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(w[1 : cut], ' ') AS head, array_to_string(w[cut + 1 :], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
scored AS (SELECT cuts.lang, cuts.phrase, a, cut, h.f AS l, t.f AS r, n, (1000::HUGEINT * a * n // (h.f::HUGEINT * t.f))::BIGINT AS score FROM cuts
    JOIN freq h ON h.lang = cuts.lang AND h.phrase = head JOIN freq t ON t.lang = cuts.lang AND t.phrase = tail JOIN total ON total.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) WHERE rank <= {MOST}
"""
