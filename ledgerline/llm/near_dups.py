"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

1. Documents become sets of five-word shingles. Documents of the same word sequence are
   one representative with a number of copies.
2. Every representative has a signature of TREES x DEPTH minima. In each tree its part of
   the signature is a path; sorted paths are a prefix trie. Matching starts with the
   whole path and is shortened level by level until the expected recall for the wanted
   similarity reaches its target. Paths that match nobody are dropped first, from counts.
3. Inside a trie node, members whose signatures agree well enough join a bundle. No pairs
   are written: a member is linked to the bundle's first. Nodes beyond a block are
   compared block against block.
4. Bundles are the components of those links. All pairs of a bundle are verified on the
   complete shingle sets, again block against block, and only a sum and one link per
   member leave the task.
5. Classes are the components of the verified links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import require
from ledgerline.llm.decontaminate import words_of
from ledgerline.llm.records import blocks_of
from ledgerline.operators.graph import connected_components
from ledgerline.session import stage

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, SEED = 24, 6, 5
#: Share of the pairs at the threshold that the forest must find.
RECALL = 0.999999
#: Share of agreeing minima from which two signatures are bundled; a pair at the threshold has less with a chance of about 1e-8.
AGREEMENT = 0.6
NODE_BLOCK, BUNDLE_BLOCK = 4096, 512
ROWS_PER_TASK, BYTES_PER_TASK = 20_000, 8 << 20
CACHE_WORDS = 1 << 16
_VALUES = TREES * DEPTH


def forest_depth(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which the forest finds the wanted share of the pairs at the threshold."""
    for k in range(depth, 0, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    raise ValueError("more trees are needed for this recall")


class _Hashes(dict):
    """64-bit hash of each word met, kept from task to task and bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def word_hashes(text: bytes | None) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit shingle hashes in order; fewer words than a shingle are one shingle, none give none."""
    if not len(words):
        return words
    size = min(size, len(words))
    h = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k]
        h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


_RNG = np.random.default_rng(SEED)
_FLIP = _RNG.integers(0, 1 << 32, _VALUES, dtype=np.uint64).astype(np.uint32)
_ODD = (_RNG.integers(0, 1 << 32, _VALUES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def signature(found: np.ndarray) -> np.ndarray:
    """Minima of the shingles under TREES x DEPTH permutations."""
    low = np.full(_VALUES, 0xFFFFFFFF, dtype=np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 4096):
        low = np.minimum(low, ((short[at : at + 4096, None] ^ _FLIP) * _ODD).min(axis=0))
    return low


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, z in blocks_of(batch.column(1)):
            digest, count, sig, sketch = [], [], [], []
            for text in batch.column(1).slice(a, z - a).to_pylist():
                words = word_hashes(text)
                found = shingles(words)
                minima = signature(found)
                digest.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest())
                count.append(len(found))
                sig.append(minima.tobytes() if len(found) else None)
                sketch.append((minima >> np.uint32(8)).astype(np.uint8).tobytes() if len(found) else None)
            others = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, z - a) for c in others], pa.array(digest, pa.binary()), pa.array(count, pa.int64()), pa.array(sig, pa.binary()), pa.array(sketch, pa.binary())],
                                             [*others, "digest", "shingles", "signature", "sketch"])


def block_pairs(df: DataFrame, keys: Sequence[str], member: str, size: Column, block: int) -> DataFrame:
    """Adds blocks ``i`` and ``j`` so that any two members of a group meet for some (i, j).

    A group of one block is (0, 0). In a larger one a member of block b goes to every
    pair with b in it; ``block`` tells which of the two it belongs to.
    """
    blocks = F.greatest(F.ceil(size / block), F.lit(1)).cast("int")
    own = df.withColumn("__blocks", blocks).withColumn("block", F.pmod(F.xxhash64(member), F.col("__blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("__blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    return own.withColumn("__pair", F.explode(pair)).select(*[c for c in df.columns], "block", F.col("__pair.i").alias("i"), F.col("__pair.j").alias("j"))


class Groups:
    """Union-find whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return int(x)

    def unite(self, x: int, others: np.ndarray) -> None:
        roots = [self.root(int(o)) for o in others]
        low = min([self.root(x), *roots])
        self.up[[self.root(x), *roots]] = low

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            over = up[up]
            if (over == up).all():
                return up
            up = over


def _close(sketch: np.ndarray, sizes: np.ndarray, x: int, others: np.ndarray, need: int) -> np.ndarray:
    """Those of the others whose signature and size may belong to a pair at the threshold."""
    ratio = np.minimum(sizes[others], sizes[x]) >= THRESHOLD * np.maximum(sizes[others], sizes[x])
    others = others[ratio]
    return others[(sketch[others] == sketch[x]).sum(axis=1) >= need] if len(others) else others


def bundle_node(rest: np.ndarray, sketch: np.ndarray, sizes: np.ndarray, need: int) -> np.ndarray:
    """Root of each member of a trie node; ``rest`` are the path values below the node, sorted."""
    n = len(sizes)
    groups = Groups(n)
    for depth in range(rest.shape[1], 0, -1):  # long matches first: near copies fall together at once
        new = np.flatnonzero(np.concatenate([[True], (rest[1:, :depth] != rest[:-1, :depth]).any(axis=1)]))
        for a, z in zip(new, [*new[1:], n], strict=True):
            if z - a > 1:
                close = _close(sketch, sizes, a, np.arange(a + 1, z), need)
                if len(close):
                    groups.unite(int(a), close)
    roots = groups.roots()
    for x in range(n - 1):  # at the node's own depth every two that are still apart are compared
        later = np.arange(x + 1, n)
        apart = later[roots[later] != roots[x]]
        if len(apart):
            close = _close(sketch, sizes, x, apart, need)
            if len(close):
                groups.unite(x, close)
                roots = groups.roots()
    return roots


def _bundle(need: int):
    def run(t: pa.Table) -> pa.Table:
        key = np.stack([np.asarray(t[c]).astype(np.int64) for c in ("tree", "prefix", "i", "j")], axis=1)
        tail = np.frombuffer(b"".join(t["rest"].to_pylist()), np.uint32).reshape(len(key), -1)
        rep, sizes = np.asarray(t["rep"]), np.asarray(t["shingles"])
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(len(key), -1)
        order = np.lexsort((rep, *tail.T[::-1], *key.T[::-1]))
        key, tail, rep, sizes, sketch = key[order], tail[order], rep[order], sizes[order], sketch[order]
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if len(key) else np.zeros(0, int)
        left, right = [], []
        for a, z in zip(new, [*new[1:], len(key)], strict=True):
            if z - a < 2:
                continue
            roots = bundle_node(tail[a:z], sketch[a:z], sizes[a:z], need)
            moved = np.flatnonzero(roots != np.arange(z - a))
            left.append(rep[a:z][moved])
            right.append(rep[a:z][roots[moved]])
        none = np.zeros(0, dtype=np.int64)
        return pa.table({"a": np.concatenate([none, *left]), "b": np.concatenate([none, *right])})
    return run


def _texts_to_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, z in blocks_of(batch.column("text")):
            part = batch.slice(a, z - a)
            words = [word_hashes(t) for t in part.column("text").to_pylist()]
            right = [hashlib.blake2b(w.tobytes(), digest_size=16).digest() == d for w, d in zip(words, part.column("digest").to_pylist(), strict=True)]
            at = pa.array(np.flatnonzero(right), pa.int64())  # another text under the same id is left
            yield pa.RecordBatch.from_arrays([part.column("rep").take(at), pa.array([shingles(w).tobytes() for w, r in zip(words, right, strict=True) if r], pa.binary())], ["rep", "found"])


def overlaps(sets: Sequence[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every two sets, by products of incidence blocks."""
    n = len(sets)
    member = np.repeat(np.arange(n), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, member = values[order], member[order]
    number = np.cumsum(np.concatenate([[0], values[1:] != values[:-1]]))
    shared = np.bincount(number)[number] > 1  # only these can meet
    number, member = number[shared], member[shared]
    number = np.cumsum(np.concatenate([[0], number[1:] != number[:-1]])) if len(number) else number
    out = np.zeros((n, n))
    at = 0
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        end = int(np.searchsorted(number, low + columns))
        block = np.zeros((n, min(columns, int(number[-1]) + 1 - low)), dtype=np.float32)
        block[member[at:end], number[at:end] - low] = 1
        out += block @ block.T
        at = end
    return out


def _verify(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        key = np.stack([np.asarray(t[c]).astype(np.int64) for c in ("bundle", "i", "j")], axis=1)
        rep, copies, block = np.asarray(t["rep"]), np.asarray(t["copies"]), np.asarray(t["block"])
        order = np.lexsort((rep, *key.T[::-1]))
        found = t["found"]
        out: list[tuple] = []
        start = np.flatnonzero(np.concatenate([[True], (key[order][1:] != key[order][:-1]).any(axis=1)])) if len(order) else np.zeros(0, int)
        for a, z in zip(start, [*start[1:], len(order)], strict=True):
            own = order[a:z]
            own = own[np.concatenate([[True], rep[own][1:] != rep[own][:-1]])]  # a row that repeats is the same representative
            sets = [np.frombuffer(found[int(k)].as_py(), np.uint64) for k in own]
            size = np.array([len(s) for s in sets], dtype=np.float64)
            both = overlaps(sets)
            # exact in whole numbers: both / (x + y - both) >= threshold
            linked = both * (1 + threshold) + 1e-9 >= threshold * (size[:, None] + size[None, :])
            np.fill_diagonal(linked, False)
            i, j = key[own[0]][1:]
            if i != j:  # pairs inside a block are counted once, where i = j
                linked &= block[own][:, None] != block[own][None, :]
            groups = Groups(len(own))
            for x in np.flatnonzero(linked.any(axis=1)):
                groups.unite(int(x), np.flatnonzero(linked[x]))
            roots = groups.roots()
            links = linked @ copies[own]
            out += [(int(rep[own[k]]), int(links[k]), int(rep[own[roots[k]]])) for k in range(len(own))]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"rep": pa.array(cols[0], pa.int64()), "links": pa.array(cols[1], pa.int64()), "root": pa.array(cols[2], pa.int64())})
    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: ``doc_id, class_id, n_links, class`` and the columns of ``keep``.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased; a
    document's set holds its five-word shingles, or all its words as one shingle if it
    has fewer. Two documents are linked if their sets have a Jaccard similarity of at
    least ``threshold``. ``n_links`` counts the other documents linked to it, copies
    included; ``class_id`` is the smallest id of those reachable over links, and ``class``
    tells classes apart even where ids repeat. Null, empty and wordless texts are linked
    to nothing. Rows with equal ids are separate documents;
    repeated rows are copies of each other. An empty table gives no rows. Other columns
    are not read.
    """
    require(docs, doc_id, text)
    if threshold < THRESHOLD:
        raise ValueError("the agreement bound is set for similarities from 0.8")
    depth = forest_depth(threshold, recall)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).withColumn("text_key", F.xxhash64("text"))
    carried = rows if not keep else docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), F.struct(*keep).alias("kept")).withColumn("text_key", F.xxhash64("text"))
    kept = "" if not keep else f", kept {carried.schema['kept'].dataType.simpleString()}"
    signed = stage(carried.mapInArrow(_signed, f"doc_id {kind}{kept}, text_key long, digest binary, shingles long, signature binary, sketch binary"), "signed")
    merged = signed.where("shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("first"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))["text_key"].alias("text_key"), F.count(F.lit(1)).alias("copies"), F.first("shingles").alias("shingles"),
                                                                F.first("signature").alias("signature"), F.first("sketch").alias("sketch"))
    reps = stage(merged.withColumn("rep", F.monotonically_increasing_id()), "reps")

    # trie nodes with company, from counts
    path = lambda a, n: F.expr(f"substring(signature, {a} + tree * {DEPTH * 4}, {n})")
    paths = reps.select("rep", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "signature").select(
        "rep", "tree", F.xxhash64(path(1, depth * 4)).alias("prefix"))
    nodes = paths.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = paths.join(nodes, ["tree", "prefix"])
    known = reps.select("rep", "signature", "sketch", "shingles")
    met = met.join(known, "rep").select("rep", "tree", "prefix", "members", path(1 + depth * 4, (DEPTH - depth) * 4).alias("rest"), "sketch", "shingles")
    met = stage(block_pairs(met, ["tree", "prefix"], "rep", F.col("members"), NODE_BLOCK), "nodes")
    tasks = max(1, -(-met.count() // ROWS_PER_TASK))
    need = int(AGREEMENT * _VALUES)
    edges = stage(met.withColumn("__task", F.pmod(F.xxhash64("tree", "prefix", "i", "j"), F.lit(tasks))).groupBy("__task").applyInArrow(_bundle(need), "a long, b long").distinct(), "edges")

    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    bundles = stage(connected_components(ends, edges).select(F.col("node").alias("rep"), F.col("component").alias("bundle")), "bundles")
    size = bundles.groupBy("bundle").agg(F.count(F.lit(1)).alias("members"))
    # many rows can share an id or have none, so a text is fetched by its own hash too
    wanted = bundles.join(reps.select("rep", "digest", "first", "text_key"), "rep").select("rep", "digest", F.col("first").alias("__first"), "text_key")
    found = rows.join(wanted.hint("shuffle_hash"), (rows["text_key"] == wanted["text_key"]) & F.col("doc_id").eqNullSafe(F.col("__first"))).select("rep", "digest", "text").mapInArrow(_texts_to_shingles, "rep long, found binary")
    found = found.join(bundles.join(size, "bundle").join(reps.select("rep", "copies"), "rep"), "rep")
    found = stage(found, "shingles")
    task_bytes = found.agg(F.coalesce(F.sum(F.length("found") * F.greatest(F.ceil(F.col("members") / BUNDLE_BLOCK), F.lit(1))), F.lit(0))).first()[0]
    tasks = max(1, -(-int(task_bytes) // BYTES_PER_TASK))
    pairs = block_pairs(found, ["bundle"], "rep", F.col("members"), BUNDLE_BLOCK).withColumn("__task", F.pmod(F.xxhash64("bundle", "i", "j"), F.lit(tasks)))
    verified = stage(pairs.groupBy("__task").applyInArrow(_verify(threshold), "rep long, links long, root long"), "verified")

    links = verified.groupBy("rep").agg(F.sum("links").alias("links"), F.countDistinct("root").alias("__roots"), F.min("root").alias("root"))
    many = size.where(F.col("members") > BUNDLE_BLOCK)
    if not many.isEmpty():  # a class of several blocks is put together from the classes of its block pairs
        linked = connected_components(links.select(F.col("rep").alias("node")), verified.select(F.col("rep").alias("a"), F.col("root").alias("b")))
        links = links.drop("root").join(linked.select(F.col("node").alias("rep"), F.col("component").alias("root")), "rep")
    classes = reps.join(links.drop("__roots"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    lowest = classes.groupBy("root").agg(F.min("first").alias("class_id"))
    by_digest = classes.join(lowest, "root").select("digest", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("root").alias("class"))
    own = signed.withColumn("__row", F.monotonically_increasing_id()).select("doc_id", "shingles", "digest", "__row", *(["kept"] if keep else []))
    more = [F.col(f"kept.{c}").alias(c) for c in keep]
    out = own.where("shingles > 0").join(by_digest, "digest").select("doc_id", "class_id", "n_links", "class", *more)
    # a document without words is a class of its own, numbered below 0
    return out.unionByName(own.where("shingles = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), (-1 - F.col("__row")).alias("class"), *more))
