"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

1. Words and punctuation runs of all documents fall into a fixed number of rows by hash.
   Every row has a sparse random index vector; a row's context vector is the sum of the
   index vectors of all its neighbours in the corpus, counted in integers per task and
   summed by Spark, so that it covers every document and is the same in every run.
2. A document is pooled from the vectors of its words: mean, spread, likeness of neighbours,
   length of the mean and number of words. Labels, language, source and id are not seen.
3. A two-layer numpy network learns from a bounded sample of labelled rows on the driver;
   its logits are divided by a temperature fitted on rows it did not learn from.

All that goes to tasks is a table of ROWS x DIM numbers and the network.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import require
from ledgerline.llm.records import blocks_of
from ledgerline.session import stage

ROWS, DIM, NONZERO, SEED = 1 << 13, 32, 2, 20
#: Labelled rows that the network learns from: about as many, those that come first in an order fixed by their contents.
SAMPLE_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 40, 256, 3e-3, 1e-4
CACHE_WORDS = 1 << 16
#: Words at which a document's pooled features count half.
SHRINK = 8
FEATURES = 2 * DIM + 3
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")


class _Rows(dict):
    """Row of each word met, kept from task to task and bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        row = self[word] = zlib.crc32(word) % ROWS
        return row


_ROWS = _Rows()


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of every row."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (ROWS, NONZERO)), rng.choice(np.array([-1, 1]), (ROWS, NONZERO))


def _rows_of(texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all words of some texts, and where each text ends."""
    parts = [list(map(_ROWS.__getitem__, _WORD.findall(t or b""))) for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    return np.fromiter((r for p in parts for r in p), dtype=np.int64, count=int(ends[-1]) if len(ends) else 0), ends


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, sign = index_vectors()
    total = np.zeros(ROWS * DIM)
    for batch in batches:
        for a, z in blocks_of(batch.column(0)):
            rows, ends = _rows_of(batch.column(0).slice(a, z - a).to_pylist())
            inside = np.ones(max(0, len(rows) - 1), dtype=bool)
            borders = ends[(ends > 0) & (ends < len(rows))] - 1
            inside[borders] = False
            left, right = rows[:-1][inside], rows[1:][inside]
            own, other = np.concatenate([left, right]), np.concatenate([right, left])
            at = own[:, None] * DIM + place[other]
            total += np.bincount(at.ravel(), weights=sign[other].ravel(), minlength=ROWS * DIM)
    sums = total.astype(np.int64).reshape(ROWS, DIM)
    met = np.flatnonzero(sums.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(list(sums[met]), pa.list_(pa.int64()))], ["row", "sums"])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """ROWS x DIM word vectors: a row's own index vector plus the direction of its contexts."""
    parts = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(_contexts, "row int, sums array<long>")
    sums = parts.groupBy("row").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(DIM)]).collect()
    context = np.zeros((ROWS, DIM))
    for r in sums:
        context[r[0]] = r[1:]
    place, sign = index_vectors()
    own = np.zeros((ROWS, DIM))
    np.add.at(own, (np.arange(ROWS)[:, None], place), sign)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    return unit(unit(own) + unit(context)).astype(np.float32)


def pool(vectors: np.ndarray, texts: Sequence[bytes | None]) -> np.ndarray:
    """Features of each text; those of a text without words are zeros."""
    rows, ends = _rows_of(texts)
    out = np.zeros((len(texts), FEATURES), dtype=np.float32)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    full = np.flatnonzero(ends > starts)
    if len(full):
        v = vectors[rows]
        n = (ends - starts)[full, None].astype(np.float32)
        mean = np.add.reduceat(v, starts[full], axis=0) / n
        square = np.add.reduceat(v * v, starts[full], axis=0) / n
        out[full, :DIM] = mean
        out[full, DIM : 2 * DIM] = np.sqrt(np.maximum(square - mean * mean, 0))
        alike = np.zeros(len(rows), dtype=np.float32)
        alike[:-1] = np.einsum("ij,ij->i", v[:-1], v[1:])
        alike[ends[full] - 1] = 0  # a text's last word has no neighbour
        out[full, -3] = np.add.reduceat(alike, starts[full]) / np.maximum(n[:, 0] - 1, 1)
        out[full, -2] = np.linalg.norm(mean, axis=1)
        out[full, -1] = np.log1p(n[:, 0])
    return out


def standardised(x: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Inputs of the network; what few words say is drawn towards the average document."""
    z = (x - center) / scale
    words = np.expm1(x[:, -1:])
    z[:, :-1] *= words / (words + SHRINK)
    return z


@dataclass
class Network:
    """Standardised inputs, one hidden layer, one logit and its temperature."""

    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(standardised(x, self.center, self.scale) @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -500, 500)))


def constant(p: float) -> Network:
    z = np.zeros
    return Network(z(FEATURES), np.ones(FEATURES), z((FEATURES, 1)), z(1), z(1), float(np.log(p / (1 - p))))


def train(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
    """Fits the network; labels of one kind only give a constant near them, none give one half."""
    if not len(y) or y.min() == y.max():
        return constant(0.5 if not len(y) else 0.99 if y[0] else 0.01)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held = order[: max(1, len(y) // 5)]
    own = order[len(held) :] if len(y) > 5 else order
    x = x.astype(np.float64)
    center, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
    net = Network(center, scale, rng.normal(0, np.sqrt(2 / FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), 0.0)
    z = standardised(x, center, scale)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(own), max(1, len(own) // BATCH)):
            a = z[at] @ params[0] + params[1]
            h = np.maximum(a, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -500, 500)))
            d = (p - y[at]) / len(at)
            dh = np.outer(d, params[2]) * (a > 0)
            grads = [z[at].T @ dh + DECAY * params[0], dh.sum(axis=0), h.T @ d + DECAY * params[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    net.temperature = calibrate(net.logits(x[held]), y[held])
    return net


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """Temperature of least log loss, by a grid refined twice."""
    def loss(t: float) -> float:
        s = np.clip(logits / t, -500, 500)
        return float(np.mean(np.logaddexp(0, s) - y * s))
    low, high = np.log(0.25), np.log(16.0)
    best = 1.0
    for _ in range(3):
        grid = np.exp(np.linspace(low, high, 25))
        best = float(grid[int(np.argmin([loss(t) for t in grid]))])
        reach = (high - low) / 24
        low, high = np.log(best) - reach, np.log(best) + reach
    return best


def _pooled(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, z in blocks_of(texts, 1 << 18):
                x = pool(shared.value, texts.slice(a, z - a).to_pylist())
                kept = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, z - a) for c in kept], pa.array([r.tobytes() for r in x], pa.binary())], [*kept, "features"])
    return run


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("features").to_pylist()), np.float32).reshape(-1, FEATURES)
            kept = [c for c in batch.schema.names if c != "features"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(shared.value.score(x), pa.float64())], [*kept, "score"])
    return run


def _fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label_id: str, label: str, folds: int, held_fold: int, sample_rows: int):
    """Word vectors and network as broadcasts, and the documents' features with the fold they are in."""
    require(docs, doc_id, text)
    require(labels, label_id, label)
    sc = docs.sparkSession.sparkContext
    vectors = sc.broadcast(word_vectors(docs, text))
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.crc32(key.cast("binary")) % folds == held_fold).alias("held_out"), F.col(text).cast("binary").alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    features = stage(rows.mapInArrow(_pooled(vectors), f"doc_id {kind}, held_out boolean, features binary"), "features")
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(label_id).alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    labelled = stage(features.where(~F.col("held_out")).join(known, "doc_id").select(
        "label", "features", F.pmod(F.xxhash64("doc_id", "features"), F.lit(1 << 40)).alias("place")), "labelled")
    share = min(1.0, sample_rows / max(1, labelled.count()))
    # rows that repeat are one example; every task sends only its share
    sample = labelled.where(F.col("place") < int(share * (1 << 40))).distinct().select("label", "features", "place").collect()
    sample.sort(key=lambda r: (r[2], bytes(r[1]), r[0]))
    x = np.frombuffer(b"".join(bytes(r[1]) for r in sample), np.float32).reshape(-1, FEATURES)
    net = sc.broadcast(train(x, np.array([r[0] for r in sample], dtype=np.float64)))
    return vectors, net, features


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "quality",
                  folds: int = 5, held_fold: int = 0, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: ``doc_id, held_out, score``.

    Held out are documents whose crc32 of the id as text leaves ``held_fold`` modulo
    ``folds`` (a null id counts as the empty text); only labels of the others are learnt
    from, about ``sample_rows`` of them. An id with several labels counts as 1 if at least half
    of them are. Null and empty texts have zero features and get a score like any other;
    null labels are no labels. Equal rows score alike. Without labels every score is one
    half. An empty table gives no rows. Other columns are not read.
    """
    _, net, features = _fit(docs, labels, doc_id, text, label_id, label, folds, held_fold, sample_rows)
    kind = docs.schema[doc_id].dataType.simpleString()
    return features.mapInArrow(_scored(net), f"doc_id {kind}, held_out boolean, score double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "quality",
              folds: int = 5, held_fold: int = 0, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents, all columns, whose score is at least ``least``.

    Scores are those of ``score_quality``; they are computed where the text is read, so
    that no text is shuffled.
    """
    vectors, net, _ = _fit(docs, labels, doc_id, text, label_id, label, folds, held_fold, sample_rows)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(batch.column(text), pa.binary())
            for a, z in blocks_of(texts, 1 << 18):
                yield batch.slice(a, z - a).filter(pa.array(net.value.score(pool(vectors.value, texts.slice(a, z - a).to_pylist())) >= least))

    return docs.mapInArrow(good, docs.schema)
