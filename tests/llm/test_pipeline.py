"""The pipeline's stages against what each must do, on its own input."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from ledgerline.llm import decontaminate, mixing, quality
from ledgerline.session import stage
from tests.llm.conftest import ROWS, SF
from tests.llm.test_operators import brute_near


@pytest.fixture(scope="module")
def results(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, step in pipeline.STAGES:
        after = stage(step(spark, docs, SF), name)
        out.append((docs, after))
        docs = after
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(results):
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "near_duplicates", "benchmark_decontamination", "mix_sources", "token_records"]
    for before, after in results[:-1]:
        assert before.dtypes == after.dtypes


def test_quality_keeps_what_the_classifier_keeps(spark, results):
    before, after = results[0]
    scores = quality.score_quality(before, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in scores.where("score >= 0.3").collect()}
    assert {i for i, _ in texts(after)} == want and 0 < len(want) < before.count()
    assert set(texts(after)) <= set(texts(before))


def test_one_of_each_group_stays(results):
    before, after = results[1]
    classes = brute_near(sorted(texts(before)))
    want = {c for _, c, _ in classes}
    assert {i for i, _ in texts(after)} == want and after.count() == len(want) and set(texts(after)) <= set(texts(before))


def test_leaks_are_cut_and_the_rest_is_kept(spark, results):
    before, after = results[2]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    dirty = {r.doc_id for r in decontaminate.find_leaks(before, bench).where(F.size("spans") > 0).collect()}
    a, b = dict(texts(before)), dict(texts(after))
    assert dirty and all(a[i] == b[i] for i in a if i not in dirty)
    assert decontaminate.find_leaks(after, bench).where(F.size("spans") > 0).count() == 0
    assert after.where(F.col("n_chars") != F.length("text")).count() == before.where(F.col("n_chars") != F.length("text")).count()


def test_mixture_copies(results):
    before, after = results[3]
    copies = {r.doc_id: r.copies for r in mixing.curriculum(before).collect()}
    got = collections.Counter(i for i, _ in texts(after))
    assert got == collections.Counter({i: n for i, n in copies.items() if n}) and set(texts(after)) <= set(texts(before))


def test_records(results):
    before, after = results[4]
    t = Tokenizer.from_file(public_tokenizers.path(pipeline.TOKENIZER))
    want = []
    for i, x in texts(before):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, pipeline.END_ID]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    rows = after.orderBy("start").collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == sorted(want)
    # in training order: that of the files of the mixture, along which the positions rise
    place = before.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index")
    assert [r.doc_id for r in rows] == [r.doc_id for r in place.collect()]
    at = collections.defaultdict(list)
    for r in mixing.training_order(mixing.curriculum(results[3][0])).orderBy("position").collect():
        at[r.doc_id].append(r.position)
    seen, positions = collections.Counter(), []
    for r in rows:
        positions.append(at[r.doc_id][seen[r.doc_id]])
        seen[r.doc_id] += 1
    assert positions == sorted(positions) and [r.doc_id for r in rows] != sorted(r.doc_id for r in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


def test_odd_rows_pass_all_stages(spark, odd, nothing):
    for df in (odd, nothing):
        docs = df.withColumn("n_chars", F.length("text").cast("long"))
        for name, step in pipeline.STAGES:
            docs = stage(step(spark, docs, SF), name)
        n = docs.count()
        assert n == 0 if df is nothing else 0 < n <= 3 * len(ROWS)
