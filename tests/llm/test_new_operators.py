"""Adaptive rules, collocations and ranked search against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import adaptive_rules, collocations, ranked_search
from ledgerline.llm.wordscan import scan
from tests.llm.conftest import LONG, ROWS

SPACE = "[^\x20\x09-\x0d]+"


# 11. adaptive rules

def facts(text):
    words = re.findall(SPACE, text or "")
    at = collections.defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i:i + 8])].append(i)
    covered = {p for found in at.values() if len(found) > 1 for i in found for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(SPACE, x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(covered)


def sketch_floor(v):
    return v - v % (1 << max(v.bit_length() - 5, 0)) if v else 0


def fences(values, name):
    """From the quartiles by rank, on bucket floors."""
    b = sorted(map(sketch_floor, values))
    q = [b[-(-len(b) * k // 4) - 1] for k in (1, 3)]
    spread = 4 * max(q[1] - q[0], adaptive_rules.LEAST_SPREAD[name])
    return (q[0] - spread if name in adaptive_rules.TWO_SIDED else None), q[1] + spread


def brute_rules(rows, least):
    seen = [(i, lang, source, facts(text)) for i, text, lang, source in rows]
    metric = lambda f: {"word_length": 1000 * f[1] // f[0], "symbols": 1000 * f[2] // f[0], "dup_lines": 1000 * f[4] // f[3], "repeats": 1000 * f[5] // f[0]}
    groups = collections.defaultdict(list)
    for _, lang, source, f in seen:
        if f[0]:
            for key in ((lang, source), (lang,), ()):
                groups[key].append(metric(f))
    out = []
    for i, lang, source, f in seen:
        failed, ok = f[0] < 20 or 100 * f[5] > 30 * f[0], True
        if f[0]:
            key = next(k for k in ((lang, source), (lang,), ()) if not k or len(groups[k]) >= least)
            for name, v in metric(f).items():
                low, high = fences([m[name] for m in groups[key]], name)
                ok &= (low is None or sketch_floor(v) >= low) and sketch_floor(v) <= high
        out.append((i, *f, failed, not failed and ok))
    return sorted(out, key=str)


def rules_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(c) for c in ("f", "n_words", "metric", "level", "kept", "bucket", "docs")})


def found_rules(df, least):
    out = adaptive_rules.apply_rules(df, least=least)
    return sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in out.collect()], key=str)


def test_rules_on_odd_and_hot_rows(spark):
    rng = random.Random(2)
    words = [("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, t, None, s) for i, t, s in ROWS]
    # a hot source, some of it junk; a source too small for cutoffs of its own; repeated passages, lines and windows
    rows += [(100 + i, text(60), "en", "hot") for i in range(60)] + [(200 + i, text(40).replace(" ", " ### "), "en", "hot") for i in range(4)]
    rows += [(300, text(30), "en", "small"), (301, " ".join(["supercalifragilistic" * 2] * 30 + words), "en", "small")]
    passage = text(9)
    rows += [(400, f"{passage} {text(40)} {passage}", "de", None), (401, f"{passage}\n{text(50)}\n{passage}\n{passage}", "de", None), (402, "a " * 40, None, None), (402, "a " * 40, None, None)]
    rows += [(403, "x y\r\nx y\r\n x y", "de", "hot"), (404, LONG, "en", "hot"), (405, "w " * 7 + "v " * 20, "en", "hot"), (406, "é€😀 " * 25, "fr", "ß")]
    for least in (3, 50):
        got = found_rules(rules_frame(spark, rows).repartition(5), least)
        assert got == brute_rules(rows, least)
    kept = {r[0]: r[-1] for r in found_rules(rules_frame(spark, rows), 50)}
    assert not any(kept[200 + i] for i in range(4)) and all(kept[100 + i] for i in range(60)) and not kept[301]


def test_sketches_merge_and_stay_close(spark):
    values = [0, 1, 15, 16, 31, 32, 33, 1000, 123_456, 10 ** 9]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(adaptive_rules.bucket(F.col("v"))).collect()]
    assert got == [sketch_floor(v) for v in values] and all(g <= v <= g * (1 + 1 / 16) + 0.5 for g, v in zip(got, values, strict=True))
    rows = [(i, "one two three four " * (1 + i % 5), f"l{i % 2}", f"s{i % 3}") for i in range(30)]
    f = rules_frame(spark, rows).select("lang", "source", adaptive_rules.text_facts(F.col("text")).alias("x")).select("lang", "source", "x.*")
    fine = adaptive_rules.sketches(f, ["lang", "source"])
    whole = adaptive_rules.sketches(f, [])
    assert sorted(tuple(r) for r in adaptive_rules.merged(fine, []).collect()) == sorted(tuple(r) for r in whole.collect())


def test_rules_without_rows(spark):
    assert found_rules(rules_frame(spark, []), 50) == []


# 12. collocations

def brute_collocations(rows, support, share=100, most=2000, longest=5):
    freq, total = collections.defaultdict(collections.Counter), collections.Counter()
    low = {i: i + 32 for i in range(65, 91)}
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(low)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                freq[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in freq.items():
        often, found = {p: a for p, a in f.items() if a >= support}, []
        for p, a in often.items():
            inside = any(len(q) > len(p) and 100 * b >= share * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in often.items())
            if len(p) > 1 and not inside:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, n + 1, p.decode(), -a, l, r, total[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(found)[:most])]
    return sorted(out)


PLANTED = ["New York City", "machine learning model of the", "per cent", "naïve Bayes", "a b a b a"]


def phrase_rows(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "of", "and", "to", "é", "x1", "New", "York", "per", "日本"]
    rows = []
    for i in range(n):
        parts = [rng.choice(PLANTED) if rng.random() < 0.3 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 8))]
        rows.append((rng.choice([i, None, 7]), rng.choice([" ", ". ", ",", "\n", " \t "]).join(parts), rng.choice(["en", "en", "de", None])))
    return rows


def found_phrases(spark, rows, **kwargs):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(c) for c in ("k", "f", "phrase", "shard", "n", "score", "part")}).repartition(4)
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(df, **kwargs).collect())


@pytest.mark.parametrize("shards, range_rows", [(1, 10 ** 6), (5, 40)])
def test_collocations(spark, shards, range_rows):
    rows = phrase_rows(shards)
    # a third of all rows are one row without an id; texts without words; a copied long text
    rows += [(None, "the same words again. and the same words again", "en")] * 60 + [(1, None, "en"), (2, " .,\n", None), (3, "", "xx"), (4, LONG[:4000], "en"), (4, LONG[:4000], "en")]
    want = brute_collocations(rows, 6)
    assert len(want) > 20 and found_phrases(spark, rows, support=6, shards=shards, range_rows=range_rows) == want
    assert found_phrases(spark, rows, support=6, shards=shards, most=5, share=60) == brute_collocations(rows, 6, share=60, most=5)


def test_collocation_scores_are_exact():
    import decimal
    a, n, l, r = 9 * 10 ** 12, 9 * 10 ** 15, 9 * 10 ** 12 + 1, 9 * 10 ** 12 + 3
    with decimal.localcontext(prec=60):
        assert 1000 * a * n // (l * r) == int(decimal.Decimal(1000 * a) * n / (l * r))


def test_wide_scores_do_not_round(spark):
    a, n, l, r = 9 * 10 ** 12, 9 * 10 ** 15, 9 * 10 ** 12 + 1, 9 * 10 ** 12 + 3
    df = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    assert df.select(F.expr(collocations._exact(("a * 1000", "n"), ("l", "r")))).first()[0] == 1000 * a * n // (l * r)


def test_collocations_without_rows(spark):
    assert found_phrases(spark, []) == [] and found_phrases(spark, [(None, None, None)]) == []


def test_bit_table_lacks_nothing(spark):
    keys = [random.Random(4).randrange(1 << 60) for _ in range(5000)]
    table = collocations.bit_table(spark.createDataFrame([(k,) for k in keys], "key long").repartition(3))
    assert table.holds(np.array(keys, np.uint64)).all()
    other = np.random.default_rng(1).integers(0, 1 << 60, 100_000).astype(np.uint64)
    assert table.holds(other).mean() < 0.05
    assert not collocations.bit_table(spark.createDataFrame([], "key long")).holds(other).any()


def test_scan_words_and_pieces():
    found = scan(["A b. C\td".encode(), None, b"", "é,\nf ".encode()], collocations.PIECES)
    assert [w.decode() for w in found.words.to_pylist()] == ["a", "b", "c", "d", "é", "f"]
    assert found.text.tolist() == [0, 0, 0, 0, 3, 3]
    assert [a == b for a, b in zip(found.piece, found.piece[1:], strict=False)] == [True, False, True, False, False]


# 13. ranked search

def terms_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute_ranking(docs, items, most):
    held = [(i, collections.Counter(terms_of(t)), len(terms_of(t))) for i, t in docs if terms_of(t)]
    documents, length = len(held), sum(n for _, _, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * documents) // length
            s = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:most])]
    return sorted(out, key=str)


def found_ranking(spark, docs, items, most=20, **kwargs):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("n", "terms", "item", "item_id", "score", "rank", "salt")}).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(c) for c in ("doc_id", "item", "rank", "term")})
    return sorted([tuple(r) for r in ranked_search.ranked_search(d, b, most=most, **kwargs).select("item_id", "rank", "doc_id", "score").collect()], key=str)


@pytest.mark.parametrize("cells", [40, 1 << 20])
def test_ranking(spark, cells):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)] + ["the", "of", "ça", "日本語", "X"]
    docs = [(i, t) for i, t, _ in ROWS] + [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(150)]
    docs += [(500 + i, "one text many times over the w1 w2") for i in range(80)] + [(None, "w1 w1 w2")] * 3 + [(7, "w1 w1 w2")]
    items = [(1, "w1 w2 w2 the"), (2, None), (3, " ,;"), (4, "unseen words only zzz"), (None, "W3 w4 ÇA ça"), (5, "one text many times"), (6, " ".join(words)), (7, "日本語, x! lorem")]
    assert found_ranking(spark, docs, items, cells=cells) == brute_ranking(docs, items, 20)
    assert found_ranking(spark, docs, items, most=3, cells=cells, item_bytes=60) == brute_ranking(docs, items, 3)  # several blocks of items


def test_ranking_of_nothing(spark):
    assert found_ranking(spark, [], [(1, "a")]) == [] and found_ranking(spark, [(1, "a")], []) == [] and found_ranking(spark, [(1, None)], [(1, "a")]) == []


def test_treap_gives_every_cell():
    rng = np.random.default_rng(3)
    for rows, columns in ((1, 1), (7, 90), (60, 5), (33, 33)):
        cells = rng.random((rows, columns)) < 0.3
        cells[0, 0] = True
        r, c = np.nonzero(cells)
        v = rng.integers(1, 10 ** 6, len(r))
        tree = ranked_search.K2Treap(r, c, v)
        value = dict(zip(zip(r.tolist(), c.tolist(), strict=True), v.tolist(), strict=True))
        assert tree.top == v.max()
        for row in range(rows):
            for column in range(columns):
                node, top = np.zeros(1, np.int64), tree.top
                for level in range(tree.depth):
                    shift = tree.depth - 1 - level
                    there, below = tree.child(node, np.array([2 * (row >> shift & 1) + (column >> shift & 1)]))
                    if not there[0]:
                        top = None
                        break
                    node, top = below.astype(np.int64), top - int(tree.less[below[0]])
                assert top == value.get((row, column))
