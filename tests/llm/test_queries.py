"""Registered queries over a test table, and the pipeline against its stages done by brute force."""

import itertools
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import decontaminate, licences, quality, queries, secrets, separators, wordsplit, wordtok
from plumbline.session import table
from tests.llm.test_small import brute_classes
from tests.oracle import DATA, compare


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLE[name])


def documents():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{DATA}/documents.parquet'").fetchall())


def test_op8_equals_library(spark):
    lib = wordtok.load(wordtok.vocabulary_path()).library
    start = 0
    rows = queries.QUERIES["op8_bit_packed_tokens"](spark, DATA).orderBy("doc_id").collect()
    for r, (i, t) in zip(rows, sorted(documents().items()), strict=True):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op2_equals_library(spark):
    lib = wordtok.load(wordtok.vocabulary_path(), plain=True).library
    want = {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in documents().items()}
    assert {r["doc_id"]: r["n_tokens"] for r in queries.QUERIES["op2_separator_token_counts"](spark, DATA).collect()} == want


def auc(scores, truth):
    """Share of (good, bad) pairs in the right order, ties half."""
    good, bad = ([x for x, t in zip(scores, truth) if t == k] for k in (1, 0))
    return np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])


def test_op6_held_out(spark, monkeypatch):
    """Only labels that the fit never saw count: their order, and how many bad ones are caught."""
    data = os.environ.get("TEST_LARGER_SF_DIR", "/root/testdata/sf0.01")
    rows = {r["doc_id"]: r for r in queries.QUERIES["op6_quality_classifier"](spark, data).collect()}
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{data}/documents.parquet'").fetchall()[0][0]
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{data}/labels.parquet' WHERE quality IS NOT NULL").fetchall()
    held = [(i, q) for i, q in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i]["held_out"] for i, _ in held)
    scores, truth = [rows[i]["score"] for i, _ in held], [q for _, q in held]
    assert len(set(truth)) == 2 and auc(scores, truth) > 0.97
    assert np.mean([rows[i]["predicted"] == 0 for i, q in held if q == 0]) > 0.7 and np.mean([rows[i]["predicted"] for i, q in held if q]) > 0.95


def test_op6_equals_brute_force(spark):
    """The fit in partitions against one on whole arrays: statistics, standardisation, waves, ridge, pools."""
    docs, marks = table(spark, DATA, "documents"), dict(duckdb.sql(f"SELECT doc_id, quality FROM '{DATA}/labels.parquet' WHERE quality IS NOT NULL").fetchall())
    texts = documents()
    ids = [i for i in sorted(texts) if i in marks and zlib.crc32(str(i).encode()) % 5]
    x = quality.statistics(pa.array([texts[i] for i in ids], pa.large_string()))
    y, fold = np.array([float(marks[i]) for i in ids]), np.array([zlib.crc32(str(i).encode()) % 5 for i in ids])
    model = quality.Model(x.mean(0), np.sqrt(np.maximum((x * x).mean(0) - x.mean(0) ** 2, 1e-8)), None, np.zeros(1), np.zeros(1))
    z = model.waves(x[fold != 1])
    penalty = np.diag([quality.RIDGE * len(z)] * quality.WAVES + [0.0]) + 1e-9 * np.eye(quality.WAVES + 1)
    model.beta = np.linalg.solve(z.T @ z + penalty, z.T @ y[fold != 1])
    raw, own = model.raw(x[fold == 1]), y[fold == 1]
    cell = np.clip(((raw - quality.LOW) / (quality.HIGH - quality.LOW) * quality.GRID).astype(int), 0, quality.GRID - 1)
    centres = quality.LOW + (np.arange(quality.GRID) + 0.5) * (quality.HIGH - quality.LOW) / quality.GRID
    model.knots, model.heights = quality.pool(np.bincount(cell, minlength=quality.GRID), np.bincount(cell, own, quality.GRID), centres)
    want = dict(zip(sorted(texts), model.score(quality.statistics(pa.array([texts[i] for i in sorted(texts)], pa.large_string())))))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs.repartition(5), table(spark, DATA, "labels")).collect()}
    assert got.keys() == want.keys() and np.mean([abs(got[i] - want[i]) < 1e-6 for i in want]) > 0.99


def test_op7_lines(spark):
    """Every line that is a notice has its licence, unless another one overlaps it."""
    some = [(n, licences.bigrams(t)) for n, t in licences.NOTICES]
    want = {(i, max(some, key=lambda x: licences.dice(own, x[1]))[0]) for i, t in documents().items() for line in t.split("\n") if (own := licences.bigrams(line)) and max(licences.dice(own, s) for _, s in some) >= licences.LEAST}
    got = {(r["doc_id"], r["licence"]) for r in queries.QUERIES["op7_licence_scan"](spark, DATA).collect()}
    assert got >= want and want


def test_op9_finds_whole_items(spark):
    items = duckdb.sql(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    want = {(d, i) for i, s in items for d, t in documents().items() if s in t}
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op9_benchmark_decontamination"](spark, DATA).collect()}
    assert got >= want


def plain_words(text):
    return [wordsplit.plain_word(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]


def holds(words, item):
    """Whether a stretch of 13 words (or all of a shorter item) or more agrees with the item in 80 %, at any place of both."""
    if len(item) < decontaminate.SPAN:
        return any(words[k : k + len(item)] == item for k in range(len(words) - len(item) + 1)) and bool(item)
    least = min(decontaminate.LEAST_WORDS, len(item))
    own = {w: [k for k, x in enumerate(item) if x == w] for w in set(item)}
    hits = Counter(k - j for k, w in enumerate(words) for j in own.get(w, ()))
    for diagonal in (d for d, n in hits.items() if n >= 0.8 * least):
        first, last = max(0, -diagonal), min(len(item), len(words) - diagonal)
        sums = [0, *itertools.accumulate(1 if item[k] == words[k + diagonal] else -4 for k in range(first, last))]
        if any(sums[b] >= min(sums[: b - least + 1]) for b in range(least, len(sums))):
            return True
    return False


def test_pipeline_equals_stages(spark):
    """The whole run against the operators' decisions applied one after the other in Python."""
    docs = table(spark, DATA, "documents")
    items = [plain_words(t) for (t,) in duckdb.sql(f"SELECT text FROM '{DATA}/benchmark.parquet'").fetchall()]
    texts = documents()
    good = {r["doc_id"] for r in quality.score(docs, table(spark, DATA, "labels")).where("predicted = 1").collect()}
    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in stage.select("doc_id").collect()}
        stage = f(spark, stage, DATA).cache()
        assert stage.columns == docs.columns
        ids = [r["doc_id"] for r in stage.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before
        if name == "quality_classifier":
            assert set(ids) == good
        if name == "minhash_near_dedup":
            rows = sorted((i, texts[i]) for i in before)
            same, _ = brute_classes(rows, weighted=True)  # every pair of texts, in plain Python
            assert set(ids) == {c for (_, t), c in zip(rows, same) if t.split()} | {i for i, t in rows if not t.split()}
        if name == "benchmark_decontamination":
            found = {i for i in before for own in items if holds(plain_words(texts[i]), own)}
            assert set(ids) == before - found and found
        if name == "secret_scan":
            assert set(ids) == before
            for r in stage.collect():
                base, added = secrets.scan_text(texts[r["doc_id"]])
                assert r["text"] == secrets.redact(texts[r["doc_id"]], base + added) and r["n_chars"] == len(r["text"])
    lib = wordtok.load(wordtok.vocabulary_path()).library
    want = {r["doc_id"]: len(lib.encode(r["text"], add_special_tokens=False).ids) + 1 for r in stage.collect()}
    rows = corpus_pipeline.run(spark, DATA).collect()
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated ids and rows, empty texts, an extra column; then empty tables."""
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (1, "other text of one id", None, None, None), (2, None, "en", "s", None), (3, "", None, "s", 0), (None, "no id here", "en", "s", 10), (None, None, None, None, None), (4, "token = abcdefghij", "en", "s", 18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("item_id", F.lit(1)).withColumn("length", F.lit("x"))
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (None, "a b c d e f")], "item_id long, text string")
    for name, frame in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        frame.write.parquet(str(tmp_path / "odd" / f"{name}.parquet"))
        frame.limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == [1, 2, 3, 4, None, None]
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path / "odd"))
        assert stage.columns == docs.columns
    assert {r["text"] for r in stage.where("doc_id = 4").collect()} == {"[SECRET]"}
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_operators_of_empty_tables_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for frame in (secrets.scan(none), secrets.redact_documents(none), licences.scan(none), decontaminate.drop_contaminated(none, bench), quality.keep_good(none, labels), separators.count_tokens(none)):
        assert frame.count() == 0
    odd = spark.createDataFrame([(None, "password = abcdefgh, released under the MIT license"), (None, None)], "doc_id long, text string")
    assert sorted((r["n_assign"], r["doc_id"]) for r in secrets.scan(odd).collect()) == [(0, None), (1, None)]
    assert [(r["doc_id"], r["licence"]) for r in licences.scan(odd).collect()] == [(None, "MIT")]
