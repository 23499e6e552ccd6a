"""The pipeline's stages against plain versions, on the smallest tables."""

from __future__ import annotations

import pytest
from test_operators import PIECES, bench_words, plain_lines, union

import corpus_pipeline
from tallyline.llm import registry, sentencepiece_stream

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), DIR).columns == docs.columns


def test_quality(spark, docs):
    out = set(texts(corpus_pipeline.quality(spark, docs, DIR)))
    bad = {r.doc_id for r in spark.read.parquet(f"{DIR}/labels.parquet").where("toxic = 1 or quality = 0").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{DIR}/labels.parquet").where("toxic = 0 and quality = 1").collect()}
    assert len(out & good) >= 0.9 * len(good) and len(out & bad) <= 0.4 * len(bad)


def test_lines(spark, docs):
    out = corpus_pipeline.lines(spark, docs, DIR).collect()
    want = {d: (t, n) for d, t, n in plain_lines(list(texts(docs).items()), 3)}
    before = {r.doc_id: r.n_chars for r in docs.collect()}
    for r in out:
        text, n = want[r.doc_id]
        assert r.text == text and r.n_chars == (len(text) if n else before[r.doc_id])


def test_near_duplicates(spark, docs):
    rows = texts(docs)
    words = {d: (t or "").lower().split() for d, t in rows.items()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for d, w in words.items()}
    near = lambda a, b: words[a] == words[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    pairs = [(a, b) for a in rows for b in rows if a < b and near(a, b)]
    top, kept = union(pairs, rows), set(texts(corpus_pipeline.near_duplicates(spark, docs, DIR)))
    clean = {d for d in rows if top[d] == d}
    assert clean <= kept and len(kept - clean) <= 0.1 * (len(rows) - len(clean))


def test_benchmark(spark, docs):
    grams = set()
    for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect():
        w = bench_words(r.text)
        grams |= {tuple(w[i : i + min(10, len(w))]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(g) for g in grams}
    bad = set()
    for d, t in texts(docs).items():
        w = bench_words(t)
        if any(tuple(w[i : i + n]) in grams for n in sizes for i in range(len(w) - n + 1)):
            bad.add(d)
    assert bad and set(texts(corpus_pipeline.benchmark(spark, docs, DIR))) == set(texts(docs)) - bad


def test_pieces_and_run(spark, docs):
    codec = sentencepiece_stream.Codec(PIECES)
    for r in corpus_pipeline.pieces(spark, docs, DIR).collect():
        assert r.same and r.n_ids == len(codec.encode(texts_cache(docs)[r.doc_id])) // 4
    out = corpus_pipeline.run(spark, DIR)
    assert 0 < out.count() < docs.count() and out.where("not same").count() == 0


_CACHE: dict = {}


def texts_cache(docs):
    if not _CACHE:
        _CACHE.update(texts(docs))
    return _CACHE


def test_odd_rows(spark):
    rows = [(None, "a b c", None, None, None), (None, None, "en", "s", 3), (1, "x\ny\nz\nw", "en", "s", 7), (1, "x\ny\nz\nw", "en", "s", 7), (2, None, None, "s", 0), (3, "", "en", None, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, DIR)
        assert stage(spark, df.limit(0), DIR).count() == 0
        assert out.where("doc_id is null").count() >= 1
        if out.columns == df.columns:
            df = out


def test_sql(spark):
    """The queries that have SQL agree with it."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, DIR)
        rel = con.execute(sql)
        names = [c[0] for c in rel.description]
        assert sorted(names) == sorted(df.columns), name
        assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r)) for r in df.select(*names).collect()), name
