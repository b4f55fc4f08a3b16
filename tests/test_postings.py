import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions.storage import commit, committed, shared_folder
from ledgerloom.operators import lexical
from ledgerloom.operators.postings import Postings, decoded, encoded, interleaved, packed, separated, term_counts

DOCS, QUERIES = "doc_id long, text string", "query_id long, text string"


def rows_of(n, seed):
    rnd = random.Random(seed)
    return [(i, rnd.choice([None, "", "the"]) if i % 17 == 0 else "the " + " ".join(rnd.choice("abcdefghij") * rnd.randint(1, 2) for _ in range(rnd.randint(1, 40)))) for i in range(n)]


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "a bb the"), (2, "c c zz"), (3, ""), (4, "j the hh Dd")], QUERIES)


def same(index, docs, queries, k=7):
    got = sorted(map(tuple, index.search(queries, k).collect()))
    assert got == sorted(map(tuple, lexical.bm25(docs, queries, k).select("query_id", "doc_id", "score", "rank").collect()))
    return got


def test_equals_bm25_over_upserts_and_deletes(spark, queries, monkeypatch):
    index = Postings(spark, shared_folder(spark, "p"), 8, 2)
    rows = dict(rows_of(300, 1))
    frame = lambda r: spark.createDataFrame(list(r.items()), DOCS).repartition(3)
    index.upsert(frame(rows))
    assert same(index, frame(rows), queries)
    new = dict(rows_of(500, 2)[250:])
    rows |= new
    index.upsert(frame(new))
    same(index, frame(rows), queries)
    for i in (3, 260, 499):
        del rows[i]
    index.delete(spark.createDataFrame([(3,), (260,), (499,), (12345,)], "doc_id long"))
    before = same(index, frame(rows), queries)
    index.compact()
    assert len(index.segments) == 1 and same(index, frame(rows), queries) == before
    again = Postings(spark, index.path)
    assert same(again, frame(rows), queries) == before
    index.upsert(frame({3: "a bb the the"}))
    same(index, frame(rows | {3: "a bb the the"}), queries)
    monkeypatch.setattr(lexical, "MAX_PAIRS", 0)
    same(index, frame(rows | {3: "a bb the the"}), queries)


def test_only_the_buckets_of_the_terms_are_read(spark, queries):
    index = Postings(spark, shared_folder(spark, "p"), 8, 2)
    index.upsert(spark.createDataFrame(rows_of(200, 3), DOCS))
    own = index.postings([r[0] for r in index.postings().where("term = 'bb'").select("bucket").distinct().collect()])
    files = {r[0] for r in own.select(F.input_file_name()).distinct().collect()}
    assert files and all(len({f.split("bucket=")[1].split("/")[0] for f in files}) == 1 for _ in [0])
    assert "PartitionFilters: [" in own._jdf.queryExecution().toString() and "bucket#" in own._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_a_write_that_fails_changes_nothing(spark, queries, monkeypatch):
    index = Postings(spark, shared_folder(spark, "p"), 8, 2)
    docs = spark.createDataFrame(rows_of(60, 4), DOCS)
    index.upsert(docs)
    for step in range(4):
        calls = []
        real = type(docs.write).parquet

        def failing(self, path, *a, step=step, calls=calls, real=real, **kw):
            calls.append(path)
            if len(calls) == step + 1:
                raise OSError("lost")
            return real(self, path, *a, **kw)

        monkeypatch.setattr(type(docs.write), "parquet", failing)
        with pytest.raises(OSError):
            Postings(spark, index.path).upsert(spark.createDataFrame([(1, "zz zz")], DOCS))
        monkeypatch.undo()
        same(Postings(spark, index.path), docs, queries)


def test_of_two_writers_one_loses(spark):
    path = shared_folder(spark, "p")
    commit(spark, path, 1, ["a"])
    with pytest.raises(Exception, match="(?i)exist"):
        commit(spark, path, 1, ["b"])
    assert committed(spark, path) == (1, ["a"])


def test_empty_index_and_queries(spark, queries):
    index = Postings(spark, shared_folder(spark, "p"), 8, 2)
    assert index.search(queries, 3).count() == 0
    index.upsert(spark.createDataFrame([], DOCS))
    assert index.search(queries, 3).count() == 0
    index.upsert(spark.createDataFrame([(1, "a a b"), (2, None)], DOCS))
    assert [(r.query_id, r.doc_id) for r in index.search(queries, 3).collect()] == [(1, 1)] and index.search(queries.limit(0), 3).count() == 0
    assert sorted(map(tuple, term_counts(spark.createDataFrame([(1, "a a b"), (2, None)], DOCS)).collect())) == [("a", 1, 2, 3), ("b", 1, 1, 3)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**35 - 1)), min_size=1)))
def test_numbers_come_back_from_base_128(rows):
    flat = np.array([x for r in rows for x in r], np.int64)
    first = np.cumsum([0, *(len(r) for r in rows)])[:-1].astype(np.int64)
    got = encoded(flat, first)
    assert len(got) == len(rows) and decoded(got).tolist() == flat.tolist() and [decoded(got.slice(i, 1)).tolist() for i in range(len(rows))] == rows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 70_000), st.one_of(st.just(1), st.integers(1, 2**31))), min_size=1)))
def test_gaps_and_counts_come_apart_again(rows):
    gap, tf = (np.array([p[i] for r in rows for p in r], np.int64) for i in (0, 1))
    first = np.cumsum([0, *(len(r) for r in rows)])[:-1].astype(np.int64)
    got = interleaved(gap, tf, first)
    assert len(got) == len(rows)
    for part, of in ((got, [p for r in rows for p in r]), *((got.slice(i, 1), r) for i, r in enumerate(rows))):
        assert list(zip(*(x.tolist() for x in separated(part)))) == of


def test_many_small_blocks_and_their_compaction(spark, queries):
    rows = dict(rows_of(200, 5))
    frame = lambda r: spark.createDataFrame(list(r.items()), DOCS).coalesce(1)
    assert packed(frame(rows), 50).where("term is null").count() == 1  # a batch of documents isn't cut
    index = Postings(spark, shared_folder(spark, "p"), 4, 2, most=50)
    for part in range(4):
        index.upsert(frame({i: t for i, t in rows.items() if i % 4 == part}))
    new = {8: "a bb a bb", 9: None, 10: "c"}
    index.upsert(frame(new))
    before = same(index, frame(rows | new), queries)
    assert index._gone().agg(F.sum(F.size("dead"))).first()[0] == 3 and index.documents().count() == 200
    merged = Postings(spark, index.path)
    merged.compact()
    assert same(merged, frame(rows | new), queries) == before and merged._gone().count() == 0
    assert merged.postings().agg(F.countDistinct("block")).first()[0] <= index.postings().select("seg", "block").distinct().count()
