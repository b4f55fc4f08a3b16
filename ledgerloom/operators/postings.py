"""BM25 over postings that are written once: an inverted index in segments of blocks, bucketed by term.

A block is a run of documents of one task, of about POSTINGS postings; inside it a document is a slot. A row has all postings of a
term in a block: gaps between slots and counts, as numbers of base 128. The row of a block without a term, in bucket -1, has its
documents' ids and lengths. A segment holds the rows in a folder for each bucket of terms, the number and the length of its documents,
and the slots of earlier segments that it replaces or deletes. Document frequencies are sums over a term's rows. The manifest names the
segments in force, and is written last, so a write that fails leaves the index as it was. A search reads the buckets of its terms, 16 bytes for each document and nothing of
the texts; rows of one block meet in one task, and each task keeps its own best k of each query.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.storage import commit, committed, shared_folder
from ledgerloom.functions.tables import read, small, small_batches
from ledgerloom.functions.text import words
from ledgerloom.operators import retrieval
from ledgerloom.operators.lexical import K1, ROWS, B, asked_terms, best_rows, ranked, sent_queries, too_many
from ledgerloom.operators.topk import Best

#: Buckets of terms of a new index, and tasks that write one bucket: postings of a term that all documents have are in so many files.
BUCKETS, WRITERS = 256, 16
#: Postings and documents after which a block ends; a single document is never cut.
POSTINGS, SLOTS = 1_000_000, 65_536
#: Rows of a block that are handed on together.
TERMS = 50_000
PACKED = "term string, block long, n int, data binary"


def encoded(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A row of bytes from each place of `first` on: whole numbers below 2^35 in base 128, low digits first, the high bit on all but the last."""
    width = np.ones(len(values), np.int64)
    for digits in range(1, 5):
        width += values >= 1 << 7 * digits
    end = np.cumsum(width)
    at, out = end - width, np.zeros(end[-1] if len(end) else 0, np.uint8)
    for i in range(5):
        has = width > i
        out[at[has] + i] = ((values[has] >> 7 * i) & 127) | ((width[has] > i + 1).astype(np.int64) << 7)
    offsets = np.r_[at[first], len(out)].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def decoded(rows: pa.Array) -> np.ndarray:
    """All numbers of rows that `encoded` made."""
    data = np.frombuffer(b"".join(rows.to_pylist()), np.uint8)
    end = np.nonzero(data < 128)[0]
    if not len(end):
        return np.zeros(0, np.int64)
    begin = np.r_[0, end[:-1] + 1]
    digit = np.arange(len(data)) - np.repeat(begin, end - begin + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * digit, begin)


def interleaved(gap: np.ndarray, tf: np.ndarray, first: np.ndarray) -> pa.Array:
    """Rows of postings: twice the gap, plus one for a count of 1; another count follows as an odd number."""
    more = tf != 1
    at = np.cumsum(1 + more) - 1 - more
    out = np.zeros(len(gap) + int(more.sum()), np.int64)
    out[at] = gap << 1 | ~more
    out[at[more] + 1] = tf[more] << 1 | 1
    return encoded(out, at[first])


def separated(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(gaps, counts) of rows that `interleaved` made: a number behind an even one is its count."""
    x = decoded(rows)
    even = x & 1 == 0
    count = np.r_[False, even[:-1]] if len(x) else even
    tf = np.ones(len(x), np.int64)
    tf[even] = x[count] >> 1
    return x[~count] >> 1, tf[~count]


class _Packer:
    """Collects documents and makes blocks of them."""

    def __init__(self, most: int):
        self.part, self.made, self.most = TaskContext.get().partitionId(), 0, most
        self._clear()

    def _clear(self):
        self.ids, self.lengths, self.terms, self.slots, self.tfs, self.docs, self.size = [], [], [], [], [], 0, 0

    def add(self, ids, lengths, terms: pa.DictionaryArray, slots, tfs):
        """Documents, and their postings with the place of the document in `ids`. Blocks that are full come out."""
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.terms.append(terms)
        self.slots.append(slots + self.docs)
        self.tfs.append(tfs)
        self.docs, self.size = self.docs + len(ids), self.size + len(slots)
        if self.size >= self.most or self.docs >= SLOTS:
            yield from self.flush()

    def flush(self):
        if not self.docs:
            return
        block = self.part << 24 | self.made
        self.made += 1
        raw = np.concatenate(self.ids + self.lengths).astype("<i8").tobytes()
        yield _packed(pa.array([None], pa.string()), block, np.array([self.docs]), pa.array([raw], pa.binary()))
        terms = pa.chunked_array(self.terms).unify_dictionaries().combine_chunks()
        terms = terms.chunk(0) if isinstance(terms, pa.ChunkedArray) else terms
        code, slot, tf = terms.indices.to_numpy().astype(np.int64), np.concatenate(self.slots), np.concatenate(self.tfs)
        self._clear()
        order = np.argsort(code * (int(slot.max(initial=0)) + 1) + slot)
        code, slot, tf = code[order], slot[order], tf[order]
        first = np.nonzero(np.diff(code, prepend=-1))[0]
        gap = np.diff(slot, prepend=0)
        gap[first] = slot[first]
        n = np.diff(np.r_[first, len(code)])
        rows = _packed(terms.dictionary.take(pa.array(code[first])), block, n, interleaved(gap, tf, first))
        yield from (rows.slice(at, TERMS) for at in range(0, rows.num_rows, TERMS))


def _packed(term, block, n, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([term, pa.array(np.full(len(n), block)), pa.array(n.astype(np.int32)), data], names=["term", "block", "n", "data"])


def packed(docs: DataFrame, most: int = POSTINGS) -> DataFrame:
    """Rows (term, block, n, data) of docs (doc_id, text) in blocks of about `most` postings, counted inside each document and without a shuffle."""

    small_batches(docs.sparkSession)

    def pack(batches):
        packer = _Packer(most)
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):  # a document gives many postings
            col = b.column(1)
            offset = col.offsets.to_numpy()
            flat = col.values.slice(offset[0], offset[-1] - offset[0]).dictionary_encode()
            length = np.diff(offset).astype(np.int64)
            width = max(1, len(flat.dictionary))
            key, tf = np.unique(np.repeat(np.arange(len(length)), length) * width + flat.indices.to_numpy(), return_counts=True)
            terms = pa.DictionaryArray.from_arrays(pa.array((key % width).astype(np.int32)), flat.dictionary)
            yield from packer.add(b.column(0).cast(pa.int64()).to_numpy(), length, terms, key // width, tf)
        yield from packer.flush()

    return docs.select("doc_id", words(F.coalesce(F.col("text"), F.lit(""))).alias("w")).mapInArrow(pack, PACKED)


def _blocks(batches):
    """(ids, lengths, living, slot, row, tf, rows) of each block; batches are sorted by (seg, block, code), with a block's documents (code -2) and dead slots (-1) first."""
    held, name = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        seg, block = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("seg", "block"))
        cuts = np.r_[0, np.nonzero((np.diff(seg) != 0) | (np.diff(block) != 0))[0] + 1, len(seg)]
        for a, z in zip(cuts[:-1], cuts[1:]):
            if (seg[a], block[a]) != name:
                if held:
                    yield _block(held)
                held, name = [], (seg[a], block[a])
            held.append(batch.slice(a, z - a))
    if held:
        yield _block(held)


def _places(data) -> np.ndarray:
    """Ids and lengths of a block's documents."""
    return np.frombuffer(data.as_py(), "<i8").reshape(2, -1)


def _block(held):
    rows = pa.Table.from_batches(held).combine_chunks()
    code = rows["code"].to_numpy()
    ids, lengths = _places(rows["data"][0])
    begin = int(np.searchsorted(code, 0))
    living = np.ones(len(ids), bool)
    for i in range(1, begin):
        living[rows["dead"][i].as_py()] = False
    rows = rows.slice(begin)
    n = rows["n"].to_numpy()
    gap, tf = separated(rows["data"])
    row, total = np.repeat(np.arange(len(n)), n), np.cumsum(gap)
    first = np.cumsum(n) - n
    slot = total - np.repeat(total[first] - gap[first], n) if len(n) else gap
    ok = living[slot]
    return ids, lengths, living, slot[ok], row[ok], tf[ok], rows


def _unpack(batches):
    for ids, lengths, _, slot, row, tf, rows in _blocks(batches):
        for at in range(0, len(slot), TERMS):
            s = slot[at : at + TERMS]
            yield pa.RecordBatch.from_arrays([rows["term"].combine_chunks().take(pa.array(row[at : at + TERMS])), pa.array(ids[s]), pa.array(tf[at : at + TERMS]), pa.array(lengths[s])], names=["term", "doc_id", "tf", "dl"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, dl) of docs (doc_id, text): the postings one by one."""
    return _dealt(packed(docs).select(F.lit(0).alias("seg"), "block", F.when(F.col("term").isNull(), -2).otherwise(0).alias("code"), "term", "n", "data", F.lit(None).cast("array<int>").alias("dead"))).mapInArrow(_unpack, "term string, doc_id long, tf long, dl long")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("seg", "block").sortWithinPartitions("seg", "block", "code", "term")


class Postings:
    """An index at `path`; documents (doc_id, text) are distinct by id. An index keeps the `buckets` that it was begun with."""

    ROWS, TOTALS = f"{PACKED}, bucket int", "n long, total long"
    GONE = "segment string, block long, dead array<int>"

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, writers: int = WRITERS, most: int = POSTINGS):
        self.spark, self.path, self.writers, self.most = spark, path, writers, most
        self.number, names = committed(spark, path)
        self.buckets = int(names[0]) if names else buckets
        self.segments = names[1:]

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _all(self, what: str, schema: str) -> DataFrame:
        """The rows of a table in all segments, with `seg`, the place of their segment."""
        out = self.spark.createDataFrame([], f"{schema}, seg int")
        for i, name in enumerate(self.segments):
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{what}").withColumn("seg", F.lit(i)))
        return out

    def _gone(self) -> DataFrame:
        """(seg, block, dead) of slots that later segments replace or delete."""
        names = F.array(*[F.lit(x) for x in self.segments])
        return self._all("gone", self.GONE).select((F.array_position(names, F.col("segment")) - 1).cast("int").alias("seg"), "block", "dead").where("seg >= 0")

    def _documents(self) -> DataFrame:
        """Rows of the blocks' documents and of their dead slots, as `_blocks` takes them."""
        docs = self._all("postings", self.ROWS).where("bucket = -1")
        docs = docs.select("seg", "block", F.lit(-2).alias("code"), "term", "n", "data", F.lit(None).cast("array<int>").alias("dead"))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("term", "string"), ("n", "int"), ("data", "binary"))]
        return docs.unionByName(self._gone().select("seg", "block", F.lit(-1).alias("code"), *none, "dead"))

    def documents(self) -> DataFrame:
        """(doc_id, dl) of the documents in force."""

        def living(batches):
            for ids, lengths, ok, *_ in _blocks(batches):
                yield pa.RecordBatch.from_arrays([pa.array(ids[ok]), pa.array(lengths[ok])], names=["doc_id", "dl"])

        return _dealt(self._documents()).mapInArrow(living, "doc_id long, dl long")

    def postings(self, buckets: list[int] | None = None) -> DataFrame:
        """Rows of terms in blocks, of all buckets or of some."""
        rows = self._all("postings", self.ROWS)
        return rows.where(F.col("bucket") >= 0 if buckets is None else F.col("bucket").isin(buckets))

    def _coded(self, rows: DataFrame) -> DataFrame:
        """Rows of terms with `code`, beside those of their documents, dealt by block."""
        return _dealt(self._documents().unionByName(rows.select("seg", "block", "code", "term", "n", "data", F.lit(None).cast("array<int>").alias("dead"))))

    def _dead(self, ids: DataFrame) -> DataFrame:
        """(segment, block, dead) of the documents with ids (doc_id)."""

        def places(batches):
            for b in batches:
                for seg, block, data in zip(b.column(0), b.column(1), b.column(2)):
                    at = _places(data)[0]
                    yield pa.RecordBatch.from_arrays([pa.array([seg.as_py()] * len(at), pa.int32()), pa.array(np.full(len(at), block.as_py())), pa.array(np.arange(len(at), dtype=np.int32)), pa.array(at)], names=["seg", "block", "slot", "doc_id"])

        if not self.segments:
            return self.spark.createDataFrame([], self.GONE)
        rows = self._documents().where("code = -2").select("seg", "block", "data").mapInArrow(places, "seg int, block long, slot int, doc_id long")
        names = F.array(*[F.lit(x) for x in self.segments])
        found = rows.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("seg", "block").agg(F.collect_list("slot").alias("dead"))  # at most a block's documents
        return found.select(F.element_at(names, F.col("seg") + 1).alias("segment"), "block", "dead")

    def _segment(self, rows: DataFrame | None, gone: DataFrame) -> str:

        def lengths(batches):
            for b in batches:
                dl = [_places(x)[1] for x in b.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in dl], pa.int64()), pa.array([int(x.sum()) for x in dl], pa.int64())], names=["n", "total"])

        name = f"segment-{uuid.uuid4().hex}"
        at = f"{self.path}/{name}"
        rows = self.spark.createDataFrame([], PACKED) if rows is None else rows
        rows = rows.withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(self.bucket(F.col("term"))))
        rows.repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(self.writers))).sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{at}/postings")
        docs = self.spark.read.schema(self.ROWS).parquet(f"{at}/postings").where("bucket = -1").select("data")
        docs.mapInArrow(lengths, self.TOTALS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).write.parquet(f"{at}/totals")
        gone.write.parquet(f"{at}/gone")
        return name

    def upsert(self, docs: DataFrame) -> None:
        """Adds documents; those whose id is there already are replaced."""
        rows = docs.select("doc_id", "text")
        self._commit([*self.segments, self._segment(packed(rows, self.most), self._dead(rows))])

    def delete(self, ids: DataFrame) -> None:
        """Deletes documents by ids (doc_id)."""
        self._commit([*self.segments, self._segment(None, self._dead(ids))])

    def compact(self) -> None:
        """One segment of all that is in force, small blocks joined. Earlier ones stay in the folder for readers that are at work."""
        most = self.most

        def pack(batches):
            packer = _Packer(most)
            for ids, lengths, living, slot, row, tf, rows in _blocks(batches):
                place = np.cumsum(living) - 1
                terms = pa.DictionaryArray.from_arrays(pa.array(row.astype(np.int32)), rows["term"].combine_chunks())
                yield from packer.add(ids[living], lengths[living], terms, place[slot], tf)
            yield from packer.flush()

        rows = self._coded(self.postings().withColumn("code", F.lit(0))).mapInArrow(pack, PACKED)
        self._commit([self._segment(rows, self.spark.createDataFrame([], self.GONE))])

    def _commit(self, segments: list[str]) -> None:
        commit(self.spark, self.path, self.number + 1, [str(self.buckets), *segments])
        self.number, self.segments = self.number + 1, segments

    def search(self, queries: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), k1: float = K1, b: float = B) -> DataFrame:
        """The best k documents (*by, doc_id, score, rank) of queries (*by, text); the same as `bm25` over the documents in force."""
        by = tuple(by)
        asked = asked_terms(queries, by)
        terms = asked.select(F.explode("terms").alias("term")).distinct()
        wanted = sorted(r[0] for r in terms.select(self.bucket(F.col("term"))).distinct().collect())  # as many as buckets at most
        if too_many(asked):
            return self._joined(asked, terms, wanted, k, k1, b, by)
        sent, known, keys, out = sent_queries(asked, by)
        codes = F.broadcast(self.spark.createDataFrame([(t, i) for i, t in enumerate(known)], "term string, code int"))  # bounded by too_many
        rows = self._coded(self.postings(wanted).join(codes, "term"))

        def count(batches):
            n, total, df = 0, 0, np.zeros(len(known), np.int64)
            for _, lengths, living, _, row, _, rows_ in _blocks(batches):
                n, total = n + int(living.sum()), total + int(lengths[living].sum())
                df += np.bincount(rows_["code"].to_numpy()[row], minlength=len(df))
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, np.arange(len(df))]), pa.array(np.r_[n, total, df])], names=["i", "x"])

        if self._gone().take(1):
            got = dict(map(tuple, rows.mapInArrow(count, "i long, x long").groupBy("i").agg(F.sum("x")).collect()))  # a number for each term
        else:  # the written numbers hold
            got = dict(map(tuple, self.postings(wanted).join(codes, "term").groupBy("code").agg(F.sum("n")).collect()))
            got[-2], got[-1] = (x or 0 for x in self._all("totals", self.TOTALS).agg(F.sum("n"), F.sum("total")).first())
        n, total = got.get(-2, 0), got.get(-1, 0)
        df = np.array([got.get(i, 0) for i in range(len(known))], np.float64)
        idf = self.spark.sparkContext.broadcast(np.log(1 + (n - df + 0.5) / (df + 0.5)))
        average = max(total / n if n else 1.0, 1e-300)

        def score(batches):
            asks = sent.value
            best = Best(asks.n, k)
            for ids, lengths, _, slot, row, tf, rows_ in _blocks(batches):
                code = rows_["code"].to_numpy()[row]
                order = np.lexsort((code, slot))
                slot, code, tf = slot[order], code[order], tf[order]
                weight = idf.value[code] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[slot] / average))
                for d, q, sums in asks.scores(slot, code, weight):
                    best.add(q, ids[d], np.round(sums, 6))
            yield from best_rows(best, keys, by)

        return ranked(rows.mapInArrow(score, out), k, by=by)

    def _joined(self, asked: DataFrame, terms: DataFrame, wanted: list[int], k: int, k1: float, b: float, by) -> DataFrame:
        """The search for query sets that can't be sent to all tasks: postings one by one, joined with the queries by term."""
        one = self.documents().agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        n, average = one[0], max(one[1] / one[0] if one[0] else 1.0, 1e-300)
        rows = self.postings(wanted).join(small(terms), "term", "left_semi").withColumn("code", F.lit(0))
        postings = self._coded(rows).mapInArrow(_unpack, "term string, doc_id long, tf long, dl long")
        idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = postings.groupBy("term").agg(F.count("*").alias("df")).select("term", idf.alias("idf"))
        part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / average))
        pairs = asked.select(*by, F.explode("terms").alias("term"))
        return ranked(pairs.join(postings, "term").join(weights, "term").groupBy(*by, "doc_id").agg(F.round(F.sum(part), 6).alias("score")), k, by=by)


# queries


def rt2_postings(spark, d):
    """BM25 from an index that was built with old texts of every seventh document, and then given the present ones."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    old = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.reverse("text")).otherwise(F.col("text")))
    index = Postings(spark, shared_folder(spark, "postings"), buckets=8, writers=2)
    index.upsert(old)
    index.upsert(docs.where("doc_id % 7 = 0"))
    return index.search(read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), retrieval.K).select("query_id", "doc_id", "score", "rank")


QUERIES = {"rt2_postings": rt2_postings}
SQL = {"rt2_postings": retrieval.SQL["rt2_bm25"]}
