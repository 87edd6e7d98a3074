"""Dense and lexical top-k retrieval for a batch of queries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import terms
from granary.session import plain_unions, spread

#: Bounds of what a block of queries sends to every task, and of what a task holds at a time.
QUERY_BYTES, QUERY_TERMS = 128 << 20, 1 << 20
BLOCK, CELLS, KEPT_ROWS = 1024, 1 << 22, 1 << 18


def l2_norm(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalised(c: Column | str) -> Column:
    """The vector at unit length; a zero vector stays."""
    v = F.col(c) if isinstance(c, str) else c
    n = l2_norm(v)
    return F.transform(v, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def top_k(df: DataFrame, k: int, by: str = "qid", order: list[Column] | None = None) -> DataFrame:
    """The k first rows per query with their rank; partial limits run before the shuffle."""
    w = Window.partitionBy(by).orderBy(*(order or [F.col("score").desc(), F.col("id")]))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class Best:
    """The k best (query, id, score) rows of each query that a task has met; ties go to the lower id."""

    def __init__(self, k: int, id_type: pa.DataType):
        self.k = k
        self.schema = pa.schema([("q", pa.int64()), ("id", id_type), ("score", pa.float64())])
        self.held: list[pa.Table] = []
        self.n, self.kept = 0, 0

    def add(self, q: np.ndarray, ids: pa.Array, score: np.ndarray) -> None:
        self.held.append(pa.Table.from_arrays([pa.array(q.astype(np.int64)), ids, pa.array(score)], schema=self.schema))
        self.n += len(q)
        if self.n > 2 * self.kept + KEPT_ROWS:
            self.prune()

    def prune(self) -> pa.Table:
        t = pa.concat_tables([self.schema.empty_table(), *self.held]).combine_chunks()
        t = t.take(pc.sort_indices(t, sort_keys=[("q", "ascending"), ("score", "descending"), ("id", "ascending")]))
        q = t.column("q").to_numpy()
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        t = t.filter(pa.array(place < self.k))
        self.held, self.n, self.kept = [t], len(t), len(t)
        return t

    def rows(self, qids: pa.Array) -> Iterator[pa.RecordBatch]:
        for b in self.prune().combine_chunks().to_batches():
            yield pa.RecordBatch.from_arrays([qids.take(b.column(0)), b.column(1), b.column(2)], ["qid", "id", "score"])


def _best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows as good as the k-th best of each line, ties included; -inf counts as no hit."""
    few = min(k, scores.shape[1])
    floor = -np.partition(-scores, few - 1, axis=1)[:, few - 1]
    return np.nonzero((scores >= floor[:, None]) & np.isfinite(scores))


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, keep_self: bool = False, same: str | None = None, size: int | None = None) -> DataFrame:
    """(qid, id, score, rank): the k nearest rows by cosine for every query, exactly.

    `vectors` has id and embedding, `queries` qid and embedding; with `same`
    both have that column and only rows with an equal value count. `size` is the
    length of a vector, by default the commonest among the queries (of equals
    the greatest). Queries are cut into blocks of bounded size; each block goes
    to every task once and meets the vectors in matrix products, of which a task
    keeps k rows per query. Null vectors, vectors of another length and zero
    vectors match nothing. Ties go to the lower id; scores are rounded to 6
    digits first.
    """
    spark = vectors.sparkSession
    id_kind, q_kind = vectors.schema["id"].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()
    lengths = queries.filter("embedding is not null").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return spark.createDataFrame([], f"qid {q_kind}, id {id_kind}, score double, rank int")
    n = size or lengths.n
    plain_unions(spark)
    cols = ["embedding"] + ([same] if same else [])
    good = (F.size("embedding") == n) & ~F.exists("embedding", lambda x: x.isNull())
    asked = queries.filter(good)
    parts = max(1, -(-asked.count() // max(1, QUERY_BYTES // (8 * n))))
    out = None
    for p in range(parts):
        block = asked if parts == 1 else asked.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == p)
        got = block.select("qid", *cols).toArrow().combine_chunks()
        m = got.column("embedding").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, n)
        length = np.linalg.norm(m, axis=1)
        m = m / np.where(length > 0, length, np.inf)[:, None]
        sent = spark.sparkContext.broadcast((m, got.column("qid").combine_chunks(), got.column(same).combine_chunks() if same else None, length > 0))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            m, qids, marks, some = sent.value
            best = None
            for whole in batches:
                best = best or Best(k, whole.schema.field(0).type)
                for at in range(0, whole.num_rows, BLOCK):
                    b = whole.slice(at, BLOCK)
                    x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
                    length = np.linalg.norm(x, axis=1)
                    x = x / np.where(length > 0, length, np.inf)[:, None]
                    for a in range(0, len(m), BLOCK):
                        s = np.round(m[a : a + BLOCK] @ x.T, 6)
                        bad = (length == 0)[None, :] | ~some[a : a + BLOCK, None]
                        # equal values of both sides, as places in a list of them; nulls equal nothing
                        for left, right, drop in ((qids, b.column(0), True), (marks, b.column(2) if same else None, False)):
                            if right is None or drop and keep_self:
                                continue
                            mine = left.slice(a, BLOCK)
                            known = pc.unique(mine)
                            one, two = (pc.index_in(x, value_set=known, skip_nulls=True) for x in (mine, right.cast(left.type)))
                            equal = one.fill_null(-1).to_numpy()[:, None] == two.fill_null(-2).to_numpy()[None, :]
                            bad = bad | (equal if drop else ~equal)
                        s[bad] = -np.inf
                        i, j = _best_of(s, k)
                        best.add(i + a, b.column(0).take(pa.array(j)), s[i, j])
            if best:
                yield from best.rows(qids)

        hits = spread(vectors.filter(good).select("id", *cols)).mapInArrow(run, f"qid {q_kind}, id {id_kind}, score double")
        out = hits if out is None else out.unionByName(hits)
    return top_k(out, k)


def postings(docs: DataFrame) -> DataFrame:
    """(id, term, tf, dl) of (id, text)."""
    t = docs.select("id", terms("text").alias("t"))
    return t.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def tokens(docs: DataFrame) -> DataFrame:
    """(id, t): the terms of each document; store it where several searches read the same documents."""
    return docs.select("id", terms("text").alias("t"))


@dataclass
class QueryBlock:
    """Queries as an index from term to queries: `flat[at[j]:at[j + 1]]` are the queries that have term j."""

    qids: pa.Array
    vocabulary: pa.Array
    at: np.ndarray
    flat: np.ndarray

    @classmethod
    def of(cls, got: pa.Table) -> QueryBlock:
        lists = got.column("t").combine_chunks()
        query = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy())
        coded = lists.flatten().dictionary_encode()
        term = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(term, kind="stable")
        return cls(got.column("qid").combine_chunks(), coded.dictionary, np.searchsorted(term[order], np.arange(len(coded.dictionary) + 1)), query[order])

    def postings(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, frequency) of the vocabulary's terms in documents, and the documents' lengths."""
        length = pc.list_value_length(lists).fill_null(0).to_numpy()
        code = pc.index_in(lists.flatten(), value_set=self.vocabulary)
        row = np.repeat(np.arange(len(lists)), length)
        have = code.is_valid().to_numpy(zero_copy_only=False)
        key, n = np.unique(row[have] * np.int64(len(self.vocabulary)) + code.drop_null().to_numpy(), return_counts=True)
        return key // len(self.vocabulary), key % len(self.vocabulary), n, length


def _document_frequencies(index: DataFrame, block, size: int) -> tuple[np.ndarray, int, float]:
    """(documents per term, documents, mean length), counted in one pass; only sums leave the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs, words = np.zeros(size, np.int64), 0, 0
        for b in batches:
            _, term, _, length = block.value.postings(b.column(0))
            total += np.bincount(term, minlength=size)
            docs, words = docs + len(length), words + int(length.sum())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(total[some], [docs, words]))], ["term", "n"])

    got = {r.term: r.n for r in index.select("t").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n_docs, words = got.pop(-1, 0), got.pop(-2, 0)
    df = np.zeros(size, np.int64)
    df[list(got)] = list(got.values())
    return df, n_docs, words / n_docs if n_docs else 0.0


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, keep_self: bool = True, index: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank) by Okapi BM25 over `docs` (id, text) for `queries` (qid, text).

    Each distinct term of a query counts once. Queries are cut into blocks of
    bounded size that go to every task; documents stay where they are, so no
    term is ever a shuffle key, however common it is. A task keeps k rows per
    query; only these are shuffled. Scores above 0 count, rounded to 6 digits;
    ties go to the lower id. Null texts have no terms but count as documents.
    `index` (`tokens` of the same documents) may be given to read it instead.
    """
    spark = docs.sparkSession
    plain_unions(spark)
    index = tokens(spread(docs.select("id", "text"))) if index is None else spread(index)
    id_kind, q_kind = index.schema["id"].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()
    asked = queries.select("qid", terms("text").alias("t")).filter(F.size("t") > 0).groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("t"))
    parts = max(1, -(-(asked.agg(F.sum(F.size("t"))).first()[0] or 0) // QUERY_TERMS))
    out = None
    for p in range(parts):
        got = (asked if parts == 1 else asked.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == p)).toArrow()
        if not len(got):
            continue
        block = QueryBlock.of(got)
        sent = spark.sparkContext.broadcast(block)
        df, n_docs, mean = _document_frequencies(index, sent, len(block.vocabulary))
        idf = np.log((n_docs - df + 0.5) / (df + 0.5) + 1)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, idf=idf, mean=mean) -> Iterator[pa.RecordBatch]:
            q, best = sent.value, None
            asking = np.diff(q.at)
            for batch in batches:
                best = best or Best(k, batch.schema.field(0).type)
                row, term, tf, length = q.postings(batch.column(1))
                weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / (mean or 1)))
                # documents of a bounded number of (query, document) sums at a time
                load = np.cumsum(np.bincount(row, asking[term], len(length)))
                at = 0
                while at < len(length):
                    most = np.searchsorted(load, (load[at - 1] if at else 0) + CELLS, "right")
                    end = min(max(int(most), at + 1), at + max(1, CELLS // max(1, len(q.qids))), len(length))
                    i, j = np.searchsorted(row, (at, end))
                    n = asking[term[i:j]]
                    begin = np.cumsum(n) - n
                    query = q.flat[np.repeat(q.at[term[i:j]] - begin, n) + np.arange(n.sum())]
                    width = end - at
                    s = np.bincount(query * width + np.repeat(row[i:j] - at, n), np.repeat(weight[i:j], n), len(q.qids) * width)
                    s = np.round(s.astype(np.float64).reshape(-1, width), 6)
                    s[s <= 0] = -np.inf
                    ids = batch.column(0).slice(at, width)
                    if not keep_self:
                        same = pc.index_in(ids.cast(q.qids.type), value_set=q.qids)
                        hit = np.flatnonzero(same.is_valid().to_numpy(zero_copy_only=False))
                        s[same.drop_null().to_numpy(), hit] = -np.inf
                    x, y = _best_of(s, k)
                    best.add(x, ids.take(pa.array(y)), s[x, y])
                    at = end
            if best:
                yield from best.rows(q.qids)

        hits = index.select("id", "t").mapInArrow(run, f"qid {q_kind}, id {id_kind}, score double")
        out = hits if out is None else out.unionByName(hits)
    return top_k(spark.createDataFrame([], f"qid {q_kind}, id {id_kind}, score double") if out is None else out, k)
