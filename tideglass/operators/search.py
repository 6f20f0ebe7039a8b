"""Text retrieval: chunks, lexical ranking, dense vectors, fusion and evaluation.

A stated set of queries is scored against all documents where they lie: the queries are held in memory in blocks, every
task keeps the best k per query, and only those are shuffled. No join of postings grows with common words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = re.compile(r"[a-z0-9]+")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def query_block(queries: DataFrame, query_id: str, text: str, block: int = 5_000) -> Iterator[list[tuple[int, str]]]:
    """The queries in blocks of at most ``block`` rows, one at a time."""
    held: list[tuple[int, str]] = []
    rows = queries.where(F.col(query_id).isNotNull() & F.col(text).isNotNull()).select(F.col(query_id).cast("long").alias("q"), F.col(text).cast("string").alias("t")).distinct()
    for r in rows.toLocalIterator():
        held.append((r["q"], r["t"]))
        if len(held) == block:
            yield sorted(held)
            held = []
    if held:
        yield sorted(held)


def corpus_stats(docs: DataFrame, text: str, vocabulary: list[str]) -> tuple[int, float, dict[str, int]]:
    """Documents, mean length and document frequency of the given words, over all documents."""
    toks = docs.where(F.col(text).isNotNull()).select(tokens(F.col(text)).alias("k"))
    n, mean = toks.agg(F.count(F.lit(1)), F.avg(F.size("k"))).first()
    words = docs.sparkSession.createDataFrame([(w,) for w in vocabulary], "w string") if vocabulary else None
    if words is None or not n:
        return n or 0, mean or 0.0, {}
    seen = toks.select(F.explode(F.array_distinct("k")).alias("w")).join(F.broadcast(words), "w", "left_semi")  # the words of one block of queries
    return n, float(mean), {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}


def best(scored: DataFrame, k: int) -> DataFrame:
    """query, doc, score, rank: the best k per query, ties by document; scores are compared at nine digits."""
    by = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _keep(scores: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the best k of each column, ties by document."""
    rows, cols = [], []
    for j in range(scores.shape[1]):
        live = np.flatnonzero(scores[:, j] > 0)
        if len(live) > k:
            edge = -np.partition(-scores[live, j], k - 1)[k - 1]
            live = live[scores[live, j] >= edge]
            live = live[np.lexsort((docs[live], -scores[live, j]))][:k]
        rows.append(live)
        cols.append(np.full(len(live), j))
    return np.concatenate(rows), np.concatenate(cols)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that what is scored against all queries stays small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str, text: str, query_id: str, query_text: str, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query, doc, score, rank: the best k documents per query with a score above 0; repeated query words count each time."""
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t"))
    out = None
    for block in query_block(queries, query_id, query_text):
        terms = [Counter(TOKEN.findall(t.lower())) for _, t in block]
        vocab = {w: i for i, w in enumerate(sorted({w for c in terms for w in c}))}
        n, mean, df = corpus_stats(docs, text, list(vocab))
        weight = np.zeros((len(vocab), len(block)))
        for j, c in enumerate(terms):
            for w, m in c.items():
                weight[vocab[w], j] = m * np.log(1 + (n - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5))
        held = docs.sparkSession.sparkContext.broadcast((vocab, weight, mean or 1.0, np.array([q for q, _ in block])))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            vocab, weight, mean, ids = held.value
            for batch in slices(batches, max(1, 2_000_000 // max(len(vocab), len(ids), 1))):
                tf = np.zeros((batch.num_rows, len(vocab)))
                for i, t in enumerate(batch["t"].to_pylist()):
                    words = TOKEN.findall(t.lower())
                    for w, m in Counter(words).items():
                        j = vocab.get(w)
                        if j is not None:
                            tf[i, j] = m * (k1 + 1) / (m + k1 * (1 - b + b * len(words) / mean))
                scores = np.round(tf @ weight, 9)
                docs_ = batch["d"].to_numpy()
                r, c = _keep(scores, docs_, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[c]), pa.array(docs_[r]), pa.array(scores[r, c])], names=["query", "doc", "score"])

        got = rows.mapInArrow(run, "query long, doc long, score double")
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "query long, doc long, score double")
    return best(out, k)


def cosine(vectors: DataFrame, queries: DataFrame, doc_id: str, vector: str, query_id: str, k: int = 10, block: int = 20_000) -> DataFrame:
    """query, doc, score, rank: the best k vectors per query by cosine; scores that are not positive fall out after the cut."""
    rows = vectors.where(F.col(doc_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(doc_id).cast("long").alias("d"), F.col(vector).cast("array<double>").alias("v"))
    stated = queries.where(F.col(query_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(query_id).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-stated.count() // block))
    out = None
    for i in range(blocks):
        part = stated.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).orderBy("q")
        pairs = [(r["q"], r["v"]) for r in part.toLocalIterator()]
        held = vectors.sparkSession.sparkContext.broadcast((np.array([q for q, _ in pairs], np.int64), np.array([v for _, v in pairs], float)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, q = held.value
            if not len(ids):
                return
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            for batch in slices(batches, max(1, 4_000_000 // len(ids))):
                flat = batch["v"].flatten().to_numpy(zero_copy_only=False)
                v = flat.reshape(batch.num_rows, -1)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                scores = np.round(v @ q.T, 9)
                docs_ = batch["d"].to_numpy()
                r, c = _keep(scores, docs_, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[c]), pa.array(docs_[r]), pa.array(scores[r, c])], names=["query", "doc", "score"])

        got = rows.mapInArrow(run, "query long, doc long, score double")
        out = got if out is None else out.unionByName(got)
    return best(out, k)


def latent_vectors(docs: DataFrame, doc_id: str, text: str, buckets: int = 256, k: int = 32) -> DataFrame:
    """doc, v: latent vectors of length 1 from hashed, weighted word counts.

    The words' second moments are summed in the tasks (one matrix of buckets x buckets each, added up by row), and the
    leading directions come from that matrix: documents never meet on the driver.
    """
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t"))

    def counts(texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), buckets))
        for i, t in enumerate(texts):
            for w, m in Counter(TOKEN.findall(t.lower())).items():
                x[i, zlib.crc32(w.encode()) % buckets] += m
        return x

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(buckets), 0
        for b in batches:
            x = counts(b["t"].to_pylist())
            total += (x > 0).sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total), pa.array(np.full(buckets, n))], names=["i", "df", "n"])

    seen = rows.mapInArrow(presence, "i long, df double, n long").groupBy("i").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).orderBy("i").collect()
    idf = np.array([np.log((1 + r["n"]) / (1 + r["df"])) + 1 for r in seen]) if seen else np.ones(buckets)

    def weighted(texts: list[str]) -> np.ndarray:
        x = counts(texts) * idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((buckets, buckets))
        for b in batches:
            x = weighted(b["t"].to_pylist())
            g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(buckets), buckets)), pa.array(np.tile(np.arange(buckets), buckets)), pa.array(g.ravel())], names=["i", "j", "g"])

    g = np.zeros((buckets, buckets))
    for r in rows.mapInArrow(moments, "i long, j long, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():  # buckets^2 rows at most
        g[r["i"], r["j"]] = r["g"]
    _, basis = np.linalg.eigh(g)
    basis = basis[:, ::-1][:, : min(k, buckets - 1)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = weighted(b["t"].to_pylist()) @ basis
            y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
            yield pa.RecordBatch.from_arrays([b["d"], pa.array(list(y), pa.list_(pa.float64()))], names=["doc", "v"])

    return rows.mapInArrow(project, "doc long, v array<double>")


def fuse(rankings: list[DataFrame], k: int = 60, top: int = 10) -> DataFrame:
    """query, doc, score, rank by the sum of 1 / (k + rank) over the rankings (query, doc, rank)."""
    legs = [r.select("query", "doc", "rank", F.lit(i).alias("leg")) for i, r in enumerate(rankings)]
    both = legs[0]
    for leg in legs[1:]:
        both = both.unionByName(leg)
    s = both.groupBy("query", "doc").agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 12).alias("score"))
    return best(s, top)


def ir_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """query, recall, precision, mrr, ndcg at k for every query with something relevant."""
    r = relevant.select("query", "doc").distinct()
    n = r.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    hits = ranked.where(F.col("rank") <= k).join(r, ["query", "doc"], "left_semi")
    s = hits.groupBy("query").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k).cast("long")).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    j = n.join(s, "query", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select("query", zero(F.col("hits") / F.col("n")).alias("recall"), zero(F.col("hits") / k).alias("precision"), zero(1 / F.col("first")).alias("mrr"), zero(F.col("dcg") / ideal).alias("ndcg"))


def chunks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, chunk, heading, n_chars, body: sections by heading lines; lines within code fences are no headings.

    The part before the first heading is chunk 0; empty sections are dropped but counted.
    """
    lines = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    by = Window.partitionBy("doc").orderBy("pos")  # the lines of one document
    fence = F.col("line").startswith("```")
    lines = lines.withColumn("fenced", F.sum(fence.cast("int")).over(by) % 2 == 1)
    head = ~F.col("fenced") & ~fence & F.col("line").rlike(r"^#{1,6}\s+\S")
    lines = lines.withColumn("head", head).withColumn("chunk", F.sum(head.cast("int")).over(by))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    got = lines.groupBy("doc", "chunk").agg(F.max(F.when(F.col("head"), F.regexp_replace("line", r"^#{1,6}\s+", ""))).alias("heading"), body.alias("body"))
    return got.where(F.length(F.trim(F.regexp_replace("body", r"\s", ""))) > 0).withColumn("n_chars", F.length("body"))


def notebook_chunks(books: DataFrame, book: str, text: str) -> DataFrame:
    """book, idx, kind, heading, body: the cells of notebooks (JSON with ``cells``) that are not empty, under their place in
    the book and the last heading at or before them. Null and broken books give none."""
    cells = F.from_json(F.get_json_object(text, "$.cells"), "array<struct<cell_type:string,source:array<string>>>")
    c = books.where(F.col(book).isNotNull()).select(F.col(book).alias("book"), F.posexplode(cells).alias("idx", "c"))
    c = c.select("book", "idx", F.col("c.cell_type").alias("kind"), F.array_join("c.source", "").alias("body"))
    mine = F.regexp_extract("body", r"(?m)^#{1,6}\s+(\S.*)$", 1)
    by = Window.partitionBy("book").orderBy("idx")  # the cells of one book
    head = F.last(F.when((F.col("kind") == "markdown") & (mine != ""), mine), ignorenulls=True).over(by)
    return c.withColumn("heading", head).where(F.trim(F.regexp_replace("body", r"\s", "")) != "").select(F.col("book").alias(book), "idx", "kind", "heading", "body")


def digests(docs: DataFrame, doc_id: str, text: str, per: int = 1000) -> DataFrame:
    """bucket, digest: a hash of the hashes of each ``per`` ids in order, so that no group outgrows a task."""
    each = docs.where(F.col(doc_id).isNotNull()).select(F.floor(F.col(doc_id) / per).alias("bucket"), F.col(doc_id).alias("d"), F.sha2(F.concat(F.col(doc_id).cast("string"), F.lit("|"), F.coalesce(text, F.lit(""))), 256).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]), "")
    return each.groupBy("bucket").agg(F.sha2(joined, 256).alias("digest"), F.count(F.lit(1)).alias("documents"))
