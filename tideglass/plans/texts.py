"""Queries of retrieval and transcripts over the documents, with the held-out items as stated queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.operators import search as S
from tideglass.operators import transcripts as T
from tideglass.plans.registry import Registry
from tideglass.session import broadcast_if_small, table

R = Registry()
_TOK = "k as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as k from documents), w as (select doc_id, unnest(k) as w from k), tf as (select doc_id, w, count(*) as tf from w group by 1, 2), dl as (select doc_id, len(k) as dl from k), st as (select count(*) as n, avg(dl) as mean from dl), df as (select w, count(*) as df from tf group by 1)"
_ITEM = "qw as (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from eval_item), qf as (select item_id, w, count(*) as qf from qw group by 1, 2)"


def _bm25_sql(b: float, top: int, name: str = "r") -> str:
    return f"""{name}s as (select item_id as query, tf.doc_id as doc, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - {b} + {b} * dl / mean))), 9) as score from qf join tf using (w) join df using (w) join dl on dl.doc_id = tf.doc_id, st group by 1, 2),
    {name} as (select * from (select *, row_number() over (partition by query order by score desc, doc) as rank from {name}s where score > 0) where rank <= {top})"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _bm25(spark: SparkSession, d: str, k: int = 10, b: float = 0.75) -> DataFrame:
    return S.bm25(_docs(spark, d), table(spark, d, "eval_item"), "doc_id", "text", "item_id", "text", k, b=b)


@R.add("with k as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as k from documents) select doc_id, len(k)::int as tokens, len(list_distinct(k))::int as words from k")
def tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", S.tokens(F.col("text")).alias("k")).select("doc_id", F.size("k").alias("tokens"), F.size(F.array_distinct("k")).alias("words"))


@R.add(f"with {_TOK}, {_ITEM}, {_bm25_sql(0.75, 10)} select query, doc, round(score, 6) as score, rank::int as rank from r")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d).withColumn("score", F.round("score", 6))


@R.add(
    f"""with {_TOK}, {_ITEM}, {_bm25_sql(0.75, 50, 'x')}, {_bm25_sql(0.0, 50, 'y')}, u as (select query, doc, rank from x union all select query, doc, rank from y), f as (select query, doc, round(sum(1.0 / (60 + rank)), 12) as score from u group by 1, 2)
    select query, doc, round(score, 9) as score, rank::int as rank from (select *, row_number() over (partition by query order by score desc, doc) as rank from f) where rank <= 10"""
)
def rrf(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of two lexical rankings, with and without length normalisation."""
    return S.fuse([_bm25(spark, d, 50), _bm25(spark, d, 50, 0.0)]).withColumn("score", F.round("score", 9))


@R.add(
    """with q as (select vec_id, embedding from embeddings where vec_id % 20 = 0), s as (select q.vec_id as query, e.vec_id as doc, round(list_dot_product(q.embedding::double[], e.embedding::double[]) / sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]) * list_dot_product(e.embedding::double[], e.embedding::double[])), 9) as score from q, embeddings e)
    select query, doc, round(score, 6) as score, rank::int as rank from (select *, row_number() over (partition by query order by score desc, doc) as rank from s where score > 0) where rank <= 10"""
)
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector against all of them."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return S.cosine(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", "vec_id").withColumn("score", F.round("score", 6))


_REL = "rel as (select item_id as query, doc_id as doc from (select item_id, doc_id, count(*) as n from (select distinct item_id, w from qw) a join tf using (w) group by 1, 2) x join (select item_id, count(distinct w) as m from qw group by 1) y using (item_id) where n >= 0.9 * m)"


def _relevant(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold nine tenths of an item's words: candidates are the best by the plain count of shared words."""
    items = table(spark, d, "eval_item").select(F.col("item_id").alias("query"), F.array_distinct(S.tokens(F.col("text"))).alias("q"))
    docs = _docs(spark, d).select(F.col("doc_id").alias("doc"), F.array_distinct(S.tokens(F.col("text"))).alias("k"))
    words = items.select("query", F.size("q").alias("m"), F.explode("q").alias("w"))
    # a document with nine tenths of the words has one of the rarest tenth plus one: only those are joined
    df = docs.select(F.explode("k").alias("w")).join(broadcast_if_small(words.select("w").distinct()), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    rare = words.join(df, "w", "left").withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.coalesce("n", F.lit(0)), "w"))).where(F.col("r") <= F.floor(F.col("m") * 0.1) + 1)
    # the stated items are a fixed, small table
    pairs = docs.select("doc", F.explode("k").alias("w")).join(broadcast_if_small(rare.select("query", "w")), "w").select("query", "doc").distinct()
    both = pairs.join(broadcast_if_small(items), "query").join(docs, "doc")
    return both.where(F.size(F.array_intersect("q", "k")) >= 0.9 * F.size("q")).select("query", "doc")


@R.add(
    f"""with {_TOK}, {_ITEM}, {_bm25_sql(0.75, 10)}, {_REL}, n as (select query, count(*) as n from rel group by 1), h as (select r.query, count(*) as hits, min(rank) as first, sum(1 / log2(rank + 1)) as dcg from r join rel using (query, doc) group by 1)
    select query, round(coalesce(hits / n, 0), 8) as recall, round(coalesce(hits / 10, 0), 8) as precision, round(coalesce(1 / first, 0), 8) as mrr, round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 8) as ndcg from n left join h using (query)"""
)
def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Lexical ranking held against the documents with nine tenths of an item's words."""
    m = S.ir_metrics(_bm25(spark, d), _relevant(spark, d))
    return m.select("query", *[F.round(c, 8).alias(c) for c in ("recall", "precision", "mrr", "ndcg")])


@R.add()
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """Latent vectors of every document; every twentieth is a query against all."""
    v = S.latent_vectors(_docs(spark, d), "doc_id", "text")
    return S.cosine(v, v.where("doc % 20 = 0"), "doc", "v", "doc").withColumn("score", F.round("score", 5))


_LINES = "l as (select doc_id as doc, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents), f as (select *, starts_with(line, '```') as fence, sum(starts_with(line, '```')::int) over (partition by doc order by pos) % 2 = 1 as fenced from l), h as (select *, not fenced and not fence and regexp_matches(line, '^#{1,6}\\s+\\S') as head from f), c as (select *, sum(head::int) over (partition by doc order by pos) as chunk from h)"


@R.add(f"with {_LINES}, g as (select doc, chunk, max(case when head then regexp_replace(line, '^#{{1,6}}\\s+', '') end) as heading, coalesce(string_agg(line, chr(10) order by pos) filter (where not head), '') as body from c group by 1, 2) select doc, chunk::bigint as chunk, heading, length(body)::int as n_chars from g where length(regexp_replace(body, '\\s', '', 'g')) > 0")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    return S.chunks(_docs(spark, d), "doc_id", "text").select("doc", "chunk", "heading", "n_chars")


@R.add(f"with {_LINES}, g as (select distinct regexp_replace(line, '^#{{1,6}}\\s+', '') as heading, doc from c where head) select heading, count(*) as documents, min(doc) as first from g where len(string_split(trim(heading), ' ')) >= 2 group by 1")
def gold_by_heading(spark: SparkSession, d: str) -> DataFrame:
    """Headings of two words or more with the documents that have them."""
    heads = _docs(spark, d).select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    from pyspark.sql import Window

    fence = F.col("line").startswith("```")
    heads = heads.withColumn("fenced", F.sum(fence.cast("int")).over(Window.partitionBy("doc").orderBy("pos")) % 2 == 1)
    heads = heads.where(~F.col("fenced") & ~fence & F.col("line").rlike(r"^#{1,6}\s+\S")).select("doc", F.regexp_replace("line", r"^#{1,6}\s+", "").alias("heading")).distinct()
    return heads.where(F.size(F.split(F.trim("heading"), " ")) >= 2).groupBy("heading").agg(F.count(F.lit(1)).alias("documents"), F.min("doc").alias("first"))


@R.add("with e as (select doc_id // 1000 as bucket, doc_id, sha256(doc_id::varchar || '|' || coalesce(text, '')) as x from documents) select bucket::bigint as bucket, sha256(string_agg(x, '' order by doc_id)) as digest, count(*) as documents from e group by 1")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return S.digests(_docs(spark, d), "doc_id", "text")


@R.add("select doc_id, n_chars from documents where contains(lower(text), 'monte carlo')")
def substring_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("monte carlo"))).select("doc_id", "n_chars")


_TURNS = "tl as (select doc_id as doc, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as turn from documents where source = 'agent_transcript'), tr as (select *, regexp_extract(line, '^(?:- )?(user|tool|assistant): ', 1) as role from tl), tt as (select * from tr where role <> '')"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return T.turns(table(spark, d, "documents").where("source = 'agent_transcript'").select("doc_id", "text"), "doc_id", "text")


@R.add(
    f"""with {_TURNS}, p as (select doc, role, regexp_replace(unnest(regexp_extract_all(line, '[A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+')), '[.,:;)''"]+$', '') as path from tt), c as (select distinct doc, path from p where role = 'assistant'), e as (select distinct doc, path from p where role = 'tool'),
    s as (select c.doc, count(*) as cited, count(e.path) as supported from c left join e using (doc, path) group by 1), d as (select distinct doc from tt)
    select doc, coalesce(cited, 0)::int as cited, coalesce(supported, 0)::int as supported, round(case when cited is null then 1.0 else supported / cited end, 9) as precision from d left join s using (doc)"""
)
def citation_precision(spark: SparkSession, d: str) -> DataFrame:
    return T.citations(_turns(spark, d)).withColumn("precision", F.round("precision", 9))


@R.add(f"with {_TURNS} select role, count(*) as turns, count(distinct doc) as transcripts from tt group by 1")
def roles_used(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("doc").alias("transcripts"))


@R.add(f"with {_TURNS} select regexp_extract(line, 'tool: ([a-z_]+)\\(', 1) as tool, count(*) as calls from tt where role = 'tool' group by 1")
def tools_called(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).where("role = 'tool'").groupBy(F.regexp_extract("line", r"tool: ([a-z_]+)\(", 1).alias("tool")).agg(F.count(F.lit(1)).alias("calls"))


@R.add("select doc_id, round((contains(lower(text), 'hedge')::int + contains(lower(text), 'candle')::int + contains(lower(text), 'embargo')::int) / 3.0, 9) as recall from documents")
def keyword_recall(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(F.lit("Hedge"), F.lit("candle"), F.lit("EMBARGO"))
    return _docs(spark, d).select("doc_id", F.round(T.keyword_recall(F.col("text"), words), 9).alias("recall"))


_SETS = """w as (select item_id, suite, list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: length(x) > 4), lambda x: lower(regexp_replace(x, '^[.,:;()''"]+|[.,:;()''"]+$', '', 'g'))))) as w from eval_item)"""


@R.add(f"with {_SETS}, p as (select a.item_id, count(b.item_id) as links from w a left join w b on a.item_id <> b.item_id and a.suite <> b.suite and len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.3 group by 1) select item_id, links from p")
def jaccard_links(spark: SparkSession, d: str) -> DataFrame:
    return T.similar_links(table(spark, d, "eval_item"), "item_id", "text", "suite")


@R.add()
def merge_findings(spark: SparkSession, d: str) -> DataFrame:
    return T.merge_findings(table(spark, d, "eval_item"), "category", "item_id", "text", "suite")


_CELLS = "cl as (select source, doc_id, row_number() over (partition by source, doc_id // 50 order by doc_id) - 1 as idx, doc_id // 50 as part, case when doc_id % 5 = 0 then '# ' || coalesce(lang, 'none') when doc_id % 7 = 0 then '  ' else split_part(text, chr(10), 1) end as body, case when doc_id % 5 = 0 then 'markdown' else 'code' end as kind from documents where text is not null and source is not null)"


@R.add(
    f"""with {_CELLS}, hd as (select *, last_value(case when kind = 'markdown' and body like '# %' then substr(body, 3) end ignore nulls) over (partition by source, part order by idx) as heading from cl)
    select source || '-' || part as notebook, idx::int as idx, kind, heading, length(body) as n_chars from hd where trim(body) <> ''"""
)
def notebook_cells(spark: SparkSession, d: str) -> DataFrame:
    """One chunk for each cell of notebooks, with the heading carried on; documents are bound into notebooks of their source."""
    docs = table(spark, d, "documents").where("text is not null and source is not null")
    five, seven = F.col("doc_id") % 5 == 0, F.col("doc_id") % 7 == 0
    body = F.when(five, F.concat(F.lit("# "), F.coalesce("lang", F.lit("none")))).when(seven, F.lit("  ")).otherwise(F.split_part("text", F.lit("\n"), F.lit(1)))
    cell = F.struct("doc_id", F.when(five, "markdown").otherwise("code").alias("cell_type"), F.array(body).alias("source"))
    part = F.floor(F.col("doc_id") / 50)
    books = docs.groupBy(F.concat(F.col("source"), F.lit("-"), part.cast("string")).alias("notebook")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(cell)).alias("cells"))).alias("body"))
    return S.notebook_chunks(books, "notebook", "body").select("notebook", "idx", "kind", "heading", F.length("body").alias("n_chars"))
