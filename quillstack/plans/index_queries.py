"""Queries over stored indexes, with their SQL: each builds its index from the driver's tables and searches it for a table of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.operators import evaluate
from quillstack.operators.gram_index import GramIndex
from quillstack.operators.vector_index import VectorIndex
from quillstack.plans import batch
from quillstack.plans.queries import C, PX, SQL, _chunk_vectors, chunks, citations, indexed, papers, query, table, vectors
from quillstack.sources.buckets import BucketTable
from quillstack.sources.shared import cut, place, remove

# ---- queries as rows: words of every benchmark passage, with the vector of the same number


def cases(spark, d, with_vectors: bool = True) -> DataFrame:
    """(case, v, text, vector): three words of each passage; of every fourth one, two variants."""
    words = F.split(F.translate("text", "\n", " "), " ")
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("case"), words.alias("w"), F.explode(F.when(F.col("item_id") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("v"))
    b = b.select("case", "v", F.array_join(F.slice("w", 2 + 3 * F.col("v"), 3), " ").alias("text"))
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("case"), F.col("embedding").cast("array<double>").alias("vector"))
    return cut(b.join(vec, "case", "left") if with_vectors else b.withColumn("vector", F.lit(None).cast("array<double>")), "cases")


_CASES = """cases as (select item_id as case_id, v, array_to_string(list_slice(string_split(replace(text, chr(10), ' '), ' '), 2 + 3 * v, 4 + 3 * v), ' ') as q
from (select *, unnest(case when item_id % 4 = 0 then [0, 1] else [0] end) as v from benchmark)),
terms as (select case_id, v, t, ts[t] as term from (select *, unnest(range(1, len(ts) + 1)) as t from (select case_id, v, list_filter(string_split_regex(q, '[\\s,，;；、|]+'), lambda x: length(x) >= 3) as ts from cases)))"""
# Occurrences may overlap only where a term begins as it ends; else they are counted by what is left without them.
_OCC = """case when own then len(list_filter(range(1, length(low) - length(term) + 2), lambda i: substr(low, i, length(term)) = term)) else (length(low) - length(replace(low, term, ''))) // length(term) end"""
_OWN = "len(list_filter(range(1, length(term)), lambda i: left(lower(term), i) = right(lower(term), i))) > 0"


def _hits(name: str, asked: str, rows: str, text: str) -> str:
    """CTEs {name}h(case_id, v, t, id, d, f), {name}df, {name}n: rows that hold a term, how many, and corpus numbers."""
    return f"""{name}low as (select id, lower({text}) as low, greatest(length({text}) - 2, 0) as d from {rows}),
{name}t as (select case_id, v, t, lower(term) as term, {_OWN} as own from {asked}), {name}h as (select case_id, v, t, id, d, {_OCC} as f from {name}t join {name}low on contains(low, term)),
{name}df as (select case_id, v, t, count(*) as df from {name}h group by case_id, v, t), {name}n as (select count(*) as n, avg(d) as mean from {name}low)"""


def _scored(name: str, where: str = "true") -> str:
    idf = "(case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end)"
    return f"(select h.case_id, h.v, h.id, round(sum({idf} * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean))), 6) as score from {name}h h join {name}df x on x.case_id = h.case_id and x.v = h.v and x.t = h.t, {name}n where {where} group by h.case_id, h.v, h.id)"


def _top(source: str, k: int, by: str = "score", within: str = "case_id, v") -> str:
    return f"(select *, row_number() over (partition by {within} order by {by} desc, id) as rank from {source} qualify row_number() over (partition by {within} order by {by} desc, id) <= {k})"


_SIM = "round(list_dot_product(cast(e.embedding as double[]), w.qv) / (sqrt(list_dot_product(cast(e.embedding as double[]), cast(e.embedding as double[]))) * sqrt(list_dot_product(w.qv, w.qv))), 6)"
_VEC = "qv as (select c.case_id, c.v, cast(embedding as double[]) as qv from cases c join embeddings e on e.vec_id = c.case_id)"
_FUSED = "(select case_id, id, round(sum(1.0 / (60 + rank)), 6) as score from {lists} group by case_id, id)"


# ---- the gram index

_FOUND = f"{_hits("g", "terms", "documents_", "text")}, s as {_scored("g")}, first as {_top('s', 10)}"
_LIKE = "other as (select c.case_id, c.v, l.id, 0.0 as score from cases c join glow l on contains(low, lower(q)) where (c.case_id, c.v) not in (select (case_id, v) from first))"
_FROM_INDEX = f"{_CASES}, documents_ as (select doc_id as id, text from {{rows}}), {_FOUND}, {_LIKE} select case_id, v, id, score, cast(rank as integer) as rank from first union all select case_id, v, id, score, cast(rank as integer) from {_top('other', 10)}"


def _terms_topk(index: GramIndex, spark, d) -> DataFrame:
    return index.topk(cases(spark, d, False), batch.ONE, 10).withColumnRenamed("case", "case_id")


@query("with " + _FROM_INDEX.format(rows="documents"))
def gram_index_terms(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return _terms_topk(GramIndex.build(docs, place(spark, "grams")), spark, d)


@query("with " + _FROM_INDEX.format(rows="documents where doc_id % 7 <> 3"))
def gram_index_changes(spark, d):
    """Stale texts replaced, new rows added, others taken out by a second epoch; then made one and searched."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    stale = docs.filter("id % 3 < 2").withColumn("text", F.when(F.col("id") % 5 == 0, F.concat(F.lit("stale thing "), F.reverse("text"))).otherwise(F.col("text")))
    index = GramIndex.build(stale, place(spark, "grams"))
    index.apply(docs.filter("id % 7 <> 3 and (id % 3 = 2 or id % 5 = 0)"), 1, docs.filter("id % 7 = 3").select("id"))
    one = index.compact(place(spark, "grams"))
    remove(spark, index.path)
    return _terms_topk(one, spark, d)


@query("select b.item_id as case_id, d.doc_id as id from benchmark b join documents d on contains(lower(d.text), lower(b.text))")
def gram_index_passages(spark, d):
    """Every benchmark passage as one phrase: the documents that hold it."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), "text")
    return GramIndex.build(docs, place(spark, "grams")).containing(asked, ["case_id"])


# ---- the vector index


@query(f"""with w as (select vec_id as q, cast(embedding as double[]) as qv from embeddings where vec_id % 100 = 0), s as (select w.q, e.vec_id as id, {_SIM} as sim from embeddings e, w)
select q, id, sim, cast(row_number() over (partition by q order by sim desc, id) as integer) as rank from s qualify row_number() over (partition by q order by sim desc, id) <= 10""")
def vector_index_topk(spark, d):
    v = vectors(spark, d)
    return VectorIndex.build(v, place(spark, "vectors")).topk(v.filter("id % 100 = 0").select(F.col("id").alias("q"), F.col("embedding").alias("vector")), k=10)


@query(f"""with w as (select vec_id as a, cast(embedding as double[]) as qv from embeddings), s as (select w.a, e.vec_id as b, {_SIM} as sim from embeddings e, w where e.vec_id <> w.a)
select a, b, sim from s where sim >= 0.35 qualify row_number() over (partition by a order by sim desc, b) <= 3""")
def similarity_join(spark, d):
    return VectorIndex.build(vectors(spark, d), place(spark, "vectors")).similar(0.35, 3)


# ---- tables by bucket: the rows of the whole-table changes, from touched buckets


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("v"))


@query(SQL["insert_ignore"])
def bucket_insert_ignore(spark, d):
    o = _orders(spark, d)
    t = BucketTable.create(o.filter("id % 2 = 0"), place(spark, "table"), "id")
    t.insert_or_ignore(o.filter("id % 3 = 0").select("id", (F.col("v") + 1).alias("v")), ["id"], ["v"])
    return t.read()


@query(SQL["insert_replace"])
def bucket_insert_replace(spark, d):
    fresh = table(spark, d, "lineitem").filter("l_orderkey % 5 = 0").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("v"), F.struct("l_linenumber", "l_partkey").alias("at"))
    t = BucketTable.create(_orders(spark, d), place(spark, "table"), "id")
    t.insert_or_replace(fresh, ["id"], "at")
    return t.read()


@query(SQL["replace_chunks"])
def bucket_replace_chunks(spark, d):
    fresh = table(spark, d, "documents").filter("doc_id % 4 = 0").select((F.col("doc_id") * 1_000_000).alias("id"), F.col("doc_id").alias("paper_id"), F.lit("new").alias("text"))
    t = BucketTable.create(chunks(spark, d).select("id", "paper_id", "text"), place(spark, "table"), "paper_id")
    t.replace(fresh)
    return t.read()


@query(SQL["update_points"])
def bucket_update_points(spark, d):
    delta = table(spark, d, "labels").selectExpr("doc_id as id", "case when quality = 1 then 'New title' end as title", "case when toxic = 1 then 'New Author' end as authors")
    t = BucketTable.create(papers(spark, d), place(spark, "table"), "id")
    t.update_points(delta)
    return t.read().select("id", "title", "authors")


@query(SQL["replace_citations"])
def bucket_replace_citations(spark, d):
    c = citations(spark, d)
    t = BucketTable.create(c, place(spark, "table"), "paper_id")
    t.replace_citations(c.filter("paper_id < 5").withColumn("cid", F.col("cid") + 1000))
    return t.read().select("cid", "paper_id", "direction")


@query("select vec_id as id, len(embedding) as n from embeddings where vec_id not in (select doc_id from labels) union all select doc_id, 2 from labels where toxic = 0")
def bucket_index_upsert(spark, d):
    delta = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 0, F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")).alias("embedding"))
    t = BucketTable.create(vectors(spark, d), place(spark, "table"), "id")
    t.upsert_index(delta)
    return t.read().select("id", F.size("embedding").cast("long").alias("n"))


@query(SQL["delete_papers"])
def bucket_delete_papers(spark, d):
    t = BucketTable.create(chunks(spark, d).select("id", "paper_id", "text"), place(spark, "table"), "paper_id")
    t.delete(table(spark, d, "labels").select(F.col("doc_id").alias("paper_id")))
    return t.read().select("id")


# ---- searching with all cases


def _batch_sql(with_vectors: bool) -> str:
    near = lambda scale, where: f"(select w.case_id, w.v, e.vec_id * {scale} as id, {_SIM} as sim from embeddings e, qv w where {where})"
    lists = lambda n: f"(select case_id, id, rank from a{n}" + (f" union all select case_id, id, rank from b{n})" if with_vectors else ")")
    vec = lambda n, scale, where: f"near{n} as {near(scale, where)}, b{n} as {_top(f'near{n}', 30, 'sim')}," if with_vectors else ""
    ok = "(case_id % 2 = 1 or {id} in (select id from papers where year >= 2004))"
    inside = "(select * from inside where case_id = h.case_id and id = h.id)"
    return f"""with {PX}, {C}, {_CASES}, {_VEC},
{_hits("p", "(select case_id, v, 0 as t, q as term from cases where length(q) >= 3)", "indexed", "index_text")}, s1 as {_scored("p")}, a1 as {_top("s1", 30)}, {vec(1, 1, "true")}
f1 as {_FUSED.format(lists=lists(1))}, chosen as (select * from {_top("(select * from f1 where " + ok.format(id="id") + ")", 20, within="case_id")}),
inside as (select ch.case_id, c.id, c.paper_id from chosen ch join chunks c on c.paper_id = ch.id),
{_hits("c", "terms", "chunks", "text")}, s2 as {_scored("c", f"exists {inside}")}, t2 as {_top("s2", 30)},
o2 as (select q.case_id, q.v, i.id, 0.0 as score from cases q join inside i on i.case_id = q.case_id join clow l on l.id = i.id and contains(low, lower(q.q)) where (q.case_id, q.v) not in (select (case_id, v) from t2)),
a2 as (select case_id, v, id, rank from t2 union all select case_id, v, id, rank from {_top("o2", 30)}), {vec(2, 1000000, "exists (select 1 from inside i where i.case_id = w.case_id and i.id = e.vec_id * 1000000)")}
f2 as {_FUSED.format(lists=lists(2))}, hits as (select f.case_id, i.paper_id, f.id, f.score from f2 f join inside i on i.case_id = f.case_id and i.id = f.id),
staged as (select case_id, paper_id, arg_min(id, (-score, id)) as chunk_id, round(max(score) * (1 + 0.1 * least(count(*) - 1, 5)), 6) as score, count(*) as matched from hits group by case_id, paper_id),
rest as (select * from cases where case_id not in (select case_id from staged)),
s3 as {_scored("c", "h.case_id in (select case_id from rest)")}, t3 as {_top("s3", 200)},
o3 as (select q.case_id, q.v, l.id, 0.0 as score from rest q join clow l on contains(low, lower(q.q)) where (q.case_id, q.v) not in (select (case_id, v) from t3)),
l3 as (select case_id, v, id, rank from t3 union all select case_id, v, id, rank from {_top("o3", 200)}{f" union all select case_id, v, id, rank + 1000000 from {_top(near(1000000, 'w.case_id in (select case_id from rest)'), 200, 'sim')}" if with_vectors else ""}),
p3 as (select l.case_id, l.v, l.id, row_number() over (partition by l.case_id, l.v, l.rank > 1000000 order by l.rank) as rank from l3 l join chunks c on c.id = l.id where {ok.format(id="c.paper_id")}),
f3 as {_FUSED.format(lists="(select * from p3 where rank <= 30)")}, g3 as (select g.*, c.paper_id from {_top("f3", 20, within="case_id")} g join chunks c on c.id = g.id),
every as (select case_id, paper_id, chunk_id, score, matched from staged qualify row_number() over (partition by case_id order by score desc, paper_id) <= 10
union all select case_id, paper_id, id, score, 1 from g3 qualify row_number() over (partition by case_id, paper_id order by score desc, id) = 1),
results as (select case_id, cast(row_number() over (partition by case_id order by score desc, paper_id) as integer) as rank, paper_id, chunk_id, score, cast(matched as bigint) as matched from every qualify row_number() over (partition by case_id order by score desc, paper_id) <= 5)"""


def batch_results(spark, d, with_vectors: bool) -> DataFrame:
    p, c, q = papers(spark, d), chunks(spark, d), cases(spark, d, with_vectors)
    index = batch.SearchIndex.build(place(spark, "search"), p, c, *((vectors(spark, d), _chunk_vectors(spark, d)) if with_vectors else ()))
    # Even cases share one filter, odd ones have none.
    filters = q.filter("case % 2 = 0").select("case", F.lit(0).alias("filter")).distinct()
    allowed = p.filter("year >= 2004").select(F.lit(0).alias("filter"), "id")
    return batch.search_all(index, q, 5, filters, allowed).withColumnRenamed("case", "case_id")


@query(_batch_sql(True) + " select * from results")
def batch_search(spark, d):
    return batch_results(spark, d, True)


@query(_batch_sql(False) + " select * from results")
def batch_search_lexical(spark, d):
    return batch_results(spark, d, False)


@query(_batch_sql(False) + """, expected as (select b.item_id as case_id, d.doc_id as paper_id from benchmark b join documents d on contains(lower(d.text), lower(b.text))),
judged as (select e.case_id, bool_or(r.rank is not null) as passed, coalesce(1.0 / min(r.rank), 0) as rr from expected e left join results r on r.case_id = e.case_id and r.paper_id = e.paper_id group by e.case_id)
select count(*) as cases, round(avg(cast(passed as integer)), 6) as recall, round(avg(round(rr, 6)), 6) as mrr from judged""")
def batch_recall_mrr(spark, d):
    """The evaluation over real searches: a case passes if a document that holds its passage is among the five found."""
    expected = gram_index_passages(spark, d).select("case_id", F.col("id").alias("paper_id"), F.lit(False).alias("need_all"))
    return evaluate.summary(evaluate.judge(batch_results(spark, d, False).select("case_id", "paper_id", "rank"), expected))
