"""Every operator as a query over the driver's tables, with its SQL where DuckDB can say the same.

Stand-ins: documents are papers, their windows chunks, embeddings the papers' vectors, parts concept nodes, order
lines links of chunks (orders) to nodes, successive lines edges, benchmark passages cited titles.
"""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions import front
from quillstack.functions import scalars as X
from quillstack.functions import text as T
from quillstack.operators import catalog, evaluate, graph, library, profile, search
from quillstack.operators.vectors import neighbours, similarity_edges, vector_topk
from quillstack.plans import search as plan
from quillstack.sources.shared import cut, spread
from quillstack.streaming.arrivals import event_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_PAPER = [
    "doc_id as id", "substr(text, 1, 80) as title", "concat('Author ', doc_id % 17, '; Writer ', doc_id % 5, '; Reader ', doc_id % 3, '; Checker ', doc_id % 2) as authors",
    "case when doc_id % 10 = 0 then cast(null as int) else cast(2000 + doc_id % 25 as int) end as year", "source as venue", "case when doc_id % 4 = 0 then concat('10.1000/X', doc_id % 50) else '' end as doi",
    "text as abstract", "case when doc_id % 3 = 0 then '' else substr(text, 1, 300) end as summary", "concat(lang, '; ', upper(source), ';  ', source, ' ;', lang, ' tag ', doc_id % 6) as topics",
    "case when doc_id % 7 = 0 then 'note' end as notes",
]
P = f"papers as (select {', '.join(_PAPER)} from documents)"
_IX = "regexp_replace(concat(title, ' / ', authors, ' / ', topics, ' / ', abstract, ' / ', summary), '^[ /]+|[ /]+$', '', 'g')"
PX = f"{P}, indexed as (select *, {_IX} as index_text from papers)"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
C = f"""windows as (select doc_id as paper_id, text, unnest(range(0, case when length(text) = 0 then 0 when length(text) <= 1800 then 1 else cast(ceil(length(text) / 1600.0) as bigint) end)) as i from documents),
cut as (select paper_id, i, trim(substr(text, i * 1600 + 1, case when length(text) <= 1800 then length(text) else 1800 end), {_WS}) as text from windows),
chunks as (select paper_id * 1000000 + i as id, paper_id, cast(i as integer) as ord, concat('Part ', i // 3, ' / Body') as section, cast(i + 1 as integer) as page_start, cast(i + 1 as integer) as page_end, text from cut where text <> '')"""


def papers(spark, d):
    return table(spark, d, "documents").selectExpr(*_PAPER)


def indexed(spark, d):
    return plan.with_index_text(papers(spark, d))


def chunks(spark, d):
    c = library.window_chunks(table(spark, d, "documents"), "doc_id")
    page = (F.col("ord") + 1).cast("int")
    return c.select((F.col("paper_id") * 1_000_000 + F.col("ord")).alias("id"), "paper_id", "ord", F.concat(F.lit("Part "), F.floor(F.col("ord") / 3).cast("string"), F.lit(" / Body")).alias("section"), page.alias("page_start"), page.alias("page_end"), "text")


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def vector_of(spark, d, i=0):
    return list(vectors(spark, d).filter(F.col("id") == i).first()["embedding"])


def bm25_sql(source: str, terms: list[str], text: str = "text", allowed: str = "true") -> str:
    """CTE `scored(id, score)`; terms must not overlap themselves."""
    f = [f"(length(lower({text})) - length(replace(lower({text}), '{t}', ''))) / {len(t)}" for t in terms]
    cols = ", ".join(f"{x} as f{i}" for i, x in enumerate(f))
    n = ", ".join(f"count(*) filter (f{i} > 0) as n{i}" for i in range(len(terms)))
    idf = lambda i: f"(case when ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 then 1e-6 else ln((n - n{i} + 0.5) / (n{i} + 0.5)) end)"
    part = " + ".join(f"(case when f{i} > 0 then {idf(i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * d / mean)) else 0.0 end)" for i in range(len(terms)))
    return f"""counted as (select *, greatest(length({text}) - 2, 0) as d, {cols} from {source}),
corpus as (select count(*) as n, avg(d) as mean, {n} from counted),
scored as (select id, round({part}, 6) as score from counted, corpus where ({" or ".join(f"f{i} > 0" for i in range(len(terms)))}) and {allowed})"""


def cosine_sql(i: int = 0) -> str:
    return f"""q as (select cast(embedding as double[]) as qv from embeddings where vec_id = {i}),
near as (select vec_id as id, round(list_dot_product(cast(embedding as double[]), qv) / (sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) * sqrt(list_dot_product(qv, qv))), 6) as sim from embeddings, q)"""


def top_sql(src: str, by: str, k: int) -> str:
    return f"select id, {by}, cast(row_number() over (order by {by} desc, id) as integer) as rank from {src} order by {by} desc, id limit {k}"


# ---- filters, lookups, reading

@query(f"with {P} select id from papers where year >= 2003 and year <= 2015 and lower(authors) like '%author 1%' and lower(venue) like '%src1%'")
def meta_filter(spark, d):
    return search.meta_filter(papers(spark, d), 2003, 2015, "AUTHOR 1", "Src1")


@query(f"with {P} select id, title from papers where id = 17")
def point_lookup(spark, d):
    return papers(spark, d).filter("id = 17").select("id", "title")


@query(f"with {P} select id from papers where id not in (select vec_id from embeddings)")
def missing_vectors_anti(spark, d):
    return library.missing(papers(spark, d), vectors(spark, d)).select("id")


@query(f"with {P} select id, title, case id when 9 then 0 when 3 then 1 when 150 then 3 else 4 end as pos from papers where id in (9, 3, 150, 4)")
def in_list_ordered(spark, d):
    return search.in_order(papers(spark, d), [9, 3, 10**9, 150, 4, 9]).select("id", "title", "pos")


@query(f"with {C} select id, paper_id from chunks where id in (0, 1000000, 2000000)")
def chunk_paper_map(spark, d):
    return search.in_order(chunks(spark, d), [0, 1000000, 2000000, 5]).select("id", "paper_id")


@query(f"with {P} select id from papers where notes is null")
def work_queue(spark, d):
    return library.work_queue(papers(spark, d), "notes").select("id")


@query(f"with {P} select id from papers where trim(summary) <> ''")
def text_filter(spark, d):
    return library.with_text(papers(spark, d), "summary").select("id")


@query(f"with {P} select id, title, year from papers")
def paper_list(spark, d):
    return papers(spark, d).select("id", "title", "year").orderBy(F.col("year").asc_nulls_first(), "id")


@query(f"with {C} select id, ord, section, text from chunks where paper_id = 0 and lower(section) like '%part 0%'")
def section_read(spark, d):
    return library.read_section(chunks(spark, d), 0, "PART 0").select("id", "ord", "section", "text")


@query(f"with {C} select section, min(page_start) as page_start from chunks where paper_id = 0 group by section order by min(ord) limit 30")
def sections_list(spark, d):
    return library.sections(chunks(spark, d), 0).select("section", "page_start")


@query(f"""with {C}, whole as (select paper_id, string_agg(concat('[', section, ' | p', page_start, ']', chr(10), text), chr(10) || chr(10) order by ord) as w from chunks group by paper_id)
select paper_id, substr(w, 1, 6000) as text, length(w) as total from whole""")
def section_text(spark, d):
    return library.section_text(chunks(spark, d))


@query(f"with {C} select c.id, c.paper_id, p.title from chunks c join (select doc_id as id, substr(text, 1, 80) as title from documents) p on p.id = c.paper_id")
def chunk_hydration(spark, d):
    return chunks(spark, d).join(papers(spark, d).select(F.col("id").alias("paper_id"), "title"), "paper_id").select("id", "paper_id", "title")


# ---- lexical and vector search, fusion

@query(f"with {PX}, {bm25_sql('indexed', ['and the'], 'index_text')} {top_sql('scored', 'score', 30)}")
def lexical_phrase_topk(spark, d):
    return search.phrase_topk(indexed(spark, d), "and the", 30, "id", "index_text", "title")


@query(f"with {C}, {bm25_sql('chunks', ['thing', 'heoron'])} {top_sql('scored', 'score', 30)}")
def lexical_or_topk(spark, d):
    return search.terms_topk(chunks(spark, d), "thing, is heoron;", 30)


@query(f"with {C}, {bm25_sql('chunks', ['thing', 'heoron'])} select id, score from scored")
def bm25_scores(spark, d):
    return search.bm25(chunks(spark, d), ["thing", "heoron"])


@query(f"""with {C}, inside as (select id from chunks where paper_id % 3 = 0), {bm25_sql('chunks', ['thing'], 'text', 'id in (select id from inside)')} {top_sql('scored', 'score', 30)}""")
def lexical_restricted(spark, d):
    c = chunks(spark, d)
    return search.terms_topk(c, "thing", 30, allowed=c.filter("paper_id % 3 = 0").select("id"))


@query(f"""with {C}, hit as (select id, 0.0::double as score from chunks where contains(lower(text), 'é,') order by id limit 30)
select id, score, cast(row_number() over (order by id) as integer) as rank from hit""")
def like_fallback(spark, d):
    return search.terms_topk(chunks(spark, d), "é,", 30)


@query(f"with {cosine_sql()} {top_sql('near', 'sim', 30)}")
def vector_topk_papers(spark, d):
    return vector_topk(vectors(spark, d), vector_of(spark, d), 30)


@query(f"with {cosine_sql()}, few as (select * from near where id % 2 = 1 and id in (select doc_id from documents)) {top_sql('few', 'sim', 30)}")
def vector_topk_restricted(spark, d):
    return vector_topk(vectors(spark, d), vector_of(spark, d), 30, allowed=papers(spark, d).filter("id % 2 = 1").select("id"))


@query(f"""with {P}, {cosine_sql(3)}, pool as (select id, sim from near where id <> 3 order by sim desc, id limit 10)
select p.id, title, year, round(sim, 3) as similarity from pool join papers p on p.id = pool.id order by sim desc, p.id limit 5""")
def semantic_neighbors(spark, d):
    return plan.semantic_neighbors(vectors(spark, d), papers(spark, d), 3, vector_of(spark, d, 3), 5)


_PAIRS = """e as (select vec_id as id, cast(embedding as double[]) as v from embeddings),
u as (select id, v, case when list_dot_product(v, v) = 0 then 1.0 else sqrt(list_dot_product(v, v)) end as n from e),
s as (select a.id as a, b.id as b, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) as sim from u a, u b),
r as (select *, row_number() over (partition by a order by sim desc, b) as rank from s)"""
_EDGES = f"""{_PAIRS},
edges as (select least(a, b) as src, greatest(a, b) as dst, round(max(sim), 3) as weight from r where rank <= 3 and a <> b and sim >= 0.35 group by 1, 2)"""


@query(f"with {_PAIRS} select a, b, sim, cast(rank as integer) as rank from r where rank <= 3")
def nearest_neighbours(spark, d):
    return neighbours(vectors(spark, d), 3)


@query(f"with {_EDGES} select * from edges")
def similarity_graph(spark, d):
    return similarity_edges(vectors(spark, d), threshold=0.35)


_RRF = "select id, round(sum(1.0 / (60 + rank)), 6) as score from lists group by id"


@query(f"with {PX}, {bm25_sql('indexed', ['and the'], 'index_text')}, a as ({top_sql('scored', 'score', 30)}), {cosine_sql()}, b as ({top_sql('near', 'sim', 30)}), lists as (select id, rank from a union all select id, rank from b) {_RRF}")
def rrf_fusion(spark, d):
    return search.rrf([search.phrase_topk(indexed(spark, d), "and the", 30, "id", "index_text"), vector_topk(vectors(spark, d), vector_of(spark, d), 30)])


def _asked(spark, d, text="thing"):
    return [(text, vector_of(spark, d))]


_ALLOWED = "id in (select id from papers where year >= 2004)"
_STAGE1 = f"""{PX}, {bm25_sql('indexed', ['thing'], 'index_text')}, a as ({top_sql('scored', 'score', 30)}), {cosine_sql()}, b as ({top_sql('near', 'sim', 30)}),
lists as (select id, rank from a union all select id, rank from b), fused as ({_RRF}),
chosen as (select * from fused where {_ALLOWED} order by score desc, id limit 20)"""


@query(f"with {_STAGE1} select * from chosen")
def stage1_candidates(spark, d):
    p = indexed(spark, d)
    return plan.candidates(p, vectors(spark, d), _asked(spark, d), p.filter("year >= 2004").select("id"))


@query(f"""with {PX}, ok as (select * from indexed where {_ALLOWED}), {bm25_sql('ok', ['thing'], 'index_text')}, a as ({top_sql('scored', 'score', 30)}), {cosine_sql()},
few as (select * from near where {_ALLOWED}), b as ({top_sql('few', 'sim', 30)}), lists as (select id, rank from a union all select id, rank from b), fused as ({_RRF}) select * from fused order by score desc, id limit 20""")
def stage1_candidates_exact(spark, d):
    p = indexed(spark, d)
    return plan.candidates(p, vectors(spark, d), _asked(spark, d), p.filter("year >= 2004").select("id"), parity=False)


def _chunk_vectors(spark, d):
    return vectors(spark, d).select((F.col("id") * 1_000_000).alias("id"), "embedding")


_STAGE2 = f"""{_STAGE1}, {C}, inside as (select id from chunks where paper_id in (select id from chosen)),
counted2 as (select *, greatest(length(text) - 2, 0) as d, (length(lower(text)) - length(replace(lower(text), 'thing', ''))) / 5 as f0 from chunks),
corpus2 as (select count(*) as n, avg(d) as mean, count(*) filter (f0 > 0) as n0 from counted2),
scored2 as (select id, round((case when ln((n - n0 + 0.5) / (n0 + 0.5)) <= 0 then 1e-6 else ln((n - n0 + 0.5) / (n0 + 0.5)) end) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * d / mean)), 6) as score from counted2, corpus2 where f0 > 0 and id in (select id from inside)),
a2 as ({top_sql('scored2', 'score', 30)}), near2 as (select id * 1000000 as id, sim from near where id * 1000000 in (select id from inside)), b2 as ({top_sql('near2', 'sim', 30)}),
lists2 as (select id, rank from a2 union all select id, rank from b2),
fused2 as (select id, round(sum(1.0 / (60 + rank)), 6) as score from lists2 group by id),
hits as (select paper_id, f.id, score from fused2 f join chunks c on c.id = f.id)"""
_BOOST = "select paper_id, arg_min(id, (-score, id)) as chunk_id, round(max(score) * (1 + 0.1 * least(count(*) - 1, 5)), 6) as score, count(*) as matched from hits group by paper_id"


@query(f"with {_STAGE2}, best as ({_BOOST}) select * from best order by score desc, paper_id limit 10")
def two_stage_search(spark, d):
    p = indexed(spark, d)
    return plan.two_stage(p, chunks(spark, d), vectors(spark, d), _chunk_vectors(spark, d), _asked(spark, d), 5, p.filter("year >= 2004").select("id"))


@query(f"with {C}, {bm25_sql('chunks', ['thing', 'heoron'])}, hits as (select paper_id, s.id, score from scored s join chunks c on c.id = s.id), best as ({_BOOST}) select * from best order by score desc, paper_id limit 12")
def stage2_boost(spark, d):
    c = chunks(spark, d)
    return search.aggregate_papers(search.bm25(c, ["thing", "heoron"]).join(c.select("id", "paper_id"), "id"), 12)


@query(f"""with {C}, {bm25_sql('chunks', ['thing'])}, a as ({top_sql('scored', 'score', 30)}), {cosine_sql()}, nearc as (select id * 1000000 as id, sim from near), b as ({top_sql('nearc', 'sim', 30)}),
lists as (select id, rank from a union all select id, rank from b), fused as ({_RRF}), pool as (select * from fused order by score desc, id limit 20),
own as (select c.paper_id, p.id as chunk_id, p.score, row_number() over (partition by c.paper_id order by p.score desc, p.id) as n from pool p join chunks c on c.id = p.id)
select paper_id, chunk_id, score, 1::bigint as matched from own where n = 1 order by score desc, paper_id limit 5""")
def global_chunk_search(spark, d):
    return plan.global_search(chunks(spark, d), _chunk_vectors(spark, d), _asked(spark, d), 5)


@query(f"with {C}, {bm25_sql('chunks', ['thing'])}, deep as (select * from scored order by score desc, id limit 200), few as (select id, score from deep where id % 2 = 0) {top_sql('few', 'score', 30)}")
def overfetch_filter(spark, d):
    c = chunks(spark, d)
    return search.over_fetch(search.bm25(c, ["thing"]), c.filter("id % 2 = 0").select("id"))


@query(f"""with {P}, {C}, {bm25_sql('chunks', ['heoron'])}, hits as (select paper_id, s.id, score from scored s join chunks c on c.id = s.id), best as ({_BOOST}), top as (select * from best order by score desc, paper_id limit 8)
select t.paper_id, p.title, p.year, substr(p.summary, 1, 500) as summary, p.topics, chunk_id, c.section, concat('p', c.page_start) as pages, round(t.score, 5) as score, matched as matched_chunks, substr(c.text, 1, 400) as snippet
from top t join papers p on p.id = t.paper_id join chunks c on c.id = t.chunk_id""")
def hit_cards(spark, d):
    c = chunks(spark, d)
    return search.hit_cards(search.aggregate_papers(search.bm25(c, ["heoron"]).join(c.select("id", "paper_id"), "id"), 8), papers(spark, d), c)


@query()
def reranked_search(spark, d):
    from quillstack.hooks import overlap_reranker

    c = chunks(spark, d)
    return plan.rerank(plan.global_search(c, None, [("thing heoron", None)], 8), c, "thing heoron", overlap_reranker, 5)


# ---- chunking and metadata

@query(f"with {C} select paper_id, ord, text from chunks")
def chunk_windows(spark, d):
    return library.window_chunks(table(spark, d, "documents"), "doc_id")


def _markdown(spark, d):
    """Pages as Markdown: title and paragraphs of the HTML, under headings and page marks."""
    h = F.regexp_replace("html", "(?s)<(script|style|nav|!--).*?(</\\1>|-->)", "")
    h = F.regexp_replace(h, "<h1>", "\n<!-- page:1 -->\n# ")
    h = F.regexp_replace(h, "<(p|div|article|br)[^>]*>", "\n\n")
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), F.regexp_replace(h, "<[^>]+>", "\n").alias("text"))


@query()
def chunk_markdown(spark, d):
    return T.chunk_documents(_markdown(spark, d))


@query()
def extract_title_authors(spark, d):
    return front.front_matter(_markdown(spark, d))


@query(f"with {P} select id, regexp_replace(lower(title), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]', '', 'g') as norm from papers")
def title_norm(spark, d):
    return papers(spark, d).select("id", X.norm_title("title").alias("norm"))


@query("select conv_id, turn, lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) as name from conversations")
def name_norm(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.norm_name("text").alias("name"))


@query(f"with {PX} select id, index_text from indexed")
def index_text(spark, d):
    return indexed(spark, d).select("id", "index_text")


_TAGGED = "list_transform(string_split(topics, ';'), lambda x: substr(trim(regexp_replace(x, ' +', ' ', 'g')), 1, 48))"
_NORM = f"select id, (select array_to_string(list(t order by pos), '; ') from (select min(pos) as pos, arg_min(t, pos) as t from (select unnest({_TAGGED}) as t, unnest(range(1, 1 + len({_TAGGED}))) as pos) where t <> '' group by lower(t))) as topics from papers"


@query(f"with {P} {_NORM}")
def normalize_topics(spark, d):
    return papers(spark, d).select("id", X.normalize_topics("topics").alias("topics"))


@query(f"with {P} select id, array_to_string(list_filter(list_transform(string_split(authors, ';'), lambda x: trim(x)), lambda x: x <> '')[1:3], '; ') || ' et al.' as authors from papers")
def format_authors(spark, d):
    return papers(spark, d).select("id", X.format_authors("authors").alias("authors"))


_DOI_TEXT = "case doc_id % 5 when 0 then concat('doi: 10.1234/ab-', doc_id, ').', text) when 1 then concat('see arXiv:', 2000 + doc_id % 25, '.', 10000 + doc_id, 'v2 ', text) when 2 then concat('published in ', 1950 + doc_id % 90, ' ', text) else text end"


@query(f"""with t as (select doc_id, {_DOI_TEXT} as t from documents),
m as (select doc_id, regexp_replace(regexp_extract(substr(t, 1, 4000), '10\\.[0-9]{{4,9}}/[^ \\t\\n\\v\\f\\r"''<>\\])]+'), '[.,;)]+$', '') as doi, regexp_extract(t, '(?i)arxiv[: \\t\\n\\r]*([0-9]{{4}}\\.[0-9]{{4,5}})', 1) as arx from t)
select doc_id, case when doi <> '' then doi when arx <> '' then concat('10.48550/arXiv.', arx) else '' end as doi from m""")
def doi_extract(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id", f"{_DOI_TEXT} as t").select("doc_id", X.extract_doi("t").alias("doi"))


@query(f"""with t as (select doc_id, {_DOI_TEXT} as t from documents)
select doc_id, coalesce(2000 + cast(nullif(regexp_extract(t, '(?i)arxiv[: \\t\\n\\r]*([0-9]{{2}})[0-9]{{2}}\\.[0-9]{{4,5}}', 1), '') as integer), cast(nullif(regexp_extract(substr(t, 1, 2000), '\\b((?:19|20)[0-9]{{2}})\\b', 1), '') as integer)) as year from t""")
def year_extract(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id", f"{_DOI_TEXT} as t").select("doc_id", X.extract_year("t").alias("year"))


@query("""select doc_id, case when doc_id % 3 = 0 then concat('doi:10.1/', doc_id) when doc_id % 3 = 1 then concat('arxiv:', doc_id) else concat('th:', substr(sha1(lower(text)), 1, 16)) end as ext_id from documents""")
def external_ids(spark, d):
    return table(spark, d, "documents").selectExpr("*", "case when doc_id % 3 = 0 then concat('10.1/', doc_id) end as doi", "case when doc_id % 3 = 1 then cast(doc_id as string) else '' end as arxiv").select("doc_id", X.external_id("doi", "arxiv", F.lit(None).cast("string"), "text").alias("ext_id"))


@query("select event_id, cast(json_extract(props, '$.k') as integer) as k from events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", X.loose_json(F.concat("props", F.lit(" data: [DONE]")), "k int")["k"].alias("k"))


@query("select page_id, substr(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), 1, 60) as name, concat('openalex:', regexp_extract(url, '[^/]*$')) as work from pages")
def names_of_urls(spark, d):
    return table(spark, d, "pages").select("page_id", X.safe_filename("url").alias("name"), X.work_id(F.lit(""), "url").alias("work"))


@query("""select p_partkey, round(9 + least(sqrt(p_size) * 2.2, 24.0), 6) as cited, round(9 + least(case when p_size = 0 then 1 else p_size end, 60) / 3, 6) as by_chunks, round(1.1 + least(p_size, 28) / 5, 6) as value,
round(6.5 * cbrt((1.1 + least(p_size, 28) / 5) * 0.75 / pi()), 6) as radius, round(8 + least(p_size, 24) * 0.9, 6)::double as flat, case when length(p_name) > 8 then substr(p_name, 1, 7) || '…' else p_name end as label, p_size >= 3 or p_type = 'ECONOMY' as shown,
round(case when p_size % 2 = 0 then 1 + (p_size / 50 - 0.55) * 8 else 1.6 end, 6) as width from part""")
def view_sizes(spark, d):
    n = F.col("p_size")
    kind = F.when(n % 2 == 0, "similar").otherwise("citation")
    r = lambda c: F.round(c, 6)
    return table(spark, d, "part").select("p_partkey", r(X.node_size("citations", n, n)).alias("cited"), r(X.node_size("chunks", n, n)).alias("by_chunks"), r(X.concept_value(n)).alias("value"), r(X.concept_radius(n)).alias("radius"), r(X.concept_radius_flat(n)).alias("flat"), X.short_label(F.col("p_name"), 8).alias("label"), X.label_visible(n, F.col("p_type") == "ECONOMY").alias("shown"), r(X.edge_width(kind, n / 50)).alias("width"))


# ---- profile

@query(f"with {C} select (select count(*) from documents) as papers, (select count(*) from chunks) as chunks, (select count(*) from embeddings) as embedded")
def library_stats(spark, d):
    return profile.library_stats(papers(spark, d), chunks(spark, d), vectors(spark, d))


@query("select l_orderkey as paper_id, count(*) as n_chunks from lineitem group by 1")
def chunk_counts(spark, d):
    return profile.chunk_counts(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "paper_id"))


@query(f"with {P} select min(year) as min_year, max(year) as max_year, count(year) as with_year, count(*) as papers from papers")
def year_span(spark, d):
    return profile.year_span(papers(spark, d))


@query(f"""with {P}, l as (select p.*, quality, toxic from papers p left join labels on labels.doc_id = p.id)
select count(*) filter (coalesce(trim(authors), '') = '') as no_authors, count(*) filter (coalesce(trim(summary), '') = '') as no_summary, count(*) filter (year is null) as no_year, count(*) filter (quality is null) as no_kg, count(*) filter (toxic is null) as no_citations from l""")
def gap_counts(spark, d):
    marks = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("kg_built_at"), F.col("toxic").alias("citations_fetched_at"))
    return profile.gaps(papers(spark, d).join(marks, "id", "left"))


@query(f"""with {P}, {C}, n as (select paper_id, count(*) as n_chunks from chunks group by 1)
select id, title, year, cast(trim(summary) <> '' as integer) as has_summary, coalesce(n_chunks, 0) as n_chunks from papers left join n on n.paper_id = papers.id order by 4 desc, 5 desc, coalesce(year, 0) desc, id limit 8""")
def representatives(spark, d):
    return profile.representatives(papers(spark, d), chunks(spark, d))


@query("select o_orderkey as id, o_orderdate as added_at from orders order by o_orderdate desc, o_orderkey desc limit 5")
def recent(spark, d):
    return profile.recent(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("added_at")))


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@query(f"""with w as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+\\-.]{{2,}}')) as t from documents), s as (select doc_id, regexp_replace(t, '^[.-]+|[.-]+$', '', 'g') as term from w)
select term, count(*) as n_occurrences, count(distinct doc_id) as n_documents from s where length(term) >= 3 and lower(term) not in ({_STOP}) group by term""")
def text_topics_counts(spark, d):
    return profile.topic_counts(table(spark, d, "documents"), "text").select("term", "n_occurrences", "n_documents")


@query()
def text_topics(spark, d):
    return spark.createDataFrame(profile.text_topics(profile.topic_counts(table(spark, d, "documents"), "text")), "term string, n_occurrences long")


@query(f"""with {P}, t as (select id, unnest(list_transform(string_split(topics, ';'), lambda x: trim(x))) as tag, unnest(range(0, len(string_split(topics, ';')))) as pos from papers), f as (select id, tag, row_number() over (partition by id order by pos) as pos from t where tag <> '')
select arg_min(tag, (id, pos)) as tag, count(*) as n from f group by lower(tag) order by n desc, lower(tag) limit 16""")
def user_tags(spark, d):
    return profile.user_tags(papers(spark, d))


@query(f"""with {P}, dl as (select doc_id as id, case when quality = 1 then 'Good; ' || upper('x') when toxic = 0 then '' end as t, case when toxic = 1 then '' when quality = 1 then 'seen' end as n from labels),
m as (select p.id, p.topics as old, p.notes as was, dl.t, dl.n, case when dl.t is null then p.topics else concat(p.topics, ';', dl.t) end as topics from papers p left join dl on dl.id = p.id),
k as ({_NORM.replace('from papers', 'from m').replace('as topics', 'as normal')}),
r as (select m.id, case when t is null then old else normal end as topics, case when n is null then was else n end as notes, old, was from m join k on k.id = m.id)
select id, topics, notes, not (topics is not distinct from old and notes is not distinct from was) as changed from r""")
def annotate_merge(spark, d):
    delta = table(spark, d, "labels").selectExpr("doc_id as id", "case when quality = 1 then 'Good; X' when toxic = 0 then '' end as topics", "case when toxic = 1 then '' when quality = 1 then 'seen' end as notes")
    return library.annotate(papers(spark, d), delta).select("id", "topics", "notes", "changed")


# ---- tables and deltas

@query("""with s as (select doc_id, sha256(text) as sha256 from documents), f as (select *, min(doc_id) over (partition by sha256) as first from s)
select doc_id, sha256, first, case when doc_id <> first or sha256 in (select sha256(text) from documents where doc_id < 20) then 'duplicate' else 'ok' end as status from f where doc_id >= 0""")
def dedup_sha(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    known = docs.filter("doc_id < 20").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return library.dedup_files(docs, known, "text", "doc_id").select("doc_id", "sha256", "first", "status")


@query("""with s as (select doc_id, sha256(text) as h from documents), f as (select doc_id, min(doc_id) over (partition by h) as first from s)
select case when doc_id = first then 'ok' else 'duplicate' end as status, count(*) as n from f group by 1""")
def ingest_status(spark, d):
    from quillstack.plans.ingest import status_counts

    return status_counts(library.dedup_files(table(spark, d, "documents"), None, "text", "doc_id"))


@query("""select o_orderkey as id, o_custkey as v from orders where o_orderkey % 2 = 0 union all
select id, v from (select o_orderkey as id, o_custkey + 1 as v, row_number() over (partition by o_orderkey order by o_custkey + 1) as n from orders where o_orderkey % 3 = 0 and o_orderkey % 2 <> 0) where n = 1""")
def insert_ignore(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("v"))
    return library.insert_or_ignore(o.filter("id % 2 = 0"), o.filter("id % 3 = 0").select("id", (F.col("v") + 1).alias("v")), ["id"], ["v"])


@query("""with f as (select l_orderkey as id, max(l_linenumber) as ln from lineitem group by 1), last as (select l_orderkey as id, l_partkey as v from lineitem join f on f.id = l_orderkey and ln = l_linenumber where l_orderkey % 5 = 0),
one as (select id, max(v) as v from last group by id)
select o_orderkey as id, o_custkey as v from orders where o_orderkey not in (select id from one) union all select id, v from one""")
def insert_replace(spark, d):
    fresh = table(spark, d, "lineitem").filter("l_orderkey % 5 = 0").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("v"), F.struct("l_linenumber", "l_partkey").alias("at"))
    return library.insert_or_replace(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("v")), fresh, ["id"], "at")


@query(f"with {C} select id, paper_id, text from chunks where paper_id % 4 <> 0 union all select doc_id * 1000000 as id, doc_id as paper_id, 'new' as text from documents where doc_id % 4 = 0")
def replace_chunks(spark, d):
    fresh = table(spark, d, "documents").filter("doc_id % 4 = 0").select((F.col("doc_id") * 1_000_000).alias("id"), F.col("doc_id").alias("paper_id"), F.lit("new").alias("text"))
    return library.replace_rows(chunks(spark, d).select("id", "paper_id", "text"), fresh, "paper_id")


@query(f"with {C} select id from chunks where paper_id not in (select doc_id from labels)")
def delete_papers(spark, d):
    return library.delete_papers(chunks(spark, d), table(spark, d, "labels").select(F.col("doc_id").alias("id"))).select("id")


@query(f"""with {P} select p.id, coalesce(case when quality = 1 then substr('New title', 1, 200) end, title) as title, coalesce(case when toxic = 1 then 'New Author' end, authors) as authors from papers p left join labels on labels.doc_id = p.id""")
def update_points(spark, d):
    delta = table(spark, d, "labels").selectExpr("doc_id as id", "case when quality = 1 then 'New title' end as title", "case when toxic = 1 then 'New Author' end as authors")
    return library.update_points(papers(spark, d), delta).select("id", "title", "authors")


@query(f"""with {P}, j as (select p.*, l.doc_id as lid, quality from papers p left join labels l on l.doc_id = p.id)
select id, coalesce(year, case when lid is not null then cast(1990 + quality as integer) end) as year, case when trim(summary) = '' and lid is not null then 'made up' else summary end as summary,
case when lid is not null and (year is null or trim(summary) = '') then 'updated' else 'skip' end as status from j""")
def enrich(spark, d):
    found = table(spark, d, "labels").selectExpr("doc_id as id", "'Someone' as authors", "cast(1990 + quality as int) as year", "'made up' as summary")
    return library.enrich(papers(spark, d), found).select("id", "year", "summary", "status")


@query(f"""with {P}, f as (select doc_id as id, substr(text, 1, 70 + 30 * toxic) as title, '' as authors from documents join labels using (doc_id))
select p.id, case when f.id is not null and trim(f.title) <> '' and (length(f.title) > length(p.title) + 4 or trim(p.title) = '') then f.title else p.title end as title,
case when f.id is null then 'no_markdown' when trim(f.title) <> '' and (length(f.title) > length(p.title) + 4 or trim(p.title) = '') then 'updated' else 'skip' end as status from papers p left join f on f.id = p.id""")
def refresh_metadata(spark, d):
    found = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").selectExpr("doc_id as id", "substr(text, 1, 70 + 30 * toxic) as title", "'' as authors")
    return library.refresh_metadata(papers(spark, d), found).select("id", "title", "status")


# ---- concept graph

N = "kg_nodes as (select p_partkey as id, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as name, p_name as display, p_type as type, p_brand as \"desc\" from part)"
E = "kg_edges as (select distinct a.l_partkey as src, b.l_partkey as dst, a.l_returnflag as relation from lineitem a join lineitem b on b.l_orderkey = a.l_orderkey and b.l_linenumber = a.l_linenumber + 1 where a.l_partkey <> b.l_partkey)"
L = "links as (select distinct l_orderkey as chunk_id, l_partkey as id from lineitem), kg_chunks as (select o_orderkey as id, o_custkey as paper_id from orders where o_orderkey % 7 <> 0)"


def kg(spark, d) -> SimpleNamespace:
    part, line, orders = (table(spark, d, t) for t in ("part", "lineitem", "orders"))
    nodes = part.select(F.col("p_partkey").alias("id"), X.norm_title("p_name").alias("name"), F.col("p_name").alias("display"), F.col("p_type").alias("type"), F.col("p_brand").alias("desc"))
    a = line.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"), F.col("l_returnflag").alias("relation"))
    b = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    edges = a.join(b, ["l_orderkey", "l_linenumber"]).filter("src <> dst").select("src", "dst", "relation").distinct()
    links = spread(line.select(F.col("l_orderkey").alias("chunk_id"), "l_partkey"), "chunk_id").groupBy("chunk_id").agg(F.collect_set("l_partkey").alias("node_ids"))
    return SimpleNamespace(kg_nodes=nodes, kg_edges=edges, kg_chunk_links=links, chunks=orders.filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("paper_id")))


_COUNTS = f"{L}, counts as (select links.id, count(*) as n_chunks, count(distinct paper_id) as n_papers from links left join kg_chunks on kg_chunks.id = links.chunk_id group by 1)"


@query(f"with {L} select links.id, count(*) as n_chunks, count(distinct paper_id) as n_papers, coalesce(array_to_string(list_sort(list(distinct paper_id) filter (paper_id is not null)), ','), '') as paper_ids from links left join kg_chunks on kg_chunks.id = links.chunk_id group by 1")
def kg_entity_counts(spark, d):
    g = kg(spark, d)
    return graph.entity_counts(g.kg_chunk_links, g.chunks).withColumn("paper_ids", F.array_join(F.col("paper_ids").cast("array<string>"), ","))


@query(f"""with {N}, {_COUNTS}, top as (select * from counts order by n_chunks desc, id limit 48)
select display as name, type, n_chunks, n_papers from top join kg_nodes on kg_nodes.id = top.id where n_papers > 0 order by n_papers desc, n_chunks desc, display limit 16""")
def concept_topics(spark, d):
    g = kg(spark, d)
    return graph.concept_topics(g.kg_chunk_links, g.chunks, g.kg_nodes).select("name", "type", "n_chunks", "n_papers")


@query(f"""with {N}, {E}, n as (select dst as id, relation, '->' as direction from kg_edges where src = 5 union all select src, relation, '<-' from kg_edges where dst = 5)
select n.id, display as name, type, relation, direction from n join kg_nodes on kg_nodes.id = n.id""")
def entity_neighbors(spark, d):
    g = kg(spark, d)
    return graph.entity_neighbors(g.kg_edges, g.kg_nodes, 5).select("id", "name", "type", "relation", "direction")


@query(f"with {E} select * from kg_edges where src < 100 and dst < 100")
def induced_subgraph(spark, d):
    g = kg(spark, d)
    return graph.induced(g.kg_edges, g.kg_nodes.filter("id < 100")).select("src", "dst", "relation")


_SEED = f"{N}, seed as (select id, 1.0::double as score from kg_nodes where length(name) >= 3 and contains('tellmeaboutredwidgets', name))"
_GROWN = f"""{_SEED}, {E}, around as (select src, dst from kg_edges union all select dst, src from kg_edges),
grown as (select * from seed union all select dst as id, round(0.6 * max(score), 6) as score from around join seed on seed.id = around.src where dst not in (select id from seed) group by dst)"""


@query(f"with {_SEED} select * from seed")
def graph_seed(spark, d):
    return graph.seeds(kg(spark, d).kg_nodes, "Tell me about: red widgets")


@query(f"""with {N}, {cosine_sql(1)}, named as (select id, 1.0::double as score from kg_nodes where length(name) >= 3 and contains('nothingknown', name)),
close as (select id, sim as score from near where sim >= 0.42 order by sim desc, id limit 8), every as (select * from named union all select * from close where (select count(*) from named) < 8) select id, max(score) as score from every group by id""")
def graph_seed_vectors(spark, d):
    near = vector_topk(vectors(spark, d), vector_of(spark, d, 1), 8).select("id", "sim")
    return graph.seeds(kg(spark, d).kg_nodes, "nothing known", near)


@query(f"with {_GROWN} select * from grown")
def graph_expand(spark, d):
    g = kg(spark, d)
    return graph.expand(graph.seeds(g.kg_nodes, "Tell me about: red widgets"), g.kg_edges)


@query()
def graph_expand_in_order(spark, d):
    g = kg(spark, d)
    return graph.expand_in_order(graph.seeds(g.kg_nodes, "red widget"), g.kg_edges.withColumn("ord", F.struct("src", "dst", "relation")).withColumn("ord", F.xxhash64("ord")))


_EVIDENCE = f"""{_GROWN}, {L}, per as (select chunk_id, round(sum(score), 6) as score from links join grown on grown.id = links.id group by 1),
own as (select per.chunk_id, paper_id, score, row_number() over (partition by paper_id order by score desc, chunk_id) as n from per join kg_chunks on kg_chunks.id = per.chunk_id)"""


@query(f"with {_EVIDENCE} select paper_id, chunk_id, score from own where n = 1 order by score desc, paper_id limit 10")
def graph_evidence(spark, d):
    g = kg(spark, d)
    return graph.evidence(graph.expand(graph.seeds(g.kg_nodes, "Tell me about: red widgets"), g.kg_edges), g.kg_chunk_links, g.chunks, 10)


@query(f"with {_GROWN}, top as (select * from grown order by score desc, id limit 12) select top.id, display as name, type, score from top join kg_nodes on kg_nodes.id = top.id")
def graph_search_entities(spark, d):
    from quillstack.plans.graphs import graph_search

    return graph_search(kg(spark, d), "Tell me about: red widgets")[0]


@query(f"with {_GROWN}, top as (select * from grown order by score desc, id limit 12) select * from kg_edges where src in (select id from top) and dst in (select id from top)")
def graph_search_edges(spark, d):
    from quillstack.plans.graphs import graph_search

    return graph_search(kg(spark, d), "Tell me about: red widgets")[1].select("src", "dst", "relation")


@query("""with n as (select regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as name, p_partkey, p_name, p_type, p_brand from part), o as (select name, min(p_partkey) as k from n where length(name) >= 2 group by name)
select row_number() over (order by k) as id, o.name, p_name as display, p_type as type, p_brand as "desc" from o join n on n.p_partkey = o.k""")
def kg_nodes_dedup(spark, d):
    return graph.dedup_nodes(table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("desc")))


_RAW_EDGES = "(l_partkey % 20) as src, (l_suppkey % 10) as dst, l_returnflag as relation, l_orderkey as paper_id, l_linenumber as chunk_id"


@query(f"""with r as (select {_RAW_EDGES} from lineitem), n as (select *, row_number() over (partition by src, dst, relation order by paper_id, chunk_id) as n from r) select src, dst, relation, paper_id, chunk_id from n where n = 1""")
def kg_edges_dedup(spark, d):
    raw = table(spark, d, "lineitem").selectExpr(*_RAW_EDGES.split(", ")).withColumn("ord", F.struct("paper_id", "chunk_id"))
    return graph.dedup_edges(raw).select("src", "dst", "relation", "paper_id", "chunk_id")


@query(f"with {E}, ends as (select src as id from kg_edges union all select dst from kg_edges), n as (select id, count(*) as degree from ends group by 1) select p_partkey as id, coalesce(degree, 0) as degree from part left join n on n.id = p_partkey")
def degree(spark, d):
    g = kg(spark, d)
    return graph.degree(g.kg_nodes, g.kg_edges)


@query(f"with {E}, b as (select src, dst from kg_edges union select dst, src from kg_edges union select src, src from kg_edges union select dst, dst from kg_edges) select src as id, array_to_string(list_sort(list(dst)), ',') as around from b group by src")
def adjacency(spark, d):
    return graph.adjacency(kg(spark, d).kg_edges).select("id", F.array_join(F.col("around").cast("array<string>"), ",").alias("around"))


@query(f"""with {N}, {_COUNTS}, sub as (select n.id, type, coalesce(n_chunks, 0) as n_chunks, cast(n.id % 4 as bigint) as degree from kg_nodes n left join counts c on c.id = n.id)
select id from sub where type in ('ECONOMY', 'STANDARD') and not (n_chunks < 2 and degree <= 1)""")
def node_visibility(spark, d):
    g = kg(spark, d)
    nodes = g.kg_nodes.join(graph.entity_counts(g.kg_chunk_links, g.chunks), "id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    return graph.visible_concepts(nodes, nodes.select("id", (F.col("id") % 4).alias("degree")), ["ECONOMY", "STANDARD"]).select("id")


@query(f"with {N} select id, display from kg_nodes where contains(lower(name), 'ring') or contains(lower(\"desc\"), 'ring') or lower(type) = 'ring' order by id limit 8")
def concept_search(spark, d):
    return graph.concept_search(kg(spark, d).kg_nodes, " Ring").select("id", "display")


@query(f"with {L} select distinct paper_id from links join kg_chunks on kg_chunks.id = links.chunk_id where paper_id is not null")
def paper_options(spark, d):
    g = kg(spark, d)
    n = graph.entity_counts(g.kg_chunk_links, g.chunks)
    return n.select(F.explode("paper_ids").alias("paper_id")).distinct().orderBy("paper_id")


# ---- citations and the library graph

CIT = """cit as (select item_id as cid, item_id % 20 as paper_id, case when item_id % 2 = 0 then 'refs' else 'cited' end as direction, case when item_id % 5 = 0 then concat('doi:10.1000/x', item_id % 50) else '' end as ext_id,
case when item_id % 3 = 0 then (select substr(text, 1, 80) from documents where doc_id = item_id) when item_id % 3 = 1 then (select substr(text, 1, 40) from documents where doc_id = item_id * 2) else substr(text, 1, 60) end as title from benchmark)"""
RES = f"""{P}, {CIT}, pn as (select id, lower(trim(doi)) as doi, regexp_replace(lower(title), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]', '', 'g') as t from papers),
cn as (select *, regexp_replace(lower(trim(ext_id)), '^doi:', '') as doi, regexp_replace(lower(title), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]', '', 'g') as t from cit),
m as (select cid, id, case when c.doi <> '' and c.doi = p.doi then 1 when c.t <> '' and c.t = p.t then 2 else 3 end as tier from cn c join pn p on (c.doi <> '' and c.doi = p.doi) or (c.t <> '' and c.t = p.t)
  or (length(c.t) >= 12 and length(p.t) >= 12 and (contains(p.t, c.t) or contains(c.t, p.t)))),
f as (select *, row_number() over (partition by cid order by tier, id) as n from m), resolved as (select cit.cid, paper_id, direction, id as target, tier from cit join f on f.cid = cit.cid and n = 1)"""


def citations(spark, d):
    b = table(spark, d, "benchmark")
    t = table(spark, d, "documents").select("doc_id", "text")
    c = b.selectExpr("item_id as cid", "item_id % 20 as paper_id", "case when item_id % 2 = 0 then 'refs' else 'cited' end as direction", "case when item_id % 5 = 0 then concat('doi:10.1000/x', item_id % 50) else '' end as ext_id", "substr(text, 1, 60) as own", "case item_id % 3 when 0 then item_id when 1 then item_id * 2 end as of")
    j = c.join(t, c.of == t.doc_id, "left")
    return j.selectExpr("cid", "paper_id", "direction", "ext_id", "case cid % 3 when 0 then substr(text, 1, 80) when 1 then substr(text, 1, 40) else own end as title")


def resolved(spark, d):
    return graph.resolve_citations(citations(spark, d), papers(spark, d))


@query(f"with {RES} select * from resolved")
def citation_resolve(spark, d):
    return resolved(spark, d).select("cid", "paper_id", "direction", "target", "tier")


_CE = f"{RES}, cited as (select distinct case when direction = 'refs' then paper_id else target end as src, case when direction = 'refs' then target else paper_id end as dst from resolved where paper_id <> target)"


@query(f"with {_CE} select * from cited")
def citation_edges(spark, d):
    return graph.citation_edges(resolved(spark, d))


@query(f"with {RES} select case when direction = 'refs' then 'cites' else 'cited_by' end as relation, target as id from resolved where paper_id = 10 and target <> 10")
def library_neighbors(spark, d):
    return graph.library_neighbors(resolved(spark, d), 10)


@query(f"with {CIT} select direction, count(*) as n from cit where paper_id = 5 group by 1")
def citation_counts(spark, d):
    return profile.citation_counts(citations(spark, d), 5)


@query(f"""with {CIT}, fresh as (select cid + 1000 as cid, paper_id, direction, ext_id, title from cit where paper_id < 5), one as (select *, row_number() over (partition by paper_id, direction, ext_id order by cid) as n from fresh)
select cid, paper_id, direction from cit where paper_id >= 5 union all select cid, paper_id, direction from one where n = 1""")
def replace_citations(spark, d):
    c = citations(spark, d)
    return graph.replace_citations(c, c.filter("paper_id < 5").withColumn("cid", F.col("cid") + 1000)).select("cid", "paper_id", "direction")


_REACH = f"""with recursive {_EDGES}, both_ as (select src, dst from edges union select dst, src from edges),
reach(a, b) as (select src, src from both_ union select r.a, b.dst from reach r join both_ b on b.src = r.b),
comp as (select a as node, min(b) as component from reach group by a)"""


@query(f"{_REACH} select * from comp")
def connected_components(spark, d):
    e = similarity_edges(vectors(spark, d), threshold=0.35)
    return graph.components(e.select(F.col("src").alias("a"), F.col("dst").alias("b"))).select("node", "component")


_CL = f"""{_REACH.replace("both_ as (select src, dst from edges union select dst, src from edges)", "own as (select src, dst from edges where src in (select doc_id from documents) and dst in (select doc_id from documents)), both_ as (select src, dst from own union select dst, src from own)")}, {P}, n as (select p.id, year, coalesce(component, p.id) as component from papers p left join comp on comp.node = p.id),
ranked as (select *, row_number() over (order by year nulls first, id) as place from n), firsts as (select component, min(place) as f from ranked group by 1), num as (select component, row_number() over (order by f) - 1 as cluster from firsts),
clustered as (select n.id, n.year, cluster from n join num on num.component = n.component)"""


def _clusters(spark, d):
    p = papers(spark, d)
    return graph.clusters(p, graph.induced(similarity_edges(vectors(spark, d), threshold=0.35), p).select("src", "dst"))


@query(f"{_CL} select id, cluster from clustered")
def clusters(spark, d):
    return _clusters(spark, d)


@query(f"{_CL} select cluster, count(*) as n from clustered group by 1")
def cluster_sizes(spark, d):
    return profile.cluster_sizes(_clusters(spark, d))


@query(f"""{_CL}, y as (select id, cluster, coalesce(year, 2024) as yr from clustered), sp as (select min(yr) as lo, greatest(max(yr) - min(yr), 2) as span from y), lanes as (select cluster, row_number() over (order by min(yr), cluster) - 1 as lane from y group by 1),
z as (select y.*, lane, row_number() over (partition by lane order by yr, id) - 1 as k, row_number() over (partition by lane, yr order by id) - 1 as i from y join lanes on lanes.cluster = y.cluster)
select id, cluster, round((yr - lo) * 240.0 / span + 26 * i, 6)::double as x, cast(-110 * lane - 16 * k as bigint) as y from z, sp""")
def timeline_layout(spark, d):
    return graph.timeline_layout(papers(spark, d).join(_clusters(spark, d), "id"))


@query(f"with {P} select id from papers where coalesce(year, 0) >= 2005 and coalesce(year, 9999) <= 2020 and contains(lower(authors), 'writer 2') and contains(lower(venue), 'src')")
def visible_papers(spark, d):
    return graph.visible_papers(papers(spark, d), None, 2005, 2020, "Writer 2", "SRC").select("id")


@query(f"with {_EDGES} select src, dst, weight from edges where src % 3 <> 0 and dst % 3 <> 0 and src in (select doc_id from documents) and dst in (select doc_id from documents)")
def edge_visibility(spark, d):
    return graph.induced(similarity_edges(vectors(spark, d), threshold=0.35), papers(spark, d).filter("id % 3 <> 0")).select("src", "dst", "weight")


@query(f"with {P} select distinct year from papers where year is not null")
def year_options(spark, d):
    return papers(spark, d).select("year").filter("year is not null").distinct().orderBy("year")


@query()
def library_graph_nodes(spark, d):
    from quillstack.plans.graphs import library_graph

    p = papers(spark, d).withColumns({"cited_by_count": F.lit(None).cast("int"), "citations_fetched_at": F.lit(None).cast("timestamp")})
    return library_graph(SimpleNamespace(papers=p, chunks=chunks(spark, d), citations=citations(spark, d), paper_vectors=vectors(spark, d)), 0.35)[0]


# ---- external catalog

@query("select user_id as \"itemID\", min(case when event_type = 'view' then props end) as view, min(case when event_type = 'click' then props end) as click, min(case when event_type = 'error' then props end) as error from events where event_type in ('view', 'click', 'error') group by 1")
def eav_pivot(spark, d):
    e = table(spark, d, "events")
    data = e.select(F.col("user_id").alias("itemID"), F.col("event_type").alias("fieldID"), F.col("event_id").alias("valueID"))
    fields = e.select(F.col("event_type").alias("fieldID"), F.col("event_type").alias("fieldName")).distinct()
    return catalog.pivot_fields(data, fields, e.select(F.col("event_id").alias("valueID"), F.col("props").alias("value")), ["view", "click", "error"])


@query("""with hit as (select o_orderkey as id, case when contains(lower(o_orderpriority), 'urgent') then 0 else 2 end as bucket from orders where contains(lower(o_orderpriority), 'urgent') or contains(lower(o_orderstatus), 'urgent')
union all select o_orderkey, 1 from orders join customer on c_custkey = o_custkey where contains(lower(c_mktsegment), 'urgent') union all select o_orderkey, 2 from orders where concat('k', o_orderkey) = 'urgent'),
b as (select id, min(bucket) as bucket from hit group by 1) select id as "itemID", bucket from b where id % 10 <> 0 order by bucket, id limit 20""")
def catalog_search(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    items = o.select(F.col("o_orderkey").alias("itemID"), F.concat(F.lit("K"), F.col("o_orderkey").cast("string")).alias("key"))
    data = o.selectExpr("o_orderkey as itemID", "stack(2, 'title', o_orderpriority, 'date', o_orderstatus) as (fieldName, value)")
    people = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("itemID"), F.col("c_mktsegment").alias("name"))
    return catalog.keyword_search(items, data, people, items.filter("itemID % 10 = 0"), "Urgent")


@query("select l_orderkey as \"itemID\", string_agg(concat(l_returnflag, ' ', l_linestatus), '; ' order by l_linenumber, concat(l_returnflag, ' ', l_linestatus)) as creators from lineitem group by 1")
def catalog_creators(spark, d):
    line = table(spark, d, "lineitem")
    own = line.select(F.col("l_orderkey").alias("itemID"), F.col("l_linenumber").alias("orderIndex"), F.concat("l_returnflag", "l_linestatus").alias("creatorID"))
    people = line.select(F.concat("l_returnflag", "l_linestatus").alias("creatorID"), F.col("l_returnflag").alias("firstName"), F.col("l_linestatus").alias("lastName")).distinct()
    return catalog.creators(own, people)


@query("select c_custkey as \"itemID\", c_name as key from customer where c_custkey = 7")
def catalog_lookup(spark, d):
    items = table(spark, d, "customer").select(F.col("c_custkey").alias("itemID"), F.col("c_name").alias("key"))
    return catalog.lookup(items, items.filter("itemID = 8"), "7")


@query("select count(*) as n from customer where c_custkey % 10 <> 0 and c_nationkey < 20")
def catalog_count(spark, d):
    items = table(spark, d, "customer").select(F.col("c_custkey").alias("itemID"), F.col("c_nationkey").alias("itemTypeID"))
    return catalog.item_count(items, table(spark, d, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("itemTypeID")), items.filter("itemID % 10 = 0"))


@query("""select c_custkey as "itemID", c_name as key, case when c_custkey % 4 = 0 then '(untitled)' else c_mktsegment end as title, cast(case when c_custkey % 3 = 0 then 1990 + c_nationkey else 2010 end as integer) as year, case when c_custkey % 2 = 0 then 'Journal' else 'Proc' end as publication, case when c_custkey % 5 = 0 then '' else c_name end as creators from customer""")
def catalog_rows(spark, d):
    c = table(spark, d, "customer")
    items = c.select(F.col("c_custkey").alias("itemID"), F.col("c_name").alias("key"))
    data = c.selectExpr("c_custkey as itemID", "case when c_custkey % 4 = 0 then ' ' else c_mktsegment end as title", "case when c_custkey % 3 = 0 then concat('May ', 1990 + c_nationkey) end as date", "'2010' as year", "case when c_custkey % 2 = 0 then 'Journal' end as publicationTitle", "'Proc' as proceedingsTitle")
    return catalog.assemble(items, data, c.filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("itemID"), F.col("c_name").alias("creators")))


@query("""select o_custkey as "parentItemID", o_orderkey as "itemID", o_orderstatus as "contentType", case when o_orderkey % 3 = 0 then concat('/store/K', o_orderkey, '/f.pdf') when o_orderkey % 3 = 1 then 'g.pdf' else '/abs/h.pdf' end as path from orders where o_orderkey % 11 <> 0""")
def catalog_attachments(spark, d):
    o = table(spark, d, "orders")
    items = o.selectExpr("o_orderkey as itemID", "concat('K', o_orderkey) as key")
    rows = o.selectExpr("o_custkey as parentItemID", "o_orderkey as itemID", "o_orderstatus as contentType", "case o_orderkey % 3 when 0 then 'storage:f.pdf' when 1 then 'attachments:g.pdf' else '/abs/h.pdf' end as path")
    return catalog.attachments(rows, items, items.filter("itemID % 11 = 0"), "/store/")


# ---- evaluation

_HITS = "hits as (select b.item_id as case_id, d.doc_id as paper_id, row_number() over (partition by b.item_id order by d.doc_id) as rank from benchmark b join documents d on contains(d.text, substr(b.text, 1, 40)))"
_EXP = "expected as (select item_id as case_id, item_id % 3 = 0 as need_all, d.doc_id as paper_id from benchmark b join documents d on contains(d.text, b.text))"
_JUDGED = f"""{_HITS}, {_EXP}, r as (select e.*, rank from expected e left join (select * from hits where rank <= 5) h on h.case_id = e.case_id and h.paper_id = e.paper_id),
judged as (select case_id, case when bool_or(need_all) then bool_and(rank is not null) else bool_or(rank is not null) end as passed, min(rank) as best_rank, round(coalesce(1.0 / min(rank), 0), 6)::double as rr from r group by 1)"""


def _passages(spark, d, n):
    """(case_id, paper_id, whole): documents that hold the first n characters of a benchmark passage, and whether they hold all of it.
    The cases are few and fixed, so each document is tested against all of them in one scan."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("passage"), F.substring("text", 1, n).alias("needle"))
    held = b.join(table(spark, d, "documents").select("doc_id", "text"), F.contains("text", "needle"))
    return held.select("case_id", F.col("doc_id").alias("paper_id"), F.contains("text", "passage").alias("whole"))


def judged(spark, d):
    from pyspark.sql import Window

    held = cut(_passages(spark, d, 40), "passages")
    ranked = held.select("case_id", "paper_id").withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("paper_id")))
    return evaluate.judge(ranked, held.filter("whole").select("case_id", "paper_id", (F.col("case_id") % 3 == 0).alias("need_all")))


@query(f"with {_JUDGED} select case_id, passed, cast(best_rank as integer) as best_rank, rr from judged")
def eval_cases(spark, d):
    return judged(spark, d)


@query(f"with {_JUDGED} select count(*) as cases, round(avg(cast(passed as integer)), 6) as recall, round(avg(rr), 6) as mrr from judged")
def eval_recall_mrr(spark, d):
    return evaluate.summary(judged(spark, d))


@query(f"with {P} select 'a' as case_id, 'Thing' as pattern, min(id) as paper_id, count(*) as matches from papers where contains(lower(title), 'thing') having count(*) > 0")
def eval_titles(spark, d):
    return evaluate.resolve_titles(spark.createDataFrame([("a", "Thing"), ("b", "no such title")], "case_id string, pattern string"), papers(spark, d))


@query("select round(median(value), 6) as median, round((list_sort(list(value)))[greatest(1, cast(floor(0.95 * count(*)) as bigint))], 6) as p95 from events")
def eval_latency(spark, d):
    return evaluate.latency(table(spark, d, "events"), "value")


# ---- events

@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_by_hour(spark, d):
    return event_windows(table(spark, d, "events"))
