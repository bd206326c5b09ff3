"""Composed views: the library graph, the concept graph, graph search, the overview."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.operators import graph as G
from quillstack.operators import profile as P
from quillstack.operators.vectors import similarity_edges, vector_topk

# Chunks of a call, characters of each, the relation that has no name.
GROUP, EXTRACTED, RELATED = 3, 1400, "相关"


def library_graph(lib, threshold: float = 0.55) -> tuple[DataFrame, DataFrame]:
    """Nodes (papers with counts and cluster) and edges (citation, similar)."""
    cited = G.citation_edges(G.resolve_citations(lib.citations, lib.papers))
    near = similarity_edges(lib.paper_vectors.join(lib.papers.select("id"), "id", "left_semi"), threshold=threshold)
    edges = cited.select("src", "dst", F.lit("citation").alias("kind"), F.lit(1.0).alias("weight")).union(near.select("src", "dst", F.lit("similar"), "weight"))
    nodes = lib.papers.join(G.clusters(lib.papers, cited), "id").join(P.chunk_counts(lib.chunks).withColumnRenamed("paper_id", "id"), "id", "left")
    nodes = nodes.select("id", "title", "authors", "year", "venue", F.substring("summary", 1, 220).alias("summary"), "cited_by_count", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.col("citations_fetched_at").isNotNull().alias("has_citations"), "cluster")
    return nodes, edges


def concept_graph(lib) -> tuple[DataFrame, DataFrame]:
    """Nodes (with chunk counts and papers) and edges of the concept graph."""
    nodes = lib.kg_nodes.join(G.entity_counts(lib.kg_chunk_links, lib.chunks).drop("n_papers"), "id", "left")
    return nodes.withColumns({"n_chunks": F.coalesce("n_chunks", F.lit(0)), "paper_ids": F.coalesce("paper_ids", F.array().cast("array<bigint>"))}), lib.kg_edges


def entity_detail(lib, node: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The node, its neighbours, and the papers its edges come from: in the order in which edges first name them, as `seen` from 1,
    where edges have an `ord`."""
    e = lib.kg_edges.filter((F.col("src") == node) | (F.col("dst") == node))
    if "ord" in e.columns:
        first = e.groupBy(F.col("paper_id").alias("id")).agg(F.min("ord").alias("first"))
        rows = lib.papers.select("id", "title", "year").join(first, "id")
        papers = rows.withColumn("seen", F.row_number().over(Window.orderBy("first", "id"))).drop("first")  # one node's papers
    else:
        papers = lib.papers.join(e.select(F.col("paper_id").alias("id")).distinct(), "id", "left_semi").select("id", "title", "year")
    return lib.kg_nodes.filter(F.col("id") == node), G.entity_neighbors(lib.kg_edges, lib.kg_nodes, node), papers


def graph_search(lib, query: str, k: int = 5, embedder=None, parity: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, edges among them, and papers by evidence. node vectors are made by the embedder, if any."""
    near = None
    if embedder is not None:
        from quillstack.hooks import embed_rows

        text = lib.kg_nodes.select("id", F.concat_ws(" ", "display", "desc").alias("text"))
        near = vector_topk(embed_rows(text, embedder), embedder([query])[0], G.SEEDS)
    found = G.seeds(lib.kg_nodes, query, near, parity)
    scored = G.expand_in_order(found, lib.kg_edges.withColumn("ord", F.monotonically_increasing_id())) if parity else G.expand(found, lib.kg_edges)
    best = G.top_entities(scored, lib.kg_nodes)
    return best, G.induced(lib.kg_edges, best), G.evidence(scored, lib.kg_chunk_links, lib.chunks, k)


def build_concepts(lib, extractor) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, links) extracted from all chunks: names merge by their normal form, first ones win; ends of
    relations that no chunk named become nodes of type concept; a chunk links to the nodes named in it."""
    from quillstack.functions.scalars import norm_title
    from quillstack.hooks import extract_rows
    from quillstack.sources.shared import cut

    entities, relations = (cut(x, "concepts") for x in extract_rows(lib.chunks, extractor))
    own = entities.select(F.struct(F.lit(0).alias("late"), "ord").alias("ord"), "name", "type", "desc")
    ends = relations.select("ord", F.explode(F.array("source", "target")).alias("name"))
    more = ends.select(F.struct(F.lit(1).alias("late"), "ord").alias("ord"), "name", F.lit("concept").alias("type"), F.lit("").alias("desc"))
    nodes = cut(G.dedup_nodes(own.union(more)), "concepts")
    key = nodes.select("id", F.col("name").alias("key"))
    edge = relations.join(key.select(F.col("key").alias("sk"), F.col("id").alias("src")), norm_title("source") == F.col("sk")).join(key.select(F.col("key").alias("tk"), F.col("id").alias("dst")), norm_title("target") == F.col("tk"))
    edges = G.dedup_edges(edge.filter("src <> dst").select("ord", "src", "dst", "relation", "paper_id", "chunk_id"))
    links = entities.join(key, norm_title("name") == F.col("key")).groupBy("chunk_id").agg(F.sort_array(F.collect_set("id")).alias("node_ids"))
    return nodes, edges, links


def _answers(lib, extractor, size: int, chars: int | None) -> DataFrame:
    """(paper_id, grp, c, raw): what the extractor says of each group of chunks c(place, chunk_id, t), of whole texts if chars is None;
    null where its call failed."""
    import pyarrow as pa

    place = F.row_number().over(Window.partitionBy("paper_id").orderBy("ord", "id")) - 1
    grouped = lib.chunks.select("paper_id", F.col("id").alias("chunk_id"), (F.col("text") if chars is None else F.substring("text", 1, chars)).alias("t"), place.alias("place"))
    grouped = grouped.groupBy("paper_id", F.expr(f"place div {size}").alias("grp")).agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id", "t"))).alias("c"))  # `size` chunks at most

    def run(batches):
        for b in batches:
            raw = []
            for cell in b.column(2).to_pylist():
                try:
                    raw.append(extractor("\n\n".join(x["t"] or "" for x in cell)))
                except Exception:
                    raw.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(raw, pa.string())], ["paper_id", "grp", "c", "raw"])

    cells = dict(grouped.dtypes)["c"]
    return grouped.mapInArrow(run, f"paper_id long, grp long, c {cells}, raw string")


def _parsed(answers: DataFrame) -> DataFrame:
    """(paper_id, grp, c, j) of the answers that can be read, with the chunks' texts in their normal form."""
    from quillstack.functions.scalars import loose_json, norm_title

    return answers.select("paper_id", "grp", F.transform("c", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), norm_title(F.coalesce(x["t"], F.lit(""))).alias("t"))).alias("c"), loose_json("raw", "entities array<struct<name:string,type:string,desc:string>>, relations array<struct<source:string,target:string,relation:string>>").alias("j")).filter("j is not null")


def concepts_in_groups_report(lib, extractor, size: int = GROUP, chars: int | None = None) -> DataFrame:
    """The report of build_concepts_in_groups alone, over whole texts unless chars says otherwise. Every name of two characters and more has a node, so that nodes need not be made
    nor numbered to count: the answers are read once, and only counts and ids of chunks are summed up by paper."""
    from quillstack.functions.scalars import norm_title

    known = lambda name: F.length(norm_title(name)) >= 2

    def chunks_of(e):
        key = norm_title(e["name"])
        within = F.filter("c", lambda x: F.contains(x["t"], key))
        return F.transform(F.when(F.size(within) > 0, within).otherwise(F.col("c")), lambda x: x["chunk_id"])

    rows = _parsed(_answers(lib, extractor, size, chars)).select(
        "paper_id", "c", F.filter("j.entities", lambda e: known(e["name"])).alias("entities"),
        F.filter("j.relations", lambda r: known(r["source"]) & known(r["target"]) & (norm_title(r["source"]) != norm_title(r["target"]))).alias("relations"),
    )
    rows = rows.select("paper_id", F.when(F.col("entities").isNull(), 0).otherwise(F.size("entities")).cast("long").alias("e"), F.when(F.col("relations").isNull(), 0).otherwise(F.size("relations")).cast("long").alias("r"), F.array_distinct(F.flatten(F.transform("entities", chunks_of))).alias("ids"))
    counts = rows.groupBy("paper_id").agg(F.count("*").alias("groups"), F.sum("e").alias("entities"), F.sum("r").alias("relations"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))  # one paper's chunks
    return counts.select("paper_id", "groups", "entities", "relations", F.size("ids").cast("long").alias("chunks_linked"))


def build_concepts_in_groups(lib, extractor, size: int = GROUP, chars: int = EXTRACTED) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, links, report) with one call of the extractor for `size` chunks of a paper that follow each other.

    An entity belongs to the chunks whose normalised text holds its normalised name, or to the whole group where none does. Names are one
    node across groups and papers, so a relation may name an entity of an earlier group; the first spelling, type and description
    win in the order of papers, groups, entities before relations. An edge carries its group's first chunk. report: (paper_id, groups,
    entities, relations, chunks_linked) of papers with an answer; a call that fails costs its group only.
    """
    from quillstack.functions.scalars import norm_title
    from quillstack.sources.shared import cut

    got = _parsed(cut(_answers(lib, extractor, size, chars), "answers"))
    nth = lambda late: F.struct("paper_id", "grp", F.lit(late).alias("late"), "pos")
    entities = got.select("paper_id", "grp", "c", F.posexplode("j.entities").alias("pos", "e")).withColumn("key", norm_title("e.name")).filter(F.length("key") >= 2)
    within = F.transform(F.filter("c", lambda x: F.contains(x["t"], F.col("key"))), lambda x: x["chunk_id"])
    entities = cut(entities.select(nth(0).alias("ord"), "paper_id", "key", "e.name", F.coalesce("e.type", F.lit("concept")).alias("type"), F.coalesce("e.desc", F.lit("")).alias("desc"), F.when(F.size(within) > 0, within).otherwise(F.transform("c", lambda x: x["chunk_id"])).alias("chunks")), "concepts")
    relations = got.select("paper_id", "grp", F.element_at("c", 1)["chunk_id"].alias("chunk_id"), F.posexplode("j.relations").alias("pos", "r")).withColumns({"sk": norm_title("r.source"), "tk": norm_title("r.target")})
    relations = cut(relations.filter((F.length("sk") >= 2) & (F.length("tk") >= 2)).select(nth(1).alias("ord"), "paper_id", "chunk_id", "r.source", "r.target", F.coalesce("r.relation", F.lit(RELATED)).alias("relation"), "sk", "tk"), "concepts")
    ends = relations.select("ord", F.posexplode(F.array("source", "target")).alias("side", "name"))
    raw = entities.select(F.struct("ord", F.lit(0).alias("side")).alias("ord"), "name", "type", "desc").union(ends.select(F.struct("ord", "side").alias("ord"), "name", F.lit("concept"), F.lit("")))
    nodes = cut(G.dedup_nodes(raw), "concepts")
    key = nodes.select("id", F.col("name").alias("key"))
    edge = relations.join(key.select(F.col("key").alias("sk"), F.col("id").alias("src")), "sk").join(key.select(F.col("key").alias("tk"), F.col("id").alias("dst")), "tk").filter("src <> dst")
    edges = G.dedup_edges(edge.select("ord", "src", "dst", "relation", "paper_id", "chunk_id"))
    linked = entities.select("paper_id", "key", F.explode("chunks").alias("chunk_id")).join(key, "key")
    links = linked.groupBy("chunk_id").agg(F.sort_array(F.collect_set("id")).alias("node_ids"))
    count = lambda df, name: df.groupBy("paper_id").agg(F.count("*").alias(name))
    report = count(got, "groups").join(count(entities, "entities"), "paper_id", "left").join(count(edge, "relations"), "paper_id", "left").join(linked.groupBy("paper_id").agg(F.count_distinct("chunk_id").alias("chunks_linked")), "paper_id", "left")
    return nodes, edges, links, report.na.fill(0)


def overview(lib) -> dict:
    """The library's profile; every block is a few rows."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    topics = rows(G.concept_topics(lib.kg_chunk_links, lib.chunks, lib.kg_nodes))
    tags, terms = rows(P.user_tags(lib.papers)), P.text_topics(P.topic_counts(lib.papers, "title", "abstract", "summary"), 10)
    return {
        "stats": rows(P.library_stats(lib.papers, lib.chunks, lib.chunk_vectors))[0] | rows(P.year_span(lib.papers))[0],
        "topics": topics, "user_tags": tags, "text_topics": terms,
        "representatives": rows(P.representatives(lib.papers, lib.chunks)), "recent": rows(P.recent(lib.papers).select("id", "title", "year", "added_at")), "gaps": rows(P.gaps(lib.papers))[0],
        "direction": P.direction_sentence([t["tag"] for t in tags], [t["name"] for t in topics], [t for t, _ in terms]),
    }
