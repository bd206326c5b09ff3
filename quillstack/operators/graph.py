"""Citation and concept graphs: resolution of citations, edges, components, layout, expansion, graph search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from quillstack.functions.scalars import norm_doi, norm_name, norm_title
from quillstack.sources.shared import cut, discard

from .components import components
from .containment import contained
from .numbering import numbered

GRAM, DIGITS = 12, 6
# The timeline's width, and steps within a year, between lanes, and within a lane.
X_SPAN, X_STEP, Y_LANE, Y_STEP = 240.0, 26, -110, -16


def resolve_citations(citations: DataFrame, papers: DataFrame, parity: bool = False, interleaved: bool = False) -> DataFrame:
    """(row columns, target, tier): the paper each citation row means, by DOI (1), exact title (2), or containment
    of normalised titles of 12 characters at least (3); the first tier wins, then the smallest id.

    citations need (cid, ext_id, title), papers (id, doi, title). Different titles meet on the rarest piece of the shorter one. parity
    takes the alphabetically smaller title for the shorter. interleaved: the smallest id of any tier wins.
    """
    c = citations.select("cid", norm_doi("ext_id").alias("doi"), norm_title("title").alias("t"))
    p = papers.select("id", norm_doi("doi").alias("doi"), norm_title("title").alias("t"))
    by_doi = c.filter("doi <> ''").join(p.filter("doi <> ''").select("id", "doi"), "doi").select("cid", "id", F.lit(1).alias("tier"))
    exact = c.filter("t <> ''").join(p.filter("t <> ''").select("id", "t"), "t").select("cid", "id", F.lit(2).alias("tier"))
    # Either side may be the shorter one.
    titles = lambda df: df.select("t")
    one, two = contained(titles(c), titles(p), GRAM), contained(titles(p), titles(c), GRAM)
    if parity:
        one, two = one.filter("s <= l"), two.filter("s <= l")
    pairs = one.select(F.col("s").alias("ct"), F.col("l").alias("pt")).union(two.select(F.col("l").alias("ct"), F.col("s").alias("pt"))).distinct()
    least = p.groupBy(F.col("t").alias("pt")).agg(F.min("id").alias("id"))  # of papers with one title the smallest id wins
    fuzzy = c.select("cid", F.col("t").alias("ct")).join(pairs.join(least, "pt").groupBy("ct").agg(F.min("id").alias("id")), "ct").select("cid", "id", F.lit(3).alias("tier"))
    best = by_doi.union(exact).union(fuzzy).groupBy("cid").agg(F.min(F.struct("id", "tier") if interleaved else F.struct("tier", "id")).alias("m"))
    return citations.join(best, "cid").select(*citations.columns, F.col("m.id").alias("target"), F.col("m.tier").alias("tier"))


def citation_edges(resolved: DataFrame) -> DataFrame:
    """(src, dst): who cites whom inside the library, once each, no self citations."""
    out = F.col("direction") == "refs"
    e = resolved.select(F.when(out, F.col("paper_id")).otherwise(F.col("target")).alias("src"), F.when(out, F.col("target")).otherwise(F.col("paper_id")).alias("dst"))
    return e.filter("src <> dst").distinct()


def library_neighbors(resolved: DataFrame, paper_id: int) -> DataFrame:
    """(relation, id): papers that one paper cites or that cite it, one row per citation row."""
    return resolved.filter((F.col("paper_id") == paper_id) & (F.col("target") != paper_id)).select(F.when(F.col("direction") == "refs", "cites").otherwise("cited_by").alias("relation"), F.col("target").alias("id"))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first in the order given."""
    names = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in rows.columns])


def replace_citations(table: DataFrame, fresh: DataFrame) -> DataFrame:
    """The citation table with the fresh rows' papers replaced; of equal (paper, direction, ext_id) the first stays."""
    kept = table.join(fresh.select("paper_id").distinct(), "paper_id", "left_anti")
    return kept.unionByName(keep_first(fresh, ["paper_id", "direction", "ext_id"], ["cid"]).select(table.columns))


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster): components numbered from 0 by their first node in (year, id) order, unconnected nodes too."""
    comp = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    own = nodes.select("id", "year").join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = own.groupBy("component").agg(F.min(F.struct(F.col("year").isNotNull().alias("k"), "year", "id")).alias("first"))
    number = numbered(first, ["first"]).select("component", (F.col("place") - 1).alias("cluster"))
    return own.join(number, "component").select("id", "cluster")


def timeline_layout(nodes: DataFrame, default_year: int = 2024) -> DataFrame:
    """(id, cluster, x, y) of nodes(id, year, cluster): a lane per component, oldest first; x by year."""
    n = nodes.select("id", "cluster", F.coalesce("year", F.lit(default_year)).alias("yr"))
    span = n.agg(F.min("yr").alias("lo"), F.greatest(F.max("yr") - F.min("yr"), F.lit(2)).alias("span"))
    lanes = numbered(n.groupBy("cluster").agg(F.min("yr").alias("start")), ["start", "cluster"], "lane").select("cluster", (F.col("lane") - 1).alias("lane"))
    # One numbering by lane, year and id; places within a lane or a year of it count from its first one.
    n = numbered(n.join(lanes, "cluster"), ["lane", "yr", "id"])
    n = n.join(n.groupBy("lane").agg(F.min("place").alias("first")), "lane").join(n.groupBy("lane", "yr").agg(F.min("place").alias("early")), ["lane", "yr"]).crossJoin(F.broadcast(span))
    k, i = F.col("place") - F.col("first"), F.col("place") - F.col("early")
    return n.select("id", "cluster", F.round((F.col("yr") - F.col("lo")) * X_SPAN / F.col("span") + X_STEP * i, DIGITS).alias("x"), (Y_LANE * F.col("lane") + Y_STEP * k).cast("long").alias("y"))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): incident edge ends, 0 for isolated nodes."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, around): each node's closed neighbourhood."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    own = both.select("src", F.col("src").alias("dst"))
    return both.union(own).groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("around"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes(id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def entity_neighbors(edges: DataFrame, nodes: DataFrame, node: int) -> DataFrame:
    """(id, name, type, relation, direction) at the other ends of one node's edges."""
    out = edges.filter(F.col("src") == node).select(F.col("dst").alias("id"), "relation", F.lit("->").alias("direction"))
    into = edges.filter((F.col("dst") == node) & (F.col("src") != node)).select(F.col("src").alias("id"), "relation", F.lit("<-").alias("direction"))
    return out.union(into).join(nodes.select("id", F.col("display").alias("name"), "type"), "id")


def _linked(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, paper_id) of links(chunk_id, node_ids), a row a link; chunks meet before links are spread out. Unknown chunks have no paper."""
    return links.join(chunks.select(F.col("id").alias("chunk_id"), "paper_id"), "chunk_id", "left").select(F.explode("node_ids").alias("id"), "paper_id")


def entity_counts(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, n_chunks, n_papers, paper_ids) of links(chunk_id, node_ids): links whose chunk is unknown count as chunks."""
    return _linked(links, chunks).groupBy("id").agg(F.count("*").alias("n_chunks"), F.count_distinct("paper_id").alias("n_papers"), F.sort_array(F.collect_set("paper_id")).alias("paper_ids"))


def concept_topics(links: DataFrame, chunks: DataFrame, nodes: DataFrame, limit: int = 16) -> DataFrame:
    """(name, type, n_chunks, n_papers): the 3 * limit most linked nodes, those without papers dropped, by papers. Papers are
    counted for these nodes only."""
    rows = _linked(links, chunks)
    top = rows.groupBy("id").agg(F.count("*").alias("n_chunks")).orderBy(F.desc("n_chunks"), "id").limit(3 * limit)
    papers = rows.filter("paper_id is not null").join(F.broadcast(top), "id").groupBy("id", "n_chunks").agg(F.count_distinct("paper_id").alias("n_papers"))
    named = nodes.select("id", F.col("display").alias("name"), "type").join(F.broadcast(papers), "id")  # 3 * limit rows at most
    return named.select("name", "type", "n_chunks", "n_papers").orderBy(F.desc("n_papers"), F.desc("n_chunks"), "name").limit(limit)


def dedup_nodes(raw: DataFrame, first_id: int = 1, least: int = 2) -> DataFrame:
    """(id, name, display, type, desc) of raw(ord, name, type, desc): one node per normalised name, the first spelling
    wins; names that normalise to fewer than two characters are refused."""
    n = raw.withColumn("key", norm_title("name")).filter(F.length("key") >= least)
    one = n.groupBy("key").agg(F.min_by(F.struct("name", "type", F.substring("desc", 1, 300).alias("desc")), "ord").alias("r"), F.min("ord").alias("ord"))
    return numbered(one, ["ord"]).select((F.col("place") - 1 + first_id).alias("id"), F.col("key").alias("name"), F.col("r.name").alias("display"), F.col("r.type").alias("type"), F.col("r.desc").alias("desc"))


def dedup_edges(raw: DataFrame) -> DataFrame:
    """Of raw(ord, src, dst, relation, paper_id, chunk_id) the first of each (src, dst, relation[:60])."""
    return keep_first(raw.withColumn("relation", F.substring("relation", 1, 60)), ["src", "dst", "relation"], ["ord"]).drop("ord")


SEEDS, MIN_SIM, DECAY, TOP_ENTITIES = 8, 0.42, 0.6, 12
#: Shares of the edges, in order, at which expand_in_order() cuts them.
PARTS = (1 / 64, 1 / 16, 1 / 8, 1 / 4)


def seeds(nodes: DataFrame, query: str, near: DataFrame | None = None, parity: bool = False) -> DataFrame:
    """(id, score): nodes whose name (3 characters at least) stands in the query score 1; if they are fewer than
    eight, the eight nearest of near(id, sim) above the threshold join with their similarity."""
    spark = nodes.sparkSession
    q = spark.range(1).select((norm_name(F.lit(query)) if parity else norm_title(F.lit(query))).alias("q"))
    named = nodes.crossJoin(F.broadcast(q)).filter((F.length("name") >= 3) & F.contains("q", "name")).select("id", F.lit(1.0).alias("score"))
    if near is None:
        return named
    few = named.agg(F.count("*").alias("n")).filter(F.col("n") < SEEDS).select(F.lit(1).alias("go"))
    close = near.filter(F.col("sim") >= MIN_SIM).orderBy(F.desc("sim"), "id").limit(SEEDS).crossJoin(F.broadcast(few))
    return named.union(close.select("id", F.col("sim").alias("score"))).groupBy("id").agg(F.max("score").alias("score"))


def expand(scored: DataFrame, edges: DataFrame, decay: float = DECAY) -> DataFrame:
    """(id, score): seeds and their neighbours, who get the best neighbouring seed's score times the decay."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    next_ = both.join(scored.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.round(decay * F.max("score"), DIGITS).alias("score"))
    return scored.union(next_.join(scored.select("id"), "id", "left_anti"))


def expand_in_order(scored: DataFrame, edges: DataFrame, decay: float = DECAY, parts: tuple[float, ...] = PARTS) -> DataFrame:
    """As expand(), but edges(ord, src, dst) are read once in order, of equal ord by ends, and nodes scored on the way
    pass it on. A node's score thus comes by its first edge to a node that was scored by an earlier one.

    Edges are taken in parts that follow each other in order (a numeric ord is cut at these shares of the edges, any other is one part). What
    one part has settled no later edge changes, so that of the next only edges to nodes not yet scored are kept. Within a
    part, nodes reached by an earlier edge than known, or with another score, offer their later edges to their
    neighbours, in rounds of joins, until none changes. Every round is written to the shared folder.
    """
    e = cut(edges.filter("src <> dst").select("ord", "src", "dst"), "edges")
    cuts = e.agg(F.percentile_approx("ord", list(parts), 10_000)).first()[0] if isinstance(e.schema["ord"].dataType, NumericType) else None
    ends = sorted(set(cuts or ()))
    at = F.struct("ord", F.when(F.col("ahead"), F.col("a")).otherwise(F.col("b")).alias("src"), F.when(F.col("ahead"), F.col("b")).otherwise(F.col("a")).alias("dst"))
    better = F.expr("m is not null and (had is null or m.at < had.at or (m.at = had.at and m.score <> had.score))")

    def offers(both: DataFrame, since: DataFrame) -> DataFrame:
        rows = both.join(since.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id"), at.alias("at"), "since", "score").filter("since is null or at > since")
        return rows.groupBy("id").agg(F.min(F.struct("at", (decay * F.col("score")).alias("score"))).alias("m"))

    reached = cut(scored.select("id", "score"), "reached")
    for low, high in zip([None, *ends], [*ends, None]):
        part = e if low is None else e.filter(F.col("ord") > low)
        part = part if high is None else part.filter((F.col("ord") <= high) | F.col("ord").isNull())
        ways = F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("ahead")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(False).alias("ahead"))))
        both = part.select("ord", ways.alias("way")).select("ord", "way.*")
        both = cut(both.join(reached.select(F.col("id").alias("b")), "b", "left_anti"), "edges")
        first = offers(both, reached.withColumn("since", F.lit(None)))
        turn, found = 0, cut(first.select("id", F.col("m").alias("had"), F.lit(0).alias("turn")), "found")
        while not (fresh := found.filter(F.col("turn") == turn)).isEmpty():
            turn += 1
            best = offers(both, fresh.select("id", F.col("had.at").alias("since"), F.col("had.score").alias("score")))
            behind, found = found, cut(found.join(best, "id", "full").select("id", F.when(better, F.col("m")).otherwise(F.col("had")).alias("had"), F.when(better, turn).otherwise(F.col("turn")).alias("turn")), "found")
            discard(behind)
        discard(both)
        reached = reached.unionByName(found.select("id", "had.score"))
    discard(e)
    return reached.select("id", F.round("score", DIGITS).alias("score"))


def evidence(scored: DataFrame, links: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(paper_id, chunk_id, score): per chunk the sum of its nodes' scores, per paper the best chunk, k papers."""
    per = links.select("chunk_id", F.explode("node_ids").alias("id")).join(scored, "id").groupBy("chunk_id").agg(F.round(F.sum("score"), DIGITS).alias("score"))
    own = per.join(chunks.select(F.col("id").alias("chunk_id"), "paper_id"), "chunk_id")
    best = own.groupBy("paper_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "chunk_id")).alias("m"))
    return best.select("paper_id", F.col("m.chunk_id").alias("chunk_id"), (-F.col("m.s")).alias("score")).orderBy(F.desc("score"), "paper_id").limit(k)


def top_entities(scored: DataFrame, nodes: DataFrame, k: int = TOP_ENTITIES) -> DataFrame:
    return scored.orderBy(F.desc("score"), "id").limit(k).join(nodes.select("id", F.col("display").alias("name"), "type"), "id").select("id", "name", "type", "score")


def visible_concepts(nodes: DataFrame, degrees: DataFrame, types: list[str] | None = None, paper_id: int | None = None, hide_minor: bool = True) -> DataFrame:
    """Concept nodes of the types chosen, of one paper if given, without those of one chunk and one edge at most."""
    n = nodes.join(degrees, "id", "left")
    if types:
        n = n.filter(F.col("type").isin(types))
    if paper_id is not None:
        n = n.filter(F.array_contains("paper_ids", paper_id))
    return n.filter(~((F.col("n_chunks") < 2) & (F.coalesce("degree", F.lit(0)) <= 1))) if hide_minor else n


def concept_search(nodes: DataFrame, query: str, k: int = 8) -> DataFrame:
    """Nodes whose name or description contains the query, or whose type it is."""
    q = query.strip().lower()
    return nodes.filter(F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower(F.coalesce("desc", F.lit(""))), F.lit(q)) | (F.lower("type") == q)).orderBy("id").limit(k)


def visible_papers(nodes: DataFrame, cluster: int | None = None, year_min: int = 0, year_max: int = 9999, author: str = "", venue: str = "") -> DataFrame:
    """Paper nodes of one cluster, if given, within the view's filters; a missing year fails any bound set."""
    n = nodes if cluster is None else nodes.filter(F.col("cluster") == cluster)
    if year_min > 0:
        n = n.filter(F.coalesce("year", F.lit(0)) >= year_min)
    if year_max < 9999:
        n = n.filter(F.coalesce("year", F.lit(9999)) <= year_max)
    for col, text in (("authors", author), ("venue", venue)):
        if text:
            n = n.filter(F.contains(F.lower(F.coalesce(F.col(col), F.lit(""))), F.lit(text.lower())))
    return n
