import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from quillstack import hooks
from quillstack.operators import catalog, graph, library, profile
from quillstack.plans import graphs
from quillstack.sources import library as sources
from quillstack.streaming.arrivals import event_windows, ingest_once, landing

PAPERS = [(1, "10.1/A", "Attention is all you need", None), (2, "", "Efficient attention for transformers", 2020), (3, "10.1/c", "Gene editing of staple crops", 2019), (4, None, "Attention is all you need", 2018)]
CITES = [(1, 2, "refs", "doi:10.1/a", "whatever"), (2, 3, "cited", "", "efficient ATTENTION for transformers."), (3, 1, "refs", "", "Gene editing of staple crops: a field study"), (4, 1, "refs", "", "of staple crops"), (5, 1, "refs", "10.1/a", "self"), (6, 2, "refs", "", "crops"), (7, 3, "refs", "", "attention is all you need")]


def tables(spark):
    return spark.createDataFrame(PAPERS, "id long, doi string, title string, year int"), spark.createDataFrame(CITES, "cid long, paper_id long, direction string, ext_id string, title string")


def test_citations(spark):
    p, c = tables(spark)
    got = {r.cid: (r.target, r.tier) for r in graph.resolve_citations(c, p).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (3, 3), 4: (3, 3), 5: (1, 1), 7: (1, 2)}
    assert 4 not in {r.cid for r in graph.resolve_citations(c, p, parity=True).collect()}
    r = graph.resolve_citations(c, p)
    assert {(e.src, e.dst) for e in graph.citation_edges(r).collect()} == {(2, 1), (2, 3), (1, 3), (3, 1)}
    assert sorted((x.relation, x.id) for x in graph.library_neighbors(r, 1).collect()) == [("cites", 3), ("cites", 3)]


def test_components_whatever_the_order(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)]
    want = None
    for _ in range(2):
        r.shuffle(edges)
        got = {x.node: x.component for x in graph.components(spark.createDataFrame([e if r.random() < 0.5 else e[::-1] for e in edges], "a long, b long")).collect()}
        want = want or got
        assert got == want
    for a, b in edges:
        assert a == b or want[a] == want[b] <= min(a, b)


def test_clusters_and_layout(spark):
    p, _ = tables(spark)
    edges = spark.createDataFrame([(2, 3)], "src long, dst long")
    c = graph.clusters(p, edges)
    assert {r.id: r.cluster for r in c.collect()} == {1: 0, 4: 1, 2: 2, 3: 2}
    xy = {r.id: (r.x, r.y) for r in graph.timeline_layout(p.join(c, "id")).collect()}
    assert xy == {4: (0.0, 0), 3: (40.0, -110), 2: (80.0, -126), 1: (240.0, -220)}


def kg(spark):
    nodes = spark.createDataFrame([(1, "graphrag", "Graph RAG", "method", "d"), (2, "rag", "RAG", "method", ""), (3, "llm", "LLM", "concept", ""), (4, "ab", "AB", "task", "")], "id long, name string, display string, type string, desc string")
    edges = spark.createDataFrame([(1, 2, "uses", 7, 70), (2, 3, "uses", 8, 80), (3, 4, "x", 7, 71)], "src long, dst long, relation string, paper_id long, chunk_id long")
    links = spark.createDataFrame([(70, [1, 2]), (80, [3]), (81, [2]), (99, [1])], "chunk_id long, node_ids array<long>")
    chunks = spark.createDataFrame([(70, 7, "t"), (71, 7, "t"), (80, 8, "t"), (81, 8, "t")], "id long, paper_id long, text string")
    papers = spark.createDataFrame([(7, "P7", 2020), (8, "P8", None)], "id long, title string, year int")
    return SimpleNamespace(kg_nodes=nodes, kg_edges=edges, kg_chunk_links=links, chunks=chunks, papers=papers)


def test_concepts(spark):
    g = kg(spark)
    assert {r.id: r.score for r in graph.seeds(g.kg_nodes, "What is Graph-RAG?").collect()} == {1: 1.0, 2: 1.0}
    assert {r.id for r in graph.seeds(g.kg_nodes, "What is Graph RAG?", parity=True).collect()} == {2}
    one = graph.seeds(g.kg_nodes.filter("id = 1"), "graph rag")
    assert {r.id: r.score for r in graph.expand(one, g.kg_edges).collect()} == {1: 1.0, 2: 0.6}
    chained = graph.expand_in_order(one, g.kg_edges.withColumn("ord", F.col("chunk_id") % 10 * 0 + F.col("src")))
    assert {r.id: r.score for r in chained.collect()} == {1: 1.0, 2: 0.6, 3: 0.36, 4: 0.216}
    entities, edges, papers = graphs.graph_search(g, "graph rag")
    assert {r.name: r.score for r in entities.collect()} == {"Graph RAG": 1.0, "RAG": 1.0, "LLM": 0.6}
    assert {(e.src, e.dst) for e in edges.collect()} == {(1, 2), (2, 3)}
    assert [(r.paper_id, r.chunk_id, r.score) for r in papers.collect()] == [(7, 70, 2.0), (8, 81, 1.0)]
    counts = {r.id: (r.n_chunks, r.n_papers, r.paper_ids) for r in graph.entity_counts(g.kg_chunk_links, g.chunks).collect()}
    assert counts == {1: (2, 1, [7]), 2: (2, 2, [7, 8]), 3: (1, 1, [8])}
    node, around, own = graphs.entity_detail(g, 2)
    assert {(r.id, r.direction) for r in around.collect()} == {(1, "<-"), (3, "->")} and own.count() == 2
    assert {r.id: r.around for r in graph.adjacency(g.kg_edges).collect()}[2] == [1, 2, 3]
    assert {r.id: r.degree for r in graph.degree(g.kg_nodes, g.kg_edges).collect()} == {1: 1, 2: 2, 3: 2, 4: 1}
    full, _ = graphs.concept_graph(g)
    assert {r.id for r in graph.visible_concepts(full, graph.degree(full, g.kg_edges)).collect()} == {1, 2, 3}
    assert graph.visible_concepts(full, graph.degree(full, g.kg_edges), ["method"], 8).count() == 1


def test_expansion_never_lowers_a_seed(spark):
    g = kg(spark)
    seeds = spark.createDataFrame([(1, 1.0), (2, 0.1)], "id long, score double")
    assert {r.id: r.score for r in graph.expand(seeds, g.kg_edges).collect()} == {1: 1.0, 2: 0.1, 3: 0.06}


def test_build_concepts(spark):
    chunks = spark.createDataFrame([(1, 7, "We use Graph-RAG and an LLM."), (2, 8, "An LLM and graphrag; nothing.")], "id long, paper_id long, text string")
    nodes, edges, links = graphs.build_concepts(SimpleNamespace(chunks=chunks), hooks.dictionary_extractor({"Graph-RAG": "method", "graphrag": "concept", "LLM": "concept", "An": "concept"}))
    assert {r.name: (r.display, r.type) for r in nodes.collect()} == {"graphrag": ("Graph-RAG", "method"), "llm": ("LLM", "concept"), "an": ("An", "concept")}
    ids = {r.name: r.id for r in nodes.collect()}
    assert (ids["graphrag"], ids["llm"]) in {(e.src, e.dst) for e in edges.collect()} | {(e.dst, e.src) for e in edges.collect()}
    assert {r.chunk_id: set(r.node_ids) for r in links.collect()} == {1: set(ids.values()), 2: set(ids.values())}


def test_overview(spark):
    g = kg(spark)
    g.papers = spark.createDataFrame([(7, "Graph search", "A", "s", "x; Y", "abs", 2020, None, None, 1), (8, "Graph walks", "", " ", "y", "abs", None, None, None, 2)], "id long, title string, authors string, summary string, topics string, abstract string, year int, kg_built_at timestamp, citations_fetched_at timestamp, added_at long")
    g.chunk_vectors = spark.createDataFrame([], "id long")
    o = graphs.overview(g)
    assert o["stats"]["papers"] == 2 and o["gaps"]["no_authors"] == 1 and o["user_tags"] == [{"tag": "Y", "n": 2}, {"tag": "x", "n": 1}]
    assert o["text_topics"][0] == ("Graph", 2) and o["direction"] == "Library on Y, x" and [r["id"] for r in o["recent"]] == [8, 7]


def test_text_topics_skip_parts(spark):
    counts = spark.createDataFrame([("graphs", 9), ("graph", 8), ("Graphs", 7), ("other", 1)], "term string, n_occurrences long")
    assert profile.text_topics(counts, 3, pool=1) == [("graphs", 9), ("other", 1)]


def test_deltas(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    fresh = spark.createDataFrame([(2, "x", 1), (3, "y", 1), (3, "z", 2)], "id long, v string, o int")
    rows = lambda df: sorted((r.id, r.v) for r in df.collect())
    assert rows(library.insert_or_ignore(t, fresh, ["id"], ["o"])) == [(1, "a"), (2, "b"), (3, "y")]
    assert rows(library.insert_or_replace(t, fresh, ["id"], "o")) == [(1, "a"), (2, "x"), (3, "z")]
    p = spark.createDataFrame([(1, "T", "A", "x", "", "", "n")], "id long, title string, authors string, topics string, abstract string, summary string, notes string")
    d = lambda topics, notes: spark.createDataFrame([(1, topics, notes)], "id long, topics string, notes string")
    a = library.annotate(p, d("X, y", None)).first()
    assert (a.topics, a.notes, a.changed, a.index_text) == ("x; y", "n", True, "T / A / x; y")
    b = library.annotate(p, d(None, "")).first()
    assert (b.topics, b.notes, b.changed) == ("x", "", True)
    assert library.annotate(p, d("z", None), merge=False).first().topics == "z"


def test_catalog(spark):
    items = spark.createDataFrame([(1, "AB"), (2, "7"), (7, "CD")], "itemID long, key string")
    gone = spark.createDataFrame([(1,)], "itemID long")
    assert catalog.lookup(items, gone, "7").first().itemID == 7
    assert catalog.lookup(items, gone, "cd").first().itemID == 7
    assert catalog.lookup(items, gone, "AB").count() == 0


def test_sources(spark):
    raw = spark.createDataFrame([(1, '{"results": [{"id": "https://o.org/W5", "doi": null, "title": "T", "publication_year": 2001}, {"id": "x", "title": " "}]}')], "paper_id long, json string")
    assert [tuple(r) for r in sources.works_to_citations(raw).collect()] == [(1, "refs", "openalex:W5", "T", 2001)]
    raw = spark.createDataFrame([(1, '{"data": [{"citedPaper": {"title": "U", "year": 1999, "externalIds": {"ArXiv": "1.2"}, "authors": [{"name": "A"}, {"name": "B"}]}}, {"citingPaper": {"title": ""}}]}')], "paper_id long, json string")
    assert [tuple(r) for r in sources.fallback_to_citations(raw).collect()] == [(1, "refs", "arxiv:1.2", "U", 1999, "A, B")]
    keys = spark.createDataFrame([("k1",), ("k2",)], "key string")
    import hashlib

    marked = spark.createDataFrame([(hashlib.sha256(b"k1").hexdigest()[:12], 1000), (hashlib.sha256(b"k2").hexdigest()[:12], 1)], "fingerprint string, epoch long")
    assert [r.key for r in sources.usable_keys(keys, marked, 1000 + 6 * 3600 - 1).collect()] == ["k2"]


def test_streams(spark, tmp_path):
    schema = "id long, text string"
    for n, rows in enumerate([[(1, "a"), (2, "b"), (3, "a")], [(4, "b"), (5, "c")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest_once(landing(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 5]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    spark.createDataFrame(events.limit(300).toPandas(), "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "ev"))
    stream = event_windows(spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(str(tmp_path / "ev")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from w").first()[0] == 300


def in_order(scored, edges, decay=0.6):
    score = dict(scored)
    for _, s, d in sorted(edges):
        for a, b in ((s, d), (d, s)):
            if a in score and b not in score:
                score[b] = score[a] * decay
    return {i: round(x, 6) for i, x in score.items()}


def test_expand_in_order_by_rounds(spark):
    r = random.Random(8)
    for n, m in ((40, 120), (30, 25), (12, 60)):
        edges = [(r.randint(0, m), r.randrange(n), r.randrange(n)) for _ in range(m)]  # ties, loops, repeats
        scored = [(0, 1.0), (1, 0.5)]
        got = graph.expand_in_order(spark.createDataFrame(scored, "id long, score double"), spark.createDataFrame(edges, "ord long, src long, dst long"))
        assert {x.id: x.score for x in got.collect()} == in_order(scored, edges)


def test_expand_in_order_by_parts(spark, monkeypatch):
    """Wherever the order is cut, also at equal places or for an order without numbers, the result is the same; and once nodes are
    settled, no later edge to them is kept or rewritten."""
    r = random.Random(4)
    edges = [(r.randint(-40, 40), r.randrange(60), r.randrange(60)) for _ in range(180)]
    scored, schema = spark.createDataFrame([(0, 1.0), (1, 0.5)], "id long, score double"), "ord long, src long, dst long"
    df = spark.createDataFrame(edges, schema)
    want = in_order([(0, 1.0), (1, 0.5)], edges)
    assert 20 < len(want)
    for e, parts in ((df, (0.5,)), (df, (0.3, 0.301, 0.9)), (df.withColumn("ord", F.struct("ord", F.lit("a"))), (0.5,))):
        assert {x.id: x.score for x in graph.expand_in_order(scored, e, parts=parts).collect()} == want
    assert graph.expand_in_order(scored, df.filter("false")).count() == 2
    many = [(r.randint(0, 10**6), r.randrange(20), r.randrange(20)) for _ in range(4000)]
    real, rows = graph.cut, []

    def watch(part, name="part"):
        out = real(part, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", watch)
    got = graph.expand_in_order(scored, spark.createDataFrame(many, schema))
    assert {x.id: x.score for x in got.collect()} == in_order([(0, 1.0), (1, 0.5)], many)
    assert sum(rows) < 1.5 * len(many)


def test_expand_in_order_query_sees_the_whole_graph(spark):
    from quillstack.plans import queries

    d = "/root/testdata/sf0.001"
    g = queries.kg(spark, d)
    edges = [tuple(x) for x in g.kg_edges.select(F.xxhash64(F.struct("src", "dst", "relation")), "src", "dst").collect()]
    scored = [tuple(x) for x in graph.seeds(g.kg_nodes, "red widget").select("id", "score").collect()]
    got = {x.id: x.score for x in queries.QUERIES["graph_expand_in_order"](spark, d).collect()}
    assert got == in_order(scored, edges) and len(got) == g.kg_nodes.count()


def test_concept_topics(spark):
    """The most linked nodes, and their papers only; unknown chunks, chunks without paper, chunks named twice, unknown nodes, ties."""
    r = random.Random(2)
    links = [(c, sorted({min(r.randrange(40), r.randrange(40)) for _ in range(r.randint(0, 8))} | ({50} if c % 3 else {60}))) for c in range(200)]
    chunks = [(c, c % 7 if c % 5 else None) for c in range(150) if c % 3 == 0] + [(0, 8), (3, 9)]
    nodes = [(i, f"node {i % 30}", "t") for i in range(55)]
    papers, n = {}, {}
    for c, ids in links:
        for i in ids:
            n[i] = n.get(i, 0) + max(1, sum(k == c for k, _ in chunks))
            papers.setdefault(i, set()).update(p for k, p in chunks if k == c and p is not None)
    for limit in (2, 5, 16):
        top = sorted(n, key=lambda i: (-n[i], i))[: 3 * limit]
        want = sorted(((f"node {i % 30}", "t", n[i], len(papers[i])) for i in top if papers[i] and i < 55), key=lambda x: (-x[3], -x[2], x[0]))[:limit]
        got = graph.concept_topics(spark.createDataFrame(links, "chunk_id long, node_ids array<long>"), spark.createDataFrame(chunks, "id long, paper_id long"), spark.createDataFrame(nodes, "id long, display string, type string"), limit)
        assert [tuple(x) for x in got.collect()] == want and want


def test_links_lie_in_bounded_partitions(spark, monkeypatch):
    """However many rows adaptive execution would put together, a task gathers a bounded number of them."""
    import functools

    from quillstack.plans import queries

    monkeypatch.setattr(queries, "spread", functools.partial(queries.spread, most=400))
    links = queries.kg(spark, "/root/testdata/sf0.001").kg_chunk_links
    sizes = [x["n"] for x in links.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.size("node_ids")).alias("n")).collect()]
    assert len(sizes) == 6000 // 400 + 1 and max(sizes) < 2 * 400 and sum(sizes) > 5000


def test_concepts_in_groups(spark):
    """Three chunks a call; attribution by containment or to the group; names of earlier groups; a call that fails."""
    import json
    from types import SimpleNamespace

    from quillstack.plans.graphs import build_concepts_in_groups

    chunks = spark.createDataFrame([(10 + i, 1, i, t) for i, t in enumerate(["a Graph-RAG here", "nothing", "graph rag again", "second group", "fails?"])] + [(99, 2, 0, "FAIL")], "id long, paper_id long, ord int, text string")

    def extractor(text):
        if "FAIL" in text:
            raise RuntimeError
        if "second" in text:
            return "noise " + json.dumps({"entities": [{"name": "Late"}, {"name": "x"}], "relations": [{"source": "Late", "target": "GRAPH RAG", "relation": "extends"}, {"source": "Late", "target": "late", "relation": "self"}, {"source": "Late", "target": "q", "relation": "short"}]})
        return json.dumps({"entities": [{"name": "Graph RAG", "type": "method", "desc": "d"}, {"name": "Unsaid", "type": "task"}], "relations": [{"source": "Graph RAG", "target": "Other End"}]})

    nodes, edges, links, report = build_concepts_in_groups(SimpleNamespace(chunks=chunks), extractor)
    ids = {r["name"]: r["id"] for r in nodes.collect()}
    got = {r["name"]: (r["display"], r["type"]) for r in nodes.collect()}
    assert got["graphrag"] == ("Graph RAG", "method") and got["otherend"] == ("Other End", "concept") and "x" not in got
    assert {r["chunk_id"]: set(r["node_ids"]) for r in links.collect()} == {10: {ids["graphrag"], ids["unsaid"]}, 11: {ids["unsaid"]}, 12: {ids["graphrag"], ids["unsaid"]}} | ({13: {ids["late"]}, 14: {ids["late"]}} if "late" in ids else {})
    assert {(r["src"], r["dst"], r["relation"], r["chunk_id"]) for r in edges.collect()} == {(ids["graphrag"], ids["otherend"], "相关", 10)} | ({(ids["late"], ids["graphrag"], "extends", 13)} if "late" in ids else set())
    rows = {r["paper_id"]: r.asDict() for r in report.collect()}
    assert set(rows) == {1} and rows[1]["groups"] in (1, 2)


def test_report_of_concepts_alone(spark, monkeypatch):
    """The report by itself equals that of the whole build, and writes nothing."""
    import json
    from types import SimpleNamespace

    from quillstack.plans import graphs
    from quillstack.sources import shared

    answers = [
        {"entities": [{"name": "Graph RAG"}, {"name": "graph-rag"}, {"name": "Unsaid"}, {"name": "x"}, {}], "relations": [{"source": "Graph RAG", "target": "Other"}, {"source": "A b", "target": "ab"}, {"source": "Late", "target": "q"}, {"source": "Late"}]},
        {"entities": []}, {"relations": [{"source": "one", "target": "two"}]}, {}, None,
    ]
    chunks = spark.createDataFrame([(100 * p + i, p, i, f"n{(p + i // 3) % 5} graph rag" if i % 2 else f"n{(p + i // 3) % 5}") for p in range(9) for i in range(p)], "id long, paper_id long, ord int, text string")
    extractor = lambda text: json.dumps(answers[int(text[1])]) if answers[int(text[1])] is not None else "no"
    lib = SimpleNamespace(chunks=chunks)
    want = graphs.build_concepts_in_groups(lib, extractor)[3]
    monkeypatch.setattr(shared, "cut", None)
    got = graphs.concepts_in_groups_report(lib, extractor)
    assert got.columns == want.columns and len(rows := sorted(map(tuple, want.collect()))) > 5 and len({r[1:] for r in rows}) > 3
    assert sorted(map(tuple, got.collect())) == rows


def test_report_reads_whole_texts(spark, tmp_path):
    """Names at the very end of the longest chunk count, in the code as in its SQL."""
    import duckdb

    from quillstack.plans.more_queries import SQL, concept_groups_report

    texts = ["y" * 1395 + "thing and " + "z" * 300 + " heoron", "y" * 1500 + "thing", "thing", "y" * 4000 + "tion", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in concept_groups_report(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.execute(SQL["concept_groups_report"]).fetchall()) == {(0, 1, 2, 1, 1), (1, 1, 1, 0, 1), (2, 1, 1, 0, 1), (3, 1, 1, 0, 1)}


def test_apply_fetched(spark):
    """The first source that knows a paper speaks for it; a known paper without citations loses its old ones; unknown papers stay as they are."""
    from quillstack.sources.library import apply_fetched, fetched

    papers = spark.createDataFrame([(i, f"A{i}", None, None) for i in range(1, 5)], "id long, authors string, cited_by_count int, citations_fetched_at timestamp")
    old = spark.createDataFrame([(i, i, "refs", "old", "t", None) for i in range(1, 5)], "cid long, paper_id long, direction string, ext_id string, title string, year int")
    row = lambda cid, p, e: (cid, p, "cited", e, "T", 2000)
    meta = "paper_id long, cited_by_count int, authors string"
    primary = (spark.createDataFrame([row(12, 1, "x"), row(11, 1, "x"), row(13, 1, "y")], old.schema), spark.createDataFrame([(1, 7, "New"), (2, None, "")], meta))
    fallback = (spark.createDataFrame([row(21, 1, "z"), row(22, 3, "z")], old.schema), spark.createDataFrame([(1, 8, "Not"), (3, None, None)], meta))
    rows, found = fetched(papers, primary, fallback)
    new, cits, report = apply_fetched(papers, old, papers, rows, found)
    assert sorted((r["id"], r["authors"], r["cited_by_count"], r["citations_fetched_at"] is not None) for r in new.collect()) == [(1, "New", 7, True), (2, "A2", None, True), (3, "A3", None, True), (4, "A4", None, False)]
    assert sorted((r["cid"], r["paper_id"], r["ext_id"]) for r in cits.collect()) == [(4, 4, "old"), (11, 1, "x"), (13, 1, "y"), (22, 3, "z")]
    assert sorted((r["paper_id"], r["status"], r["source"], r["cited"], r["stored"]) for r in report.collect()) == [(1, "ok", "primary", 3, 2), (2, "ok", "primary", 0, 0), (3, "ok", "fallback", 1, 1), (4, "not_found", "fallback", 0, 0)]
