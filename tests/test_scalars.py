import pytest
from pyspark.sql import functions as F

from quillstack import hooks
from quillstack.functions import scalars as X


def value(spark, col, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)) if cols else spark.range(1)
    return row.select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("raw, want", [
    ("a; B,a|b、c，d", "a; B; c; d"),
    (None, ""),
    ("  x   y ;; ", "x y"),
    (";".join(f"t{i}" for i in range(40)), "; ".join(f"t{i}" for i in range(24))),
    ("z" * 60 + ";" + "z" * 50, "z" * 48),
    ("a；b", "a；b"),
])
def test_normalize_topics(spark, raw, want):
    got = value(spark, X.normalize_topics("t"), t=raw)
    assert got == want
    assert value(spark, X.normalize_topics("t"), t=got) == got


@pytest.mark.parametrize("text, doi, year", [
    ("see 10.1234/ab-c(9).) in 1999", "10.1234/ab-c(9", 1999),
    ("arXiv: 2310.01234v2 from 1987", "10.48550/arXiv.2310.01234", 2023),
    ("nothing here 2150 1850", "", None),
    ("", "", None),
])
def test_doi_and_year(spark, text, doi, year):
    assert value(spark, X.extract_doi("t"), t=text) == doi
    assert value(spark, X.extract_year("t"), t=text) == year
    assert value(spark, X.extract_year(F.col("t"), F.col("d")), t=text, d="D:20110203 2011") == 2011


def test_titles(spark):
    t = lambda a, b, **k: value(spark, X.titles_match(F.col("a"), F.col("b"), **k), a=a, b=b)
    assert t("Attention Is All You Need", "attention is all you need: transformers")
    assert t("need: transformers everywhere", "Attention is all you need: transformers everywhere")
    assert not t("need: transformers everywhere", "Attention is all you need: transformers everywhere", parity=True)
    assert not t("short", "short")
    assert value(spark, X.norm_title("a"), a="Ab-C 9 图") == "abc9图"


def test_small_ones(spark):
    assert value(spark, X.format_authors("a"), a="A;B; C;D") == "A; B; C et al."
    assert value(spark, X.index_text("a", "b", "c", "d", "e"), a="T", b=None, c="", d="A", e="") == "T /  /  / A"
    assert value(spark, X.external_id("a", "b", "c", "d"), a=None, b=" ", c=None, d="Ab") == "th:" + __import__("hashlib").sha1(b"ab").hexdigest()[:16]
    assert value(spark, X.norm_doi("a"), a=" DOI:10.1/X ") == "10.1/x"
    assert value(spark, X.work_id("a", "b"), a="https://doi.org/10.1/x", b="u/W1") == "10.1/x"
    assert value(spark, X.work_id("a", "b"), a=None, b="https://o.org/W1") == "openalex:W1"
    assert value(spark, X.loose_json("a", "k int")["k"], a='{"k": 3} data: [DONE]') == 3
    assert value(spark, X.safe_filename("a"), a="a/b ü图?.pdf") == "a_b_ü图_.pdf"
    assert value(spark, X.topic_tokens("a"), a="The Graph-RAG. of c++x models 知识图谱") == ["Graph-RAG", "c++x", "知识图谱"]
    assert value(spark, X.quota_error(F.lit(402), F.lit(""))) and not value(spark, X.quota_error(F.lit(500), F.lit("down")))
    assert value(spark, X.extract_abstract("a"), a="Abstract: " + "word " * 30 + "\n# Next") == ("word " * 30).strip()
    assert value(spark, X.pages_label(F.lit(2), F.lit(4))) == "p2-4"
    assert X.search_terms("ab, graph；is 检索增强|x") == ["graph", "检索增强"]
    assert value(spark, X.short_label(F.col("a"), 5), a="abcdefg") == "abcd…"


def test_query_expansion():
    assert hooks.glossary_terms("图检索增强 方法")[:2] == ["GraphRAG", "graph retrieval augmented generation"]
    assert hooks.glossary_terms("") == []
    assert hooks.expand_query("attention", lambda q: 1 / 0)[0] == "attention"
    assert len(hooks.expand_query("知识图谱 微调", lambda q: ["a", "b", "c"])) == 5
    assert hooks.parse_variants('say ["x", "y"]', "零样本") == ["x", "y", "zero-shot"]
    assert hooks.parse_variants("no", "plain") is None


def test_hooks(spark):
    embed = hooks.hashing_embedder(8)
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")
    got = {r.id: r.embedding for r in hooks.embed_rows(rows, embed).collect()}
    assert got[1] == pytest.approx(embed(["a b"])[0], abs=1e-6) and len(got[2]) == 8

    def broken(texts):
        raise RuntimeError

    assert all(r.embedding is None for r in hooks.embed_rows(rows, broken).collect())
    assert [r["index"] for r in hooks.overlap_reranker("a b", ["x", "b a", "a"], 2)] == [1, 2]
    assert hooks.lead_summary("One. Two! Three? Four.") == "One. Two! Three?"
