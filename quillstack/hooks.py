"""What a user may plug in, each with an offline default that gives the same result every time.

A missing hook means fewer signals, never an error: plans leave its branch out.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]
Reranker = Callable[[str, list[str], int], list[dict]]
Rewriter = Callable[[str], list[str] | None]
Extractor = Callable[[str], str]

EMBED_BATCH, EMBED_CHARS = 16, 4000


@functools.lru_cache(1 << 16)
def _feature(f: str) -> int:
    return int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")


def hashing_embedder(dim: int = 64) -> Embedder:
    """Signed hashing of words and character trigrams, unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for row, t in zip(out, texts):
            low = t.lower()
            for f, n in Counter([*re.findall(r"\w+", low), *map("".join, zip(low, low[1:], low[2:]))]).items():
                h = _feature(f)
                row[h % dim] += n if h >> 63 else -n
            row /= np.linalg.norm(row) or 1.0
        return out.tolist()

    return embed


def overlap_reranker(query: str, documents: list[str], top_n: int) -> list[dict]:
    """[{index, score}] by the share of the query's words a document has."""
    want = set(re.findall(r"\w+", query.lower()))
    score = [len(want & set(re.findall(r"\w+", d.lower()))) / max(1, len(want)) for d in documents]
    order = sorted(range(len(documents)), key=lambda i: (-score[i], i))
    return [{"index": i, "score": score[i]} for i in order[:top_n]]


def lead_summary(text: str | None, most: int = 3, chars: int = 3500) -> str | None:
    """The first sentences."""
    found = re.findall(r"[^.!?。！？]+[.!?。！？]", (text or "")[:chars])
    return " ".join(s.strip() for s in found[:most]) or None


def map_text(f: Callable[[str | None], str | None]) -> Callable:
    """A function of one text as a column function, an Arrow batch at a time; a text it fails on gets null."""

    def one(t: str | None) -> str | None:
        try:
            return f(t)
        except Exception:
            return None

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([one(t.as_py()) for t in texts], pa.string())

    return run


def dictionary_extractor(terms: dict[str, str]) -> Extractor:
    """Entities of a fixed list {name: type} found in a text, and that neighbours in it occur together."""

    def extract(text: str) -> str:
        low = text.lower()
        got = sorted((low.find(n.lower()), n) for n in terms if n.lower() in low)
        entities = [{"name": n, "type": terms[n], "desc": ""} for _, n in got]
        relations = [{"source": a[1], "target": b[1], "relation": "co-occurs"} for a, b in zip(got, got[1:])]
        return json.dumps({"entities": entities, "relations": relations})

    return extract


def embed_rows(rows: DataFrame, embedder: Embedder | None, id_col: str = "id", text_col: str = "text", batch: int = EMBED_BATCH) -> DataFrame:
    """(id, embedding): null where there is no embedder or its call for the batch failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            out: list = []
            for at in range(0, len(texts), batch):
                part = [(t or "")[:EMBED_CHARS] for t in texts[at : at + batch]]
                try:
                    out += embedder(part) if embedder else [None] * len(part)
                except Exception:  # a failed call costs its own rows only
                    out += [None] * len(part)
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.list_(pa.float32()))], ["id", "embedding"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.substring(text_col, 1, EMBED_CHARS).alias("text")).mapInArrow(run, "id long, embedding array<float>")


def extract_rows(chunks: DataFrame, extractor: Extractor) -> tuple[DataFrame, DataFrame]:
    """Entities (ord, name, type, desc, chunk_id, paper_id) and relations (ord, source, target, relation, chunk_id,
    paper_id) from chunks(id, paper_id, text), parsed leniently; a failing chunk has none."""
    from quillstack.functions.scalars import loose_json

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(2).to_pylist():
                try:
                    out.append(extractor((t or "")[:1400]))
                except Exception:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["chunk_id", "paper_id", "raw"])

    raw = chunks.select(F.col("id").cast("long").alias("chunk_id"), F.col("paper_id").cast("long").alias("paper_id"), "text").mapInArrow(run, "chunk_id long, paper_id long, raw string")
    got = raw.select("chunk_id", "paper_id", loose_json("raw", "entities array<struct<name:string,type:string,desc:string>>, relations array<struct<source:string,target:string,relation:string>>").alias("j"))
    place = F.struct("chunk_id", "pos").alias("ord")
    e = got.select("chunk_id", "paper_id", F.posexplode("j.entities").alias("pos", "e")).select(place, "e.*", "chunk_id", "paper_id")
    r = got.select("chunk_id", "paper_id", F.posexplode("j.relations").alias("pos", "r")).select(place, "r.*", "chunk_id", "paper_id")
    return e, r


# Bilingual glossary for offline query expansion.
GLOSSARY = (
    (("图检索增强", "图检索增强生成", "图增强检索", "知识图谱检索"), ("GraphRAG", "graph retrieval augmented generation")),
    (("轻量图检索",), ("LightRAG", "light rag")),
    (("自我反思检索", "自反思检索"), ("Self-RAG", "self-reflective retrieval")),
    (("纠正式检索", "纠错检索"), ("Corrective RAG", "CRAG")),
    (("假设文档嵌入",), ("HyDE", "hypothetical document embeddings")),
    (("检索增强", "检索增强生成", "增强检索"), ("retrieval-augmented generation", "RAG")),
    (("图检索",), ("graph retrieval", "GraphRAG")),
    (("注意力机制",), ("attention", "self-attention")),
    (("向量数据库",), ("vector database", "vector search")),
    (("重排序", "重排"), ("rerank", "reranker")),
    (("知识图谱",), ("knowledge graph", "KG")),
    (("大语言模型",), ("large language model", "LLM")),
    (("零样本",), ("zero-shot",)),
    (("少样本",), ("few-shot",)),
    (("提示工程",), ("prompt engineering",)),
    (("微调",), ("fine-tuning", "finetune")),
    (("基准测试",), ("benchmark",)),
    (("消融实验",), ("ablation",)),
)


#: Entries in the order in which they speak: those with the longest anchor first.
_ENTRIES = tuple(sorted(GLOSSARY, key=lambda e: -max(map(len, e[0]))))


def glossary_column(query: Column, most: int = 4) -> Column:
    """Terms of the glossary's entries that a query touches, longest anchors first, those not in it already."""
    q = F.lower(F.trim(F.coalesce(query, F.lit(""))))
    entries = F.array(*[F.array(*[F.lit(t) for t in (*latin, *cjk)]) for cjk, latin in _ENTRIES])
    touched = F.flatten(F.filter(entries, lambda e: F.exists(e, lambda t: F.contains(q, F.lower(t)))))
    fresh = F.array_distinct(F.filter(touched, lambda t: ~F.contains(q, F.lower(t))))
    return F.when(q != "", F.slice(fresh, 1, most)).otherwise(F.array().cast("array<string>"))


def expand_column(query: Column, variants: Column | None = None, most: int = 5) -> Column:
    """The query, glossary terms, and a rewriter's variants, each once and none blank."""
    parts = [F.array(query), glossary_column(query), *([F.coalesce(variants, F.array().cast("array<string>"))] if variants is not None else [])]
    return F.slice(F.array_distinct(F.filter(F.concat(*parts), lambda v: F.trim(v) != "")), 1, most)


def variants_column(answer: Column, query: Column, most: int = 4) -> Column:
    """Up to three variants of a model's JSON array answer with the glossary's terms; null if there are none."""
    given = F.from_json(F.regexp_extract(F.coalesce(answer, F.lit("")), "(?s)\\[.*\\]", 0), "array<string>")
    given = F.slice(F.filter(F.transform(F.coalesce(given, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), 1, 3)
    every = F.slice(F.array_distinct(F.concat(given, glossary_column(query))), 1, most)
    return F.when(F.size(every) > 0, every)


def glossary_terms(query: str, most: int = 4) -> list[str]:
    """glossary_column() of one query, on the driver."""
    q = query.strip().lower()
    touched = [t for cjk, latin in _ENTRIES if q and any(x.lower() in q for x in (*latin, *cjk)) for t in (*latin, *cjk)]
    return list(dict.fromkeys(t for t in touched if t.lower() not in q))[:most]


def expand_query(query: str, rewriter: Rewriter | None = None, most: int = 5) -> list[str]:
    """The query, glossary terms, and a rewriter's variants; errors of the rewriter are ignored."""
    try:
        more = (rewriter(query) if rewriter else None) or []
    except Exception:
        more = []
    return list(dict.fromkeys(v for v in (query, *glossary_terms(query), *more) if v.strip()))[:most]


def parse_variants(answer: str, query: str, most: int = 4) -> list[str] | None:
    """Up to three variants of a model's JSON array answer with the glossary's terms; None if there are none."""
    found = re.search(r"\[.*\]", answer or "", re.DOTALL)
    try:
        given = [str(x).strip() for x in json.loads(found[0]) if str(x).strip()][:3] if found else []
    except ValueError:
        given = []
    return list(dict.fromkeys([*given, *glossary_terms(query)]))[:most] or None
