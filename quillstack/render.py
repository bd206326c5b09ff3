"""Small results as Markdown; they are collected first, being as many rows as a reader will look at."""

from __future__ import annotations

from pyspark.sql import DataFrame


def hits(cards: DataFrame) -> str:
    rows = cards.orderBy(cards["score"].desc(), "paper_id").collect()
    out = []
    for n, r in enumerate(rows, 1):
        year = f" ({r['year']})" if r["year"] is not None else ""
        where = ", ".join(x for x in (r["section"], r["pages"]) if x)
        out.append(f"{n}. **{r['title']}**{year} [paper {r['paper_id']}, score {r['score']:.5f}]\n   {where}: {' '.join((r['snippet'] or '').split())}")
    return "\n".join(out) or "No results."


def graph(entities: DataFrame, edges: DataFrame, papers: DataFrame) -> str:
    names = {r["id"]: r["name"] for r in entities.collect()}
    lines = ["## Entities", *[f"- {r['name']} ({r['type']}, {r['score']:.3f})" for r in entities.orderBy(entities["score"].desc(), "id").collect()]]
    lines += ["## Relations", *[f"- {names.get(r['src'], r['src'])} —{r['relation']}→ {names.get(r['dst'], r['dst'])}" for r in edges.collect()]]
    lines += ["## Papers", *[f"- paper {r['paper_id']} ({r['score']:.3f})" for r in papers.orderBy(papers["score"].desc(), "paper_id").collect()]]
    return "\n".join(lines)


def overview(blocks: dict) -> str:
    """blocks as given by plans.overview()."""
    s = blocks["stats"]
    lines = [f"{s['papers']} papers, {s['chunks']} chunks, {s['embedded']} embedded"]
    lines += [blocks["direction"], "## Topics", *[f"- {t['name']} ({t['n_papers']} papers)" for t in blocks["topics"]]]
    lines += ["## Tags", *[f"- {t['tag']} ({t['n']})" for t in blocks["user_tags"]], "## Terms", *[f"- {t} ({n})" for t, n in blocks["text_topics"]]]
    lines += ["## Gaps", *[f"- {k}: {v}" for k, v in blocks["gaps"].items()]]
    return "\n".join(lines)
