"""Divergence of sources against brute force over all kept terms and pairs, and against its SQL; heavy and light split anywhere."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from quillstack.llm import divergence, queries

from .helpers import DATA, awkward, frame


def brute(rows, min_docs=10, top=10):
    """rows: (text, lang, source). From the definition, dense and in Python's whole numbers."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    said = [(lang, source, Counter(lower(t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text))) for text, lang, source in rows]
    docs, count, out = defaultdict(Counter), defaultdict(Counter), []
    for lang, source, c in said:
        docs[lang].update(c.keys())
        count[lang, source].update(c)
    for lang in docs.keys() | {k for k, _ in count}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = sorted(s for k, s in count if k == lang)
        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(count[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, got in (("pair", pairs), ("term", terms)):
                ranked = sorted(got, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(ranked if part == "pair" else ranked[:top])]
    return sorted(out)


def run(spark, df, **more):
    return sorted(tuple(r) for r in divergence.source_divergence(df, **more).collect())


def read(df):
    return [(r["text"], r["lang"], r["source"]) for r in df.collect()]


def words(n=400):
    """Many sources, words of some, of all, of two; a source without words, a language with one source, null names."""
    out = []
    for i in range(n):
        s = i * i % 23
        out.append((f"Common word{s % 3} rare{s // 2} own{s} {'ÀB' * (i % 2)} x1y-Z" * (1 + i % 3), ["en", "fr", None][s % 3], f"s{s}" if s else None))
    return [*out, ("123 .,", "en", "no words"), (None, "en", "null text"), ("alone", "it", "only"), (" ".join(f"t{c}" for c in "abc" * 40_000), "en", "long")]


def table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(5)


@pytest.mark.parametrize("light, block, tile", [(8, 1024, 128), (0, 2, 128), (1000, 1024, 128), (3, 4, 2), (2, 1024, 3)])
def test_any_split_gives_the_same(spark, light, block, tile):
    rows = words()
    assert run(spark, table(spark, rows), light=light, block=block, tile=tile) == brute(rows)


def test_awkward(spark):
    df = frame(spark, awkward() + awkward()).cache()
    assert run(spark, df, min_docs=2) == brute(read(df), 2)
    assert run(spark, df, min_docs=1000) == brute(read(df), 1000)  # nothing is kept: every pair has zero
    assert run(spark, frame(spark, [])) == []


def test_counts_beyond_64_bits(spark):
    """A term said 10^12 times: shares are whole-number quotients of 10^21."""
    df = spark.createDataFrame([(10**12, 3 * 10**12 + 7, 5)], "c long, t long, k long")
    assert df.select(divergence._share("c", "t", "k")).first()[0] == 1 + 10**9 * (10**12 + 2) // (3 * 10**12 + 7 + 10)


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = queries.op11_source_divergence(spark, DATA)
    want = con.execute(queries.oracle_sql()["op11_source_divergence"])
    names = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall())
    assert len(names) == len(got.columns)
