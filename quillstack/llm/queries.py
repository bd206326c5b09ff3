"""The thin queries over these operators, and their SQL where DuckDB can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, divergence, fingerprints, hilbert, licenses, linefreq, packing, pieces, simhash, substrings, topk, toxicity, variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_edits(_table(spark, sf_dir, "documents"))


def op2_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.cut_vectors(_table(spark, sf_dir, "embeddings"))
    return topk.search(topk.build_index(vectors), vectors.filter("vec_id % 50 = 0"))


def op3_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.curve_shards(_table(spark, sf_dir, "documents"))


def op5_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_report(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linefreq.drop_lines(docs).select("doc_id", "source", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.md5(F.coalesce("_kept", F.lit("")).cast("binary")).alias("kept_md5"))


def op7_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_documents(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op8_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op9_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.encode_report(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_syncmer_fingerprints, op2_impact_topk, op3_covering_simhash, op4_hilbert_shards, op5_piece_viterbi, op6_line_frequency, op7_weak_toxicity, op8_suffix_family, op9_license_diagonals, op10_bestfit_packing, op11_source_divergence, op12_byte_bpe, op13_spelling_variants)}


_OP2 = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
           where embedding is not null and vec_id is not null
             and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(cast(x as double)), false)))),
q as (select vec_id as query_id, v as w from v where vec_id % 50 = 0),
s as (select query_id, vec_id, cast(list_sum(list_transform(range(1, 1 + least(len(v), len(w))), lambda i: v[i] * w[i])) as bigint) as score
      from q join v on vec_id <> query_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rk, vec_id, score from s)
select query_id, cast(rk as integer) as rank, vec_id, score from r where rk <= 5
"""

_OP6 = """
with d as (select doc_id, source, text, coalesce(source, chr(1)) as host from documents),
l as (select distinct host, doc_id, trim(u.line, chr(32) || chr(9) || chr(13)) as bare
      from d, unnest(string_split(coalesce(text, ''), chr(10))) as u(line)),
h as (select host, count(*) as pages from d group by host),
f as (select l.host, bare from l join h on h.host = l.host where bare <> ''
      group by l.host, bare, pages having count(*) >= 5 and count(*) > 0.05 * pages),
k as (select host, list(bare) as bp from f group by host),
x as (select d.doc_id, d.source, d.text, string_split(d.text, chr(10)) as ls, coalesce(k.bp, cast([] as varchar[])) as bp from d left join k on k.host = d.host),
y as (select doc_id, source, text, ls, list_filter(ls, lambda z: not list_contains(bp, trim(z, chr(32) || chr(9) || chr(13)))) as kept from x)
select doc_id, source, cast(case when coalesce(text, '') = '' then 0 else len(ls) end as bigint) as n_lines,
       cast(case when coalesce(text, '') = '' then 0 else len(ls) - len(kept) end as bigint) as n_dropped,
       md5(coalesce(array_to_string(kept, chr(10)), '')) as kept_md5
from y
"""

_OP11 = r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as doc,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
           from documents),
o as (select lang, source, doc, unnest(terms) as term from d),
k as (select lang, term, count(*) as c from o group by lang, term having count(distinct doc) >= 10),
g as (select distinct lang, source from d),
c as (select o.lang, o.source, o.term, count(*) as c from o join k on k.lang = o.lang and k.term = o.term group by o.lang, o.source, o.term),
n as (select lang, source, sum(c) as n from c group by lang, source),
v as (select lang, count(*) as v, sum(c) as n from k group by lang),
s as (select g.lang, g.source, k.term, coalesce(c.c, 0) as c,
             1 + (1000000000::hugeint * (coalesce(c.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * v.v)::hugeint as p, 1 + (1000000000::hugeint * (k.c + 2)) // (v.n + 2 * v.v)::hugeint as q
      from g join k on k.lang = g.lang join v on v.lang = g.lang left join n on n.lang = g.lang and n.source = g.source
      left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
w as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
      from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
x as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(w.value, 0) as bigint) as value
      from g a join g b on a.lang = b.lang and a.source <> b.source left join w on w.lang = a.lang and w.source = a.source and w.item = b.source
      union all select lang, source, 'term', term, cast(((p - q) * (p - q)) // (p + q) as bigint) from s where c > 0 and p > q),
r as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from x)
select * from r where part = 'pair' or rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_impact_topk": _OP2, "op6_line_frequency": _OP6, "op11_source_divergence": _OP11}
