"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, cotrain, ctw, langid, lexical, merkle, near_dedup, packing, quality_rules, sentencepiece_codec, suffix_dedup, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.measure_repeats(_table(spark, sf_dir, "documents"), "doc_id", "text", length=400, passages=(200, 50, 300))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), "doc_id", "text", window=2048)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), "doc_id", "text", with_ids=False)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), "doc_id", "text", width=3, percent=85)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), "page_id", "url", "html").drop("file")


def op6_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return cotrain.score(docs, cotrain.fit(docs, _table(spark, sf_dir, "labels")))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op8_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(_table(spark, sf_dir, "documents"), "doc_id", "text", folds=5, held_fold=1)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.learn_rules(docs, _table(spark, sf_dir, "labels")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")), F.lit(4)) == 2, F.lit(True))
    model = langid.learn(docs.where(~held))
    return langid.identify(docs, model, [F.col("doc_id"), held.alias("held_out")])


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    even = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 2 == 0
    tampered = F.when(even, merkle.digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.translate("text", "\n", "")))
    return merkle.manifest(docs, "doc_id", "source", ("doc_id", "source", "lang", "n_chars", "text"), other=tampered, fanout=3)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), None, "doc_id", "text", limit=512)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_dedup, op2_packing, op3_sentencepiece, op4_near_dedup, op5_warc, op6_cotraining, op7_ann, op8_ctw, op9_quality_rules, op10_language_id, op11_merkle, op12_token_counts, op13_lexical_search)
}

_UPPER = "".join(map(chr, range(65, 91)))

#: SQL for the queries whose whole result it can express; the others are tested against brute force, exact round trips or held-out rows.
ORACLES: dict[str, str] = {
    "op4_near_dedup": f"""with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
 s as materialized (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as g from d),
 e as materialized (select doc_id, len(g) as n, unnest(g) as x from s),
 p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as k from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
 l as materialized (select a, b from p where 100 * k >= 85 * (n + m - k)),
 u as (select a, b from l union select b, a from l),
 r as (select doc_id as node, doc_id as other from documents union select r.node, u.b from r join u on u.a = r.other),
 c as (select node, min(other) as component_id from r group by 1)
 select doc_id, cast(len(g) as bigint) as n_shingles, component_id, doc_id = component_id as kept from s join c on node = doc_id""",
    "op11_merkle": """with recursive v as (select doc_id, source, concat(coalesce(octet_length(encode(doc_id::varchar))::varchar || ':' || doc_id, '-'), coalesce(octet_length(encode(source))::varchar || ':' || source, '-'), coalesce(octet_length(encode(lang))::varchar || ':' || lang, '-'), coalesce(octet_length(encode(n_chars::varchar))::varchar || ':' || n_chars, '-')) as h, text, replace(text, chr(10), '') as t2,
   list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) as crc from documents),
 l as materialized (select doc_id, source, sha256(h || coalesce(octet_length(encode(text))::varchar || ':' || text, '-')) as leaf, case when xor(crc, 4294967295) % 2 = 0 then sha256(h || coalesce(octet_length(encode(t2))::varchar || ':' || t2, '-')) end as other from v),
 p as materialized (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as n from l),
 t as (select source, 0 as lvl, pos as idx, leaf as d, n from p union all select source, lvl + 1, idx // 3, sha256(string_agg(d, '' order by idx)), (any_value(n) + 2) // 3 from t where n > 1 group by source, lvl, idx // 3),
 tree as materialized (select * from t),
 tops as materialized (select source, d as subroot, row_number() over (order by encode(source) nulls first) - 1 as pos, count(*) over () as n, lvl as height from tree where n = 1),
 u as (select 0 as lvl, pos as idx, subroot as d, n from tops union all select lvl + 1, idx // 3, sha256(string_agg(d, '' order by idx)), (any_value(n) + 2) // 3 from u where n > 1 group by lvl, idx // 3),
 upper as materialized (select * from u),
 way as materialized (select p.doc_id, p.leaf, p.pos as row_at, p.source, e.lvl, coalesce(string_agg(e.d, '' order by e.idx) filter (e.idx < p.pos // (3 ** e.lvl)::bigint), '') as lft, coalesce(string_agg(e.d, '' order by e.idx) filter (e.idx > p.pos // (3 ** e.lvl)::bigint), '') as rgt
   from p join tree e on e.source is not distinct from p.source and e.n > 1 and e.idx // 3 = p.pos // (3 ** (e.lvl + 1))::bigint group by all
  union all select p.doc_id, p.leaf, p.pos, p.source, o.height + e.lvl, coalesce(string_agg(e.d, '' order by e.idx) filter (e.idx < o.pos // (3 ** e.lvl)::bigint), ''), coalesce(string_agg(e.d, '' order by e.idx) filter (e.idx > o.pos // (3 ** e.lvl)::bigint), '')
   from p join tops o on o.source is not distinct from p.source join upper e on e.n > 1 and e.idx // 3 = o.pos // (3 ** (e.lvl + 1))::bigint group by all),
 proof as materialized (select source, row_at, list(lft order by lvl) as ls, list(rgt order by lvl) as rs, sha256(string_agg(lft || rgt, '' order by lvl)) as proof_sha256 from way group by all),
 f as (select p.source, pos, 0 as lvl, coalesce(other, leaf) as d, coalesce(len(ls), 0) as steps, ls, rs from p left join proof on proof.source is not distinct from p.source and row_at = pos union all select source, pos, lvl + 1, sha256(ls[lvl + 1] || d || rs[lvl + 1]), steps, ls, rs from f where lvl < steps)
 select p.doc_id, p.leaf, subroot, r.d as root, coalesce(proof_sha256, sha256('')) as proof_sha256, f.d as folded_root, f.d = r.d as verified from p join tops o on o.source is not distinct from p.source join f on f.source is not distinct from p.source and f.pos = p.pos and f.lvl = f.steps left join proof on proof.source is not distinct from p.source and row_at = p.pos cross join (select d from upper where n = 1) r""",
    "op13_lexical_search": f"""with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
 q as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
 s as (select count(*) filter (len(w) > 0) as nd, cast(sum(len(w)) as bigint) as l from d),
 e as (select doc_id, len(w) as n, unnest(w) as term from d),
 tf as materialized (select doc_id, n, term, count(*) as tf from e group by all),
 df as (select term, count(*) as df from tf group by 1),
 c as (select item_id, doc_id, cast(sum(cast(floor(1000 * ln(cast(2 * nd + 2 as double) / (2 * df + 1))) as bigint) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l)))) as bigint) as score from q join tf using (term) join df using (term), s group by all),
 r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from c where score > 0)
 select item_id, cast(rank as integer) as rank, doc_id, score from r where rank <= 50""",
    "op5_warc": """with p as (select page_id, url, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
 f as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
 select page_id, url, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id > first_id then 'revisit' else 'response' end as record_type, case when payload_bytes >= 100 and page_id > first_id then first_id end as refers_to from f""",
}
