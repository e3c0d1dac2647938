"""Queries that rank, recall, compare and walk: lexical and hybrid search, memories, evidence, reviewed links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import statements, text, vector
from tessera.operators import graph, relational, retrieval, stages
from tessera.operators.postings import Postings

from .analytics import Tables, query

_QUERY = ("erin", "thon", "src3", "the", "fr")
_TOK = r"[a-z0-9][a-z0-9._+\-]*"


def _tok_sql(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '{_TOK}'), lambda t: length(t) >= 2))"


def _hit_sql(x: str, q: str) -> str:
    return f"list_filter({q}, lambda t: list_contains({_tok_sql(x)}, t))"


def _points_sql(hit: str, w: int) -> str:
    return f"coalesce(list_sum(list_transform({hit}, lambda t: least(length(t), 4) * {w})), 0)"


_FIELDS_SQL = {"h1": ("left(text, 40)", 5), "h2": ("lang || ' ' || source", 8), "h3": ("substr(text, 41, 120)", 4), "h4": ("text", 1)}


def _lexical_sql(q: str, rows: str = "documents", more: str = "") -> str:
    hits = ", ".join(f"{_hit_sql(x, q)} as {n}" for n, (x, _) in _FIELDS_SQL.items())
    score = " + ".join(_points_sql(n, w) for n, (_, w) in _FIELDS_SQL.items())
    matched = "list_sort(list_distinct(h1 || h2 || h3 || h4))"
    return f"(select doc_id{more}, cast({score} as bigint) as score, array_to_string({matched}, ' ') as matched from (select doc_id{more}, {hits} from {rows}))"


def _fields() -> dict[str, tuple[Column, int]]:
    """Title, facts, tags and content of a document, and their weights: its first 40 characters, the next 120, its language and source, and all of it."""
    low = F.lower("text")
    return {"title": (F.substring(low, 1, 40), 5), "tags": (F.lower(F.concat_ws(" ", "lang", "source")), 8), "facts": (F.substring(low, 41, 120), 4), "content": (low, 1)}


def _lexical(docs: DataFrame, keep: list[str | Column], q: tuple[str, ...]) -> DataFrame:
    found = {n: (retrieval.found_tokens(c, q), w) for n, (c, w) in _fields().items()}
    return retrieval.lexical_matches(docs, keep, found, F.array(*[F.lit(x) for x in q]))


_Q_SQL = "[" + ", ".join(f"'{t}'" for t in _QUERY) + "]"
_CONF_SQL = "floor(least(score / 48.0, 1) * 1000 + 0.5) / 1000"


@query(f"select doc_id, score, matched, {_CONF_SQL} as confidence from {_lexical_sql(_Q_SQL)} where score >= 12")
def lexical_rank_fields(t: Tables) -> DataFrame:
    s = _lexical(t.documents, ["doc_id"], _QUERY)
    return retrieval.ranked(s, "doc_id", most=None).select("doc_id", "score", F.array_join("matched", " ").alias("matched"), "confidence")


def _index(t: Tables) -> Postings:
    """The stored index of the documents' fields, and of their words between blanks."""
    tokens = {n: F.when(F.col("text").isNotNull(), retrieval.search_tokens(c)) for n, (c, _) in _fields().items()}
    words = {"fts": F.split(F.lower("text"), r"\s+"), "alias": F.array(F.lower("source")), "facet": F.array(F.lower("lang"))}
    return Postings.build(t.documents, stages.shared_folder(t.spark), "doc_id", tokens | words, revision=t.sf_dir)


@query(f"select doc_id, score, matched from {_lexical_sql(_Q_SQL, '(select * from documents where text is not null)')} where score >= 6")
def indexed_rank(t: Tables) -> DataFrame:
    """Lexical scores from the stored index: once it is there, a query reads its own terms' buckets and no text."""
    found = _index(t).lexical(_QUERY, {n: w for n, (_, w) in _fields().items()}).where("score >= 6")
    return found.select(F.col("id").alias("doc_id"), "score", F.array_join("matched", " ").alias("matched"))


@query(f"with s as {_lexical_sql(_Q_SQL)}, k as (select case when max(score) >= 12 then 12 else 6 end as least_score from s) select doc_id, score, {_CONF_SQL} as confidence from s, k where score >= least_score order by score desc, doc_id limit 5")
def lexical_top_five(t: Tables) -> DataFrame:
    """The five best of 12 points or more; if none has that many, of 6 or more."""
    s = _lexical(t.documents, ["doc_id"], _QUERY).where("score >= 6")
    top = retrieval.ranked(s, "doc_id", least=6)
    best = F.max("score").over(Window.partitionBy(F.lit(1)))
    return top.withColumn("best", best).where((F.col("score") >= 12) | (F.col("best") < 12)).select("doc_id", "score", "confidence")


_HYBRID_SQL = f"""with q as (select embedding::double[] as qe from embeddings where vec_id = 0),
 l as {_lexical_sql(_Q_SQL)}, s as (select vec_id, greatest(-1, least(1, list_cosine_similarity(qe, embedding::double[]))) as cos, coalesce(score, 0)::double as lex, coalesce(matched, '') as matched from embeddings cross join q left join l on doc_id = vec_id),
 m as (select median(cos) as b from s),
 c as (select *, case when cos >= 0.2 and greatest(0, cos - b) >= 0.025 then least(1, greatest(0, greatest(0, cos - b) / greatest(0.05, 1 - b))) else 0 end as cal from s, m),
 r as (select *, 0.72 * cal + 0.28 * least(lex / 48.0, 1) as combined from c)
 select vec_id, cast(floor(100 * combined + 0.5) as bigint) as score, matched, case when lex >= 6 and cal >= 0.12 then 'HYBRID' when cal >= 0.12 then 'SEMANTIC' else 'LEXICAL' end as method
 from r where lex >= 6 or cal >= 0.12 or combined >= 0.24"""


@query(_HYBRID_SQL)
def hybrid_rank(t: Tables) -> DataFrame:
    """Similarity to one vector above the median, mixed with the lexical score of the document of the same id."""
    q = F.broadcast(t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("qe")).limit(1))
    lex = _lexical(t.documents, [F.col("doc_id").alias("vec_id")], _QUERY)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vector.cosine(F.col("qe"), F.col("embedding"))))
    s = t.embeddings.crossJoin(q).select("vec_id", cos.alias("cos")).join(lex, "vec_id", "left")
    s = s.select("vec_id", "cos", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("lex"), F.coalesce(F.array_join("matched", " "), F.lit("")).alias("matched"))
    s = stages.written(s)  # similarities and points are worked out once, however often the median looks at them
    base = retrieval.median_of(s, "cos")
    c = s.withColumn("cal", retrieval.calibrated(F.col("cos"), F.lit(base)))
    good = c.where(retrieval.relevant(F.col("cal"), F.col("lex")))
    return good.select("vec_id", F.floor(100 * retrieval.combined(F.col("cal"), F.col("lex")) + 0.5).cast("long").alias("score"), "matched", retrieval.method(F.col("lex"), F.col("cal"), 6, 0.12).alias("method"))


@query(_HYBRID_SQL + " order by score desc, vec_id limit 5")
def hybrid_top_five(t: Tables) -> DataFrame:
    from .analytics import QUERIES

    return QUERIES["hybrid_rank"](t.spark, t.sf_dir).orderBy(F.desc("score"), "vec_id").limit(5)


#: Sentences, and the kind that each tells.
_SAYINGS = (("我总是在端口设置上卡住。", "RECURRING_STRUGGLE"), ("我的同学学会了遮罩。", None), ("今天，我学会了遮罩！", "LEARNED_CONCEPT"), ("我更喜欢冷色吗？", None), ("我更喜欢冷色。", "PREFERENCE"), ("如果我喜欢红，就用红。", None), ("我正在设计装置。", "PROJECT_FACT"))
_KIND_ORDER = "['MISCONCEPTION_CORRECTED', 'RECURRING_STRUGGLE', 'LEARNED_CONCEPT', 'PREFERENCE', 'PROJECT_FACT']"
_SAYINGS_SQL = "[" + ", ".join(f"struct_pack(t := '{a}', k := " + (f"'{b}')" if b else "null)") for a, b in _SAYINGS) + "]"


@query(f"""with s as (select user_id, event_id, {_SAYINGS_SQL} as m from events),
 f as (select event_id, list_distinct(list_filter([m[event_id % 7 + 1].k, m[user_id % 7 + 1].k, m[(event_id * 3 + user_id) % 7 + 1].k], lambda x: x is not null)) as ks from s)
 select event_id, array_to_string(list_filter({_KIND_ORDER}, lambda x: list_contains(ks, x))[1:2], ',') as kinds from f""")
def stated_facts(t: Tables) -> DataFrame:
    """What three sentences say of their writer, personal data masked first: the first two kinds; questions, suppositions and what others do don't count."""
    n, u = F.col("event_id"), F.col("user_id")
    pick = lambda at: F.element_at(F.array(*[F.lit(a) for a, _ in _SAYINGS]), (at % len(_SAYINGS) + 1).cast("int"))
    said = F.concat(pick(n), F.lit("\n"), pick(u), F.lit(" "), pick(n * 3 + u))
    made = statements.explicit_statements(text.redact(said), 2)
    return t.events.select("event_id", F.array_join(F.transform(made, lambda s: s["kind"]), ",").alias("kinds"))


_ODD_VECTOR_SQL = "case vec_id % 4 when 0 then embedding::double[] when 1 then null when 2 then list_transform(embedding::double[], lambda x: 0.0) else list_slice(embedding::double[], 1, len(embedding) - 1) end"


@query(f"with d as (select max(len(embedding)) as dim from embeddings), v as (select vec_id, {_ODD_VECTOR_SQL} as v, dim from embeddings, d) select vec_id, case when v is null then 'UNAVAILABLE' when len(v) <> dim or len(list_filter(v, lambda x: x <> 0)) = 0 then 'FAILED' else 'USED' end as status, v is null or len(v) <> dim or len(list_filter(v, lambda x: x <> 0)) = 0 as lexical_only from v")
def retrieval_status(t: Tables) -> DataFrame:
    """Whether a query's vector can be used; without one, or with a bad one, ranking falls back to words."""
    e = F.col("embedding").cast("array<double>")
    k = F.col("vec_id") % 4
    odd = F.when(k == 0, e).when(k == 2, F.transform(e, lambda x: F.lit(0.0))).when(k == 3, F.slice(e, 1, F.size(e) - 1))
    v = t.embeddings.crossJoin(F.broadcast(t.embeddings.agg(F.max(F.size("embedding")).alias("dim")))).select("vec_id", odd.alias("v"), "dim")
    status = F.when(F.col("v").isNull(), "UNAVAILABLE").when((F.size("v") != F.col("dim")) | ~vector.is_valid(F.col("v")), "FAILED").otherwise("USED")
    return v.select("vec_id", status.alias("status"), (status != "USED").alias("lexical_only"))


_MEMORY_SQL = f"""with m as (select conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as body, {_tok_sql("text")} as tok, turn % 11 as salience, greatest(0, 400 - turn * 7 - conv_id % 13) as age from conversations where role <> 'system'),
 q as (select conv_id, body as qb, tok as qt, turn as q_turn from m qualify row_number() over (partition by conv_id order by turn desc) = 1),
 s as (select conv_id, turn, salience, age, coalesce(list_sum(list_transform(list_intersect(qt, tok), lambda x: case when length(x) > 2 then 3 else 2 end)), 0) + case when length(qb) >= 4 and length(body) >= 4 and (contains(qb, body) or contains(body, qb)) then 8 else 0 end as lex from m join q using (conv_id) where turn <> q_turn),
 c as (select conv_id, turn, round((0.9 * least(1, lex / 24.0) + 0.1 * salience / 10.0) * (0.8 + 0.2 * pow(0.5, age / 30.0)), 6) as confidence from s where lex > 0)
 select conv_id, turn, confidence, 'M' || row_number() over (partition by conv_id order by confidence desc, turn desc) as alias from c qualify row_number() over (partition by conv_id order by confidence desc, turn desc) <= 4"""


def _memories(t: Tables) -> DataFrame:
    body = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    age = F.greatest(F.lit(0), 400 - F.col("turn") * 7 - F.col("conv_id") % 13)
    return t.conversations.where("role <> 'system'").select("conv_id", "turn", body.alias("body"), (F.col("turn") % 11).alias("salience"), age.alias("age"))


@query(_MEMORY_SQL)
def memory_rank(t: Tables) -> DataFrame:
    """The four notes of a conversation that best match its last one, by shared tokens, salience and age."""
    m = _memories(t)
    q = relational.latest_per_key(m, ["conv_id"], [F.desc("turn")]).select("conv_id", F.col("body").alias("q"), F.col("turn").alias("q_turn"))
    j = m.join(q, "conv_id").where("turn <> q_turn")
    s = retrieval.once(j, ["conv_id", "turn", "salience", "age"], lex=retrieval.memory_overlap(F.col("q"), F.col("body"))).where("lex > 0")
    conf = F.round((0.9 * F.least(F.lit(1.0), F.col("lex") / 24.0) + 0.1 * F.col("salience") / 10.0) * retrieval.recency(F.col("age")), 6)
    w = Window.partitionBy("conv_id").orderBy(F.desc("confidence"), F.desc("turn"))
    top = s.select("conv_id", "turn", conf.alias("confidence")).withColumn("rn", F.row_number().over(w)).where("rn <= 4")
    return top.select("conv_id", "turn", "confidence", F.concat(F.lit("M"), F.col("rn")).alias("alias"))


_MEMORY_HYBRID_SQL = f"""with m as (select vec_id, label, embedding::double[] as e, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as body, {_tok_sql("text")} as tok, vec_id % 11 as salience, vec_id % 90 as age from embeddings join documents on doc_id = vec_id),
 q as (select label, vec_id as q_id, e as qe, body as qb, tok as qt from m qualify row_number() over (partition by label order by vec_id) = 1),
 j as (select label, vec_id, salience, age, greatest(-1, least(1, list_cosine_similarity(qe, e))) as cos, coalesce(list_sum(list_transform(list_intersect(qt, tok), lambda x: case when length(x) > 2 then 3 else 2 end)), 0) + case when length(qb) >= 4 and length(body) >= 4 and (contains(qb, body) or contains(body, qb)) then 8 else 0 end as lex from m join q using (label) where vec_id <> q_id),
 b as (select label, median(cos) as base, count(cos) as known from j group by 1),
 s as (select *, case when known = 1 then case when cos >= 0.35 then least(1, (cos - 0.35) / 0.65) else 0 end when cos >= 0.3 and greatest(0, cos - base) >= 0.03 then least(1, greatest(0, cos - base) / greatest(0.05, 1 - base)) else 0 end as sem from j join b using (label))
 select label, vec_id, round((0.78 * sem + 0.17 * least(1, lex / 24.0) + 0.04 * salience / 10.0) * (0.8 + 0.2 * pow(0.5, age / 30.0)), 6) as confidence, case when lex > 0 and sem >= 0.08 then 'HYBRID' when sem >= 0.08 then 'SEMANTIC' else 'LEXICAL' end as method from s where sem >= 0.08 or lex > 0
 qualify row_number() over (partition by label order by round((0.78 * sem + 0.17 * least(1, lex / 24.0) + 0.04 * salience / 10.0) * (0.8 + 0.2 * pow(0.5, age / 30.0)), 6) desc, vec_id) <= 4"""


@query(_MEMORY_HYBRID_SQL)
def memory_rank_hybrid(t: Tables) -> DataFrame:
    """As :func:`memory_rank`, with similarity above each holder's median."""
    body = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    d = t.documents.select(F.col("doc_id").alias("vec_id"), body.alias("body"))
    m = t.embeddings.join(d, "vec_id").select("vec_id", "label", "embedding", "body", (F.col("vec_id") % 11).alias("salience"), (F.col("vec_id") % 90).alias("age"))
    q = m.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding", "body"), "vec_id").alias("q"))
    j = m.join(q, "label").where("vec_id <> q.vec_id")
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vector.cosine(F.col("q.embedding"), F.col("embedding"))))
    s = retrieval.once(j, ["label", "vec_id", "salience", "age"], cos=cos, lex=retrieval.memory_overlap(F.col("q.body"), F.col("body")))
    s = stages.written(s)
    known = s.groupBy("label").agg(F.count("cos").alias("known"))
    b = known.join(retrieval.medians(s, ["label"], "cos").withColumnRenamed("median", "base"), "label", "left")
    s = s.join(b, "label").withColumn("sem", retrieval.memory_similarity(F.col("cos"), F.col("base"), F.col("known"))).where("sem >= 0.08 or lex > 0")
    conf = F.round((0.78 * F.col("sem") + 0.17 * F.least(F.lit(1.0), F.col("lex") / 24.0) + 0.04 * F.col("salience") / 10.0) * retrieval.recency(F.col("age")), 6)
    made = s.select("label", "vec_id", conf.alias("confidence"), retrieval.method(F.col("lex"), F.col("sem"), 1, 0.08).alias("method"))
    return relational.latest_per_key(made, ["label"], [F.desc("confidence"), F.asc("vec_id")], 4)


_FUSION_SQL = f"""with q as (select embedding::double[] as qe from embeddings where vec_id = 1), l as {_lexical_sql(_Q_SQL)}, a as (select doc_id, lang from documents where lang in ('en', 'fr')),
 s as (select vec_id, (list_cosine_similarity(qe, embedding::double[]) + 1) / 2 as image, least(1, 0.65 * greatest(0, list_cosine_similarity(qe, embedding::double[])) + 0.35 * least(1, score / 48.0)) as txt, vec_id % 3 as channel from embeddings cross join q join a on a.doc_id = vec_id join l on l.doc_id = vec_id)
 select vec_id, round(case channel when 0 then 0.58 * image + 0.42 * txt when 1 then image else txt end, 4) as score from s where channel <> 2 or txt >= 0.035"""


@query(_FUSION_SQL)
def multimodal_fusion(t: Tables) -> DataFrame:
    """Picture and text channels of active entries of a topic; a third of the entries has both, a third each only one."""
    q = F.broadcast(t.embeddings.where("vec_id = 1").select(F.col("embedding").alias("qe")).limit(1))
    active = t.documents.where(F.col("lang").isin("en", "fr"))
    lex = _lexical(active, [F.col("doc_id").alias("vec_id")], _QUERY).select("vec_id", F.col("score").alias("lex"))
    s = t.embeddings.crossJoin(q).select("vec_id", vector.cosine(F.col("qe"), F.col("embedding")).alias("cos")).join(lex, "vec_id")
    channel = F.col("vec_id") % 3
    txt = F.when(channel != 1, F.least(F.lit(1.0), 0.65 * F.greatest(F.lit(0.0), F.col("cos")) + 0.35 * F.least(F.lit(1.0), F.col("lex") / 48.0)))
    image = F.when(channel != 2, (F.col("cos") + 1) / 2)
    made = s.select("vec_id", txt.alias("txt"), image.alias("image")).where("image is not null or txt >= 0.035")
    return made.select("vec_id", F.round(retrieval.fused(F.col("txt"), F.col("image")), 4).alias("score"))


_TERMS = {"fts": "text", "alias": "source", "facet": "lang"}
_SEED_TOKENS = ("fr", "src3", "and")


@query("with d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') as fts, lower(source) as alias, lower(lang) as facet from documents), h as (select doc_id, case when " + " or ".join(f"list_contains(fts, '{x}')" for x in _SEED_TOKENS) + " then 'FTS' end as f, case when alias in ('fr', 'src3', 'and') then 'ALIAS' end as a, case when facet in ('fr', 'src3', 'and') then 'FACET' end as c from d) select doc_id, concat_ws(',', a, c, f) as matched_by from h where coalesce(a, c, f) is not null")
def seed_search(t: Tables) -> DataFrame:
    """Documents that hold a query token as a whole word, alias or facet; parts of words don't count."""
    tokens = F.array(*[F.lit(x) for x in _SEED_TOKENS])
    words = F.split(F.lower("text"), r"\s+")
    modes = F.array(
        F.when(F.array_contains(tokens, F.lower("source")), "ALIAS"), F.when(F.array_contains(tokens, F.lower("lang")), "FACET"), F.when(F.arrays_overlap(words, tokens), "FTS"),
    )
    made = retrieval.once(t.documents, ["doc_id"], modes=F.array_compact(modes)).where("size(modes) > 0")
    return made.select("doc_id", F.array_join("modes", ",").alias("matched_by"))


@query("with d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') as fts, lower(source) as alias, lower(lang) as facet from documents), h as (select doc_id, case when " + " or ".join(f"list_contains(fts, '{x}')" for x in _SEED_TOKENS) + " then 'FTS' end as f, case when alias in ('fr', 'src3', 'and') then 'ALIAS' end as a, case when facet in ('fr', 'src3', 'and') then 'FACET' end as c from d) select doc_id, concat_ws(',', a, c, f) as matched_by from h where coalesce(a, c, f) is not null")
def indexed_seed_search(t: Tables) -> DataFrame:
    """As :func:`seed_search`, from the stored index."""
    hits = _index(t).lookup(_SEED_TOKENS).where(F.col("field").isin("fts", "alias", "facet"))
    return hits.groupBy(F.col("id").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_set(F.upper("field"))), ",").alias("matched_by"))


@query(r"with w as (select conv_id, turn, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9._+\-]{2,}')), lambda x: x not in ('the', 'and', 'for', 'with', 'how', 'what')) as tok, lag(lower(text)) over (partition by conv_id order by turn) as corpus from conversations) select conv_id, turn, cast(len(tok) as bigint) as tokens, len(tok) >= 2 and len(list_filter(tok, lambda x: contains(corpus, x))) = 0 as vetoed from w where corpus is not null")
def technical_veto(t: Tables) -> DataFrame:
    """A question of two technical words or more, none of which the found texts hold, gets no answer."""
    tok = F.array_except(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z][a-z0-9._+\-]{2,})"), 1)), F.array(*[F.lit(x) for x in retrieval.PLAIN_WORDS]))
    w = t.conversations.select("conv_id", "turn", tok.alias("tok"), F.lag(F.lower("text")).over(Window.partitionBy("conv_id").orderBy("turn")).alias("corpus")).where("corpus is not null")
    hit = F.exists("tok", lambda x: F.contains(F.col("corpus"), x))
    return w.select("conv_id", "turn", F.size("tok").cast("long").alias("tokens"), ((F.size("tok") >= 2) & ~hit).alias("vetoed"))


@query("with w as (select conv_id, turn, trim(text) as body, lag(text) over (partition by conv_id order by turn) as prior from conversations where role = 'user') select conv_id, turn, md5(case when length(body) <= 120 and regexp_matches(lower(body), '(^|[^a-z])(and|then|it|un|und|ist|la|de)([^a-z]|$)') and prior is not null then prior || ' ' || body else body end) as question from w")
def follow_up_rewrite(t: Tables) -> DataFrame:
    """A short question that leans on the one before is asked together with it."""
    w = t.conversations.where("role = 'user'").select("conv_id", "turn", F.trim("text").alias("body"), F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("prior"))
    leans = (F.length("body") <= 120) & F.lower("body").rlike(r"(^|[^a-z])(and|then|it|un|und|ist|la|de)([^a-z]|$)") & F.col("prior").isNotNull()
    return w.select("conv_id", "turn", F.md5(F.when(leans, F.concat_ws(" ", "prior", "body")).otherwise(F.col("body"))).alias("question"))


@query("with s as (select user_id, event_id, event_type, row_number() over (partition by user_id order by value desc, event_id) as rn, bool_or(event_type <> 'view') over (partition by user_id) as specific from events where event_type <> 'error') select user_id, event_id, rn <= 2 as kept, event_type = 'view' and specific as generic from s")
def source_minimisation(t: Tables) -> DataFrame:
    """Of each answer's sources the two best stay; general ones are told apart where a specific one is there."""
    own = Window.partitionBy("user_id")
    s = t.events.where("event_type <> 'error'").select("user_id", "event_id", "event_type", F.row_number().over(own.orderBy(F.desc("value"), "event_id")).alias("rn"), F.bool_or(F.col("event_type") != "view").over(own).alias("specific"))
    return s.select("user_id", "event_id", (F.col("rn") <= 2).alias("kept"), ((F.col("event_type") == "view") & F.col("specific")).alias("generic"))


_NOTE_SQL = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"


#: Letters as Han characters, so that a third of the texts is Han.
_LETTERS, _HAN = "abcdefghijklmnopqrstuvwxyz", "光影动画城市声音色彩节奏空间时序材料触觉剧场故事"
_SAID_SQL = f"case when doc_id % 3 = 0 then translate(lower(text), '{_LETTERS}', '{_HAN}') else text end"
_CORE_SQL = rf"regexp_replace(regexp_replace(c, '{text.FILLER}', '', 'g'), '[\p{{P}}\p{{S}}\s]', '', 'g')"


@query(rf"""with d as (select doc_id, lang, source, lower(trim(regexp_replace({_SAID_SQL}, '\s+', ' ', 'g'))) as c from documents where text is not null),
 k as (select lang, source, c, min(doc_id) as class_id, {_CORE_SQL} as core from d group by 1, 2, 3),
 s as (select *, regexp_matches(c, '{text.NEGATIVE}') as neg, regexp_extract_all(c, '\d+(?:\.\d+)?') as num, list_distinct(regexp_extract_all(core, '[a-z0-9]+') || regexp_extract_all(core, '\p{{Han}}')) as units,
  list_distinct(flatten(list_transform(regexp_extract_all(core, '\p{{Han}}{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda i: r[i:i + 1])))) as pairs from k),
 p as (select a.class_id as x, b.class_id as y, len(list_intersect(a.units, b.units)) as k, len(a.units) as n, len(b.units) as m, len(list_intersect(a.pairs, b.pairs)) as pk, least(len(a.pairs), len(b.pairs)) as pl from s a join s b on a.lang = b.lang and a.source = b.source and a.class_id < b.class_id and a.neg = b.neg and a.num = b.num where least(len(a.units), len(b.units)) >= 3 and least(len(a.units), len(b.units)) >= 0.8 * greatest(len(a.units), len(b.units))),
 l as (select x, y from p where k / least(n, m) >= 0.9 and k / (n + m - k) >= 0.8 and (pl < 2 or pk / pl >= 0.8)),
 c as (select class_id, count(*) as links from (select x as class_id from l union all select y from l) group by 1)
 select doc_id, s.class_id, coalesce(links, 0) as links from d join s using (lang, source, c) left join c on c.class_id = s.class_id""")
def near_duplicates(t: Tables) -> DataFrame:
    """Within a language and source: each text's class of equal texts, and how many other classes tell the same; a third of the texts in Han characters."""
    said = F.when(F.col("doc_id") % 3 == 0, F.translate(F.lower("text"), _LETTERS, _HAN)).otherwise(F.col("text"))
    c = F.lower(F.trim(F.regexp_replace(said, r"\s+", " ")))
    notes = t.documents.where("text is not null").select("doc_id", "lang", "source", c.alias("note"))
    return retrieval.near_duplicate_classes(notes, ["lang", "source"], "doc_id", "note")


@query("with h as (select user_id, event_type, event_id, ts, cast(json_extract_string(props, '$.k') as bigint) % 11 as fresh from events) select user_id, event_type, cast(list_reduce(list(fresh order by ts, event_id), lambda s, x: least(10, greatest(s + 1, x))) as bigint) as salience, arg_max(event_id, (ts, event_id)) as last_source from h group by 1, 2")
def merged_salience(t: Tables) -> DataFrame:
    """A note told again gains one point of salience or takes the new one's, up to ten.

    Told in order, that is the greatest of every telling's salience plus the
    number of tellings after it, so no fold is needed.
    """
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = t.events.select("user_id", "event_type", "event_id", "ts", (F.get_json_object("props", "$.k").cast("bigint") % 11).alias("fresh"), (F.row_number().over(w) - 1).alias("later"))
    return rows.groupBy("user_id", "event_type").agg(F.least(F.lit(10).cast("long"), F.max(F.col("fresh") + F.col("later"))).alias("salience"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_source"))


#: The tools' paths, for hands-on control, for pictures in real time and for both; requirements order them as the query says.
TOOL_PATHS = ("DIGISHOW", "TOUCHDESIGNER", "COLLABORATIVE")


@query("select p_partkey, case when p_size > 25 and p_retailprice > 1200 then 'COLLABORATIVE' when p_size > 25 then (case when p_partkey % 5 = 0 then 'COLLABORATIVE' else 'DIGISHOW' end) when p_retailprice > 1200 then (case when p_size % 3 = 0 then (case when p_partkey % 5 = 0 then 'TOUCHDESIGNER' else 'DIGISHOW' end) else 'TOUCHDESIGNER' end) else (case when p_partkey % 5 = 0 then 'TOUCHDESIGNER' else 'DIGISHOW' end) end as path from part")
def tool_path(t: Tables) -> DataFrame:
    """The first candidate, in the order that the requirements give, that is allowed."""
    physical, visual, both = (F.lit(x) for x in TOOL_PATHS)
    hands, screen = F.col("p_size") > 25, F.col("p_retailprice") > 1200
    order = F.when(hands & screen, F.array(both)).when(hands, F.array(physical, both)).when(screen & (F.col("p_size") % 3 == 0), F.array(physical, visual, both)).when(screen, F.array(visual, both, physical)).otherwise(F.array(physical, visual, both))
    allowed = F.when(F.col("p_partkey") % 5 == 0, F.array(visual, both)).otherwise(F.array(physical, visual, both))
    return t.part.select("p_partkey", F.try_element_at(F.filter(order, lambda x: F.array_contains(allowed, x)), F.lit(1)).alias("path"))


@query("""with h as (select user_id, count(*) as hints, max(event_id) as mark from events where event_type = 'error' group by 1),
 e as (select user_id, event_id, cast(json_extract_string(props, '$.k') as bigint) as digest from events where event_type = 'purchase'),
 n as (select e.user_id, min(e.event_id) as evidence from e join h on h.user_id = e.user_id where h.hints >= 2 and e.event_id > h.mark and not exists (select 1 from e p where p.user_id = e.user_id and p.digest = e.digest and p.event_id <= h.mark) group by 1)
 select u.user_id, case when hints is null then 1 when evidence is not null then 3 else 2 end as level, evidence from (select distinct user_id from events) u left join h on h.user_id = u.user_id left join n on n.user_id = u.user_id""")
def hint_levels(t: Tables) -> DataFrame:
    """No hint yet: level 1.  Two or more, and evidence not seen before above the last hint's mark: level 3.  Else level 2."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    h = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("hints"), F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("mark"))
    e = t.events.where("event_type = 'purchase'").groupBy("user_id", k.alias("digest")).agg(F.min("event_id").alias("first"))
    # A digest is new if even its first evidence is above the mark.
    n = e.join(h, "user_id").where("hints >= 2 and first > mark").groupBy("user_id").agg(F.min("first").alias("evidence"))
    level = F.when(F.col("hints") == 0, 1).when(F.col("evidence").isNotNull(), 3).otherwise(2)
    return h.join(n, "user_id", "left").select("user_id", level.alias("level"), "evidence")


#: What is asked of each third of the users: of a fault, of none that any fact fits, and of one that no fact fits.
_ASKED = ("why did the purchase in the checkout fail with 42 and red light", "which colours does the poster have", "ＣＨＥＣＫＯＵＴ 没反应, nothing else")
#: Words of a question that looks for a fault.
FAULT_WORDS = ("不动", "没反应", "没有变化", "未变化", "故障", "排查")
_ASKED_SQL = "(case user_id % 3 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(("why did the purchase in the checkout fail with 42 and red light", "which colours does the poster have", "checkout 没反应, nothing else"))) + " end)"


@query(f"""with q as (select *, {_ASKED_SQL} as asked, 'the ' || event_type || ' light was ' || props || case when event_id % 2 = 0 then ' 画面没反应' else '' end as statement from events),
 f as (select user_id, event_id, asked, case when value > 50 then 1 else 0 end + case when contains(asked, event_type) then 8 else 0 end + 4 * (case when event_type = 'error' and contains(asked, 'fail') then 1 else 0 end + case when event_type = 'error' and contains(asked, 'crash') then 1 else 0 end + case when event_type = 'view' and contains(asked, 'light') then 1 else 0 end) + least(3, len(list_filter(regexp_extract_all(lower(statement), '[a-z][a-z0-9._+\\-]{{2,}}|\\p{{Han}}{{2,6}}'), lambda x: contains(asked, x)))) as score from q),
 d as (select *, max(score) over (partition by user_id) >= 4 as direct from f)
 select user_id, event_id, cast(score as bigint) as score from d where score >= 4 or (not direct and user_id % 3 = 2) qualify row_number() over (partition by user_id order by score desc, event_id desc) <= 5""")
def evidence_fact_rank(t: Tables) -> DataFrame:
    """The five facts of each user that a question asks for: checked ones, named labels, hints at their layer, shared words.

    If none fits well, all of them stand for a question that looks for a fault, and none for any other.
    """
    asked = F.lower(text.nfkc(F.element_at(F.array(*map(F.lit, _ASKED)), (F.col("user_id") % 3 + 1).cast("int"))))
    hints = {"error": ("fail", "crash"), "view": ("light",)}
    statement = F.concat(F.lit("the "), "event_type", F.lit(" light was "), "props", F.when(F.col("event_id") % 2 == 0, " 画面没反应").otherwise(""))
    rows = retrieval.once(t.events, ["user_id", "event_id", "event_type", "value"], asked=asked, words=F.regexp_extract_all(F.lower(statement), F.lit(r"([a-z][a-z0-9._+\-]{2,}|\p{IsHan}{2,6})"), 1))
    asked = F.col("asked")
    layer = sum((F.when((F.col("event_type") == k) & F.contains(asked, F.lit(h)), 4).otherwise(0) for k, hs in hints.items() for h in hs), F.lit(0))
    shared = F.least(F.lit(3), F.size(F.filter("words", lambda x: F.contains(F.col("asked"), x))))
    score = F.when(F.col("value") > 50, 1).otherwise(0) + F.when(F.contains(asked, F.col("event_type")), 8).otherwise(0) + layer + shared
    fault = asked.rlike("|".join(FAULT_WORDS))
    scored = retrieval.once(rows, ["user_id", "event_id"], score=score.cast("long"), fault=fault)
    kept = scored.withColumn("best", F.max("score").over(Window.partitionBy("user_id"))).where("score >= 4 or (best < 4 and fault)")
    return relational.latest_per_key(kept, ["user_id"], [F.desc("score"), F.desc("event_id")], 5).select("user_id", "event_id", "score")


# Reviewed links: pages are users, links join the users of neighbouring events.

_LINKS_SQL = "(select event_id as link, user_id as a, lead(user_id) over (order by event_id) as b, event_type as kind, ts as valid_from, case when event_id % 3 = 0 then ts + interval 5 day end as valid_until from events)"
_NOW_SQL = "timestamp '2024-01-20'"
_OPEN_SQL = f"(select link, a, b from {_LINKS_SQL} where kind in ('view', 'click') and a <> b and a % 7 <> 0 and b % 7 <> 0 and valid_from <= {_NOW_SQL} and (valid_until is null or {_NOW_SQL} <= valid_until))"


def _links(t: Tables) -> DataFrame:
    """Links between the users of events of neighbouring ids; joined by id, so no window over all rows."""
    e = t.events.select(F.col("event_id").alias("link"), F.col("user_id").alias("a"), F.col("event_type").alias("kind"), F.col("ts").alias("valid_from"))
    follow = t.events.select((F.col("event_id") - 1).alias("link"), F.col("user_id").alias("b"))
    until = F.when(F.col("link") % 3 == 0, F.col("valid_from") + F.expr("interval 5 days"))
    return e.join(follow, "link", "left").withColumn("valid_until", until)


def _open_links(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seeds, visible pages, and the links that are current and of an allowed kind."""
    pages = t.events.select(F.col("user_id").alias("page")).distinct().where("page % 7 <> 0")
    live = graph.current_links(_links(t).where("kind in ('view', 'click')"), F.lit("2024-01-20").cast("timestamp_ntz"))
    return pages.where("page % 10 = 1"), pages, live.select("link", "a", "b")


_WAYS_SQL = f"""with l as {_OPEN_SQL}, u as (select link, a as page, b as "to" from l union all select link, b, a from l), s as (select distinct user_id as page from events where user_id % 10 = 1 and user_id % 7 <> 0),
 w1 as (select u."to" as page, s.page as origin, [u.link] as links, [s.page, u."to"] as pages from s join u on u.page = s.page),
 f1 as (select * from w1 where page not in (select page from s) qualify row_number() over (partition by page order by origin, links) = 1),
 w2 as (select u."to" as page, f.origin, list_append(f.links, u.link) as links from f1 f join u on u.page = f.page where not list_contains(f.pages, u."to") and not list_contains(f.links, u.link)),
 w as (select page, origin, links from w1 union select page, origin, links from w2)"""


@query(_WAYS_SQL + " select page, origin, array_to_string(links, '>') as way from w")
def graph_paths(t: Tables) -> DataFrame:
    """Every way of at most two current links of the allowed kinds from the seeds, over visible pages only."""
    return graph.paths_within(*_open_links(t), 2).select("page", "origin", F.array_join("links", ">").alias("way"))


@query(_WAYS_SQL + """, r as (select *, row_number() over (partition by page order by len(links), origin, links) as rn from w), g as (select page, cast(count(*) as int) as ways, string_agg(array_to_string(links, '>'), ' ' order by rn) as paths from r where rn <= 8 group by 1)
 select page, s.page is not null as seed, coalesce(ways, 0) as ways, coalesce(paths, '') as paths from s full join g using (page) order by seed desc, page limit 12""")
def graph_results(t: Tables) -> DataFrame:
    seeds, pages, links = _open_links(t)
    found = graph.found_pages(seeds, graph.paths_within(seeds, pages, links, 2, most=8), 12)
    return found.select("page", "seed", "ways", F.coalesce(F.array_join(F.transform("paths", lambda w: F.array_join(w, ">")), " "), F.lit("")).alias("paths"))


@query(f"select least(a, b) as x, greatest(a, b) as y, kind, count(*) as n from {_LINKS_SQL} where b is not null group by 1, 2, 3 having count(*) > 1")
def repeated_logical_links(t: Tables) -> DataFrame:
    return graph.repeated_links(_links(t).where("b is not null"))


_EDGES_SQL = "(select distinct p_size as a, 100 + p_partkey % 60 as b from part where p_partkey % 3 = 0)"


@query(f"with recursive e as {_EDGES_SQL}, u as (select a, b from e union select b, a from e), r as (select a as node, a as other from u union select r.node, u.b from r join u on u.a = r.other), c as (select node, min(other) as comp from r group by 1), n as (select comp, count(*) as nodes from c group by 1), l as (select comp, count(*) as links from e join c on node = a group by 1) select cast(comp as bigint) as comp, nodes, links from n join l using (comp) where links >= nodes")
def link_forest_check(t: Tables) -> DataFrame:
    """Groups of linked pages that hold a cycle; none, if the links are a forest."""
    e = t.part.where("p_partkey % 3 = 0").select(F.col("p_size").cast("long").alias("a"), (100 + F.col("p_partkey") % 60).alias("b"))
    return graph.cyclic_components(e)


_VERSIONS_SQL = "(select event_id as id, case when event_id % 50 = 0 then event_id + 1000000 when event_id % 40 = 0 then event_id - 2 when event_id % 90 = 7 then event_id + 1 when event_id % 90 = 8 then event_id - 1 when event_id % 5 <> 0 then event_id - 1 end as prior, ts from events)"


@query(f"""with recursive v as materialized {_VERSIONS_SQL}, c as (select id as root, prior as at, 1 as n from v where prior in (select id from v) union all select c.root, v.prior, c.n + 1 from c join v on v.id = c.at where v.prior is not null and c.n < 12)
 select id, 'UNKNOWN_PRIOR' as fault from v where prior is not null and prior not in (select id from v) union all select prior, 'FORK' from v where prior is not null group by 1 having count(*) > 1 union all select distinct root, 'CYCLE' from c where n >= 12 union all select v.id, 'TIME_ORDER' from v join v p on p.id = v.prior where v.ts < p.ts""")
def version_chain_faults(t: Tables) -> DataFrame:
    i = F.col("event_id")
    prior = F.when(i % 50 == 0, i + 1000000).when(i % 40 == 0, i - 2).when(i % 90 == 7, i + 1).when(i % 90 == 8, i - 1).when(i % 5 != 0, i - 1)
    return graph.chain_faults(t.events.select(i.alias("id"), prior.alias("prior"), "ts"), "id", "prior", "ts")


_SURFACES = ("BROWSE", "SEARCH", "TOOL", "PROMPT", "RENDER", "RETRY", "PREVIEW")
_SHOWN_SQL = "(select surface, p_partkey as node, p_brand from part, (values " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(_SURFACES)) + ") s(i, surface) where p_size > 10 + i * 4 and p_retailprice > 400)"


def _shown(t: Tables) -> DataFrame:
    """Pages by the surfaces that may show them; each surface asks for more."""
    surfaces = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("surface")) for i, s in enumerate(_SURFACES)]))
    return t.part.where("p_retailprice > 400").select(F.col("p_partkey").alias("node"), "p_brand", "p_size", surfaces.alias("s")).where("p_size > 10 + s.i * 4").select("s.surface", "node", "p_brand")


@query(f"select surface, p_brand, count(*) as pages, min(node) as first_page, max(node) as last_page from {_SHOWN_SQL} group by 1, 2")
def exposure_surfaces(t: Tables) -> DataFrame:
    return _shown(t).groupBy("surface", "p_brand").agg(F.count(F.lit(1)).alias("pages"), F.min("node").alias("first_page"), F.max("node").alias("last_page"))


@query(f"select surface, count(*) as lost from {_SHOWN_SQL} where node in (select p_partkey from part where p_size = 27) group by 1")
def restriction_surfaces(t: Tables) -> DataFrame:
    """Which surfaces showed a page that is now held back."""
    return graph.invalidated_surfaces(_shown(t), t.part.where("p_size = 27").select(F.col("p_partkey").alias("node")))
