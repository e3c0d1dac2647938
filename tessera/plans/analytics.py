"""The registered analytics queries over the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import design, text, vector
from tessera.operators import graph, relational, retrieval
from tessera.streaming import folds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

STATUSES = ("F", "O", "P", "X")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


class Tables:
    """Attribute access to the Parquet tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return run

    return register


def _current(t: Tables) -> DataFrame:
    return relational.latest_per_key(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


_CURRENT = "(select * from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)"
_EVENT_K = "cast(json_extract_string(props, '$.k') as bigint)"


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


@query(f"""select c_mktsegment as segment, count(*) as participants, count(o_orderkey) as current_projects,
  cast(coalesce(sum(case when o_orderstatus = 'F' then 1 else 0 end), 0) as bigint) as completed,
  case when count(o_orderkey) > 0 then floor(coalesce(sum(case when o_orderstatus = 'F' then 1 else 0 end), 0) / count(o_orderkey) * 1000.0 + 0.5) / 1000.0 end as completion_rate,
  round(avg(o_totalprice), 2) as average_price
  from customer left join {_CURRENT} o on o_custkey = c_custkey group by 1""")
def pilot_report_summary(t: Tables) -> DataFrame:
    done = F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)), F.lit(0))
    j = t.customer.join(_current(t), F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("participants"), F.count("o_orderkey").alias("current_projects"), done.alias("completed"),
        relational.safe_rate(done, F.count("o_orderkey")).cast("double").alias("completion_rate"), F.round(F.avg("o_totalprice"), 2).alias("average_price"))


@query(f"select o_custkey, o_orderkey, o_orderstatus, o_orderdate from {_CURRENT}")
def latest_order_per_customer(t: Tables) -> DataFrame:
    return _current(t).select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")


@query("select user_id, arg_max(event_type, (ts, event_id)) as event_type, count(*) as n from events group by 1")
def latest_state_max_by(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.count(F.lit(1)).alias("n"))


@query("select o.o_custkey, o.o_orderkey from orders o where not exists (select 1 from orders n where n.o_custkey = o.o_custkey and (n.o_orderdate > o.o_orderdate or (n.o_orderdate = o.o_orderdate and n.o_orderkey > o.o_orderkey)))")
def latest_by_anti_join(t: Tables) -> DataFrame:
    """The newest-row filter, as a maximum of (time, id) joined back: no non-equi join over a key's rows."""
    newest = t.orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return newest.select("o_custkey", F.col("m.o_orderkey").alias("o_orderkey"))


@query("select c_custkey, e.event_id, e.event_type from customer left join (select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) e on e.user_id = c_custkey")
def latest_event_left_join(t: Tables) -> DataFrame:
    e = relational.latest_per_key(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return t.customer.join(e, F.col("user_id") == F.col("c_custkey"), "left").select("c_custkey", "event_id", "event_type")


@query("select user_id from (select user_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) where event_type in ('signup', 'purchase')")
def pages_active_by_latest_event(t: Tables) -> DataFrame:
    last = relational.latest_value(t.events, ["user_id"], F.col("event_type"), F.struct("ts", "event_id"), "event_type")
    return last.where(F.col("event_type").isin("signup", "purchase")).select("user_id")


@query("select user_id from events where value > 10 group by 1 having count(distinct event_type) = 5")
def gate_division_all_satisfied(t: Tables) -> DataFrame:
    return relational.satisfies_all(t.events.where("value > 10"), "user_id", "event_type", len(EVENT_TYPES))


@query("select n_name, count(c_custkey) as members, cast(coalesce(sum(case when c_acctbal > 5000 then 1 else 0 end), 0) as bigint) as rich from nation left join customer on c_nationkey = n_nationkey and c_mktsegment = 'BUILDING' group by 1")
def segment_counts_left_join(t: Tables) -> DataFrame:
    j = t.nation.join(t.customer, (F.col("c_nationkey") == F.col("n_nationkey")) & (F.col("c_mktsegment") == "BUILDING"), "left")
    return j.groupBy("n_name").agg(F.count("c_custkey").alias("members"), F.coalesce(F.count_if(F.col("c_acctbal") > 5000), F.lit(0)).alias("rich"))


@query(f"select l_orderkey, count(*) as n, round(sum(l_extendedprice), 2) as price from lineitem where l_orderkey in (select o_orderkey from {_CURRENT}) group by 1")
def semi_current_projects(t: Tables) -> DataFrame:
    rows = t.lineitem.join(_current(t).select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("with r as (select user_id, nullif(event_type, 'error') as k, count(*) as n from events group by 1, 2) select a.user_id, a.k, a.n, b.n as m from r a join r b on b.user_id = a.user_id + 1 and a.k is not distinct from b.k")
def null_safe_match(t: Tables) -> DataFrame:
    r = t.events.groupBy("user_id", F.nullif(F.col("event_type"), F.lit("error")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = r.select((F.col("user_id") - 1).alias("u"), F.col("k").alias("k2"), F.col("n").alias("m"))
    return r.join(b, (F.col("user_id") == F.col("u")) & F.col("k").eqNullSafe(F.col("k2"))).select("user_id", "k", "n", "m")


@query(f"select event_type, count(*) as n, cast(sum(case when {_EVENT_K} >= 50 then 1 else 0 end) as bigint) as high, cast(sum(case when {_EVENT_K} < 50 and value > 20 then 1 else 0 end) as bigint) as ready from events group by 1")
def conditional_readiness(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(_k() >= 50).alias("high"), F.count_if((_k() < 50) & (F.col("value") > 20)).alias("ready"))


@query("select d.i as ordinal, d.s as o_orderstatus, count(o_orderkey) as n from (values (0, 'F'), (1, 'O'), (2, 'P'), (3, 'X')) d(i, s) left join orders on o_orderstatus = d.s group by 1, 2")
def status_gap_filled(t: Tables) -> DataFrame:
    return relational.gap_filled_counts(t.orders, "o_orderstatus", STATUSES)


@query("select case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'VERIFIED' when o_orderpriority = '3-MEDIUM' then 'SUBMITTED' else 'NONE' end as authority, cast(sum(n) as bigint) as n from (select o_orderpriority, count(*) as n from orders group by 1) group by 1")
def authority_remap_counts(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    authority = F.when(p.isin("1-URGENT", "2-HIGH"), "VERIFIED").when(p == "3-MEDIUM", "SUBMITTED").otherwise("NONE")
    return t.orders.groupBy(p).agg(F.count(F.lit(1)).alias("n")).groupBy(authority.alias("authority")).agg(F.sum("n").alias("n"))


@query(f"with h as (select user_id, arg_max({_EVENT_K}, (ts, event_id)) as latest, max({_EVENT_K}) as highest, count(*) as n from events group by 1) select latest // 10 as bucket, count(*) as users, max(highest) as highest, cast(sum(n) as bigint) as n from h group by 1")
def hint_latest_max_count(t: Tables) -> DataFrame:
    h = t.events.groupBy("user_id").agg(F.max_by(_k(), F.struct("ts", "event_id")).alias("latest"), F.max(_k()).alias("highest"), F.count(F.lit(1)).alias("n"))
    return h.groupBy(F.floor(F.col("latest") / 10).alias("bucket")).agg(F.count(F.lit(1)).alias("users"), F.max("highest").alias("highest"), F.sum("n").alias("n"))


@query("select issue, count(*) as n from (select unnest(list_slice(regexp_extract_all(lower(text), '[a-z0-9]{2,}'), 1, 10)) as issue from conversations) group by 1")
def issue_histogram(t: Tables) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]{2,})"), 1)
    return t.conversations.select(F.explode(F.slice(words, 1, 10)).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query("select 'p_brand' as dimension, p_brand as value, count(*) as n from part group by p_brand union all select 'p_type', p_type, count(*) from part group by p_type union all select 'p_size', cast(p_size as varchar), count(*) from part group by p_size")
def dimension_histogram(t: Tables) -> DataFrame:
    return relational.pivoted_histogram(t.part, ["p_brand", "p_type", "p_size"])


@query("select user_id from events where event_type = 'error' group by 1 having count(*) >= 15 union select user_id from events group by 1 having max(value) > 90 union select user_id from events group by 1 having count(distinct event_type) < 5")
def support_needed_union(t: Tables) -> DataFrame:
    e = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.max("value").alias("top"), F.countDistinct("event_type").alias("kinds"))
    return e.where("errors >= 15 or top > 90 or kinds < 5").select("user_id")


@query("select sha256(text) as fingerprint, count(*) as copies, count(distinct source) as sources, min(doc_id) as first_doc from documents group by 1 having count(*) > 1")
def duplicate_fingerprints(t: Tables) -> DataFrame:
    g = t.documents.groupBy(F.sha2("text", 256).alias("fingerprint")).agg(F.count(F.lit(1)).alias("copies"), F.countDistinct("source").alias("sources"), F.min("doc_id").alias("first_doc"))
    return g.where("copies > 1")


@query("select relation, id from (select 'order_customer' as relation, o_orderkey as id from orders join customer on c_custkey = o_custkey where o_orderpriority = '1-URGENT' and c_acctbal < 0 union all select 'line_supplier', l_orderkey from lineitem join supplier on s_suppkey = l_suppkey where l_quantity >= 50 and s_acctbal < 1000) order by relation, id limit 10")
def provenance_mismatch_union(t: Tables) -> DataFrame:
    a = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).where("o_orderpriority = '1-URGENT' and c_acctbal < 0").select(F.lit("order_customer").alias("relation"), F.col("o_orderkey").alias("id"))
    b = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).where("l_quantity >= 50 and s_acctbal < 1000").select(F.lit("line_supplier").alias("relation"), F.col("l_orderkey").alias("id"))
    return a.unionByName(b).orderBy("relation", "id").limit(10)


@query("select (select count(*) from part where exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R') or exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'A')) as covered, (select count(*) from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R') and not exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'A')) as unassigned, (select count(*) from part where exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R') and exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'A')) as overlap")
def coverage_and_unassigned(t: Tables) -> DataFrame:
    flags = t.lineitem.where("l_returnflag in ('R', 'A')").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_returnflag").alias("k"))
    j = t.part.join(flags, "p_partkey", "left")
    return j.agg(F.count("k").alias("covered"), F.count_if(F.col("k").isNull()).alias("unassigned"), F.count_if(F.col("k") == 2).alias("overlap"))


@query("select gate, " + ", ".join(f"cast(sum(case when status = '{s}' then 1 else 0 end) as bigint) as {s.lower()}" for s in STATUSES) + " from (select o_orderpriority as gate, o_orderstatus as status from orders) group by 1")
def gate_status_matrix(t: Tables) -> DataFrame:
    m = t.orders.groupBy(F.col("o_orderpriority").alias("gate")).pivot("o_orderstatus", list(STATUSES)).agg(F.count(F.lit(1)))
    return m.select("gate", *[F.coalesce(s, F.lit(0)).alias(s.lower()) for s in STATUSES])


@query(f"select l_orderkey, l_linenumber, case when l_returnflag = 'R' then 1 when l_returnflag = 'A' then 2 else 3 end as stage from lineitem join {_CURRENT} o on l_orderkey = o_orderkey and l_shipdate > o_orderdate and o_orderstatus = 'O'")
def version_bound_join(t: Tables) -> DataFrame:
    o = _current(t).where("o_orderstatus = 'O'")
    stage = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3)
    return t.lineitem.join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate"))).select("l_orderkey", "l_linenumber", stage.alias("stage"))


@query("select conv_id, turn * 2 as seq, 'role' as kind, role as body from conversations union all select conv_id, turn * 2 + 1, 'text', md5(text) from conversations")
def turn_to_messages(t: Tables) -> DataFrame:
    two = F.array(F.struct((F.col("turn") * 2).alias("seq"), F.lit("role").alias("kind"), F.col("role").alias("body")), F.struct((F.col("turn") * 2 + 1).alias("seq"), F.lit("text").alias("kind"), F.md5("text").alias("body")))
    return t.conversations.select("conv_id", F.explode(two).alias("m")).select("conv_id", "m.*")


@query("select event_type, count(*) as n, min(value) as lo, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.9) as p90, quantile_disc(value, 0.95) as p95, max(value) as hi, round(avg(value), 4) as average, round(sum(value), 2) as total from events group by 1")
def latency_nearest_rank(t: Tables) -> DataFrame:
    ranks = retrieval.nearest_ranks(t.events, ["event_type"], "value", {"p50": 0.5, "p90": 0.9, "p95": 0.95})
    plain = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 4).alias("average"), F.round(F.sum("value"), 2).alias("total"))
    return plain.join(ranks, "event_type", "left").select("event_type", "n", "lo", "p50", "p90", "p95", "hi", "average", "total")


@query("with l as (select c.role, c.conv_id, avg(coalesce(l.quality, 0)) as q from conversations c left join labels l on l.doc_id = c.conv_id group by 1, 2) select role, count(*) as n, round(avg(q), 4) as pass_rate, bool_and(q >= 0) as gate from l group by 1")
def eval_pass_rates(t: Tables) -> DataFrame:
    l = t.conversations.join(t.labels, F.col("doc_id") == F.col("conv_id"), "left").groupBy("role", "conv_id").agg(F.avg(F.coalesce("quality", F.lit(0))).alias("q"))
    return l.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("q"), 4).alias("pass_rate"), F.every(F.col("q") >= 0).alias("gate"))


@query("select o_orderkey, o_orderdate from orders where o_orderdate < timestamp '1997-05-28' or (o_orderdate = timestamp '1997-05-28' and o_orderkey < 900) order by o_orderdate desc, o_orderkey desc limit 21")
def keyset_page(t: Tables) -> DataFrame:
    import datetime

    at = F.lit(datetime.datetime(1997, 5, 28)).cast("timestamp_ntz")
    return relational.keyset_page(t.orders.select("o_orderkey", "o_orderdate"), [("o_orderdate", True), ("o_orderkey", True)], [at, 900], 20)


@query("select c_custkey, c_name, (select count(*) from customer where c_acctbal > 0) as total from customer where c_acctbal > 0 order by c_acctbal desc, c_custkey limit 25 offset 50")
def offset_page(t: Tables) -> DataFrame:
    rows = t.customer.where("c_acctbal > 0")
    page = rows.orderBy(F.desc("c_acctbal"), "c_custkey").offset(50).limit(25).select("c_custkey", "c_name")
    return page.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))


@query("select * from (select 'order' as kind, o_orderkey as id, o_orderdate as moment from orders union all select 'line', l_orderkey * 10 + l_linenumber, l_shipdate from lineitem) order by moment desc, kind, id limit 200")
def merged_assets_topk(t: Tables) -> DataFrame:
    a = t.orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("moment"))
    b = t.lineitem.select(F.lit("line").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("moment"))
    return a.unionByName(b).orderBy(F.desc("moment"), "kind", "id").limit(200)


@query("select distinct doc_id, 'MISSING' as side from documents where doc_id not in (select doc_id from labels) union all select distinct doc_id, 'UNEXPECTED' from labels where doc_id not in (select doc_id from documents)")
def missing_unexpected_ids(t: Tables) -> DataFrame:
    return relational.missing_and_unexpected(t.documents.select("doc_id"), t.labels.select("doc_id"), "doc_id")


@query("select event_id, user_id, row_number() over w as version, value - last_value(case when event_type <> 'error' then value end ignore nulls) over (w rows between unbounded preceding and 1 preceding) as diff, event_id <> first_value(event_id) over (partition by user_id, event_type order by ts, event_id) as repeated from events window w as (partition by user_id order by ts, event_id)")
def version_numbering_diff(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    last = F.last(F.when(F.col("event_type") != "error", F.col("value")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first("event_id").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return t.events.select("event_id", "user_id", F.row_number().over(w).cast("long").alias("version"), (F.col("value") - last).alias("diff"), (F.col("event_id") != first).alias("repeated"))


@query("select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 2")
def recent_n_turns(t: Tables) -> DataFrame:
    return relational.latest_per_key(t.conversations, ["conv_id"], [F.desc("turn")], 2).select("conv_id", "turn", "role")


@query("select conv_id, max(turn) as through_turn, count(*) as folded, md5(string_agg(role, '|' order by turn)) as summary from (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations) where rn > 2 group by 1")
def fold_candidates(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    old = t.conversations.withColumn("rn", F.row_number().over(w)).where("rn > 2")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return old.groupBy("conv_id").agg(F.max("turn").alias("through_turn"), F.count(F.lit(1)).alias("folded"), F.md5(F.array_join(lines, "|")).alias("summary"))


@query("select o_orderkey, count(l_orderkey) as n, coalesce(string_agg(l_linenumber || ':' || l_returnflag, ',' order by l_linenumber, l_returnflag), '') as lines from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def nested_timeline(t: Tables) -> DataFrame:
    kids = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag")
    made = relational.nested(t.orders.select("o_orderkey"), kids, "o_orderkey", ["l_linenumber"], "items")
    line = F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_returnflag"]))
    return made.select("o_orderkey", F.size("items").cast("long").alias("n"), F.array_join(line, ",").alias("lines"))


@query("with a as (select user_id as k, count(*) as s from events where ts < timestamp '2024-01-15' group by 1), b as (select user_id as k, count(*) as s from events where ts >= timestamp '2024-01-15' group by 1) select coalesce(a.k, b.k) as k, case when a.k is null then 'ADDED' when b.k is null then 'REMOVED' else 'CHANGED' end as change from a full join b on a.k = b.k where a.s is distinct from b.s")
def structure_diff(t: Tables) -> DataFrame:
    cut = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    snap = lambda c: t.events.where(c).groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("s"))
    return relational.outer_diff(snap(cut), snap(~cut), "k", "s")


@query(f"select event_id, {_EVENT_K} as k, cast(json_array_length('[' || {_EVENT_K} || ',1]') as bigint) as n, {_EVENT_K} > 90 as high from events")
def event_json_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", _k().alias("k"), F.json_array_length(F.concat(F.lit("["), _k().cast("string"), F.lit(",1]"))).cast("long").alias("n"), F.exists(F.array(_k()), lambda x: x > 90).alias("high"))


@query("select event_id, round(0.8 + 0.2 * pow(0.5, greatest(date_diff('second', date_trunc('second', ts), timestamp '2024-01-31') / 86400.0, 0) / 30.0), 6) as decay from events")
def recency_decay(t: Tables) -> DataFrame:
    age = (F.unix_timestamp(F.lit("2024-01-31 00:00:00")) - F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))) / 86400.0
    return t.events.select("event_id", F.round(retrieval.recency(age), 6).alias("decay"))


@query("with q as (select vec_id as q_id, embedding::double[] as qe from embeddings where vec_id < 5) select q_id, vec_id, round(list_cosine_similarity(qe, embedding::double[]), 4) as score from q, embeddings where vec_id <> q_id qualify row_number() over (partition by q_id order by round(list_cosine_similarity(qe, embedding::double[]), 4) desc, vec_id) <= 10")
def cosine_topk(t: Tables) -> DataFrame:
    q = F.broadcast(t.embeddings.where("vec_id < 5").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("qe")))
    scored = t.embeddings.join(q, F.col("vec_id") != F.col("q_id")).select("q_id", "vec_id", F.round(vector.cosine(F.col("qe"), F.col("embedding")), 4).alias("score"))
    return relational.latest_per_key(scored, ["q_id"], [F.desc("score"), F.asc("vec_id")], 10)


@query("select median(value) as baseline, cast(sum(case when value - (select median(value) from events) >= 0.025 then 1 else 0 end) as bigint) as lifted from events")
def median_baseline_lift(t: Tables) -> DataFrame:
    rows = retrieval.with_baseline(t.events.select("value"), "value")
    return rows.agg(F.first("baseline").alias("baseline"), F.count_if(F.col("value") - F.col("baseline") >= 0.025).alias("lifted"))


def _word(*words: str) -> str:
    return f"(^|[^a-zà-ÿ])({'|'.join(words)})($|[^a-zà-ÿ])"


_ROUTES = (
    ("DEBUG", _word("fail", "error", "wrong", "stuck", "nicht", "kaputt", "pas", "panne", "fallo"), None),
    ("ENGLISH", _word("the", "and", "with", "from", "this", "that"), _word("not the", "not this", "not that")),
    ("GERMAN", _word("der", "die", "das", "und", "mit", "ein", "eine"), _word("kein", "keine")),
    ("FRENCH", _word("le", "la", "les", "des", "une", "dans", "avec"), None),
    ("SPANISH", _word("el", "los", "las", "una", "con", "para", "por"), None),
)


@query("select conv_id, turn, case " + " ".join(f"when regexp_matches(lower(text), '{p}')" + (f" and not regexp_matches(lower(text), '{v}')" if v else "") + f" then '{n}'" for n, p, v in _ROUTES) + " else upper(role) end as route from conversations")
def keyword_route(t: Tables) -> DataFrame:
    """Ordered rules; the first that fits and isn't negated decides, else the speaker does."""
    return t.conversations.select("conv_id", "turn", text.routed(F.lower("text"), _ROUTES, F.upper("role")).alias("route"))


@query("select o_orderkey, l_linenumber, case when o_orderdate > timestamp '1998-01-01' then 'NOT_YET_VALID' when l_shipdate < timestamp '1998-01-01' then 'EXPIRED' else 'VALID' end as state from orders join lineitem on l_orderkey = o_orderkey")
def validity_interval(t: Tables) -> DataFrame:
    now = F.lit("1998-01-01").cast("timestamp_ntz")
    state = F.when(F.col("o_orderdate") > now, "NOT_YET_VALID").when(F.col("l_shipdate") < now, "EXPIRED").otherwise("VALID")
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber", state.alias("state"))


@query("with m as (select user_id, avg(least(4, greatest(1, value / 25))) as mean from events group by 1) select user_id, floor(mean * 100 + 0.5) / 100 as mean, case when mean >= 3.8 then 4 when mean >= 3.2 then 3 when mean >= 2.2 then 2 else 1 end as level from m")
def rubric_levels(t: Tables) -> DataFrame:
    m = t.events.groupBy("user_id").agg(F.avg(F.least(F.lit(4.0), F.greatest(F.lit(1.0), F.col("value") / 25))).alias("m"))
    level = F.when(F.col("m") >= 3.8, 4).when(F.col("m") >= 3.2, 3).when(F.col("m") >= 2.2, 2).otherwise(1)
    return m.select("user_id", retrieval.half_up(F.col("m"), 2).cast("double").alias("mean"), level.alias("level"))


@query("select item_id, (contains(lower(text), 'the') or contains(lower(text), 'das')) and (contains(lower(text), 'er') or contains(lower(text), 'en')) as concepts, contains(lower(text), 'xq') as forbidden from benchmark")
def concept_group_match(t: Tables) -> DataFrame:
    groups = F.array(F.array(F.lit("the"), F.lit("das")), F.array(F.lit("er"), F.lit("en")))
    low = F.lower("text")
    return t.benchmark.select("item_id", F.forall(groups, lambda g: F.exists(g, lambda w: low.contains(w))).alias("concepts"), F.exists(F.array(F.lit("xq")), lambda w: low.contains(w)).alias("forbidden"))


_HEX = "upper(lpad(to_hex(p_partkey * 7919 % 16777216), 6, '0'))"
_LUM = lambda at: f"(with v as (select cast(('0x' || substr(h, {at}, 2)) as integer) / 255.0 as x) select case when x <= 0.04045 then x / 12.92 else pow((x + 0.055) / 1.055, 2.4) end from v)"


@query(f"with c as (select p_partkey, {_HEX} as h from part), l as (select p_partkey, h, 0.2126 * {_LUM(1)} + 0.7152 * {_LUM(3)} + 0.0722 * {_LUM(5)} as lum from c) select p_partkey, '#' || h as colour, round(1.05 / (lum + 0.05), 4) as ratio, 1.05 / (lum + 0.05) >= 4.5 as passes from l")
def colour_contrast(t: Tables) -> DataFrame:
    colour = text.hex_colour(F.concat(F.lit("#"), F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0")))
    c = t.part.select("p_partkey", colour.alias("colour"))
    ratio = design.contrast(F.col("colour"), F.lit("#FFFFFF"))
    return c.select("p_partkey", "colour", F.round(ratio, 4).alias("ratio"), (ratio >= 4.5).alias("passes"))


@query("select p_partkey, round((1200.0 - 2 * p_size - 16 * 11) / 12, 4) as width from part")
def layout_grid(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(design.column_width(F.lit(1200.0), F.col("p_size"), F.lit(16), F.lit(12)), 4).alias("width"))


@query("with y as (select p_partkey, floor((1000 + 5) / (p_size * 10.0 + 5) + 1e-9) * floor((700 + 5) / (p_size * 6.0 + 5) + 1e-9) as a, floor((1000 + 5) / (p_size * 6.0 + 5) + 1e-9) * floor((700 + 5) / (p_size * 10.0 + 5) + 1e-9) as b from part) select p_partkey, b > a as rotated, cast(greatest(a, b) as bigint) as n from y")
def sheet_yield(t: Tables) -> DataFrame:
    y = design.sheet_yield(F.lit(1000.0), F.lit(700.0), F.col("p_size") * 10.0, F.col("p_size") * 6.0, F.lit(5.0))
    return t.part.select("p_partkey", y.alias("y")).select("p_partkey", "y.rotated", F.col("y.count").alias("n"))


@query("select l_orderkey, l_linenumber, cast(floor(l_quantity * 29.97 + 1e-9) as bigint) as lo, cast(floor(l_quantity * 29.97 + 0.5) as bigint) as mid, cast(ceil(l_quantity * 29.97 - 1e-9) as bigint) as hi from lineitem")
def frames_of_duration(t: Tables) -> DataFrame:
    q, r = F.col("l_quantity"), F.lit(29.97)
    return t.lineitem.select("l_orderkey", "l_linenumber", *[design.frames(q, r, m).alias(n) for m, n in (("FLOOR", "lo"), ("ROUND", "mid"), ("CEIL", "hi"))])


@query("select p_partkey, cast(gcd(p_size * 16, 1080) as bigint) as g, cast(p_size * 16 // gcd(p_size * 16, 1080) as bigint) as w, cast(1080 // gcd(p_size * 16, 1080) as bigint) as h from part")
def aspect_ratio(t: Tables) -> DataFrame:
    g = design.gcd(F.col("p_size") * 16, F.lit(1080))
    return t.part.select("p_partkey", g.alias("g"), F.expr("cast(p_size * 16 as bigint)").alias("s")).select("p_partkey", "g", F.expr("s div g").alias("w"), F.expr("1080 div g").alias("h"))


@query("with recursive e as (select distinct c_nationkey as src, s_nationkey as dst from (select o_custkey, l_suppkey from orders join lineitem on l_orderkey = o_orderkey where l_quantity >= 49 and o_orderstatus = 'F') join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey), u as (select src, dst from e union select dst, src from e), w as (select 0 as node, 0 as depth union select u.dst, w.depth + 1 from w join u on u.src = w.node where w.depth < 2) select node, min(depth) as depth from w group by 1")
def graph_bfs_2hop(t: Tables) -> DataFrame:
    links = t.orders.where("o_orderstatus = 'F'").join(t.lineitem.where("l_quantity >= 49"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey")
    e = links.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select("c_nationkey", "s_nationkey").distinct()
    return graph.bounded_hops(t.spark.sql("select 0 as node"), graph.undirected(e, "c_nationkey", "s_nationkey"), 2)


_CHAIN = "(select event_id, lag(event_id) over (partition by user_id order by ts, event_id) as supersedes from events)"


@query(f"select event_id, supersedes from {_CHAIN} c where not exists (select 1 from {_CHAIN} d where d.supersedes = c.event_id)")
def supersession_heads(t: Tables) -> DataFrame:
    c = t.events.select("event_id", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("supersedes"))
    return graph.chain_heads(c, "event_id", "supersedes").select("event_id", "supersedes")


@query("with e as (select distinct l_partkey as src, l_suppkey as dst from lineitem), b as (select p_partkey as node from part where p_size = 7) select src, dst from e where src not in (select node from b) and dst not in (select node from b)")
def restriction_propagation(t: Tables) -> DataFrame:
    e = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return graph.restricted(t.part.select(F.col("p_partkey").alias("node")), e, t.part.where("p_size = 7").select(F.col("p_partkey").alias("node")))[1]


@query("select 'lineitem_order' as rule, count(*) as violations from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey) union all select 'order_unique', count(*) from (select o_orderkey from orders group by 1 having count(*) > 1) union all select 'discount_range', count(*) from lineitem where l_discount not between 0 and 0.1 union all select 'ship_after_order', count(*) from lineitem join orders on o_orderkey = l_orderkey where l_shipdate < o_orderdate")
def constraint_violations(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    rules = {
        "lineitem_order": t.lineitem.join(o, "l_orderkey", "left_anti"),
        "order_unique": t.orders.groupBy("o_orderkey").count().where("count > 1"),
        "discount_range": t.lineitem.where("l_discount not between 0 and 0.1"),
        "ship_after_order": t.lineitem.join(o, "l_orderkey").where("l_shipdate < o_orderdate"),
    }
    out = None
    for name, bad in rules.items():
        one = bad.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


@query("with recursive e as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as rn from events), r as (select user_id, event_id, rn, ts as begun, 1 as n, true as accepted from e where rn = 1 union all select e.user_id, e.event_id, e.rn, case when e.ts >= r.begun + interval 1 day then e.ts else r.begun end, case when e.ts >= r.begun + interval 1 day then 1 when r.n < 2 then r.n + 1 else r.n end, e.ts >= r.begun + interval 1 day or r.n < 2 from r join e on e.user_id = r.user_id and e.rn = r.rn + 1) select event_id, user_id, accepted from r")
def rate_limit_anchored(t: Tables) -> DataFrame:
    return folds.anchored_limit(t.events, "user_id", "ts", "event_id", 86_400, 2)


@query("select event_id, count(*) over (partition by user_id order by epoch_us(date_trunc('second', ts)) range between 86399000000 preceding and current row) as n from events")
def sliding_count_limit(t: Tables) -> DataFrame:
    sec = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("sec").rangeBetween(-86_399, 0)
    return t.events.withColumn("sec", sec).select("event_id", F.count(F.lit(1)).over(w).alias("n"))


@query("with s as (select user_id, arg_max(event_type, (ts, event_id)) as state, max(ts) as last_ts, count(*) as attempts from events group by 1) select user_id, state, attempts, case when state = 'signup' then 'QUEUED' when state = 'view' and last_ts < timestamp '2024-01-30' then 'LEASE_EXPIRED' when state = 'error' then 'FAILED' else 'NONE' end as recovery from s")
def run_state_recovery(t: Tables) -> DataFrame:
    s = t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("at"), F.count(F.lit(1)).alias("attempts"))
    st = F.col("state")
    rec = F.when(st == "signup", "QUEUED").when((st == "view") & (F.col("at") < F.lit("2024-01-30").cast("timestamp_ntz")), "LEASE_EXPIRED").when(st == "error", "FAILED").otherwise("NONE")
    return s.select("user_id", "state", "attempts", rec.alias("recovery"))


@query(None)
def text_hash_vector(t: Tables) -> DataFrame:
    """Signed hashed word features in 512 buckets, as unit-length sparse rows."""
    grams = F.concat(*[text.word_ngrams(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""), n) for n in (1, 2)])
    h = t.benchmark.select("item_id", F.explode(grams).alias("g")).withColumn("h", text.fnv1a32(F.col("g")))
    sign = F.when(F.col("h") >= 1 << 31, -1).otherwise(1)
    s = h.groupBy("item_id", (F.col("h") % 512).alias("bucket")).agg(F.sum(sign).alias("v")).where("v <> 0")
    return s.withColumn("v", F.round(F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("item_id"))), 8))


@query(r"select doc_id, sha256(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', '[email]', 'g'), '1[3-9][0-9]{9}', '[phone]', 'g')) as redacted from documents")
def redact_builtin(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(text.redact_basic(F.col("text")), 256).alias("redacted"))


@query(None)
def redact_pii(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(text.redact(F.col("text")), 256).alias("redacted"))


@query("with w as (select c.conv_id, c.turn, list_distinct(regexp_extract_all(lower(c.text), '[a-z0-9]{2,}')) as a, lead(list_distinct(regexp_extract_all(lower(c.text), '[a-z0-9]{2,}'))) over (partition by conv_id order by turn) as b from conversations c) select conv_id, turn, round(len(list_intersect(a, b)) / least(len(a), len(b)), 4) as containment, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 4) as jaccard from w where len(a) > 0 and len(b) > 0")
def set_overlap_pairs(t: Tables) -> DataFrame:
    own = text.latin_tokens(F.col("text"))
    w = t.conversations.select("conv_id", "turn", own.alias("a")).withColumn("b", F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn")))
    inside, jaccard = text.overlap(F.col("a"), F.col("b"))
    return w.where("size(a) > 0 and size(b) > 0").select("conv_id", "turn", F.round(inside, 4).alias("containment"), F.round(jaccard, 4).alias("jaccard"))


@query("select time_bucket(interval 1 day, ts) as day, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def daily_windows(t: Tables) -> DataFrame:
    """An extra: tumbling windows."""
    return t.events.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
