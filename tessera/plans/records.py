"""Queries of records: filters, gates, versioned writes, replays, ordering, roll-ups, event logs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import records, relational, retrieval, stages
from tessera.streaming import folds

from .analytics import STATUSES, Tables, query

_K_SQL = "cast(json_extract_string(props, '$.k') as bigint)"


def _k():
    return F.get_json_object("props", "$.k").cast("bigint")


# Filters and gates.


@query("select o_orderkey from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
def optional_filters(t: Tables) -> DataFrame:
    """Conditions that aren't given drop out."""
    return records.matching(t.orders, o_orderstatus="F", o_orderpriority="1-URGENT", o_custkey=None).select("o_orderkey")


@query("select page_id, starts_with(url, 'https://') as secure, regexp_full_match(sha256(coalesce(html, '')), '[0-9a-f]{64}') as is_digest, regexp_full_match(url, 'https://.*/en/.*') as english from pages where url is not null")
def glob_patterns(t: Tables) -> DataFrame:
    u = F.col("url")
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    return t.pages.where("url is not null").select("page_id", records.glob(u, "https://*").alias("secure"), (~records.glob(digest, "*[^0-9a-f]*") & (F.length(digest) == 64)).alias("is_digest"), records.glob(u, "https://*/en/*").alias("english"))


@query("select doc_id from documents where lang = 'fr' or source = 'src3' or (lang = 'de' and source = 'src7')")
def topic_match(t: Tables) -> DataFrame:
    """A topic stands among a row's tags or in the facets of any of its courses."""
    courses = F.array(F.struct(F.array("lang", "source").alias("facets")), F.struct(F.array(F.when((F.col("lang") == "de") & (F.col("source") == "src7"), "fr").otherwise("-")).alias("facets")))
    return t.documents.where(records.has_topic(F.array("source"), courses, "fr") | F.array_contains(F.array("source"), "src3")).select("doc_id")


@query("select l_orderkey, l_linenumber, l_quantity >= 10 and l_discount <= 0.05 and l_tax < 0.07 and l_returnflag <> 'R' and l_linestatus = 'F' as eligible, list_aggregate(list_sort(list_filter([case when l_quantity < 10 then 'QUANTITY' end, case when l_discount > 0.05 then 'DISCOUNT' end, case when l_linestatus <> 'F' then 'LINE_STATUS' end, case when l_returnflag = 'R' then 'RETURNED' end, case when l_tax >= 0.07 then 'TAX' end], lambda x: x is not null)), 'string_agg', ',') as reasons from lineitem")
def eligibility_gate(t: Tables) -> DataFrame:
    """All conditions must hold; the ones that don't are named, in order; a condition that can't be judged fails."""
    rules = {"QUANTITY": F.col("l_quantity") >= 10, "DISCOUNT": F.col("l_discount") <= 0.05, "TAX": F.col("l_tax") < 0.07, "RETURNED": F.col("l_returnflag") != "R", "LINE_STATUS": F.col("l_linestatus") == "F"}
    reasons = records.failed_rules(rules)
    return t.lineitem.select("l_orderkey", "l_linenumber", reasons.alias("r")).select("l_orderkey", "l_linenumber", (F.size("r") == 0).alias("eligible"), F.when(F.size("r") > 0, F.array_join("r", ",")).alias("reasons"))


@query("select doc_id from documents where contains(lower(text), 'die') or contains(lower(text), 'der') or contains(lower(text), 'und')")
def synonym_search(t: Tables) -> DataFrame:
    """A query's own tokens and those that its facets stand for; any of them as part of a text is enough."""
    facets = {"german": ("der", "und"), "french": ("les",)}
    return t.documents.where(records.mentions(F.col("text"), "die german", facets, drop=("german",))).select("doc_id")


@query("select user_id, event_id from events where user_id in (select user_id from (select user_id, max(event_id) as last_event from events group by 1 order by last_event desc, user_id limit 30)) and event_type = 'error'")
def recent_thirty(t: Tables) -> DataFrame:
    """Rows of the 30 users seen last: a semi join with a top-k, no list of ids."""
    last = t.events.groupBy("user_id").agg(F.max("event_id").alias("last_event")).orderBy(F.desc("last_event"), "user_id").limit(30)
    return t.events.where("event_type = 'error'").join(last, "user_id", "left_semi").select("user_id", "event_id")


@query("select o_orderkey, case when o_orderdate > timestamp '1998-01-01' then 'NOT_YET_VALID' when u is not null and u < timestamp '1998-01-01' then 'EXPIRED' else 'VALID' end as state from (select *, case when o_orderkey % 3 <> 0 then o_orderdate + interval 30 day end as u from orders)")
def open_ended_validity(t: Tables) -> DataFrame:
    until = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate") + F.expr("interval 30 days"))
    return t.orders.select("o_orderkey", records.validity(F.col("o_orderdate"), until, F.lit("1998-01-01").cast("timestamp_ntz")).alias("state"))


@query("select case when user_id % 10 = 0 then 'DEMONSTRATION_DATA' else 'REAL' end as data_type, count(distinct user_id) as users, count(*) as events, cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as errors from events where user_id % 4 = 1 or user_id % 10 = 0 group by 1")
def tenant_report_by_data_type(t: Tables) -> DataFrame:
    """A report never mixes real and demonstration rows, and reads only what its reader may see."""
    name = F.when(F.col("user_id") % 10 == 0, F.concat(F.lit("demo-"), "user_id")).otherwise(F.concat(F.lit("u-"), "user_id"))
    seen = t.events.where((F.col("user_id") % 4 == 1) | (F.col("user_id") % 10 == 0))
    kinds = seen.withColumn("data_type", F.when(records.glob(name, "demo-*"), "DEMONSTRATION_DATA").otherwise("REAL"))
    return kinds.groupBy("data_type").agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"))


# Versioned writes.

_OLD_SQL = "(select c_custkey as id, c_mktsegment as space, c_name as body, 1 as version from customer where c_custkey % 3 <> 0)"
_NEW_SQL = "(select c_custkey as id, c_mktsegment as space, upper(c_name) as body, 2 as version from customer where c_custkey % 4 = 0 and c_mktsegment <> 'MACHINERY')"


def _old(t: Tables) -> DataFrame:
    return t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("space"), F.col("c_name").alias("body"), F.lit(1).alias("version"))


def _new(t: Tables) -> DataFrame:
    return t.customer.where("c_custkey % 4 = 0 and c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("space"), F.upper("c_name").alias("body"), F.lit(2).alias("version"))


@query(f"select coalesce(n.id, o.id) as id, coalesce(n.space, o.space) as space, coalesce(n.body, o.body) as body, coalesce(n.version, o.version) as version from {_OLD_SQL} o full join {_NEW_SQL} n on n.id = o.id")
def upsert_rows(t: Tables) -> DataFrame:
    return relational.upsert(_old(t), _new(t), ["id"], "version")


@query(f"select * from {_NEW_SQL} n where not exists (select 1 from {_OLD_SQL} o where o.id = n.id)")
def insert_absent_rows(t: Tables) -> DataFrame:
    return relational.insert_absent(_old(t), _new(t), ["id"])


@query(f"select * from {_OLD_SQL} o where o.space not in (select space from {_NEW_SQL}) or exists (select 1 from {_NEW_SQL} n where n.space = o.space and n.id = o.id)")
def prune_rows(t: Tables) -> DataFrame:
    return relational.prune(_old(t), _new(t), "id", "space")


@query("with g as (select user_id, count(*) as last from events where ts < timestamp '2024-01-20' group by 1) select event_id, e.user_id, coalesce(last, 0) + row_number() over (partition by e.user_id order by ts, event_id) as sequence from events e left join g on g.user_id = e.user_id where ts >= timestamp '2024-01-20'")
def append_sequence_rows(t: Tables) -> DataFrame:
    cut = F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")
    log = t.events.where(cut).withColumn("sequence", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    return relational.append_sequence(log, t.events.where(~cut).select("event_id", "user_id", "ts"), "user_id", [F.asc("ts"), F.asc("event_id")]).select("event_id", "user_id", "sequence")


@query("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as revision, coalesce(o_orderstatus, 'F') as state from orders where o_totalprice > 1000")
def backfill_numbered(t: Tables) -> DataFrame:
    """Old rows rebuilt into a new table, numbered within their key."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.where("o_totalprice > 1000").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("revision"), F.coalesce("o_orderstatus", F.lit("F")).alias("state"))


_BOUND_SQL = "(select doc_id, sha256(lang || ':' || text) as revision, sha256(lang || ':' || case when doc_id % 17 = 0 then text || ' ' else text end) as found from documents where text is not null)"


@query(f"select doc_id, revision, revision = found as holds from {_BOUND_SQL}")
def revision_binding(t: Tables) -> DataFrame:
    """A version is bound to what it says: the digest kept with it must be that of the content found."""
    d = t.documents.where("text is not null")
    kept = F.sha2(F.concat_ws(":", "lang", "text"), 256)
    found = F.sha2(F.concat_ws(":", "lang", F.when(F.col("doc_id") % 17 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))), 256)
    return d.select("doc_id", kept.alias("revision"), (kept == found).alias("holds"))


@query("with o as (select event_id, md5(props) as body from events where event_id % 10 <> 3), n as (select event_id, case when event_id % 100 = 7 then 'x' else md5(props) end as body from events where event_id % 50 <> 1) select o.event_id, case when n.event_id is null then 'DELETED' else 'UPDATED' end as fault from o left join n on n.event_id = o.event_id where n.event_id is null or n.body <> o.body")
def append_only_guard(t: Tables) -> DataFrame:
    """What changed in a log that may only grow: rows gone or rewritten between two snapshots."""
    body = F.md5("props")
    before = t.events.where("event_id % 10 <> 3").select("event_id", body.alias("body"))
    after = t.events.where("event_id % 50 <> 1").select("event_id", F.when(F.col("event_id") % 100 == 7, "x").otherwise(body).alias("body"))
    return records.append_only_faults(before, after, "event_id", "body")


@query("select distinct e.user_id from events e join events f on f.user_id = e.user_id where e.event_type = 'signup' and f.event_type = 'purchase' and e.value > 60 and f.value > 60")
def mutual_exclusion(t: Tables) -> DataFrame:
    """Keys that stand in two tables of which they may be in one only."""
    big = t.events.where("value > 60")
    return records.in_both(big.where("event_type = 'signup'"), big.where("event_type = 'purchase'"), ["user_id"])


@query(f"with r as (select event_id, user_id as actor, {_K_SQL} % 10 as idem, md5(event_type) as request, ts from events), f as (select *, first_value(request) over w as original, first_value(event_id) over w as origin from r window w as (partition by actor, idem order by ts, event_id)) select event_id, case when event_id = origin then 'APPLIED' when request = original then 'REPLAYED' else 'CONFLICT' end as outcome, origin from f")
def idempotent_replay(t: Tables) -> DataFrame:
    """The first request of an actor and key counts; the same again is a replay, another one under the key a conflict."""
    r = t.events.select("event_id", F.col("user_id").alias("actor"), (_k() % 10).alias("idem"), F.md5("event_type").alias("request"), "ts")
    return records.replayed(r, ["actor", "idem"], "request", ["ts", "event_id"], "event_id")


# Order, paging and roll-ups.


@query("select p_partkey, p_name from part order by lower(p_name), p_name, p_partkey limit 40")
def locale_order(t: Tables) -> DataFrame:
    """By a reader's alphabet, in which case matters last; then by code points."""
    return t.part.select("p_partkey", "p_name").orderBy(relational.collated(F.col("p_name")), "p_name", "p_partkey").limit(40)


#: Names in the order in which a Chinese reader looks them up.
_NAMES = ("安", "白", "陈", "丁", "方", "高", "何", "李", "王", "张", "anna", "Anna", "ánna", "Émile", "emilia", "zoë")


@query(f"with n as (select p_partkey, p_partkey * 7 % {len(_NAMES)} as place, p_size from part), k as (select *, {list(_NAMES)}[place + 1] as name from n) select p_partkey, name from k where place > {_NAMES.index('李')} or (place = {_NAMES.index('李')} and p_partkey > 9) order by place, p_partkey limit 101")
def alphabet_page(t: Tables) -> DataFrame:
    """The page after a cursor in a Chinese reader's alphabet: Han characters by sound, then letters, accents after these and case last."""
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") * 7 % len(_NAMES) + 1).cast("int"))
    rows = t.part.select("p_partkey", relational.collated(name, "zh-CN").alias("name"))
    page = relational.keyset_page(rows, [("name", False), ("p_partkey", False)], ("李", 9), 100)
    return page.select("p_partkey", F.collate("name", "UTF8_BINARY").alias("name"))


@query("select conv_id, turn, role from conversations order by conv_id desc, case role when 'user' then 0 when 'assistant' then 1 else 2 end, turn limit 60")
def custom_order(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", "role").orderBy(F.desc("conv_id"), relational.ordinal(F.col("role"), ("user", "assistant")), "turn").limit(60)


@query("select l_orderkey, l_linenumber from lineitem order by case l_returnflag when 'R' then 1 when 'A' then 2 else 3 end, l_shipdate desc, l_orderkey, l_linenumber limit 100")
def staged_order(t: Tables) -> DataFrame:
    return t.lineitem.orderBy(relational.ordinal(F.col("l_returnflag"), ("R", "A")), F.desc("l_shipdate"), "l_orderkey", "l_linenumber").limit(100).select("l_orderkey", "l_linenumber")


@query("with r as (select c_custkey, c_name, c_acctbal from customer where c_acctbal > 9000), n as (select count(*) as total from r) select c_custkey, total, total > 50 + 200 as truncated from r, n order by c_acctbal desc, c_custkey limit 200 offset 50")
def clamped_page(t: Tables) -> DataFrame:
    """A page whose size is held between bounds, with the number of all rows and whether more follow."""
    return relational.offset_page(t.customer.where("c_acctbal > 9000"), [F.desc("c_acctbal"), F.asc("c_custkey")], 5000, 50, most=200).select("c_custkey", "total", "truncated")


@query("select o_orderkey, string_agg(l_linenumber, ',' order by score desc, l_linenumber) as best from (select l_orderkey as o_orderkey, l_linenumber, cast(l_quantity > 40 as int) * 4 + cast(l_returnflag = 'R' as int) * 2 as score, row_number() over (partition by l_orderkey order by cast(l_quantity > 40 as int) * 4 + cast(l_returnflag = 'R' as int) * 2 desc, l_linenumber) as rn from lineitem) where rn <= 3 group by 1")
def nested_top(t: Tables) -> DataFrame:
    """The three items of each parent that matter most, in order."""
    score = (F.col("l_quantity") > 40).cast("int") * 4 + (F.col("l_returnflag") == "R").cast("int") * 2
    rows = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", score.alias("score"))
    top = relational.latest_per_key(rows, ["o_orderkey"], [F.desc("score"), F.asc("l_linenumber")], 3)
    items = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "l_linenumber")))
    return top.groupBy("o_orderkey").agg(items.alias("i")).select("o_orderkey", F.array_join(F.transform("i", lambda x: x["l_linenumber"].cast("string")), ",").alias("best"))


@query("select conv_id, len(list_filter(list_distinct(list(role)), lambda r: r not in ('user', 'assistant'))) = 0 as allowed, list_sort(list_distinct(list(role))) = ['assistant', 'user'] as complete from conversations group by 1")
def role_sets(t: Tables) -> DataFrame:
    """Subset and equality tests of each conversation's set of roles."""
    sets = t.conversations.groupBy("conv_id").agg(F.collect_set("role").alias("r"))
    return sets.select("conv_id", relational.is_subset(F.col("r"), F.array(F.lit("user"), F.lit("assistant"))).alias("allowed"), relational.same_set(F.col("r"), F.array(F.lit("user"), F.lit("assistant"))).alias("complete"))


_CATALOG_SQL = "select p_brand || ':' || lower(p_type) as id, count(*) as uses, array_to_string(list_sort(list_distinct(list(p_size)))[1:5], ',') as cases, array_to_string(list_sort(list_distinct(list(p_name)))[1:12], ',') as params, 'COURSE' as origin from part where p_partkey % 2 = 0 group by 1"


@query(f"with c as ({_CATALOG_SQL}) select * from c union all select id, 0, '', '', 'STARTER' from (values ('Brand#1:economy'), ('Brand#99:starter')) s(id) where id not in (select id from c)")
def catalog_roll_up(t: Tables) -> DataFrame:
    """Uses, up to five cases and up to twelve parameters of each kind, and known starters that nobody uses yet."""
    rows = t.part.where("p_partkey % 2 = 0").select(F.concat_ws(":", "p_brand", F.lower("p_type")).alias("id"), "p_size", "p_name")
    starters = t.spark.createDataFrame([("Brand#1:economy",), ("Brand#99:starter",)], "id string")
    return records.rolled_up(rows, "id", {"cases": ("p_size", 5), "params": ("p_name", 12)}, starters)


@query("with n as (select p_partkey as id, 'net' || p_size % 5 || '/n' || p_partkey as path, 'net' || p_size % 5 as folder, case p_partkey % 3 when 0 then '../net' || (p_size + 1) % 5 || '/n' || (p_partkey + 1) when 1 then 'n' || (p_partkey + 2) else '/net' || p_size % 5 || '/n' || (p_partkey + 5) end as input from part), r as (select *, case id % 3 when 0 then substr(input, 4) when 1 then folder || '/' || input else substr(input, 2) end as source from n) select source, path as target from r where source in (select path from n)")
def resolved_edges(t: Tables) -> DataFrame:
    """Edges from nodes' relative or absolute inputs; inputs that lead nowhere are dropped."""
    key, net = F.col("p_partkey"), lambda x: F.concat(F.lit("net"), x % 5)
    one = F.concat(F.lit("../"), net(F.col("p_size") + 1), F.lit("/n"), key + 1)
    given = F.when(key % 3 == 0, one).when(key % 3 == 1, F.concat(F.lit("n"), key + 2)).otherwise(F.concat(F.lit("/"), net(F.col("p_size")), F.lit("/n"), key + 5))
    nodes = t.part.select(F.concat(net(F.col("p_size")), F.lit("/n"), key).alias("path"), net(F.col("p_size")).alias("folder"), given.alias("input"))
    return records.edges_of_inputs(nodes, "path", "folder", "input")


# Rubrics.


@query("with d as (select user_id, avg(least(4, greatest(1, value / 25))) as mean, max(case when event_type = 'purchase' then least(4, greatest(1, floor(value / 20))) else 0 end) as transfer from events group by 1) select user_id, case when mean >= 3.8 and transfer >= 4 then 'L4' when mean >= 1.6 and transfer >= 3 then 'L3' when mean >= 1.4 then 'L2' else 'L1' end as level from d")
def diagnostic_levels(t: Tables) -> DataFrame:
    """Levels by the mean of all dimensions; the upper two also ask for enough transfer."""
    mean = F.avg(F.least(F.lit(4.0), F.greatest(F.lit(1.0), F.col("value") / 25)))
    transfer = F.max(F.when(F.col("event_type") == "purchase", F.least(F.lit(4.0), F.greatest(F.lit(1.0), F.floor(F.col("value") / 20).cast("double")))).otherwise(0.0))
    d = t.events.groupBy("user_id").agg(mean.alias("mean"), transfer.alias("transfer"))
    return d.select("user_id", records.level(F.col("mean"), F.col("transfer"), {"L4": (3.8, 4), "L3": (1.6, 3), "L2": (1.4, 0)}, "L1").alias("level"))


@query("with c as (select l_orderkey, l_linenumber, l_quantity > 10 as a, l_discount < 0.08 as b, l_tax < 0.06 as c, l_returnflag = 'N' as d from lineitem) select l_orderkey, l_linenumber, cast(a as int) + cast(b as int) + cast(c as int) + cast(d as int) as score, a and b and c and d as passed, case when not a then 'RETAINED_MISMATCH' when not b then 'CHANGE_MISMATCH' when not c then 'NORMALIZATION_INVALID_RANGE' when not d then 'CULTURAL_INVALID_MECHANISM' end as first_reason from c")
def transfer_rubric(t: Tables) -> DataFrame:
    """Four criteria; all must pass, the first that fails gives the reason."""
    criteria = {"RETAINED_MISMATCH": F.col("l_quantity") > 10, "CHANGE_MISMATCH": F.col("l_discount") < 0.08, "NORMALIZATION_INVALID_RANGE": F.col("l_tax") < 0.06, "CULTURAL_INVALID_MECHANISM": F.col("l_returnflag") == "N"}
    return t.lineitem.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in records.scored(criteria).items()])


@query("""select event_id, case when event_id % 3 = 0 then true when event_id % 3 = 1 then user_id <= 4 else false end as valid from events""")
def rubric_json_valid(t: Tables) -> DataFrame:
    """Whether a text is a rubric: JSON with a score from 0 to 4, a verdict that agrees with it, and reasons."""
    score = F.when(F.col("event_id") % 3 == 0, F.lit(4).cast("long")).otherwise(F.col("user_id"))
    whole = F.concat(F.lit('{"score": '), score, F.lit(', "passed": '), F.when(score == 4, "true").otherwise("false"), F.lit(', "reasons": ["a"]}'))
    return t.events.select("event_id", records.is_rubric(F.when(F.col("event_id") % 3 == 2, F.concat(F.lit("{"), whole)).otherwise(whole)).alias("valid"))


@query("with a as (select item_id, text, regexp_extract(lower(text), '^([a-zà-ÿ]+)', 1) as action from benchmark where text is not null) select item_id, contains(lower(text), 'the') or contains(lower(text), 'das') as concepts, not contains(lower(text), 'xq') as clean, action in ('', 'le', 'die', 'the', 'el') as allowed from a")
def case_scorer(t: Tables) -> DataFrame:
    """Concept groups, forbidden terms and the white list of actions of an evaluation case."""
    low = F.lower("text")
    return t.benchmark.where("text is not null").select("item_id", *[c.alias(n) for n, c in records.case_score(low, [["the", "das"]], ["xq"], F.array(F.regexp_extract(low, "^([a-zà-ÿ]+)", 1)), ["", "le", "die", "the", "el"]).items()])


# Event logs and streams.


@query("select event_id, user_id, sequence from (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as sequence from events) where sequence > 5 and sequence <= 5 + 20")
def event_tail(t: Tables) -> DataFrame:
    """Each run's events after a sequence that the reader has, at most a page of them."""
    log = t.events.select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("sequence"))
    return records.tail(log, "user_id", "sequence", after=5, page=20).select("event_id", "user_id", "sequence")


@query("select user_id, arg_max(event_type, event_id) as event_type, count(*) as n from events group by 1")
def stream_tail_state(t: Tables) -> DataFrame:
    """The latest state of every run, from the log read as a stream up to its present end; the checkpoint lets a later run go on from there."""
    folder = stages.shared_folder(t.spark)
    log = folds.file_stream(t.spark, f"{t.sf_dir}/events.parquet", t.events.schema).select("user_id", "event_type", "event_id")
    return folds.run_to_end(folds.latest_state_stream(log, "user_id", "event_type", "event_id"), folder, ["user_id"])


@query("select time_bucket(interval 1 day, ts) as day, event_type, count(*) as n from events group by 1, 2")
def stream_daily_windows(t: Tables) -> DataFrame:
    """Event-time windows of the log read as a stream."""
    log = folds.file_stream(t.spark, f"{t.sf_dir}/events.parquet", t.events.schema).withColumn("at", F.col("ts").cast("timestamp"))
    made = folds.run_to_end(folds.windowed_counts(log, "at", "1 day", "400 days", "event_type").select(F.col("window.start").alias("day"), "event_type", "n"), stages.shared_folder(t.spark), ["day", "event_type"])
    return made.select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n")


#: The watermark has passed all events before the last one's millisecond; they are final.
_PASSED = "(select date_trunc('millisecond', max(ts)) from events)"


def _event_stream(t: Tables) -> DataFrame:
    return folds.file_stream(t.spark, f"{t.sf_dir}/events.parquet", t.events.schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _final(t: Tables, stream: DataFrame) -> DataFrame:
    return folds.append_to_end(stream, stages.shared_folder(t.spark))


@query(f"with recursive e as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as rn from events), r as (select user_id, event_id, rn, ts, ts as begun, 1 as n, true as accepted from e where rn = 1 union all select e.user_id, e.event_id, e.rn, e.ts, case when e.ts >= r.begun + interval 1 day then e.ts else r.begun end, case when e.ts >= r.begun + interval 1 day then 1 when r.n < 2 then r.n + 1 else r.n end, e.ts >= r.begun + interval 1 day or r.n < 2 from r join e on e.user_id = r.user_id and e.rn = r.rn + 1) select event_id, user_id, accepted from r where ts < {_PASSED}")
def stream_rate_limit(t: Tables) -> DataFrame:
    """Windows anchored at a key's own first event, as a stream with keyed state: what the watermark has passed is final."""
    return _final(t, folds.anchored_limit(_event_stream(t), "user_id", "ts", "event_id", 86_400, 2, late="0 seconds"))


@query(f"""with recursive e as (select user_id, event_id, ts, event_type in ('error', 'view') as failed, row_number() over (partition by user_id order by ts, event_id) as rn from events),
 r as (select user_id, event_id, rn, ts, case when failed then ts end as begun, case when failed then 1 else 0 end as n, timestamp '1970-01-01' as until, false as blocked from e where rn = 1
  union all select s.user_id, s.event_id, s.rn, s.ts, case when counts and m >= 3 then null when counts then b else begun end, case when counts and m >= 3 then 0 when counts then m else n end, case when counts and m >= 3 then s.ts + interval 2 day else until end, s.blocked
   from (select e.user_id, e.event_id, e.rn, e.ts, r.begun, r.n, r.until, e.ts < r.until as blocked, e.failed and e.ts >= r.until as counts, case when r.begun is null or e.ts >= r.begun + interval 3 day then e.ts else r.begun end as b, case when r.begun is null or e.ts >= r.begun + interval 3 day then 1 else r.n + 1 end as m from r join e on e.user_id = r.user_id and e.rn = r.rn + 1) s)
 select event_id, user_id, blocked from r where ts < {_PASSED}""")
def stream_failure_block(t: Tables) -> DataFrame:
    """Three failures within three days block a user for two, as a stream; a state that is over is dropped by a timer."""
    failed = _event_stream(t).withColumn("failed", F.col("event_type").isin("error", "view"))
    return _final(t, folds.failure_block(failed, "user_id", "ts", "event_id", "failed", 3, 3 * 86_400, 2 * 86_400, late="0 seconds"))


@query(f"with e as (select user_id, ts, event_type, lead(ts) over w as next, lag(event_type) over w as was, event_id from events window w as (partition by user_id order by ts, event_id)) select user_id, epoch_us(ts) + 86400000000 as us from e where event_type = 'view' and coalesce(next, timestamp '2999-01-01') > ts + interval 1 day and ts + interval 1 day < {_PASSED}")
def stream_leases(t: Tables) -> DataFrame:
    """When a viewing user has had no event for a day: told by a timer, not by the next event."""
    made = folds.leases(_event_stream(t), "user_id", "ts", "event_id", "event_type", running="view", seconds=86_400, attempts=1 << 30, late="0 seconds")
    return _final(t, made).select("user_id", "us")


@query("with s as (select user_id, arg_max(event_type, (ts, event_id)) as state, max(ts) as last_ts, min(ts) as born, count(*) as attempts from events group by 1) select user_id, state, attempts < 70 as executes from s where state = 'signup' or (state = 'view' and last_ts <= timestamp '2024-01-30') order by born, user_id limit 20")
def recovery_scan(t: Tables) -> DataFrame:
    """The 20 oldest runs that wait or whose lease is over; those at the cap of attempts fail instead of running again."""
    s = t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("at"), F.min("ts").alias("born"), F.count(F.lit(1)).alias("attempts"))
    due = (F.col("state") == "signup") | ((F.col("state") == "view") & (F.col("at") <= F.lit("2024-01-30").cast("timestamp_ntz")))
    return s.where(due).orderBy("born", "user_id").limit(20).select("user_id", "state", (F.col("attempts") < 70).alias("executes"))


@query("select event_id, case when event_type = 'view' and ts <= timestamp '2024-01-30' - interval 2 minute then 'FAILED' when event_type = 'view' then 'RUNNING' else 'DONE' end as status from events where ts + interval 7 day > timestamp '2024-01-30'")
def stale_runs(t: Tables) -> DataFrame:
    """Runs without news for two minutes fail; sessions past their end are gone."""
    now = F.lit("2024-01-30").cast("timestamp_ntz")
    live = t.events.where(F.col("ts") + F.expr("interval 7 days") > now)
    stale = F.col("ts") <= now - F.expr("interval 2 minutes")
    return live.select("event_id", F.when((F.col("event_type") == "view") & stale, "FAILED").when(F.col("event_type") == "view", "RUNNING").otherwise("DONE").alias("status"))


_ORDERED_SQL = "(select event_id, user_id, ts, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as rn, event_type, value from events)"


@query(f"with recursive e as materialized {_ORDERED_SQL}, r as (select event_id, user_id, rn, true as accepted, [us] as recent, 1 as total from e where rn = 1 union all select e.event_id, e.user_id, e.rn, len(list_filter(r.recent, lambda x: x > e.us - 86400000000)) < 3 and r.total < 40, case when len(list_filter(r.recent, lambda x: x > e.us - 86400000000)) < 3 and r.total < 40 then list_append(list_filter(r.recent, lambda x: x > e.us - 86400000000), e.us) else list_filter(r.recent, lambda x: x > e.us - 86400000000) end, r.total + case when len(list_filter(r.recent, lambda x: x > e.us - 86400000000)) < 3 and r.total < 40 then 1 else 0 end from r join e on e.user_id = r.user_id and e.rn = r.rn + 1) select event_id, user_id, accepted from r")
def sliding_limit(t: Tables) -> DataFrame:
    """At most three accepted runs a day and forty in all; only accepted ones count."""
    return folds.sliding_limit(t.events, "user_id", "ts", "event_id", 86_400, 3, 40)


@query(f"with recursive e as materialized {_ORDERED_SQL}, r as (select event_id, user_id, rn, true as passed, us as last from e where rn = 1 union all select e.event_id, e.user_id, e.rn, e.us - r.last >= 43200000000, case when e.us - r.last >= 43200000000 then e.us else r.last end from r join e on e.user_id = r.user_id and e.rn = r.rn + 1) select event_id, user_id from r where passed")
def throttled_events(t: Tables) -> DataFrame:
    return folds.throttled(t.events, "user_id", "ts", "event_id", 43_200)


_FAIL_SQL = f"""with recursive e as materialized {_ORDERED_SQL},
 r as (select event_id, user_id, rn, false as blocked, case when event_type = 'error' then us end as begun, case when event_type = 'error' then 1 else 0 end as n, 0::bigint as until from e where rn = 1
  union all select event_id, user_id, rn, blocked, case when blocked or event_type <> 'error' then pb when fresh_n >= 2 then null else fresh_b end, case when blocked or event_type <> 'error' then pn when fresh_n >= 2 then 0 else fresh_n end, case when not blocked and event_type = 'error' and fresh_n >= 2 then us + 86400000000 else pu end
  from (select e.event_id, e.user_id, e.rn, e.us, e.event_type, e.us < r.until as blocked, r.begun as pb, r.n as pn, r.until as pu, case when r.begun is null or e.us >= r.begun + 86400000000 then e.us else r.begun end as fresh_b, case when r.begun is null or e.us >= r.begun + 86400000000 then 1 else r.n + 1 end as fresh_n from r join e on e.user_id = r.user_id and e.rn = r.rn + 1))
 select event_id, user_id, blocked from r"""


@query(_FAIL_SQL)
def failure_limiter(t: Tables) -> DataFrame:
    """Two failures within a day block a user for a day; blocked attempts count for nothing."""
    rows = t.events.withColumn("failed", F.col("event_type") == "error")
    return folds.failure_block(rows, "user_id", "ts", "event_id", "failed", 2, 86_400, 86_400)


_ROUND_SQL = f"""with recursive e as materialized (select *, {_K_SQL} % 40 as digest from events), o as (select *, row_number() over (partition by user_id order by ts, event_id) as rn from e),
 r as (select event_id, user_id, rn, case when event_type in ('purchase', 'signup') then 0 else 1 end as stale, case when event_type in ('purchase', 'signup') then [digest] else []::bigint[] end as used, false as escalated from o where rn = 1
  union all select o.event_id, o.user_id, o.rn, case when r.escalated then r.stale when o.event_type in ('purchase', 'signup') and not list_contains(r.used, o.digest) then 0 else least(4, r.stale + 1) end, case when not r.escalated and o.event_type in ('purchase', 'signup') then list_append(r.used, o.digest) else r.used end, r.escalated or (not (o.event_type in ('purchase', 'signup') and not list_contains(r.used, o.digest)) and r.stale + 1 >= 4) from r join o on o.user_id = r.user_id and o.rn = r.rn + 1)
 select event_id, user_id, cast(stale as int) as stale, case when escalated then 'ESCALATED' else 'ACTIVE' end as status from r"""


@query(_ROUND_SQL)
def evidence_rounds(t: Tables) -> DataFrame:
    """Four rounds in a row without a purchase or signup of a new digest escalate a user for good."""
    rows = t.events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", (_k() % 40).alias("digest"), F.col("event_type").isin("purchase", "signup").alias("valid"))
    return folds.evidence_rounds(rows, "user_id", ["us", "event_id"], "event_id", "digest", "valid", 4).drop("us")


@query("with t as (select conv_id, turn, '- ' || role || ' ' || turn || ' ' || md5(text) as line from conversations), n as (select conv_id, turn, line, row_number() over (partition by conv_id order by turn desc) as rn from t), f as (select *, sum(length(line) + 1) over (partition by conv_id order by turn desc) as upto from n where rn > 2) select conv_id, string_agg(line, chr(10) order by turn) as summary, max(turn) as through_turn, count(*) as lines from f where upto <= 150 or rn = 3 group by 1")
def rolling_summary(t: Tables) -> DataFrame:
    """What is told of the turns older than the newest two: their last lines, as many as fit into 150 characters, one at least."""
    line = F.concat(F.lit("- "), "role", F.lit(" "), "turn", F.lit(" "), F.md5("text"))
    return records.rolling_summary(t.conversations.select("conv_id", "turn", line.alias("line")), "conv_id", "turn", "line", recent=2, longest=150)


@query("select conv_id, string_agg(text, '' order by turn) as whole from conversations where text is not null group by 1 having length(string_agg(text, '' order by turn)) > 0")
def delta_batches(t: Tables) -> DataFrame:
    """Texts let out in small batches, put together again: nothing is lost or moved."""
    rows = t.conversations.where("text is not null").select("conv_id", "turn", "text", (F.col("turn") * 15).alias("ms"))
    ends = rows.select("conv_id").distinct().select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("ms"))
    made = folds.micro_batches(rows.unionByName(ends), "conv_id", "turn", "text", "ms")
    parts = F.array_sort(F.collect_list(F.struct("seq", "chunk")))
    return made.groupBy("conv_id").agg(parts.alias("p")).select("conv_id", F.array_join(F.transform("p", lambda x: x["chunk"]), "").alias("whole"))


_SPLIT_SQL = "list_transform(range(0, (length({x}) + 479) // 480), lambda i: {x}[i * 480 + 1:i * 480 + 480])"


def _delta_sql() -> str:
    late = "(r.held <> '' and r.since is not null and e.ms - r.since >= 40)"
    now = f"(case when {late} then '' else r.held end || e.t)"
    due = "(length(now) >= 24 or (length(now) >= 6 and now[-1] in (chr(10), '。', '！', '？', '；', '：')))"
    done = "case when late then " + _SPLIT_SQL.format(x="was") + " else [] end"
    return f"""with recursive w as (select conv_id, turn, unnest(string_split(text, ' ')) as t, generate_subscripts(string_split(text, ' '), 1) as i from conversations where text is not null),
 e as materialized (select conv_id, row_number() over (partition by conv_id order by turn, i) as rn, t || ' ' as t, 15 * (row_number() over (partition by conv_id order by turn, i)) + 30 * turn as ms from w),
 r as (select conv_id, 0::bigint as rn, '' as held, null::bigint as since, []::varchar[] as out from e group by 1
  union all select conv_id, rn, case when {due} then '' else now end, case when {due} then null when late or since is null then ms else since end, out || ({done}) || (case when {due} then {_SPLIT_SQL.format(x="now")} else [] end)
   from (select e.conv_id, e.rn, e.ms, r.since, r.out, r.held as was, {late} as late, {now} as now from r join e on e.conv_id = r.conv_id and e.rn = r.rn + 1) s),
 f as (select conv_id, arg_max(out || case when held <> '' then {_SPLIT_SQL.format(x="held")} else [] end, rn) as chunks from r group by 1)
 select conv_id, cast(s - 1 as bigint) as seq, chunk from (select conv_id, unnest(chunks) as chunk, generate_subscripts(chunks, 1) as s from f)"""


@query(_delta_sql())
def delta_chunks(t: Tables) -> DataFrame:
    """Each conversation's words as they come, let out in chunks by size, sentence end or waiting time: the chunks themselves, in order."""
    words = t.conversations.where("text is not null").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "w"))
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "i")).cast("long")
    rows = words.select("conv_id", rn.alias("rn"), F.concat("w", F.lit(" ")).alias("t"), (15 * rn + 30 * F.col("turn")).cast("long").alias("ms"))
    ends = rows.select("conv_id").distinct().select("conv_id", F.lit(None).cast("long").alias("rn"), F.lit(None).cast("string").alias("t"), F.lit(None).cast("long").alias("ms"))
    return folds.micro_batches(rows.unionByName(ends), "conv_id", "rn", "t", "ms")


_GATES = tuple(s.lower() for s in STATUSES)


@query("select 'order_state' as relation, count(*) as n from orders join customer on c_custkey = o_custkey where (o_orderstatus = 'F') <> (c_acctbal > 0) union all select 'line_state', count(*) from lineitem join orders on o_orderkey = l_orderkey where l_linestatus <> o_orderstatus union all select 'nation', count(*) from customer join nation on n_nationkey = c_nationkey where n_regionkey <> c_custkey % 5")
def state_mismatches(t: Tables) -> DataFrame:
    """Joined rows whose states differ, by relation."""
    pairs = [
        ("order_state", t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")), F.col("o_orderstatus") == "F", F.col("c_acctbal") > 0),
        ("line_state", t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")), F.col("l_linestatus"), F.col("o_orderstatus")),
        ("nation", t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")), F.col("n_regionkey").cast("long"), F.col("c_custkey") % 5),
    ]
    return records.mismatches(pairs)


#: Ten relations in the order in which they are checked: parent and child, how they are joined, what must agree, and the child's id.
_RELATIONS_SQL = (
    ("A_ORDER", "orders join customer on c_custkey = o_custkey where c_custkey <> o_custkey", "o_orderkey"),
    ("B_LINE", "lineitem join orders on o_orderkey = l_orderkey where l_orderkey <> o_orderkey", "l_orderkey"),
    ("C_NATION", "nation join region on r_regionkey = n_regionkey where r_name is null", "n_nationkey"),
    ("D_SUPPLIER", "supplier join nation on n_nationkey = s_nationkey where n_regionkey > 99", "s_suppkey"),
    ("E_PART", "lineitem join part on p_partkey = l_partkey where (l_quantity > 49) <> (p_size > 49) and l_discount > 0.08", "l_orderkey"),
    ("F_STATE", "lineitem join orders on o_orderkey = l_orderkey where l_linestatus <> o_orderstatus", "l_orderkey"),
    ("G_OWNER", "orders join customer on c_custkey = o_custkey where (c_acctbal > 0) <> (o_totalprice > 200000)", "o_orderkey"),
    ("H_LABEL", "labels l join documents d on d.doc_id = l.doc_id where (quality = 1) <> (n_chars > 500)", "l.doc_id"),
    ("I_USER", "events join customer on c_custkey = user_id where (value > 50) <> (c_acctbal > 0)", "event_id"),
    ("J_SUPPLY", "lineitem join supplier on s_suppkey = l_suppkey where (l_tax > 0.05) <> (s_acctbal > 0)", "l_orderkey"),
)


@query("select relation, id from (" + " union all ".join(f"select '{n}' as relation, {i} as id from {j}" for n, j, i in _RELATIONS_SQL) + ") order by relation, id limit 1")
def first_mismatch(t: Tables) -> DataFrame:
    """The first of ten relations in which a row disagrees with its parent, and the least such row."""
    c = F.col
    labelled = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    made = {
        "A_ORDER": (t.orders.join(t.customer, c("c_custkey") == c("o_custkey")), c("o_custkey"), c("c_custkey"), "o_orderkey"),
        "B_LINE": (t.lineitem.join(t.orders, c("o_orderkey") == c("l_orderkey")), c("l_orderkey"), c("o_orderkey"), "l_orderkey"),
        "C_NATION": (t.nation.join(t.region, c("r_regionkey") == c("n_regionkey")), c("r_name").isNull(), F.lit(False), "n_nationkey"),
        "D_SUPPLIER": (t.supplier.join(t.nation, c("n_nationkey") == c("s_nationkey")), c("n_regionkey") > 99, F.lit(False), "s_suppkey"),
        "E_PART": (t.lineitem.where("l_discount > 0.08").join(t.part, c("p_partkey") == c("l_partkey")), c("l_quantity") > 49, c("p_size") > 49, "l_orderkey"),
        "F_STATE": (t.lineitem.join(t.orders, c("o_orderkey") == c("l_orderkey")), c("l_linestatus"), c("o_orderstatus"), "l_orderkey"),
        "G_OWNER": (t.orders.join(t.customer, c("c_custkey") == c("o_custkey")), c("c_acctbal") > 0, c("o_totalprice") > 200000, "o_orderkey"),
        "H_LABEL": (labelled, c("quality") == 1, c("n_chars") > 500, "doc_id"),
        "I_USER": (t.events.join(t.customer, c("c_custkey") == c("user_id")), c("value") > 50, c("c_acctbal") > 0, "event_id"),
        "J_SUPPLY": (t.lineitem.join(t.supplier, c("s_suppkey") == c("l_suppkey")), c("l_tax") > 0.05, c("s_acctbal") > 0, "l_orderkey"),
    }
    return records.first_mismatch(made)


@query("select user_id, event_type, epoch_us(max(ts)) as us from events group by 1, 2 order by us desc, user_id * 10 + length(event_type) limit 150")
def newest_buckets(t: Tables) -> DataFrame:
    """Of all limiter buckets (a user and a kind of event) the 150 seen last; the others are evicted."""
    seen = t.events.groupBy("user_id", "event_type").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("us")).withColumn("tie", F.col("user_id") * 10 + F.length("event_type"))
    return retrieval.newest(stages.written(seen), "us", "tie", 150).select("user_id", "event_type", "us")


_DRAFT_SQL = "(select o_orderkey as id, o_custkey % 7 as revision, md5(o_orderpriority) as digest, case when o_orderkey % 2 = 0 then 'REVIEW' else 'DRAFT' end as stage from orders)"


@query(f"select l_orderkey, l_linenumber, d.revision from lineitem join {_DRAFT_SQL} d on d.id = l_orderkey and d.revision = l_partkey % 7 and d.digest = md5(case when l_quantity > 25 then '1-URGENT' else '5-LOW' end) and d.stage = 'REVIEW'")
def draft_bound_join(t: Tables) -> DataFrame:
    """Cases with the very draft that they were opened for: id, revision, digest and stage must all agree."""
    drafts = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 7).alias("revision"), F.md5("o_orderpriority").alias("digest"), F.when(F.col("o_orderkey") % 2 == 0, "REVIEW").otherwise("DRAFT").alias("stage"))
    cases = t.lineitem.select(F.col("l_orderkey").alias("id"), "l_linenumber", (F.col("l_partkey") % 7).alias("revision"), F.md5(F.when(F.col("l_quantity") > 25, "1-URGENT").otherwise("5-LOW")).alias("digest"), F.lit("REVIEW").alias("stage"))
    return cases.join(drafts, ["id", "revision", "digest", "stage"]).select(F.col("id").alias("l_orderkey"), "l_linenumber", "revision")


@query("select event_id, cast(i as bigint) as i, asset from (select event_id, unnest(['a' || user_id, event_type, 'a' || user_id]) as asset, unnest([0, 1, 2]) as i from events)")
def json_array_unnest(t: Tables) -> DataFrame:
    """A JSON list of media as rows, each with its place."""
    raw = F.to_json(F.array(*[F.struct(x.alias("asset")) for x in (F.concat(F.lit("a"), "user_id"), F.col("event_type"), F.concat(F.lit("a"), "user_id"))]))
    made = t.events.select("event_id", F.posexplode(F.from_json(raw, "array<struct<asset: string>>")).alias("i", "m"))
    return made.select("event_id", F.col("i").cast("long").alias("i"), F.col("m.asset").alias("asset"))


#: The eight pages, and below the names and thresholds of the four criteria that their order is judged by.
_PAGES = ("cover", "quick-start", "map", "featured-activity", "calendar", "stories", "join-us", "back")


@query("with p as (select p_partkey, list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda i: (i * case when p_partkey % 3 = 0 then 3 else 1 end + case when p_partkey % 5 = 0 then 1 else 0 end) % case when p_partkey % 11 = 0 then 7 else 8 end) as o, p_size > 10 as diagnosed, p_partkey % 4 <> 0 as newcomers, p_size > 30 as moved from part), c as (select p_partkey, diagnosed as a, len(list_distinct(o)) = 8 as b, o[1] = 0 and list_position(o, 1) < list_position(o, 3) and coalesce(list_position(o, 6), 0) > 5 as c, newcomers or moved as d from p) select p_partkey, cast(a as int) + cast(b as int) + cast(c as int) + cast(d as int) as score, a and b and c and d as passed, case when not a then 'DIAGNOSTIC' when not b then 'PAGE_BOUNDARY' when not c then 'READING_PATH' when not d then 'AUDIENCE_TRANSFER' end as first_reason from c")
def book_layout_rubric(t: Tables) -> DataFrame:
    """Four criteria of a page order: a diagnosis first, eight different pages, a reading path, and a change for another audience."""
    n = F.col("p_partkey")
    step, shift, size = F.when(n % 3 == 0, 3).otherwise(1), F.when(n % 5 == 0, 1).otherwise(0), F.when(n % 11 == 0, 7).otherwise(8)
    pages = F.array(*[F.lit(p) for p in _PAGES])
    rows = t.part.select("p_partkey", "p_size", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.element_at(pages, ((i * step + shift) % size + 1).cast("int"))).alias("order"))
    place = lambda p: F.array_position("order", p)
    criteria = {
        "DIAGNOSTIC": F.col("p_size") > 10,
        "PAGE_BOUNDARY": F.size(F.array_distinct("order")) == 8,
        "READING_PATH": (F.element_at("order", 1) == "cover") & (place("quick-start") < place("featured-activity")) & (place("join-us") > 5),
        "AUDIENCE_TRANSFER": (n % 4 != 0) | (F.col("p_size") > 30),
    }
    return rows.select("p_partkey", *[c.alias(name) for name, c in records.scored(criteria).items()])
