"""Gates, guards and roll-ups over records."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text


def matching(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows that have all given values; a value of None asks for nothing."""
    terms = [F.col(c) == F.lit(v) for c, v in wanted.items() if v is not None]
    return df.where(reduce(Column.__and__, terms)) if terms else df


def glob(value: Column, pattern: str) -> Column:
    """Does all of ``value`` fit a pattern of ``*``, ``?`` and ``[...]``; a plain start goes without a regular expression."""
    if re.fullmatch(r"[^*?\[]*\*", pattern):
        return value.startswith(pattern[:-1])
    parts = re.findall(r"\*|\?|\[[^\]]*\]|[^*?\[]+", pattern)
    made = "".join({"*": ".*", "?": "."}.get(p, p if p.startswith("[") else re.escape(p)) for p in parts)
    return value.rlike(f"(?s)^{made}$")


def has_topic(tags: Column, courses: Column, topic: str) -> Column:
    """Is ``topic`` a tag or a facet of any course (array of structs with ``facets``)."""
    return F.array_contains(tags, topic) | F.exists(courses, lambda c: F.array_contains(c["facets"], topic))


def failed_rules(rules: Mapping[str, Column]) -> Column:
    """Names of rules that don't hold or can't be judged, in order of names."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(rules[n], F.lit(False)), n) for n in sorted(rules)]))


def mentions(surface: Column, query: str, facets: Mapping[str, Sequence[str]], drop: Sequence[str] = ()) -> Column:
    """Does a text hold any token of ``query`` or of the facets that it names."""
    tokens = [w for w in query.lower().split() if w not in drop]
    tokens += [x for f, xs in facets.items() if f in query.lower() for x in xs]
    low = F.lower(surface)
    return reduce(Column.__or__, [F.contains(low, F.lit(x)) for x in dict.fromkeys(tokens)], F.lit(False))


def validity(begin: Column, until: Column, at: Column) -> Column:
    """Both ends count; no end means for good."""
    return F.when(begin > at, "NOT_YET_VALID").when(until.isNotNull() & (until < at), "EXPIRED").otherwise("VALID")


def append_only_faults(before: DataFrame, after: DataFrame, key: str, body: str) -> DataFrame:
    a, b = before.select(key, F.col(body).alias("_a")), after.select(key, F.col(body).alias("_b"), F.lit(True).alias("_there"))
    fault = F.when(F.col("_there").isNull(), "DELETED").when(~F.col("_a").eqNullSafe(F.col("_b")), "UPDATED")
    return a.join(b, key, "left").select(key, fault.alias("fault")).where("fault is not null")


def in_both(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b, list(keys), "left_semi")


def replayed(requests: DataFrame, keys: Sequence[str], digest: str, order: Sequence[str], id_col: str) -> DataFrame:
    """``id_col, outcome, origin``: APPLIED for the first request of each key, REPLAYED for the same one again, CONFLICT for another one."""
    first = requests.groupBy(*keys).agg(F.min(F.struct(*order, F.col(digest).alias("_d"), F.col(id_col).alias("_o"))).alias("f"))
    j = requests.join(first, list(keys))
    outcome = F.when(F.col(id_col) == F.col("f._o"), "APPLIED").when(F.col(digest) == F.col("f._d"), "REPLAYED").otherwise("CONFLICT")
    return j.select(id_col, outcome.alias("outcome"), F.col("f._o").alias("origin"))


def rolled_up(rows: DataFrame, key: str, parts: Mapping[str, tuple[str, int]], starters: DataFrame) -> DataFrame:
    """Per key its number of rows, and of every part the first few values in order, joined by commas; ``starters`` without a row follow with none."""
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("uses"))
    for name, (column, most) in parts.items():
        distinct = rows.select(key, column).where(F.col(column).isNotNull()).distinct()
        first = distinct.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(column))).where(F.col("_rn") <= most)
        listed = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(column)), lambda x: x.cast("string")), ",").alias(name))
        out = out.join(listed, key, "left").withColumn(name, F.coalesce(name, F.lit("")))
    unused = starters.select(key).distinct().join(out, key, "left_anti")
    empty = [F.lit("").alias(n) for n in parts]
    return out.withColumn("origin", F.lit("COURSE")).unionByName(unused.select(key, F.lit(0).cast("long").alias("uses"), *empty, F.lit("STARTER").alias("origin")))


def edges_of_inputs(nodes: DataFrame, path: str, folder: str, given: str) -> DataFrame:
    """``source, target`` of the inputs that lead to a known node."""
    made = nodes.select(text.joined_path(F.col(folder), F.col(given)).alias("source"), F.col(path).alias("target"))
    return made.join(nodes.select(F.col(path).alias("source")), "source", "left_semi").select("source", "target")


def level(mean: Column, gate: Column, steps: Mapping[str, tuple[float, float]], least: str) -> Column:
    """The first level whose mean and gate are both reached."""
    out = None
    for name, (m, g) in steps.items():
        hit = (mean >= m) & (gate >= g)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(least)


def scored(criteria: Mapping[str, Column]) -> dict[str, Column]:
    """Criteria passed, whether all are, and the name of the first that isn't."""
    held = {n: F.coalesce(c, F.lit(False)) for n, c in criteria.items()}
    return {
        "score": reduce(Column.__add__, [c.cast("int") for c in held.values()]),
        "passed": reduce(Column.__and__, held.values()),
        "first_reason": F.coalesce(*[F.when(~c, n) for n, c in held.items()]),
    }


def is_rubric(raw: Column) -> Column:
    """Is a text JSON of a rubric: a score from 0 to 4, the verdict that goes with it, and at least one reason."""
    r = F.from_json(F.when(F.try_parse_json(raw).isNotNull(), raw), "score bigint, passed boolean, reasons array<string>")
    return F.coalesce(r["score"].between(0, 4) & (r["passed"] == (r["score"] == 4)) & (F.size(r["reasons"]) > 0), F.lit(False))


def case_score(low: Column, groups: Sequence[Sequence[str]], forbidden: Sequence[str], actions: Column, allowed: Sequence[str]) -> dict[str, Column]:
    """Any term of every concept group, no forbidden term, and no action off the list."""
    any_of = lambda xs: reduce(Column.__or__, [F.contains(low, F.lit(x)) for x in xs], F.lit(False))
    return {
        "concepts": reduce(Column.__and__, [any_of(g) for g in groups], F.lit(True)),
        "clean": ~any_of(forbidden),
        "allowed": F.size(F.array_except(actions, F.array(*[F.lit(a) for a in allowed]))) == 0,
    }


def tail(log: DataFrame, run: str, sequence: str, after: int, page: int = 100) -> DataFrame:
    """Events of each run behind ``after``, at most ``page`` (held between 1 and 200)."""
    rn = F.row_number().over(Window.partitionBy(run).orderBy(sequence))
    return log.where(F.col(sequence) > after).withColumn("_rn", rn).where(F.col("_rn") <= max(1, min(page, 200))).drop("_rn")


def rolling_summary(lines: DataFrame, key: str, order: str, line: str, recent: int, longest: int) -> DataFrame:
    """Lines older than the newest ``recent``, the oldest dropped beyond ``longest`` characters: ``key, summary, through_turn, lines``."""
    back = Window.partitionBy(key).orderBy(F.desc(order))
    rows = lines.withColumn("_rn", F.row_number().over(back)).where(F.col("_rn") > recent)
    rows = rows.withColumn("_upto", F.sum(F.length(line) + 1).over(back.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("_upto") <= longest) | (F.col("_rn") == recent + 1))
    kept = F.array_sort(F.collect_list(F.struct(order, line)))
    made = rows.groupBy(key).agg(kept.alias("k"), F.max(order).alias("through_turn"), F.count(F.lit(1)).alias("lines"))
    return made.select(key, F.array_join(F.transform("k", lambda x: x[line]), "\n").alias("summary"), "through_turn", "lines")


def mismatches(pairs: Sequence[tuple[str, DataFrame, Column, Column]]) -> DataFrame:
    """Per named join, how many of its rows disagree."""
    made = [df.where(a != b).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n") for name, df, a, b in pairs]
    return reduce(DataFrame.unionByName, made)


def tagged(parts: Mapping[str, DataFrame], name: str) -> DataFrame:
    """Frames of one shape on top of one another, each with its tag in column ``name``."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(tag).alias(name), "*") for tag, df in parts.items()])


def first_mismatch(relations: Mapping[str, tuple[DataFrame, Column, Column, str]]) -> DataFrame:
    """``relation, id`` of the first relation, by name, with rows whose two sides differ, and the least id of these; no row if all agree.

    Each relation gives one row, the least of its own, so nothing is sorted.
    """
    firsts = [rows.where(~a.eqNullSafe(b)).agg(F.min(F.col(key).cast("long")).alias("id")).select(F.lit(name).alias("relation"), "id") for name, (rows, a, b, key) in relations.items()]
    made = reduce(DataFrame.unionByName, firsts).where("id is not null")
    first = made.agg(F.min(F.struct("relation", "id")).alias("m")).where("m is not null")
    return first.select("m.relation", "m.id")
