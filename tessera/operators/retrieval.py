"""Explainable ranking: weighted fields, median-lifted similarity, recency and fusion."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.text import han_ngrams, note_core, note_signature, overlapping

from . import blocks
from .stages import written


#: Words that say nothing of a technical question; fixed values.
PLAIN_WORDS = ("the", "and", "for", "with", "how", "what")


def search_tokens(text: Column, low: int = 2, high: int = 4) -> Column:
    """Latin tokens of two characters or more and Han n-grams of a lower-cased text; a repeated token may stand more than once."""
    latin = F.regexp_extract_all(text, F.lit(r"([a-z0-9][a-z0-9._+\-]+)"), 1)
    return F.when(text.rlike(r"\p{IsHan}"), F.concat(latin, han_ngrams(text, low, high))).otherwise(latin)


def found_tokens(text: Column, tokens: Sequence[str], low: int = 2, high: int = 4) -> Column:
    """Those of ``tokens`` that :func:`search_tokens` of a lower-cased text would give, without listing all of its tokens."""
    latin = [t for t in tokens if re.fullmatch(r"[a-z0-9][a-z0-9._+\-]+", t)]
    han = [t for t in tokens if low <= len(t) <= high and regex.fullmatch(r"\p{Han}+", t)]
    out = []
    if latin:  # the longest first: of tokens that begin alike only a whole one fits
        any_of = "|".join(re.escape(t) for t in sorted(latin, key=len, reverse=True))
        out.append(F.regexp_extract_all(text, F.lit(rf"(?<![a-z0-9._+\-])[._+\-]*({any_of})(?![a-z0-9._+\-])"), 1))
    out += [F.when(F.contains(text, F.lit(t)), F.array(F.lit(t))).otherwise(F.array().cast("array<string>")) for t in han]
    return F.array_distinct(F.concat(*out)) if out else F.array().cast("array<string>")


def once(df: DataFrame, keep: Sequence[str | Column], **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row, however often later steps use them: a one-row generator stands between."""
    made = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select(*keep, F.explode(made).alias("_once")).select("*", "_once.*").drop("_once")


def lexical_matches(df: DataFrame, keep: Sequence[str | Column], fields: Mapping[str, tuple[Column, int]], query: Column) -> DataFrame:
    """``keep`` columns with ``score``, the sum over fields and their matched query tokens of min(length, 4) times the field's weight, and ``matched``, all matched tokens in order.

    ``fields`` hold token arrays, ``query`` an array of distinct tokens.
    """
    hits = once(df, keep, **{f"_{n}": F.array_intersect(query, c) for n, (c, _) in fields.items()})

    def points(n: str, w: int) -> Column:
        return F.aggregate(f"_{n}", F.lit(0).cast("long"), lambda s, t: s + F.least(F.length(t), F.lit(4)) * w)

    score = reduce(Column.__add__, [points(n, w) for n, (_, w) in fields.items()])
    matched = F.array_sort(F.array_distinct(F.concat(*[F.col(f"_{n}") for n in fields])))
    return hits.withColumn("score", score).withColumn("matched", matched).drop(*[f"_{n}" for n in fields])


def ranked(scored: DataFrame, key: str, least: int = 12, most: int | None = 5) -> DataFrame:
    """Scores of ``least`` or more, best first, ties by ``key``; ``confidence`` is the share of 48 points."""
    good = scored.where(F.col("score") >= least).withColumn("confidence", half_up(F.least(F.col("score") / 48.0, F.lit(1.0)), 3).cast("double"))
    return good if most is None else good.orderBy(F.desc("score"), key).limit(most)


def method(lexical: Column, semantic: Column, least_lexical: float, least_semantic: float) -> Column:
    """Which of both channels found a row."""
    return F.when((lexical >= least_lexical) & (semantic >= least_semantic), "HYBRID").when(semantic >= least_semantic, "SEMANTIC").otherwise("LEXICAL")


def memory_overlap(query: Column, content: Column) -> Column:
    """Points for shared tokens (3, or 2 for those of two characters) and 8 more if one text holds the other."""
    both = F.array_intersect(search_tokens(query, 2, 2), search_tokens(content, 2, 2))  # each shared token once
    points = F.aggregate(both, F.lit(0), lambda s, t: s + F.when(F.length(t) > 2, 3).otherwise(2))
    inside = (F.length(query) >= 4) & (F.length(content) >= 4) & (F.contains(query, content) | F.contains(content, query))
    return points + F.when(inside, 8).otherwise(0)


def memory_similarity(cos: Column, baseline: Column, known: Column) -> Column:
    """Similarity above the median of a holder's notes as a share of what is above it; a single note is measured against a fixed floor."""
    bound = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))
    lift = F.greatest(F.lit(0.0), bound - baseline)
    alone = F.when(bound >= 0.35, F.least(F.lit(1.0), (bound - 0.35) / 0.65)).otherwise(0.0)
    several = F.when((bound >= 0.3) & (lift >= 0.03), F.least(F.lit(1.0), lift / F.greatest(F.lit(0.05), 1 - baseline))).otherwise(0.0)
    return F.when(cos.isNull(), 0.0).when(known == 1, alone).otherwise(several)


#: The ranks of the middle: one for an odd number of values, two for an even one.
MIDDLE = {"low": 0.5, "high": lambda n: F.floor(n / 2) + 1}


def medians(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The exact median of each key: ``keys`` and ``median``; keys without a value have none."""
    return nearest_ranks(df, keys, value, MIDDLE).select(*keys, ((F.col("low") + F.col("high")) / 2).alias("median"))


def nearest_ranks(df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float | Callable[[Column], Column]], slices: int = 1024) -> DataFrame:
    """Exact nearest-rank percentiles per key: ``keys`` and a column for each of ``quantiles``, shares or ranks made from the number of values.

    Equal values are counted first, then summed by ranges of a key's span; only
    the ranges that hold a wanted rank are put in order, each by itself, so a
    frequent key isn't sorted in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    span = counts.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_n"))
    cell = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * slices), F.lit(slices - 1))).otherwise(0)
    placed = counts.join(span, list(keys)).select(*keys, "_v", "_c", "_n", cell.alias("_cell"))  # small once counted, and exchanged once
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*keys, "_cell").agg(F.sum("_c").alias("_s"), F.first("_n").alias("_n")).withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    ranks = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), (q(F.col("_n")) if callable(q) else F.greatest(F.ceil(F.col("_n") * F.lit(q)), F.lit(1))).alias("rank")) for n, q in quantiles.items()]))
    wanted = sums.select(*keys, "_cell", "_s", "_before", ranks.alias("_r")).where((F.col("_r.rank") > F.col("_before")) & (F.col("_r.rank") <= F.col("_before") + F.col("_s")))
    found = placed.join(wanted.select(*keys, "_cell").distinct(), [*keys, "_cell"], "left_semi")
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_cell").orderBy("_v"))
    rows = found.withColumn("_upto", upto).join(wanted.select(*keys, "_cell", "_before", "_r"), [*keys, "_cell"])
    at = F.col("_r.rank") - F.col("_before")
    hit = rows.where((at <= F.col("_upto")) & (at > F.col("_upto") - F.col("_c")))
    return hit.groupBy(*keys).agg(*[F.max(F.when(F.col("_r.name") == n, F.col("_v"))).alias(n) for n in quantiles])


#: A unit of more classes under like keys, polarity and numbers is frequent.
UNIT_BLOCK = 64
#: Classes of a block, about; two blocks are compared at once.
BLOCK_CLASSES = 4096


def near_duplicate_classes(notes: DataFrame, keys: Sequence[str], id_col: str, note: str) -> DataFrame:
    """Per row ``id_col, class_id`` (the least id of an equal note under the same keys) and ``links`` (other classes that tell the same).

    ``note`` is a canonical text.  Classes are compared, not rows, and only
    under like polarity and numbers.  A pair above the threshold shares one of
    each one's rarest units, as many as it can't do without.  What shares a rare
    one is compared pair by pair.  Classes that have a frequent one among them
    are compared in blocks, each pair of blocks in a step of its own that counts
    what all their classes share, so no pair of these is ever a row.  Units and
    bigrams are compared by their 64-bit hashes.
    """
    cored = once(notes, [F.col(id_col).alias("id"), *keys, F.col(note).alias("note")], core=note_core(F.col(note)))
    made = once(cored, ["id", *keys, F.sha2("note", 256).alias("same")], sig=note_signature(F.col("note"), F.col("core")))
    like = F.xxhash64(*keys, F.col("sig.negative").cast("int"), "sig.numbers")
    rows = written(made.select("id", *keys, "same", like.alias("like"), *[F.transform(f"sig.{c}", lambda x: F.xxhash64(x)).alias(c) for c in ("units", "bigrams")]))
    classes = rows.groupBy(*keys, "same").agg(F.min("id").alias("class_id"), *[F.first(c).alias(c) for c in ("like", "units", "bigrams")])
    signed = written(classes.select("class_id", "like", "units", "bigrams").where(F.size("units") >= 3))
    unit = signed.select("class_id", F.size("units").alias("n"), "like", F.explode("units").alias("unit"))
    common = unit.groupBy("like", "unit").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = unit.join(common, ["like", "unit"], "left").withColumn("df", F.coalesce("df", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("class_id").orderBy("df", "unit"))
    prefix = written(shared.withColumn("rank", rank).where((F.col("rank") <= F.col("n") - F.ceil(F.col("n") * 0.8) + 1) & (F.col("df") > 1)).drop("rank"))
    frequent = written(prefix.where(F.col("df") > UNIT_BLOCK).select("class_id").distinct())
    counts = _links_in_blocks(signed.join(frequent, "class_id", "left_semi")).unionByName(_links_by_rare_units(signed, prefix.where(F.col("df") <= UNIT_BLOCK), frequent))
    counts = counts.groupBy("class_id").agg(F.sum("links").alias("links"))
    ids = rows.groupBy(*keys, "same").agg(F.min("id").alias("class_id"))
    named = rows.select("id", *keys, "same").join(ids, [*keys, "same"]).join(counts, "class_id", "left")
    return named.select(F.col("id").alias(id_col), "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def _links_by_rare_units(signed: DataFrame, rare: DataFrame, frequent: DataFrame) -> DataFrame:
    """``class_id, links`` of pairs that share one of ``rare`` units and aren't both among the ``frequent`` classes, which meet in blocks."""
    marked = rare.join(frequent.select("class_id", F.lit(True).alias("hot")), "class_id", "left").select("like", "unit", "n", "class_id", F.coalesce("hot", F.lit(False)).alias("hot"))
    other = marked.select("like", "unit", F.col("n").alias("m"), F.col("class_id").alias("y"), F.col("hot").alias("hot_y"))
    near = marked.withColumnRenamed("class_id", "x").join(other, ["like", "unit"]).where("x < y and not (hot and hot_y) and least(n, m) >= 0.8 * greatest(n, m)").select("x", "y").distinct()
    sig = signed.select("class_id", F.struct("units", "bigrams").alias("sig"))
    both = near.join(sig.select(F.col("class_id").alias("x"), F.col("sig").alias("sx")), "x").join(sig.select(F.col("class_id").alias("y"), F.col("sig").alias("sy")), "y")
    linked = both.where(overlapping(F.col("sx"), F.col("sy"))).select(F.explode(F.array("x", "y")).alias("class_id"))
    return linked.groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))


def _links_in_blocks(members: DataFrame) -> DataFrame:
    """``class_id, links`` of all pairs of ``members`` of one ``like``, in blocks of about ``BLOCK_CLASSES``."""
    id_field = members.schema["class_id"]
    kind, id_type = id_field.dataType.simpleString(), to_arrow_type(id_field.dataType)
    # Sizes within a fifth fall into the same or neighbouring steps of a quarter.
    stepped = members.withColumn("step", F.floor(F.log(F.size("units").cast("double")) / F.log(F.lit(1.25))).cast("int"))
    sizes = stepped.groupBy("like", "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES).cast("int").alias("blocks"))
    placed = stepped.join(sizes, ["like", "step"]).withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")).drop("blocks")
    place = ("like", "step", "block")
    packed = written(placed.groupBy(*place).applyInArrow(blocks.pack(place, id_type), f"like bigint, step int, block int, {blocks.fields(kind)}"))
    whole = packed.select(*place, F.struct(*packed.columns[3:]).alias("a"))
    own = packed.select(*place)
    near = own.select("like", F.explode(F.array("step", F.col("step") - 1)).alias("low"), "step", "block").toDF("like", "step", "step_b", "block_b")
    pairs = own.join(near, ["like", "step"]).where("step < step_b or block <= block_b")
    met = pairs.join(whole, list(place)).join(whole.toDF("like", "step_b", "block_b", "b"), ["like", "step_b", "block_b"])
    met = met.select(F.expr("step = step_b and block = block_b").alias("same"), "a", "b")
    return met.mapInArrow(blocks.count_links(id_type), f"class_id {kind}, links bigint")


def newest(df: DataFrame, time: str, tie: str, k: int, slices: int = 1024) -> DataFrame:
    """The ``k`` rows of the greatest ``time`` (a number), ties by ascending ``tie``; rows without a time are none of them.

    The k-th value is found by counting ranges, so no task sees all rows; only
    rows of that very value are put in order, and no more than ``k`` of these.
    """
    rows = df.where(F.col(time).isNotNull())
    span = rows.agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("lo"), F.max(time).alias("hi")).first()
    n, lo, hi, above = span["n"], span["lo"], span["hi"], 0  # ``above``: rows beyond ``hi``
    if n <= k:
        return rows
    while hi > lo:
        width = (float(hi) - float(lo)) / slices
        cell = F.least(F.floor((F.col(time).cast("double") - float(lo)) / width), F.lit(slices - 1))
        parts = rows.where(F.col(time).between(lo, hi)).groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("lo"), F.max(time).alias("hi")).orderBy(F.desc("c")).collect()  # at most ``slices`` rows
        for p in parts:
            if above + p["n"] >= k:
                break
            above += p["n"]
        if (p["lo"], p["hi"]) == (lo, hi):
            break
        lo, hi = p["lo"], p["hi"]
    last = rows.where(F.col(time).between(lo, hi)).orderBy(F.desc(time), tie).limit(k - above)
    return rows.where(F.col(time) > hi).unionByName(last)


def median_of(df: DataFrame, score: str, slices: int = 512) -> float:
    """The exact median of a column, 0 if it has no value.

    Values are counted by ranges first; only the range or two that hold the
    middle are looked at again, so no task sees all values.
    """
    rows = df.select(F.col(score).cast("double").alias("x")).where(F.col("x").isNotNull())
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    n, lo, hi = total["n"], total["lo"], total["hi"]
    if not n:
        return 0.0
    wanted = sorted({(n - 1) // 2, n // 2})
    before = 0
    while hi > lo and n > 4096:
        width = (hi - lo) / slices
        cell = F.least(F.floor((F.col("x") - lo) / width), F.lit(slices - 1))
        parts = rows.where(F.col("x").between(lo, hi)).groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("c").collect()
        at, held = before, []
        for p in parts:
            if at <= wanted[-1] and at + p["n"] > wanted[0]:
                held.append((at, p))
            at += p["n"]
        if (held[0][1]["lo"], held[-1][1]["hi"]) == (lo, hi):
            break
        before, lo, hi, n = held[0][0], held[0][1]["lo"], held[-1][1]["hi"], sum(p["n"] for _, p in held)
    if hi == lo:
        return float(lo)
    rest = rows.where(F.col("x").between(lo, hi)).groupBy("x").agg(F.count(F.lit(1)).alias("n")).orderBy("x")
    found, at = [], before
    for r in rest.toLocalIterator():
        found += [r["x"] for w in wanted if at <= w < at + r["n"]]
        at += r["n"]
        if len(found) == len(wanted):
            break
    return float(sum(found) / len(found))


def half_up(x: Column, digits: int) -> Column:
    s = float(10**digits)
    return F.floor(x * s + 0.5) / s


def with_baseline(df: DataFrame, score: str) -> DataFrame:
    """``df`` with the median of ``score`` over all rows; what led to them runs once."""
    df = written(df)
    return df.withColumn("baseline", F.lit(median_of(df, score)))


def calibrated(cos: Column, baseline: Column, least: float = 0.2, lift: float = 0.025) -> Column:
    """Similarity above the median, as a share of what is above it; zero if too small."""
    up = F.greatest(F.lit(0.0), cos - baseline)
    value = up / F.greatest(F.lit(0.05), 1 - baseline)
    return F.when((cos >= least) & (up >= lift), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))).otherwise(0.0)


def combined(cal: Column, lexical: Column) -> Column:
    return 0.72 * cal + 0.28 * F.least(lexical / 48.0, F.lit(1.0))


def relevant(cal: Column, lexical: Column) -> Column:
    return (lexical >= 6) | (cal >= 0.12) | (combined(cal, lexical) >= 0.24)


def recency(age_days: Column, half_life: float = 30.0) -> Column:
    return 0.8 + 0.2 * F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life)


def fused(text: Column, image: Column) -> Column:
    """Both channels, or the one that there is."""
    return F.when(text.isNotNull() & image.isNotNull(), 0.58 * image + 0.42 * text).otherwise(F.coalesce(image, text))
