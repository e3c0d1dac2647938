"""Relational building blocks: latest rows, gap filling, division, differences, paging and versioned writes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order`` (give it a total order); filtered by rank before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def latest_value(df: DataFrame, keys: Sequence[str], value: Column, order: Column, name: str) -> DataFrame:
    """One value of each key's latest row, without sorting."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(name))


def gap_filled_counts(df: DataFrame, column: str, values: Sequence[str], name: str = "n") -> DataFrame:
    """Counts for a fixed list of categories, zero for those without rows, with their ordinal."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"ordinal int, {column} string")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias(name))
    return dim.join(counts, column, "left").select("ordinal", column, F.coalesce(name, F.lit(0)).alias(name))


def satisfies_all(df: DataFrame, key: str, item: str, required: int) -> DataFrame:
    """Keys that have ``required`` distinct items (relational division)."""
    return df.groupBy(key).agg(F.countDistinct(item).alias("_k")).where(F.col("_k") == required).select(key)


def outer_diff(before: DataFrame, after: DataFrame, key: str, signature: str) -> DataFrame:
    """ADDED, REMOVED and CHANGED keys between two snapshots."""
    a = before.select(F.col(key).alias("_a"), F.col(signature).alias("_sa"))
    b = after.select(F.col(key).alias("_b"), F.col(signature).alias("_sb"))
    status = F.when(F.col("_a").isNull(), "ADDED").when(F.col("_b").isNull(), "REMOVED").when(~F.col("_sa").eqNullSafe(F.col("_sb")), "CHANGED")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), status.alias("change")).where("change is not null")


def missing_and_unexpected(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Ids of one side only, by which side lacks them."""
    missing = expected.select(key).distinct().join(found, key, "left_anti").withColumn("side", F.lit("MISSING"))
    return missing.unionByName(found.select(key).distinct().join(expected, key, "left_anti").withColumn("side", F.lit("UNEXPECTED")))


#: Readers' languages, and the alphabets in which they look names up.
ALPHABETS = {"zh-CN": "zh_Hans_CHN", "de": "de", "es": "es", "fr": "fr", "en": "en", None: "UNICODE"}


def collated(name: Column, language: str | None = None) -> Column:
    """A name as a reader of a language orders it: letters before accents, accents before case; in Chinese, Han characters by their sound and before all letters.

    It sorts, ranges and compares by that alphabet, and is still the name; names that only look alike are different.
    """
    return F.collate(name, ALPHABETS[language])


def keyset_page(df: DataFrame, order: Sequence[tuple[str, bool]], after: Sequence[object] | None, size: int) -> DataFrame:
    """The page after a cursor; ``order`` holds (column, descending) with a unique column last.  One row more than ``size`` tells that a next page exists.

    A column of :func:`collated` names is paged by its alphabet.
    """
    if after is not None:
        terms, equal = [], F.lit(True)
        for (name, desc), value in zip(order, after, strict=True):
            c = F.col(name)
            collation = getattr(df.schema[name].dataType, "collation", "UTF8_BINARY")
            value = F.lit(value) if collation == "UTF8_BINARY" else F.collate(F.lit(value), collation)
            terms.append(equal & ((c < value) if desc else (c > value)))
            equal = equal & (c == value)
        df = df.where(reduce(Column.__or__, terms))
    return df.orderBy(*[F.desc(n) if d else F.asc(n) for n, d in order]).limit(size + 1)


def offset_page(df: DataFrame, order: Sequence[Column], size: int, offset: int = 0, most: int = 200) -> DataFrame:
    """A page of ``size`` rows (held between 1 and ``most``) with ``total``, the number of all rows, and ``truncated``, whether more follow."""
    size = max(1, min(size, most))
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("total")))
    return df.orderBy(*order).offset(max(0, offset)).limit(size).crossJoin(total).withColumn("truncated", F.col("total") > offset + size)


def ordinal(value: Column, order: Sequence[str]) -> Column:
    """The place of a value in a fixed order; others come last."""
    out = F.when(value == order[0], 0)
    for i, v in enumerate(order[1:], 1):
        out = out.when(value == v, i)
    return out.otherwise(len(order))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def nested(parents: DataFrame, children: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """Parents with their children as an ordered array; none is an empty array."""
    rest = [c for c in children.columns if c != key and c not in order]
    packed = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias(name))
    kind = packed.schema[name].dataType.simpleString()
    return parents.join(packed, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def pivoted_histogram(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Value counts of several columns at once: dimension, value, n."""
    pairs = ", ".join(f"'{d}', cast({d} as string)" for d in dimensions)
    return df.select(F.expr(f"stack({len(dimensions)}, {pairs}) as (dimension, value)")).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def safe_rate(num: Column, den: Column, digits: int = 3) -> Column:
    """A rate rounded half up, null if there is nothing to divide by."""
    scale = float(10**digits)
    return F.when(den > 0, F.floor(num / den * scale + 0.5) / scale)


def upsert(target: DataFrame, incoming: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """``target`` after inserting or updating by key: of each key, the row of the greatest version, incoming rows first on ties."""
    both = target.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return latest_per_key(both, keys, [F.desc(version), F.desc("_new")]).drop("_new")


def insert_absent(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The incoming rows whose key the target lacks; one of each key."""
    return incoming.dropDuplicates(list(keys)).join(target, list(keys), "left_anti")


def prune(target: DataFrame, incoming: DataFrame, key: str, namespace: str) -> DataFrame:
    """``target`` without rows of the incoming namespaces that the incoming batch no longer has."""
    owned = incoming.select(namespace).distinct()
    gone = target.join(owned, namespace, "left_semi").join(incoming, [namespace, key], "left_anti").select(namespace, key)
    return target.join(gone, [namespace, key], "left_anti")


def append_sequence(log: DataFrame, incoming: DataFrame, key: str, order: Sequence[Column], seq: str = "sequence") -> DataFrame:
    """Incoming rows numbered on from each key's last sequence."""
    last = log.groupBy(key).agg(F.max(seq).alias("_last"))
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return incoming.join(last, key, "left").withColumn(seq, (F.coalesce("_last", F.lit(0)) + rn).cast("long")).drop("_last")
