"""Learned decision lists over text statistics, as ordered Spark conditional expressions.

Sequential covering: a rule is a conjunction of thresholds, grown on two thirds
of the labelled rows by information gain, pruned on the rest, and accepted only
if its precision there is high.  What a rule covers leaves the growing set and
the next rule is learned.  The list ends in "keep".
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_stats import COUNTS, RATIOS, counts_of, ratio_column, with_counts

MAX_LABELLED = 20_000


@dataclass(frozen=True)
class Rule:
    terms: tuple[tuple[str, str, float], ...]  # ratio, ">=" or "<", threshold
    precision: float
    covered: int

    def condition(self) -> Column:
        out = F.lit(True)
        for name, op, at in self.terms:
            out = out & ((ratio_column(name) >= at) if op == ">=" else (ratio_column(name) < at))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {op} {at:.6g}" for n, op, at in self.terms)


def _cover(x: np.ndarray, terms: list[tuple[int, str, float]]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, op, at in terms:
        hit &= (x[:, f] >= at) if op == ">=" else (x[:, f] < at)
    return hit


def _grow(x: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray], most: int) -> list[tuple[int, str, float]]:
    terms: list[tuple[int, str, float]] = []
    hit = np.ones(len(x), bool)
    for _ in range(most):
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        if not p or not n:
            break
        best, gain = None, 1e-9
        for f, at in enumerate(cuts):
            above = x[hit, f][:, None] >= at[None, :]
            pa_, na = (above & bad[hit][:, None]).sum(0), (above & ~bad[hit][:, None]).sum(0)
            for op, pos, neg in ((">=", pa_, na), ("<", p - pa_, n - na)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pos > 0, pos * (np.log2(pos / np.maximum(pos + neg, 1)) - np.log2(p / (p + n))), 0)
                i = int(np.argmax(g))
                if g[i] > gain:
                    best, gain = (f, op, float(at[i])), g[i]
        if best is None:
            break
        terms.append(best)
        hit &= _cover(x, [best])
    return terms


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], max_rules: int = 12, max_terms: int = 4, least_precision: float = 0.97, least_covered: int = 8, seed: int = 7) -> list[Rule]:
    """An ordered list of rules that tell bad rows; ``x`` has a column per name."""
    order = np.random.default_rng(seed).permutation(len(x))
    x, bad = x[order], bad[order]
    third = len(x) // 3
    px, pb, gx, gb = x[:third], bad[:third], x[third:], bad[third:]
    rules: list[Rule] = []
    while len(rules) < max_rules and gb.any() and len(gx):
        cuts = [np.unique(np.quantile(np.concatenate([gx[gb, f], gx[:, f]]), np.linspace(0.01, 0.99, 60))) for f in range(x.shape[1])]
        terms = _grow(gx, gb, cuts, max_terms)
        best, worth = None, -2.0
        for k in range(1, len(terms) + 1):
            hit = _cover(px, terms[:k])
            p, n = (hit & pb).sum(), (hit & ~pb).sum()
            v = (p - n) / max(p + n, 1)
            if v > worth + 1e-12:
                best, worth = (k, p, n), v
        if best is None:
            break
        k, p, n = best
        hit = _cover(gx, terms[:k])
        p, n = p + (hit & gb).sum(), n + (hit & ~gb).sum()
        if p + n < least_covered or p < least_precision * (p + n):
            break
        rules.append(Rule(tuple((names[f], op, at) for f, op, at in terms[:k]), float(p / (p + n)), int(p + n)))
        hit_p = _cover(px, terms[:k])
        gx, gb, px, pb = gx[~hit], gb[~hit], px[~hit_p], pb[~hit_p]
    return rules


def labelled_rows(docs: DataFrame, labels: DataFrame, columns: list[str], fields: list[Column], id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> DataFrame:
    """``_k``, the labels as ``_l_..`` and ``fields`` of at most ``most`` labelled rows of ``docs``, chosen by a hash of the id.

    One row for an id: of rows that share one, that of the least hash of its
    text; of labels that share one, the least.  Null ids are no labels.
    """
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_k")).agg(F.min(F.struct(*[F.col(c).alias(f"_l_{c}") for c in columns])).alias("_l"))
    picked = known.orderBy(F.xxhash64("_k"), "_k").limit(most)
    slim = docs.select(F.col(f"`{id_col}`").alias("_k"), F.xxhash64(F.col(f"`{text_col}`")).alias("_order"), F.struct(*fields).alias("_f"))
    one = slim.join(F.broadcast(picked), "_k").groupBy("_k").agg(F.first("_l").alias("_l"), F.min_by("_f", "_order").alias("_f"))
    return one.select("_k", "_l.*", "_f.*")


def learn_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, **options: object) -> list[Rule]:
    """Rules from at most ``max_labelled`` labelled rows (``labels``: id, quality 0 or 1); none without both kinds of labels.

    A list has at most 12 rules of 4 terms each (``max_rules`` and ``max_terms``
    of :func:`learn`).  A null text counts as one without words; other columns
    are ignored whatever their names.
    """
    if not {id_col, "quality"} <= set(labels.columns):
        return []
    rows = labelled_rows(docs, labels.where("quality is not null"), ["quality"], [F.col(f"`{text_col}`").alias("_text")], id_col, text_col, max_labelled)
    made = counts_of(rows, [F.col("_k"), F.col("_l_quality").alias("_q")], "_text").select("_k", "_q", *[ratio_column(n).alias(n) for n in RATIOS]).toPandas().sort_values("_k")
    if not len(made):
        return []
    return learn(made[list(RATIOS)].to_numpy(float), (made["_q"] == 0).to_numpy(), list(RATIOS), **options)


def verdict(rules: list[Rule]) -> Column:
    """True for rows that the list keeps: the first rule whose condition holds decides."""
    out = None
    for r in rules:
        out = F.when(r.condition(), F.lit(False)) if out is None else out.when(r.condition(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def apply_rules(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id_col``, its counts, ``base_failed`` and ``kept``.

    A null text has no words and fails the base rule; repeated rows come back as
    often as they stand; other columns are ignored; an empty table stays empty.
    """
    counted = counts_of(docs, [F.col(f"`{id_col}`").alias("_key")], text_col)
    return counted.select(F.col("_key").alias(id_col), *COUNTS, F.expr(BASE_FAILED).alias("base_failed"), (~F.expr(BASE_FAILED) & verdict(rules)).alias("kept"))


def filter_by_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`apply_rules` keeps, with their columns."""
    kept = with_counts(docs, text_col).where(~F.expr(BASE_FAILED) & verdict(rules))
    return kept.select(*[F.col("_rest").getField(c).alias(c) for c in docs.columns])
