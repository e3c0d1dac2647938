"""Counts by document that quality rules and classifiers start from, computed on whole texts in Arrow blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, one_array, whole_rows
from .textblock import SPACE, TextBlock, blocks, combine

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_short")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!?")] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True

#: What rules and classifiers compare: SQL over the counts, none of which divides by zero.
RATIOS = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "short_word_share": "n_short / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


#: Texts are counted in blocks of so many bytes: what is made of one stays in the cache, and little stands beside an Arrow batch.
COUNT_BYTES = 1 << 18


def ratio_column(name: str) -> Column:
    return F.expr(f"cast({RATIOS[name]} as double)")


def _by_doc(hit: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(hit) + 1, np.int64)
    np.cumsum(hit, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def twice(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur more than once."""
    s = np.sort(keys)
    several = s[1:][s[1:] == s[:-1]]
    if not len(several):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(several, keys), len(several) - 1)
    return several[at] == keys


def lines(block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of all lines, empty ones included, in order."""
    nl = np.flatnonzero(block.data == 10)
    start = np.concatenate([block.offs[:-1], nl + 1])
    doc = np.concatenate([np.arange(block.n), block.owner(nl)])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    end = block.offs[doc + 1].copy()
    same = doc[1:] == doc[:-1]
    end[:-1][same] = start[1:][same] - 1
    return start, end, doc


def repeated_words(block: TextBlock, start: np.ndarray, end: np.ndarray, doc: np.ndarray, width: int = 5) -> np.ndarray:
    """By word: does it stand in a window of ``width`` words that its text has twice or more."""
    n = len(start)
    if n < width:
        return np.zeros(n, bool)
    h = block.hashes(start, end)
    m = n - width + 1
    key = doc[:m].astype(np.uint64)
    for k in range(width):
        key = combine(key, h[k : k + m])
    inside = np.flatnonzero(doc[:m] == doc[width - 1 :])
    again = inside[twice(key[inside])]
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    return np.cumsum(edge[:-1]) > 0


def block_counts(block: TextBlock) -> dict[str, np.ndarray]:
    """The counts of :data:`COUNTS` for each document of a block."""
    start, end, doc = block.words()
    data, offs, n = block.data, block.offs, block.n
    rep = repeated_words(block, start, end, doc)
    ls, le, ld = lines(block)
    word = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~SPACE[data], out=word[1:])
    used = word[le] > word[ls]
    ls, le, ld = ls[used], le[used], ld[used]
    key = np.sort(combine(block.hashes(ls, le), ld.astype(np.uint64))) if len(ls) else np.zeros(0, np.uint64)
    n_lines = np.bincount(ld, minlength=n)
    dup = np.zeros(n, np.int64)
    if len(key) and (key[1:] == key[:-1]).any():
        own = combine(block.hashes(ls, le), ld.astype(np.uint64))
        order = np.argsort(own, kind="stable")
        again = np.zeros(len(own), bool)
        again[order[1:]] = own[order[1:]] == own[order[:-1]]
        dup = np.bincount(ld[again], minlength=n)
    lead = (data & 0xC0) != 0x80
    return {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": _by_doc(lead & ~SPACE[data], offs),
        "n_symbols": _by_doc(SYMBOLS[data], offs),
        "n_dup_lines": dup,
        "n_repeat_words": np.bincount(doc[rep], minlength=n),
        "n_lines": n_lines,
        "n_upper": _by_doc(_UPPER[data], offs),
        "n_digits": _by_doc(_DIGITS[data], offs),
        "n_marks": _by_doc(_MARKS[data], offs),
        "n_short": np.bincount(doc[end - start <= 2], minlength=n),
    }


def ratio_matrix(counts: dict[str, np.ndarray]) -> np.ndarray:
    """The values of :data:`RATIOS`, a row per document; the same formulas as the SQL."""
    words, chars, lines_ = (np.maximum(counts[c], 1).astype(np.float64) for c in ("n_words", "word_chars", "n_lines"))
    c = counts
    return np.stack([c["n_words"] * 1.0, c["word_chars"] / words, c["n_symbols"] / words, c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / words, c["n_dup_lines"] / lines_, c["n_repeat_words"] / words, c["n_short"] / words, c["n_words"] / lines_], axis=1)


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without other columns than ``_rest`` (all of them, the text too) beside the counts of :data:`COUNTS`."""
    packed, at = whole_rows(docs, text_col)
    return _counted(docs.select(packed.alias("_rest")), ["_rest"], lambda batch: one_array(batch.column("_rest")).field(at))


def counts_of(docs: DataFrame, key_cols: list[Column], text_col: str = "text") -> DataFrame:
    """``key_cols`` and the counts, without carrying texts on."""
    return _counted(docs.select(*key_cols, F.col(f"`{text_col}`").alias("_text")), None, lambda batch: batch.column("_text"))


def _counted(df: DataFrame, keep: list[str] | None, texts: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    keep = keep or [c for c in df.columns if c != "_text"]
    fields = [df.schema[c] for c in keep]
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields] + [(c, pa.int64()) for c in COUNTS])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(texts(batch), COUNT_BYTES):
                made = block_counts(b)
                yield arrow_batch(schema, *[one_array(batch.column(c)).slice(b.first, b.n) for c in keep], *[made[c].astype(np.int64) for c in COUNTS])

    return df.mapInArrow(apply, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{c} bigint" for c in COUNTS]))
