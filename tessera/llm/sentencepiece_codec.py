"""SentencePiece encoding and decoding by streaming Viterbi search.

A path cuts the text into pieces; the best path has the greatest sum of piece
scores.  The search keeps only positions within the longest piece of the
current one, and gives out ids as soon as the back-pointers of all surviving
positions meet in one boundary, so memory does not grow with the text.

Blanks are written as U+2581, one more stands before the text, and what the
vocabulary lacks is spelled in byte pieces, U+2581 itself included.  Decoding
gives back the very text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_type, one_array

SPACE = "▁"
_CACHE_ENTRIES = 500_000
_CACHE_CHARS = 40
_NEVER = -float("inf")
_NONE = object()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A vocabulary: pieces with scores, byte pieces, and what a decoder needs."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int], decoded: list[bytes]):
        self.byte_ids, self.decoded = byte_ids, decoded
        self.table: dict[str, tuple[int, float] | None] = {}
        for i, (text, score) in enumerate(pieces):
            if text:
                self.table[text] = (i, score)
        for text in list(self.table):
            for k in range(1, len(text)):
                self.table.setdefault(text[:k], None)  # a beginning of a piece
        self.longest = max((len(t) for t in self.table), default=1)
        self.unknown = min((s for _, s in pieces if s > -1e8), default=0.0) - 10.0
        inner = any(SPACE in t.lstrip(SPACE) or "\n" in t for t in self.table)
        # No piece goes on over the cuts of this pattern, so every best path has a boundary there.
        self.cut = None if inner else re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.cache: dict[str, list[int]] = {}

    @staticmethod
    def load(path: str) -> Pieces:
        """The pieces of a model file."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids, decoded = [], [0] * 256, []
        for i in range(sp.get_piece_size()):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(text[1:-1], 16)] = i
                decoded.append(bytes([int(text[1:-1], 16)]))
                pieces.append(("", -1e9))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                decoded.append(b"")
                pieces.append(("", -1e9))
            else:
                decoded.append(text.replace(SPACE, " ").encode())
                pieces.append((text, sp.get_score(i)))
        return Pieces(pieces, byte_ids, decoded)

    def stream(self, chars: Iterable[str], check: int = 64) -> Iterator[list[int]]:
        """Ids of the best path, given out whenever all surviving paths meet.

        Steps go forwards from a position over the pieces that begin there, so
        only ``longest`` characters ahead and the positions since the last
        meeting are held.  Of paths of like score the one whose last piece is
        shorter is taken.
        """
        get, longest, unknown = self.table.get, self.longest, self.unknown
        size, held, at, read = longest + check, "", 0, 0
        source = None if isinstance(chars, str) else iter(chars)
        score, back, step = [0.0], [0], [-1]
        while True:
            if source is None:
                more = chars[read : read + size] if read or len(chars) >= size else chars
                read += len(more)
            else:
                more = "".join(islice(source, size))
            ended = len(more) < size
            held += more
            score += [_NEVER] * len(more)
            back += [0] * len(more)
            step += [-1] * len(more)
            n = len(held)
            stop = n if ended else n - longest
            for i in range(at, stop):
                s = score[i]
                for j in range(i + 1, n + 1):
                    hit = get(held[i:j], _NONE)
                    if hit is None or hit is _NONE:
                        if j == i + 1:
                            u = s + unknown * len(held[i].encode())
                            if u > score[j]:
                                score[j], back[j], step[j] = u, i, -1
                        if hit is _NONE:
                            break
                        continue
                    u, have = s + hit[1], score[j]
                    if u > have + 1e-9 or (u >= have - 1e-9 and i > back[j]):
                        score[j], back[j], step[j] = u, i, hit[0]
            at = stop
            if ended:
                if n:
                    yield self._path(held, back, step, n)
                return
            alive = {j for j in range(at, n + 1) if score[j] > _NEVER}
            while len(alive) > 1:
                x = max(alive)
                alive.discard(x)
                alive.add(back[x])
            meet = alive.pop()
            if meet:
                yield self._path(held, back, step, meet)
                base = score[meet]
                held, at = held[meet:], at - meet
                score, back, step = [v - base for v in score[meet:]], [v - meet for v in back[meet:]], step[meet:]
                score[0] = 0.0

    def _path(self, held: str, back: list[int], step: list[int], end: int) -> list[int]:
        out: list[list[int]] = []
        while end:
            i = back[end]
            out.append([step[end]] if step[end] >= 0 else [self.byte_ids[b] for b in held[i:end].encode()])
            end = i
        return [x for ids in reversed(out) for x in ids]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; null and empty texts have none."""
        if not text:
            return []
        out: list[int] = []
        mark = [self.byte_ids[b] for b in SPACE.encode()]
        for k, part in enumerate(text.split(SPACE)):
            if k:
                out += mark
            part = part.replace(" ", SPACE)
            if k == 0:
                part = SPACE + part
            cache = self.cache
            for seg in [part] if self.cut is None else self.cut.findall(part):
                ids = cache.get(seg)
                if ids is None:
                    parts = list(self.stream(seg))
                    ids = parts[0] if len(parts) == 1 else [i for some in parts for i in some]
                    if len(seg) <= _CACHE_CHARS:  # frequent words are remembered, not searched otherwise
                        if len(cache) >= _CACHE_ENTRIES:
                            cache.clear()
                        cache[seg] = ids
                out += ids
        return out

    def decode(self, ids: list[int] | np.ndarray) -> str:
        raw = b"".join(map(self.decoded.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    def total(self, ids: list[int]) -> float:
        """The score of a path."""
        scores = {i: s for v in self.table.items() if v[1] for i, s in [v[1]]}
        return sum(scores.get(i, self.unknown) for i in ids)


def _apply(path: str, id_type: pa.DataType, with_ids: bool):
    fields = [("_id", id_type), ("n_bytes", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())]
    schema = pa.schema([*fields, ("ids", pa.list_(pa.int32()))] if with_ids else fields)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(path)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                texts = [t or "" for t in batch.column("_text").slice(lo, 256).to_pylist()]
                ids = [np.array(pieces.encode(t), "<u4") for t in texts]
                crc = [zlib.crc32(i.tobytes()) for i in ids]
                same = [pieces.decode(i.tolist()) == t for i, t in zip(ids, texts, strict=True)]
                more = [pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))] if with_ids else []
                yield arrow_batch(schema, one_array(batch.column("_id")).slice(lo, 256), [len(t.encode()) for t in texts], [len(i) for i in ids], crc, same, *more)

    return apply


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Per row ``id_col, n_bytes, n_ids, ids_crc32`` (little-endian unsigned 32-bit ids), ``round_trip`` (decoding gives the text) and the ids.

    Null texts are empty and have no ids.  Repeated rows come back as often as
    they stand, other columns are ignored, an empty table stays empty.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, n_bytes bigint, n_ids bigint, ids_crc32 bigint, round_trip boolean" + ", ids array<int>" * with_ids
    return rows.mapInArrow(_apply(path or default_path(), arrow_type(rows, "_id"), with_ids), schema).withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``encoded`` with a column ``text`` for its ids; null ids give a null text."""
    path = path or default_path()

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = Pieces.load(path)
        for ids in batches:
            yield pd.Series([None if i is None else pieces.decode(i) for i in ids], dtype=object)

    return encoded.withColumn("text", text(ids_col))
