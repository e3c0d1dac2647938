"""Token counts of whole texts under a byte-level BPE vocabulary, without encoding them.

Most pieces that the pre-tokenizer cuts are vocabulary strings.  Which of these
strings encode alone as one token is proven once, by merging every one of them;
a piece that is such a string counts one, by a look-up.  Only the rest is
merged, and what that gives is remembered in bounded room.

How the library sorts characters into letters, numbers, blanks and others
depends on the Unicode version that it was built with, so it is asked: every
character outside ASCII is tried once where it first turns up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_type, one_array

#: Merged pieces that a task remembers, and the longest of them in characters.
MEMO, MEMO_CHARS = 1 << 17, 48
#: Texts are cut into pieces in stretches of about so many characters.
STRETCH = 1 << 19

#: Fixed: the pattern of byte-level pre-tokenizers, over texts whose characters stand for their kinds.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_EDGE = re.compile(r"(?<=\S)\s", re.ASCII)


def _byte_letters() -> dict[int, int]:
    """The character that stands for each byte in vocabulary files: itself if it is printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return {b: b if b in shown else next(other) for b in range(256)}


class _Kinds(dict):
    """For ``str.translate``: characters to one ASCII character of their kind, as the library sees it; ASCII stays."""

    def __init__(self, pre_tokenizer):
        super().__init__({c: c for c in range(128)})
        self.cut = lambda s: len(pre_tokenizer.pre_tokenize_str(s))

    def __missing__(self, code: int) -> int:
        c = chr(code)
        kind = next((k for k in "a0!" if self.cut(k + c + k) == 1), "\n")  # one piece between two of its own kind
        self[code] = ord(kind)
        return self[code]


class Counter(dict):
    """Tokens of a pre-token: one for proven vocabulary strings, else what merging gives."""

    def __init__(self, path: str, proven: bytes | None = None):
        from tokenizers import Tokenizer, models, pre_tokenizers

        tok = Tokenizer.from_file(path)
        added = list(tok.get_added_tokens_decoder().values())
        plain = isinstance(tok.model, models.BPE) and isinstance(tok.pre_tokenizer, pre_tokenizers.ByteLevel) and tok.normalizer is None
        if not plain or tok.pre_tokenizer.add_prefix_space or tok.model.dropout or tok.model.ignore_merges or any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("counts need a byte-level BPE tokenizer without normaliser, prefix space or tokens that take in blanks")
        self.model, self.kinds, self.letters = tok.model, _Kinds(tok.pre_tokenizer), _byte_letters()
        own = {t.content for t in added}
        self.special = re.compile("|".join(map(re.escape, sorted(own, key=len, reverse=True)))) if own else None
        vocab = sorted(tok.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1])
        if proven is None:
            proven = np.packbits([self._alone(s, i) for s, i in vocab]).tobytes()
        self.proven = proven
        back = {v: k for k, v in self.letters.items()}
        for (s, _), ok in zip(vocab, np.unpackbits(np.frombuffer(proven, np.uint8)), strict=False):
            if ok:
                try:
                    self[bytes(back[ord(c)] for c in s).decode()] = 1
                except (UnicodeDecodeError, KeyError):  # parts of characters never make a piece by themselves
                    continue
        self.whole = len(self)
        self.merged = 0

    def _alone(self, text: str, token: int) -> bool:
        made = self.model.tokenize(text)
        return len(made) == 1 and made[0].id == token

    def __missing__(self, piece: str) -> int:
        n = len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))
        if len(piece) <= MEMO_CHARS:
            if len(self) >= self.whole + MEMO:
                for k in list(self)[self.whole :]:  # dicts keep their order: the proven strings come first
                    del self[k]
            self[piece] = n
        return n

    def _stretch(self, text: str, kinds: str) -> int:
        if text is kinds:
            return sum(map(self.__getitem__, _PIECE.findall(text)))
        return sum(self[text[m.start() : m.end()]] for m in _PIECE.finditer(kinds))

    def _ordinary(self, text: str) -> int:
        n, at = 0, 0
        while at < len(text):
            part = text[at : at + 2 * STRETCH]
            kinds = part if part.isascii() else part.translate(self.kinds)
            if at + len(part) < len(text):
                # A blank after a character that is none starts a piece, whatever follows.
                cut = _EDGE.search(kinds, STRETCH)
                if cut is None:  # no such place in a long stretch: take all that is left as one
                    part = text[at:]
                    kinds = part if part.isascii() else part.translate(self.kinds)
                else:
                    part, kinds = part[: cut.start()], kinds[: cut.start()] if kinds is not part else None
                    kinds = part if kinds is None else kinds
            n += self._stretch(part, kinds)
            at += len(part)
        return n

    def count(self, text: str | None) -> int:
        """Tokens of a text; the strings of special tokens count one each, as the library takes them by default."""
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self._ordinary(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._ordinary, parts))


def _counts(path: str, proven: bytes, id_type: pa.DataType):
    schema = pa.schema([("_id", id_type), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, proven)
        for batch in batches:
            ids = one_array(batch.column("_id"))
            for lo in range(0, len(batch), 256):
                part = batch.column("_text").slice(lo, 256)
                yield arrow_batch(schema, ids.slice(lo, 256), batch.column("_bytes").slice(lo, 256), [counter.count(x.as_py()) for x in part])

    return apply


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit``: one row per input row.

    ``path`` is a byte-level BPE file of the ``tokenizers`` library, which every
    executor can open; counts are those of its ``encode`` without special tokens
    added.  Other kinds of tokenizers are refused.  Null and empty texts have no
    token and no byte, texts of any length are counted whole, repeated rows come
    back as often as they stand, an empty table stays empty, and other columns
    are ignored whatever their names.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("_bytes"))
    kind = rows.schema["_id"].dataType.simpleString()
    made = rows.mapInArrow(_counts(path, Counter(path).proven, arrow_type(rows, "_id")), f"_id {kind}, n_bytes bigint, n_tokens bigint")
    return made.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("_id", id_col)
