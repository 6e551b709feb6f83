"""Token counts: Arrow batch encoding that returns lengths only.

Batches are balanced by bytes.  For a piece vocabulary whose pieces never hold a space
after another character, a text may be split before any run of spaces without changing
its tokens (each part starts a word, as the encoder's own prefix does).  A batch's
distinct parts are encoded once by the library and summed per text, and a bounded table
remembers parts of earlier batches.  Long texts therefore go through in small parts, and
nothing but integers returns to Spark.

Where no boundary is safe a text goes to the library whole, by itself: texts that hold the space
mark itself, and all texts of other vocabularies.  Memory then follows the longest such text, which
Spark bounds at 2 GB a value.

Nulls count as empty texts; an empty text has zero bytes and zero tokens.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from foliospark.llm.common import map_texts, read, rest

#: Parts that a worker remembers; parts longer than LONG characters are never remembered.
REMEMBERED, LONG = 400_000, 64
_PARTS = re.compile(r" +[^ ]*")
FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]


@functools.lru_cache(maxsize=4)
def _piece_encoder(path: str):
    """(encode a list of texts to lengths, whether texts may be split before spaces)."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
    pieces = {p.piece for p in model.pieces}
    safe = plain and "▁" in pieces and not any(re.search("[^▁]▁", p) for p in pieces) and all(p.type != proto.ModelProto.SentencePiece.USER_DEFINED for p in model.pieces)
    processor = sentencepiece.SentencePieceProcessor(model_file=path)

    def lengths(texts: list[str]) -> list[int]:
        return [len(ids) for ids in processor.encode(texts, num_threads=1)]

    return lengths, safe


@functools.lru_cache(maxsize=4)
def _json_encoder(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()

    def lengths(texts: list[str]) -> list[int]:
        return [len(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    return lengths, False


def encoder(path: str):
    return _json_encoder(path) if path.endswith(".json") else _piece_encoder(path)


def parts(text: str) -> list[str]:
    """A text cut before each run of spaces; each part lacks the one space that the encoder adds again.

    An empty part stands for one space at the end of the text.
    """
    if not text:
        return []
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [p[1:] for p in _PARTS.findall(" " + text)]


class Counter:
    """Counts tokens of batches of texts with one encoder."""

    def __init__(self, path: str):
        self.lengths, self.safe = encoder(path)
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return self.lengths(texts)
        known = self.known
        whole = [i for i, t in enumerate(texts) if "▁" in t]  # the space mark itself: no safe boundary
        split = [parts(t) for t in texts]
        for i in whole:
            split[i] = []
        known[""] = 1  # the space mark alone is a piece
        new = set().union(*split) - known.keys()
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                known[""] = 1
                new = set().union(*split) - known.keys()
            new = list(new)
            known.update(zip(new, self.lengths(new), strict=True))
        get = known.__getitem__
        out = [sum(map(get, p)) for p in split]
        if whole:
            for i, n in zip(whole, self.lengths([texts[i] for i in whole]), strict=True):
                out[i] = n
        for p in [p for p in new if len(p) > LONG]:
            del known[p]
        return out


@functools.lru_cache(maxsize=4)
def _counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, tokenizer: str, limit: int = 4096, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens > limit) to every row.

    `tokenizer` is the path of a vocabulary file on every executor (.model or .json).  Columns of
    these names are replaced, all others pass through (or those of `carry`).
    """
    base = rest(df, *(f.name for f in FIELDS))

    def fn(_, data, offsets):
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        n = _counter(tokenizer).count(texts)
        return {"n_bytes": pa.array(offsets[1:] - offsets[:-1], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())}

    return map_texts(base, fn, FIELDS, text, carry)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document with the 32k piece vocabulary."""
    return count_tokens(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), carry=["doc_id"])
