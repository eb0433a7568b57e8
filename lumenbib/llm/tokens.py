"""Encoding texts with a public byte-level BPE vocabulary, and decoding ids again.

Method: overlapping chunk encoding. A text longer than `chunk_chars` is cut into chunks that overlap. Around each cut the
text is pre-tokenised twice, once as the chunk before sees it and once from the start of the chunk after, and the two are
stitched at the first pre-token boundary that both views have and that no context can move (see `settled`). The pieces
between the stitches are encoded one by one and their ids are concatenated. Pieces of texts longer than `spread_chars`
are encoded in parallel tasks, those of shorter ones where the text is read, without a shuffle. Decoding concatenates
the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.parallel import spread

DEFAULT_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: The pattern that splits a text before the merges, as published with the vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK_CHARS = 2_048
OVERLAP_CHARS = 256
#: Texts of more characters than this have their pieces encoded in tasks of their own.
SPREAD_CHARS = 1 << 20
#: Pieces from this many characters on go to the encoder whose pattern engine has no recursion; its ids are the same.
LONG_PIECE = 65_536


def _share_file(spark: SparkSession, directory: str, name: str) -> None:
    """Send the vocabulary with the job, so that executors need no copy of the folder; once a context."""
    sc = spark.sparkContext
    sent = sc.__dict__.setdefault("_lumenbib_vocabularies", set())
    for kind in ("tiktoken", "json"):
        path = os.path.join(directory, f"{name}.{kind}")
        if path not in sent and os.path.exists(path):
            sc.addFile(path)
            sent.add(path)


def _file(directory: str, file: str) -> str:
    path = os.path.join(directory, file)
    return path if os.path.exists(path) else SparkFiles.get(file)


@lru_cache(maxsize=4)
def _fast(directory: str, name: str):
    import tiktoken

    with open(_file(directory, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(f"own-{name}", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _steady(directory: str, name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(_file(directory, f"{name}.json"))
    t.encode_special_tokens = True
    return t


def encode_piece(text: str, directory: str = DEFAULT_DIR, name: str = VOCABULARY) -> list[int]:
    """The ids of a text encoded as one piece; strings of special tokens are ordinary text."""
    if len(text) < LONG_PIECE:
        return _fast(directory, name).encode_ordinary(text)
    return _steady(directory, name).encode(text, add_special_tokens=False).ids


def boundaries(text: str) -> list[int]:
    """Starts of the pre-tokens of text, counted in characters."""
    return [m.start() for m in _pattern().finditer(text)]


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


@lru_cache(maxsize=1 << 16)
def _kind(ch: str) -> str:
    """'s' of white space, 'l' of a letter, 'n' of a number, 'o' of another sign; '' of one that versions of Unicode may differ on."""
    import regex

    if regex.match(r"\s", ch):
        return "s"
    if unicodedata.ucd_3_2_0.category(ch) == "Cn":
        return ""
    return "l" if regex.match(r"\p{L}", ch) else "n" if regex.match(r"\p{N}", ch) else "o"


def settled(text: str, at: int) -> bool:
    """Whether a pre-token ends before text[at] whatever stands around it.

    No pre-token goes on from a sign that isn't white space to one of another kind, but for an apostrophe before
    letters. As the sign before isn't white space, the pattern's look ahead from white space ends before it, too.
    """
    a, b = _kind(text[at - 1]), _kind(text[at])
    return a not in ("", "s") and b not in ("", a) and text[at - 1] != "'"


def stitches(text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """Starts of the pieces of text: 0, and after each cut the first settled boundary that the views of both chunks have.

    A cut without one in the overlap (inside a run of one kind of signs) makes no piece: the piece before goes on.
    """
    out = [0]
    for cut_at in range(chunk, len(text), chunk):
        low, end = max(cut_at - overlap, out[-1]), min(cut_at + min(overlap, chunk), len(text))
        before = {low + p for p in boundaries(text[low:end])}
        both = (cut_at + p for p in boundaries(text[cut_at:end]) if cut_at + p in before)
        at = next((p for p in both if settled(text, p)), None)
        if at is not None:
            out.append(at)
    return out


def pieces(text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    starts = stitches(text, chunk, overlap)
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]


def encode_text(text: str | None, directory: str = DEFAULT_DIR, name: str = VOCABULARY, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """The ids of one text, piece by piece; null and empty text have no ids."""
    if not text:
        return []
    if len(text) <= chunk:
        return encode_piece(text, directory, name)
    return [i for p in pieces(text, chunk, overlap) for i in encode_piece(p, directory, name)]


def _encoder(directory: str, name: str, chunk: int, overlap: int):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([encode_text(t, directory, name, chunk, overlap) for t in s], dtype=object)

    return encode


def _spread_ids(df: DataFrame, id_col: str, text_col: str, encode, chunk: int, overlap: int, group: int = 64) -> DataFrame:
    """(id, ids) of texts whose pieces are encoded in tasks of their own, `group` neighbouring pieces each; id must be unique."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, t in zip(b["id"], b["text"]):
                starts = stitches(t, chunk, overlap)[::group]
                for at, end in zip(starts, [*starts[1:], len(t)]):
                    yield pd.DataFrame({"id": [i], "a": [at], "piece": [t[at:end]]})

    kind = T.StructType([docs.schema["id"], T.StructField("a", T.LongType()), T.StructField("piece", T.StringType())])
    out = docs.mapInPandas(cut_up, kind).repartition(F.col("id"), F.col("a")).select("id", "a", encode("piece").alias("x"))
    return out.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("a", "x"))), lambda p: p["x"])).alias("ids")).select(F.col("id").alias(id_col), "ids")


def encode_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length_col: str | None = None,
    directory: str = DEFAULT_DIR,
    name: str = VOCABULARY,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
    spread_chars: int = SPREAD_CHARS,
) -> DataFrame:
    """(id, ids): the ids of every row's text, without special tokens; one row per row of df.

    Null and empty texts have an empty list. id must be unique; a null id keeps its row as long as its text has at most
    spread_chars characters. length_col names a column with the texts' lengths in characters: it only decides which rows
    have their pieces spread, so that the scan for long texts is pruned by its statistics; without it the length is
    computed. Other columns are not read. An empty table gives an empty result; equal texts have equal ids.
    """
    _share_file(df.sparkSession, directory, name)
    encode = _encoder(directory, name, chunk_chars, overlap_chars)
    length = F.coalesce(F.col(length_col), F.lit(0)) if length_col else F.coalesce(F.length(text_col), F.lit(0))
    short = spread(df.filter(length <= spread_chars).select(id_col, text_col)).select(F.col(id_col), encode(F.col(text_col)).alias("ids"))
    long = _spread_ids(df.filter(length > spread_chars).filter(F.length(text_col) > 0), id_col, text_col, encode, chunk_chars, overlap_chars)
    # a length that speaks of a text which isn't there
    none = df.filter((length > spread_chars) & (F.coalesce(F.length(text_col), F.lit(0)) == 0)).select(F.col(id_col), F.array().cast("array<int>").alias("ids"))
    return short.unionByName(long).unionByName(none) if length_col else short.unionByName(long)


def decode_ids(ids: Column, directory: str = DEFAULT_DIR, name: str = VOCABULARY) -> Column:
    """The text of a list of ids: their raw bytes, concatenated, read as UTF-8; null for a null list."""

    @F.pandas_udf(T.StringType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = _fast(directory, name)
        for s in batches:
            yield pd.Series([None if x is None else e.decode_bytes([int(i) for i in x]).decode("utf-8", "replace") for x in s], dtype=object)

    return decode(ids)


def count_tokens(df: DataFrame, text_col: str = "text", directory: str = DEFAULT_DIR, name: str = VOCABULARY) -> Column:
    """A column expression: the number of ids of each text, 0 for null and empty text; ids don't leave the worker."""
    _share_file(df.sparkSession, directory, name)

    @F.pandas_udf(T.LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([len(encode_text(t, directory, name)) for t in s], dtype="int64")

    return count(F.col(text_col))
