import random

import pytest
from pyspark.sql import functions as F

from lumenbib.llm import tokens

HARD = ["", None, "<|endoftext|> a", " " * 5000 + "x", "ab" * 3000, "don't we'll  stop\n\n\tnow", "naïve 🙂 Ελλ 第3章", "a" * 900 + " " + "b" * 900, "x\r\ny​z w", "  ", "12345 67 8.9"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    words = ["glacier", "don't", " ", "\n", "12,5", "été", "…", "🙂", "x" * 70, "—", "  ", "I'll", "Ω", "z9"]
    return HARD + ["".join(r.choice(words) + r.choice(["", " ", "  "]) for _ in range(r.randrange(400, 1500))) for _ in range(12)]


def test_chunked_equals_whole(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("clash")).withColumn("k", F.lit(1))
    for spread_chars in (100, 1 << 20):  # pieces in tasks of their own, and where the text is read
        got = {r["doc_id"]: r["ids"] for r in tokens.encode_documents(df, chunk_chars=400, overlap_chars=60, spread_chars=spread_chars).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            assert got[i] == (tokens.encode_piece(t) if t else []), (i, (t or "")[:40])
    whole = {r["doc_id"]: r["ids"] for r in tokens.encode_documents(df).collect()}
    assert whole == got


SPACES = [" ", "  ", "\n", "\n\n", "\r\n", "\t", "\u00a0", " \n ", "\u2028", "\x1c", "\u3000", "    "]
BITS = ["glacier", "don't", "'s", "'", "''", "!'re", "12", "3.5", "—", "…", "🙂", "第", "章三", "été", "Ω", "x" * 30, "\U000323b0", "\U00011de0", "\u0558", "a\u0301", "ಠ", "ก็", "-", "!!!", "ll", "'LL", "½"]


def _random_text(r, n):
    out, size = [], 0
    gap = r.choice([0.2, 0.5, 0.9, 1.0])
    while size < n:
        out.append(r.choice(BITS) + (r.choice(SPACES) if r.random() < gap else ""))
        size += len(out[-1])
    return "".join(out)


def test_ten_thousand_texts_in_small_chunks():
    r = random.Random(11)
    for _ in range(10_000):
        t = _random_text(r, r.randrange(60, 700))
        chunk = r.randrange(50, 401)
        overlap = r.randrange(10, chunk + 1)
        assert "".join(tokens.pieces(t, chunk, overlap)) == t
        assert tokens.encode_text(t, chunk=chunk, overlap=overlap) == tokens.encode_piece(t), (chunk, overlap, t)


def test_long_texts_and_both_encoders():
    r = random.Random(12)
    kinds = [lambda n: _random_text(r, n), lambda n: "word " * (n // 5), lambda n: "第三章のテキスト" * (n // 8), lambda n: " " * n + "x", lambda n: "a" * n, lambda n: "\n\n \t" * (n // 4), lambda n: "!?" * (n // 2), lambda n: "7" * n, lambda n: "".join(chr(r.choice([r.randrange(32, 0xD800), r.randrange(0xE000, 0x33000)])) for _ in range(n)), lambda n: "été, " * (n // 5), lambda n: "don't'll " * (n // 9), lambda n: "\r\n" * (n // 2) + "x"]
    for k, kind in enumerate(kinds * 2):
        t = kind(100_001 if k < len(kinds) else 120_000)
        assert len(t) >= 99_000
        whole = tokens._steady(tokens.DEFAULT_DIR, tokens.VOCABULARY).encode(t, add_special_tokens=False).ids
        assert tokens._fast(tokens.DEFAULT_DIR, tokens.VOCABULARY).encode_ordinary(t) == whole, k
        assert tokens.encode_text(t) == whole, k


def test_ids_query_takes_the_chunks(spark, tmp_path):
    from lumenbib.llm.queries import QUERIES

    r = random.Random(13)
    rows = [(i, _random_text(r, n)) for i, n in enumerate([100, 3_000, 9_000, 40_000])] + [(7, "x y\n\n" * 220_000), (8, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.length("text").cast("bigint"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x["ids"] for x in QUERIES["p6_ids"](spark, str(tmp_path)).collect()}
    steady = tokens._steady(tokens.DEFAULT_DIR, tokens.VOCABULARY)
    assert got == {i: steady.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    assert all(len(tokens.stitches(t)) > 1 for i, t in rows[1:5])


def test_length_column_only_routes(spark):
    df = spark.createDataFrame([(1, "a b", 10**6), (2, None, 10**6), (3, "c", None), (4, "", 0)], "doc_id bigint, text string, n bigint")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_documents(df, length_col="n").collect()}
    assert got == {1: tokens.encode_text("a b"), 2: [], 3: tokens.encode_text("c"), 4: []}


def test_long_piece_and_round_trip(spark, texts):
    assert tokens.encode_text(" " * 2_000_000 + "x")[-1] == tokens.encode_text(" x")[-1]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if t is not None], "doc_id bigint, text string")
    back = tokens.encode_documents(df, chunk_chars=400, overlap_chars=60).withColumn("back", tokens.decode_ids(F.col("ids")))
    assert back.join(df, "doc_id").filter(~F.col("back").eqNullSafe(F.col("text"))).count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert tokens.encode_documents(df).collect() == []
