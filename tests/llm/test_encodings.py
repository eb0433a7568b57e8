import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenbib.llm import encodings as E

D = "/root/testdata/sf0.01"


def clean_texts():
    return [r[0] for r in duckdb.sql(f"select text from '{D}/documents.parquet' where text is not null order by doc_id").fetchall()]


@pytest.fixture(scope="module")
def model():
    seeds = [r[0] for r in duckdb.sql(f"select sample_text from '{D}/lang_samples.parquet'").fetchall()]
    return E.fit_words(seeds, clean_texts())


def garble(text, read, was="utf-8"):
    back = {v: chr(k) for k, v in E.to_bytes(read).items()}
    return "".join(chr(b) if b < 128 else back[b] for b in text.encode(was))


def test_round_trips(model):
    good = [t for t in clean_texts() if not t.isascii() and E.restore(t, model) == (t, False)][:150]
    assert len(good) == 150
    r = random.Random(0)
    for read in E.FAMILIES:
        for t in r.sample(good, 40):
            if "﻿" not in t:
                assert E.restore(garble(t, read), model)[0] == t, (read, t[:80])
    twice = [t for t in good if E.restore(garble(garble(t, "cp1252"), "cp1252"), model)[0] == t]
    assert len(twice) >= 145


def test_single_byte(model):
    ru = "Погрешность оценена путём повторных запусков с другими начальными значениями."
    fr = "Les données ont été nettoyées, appariées puis conservées avec les réglages."
    pl = "Niepewność oszacowano, powtarzając każde obliczenie z innymi wartościami."
    for text, was, reads in ((ru, "cp1251", ("cp1252", "koi8_r")), (ru, "koi8_r", ("cp1251", "cp1252")), (ru, "cp866", ("cp1251",)), (fr, "cp1252", ("cp850", "cp437", "mac_roman")), (pl, "cp1250", ("cp1252",)), (pl, "iso8859_2", ("cp1252", "cp1250"))):
        for read in reads:
            assert E.restore(garble(text, read, was), model)[0] == text, (was, read)


@pytest.fixture(scope="module")
def garbled_family(model):
    """Seeds, all texts with three in four of the Russian ones garbled in one single-byte encoding, and (garbled, original)."""
    seeds = [r[0] for r in duckdb.sql(f"select sample_text from '{D}/lang_samples.parquet'").fetchall()]
    texts, pairs, kept = [], [], 0
    for t in clean_texts():
        if sum(map(E._cyrillic, t)) > 20 and E.restore(t, model) == (t, False):
            try:
                t.encode("cp1251")
            except UnicodeEncodeError:
                pass
            else:
                kept += 1
                if kept % 4:
                    pairs.append((garble(t, "cp1252", "cp1251"), t))
                    t = pairs[-1][0]
        texts.append(t)
    assert len(pairs) >= 15
    return seeds, texts, pairs


def test_garbled_family(garbled_family):
    seeds, texts, pairs = garbled_family
    m = E.fit_words(seeds, texts)
    right = sum(E.restore(g, m)[0] == t for g, t in pairs)
    assert right >= 0.95 * len(pairs), (right, len(pairs))


def test_usual_words(spark, garbled_family):
    seeds, texts, _ = garbled_family
    n = E.count_words(["können wir", "kÜnnen wir", "(können), être", "x é"])
    assert n == {"können": 2, "kÜnnen": 1, "être": 1}
    many = {"können": 5000, "kÜnnen": 600, "Ångström": 300, "Íàøèìè": 300, "l’analyse": 400, "selten-é": 3}
    assert E.usual_words(many, 100_000, seeds) == {"können", "Ångström", "l’analyse"}
    df = spark.createDataFrame([(t,) for t in texts + texts[:5] + [None]], "text string")
    once, all_of = E.count_words(list(dict.fromkeys(texts))), E.count_words(texts + texts[:5])
    got = E.word_counts(df, len(texts), seeds)
    assert got and all(once[w] <= n <= all_of[w] for w, n in got.items())
    # a text with a third of all rows counts once where it matters
    hot = spark.createDataFrame([(t,) for t in texts] + [("Íàøèìè kÜnnen",)] * 400, "text string")
    assert E.word_counts(hot, len(texts) + 400, seeds).get("Íàøèìè", 0) <= 1 + once.get("Íàøèìè", 0)


def test_model_learns_from_all_texts(spark):
    seeds = [r[0] for r in duckdb.sql(f"select sample_text from '{D}/lang_samples.parquet'").fetchall()]
    # more texts than the 4 000 that were drawn, each with words of its own
    texts = [f"Der Wert {k} bleibt größer für Straße{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}." for k in range(6000)] + clean_texts()[:200] + ["plain ascii", "naïve • и"]
    a, b = spark.createDataFrame([(x,) for x in seeds], "t string"), spark.createDataFrame([(x,) for x in texts + texts[:300] + [None]], "t string")
    got = E.train(a, b)
    want = E.fit_words(seeds, list(dict.fromkeys(texts)), got.usual)
    assert (got.c1, got.c2, got.c3, got.h2, got.alone, got.texts) == (want.c1, want.c2, want.c3, want.h2, want.alone, want.texts)
    assert got.texts > 6000
    assert E.train(a, b.limit(0)).texts == len(seeds)


def test_decoys(model):
    for t in ["SÃO 36, ÎLE 36, ÄÖÜ 36: station codes.", "In old exports the pair “Ã©” stands where the letter “é” was meant; section 7 explains why.", "Ð and ð (eth) occur in sample 195.", "Â · Ã · Ä · Å are plotted as markers", "10\xa0000 € – 302\xa0%", "第183章 概要 と 結果", "plain ascii", "The value is 12.4 µm ± 0.4 at −4 °C", "🙂 ✓ naïve étude"]:
        assert E.restore(t, model) == (t, False), t


def test_partial_and_lost(model):
    assert E.restore("The survey (KÃ¤rnavich, 2018) is old. Die Größe bleibt.", model) == ("The survey (Kärnavich, 2018) is old. Die Größe bleibt.", False)
    assert E.restore("it can�t be recovered later", model)[1]
    assert not E.restore("the sign “�” stands for a lost character", model)[1]


def test_documents(spark, model):
    text = "Die Größe der Anlage bleibt offen."
    rows = [(1, garble(text, "cp1252")), (2, text), (3, None), (4, ""), (5, "ascii"), (6, "a�b"), (7, garble(text, "cp1252")), (8, (text + " ") * 3000 + garble(text, "cp1252"))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("restored", F.lit("x")).withColumn("lost", F.lit(1))
    got = dict(tuple(r) for r in E.found(df, model).collect())
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert got == {1: md5(text), 7: md5(text), 6: "", 8: md5((text + " ") * 3000 + text)}
    assert E.found(df.limit(0), model).collect() == []
