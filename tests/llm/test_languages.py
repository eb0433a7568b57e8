import duckdb
import pytest
from pyspark.sql import functions as F

from lumenbib.llm import languages as L

SAMPLES = "/root/testdata/sf0.01/lang_samples.parquet"


@pytest.fixture(scope="module")
def samples():
    return duckdb.sql(f"select lang, sample_text from '{SAMPLES}' order by sample_id").fetchall()


def test_held_out(samples):
    right = 0
    for k in range(5):
        m = L.fit([x for i, x in enumerate(samples) if i % 5 != k])
        test = [x for i, x in enumerate(samples) if i % 5 == k]
        best, sure = L.score(m, [t for _, t in test])
        right += sum(m.languages[b] == x for b, (x, _) in zip(best, test))
        assert ((0 < sure) & (sure <= 1)).all()
    assert right / len(samples) >= 0.97


def test_segments(samples):
    m = L.fit(samples)
    en, de = "What remains open is whether the same holds for larger sites.", "Offen bleibt die Frage, ob dies auch für größere Anlagen gilt."
    text = f"{en} It was measured by Kim et al. (2010), see fig. 3. {de} (\"{en}\") {en}"
    got = L.segments(m, [text, None, "", "  ", "123 456.", f'{de[:-1]} («what remains open is whether it holds»). {de}', en * 2000])
    assert [x[1] for x in got[0]] == ["en", "de", "en"] and [x[0] for x in got[0]] == [1, 2, 3]
    assert text[got[0][1][3] : got[0][1][4]].startswith("Offen")
    assert got[1:5] == [[], [], [], []] and [x[1] for x in got[5]] == ["de"] and len(got[6]) == 1


def test_batches_do_not_matter(samples):
    m = L.fit(samples)
    texts = [t for _, t in samples]
    a, b = L.score(m, texts), L.score(m, texts, chunk=50)
    assert (a[0] == b[0]).all() and abs(a[1] - b[1]).max() < 1e-6
    one = [L.score(m, [t])[0][0] for t in texts[:30]]
    assert one == list(a[0][:30])


def test_labels(spark):
    cases = {"en": "en", "EN": "en", "eng": "en", "en ": "en", "English": "en", "en-XB": "en", "en_GB": "en", "German": "de", "deu": "de", "xx": None, "unknown": None, "": None, "und": None, None: None, "français": "fr"}
    df = spark.createDataFrame([(k,) for k in cases], "x string").select("x", L.label_language(F.col("x")).alias("y"))
    assert {r["x"]: r["y"] for r in df.collect()} == cases


def test_found(spark, samples):
    m = L.fit(samples)
    en, de = "What remains open is whether the same holds for larger sites.", "Offen bleibt die Frage, ob dies auch für größere Anlagen gilt."
    rows = [(1, "en", en), (2, "EN", en), (3, None, en), (4, "de", en), (5, "en", f"{en} {de}"), (6, "en", None), (7, None, ""), (8, "xx", de), (8, "xx", de), (None, None, en)]
    df = spark.createDataFrame(rows, "id bigint, language string, abstract string").withColumn("segs", F.lit(1)).withColumn("label", F.lit("z"))
    got = sorted((tuple(r)[:3] for r in L.found(df, m).collect()), key=repr)
    assert got == sorted([(3, 1, "en"), (4, 1, "en"), (5, 1, "en"), (5, 2, "de"), (8, 1, "de"), (8, 1, "de"), (None, 1, "en")], key=repr)
    assert L.found(df.limit(0), m).collect() == []


def test_training_ignores_wrong_labels(spark, samples):
    s = spark.createDataFrame(samples, "lang string, t string")
    docs = spark.createDataFrame([("es", "Los datos se limpiaron y se guardaron."), ("es", "What remains open is whether the same holds for larger sites."), (None, "x"), ("en", None)], "l string, t string")
    m = L.train(s, docs)
    best, _ = L.score(m, ["What remains open is whether it holds.", "Los datos se limpiaron y se guardaron."])
    assert [m.languages[b] for b in best] == ["en", "es"]
    assert L.train(s.limit(0)) is None
