import random
import unicodedata
import zlib

import numpy as np
from pyspark.sql import functions as F

from stallwise.llm import langid

TEXTS = {
    "en": "the house and the garden are with this water that they have for when it was there",
    "de": "das haus und der garten sind mit diesem wasser das sie nicht haben wenn es dort war",
    "es": "la casa y el jardín son con esta agua que ellos tienen para cuando era así también",
}


def model(spark):
    rows = [(f"{' '.join(np.random.default_rng(i).permutation(t.split()))}", k) for k, t in TEXTS.items() for i in range(12)]
    return langid.fit(spark.createDataFrame([*rows, (None, "en"), ("abc", None)], "text string, lang string"))


def test_words_then_n_grams(spark):
    m = model(spark)
    assert m.languages == ("de", "en", "es")
    texts = ["the water and the house", "Der Garten, das Wasser!", "gartenhaus wasserhaus", "también jardínes"]  # the third has no known word
    assert [x[0] for x in m.scorer.predict(texts)] == ["en", "de", "de", "es"]
    assert np.allclose(m.score("garten"), m.words["garten"])
    g = m.score("gart")
    assert g.shape == (3,) and np.isfinite(g).all()
    assert np.isfinite(m.score("☃")).all() and np.isfinite(m.score("q")).all()


def test_defined_cases(spark):
    rows = [(1, None, 3.0), (2, "", 1.0), (3, "123 !? ___", 1.0), (4, "the house " * 50_000, 1.0), (4, "the house", 1.0), (None, "und der", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    out = [tuple(x) for x in langid.predict(docs.repartition(2), model(spark)).select("doc_id", "lang_pred", "score").collect()]
    assert len(out) == 6 and all(0 <= x[2] <= 1 for x in out)
    got = sorted(((x[0] or 0), x[1]) for x in out)
    assert got == [(0, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    empty = langid.fit(spark.createDataFrame([], "text string, lang string"))
    assert {x["lang_pred"] for x in langid.predict(docs, empty).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model(spark)).count() == 0


def test_small_caches_change_nothing(spark):
    m = model(spark)
    texts = [t for t in TEXTS.values()] + ["house garten casa " + "x y z w", "agua wasser water"]
    big, small = langid.Scorer(m), langid.Scorer(m, kept=3)
    assert list(big.predict(texts)) == list(small.predict(texts)) == [x for t in texts for x in langid.Scorer(m, block=1).predict([t])]


def brute(m, text):
    """Word by word, letter by letter, by the definition."""
    words = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()).split()
    if not words:
        return "und", 0.0
    mean = np.mean([m.score(w) for w in words], axis=0, dtype=np.float64)
    odds = np.exp(min(len(words), 25) * (mean - mean.max()))
    return m.languages[int(np.argmax(mean))], 1 / odds.sum()


def test_against_brute_force(spark):
    r, m = random.Random(3), model(spark)
    pool = [*" ".join(TEXTS.values()), *"xyzqß½²Ⅷ①_-.,7٣é中☃́ İſ"]
    texts = ["".join(r.choices(pool, k=r.randrange(60))) for _ in range(400)] + [None, "", "½", "²", "Ⅷ①", "a½b"]
    texts += [x["text"] for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    got, want = list(langid.Scorer(m, block=500).predict(texts)), [brute(m, t) for t in texts]
    assert [x[0] for x in got] == [x[0] for x in want] and np.allclose([x[1] for x in got], [x[1] for x in want], atol=1e-5)
    assert {x[0] for x in got[402:405]} == {"und"}


def test_sample_has_every_language_within_its_bound(spark):
    rows = [(f"the house number {i}", "en") for i in range(3000)] + [("one hot text", "en")] * 2000 + [("das haus", "de")] * 500
    rows += [(f"la casa {i}", "es") for i in range(4)] + [(None, "fr"), ("rien", None)]
    df = spark.createDataFrame(rows, "t string, l string")
    usable = df.filter("t is not null and l is not null").repartition(3)
    got = [tuple(x) for x in langid._sample(usable, 40).collect()]
    assert len(got) == len(set(got)) == 40 and set(got) <= {(l, t) for t, l in rows}
    assert sum(x[0] == "es" for x in got) == 4 and ("de", "das haus") in got
    assert sorted(got) == sorted(tuple(x) for x in langid._sample(usable.repartition(2), 40).collect())
    assert len(langid._sample(usable, 5000).collect()) == 3001 + 1 + 4
    assert langid.fit(df, "t", "l", max_rows=40).languages == ("de", "en", "es")
    many = spark.createDataFrame([(f"{w}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} the", "en") for w in ("ka", "lo", "mi") for i in range(676)] * 2 + [("zdravo svete", "sr")], "t string, l string")
    m = langid.fit(many, "t", "l", max_rows=600, max_words=100, max_grams=200)
    assert {"zdravo", "svete", "the"} <= set(m.words) and len(m.words) <= 100 and len(m.grams) <= 200
    assert next(m.scorer.predict(["zdravo"]))[0] == "sr"


def test_fold(spark):
    rows = spark.range(200).select("id", langid.held_out(F.col("id")).alias("h")).collect()
    assert all(x["h"] == (zlib.crc32(str(x["id"]).encode()) % 4 == 2) for x in rows)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.predict(docs, langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))).filter(langid.held_out(F.col("doc_id")))
    right, n = out.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right / n > 0.98
