import re

from hypothesis import given, settings
from hypothesis import strategies as st

from stallwise.llm import licenses


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = {}
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at.setdefault(label, []).extend(i for i in range(len(words)) if words[i : i + len(p)] == p)
    places = sorted(x for v in at.values() for x in v)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(k for k, v in at.items() if v)))


def scanned(spark, texts, **how):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, label string, template int")
    return {x["doc_id"]: x for x in licenses.scan(docs.repartition(2), **how).collect()}


def base(x):
    return (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"])


FILL = "some words of prose that say nothing about it "


def test_templates_and_phrases(spark):
    mit = licenses.TEMPLATES[1][1]
    words = mit.split()
    texts = [
        FILL + mit + " " + FILL,
        FILL + " ".join([*words[:9], "new", "words", *words[9:]]),  # two words put in
        FILL + " ".join([*words[:8], *words[9:]]),  # one left out
        " ".join(words[:8]),  # less than half of it
        FILL * 3 + "Licensed under CC BY-NC 4.0. " + FILL + "Released under the MIT License.",
        "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
        (FILL * 40 + mit + " ") * 50,
        "licensed under cc by 4.0",
    ]
    out = scanned(spark, texts)
    assert [out[i]["labels"] for i in range(8)] == ["mit", "mit", "mit", "", "cc-by-nc,mit", "cc-by-nc", "mit", "cc-by"]
    assert out[0]["score"] == 1 and 0.7 <= out[1]["score"] < 1 and out[3]["score"] == 0
    (span,) = out[0]["spans"]
    assert (span["first"], span["last"]) == (9, 9 + len(words) - 1)
    assert len(out[6]["spans"]) == 50
    for i, t in enumerate(texts):
        assert base(out[i]) == brute(t)


def test_defined_cases(spark):
    texts = [None, "", "!!", "MIT LICENSE", "mité license mit license", "general public\nlicense " * 3, "mit licenKe", "apache license " * 40_000, "x mit", "license", "K İ mit license"]
    out = scanned(spark, texts)
    for i, t in enumerate(texts):
        assert base(out[i]) == brute(t), t
        assert set(filter(None, out[i]["base_labels"].split(","))) <= set(out[i]["labels"].split(","))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(empty).collect() == []
    same = spark.createDataFrame([(None, "mit license")] * 5 + [(1, "a"), (1, "b c")], "doc_id long, text string")
    assert len(licenses.scan(same).collect()) == 7


def test_random_texts(spark):
    texts = []

    @settings(max_examples=150, database=None, derandomize=True)
    @given(st.lists(st.sampled_from(["mit", "MIT", "license", "License.", "apache", "general", "public", "-", "é", "4"]), max_size=12))
    def collect(words):
        texts.append(" ".join(words))

    collect()
    out = scanned(spark, texts)
    assert [base(out[i]) for i in range(len(texts))] == [brute(t) for t in texts]
