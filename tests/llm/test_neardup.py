import random
import re

import numpy as np
import pytest

from stallwise.llm import neardup
from stallwise.llm.graph import components
from stallwise.llm.shingles import shingle_sets


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, percent=85):
    """Components by comparing every pair of distinct texts that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    by, root = {}, list(range(len(rows)))
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(s), doc if not s else least.get(find(i))) for i, (doc, s) in enumerate(zip((r[0] for r in rows), sets))]


def found(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, class string")
    out = neardup.near_duplicates(docs.repartition(3), **how).collect()
    assert all(x["kept"] == (x["doc_id"] is not None and x["doc_id"] == x["component_id"]) for x in out)
    return sorted([tuple(x)[:3] for x in out], key=repr)


def test_driver_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(x) for x in docs.select("doc_id", "text").collect()]
    assert found(spark, rows) == sorted(brute(rows), key=repr)


def test_near_copies_shared_passages_and_chains(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows = []
    base = [word() for _ in range(200)]
    for i in range(120):  # near copies of one text, all different, some of them near the threshold
        t = list(base)
        for _ in range(1 + i % 5):
            t[r.randrange(200)] = word()
        rows.append((i, " ".join(t)))
    for i in range(200, 320):  # one passage in otherwise different texts, of which it is a half
        rows.append((i, " ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)])))
    chain = [word() for _ in range(120)]
    for i in range(400, 440):  # each like the one before
        chain = [*chain[1:], word()]
        rows.append((i, " ".join(chain)))
    for i in range(500, 560):  # short texts, a word apart
        rows.append((i, " ".join([*base[:12], word()][r.randrange(2) :])))
    r.shuffle(rows)
    want = sorted(brute(rows), key=repr)
    assert found(spark, rows) == want
    assert found(spark, rows, crowd=1) == want  # all by their differences from hubs
    assert found(spark, rows, k=None) == want  # on whole sets


def test_defined_cases(spark):
    long = "lorem ipsum dolor " * 30_000 + "end"
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A "), (6, "a b c d e"), (6, "x y"), (7, "x  Y"), (None, "q r s"), (None, "x y"), (8, long), (9, long)]
    assert found(spark, rows) == sorted(brute(rows), key=repr)
    assert found(spark, []) == []


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 9), *((i, i + 1) for i in range(100, 160))]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, **{i: 100 for i in range(100, 161)}}


@pytest.mark.parametrize("text", ["A b\x0bC d  e f", "é É x" + "y" * 300, "one", "", "a b c d e a b c d e"])
def test_shingle_counts(text):
    assert [len(s) for _, s in shingle_sets([None, text, text + " z"])][1:] == [len(shingles(text)), len(shingles(text + " z"))]


def test_long_words_differ():
    one, two = (next(iter(shingle_sets(["a" * 64 + x + "b" * 64])))[1] for x in ("xy", "yx"))
    assert not np.array_equal(one, two)


def test_least_shared():
    assert 30 < neardup.least_shared(64, 85) < 45 and neardup.least_shared(1, 85) == 1
