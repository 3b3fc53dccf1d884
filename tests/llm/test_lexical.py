import collections
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stallwise.llm import lexical, queries

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = {i: i + 32 for i in range(65, 91)}


def words(text):
    return [w.translate(LOW) for w in TERM.findall(text or "")]


def brute(docs, items, k=10):
    held = [(i, collections.Counter(words(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    df = collections.Counter(w for _, c in held for w in c)
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(words(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in terms if w in c)
            if score > 0:
                scores.append((-score, i is None, i, item))
        out += [(item, r + 1, i, -s) for r, (s, _, i, item) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("size, pack", [(3_000, 100), (1 << 24, 50_000)])
def test_ranks(spark, tmp_path, size, pack):
    d = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    lexical.index(docs.repartition(3), block_bytes=size).write.parquet(f"file://{tmp_path}/i")
    got = lexical.search(spark.read.parquet(f"file://{tmp_path}/i"), items, pack=pack).collect()
    want = brute([(x["doc_id"], x["text"]) for x in docs.collect()], [(x["item_id"], x["text"]) for x in items.collect()])
    assert sorted(map(tuple, got), key=str) == want and len(want) == 10 * items.count()


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "?!"), (4, "a b"), (5, "A  B"), (6, "a b"), (None, "b a"), (7, "c " * 70_000), (8, "Ä c"), (8, "ä c d"), (9, "a b")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, rank int").repartition(4)
    asked = [(1, "a"), (1, "B b"), (2, None), (3, "zzz"), (4, "c Ä"), (None, "d"), (5, "")]
    items = spark.createDataFrame([(i, t, "x") for i, t in asked], "item_id int, text string, doc_id string")
    for k in (1, 3, 10):
        assert sorted(map(tuple, lexical.ranked(docs, items, k).collect()), key=str) == brute(rows, asked, k)
    empty = docs.limit(0)
    assert lexical.ranked(empty, items).collect() == [] and lexical.ranked(docs, items.limit(0)).collect() == []
    assert lexical.ranked(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 29), st.integers(1, 9), min_size=1), min_size=1, max_size=8), st.integers(1, 5), st.integers(0, 30))
def test_nothing_that_may_qualify_is_left_out(found, k, floor):
    lists = [(np.array(sorted(x)), np.array([x[d] for d in sorted(x)]), max(x.values())) for x in found]
    whole = collections.Counter()
    for x in found:
        whole.update(x)
    able, scores = lexical.maxscore(lists, 30, k, floor)
    assert dict(zip(able.tolist(), scores.tolist())).items() <= whole.items()
    kth = sorted(whole.values(), reverse=True)[:k][-1]
    assert {d for d, s in whole.items() if s >= max(kth, floor)} <= set(able.tolist())


def test_non_essential_lists_are_only_probed(monkeypatch):
    """A frequent term of little weight adds nothing to the documents that can't qualify."""
    rare, common = (np.arange(5), np.full(5, 1000), 1000), (np.arange(10_000), np.full(10_000, 3), 3)
    probed = []
    real = np.searchsorted
    monkeypatch.setattr(lexical.np, "searchsorted", lambda a, v, **how: probed.append(len(v)) or real(a, v, **how))
    able, scores = lexical.maxscore([common, rare], 10_000, 5, 0)
    assert able.tolist() == [0, 1, 2, 3, 4] and set(scores.tolist()) == {1003} and probed == [5]


def test_query(spark):
    got = queries.queries()["op12_lexical_search"](spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
