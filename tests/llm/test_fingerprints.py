import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stallwise.llm import fingerprints as fp


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


@settings(max_examples=60, deadline=None, derandomize=True, database=None)
@given(st.lists(st.tuples(st.text("ABCD", max_size=64), st.text("ABCD", max_size=64)), max_size=12))
def test_edit_distances(pairs):
    left, right = [a.encode() for a, _ in pairs], [b.encode() for _, b in pairs]
    assert fp.distances(left, right).tolist() == [distance(a, b) for a, b in zip(left, right)]


def slow_print(raw):
    """The same fingerprint, byte by byte."""
    if not raw:
        return fp.LEAST_BLOCK, b"", b""
    mask = (1 << 64) - 1
    mixed = lambda x: int(fp.mix(np.array([x & mask], dtype=np.uint64))[0])
    hashes = [
        mixed(sum(int(fp._BYTE[raw[i - k]]) * int(fp._SLIDE[k]) for k in range(min(fp.WINDOW, i + 1)))) >> 32 for i in range(len(raw))
    ]

    def signature(size):
        out, start, chunks = "", 0, 0
        for i in range(len(raw)):
            last = i == len(raw) - 1
            if last or (hashes[i] % size == size - 1 and chunks < fp.LONGEST - 1):
                total = sum(int(fp._BYTE[raw[j]]) * int(fp._PLACE[(j - start) & 4095]) + ((j - start) >> 12) for j in range(start, i + 1))
                out += chr(fp.ALPHABET[mixed(total) >> 58])
                start, chunks = i + 1, chunks + 1
        return out.encode()

    block = fp.LEAST_BLOCK
    while block * fp.LONGEST < len(raw):
        block *= 2
    while block > fp.LEAST_BLOCK and len(signature(block)) < fp.LONGEST // 2:
        block //= 2
    return block, signature(block), signature(2 * block)


@pytest.mark.parametrize("text", ["", "a", "ab" * 400, "".join(random.Random(1).choices("abcdef gh", k=3000)), "é中 " * 500, "x" * 9000])
def test_fingerprints_byte_by_byte(text):
    assert fp.fingerprint(text.encode()) == slow_print(text.encode())


def test_likeness():
    r = random.Random(2)
    text = "".join(r.choices("abcdefgh ijkl", k=4000))
    other = "".join(r.choices("abcdefgh ijkl", k=4000))
    near = text[:1000] + "some words put in " + text[1000:]
    a, b, c, empty = (fp.fingerprint(x.encode()) for x in (text, near, other, ""))
    same, close, far, none, nothing = fp.likeness([(a, a), (a, b), (a, c), (a, empty), (empty, empty)])
    assert (same, none, nothing) == (1, 0, 1) and close > 0.8 > 0.5 > far


def brute(rows):
    rows = sorted(rows, key=lambda x: -x[0])
    out = {}
    for i, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        changed = fp.edited(text, following)
        a, b, c = (slow_print(x.encode()) for x in (text, changed, following))
        near = [fp.likeness([(a, x)])[0] for x in (b, c)]
        out[doc] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), fp.text_of(a), fp.text_of(b), *near)
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 90])
def test_whole_table(spark, n):
    r = random.Random(n)
    rows = [(i * 3, None if i % 13 == 5 else "".join(r.choices("abc é中\n", k=r.randrange(0, 400)))) for i in range(n)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, run int, edge string")
    out = {x["doc_id"]: tuple(x)[1:] for x in fp.fingerprints(docs.repartition(5)).collect()}
    assert out == brute(rows)


def test_nulls_and_repeated_rows(spark):
    rows = [(None, "a"), (None, None), *[(4, "same text " * 30)] * 20, (4, "other"), (9, "long " * 30_000)]
    out = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((x["doc_id"] or -1) for x in out) == sorted((x[0] or -1) for x in rows)
    prints = {x["fingerprint"] for x in out if x["n_chars"] == 300}
    assert len(prints) == 1 and all(0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1 for x in out)


@pytest.mark.parametrize("kind", ["int", "string", "double", "decimal(9,2)", "timestamp"])
def test_ids_of_any_type(spark, kind):
    rows = [(i, "abc é " * (i + 1) * 9) for i in range(1, 9)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
    out = fp.fingerprints(docs.repartition(3))
    assert out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    got = {str(x["doc_id"]): tuple(x)[1:] for x in out.collect()}
    names = {x["text"]: str(x["doc_id"]) for x in docs.collect()}
    assert got == {names[dict(rows)[i]]: x for i, x in brute(rows).items()}
