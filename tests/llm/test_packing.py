import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stallwise.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = packing.Encoder(PATH)


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=600, deadline=None, derandomize=True, database=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="ab é.,!?'sdt 1½\n\t\r\x1c\xa0×ÿ<|>endoftx", max_size=40)))
def test_ids_are_the_tokenizers(text):
    got = ENCODER.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == ids_of(text)[:-1]


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "it's 'tis don't, stop. ... x  y\n\n z", "", " ", "word." * 50, "été 中文 \U0001f600!"])
def test_ids_of_chosen_texts(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids_of(text)[:-1]


def test_ids_of_whole_documents_and_all_sorts_of_letters(spark):
    texts = [x["text"] or "" for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    points = [c for c in range(0, 0x110000, 61) if not 0xD800 <= c < 0xE000] + list(range(0x500)) + list(range(0x2000, 0x2100))
    texts += [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}. {chr(c)}  {chr(c)}{chr(c)}\n" for c in points]
    texts += [" " * 200_000, "x" + "\n" * (packing.LONG_SPACE - 1) + "y", "\t" * packing.LONG_SPACE + "z", "ab" * 100_000]
    want = [x.ids for x in TOKENIZER.encode_batch_fast(texts, add_special_tokens=False)]
    assert ENCODER.fast is not None
    assert all(np.frombuffer(ENCODER.encode(t), "<u4").tolist() == w for t, w in zip(texts, want))


def check(rows, out, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for x in out:
        by_doc[x["doc_id"]].append(x)
        by_sequence[x["sequence_id"]].append((x["offset"], x["length"]))
    for doc, text in rows:
        ids, at = np.array(ids_of(text), dtype="<u4"), 0
        found = sorted(by_doc[doc], key=lambda x: x["piece"])
        assert [x["piece"] for x in found] == list(range(len(found)))
        for x in found:
            assert x["start"] == at and x["ids_crc32"] == zlib.crc32(ids[at : at + x["length"]].tobytes())
            at += x["length"]
        assert at == len(ids)
        assert all(x["length"] == capacity for x in found[1:]) and (len(found) == 1 or len(ids) > capacity)
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_round_trip_and_fill(spark):
    rows = [(i, "words and more words " * ((i * 7) % 40)) for i in range(400)] + [(1000, None), (1001, ""), (1002, "x y z " * 700)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int").repartition(9)
    out = [x.asDict() for x in packing.pack(docs, PATH, capacity=256).collect()]
    used = check(rows, out, 256)
    assert used <= 1.02 * sum(x["length"] for x in out) / 256 + 1


def test_empty_and_repeated(spark):
    schema = "doc_id long, text string"
    assert packing.pack(spark.createDataFrame([], schema), PATH).collect() == []
    out = packing.pack(spark.createDataFrame([(None, "a")] * 5, schema), PATH).collect()
    assert len(out) == 5 and len({x["sequence_id"] for x in out}) == 1 and sorted(x["offset"] for x in out) == [0, 2, 4, 6, 8]


@settings(max_examples=100, deadline=None, derandomize=True, database=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit(lengths):
    bins, offsets, fills = packing.best_fit(np.array(lengths, dtype=np.int64), 50)
    for b in set(bins.tolist()):
        spans = sorted((int(o), n) for o, n, x in zip(offsets, lengths, bins) if x == b)
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) == next(f for f, x in zip(fills, bins) if x == b) <= 50


def test_items_that_never_pair_stay_in_bounded_tasks(spark):
    items = spark.range(3000).selectExpr("id", "30L as length").repartition(10)
    out = packing.pack_items(items, 50, per_task=400)
    assert out.select("sequence_id").distinct().count() == 3000


def test_merging_bins_across_partitions(spark):
    items = spark.range(64).selectExpr("id", "25L as length").repartition(64)
    assert packing.pack_items(items, 50, fan_in=2).select("sequence_id").distinct().count() == 32
