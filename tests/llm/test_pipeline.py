from collections import Counter, defaultdict

import public_tokenizers
from test_mixing import brute_targets
from test_neardup import brute as brute_groups
from test_neardup import shingles
from test_quality import brute as brute_rules
from tokenizers import Tokenizer

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


def test_every_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "src0", 0), (10**6 + 2, "1 2 3 " * 60, None, None, 5)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    inputs = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        inputs[name] = docs
        out = stage(spark, docs, SF)
        assert out.columns == list(pipeline.COLUMNS) or k == 4
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    rows = {name: [tuple(x) for x in df.select("doc_id", "text", "source").collect()] for name, df in inputs.items()}
    packed = docs.collect()

    after = {d: t for d, t, _ in rows["language_id"]}
    for d, t, _ in rows["quality_rules"]:
        assert not (brute_rules(t)[5] and d in after)  # too short or repetitive ones went
        if d in after:
            assert set(after[d].split("\n")) <= set(t.split("\n")) and 2 * len(after[d]) >= len(t)
    labels = {x["doc_id"]: x["quality"] for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(labels.get(d, 1) == 1 for d in after)
    assert all(d in after for d, t, _ in rows["quality_rules"] if labels.get(d) == 1 and not brute_rules(t)[5])

    assert sorted(rows["near_dedup"]) == sorted(x for x in rows["language_id"] if any(c.isalpha() for c in x[1]))
    groups = brute_groups([x[:2] for x in rows["near_dedup"]], percent=80)
    assert {x[0] for x in rows["mixing"]} == {c for _, n, c in groups if n} and len(rows["mixing"]) == len({c for *_, c in groups})

    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in rows["mixing"]:
        sizes[s] += len(t.split())
    for _, t, s in rows["packing"]:
        taken[s] += len(t.split())
    smallest = {s: min(len(t.split()) for _, t, x in rows["mixing"] if x == s) for s in sizes}
    for s, goal in brute_targets(sizes).items():
        assert abs(taken[s] - goal) <= max(2, smallest[s]), s
    assert max(Counter(rows["packing"]).values()) <= 2 and set(rows["packing"]) <= set(rows["mixing"])

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t, _ in rows["packing"])
    assert sum(x["length"] for x in packed) == total
    assert len({x["sequence_id"] for x in packed}) <= 1.05 * total / 2048 + 1
    assert shingles("a b c") == {("a", "b", "c")}


def test_dedup_by_rows(spark):
    """Null and repeated ids: one row of each group stays, whatever its id is shared with."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    near = lambda t: t + " end"
    rows = [
        (None, a), (None, near(a)), (None, a), (None, b),  # groups of null ids only
        (1, c), (2, near(c)), (2, d),  # 2 is kept for d, but not for its copy of c
        (3, e), (3, near(e)), (3, e),  # copies under one id
        (None, near(d)), (None, ""), (None, ""), (None, None), (4, ""), (4, ""),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 4):
        out = [tuple(x) for x in pipeline.dedup(spark, docs.repartition(parts), SF).select("doc_id", "text").collect()]
        assert set(out) <= set(rows)
        said = Counter((i, t and t.removesuffix(" end")) for i, t in out)
        assert said == Counter([(None, a), (None, b), (1, c), (2, d), (3, e), (None, ""), (None, ""), (None, None), (4, "")])


def test_run(spark):
    out = pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 20
