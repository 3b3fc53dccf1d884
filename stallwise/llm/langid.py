"""Language identification, word first: known words score by their log frequency in each
language, unseen ones by ever shorter character n-grams.

The model is fitted on a sample of labelled rows of bounded size, and its tables have
bounded sizes too, so it is small enough to ship to every task.  Prediction reads
each document once, whole, without a shuffle.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches

UNKNOWN = "und"


#: Python's word characters but for decimal digits and ``_``: letters, and numerals such as those of fractions.
WORDS = re.compile(r"[^\W\d_]+")


def only_letters(words: list[str]) -> list[str]:
    """Words parted at what isn't a letter, as ``\\p{L}+`` in the fit."""
    return [p for w in words for p in "".join(c if c.isalpha() else " " for c in w).split()]


@dataclass(frozen=True, eq=False)
class Model:
    """Log frequencies by language: of words, and of the n-grams of padded words."""

    languages: tuple[str, ...]
    words: dict[str, np.ndarray]
    grams: dict[str, np.ndarray]
    unseen: np.ndarray
    longest: int

    def score(self, word: str) -> np.ndarray:
        """One float per language, in nats.

        A known word's own frequencies; else the mean, over the places of the padded
        word, of the longest known n-gram that starts there, one nat less for each letter that the
        n-gram is shorter than the longest.  This is the definition; ``Scorer`` does it for many words at once.
        """
        known = self.words.get(word)
        if known is not None:
            return known
        padded = f" {word} "
        total, places = np.zeros(len(self.languages)), len(padded) - 1
        for i in range(places):
            for n in range(min(self.longest, len(padded) - i), 0, -1):
                found = self.grams.get(padded[i : i + n])
                if found is not None:
                    total += found - (self.longest - n)
                    break
            else:
                total += self.unseen
        return total / places

    @functools.cached_property
    def scorer(self) -> Scorer:
        """The process's scorer, which later tasks in it use again."""
        return Scorer(self)


def _log_table(counts: list[tuple[str, str, int]], languages: tuple[str, ...]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Smoothed log frequencies of items from (item, language, count), and those of an unseen item."""
    at = {x: i for i, x in enumerate(languages)}
    raw: dict[str, np.ndarray] = {}
    for item, language, n in counts:
        raw.setdefault(item, np.zeros(len(languages)))[at[language]] += n
    totals = sum(raw.values(), np.zeros(len(languages))) + 0.5 * (len(raw) + 1)
    table = {k: np.log((v + 0.5) / totals).astype(np.float32) for k, v in raw.items()}
    return table, np.log(0.5 / totals).astype(np.float32)


def _most_each(counts: dict[str, int], most: int) -> int:
    """How many of each language make up ``most`` at most: small languages whole, the others alike, one of each at least."""
    left = most
    for k, n in enumerate(sorted(counts.values())):
        share = left // (len(counts) - k)
        if n > share:
            return max(1, share)
        left -= n
    return most


def _sample(usable: DataFrame, max_rows: int) -> DataFrame:
    """``l, t``: of each language the distinct texts of the smallest hashes, ``max_rows`` in all at most, from ``t, l``."""
    hashed = usable.withColumn("h", F.xxhash64("t", "l"))
    distinct = hashed.select("l", "h").distinct().persist()
    try:
        counts = {x["l"]: x["n"] for x in distinct.groupBy("l").agg(F.count("*").alias("n")).collect()}
        each = _most_each(counts, max_rows)
        large = {k: n for k, n in counts.items() if n > each}
        if not large:
            return hashed.groupBy("l", "h").agg(F.first("t").alias("t")).select("l", "t")
        spark = usable.sparkSession
        # Hashes are uniform: these bounds let a few more through than are needed, which then give the exact ones.
        bounds = [(k, min(2**63 - 1, -(2**63) + int(2**64 * min(1.0, (each + 8 * each**0.5 + 30) / n)))) for k, n in large.items()]
        some = distinct.join(F.broadcast(spark.createDataFrame(bounds, "l string, bound long")), "l").filter("h <= bound")
        least: dict[str, list[int]] = {}
        for x in some.select("l", "h").collect():
            least.setdefault(x["l"], []).append(x["h"])
        exact = [(k, sorted(v)[min(each, len(v)) - 1]) for k, v in least.items()]
        taken = hashed.join(F.broadcast(spark.createDataFrame(exact, "l string, bound long")), "l", "left").filter("bound is null or h <= bound")
        return taken.groupBy("l", "h").agg(F.first("t").alias("t")).select("l", "t")
    finally:
        distinct.unpersist()


def _most_frequent(counts: DataFrame, item: str, most: int) -> DataFrame:
    """At most ``most`` items of ``item, l, n``: all those of a language with few, and the most frequent of the rest."""
    sizes = {x["l"]: x["c"] for x in counts.groupBy("l").agg(F.count("*").alias("c")).collect()}
    # A quarter is set aside, so that a language of a few texts isn't crowded out.
    few = [k for k, c in sizes.items() if c <= most // (4 * len(sizes))]
    top = counts.groupBy(item).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), item).limit(most - sum(sizes[k] for k in few)).select(item)
    return top.union(counts.filter(F.col("l").isin(few)).select(item)).distinct() if few else top


def fit(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    max_rows: int = 20_000,
    max_words: int = 40_000,
    max_grams: int = 40_000,
    longest: int = 4,
) -> Model:
    """Fit a model on rows with a text and a language.

    Bounds, all on the fit alone: ``max_rows`` distinct texts at most (but one of each language at least), chosen by a
    hash of the text, whole, with as many of each language as it has or as the bound leaves it; and the
    ``max_words`` words and ``max_grams`` n-grams that are the most frequent in them, those of languages with few included.
    Words of more than 60 letters, which are none, take no part in the fit.
    """
    usable = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    sample = _sample(usable, max_rows)
    found = F.regexp_extract_all(F.lower("t"), F.lit(r"(?U)([\p{L}]+)"), F.lit(1))
    words = sample.select("l", F.explode(found).alias("w")).groupBy("w", "l").agg(F.count("*").alias("n"))
    words = words.filter(F.length("w") <= 60).persist()
    try:
        languages = tuple(sorted(x["l"] for x in words.select("l").distinct().collect()))
        top = _most_frequent(words, "w", max_words)
        counts = words.join(F.broadcast(top), "w").select("w", "l", "n").collect()
        padded = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
        starts = F.sequence(F.lit(1), F.length(padded))
        grams = F.flatten(F.array(*[F.transform(starts, lambda i, k=k: F.substring(padded, i, F.lit(k))) for k in range(1, longest + 1)]))
        sized = words.select("l", "n", F.explode(F.array_distinct(grams)).alias("g")).groupBy("g", "l").agg(F.sum("n").alias("n")).persist()
        top = _most_frequent(sized, "g", max_grams)
        gram_counts = sized.join(F.broadcast(top), "g").select("g", "l", "n").collect()
        sized.unpersist()
    finally:
        words.unpersist()
    word_table, _ = _log_table([tuple(x) for x in counts], languages)
    gram_table, unseen = _log_table([tuple(x) for x in gram_counts], languages)
    return Model(languages, word_table, gram_table, unseen, longest)


class Scorer:
    """Scores texts; keeps the vectors of at most ``kept`` words besides a block's own.

    The n-grams are a tree: a node is a prefix, its vector that of the longest known n-gram on the way to
    it.  All places of all words new to the scorer go down the tree together, a letter at a time.
    """

    def __init__(self, model: Model, kept: int = 50_000, block: int = 1 << 18):
        # The model holds its scorer, so the scorer doesn't hold the model: a worker that drops one is rid of both.
        self.languages, self.words, self.longest, self.kept, self.block = model.languages, model.words, model.longest, kept, block
        self.letters = np.array(sorted({ord(c) for g in model.grams for c in g} | {ord(" ")}), dtype=np.uint32)
        code = {chr(c): k for k, c in enumerate(self.letters.tolist(), 1)}
        nodes, vectors, steps = {"": 0}, [model.unseen.astype(np.float64)], {}
        for prefix in sorted({g[:n] for g in model.grams for n in range(1, len(g) + 1)}, key=len):
            found, above = model.grams.get(prefix), nodes[prefix[:-1]]
            steps[above * (len(code) + 1) + code[prefix[-1]]] = nodes[prefix] = len(vectors)
            vectors.append(vectors[above] if found is None else found - np.float64(model.longest - len(prefix)))
        self.vectors = np.array(vectors)
        self.steps = np.array(sorted(steps), dtype=np.int64)
        self.next = np.array([steps[k] for k in self.steps.tolist()], dtype=np.int64)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.languages)))

    def unseen(self, words: list[str]) -> np.ndarray:
        """The scores, a row each, of words that the model doesn't know."""
        data = np.frombuffer("".join([f" {w} " for w in words]).encode("utf-32-le"), dtype=np.uint32)
        codes = np.minimum(np.searchsorted(self.letters, data), len(self.letters) - 1)
        codes = np.where(self.letters[codes] == data, codes + 1, 0)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
        ends = np.repeat(np.cumsum(lengths), lengths)
        node = np.zeros(len(data), dtype=np.int64)
        alive = np.arange(len(data))
        for n in range(self.longest if len(self.steps) else 0):
            alive = alive[alive + n < ends[alive]]
            step = node[alive] * (len(self.letters) + 1) + codes[alive + n]
            found = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
            taken = self.steps[found] == step
            alive = alive[taken]
            node[alive] = self.next[found[taken]]
        starts = np.cumsum(lengths) - lengths
        each = self.vectors[node]
        each[starts + lengths - 1] = 0  # no n-gram starts at the last blank
        return np.add.reduceat(each, starts) / (lengths - 1)[:, None]

    def _add(self, words: set[str]) -> None:
        if len(self.at) + len(words) > len(self.table):
            grown = np.zeros((max(len(self.at) + len(words), 2 * len(self.table)), self.table.shape[1]))
            grown[: len(self.at)] = self.table[: len(self.at)]
            self.table = grown
        known = self.words
        new = [w for w in words if w not in known]
        old = [w for w in words if w in known]
        k = len(self.at)
        if new:
            self.table[k : k + len(new)] = self.unseen(new)
        if old:
            self.table[k + len(new) : k + len(words)] = [known[w] for w in old]
        self.at.update(zip(new + old, range(k, k + len(words))))

    def _block(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        found = [WORDS.findall(t.lower()) if t else [] for t in texts]
        missing = set().union(*found).difference(self.at)
        if not all(map(str.isalpha, missing)):
            found = [only_letters(words) for words in found]
            missing = set().union(*found).difference(self.at)
        if missing and len(self.at) + len(missing) > self.kept:
            self.clear()
            missing = set().union(*found)
        self._add(missing)
        for words in found:
            if not words:
                yield UNKNOWN, 0.0
                continue
            total = self.table[np.fromiter(map(self.at.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
            mean = total / len(words)
            best = int(np.argmax(mean))
            odds = np.exp(np.minimum(len(words), 25) * (mean - mean[best]))
            yield self.languages[best], float(1 / odds.sum())

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """Each text's language and its probability, from the mean score a word over at most 25 words' worth of evidence."""
        if not self.languages:
            yield from ((UNKNOWN, 0.0) for _ in texts)
            return
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= self.block):
                size += len(texts[stop] or "")
                stop += 1
            yield from self._block(texts[start:stop])
            start = stop


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict every row's language: all columns of ``docs``, and ``lang_pred, score``.

    Defined cases: a text that is null or has no letter gives ``und`` with score 0, as does
    a model without languages; ties go to the first language by name; very long texts are scored whole; repeated rows are scored each and alike; columns
    of the input with the new names are replaced; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shipped.value.scorer
        for batch in batches:
            if len(batch):
                guesses = list(scorer.predict(batch[text_col].to_pylist()))
                new = [pa.array([g[0] for g in guesses], pa.string()), pa.array([g[1] for g in guesses], pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "lang_pred", "score"])
        give_back()

    return small_batches(docs).mapInArrow(scored, f"{schema}, lang_pred string, score double")


def held_out(id_: Column, fold: int = 2, folds: int = 4) -> Column:
    """Whether a row belongs to the fold that no model learns from; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold
