"""Near-duplicate groups by bottom-k sketches of word shingles under one hash function.

1. One pass hashes every text's distinct shingles.  Texts with equal sets form a
   class, which goes on as one; copies, however many, cost nothing from here.
2. A class's sketch is its ``k`` smallest hashes.  Inverted lists of sketch values
   propose pairs.  A linked pair shares at least ``least_shared`` of its sketch values (but for a chance
   of ``risk``), so it shares one among each side's rarest ``k - least_shared + 1``; only those
   enter the lists, and a passage that thousands of texts share does not.
3. Every list first pairs its members with one hub, the member whose values most others
   hold.  What that links is contracted.  In lists of up to ``crowd`` members, those of
   different components are then paired, within compatible sizes; in longer ones, those
   that differ alike from the hub.  A group of near copies so costs about its size, not its square.
4. Sketches of the union estimate each pair's similarity, and pairs that pass are
   verified on their full sets.

Components of the verified links are the groups.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut, free_shuffles, give_back, small_batches
from .graph import components
from .shingles import shingle_sets

#: Ids of so many bytes at most are broadcast to find the texts to verify; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: So many values make every sketch the whole set.
EXACT = 1 << 40
#: The chance that a linked pair's sketches are taken for those of an unlinked one, at each of two places.
RISK = 1e-7

_SIGN = np.uint64(1 << 63)


def least_shared(k: int, percent: int, risk: float = RISK) -> int:
    """The most values that two sketches of ``k`` share with a chance of at least ``1 - risk`` at the least similarity."""
    if k >= EXACT:
        return 1  # no set is larger than its sketch, so nothing goes by this
    p, below, n = percent / 100, 0.0, 0
    while True:
        below += math.comb(k, n) * p**n * (1 - p) ** (k - n)
        if below > risk:
            return max(n, 1)
        n += 1


def _class_of(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def sketches(docs: DataFrame, k: int, width: int) -> DataFrame:
    """``doc_id, class, n_shingles, sketch`` of every row (columns ``doc_id, text``)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, counts, values = [], [], []
            for _, hashes in shingle_sets(batch["text"].to_pylist(), width):
                classes.append(_class_of(hashes))
                counts.append(len(hashes))
                values.append((hashes[:k] ^ _SIGN).view(np.int64))  # in the order of signed numbers
            offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))
            columns = [batch["doc_id"], pa.array(classes, pa.binary()), pa.array(counts, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "class", "n_shingles", "sketch"])
        give_back()

    return small_batches(docs.select("doc_id", "text")).mapInArrow(hashed, f"doc_id {kind}, class binary, n_shingles long, sketch array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """``class, hashes`` of every row with a word."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, hashes in shingle_sets(batch["text"].to_pylist(), width):
                if len(hashes):
                    found = pa.ListArray.from_arrays(pa.array([0, len(hashes)], pa.int32()), pa.array(hashes.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array([_class_of(hashes)], pa.binary()), found], names=["class", "hashes"])
        give_back()

    return small_batches(docs.select("text")).mapInArrow(hashed, "class binary, hashes array<long>")


def rarest(classes: DataFrame, k: int, percent: int, risk: float = RISK) -> DataFrame:
    """The inverted lists: ``value, class, n, weight`` for each class's rarest sketch values that another class has too.

    The weight is how many classes hold the class's values, summed: the text that a group's
    members are copies of has the values that most of them kept, so it weighs most.
    """
    n, held = F.col("n"), F.least(F.col("n"), F.lit(k))
    # Sets this small pair only with sets that their sketches hold whole, so the bound is exact.
    whole = n * 100 <= k * percent
    prefix = F.when(whole, n - F.ceil(n * percent / 100) + 1).otherwise(held - least_shared(k, percent, risk) + 1)
    values = classes.select("class", "n", F.explode("sketch").alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("c")).filter("c > 1")
    shared = values.join(common, "value").groupBy("class").agg(F.first("n").alias("n"), F.sum("c").alias("weight"), F.sort_array(F.collect_list(F.struct("c", "value"))).alias("vs"))
    # Values that no other class has are the rarest of all and use up the prefix first.
    take = F.greatest(F.lit(0), prefix - held + F.size("vs")).cast("int")
    return shared.select("class", "n", "weight", F.explode(F.slice("vs", F.lit(1), take)).alias("x")).select(F.col("x.value").alias("value"), "class", "n", "weight")


def _fits(n: str, m: str, percent: int) -> Column:
    """Whether two sets' sizes allow the similarity."""
    return F.least(F.col(n), F.col(m)) * 100 >= F.greatest(F.col(n), F.col(m)) * percent


def _apart(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists whose members are in different components so far, with each member's ``root``."""
    at = lists.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    mixed = at.groupBy("value").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("value")
    return at.join(mixed, "value", "left_semi")


def hub_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Each list's members with its hub, its weightiest member, ``a < b``."""
    hubs = lists.groupBy("value").agg(F.max(F.struct("weight", F.col("class").alias("a"), F.col("n").alias("m"))).alias("hub"))
    pairs = lists.join(hubs, "value").filter((F.col("hub.a") != F.col("class")) & _fits("n", "hub.m", percent))
    return pairs.select(F.least("hub.a", "class").alias("a"), F.greatest("hub.a", "class").alias("b")).distinct()


def cross_pairs(lists: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a < b`` of the lists' members that are in different components and may be similar in size.

    Sizes fall in bands as wide as the similarity allows, so a member meets only its own
    and one neighbouring band.
    """
    band = F.floor(F.log("n") / (-math.log(percent / 100) * 1.0001))
    at = _apart(lists, roots).withColumn("band", band)
    other = at.select("value", F.col("class").alias("c2"), F.col("n").alias("m"), F.col("root").alias("root2"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), (F.col("band")).alias("own"))
    pairs = at.join(other, ["value", "band"]).filter(
        (F.col("root") != F.col("root2")) & _fits("n", "m", percent) & ((F.col("own") != F.col("band")) | (F.col("class") < F.col("c2")))
    )
    return pairs.select(F.least("class", "c2").alias("a"), F.greatest("class", "c2").alias("b")).distinct()


def _linked(x: str, y: str, n: Column, m: Column, percent: int) -> Column:
    """Whether two sets of sizes ``n`` and ``m`` are as similar as that."""
    return F.size(F.array_intersect(x, y)) * (100 + percent) >= (n + m) * percent


def estimated(pairs: DataFrame, classes: DataFrame, k: int, percent: int, risk: float = RISK) -> DataFrame:
    """``a, b, sure`` for pairs that their sketches don't rule out; ``sure`` if the sketches hold the full sets."""

    def sketched(name: str) -> DataFrame:
        return classes.select(F.col("class").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))

    joined = pairs.join(sketched("b"), "b").join(sketched("a"), "a")
    whole = F.greatest("n_a", "n_b") <= k
    # One of the sketches is full, so their union has k values at least; of its k smallest, how many both have.
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, k)
    both = F.size(F.array_intersect(union, F.array_intersect("s_a", "s_b")))
    found = F.when(whole, _linked("s_a", "s_b", F.col("n_a"), F.col("n_b"), percent)).otherwise(both >= least_shared(k, percent, risk))
    return joined.filter(found).select("a", "b", whole.alias("sure"))


def sets_of(wanted: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``class, hashes``: the full sets of some classes, from one text of each."""
    wanted = cut(wanted.select("class").distinct())
    ids = wanted.join(classes, "class").select("doc_id").distinct()
    size = ids.agg(F.coalesce(F.sum(F.octet_length(F.col("doc_id").cast("string")) + 24), F.lit(0))).first()[0] + 24 * wanted.count()
    if size <= BROADCAST_BYTES:
        ids, wanted = F.broadcast(ids), F.broadcast(wanted)
    texts = docs.alias("d").join(ids.alias("i"), F.equal_null(F.col("d.doc_id"), F.col("i.doc_id")), "left_semi")
    sets = full_sets(texts, width).join(wanted, "class", "left_semi")
    return sets.groupBy("class").agg(F.first("hashes").alias("hashes"))


def crowd_pairs(lists: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, width: int, scratch: Scratch) -> DataFrame:
    """Pairs ``a < b`` that may be linked among the members of long lists, found by how they differ from a hub.

    Let D(x) be the hashes by which x and the hub differ.  What x and y differ by is what D(x) and D(y) do, so with
    q = 100 + percent and r = 100 - percent, x and y are linked if and only if
    2 q |D(x) & D(y)| >= q |D(x)| + q |D(y)| - r |x| - r |y|.  Put D(x) and D(y) in one order.  If
    the first hash of both is at place j of D(y), they share |D(y)| - j + 1 at most, so
    u(x) = q |D(x)| - r |x| is at most v(y, j) = q |D(y)| - 2 q (j - 1) + r |y|, and likewise u(y) and v(x, i).
    Members linked with the hub are in its component already; one that isn't, a loose one, has u(x) > r |hub|.  So only pairs
    with a loose member are looked for, by hashes with v(y, j) > r |hub|.  With the rarest hashes first those are
    the ones that a copy got by edits of its own, and hardly any pair comes up that isn't linked.
    """
    q, r = 100 + percent, 100 - percent
    hubs = lists.groupBy("value").agg(F.max(F.struct("weight", F.col("class").alias("hub"))).alias("best")).select("value", "best.hub")
    members = cut(lists.join(hubs, "value").filter("class <> hub").select("hub", "class").distinct())
    sets = scratch.write(sets_of(members.select("class").union(members.select(F.col("hub"))), classes, docs, width), "crowd_sets")
    joined = members.join(sets, "class").join(sets.select(F.col("class").alias("hub"), F.col("hashes").alias("h")), "hub")
    d = F.concat(F.array_except("hashes", "h"), F.array_except("h", "hashes"))
    differ = joined.select("hub", "class", F.size("hashes").cast("long").alias("n"), (r * F.size("h").cast("long")).alias("least"), d.alias("ds"))
    each = scratch.write(differ.select("hub", "class", "n", "least", F.size("ds").cast("long").alias("size"), F.explode("ds").alias("d")), "differences")
    common = each.groupBy("hub", "d").agg(F.count("*").alias("c")).filter("c > 1")
    order = Window.partitionBy("hub", "class").orderBy("c", "d")
    at = each.join(common, ["hub", "d"]).withColumns({"place": F.row_number().over(order), "shared": F.count("*").over(Window.partitionBy("hub", "class"))})
    # Differences that no other member has are the rarest and have the first places; j - 1 counts them too.
    before = F.col("place") - 1 + F.col("size") - F.col("shared")
    u, spread = q * F.col("size") - r * F.col("n"), r * F.col("n")
    at = at.select("hub", "d", "class", "least", u.alias("u"), (q * F.col("size") + spread - 2 * q * before).alias("v"), (spread * 100 / percent).alias("most"))
    # A partner y of x has |y| <= |x| 100 / percent and |D(y)| >= |D(x)| - |what they differ by|: so u(y) >= u(x) - 2 r |y|.
    left = at.filter("u > least and v >= greatest(u - 2 * most, -most)").select("hub", "d", "class", "u", "v")
    right = at.filter("v > least").select("hub", "d", F.col("class").alias("other"), F.col("u").alias("u2"), F.col("v").alias("v2"), (F.col("u") > F.col("least")).alias("loose"))
    fits = F.when(F.col("loose"), F.col("class") < F.col("other")).otherwise(F.col("class") != F.col("other"))
    pairs = left.join(right, ["hub", "d"]).filter((F.col("u") <= F.col("v2")) & (F.col("u2") <= F.col("v")) & fits)
    return pairs.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, width: int, scratch: Scratch, risk: float = RISK) -> DataFrame:
    """The links ``a, b`` among the pairs, confirmed on the full sets of one text of each class."""
    likely = cut(estimated(pairs, classes, k, percent, risk))
    unsure = likely.filter(~F.col("sure"))
    sets = scratch.write(sets_of(unsure.select(F.col("a").alias("class")).union(unsure.select("b")), classes, docs, width), "sets")
    joined = unsure.join(sets.select(F.col("class").alias("b"), F.col("hashes").alias("h_b")), "b")
    joined = joined.join(sets.select(F.col("class").alias("a"), F.col("hashes").alias("h_a")), "a")
    links = joined.filter(_linked("h_a", "h_b", F.size("h_a"), F.size("h_b"), percent)).select("a", "b")
    links = cut(links.union(likely.filter("sure").select("a", "b")))
    scratch.drop("sets")
    free_shuffles(docs.sparkSession)
    return links


def near_duplicates(docs: DataFrame, percent: int = 85, k: int | None = 64, width: int = 5, crowd: int = 50, risk: float = RISK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's group: ``doc_id, n_shingles, component_id, kept``.

    Words are runs of other than white space with A-Z in lower case.  Two texts are linked when the
    Jaccard similarity of their sets of ``width``-word shingles is at least ``percent``
    / 100; a text with fewer words is one shingle.  component_id is the smallest id that links reach;
    the row with that id is kept.

    A link is missed with a chance of ``2 * risk`` at most where neither set fits a sketch of ``k``.  With ``k`` None nothing is left to chance: the
    inverted lists hold prefixes of the whole sets and no estimate comes before the verification, at the cost of tables as large as the sets.

    Defined cases: a null, empty or blank text has no shingles, is linked with nothing and is
    its own component; rows with a null id take part, but name no component unless all its
    ids are null (then component_id is null), and are never kept; rows with equal ids get
    a result each; an empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    k = EXACT if k is None else k
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(sketches(docs, k, width), "sketches")
    grouped = rows.filter(F.col("class").isNotNull()).groupBy("class")
    classes = scratch.write(grouped.agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "classes")
    lists = scratch.write(rarest(classes, k, percent, risk), "lists")
    first = cut(hub_pairs(lists, percent))
    links = verified(first, classes, docs, k, percent, width, scratch, risk)
    roots = cut(components(links))
    free_shuffles(docs.sparkSession)
    # What is left: short lists pair their members, long ones those that differ alike from the hub.
    left = scratch.write(_apart(lists, roots).drop("root"), "apart")
    lengths = left.groupBy("value").agg(F.count("*").alias("length"))
    short = left.join(lengths.filter(F.col("length") <= crowd), "value", "left_semi")
    long_ = left.join(lengths.filter(F.col("length") > crowd), "value", "left_semi")
    pairs = cross_pairs(short, roots, percent).union(crowd_pairs(long_, classes, docs, percent, width, scratch)).distinct()
    pairs = cut(pairs.join(first, ["a", "b"], "left_anti"))
    scratch.drop("lists", "apart", "crowd_sets", "differences")
    more = verified(pairs, classes, docs, k, percent, width, scratch, risk)
    if not more.isEmpty():
        roots = cut(components(links.union(more)))
        free_shuffles(docs.sparkSession)
    member = classes.select("class", "doc_id").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = member.groupBy("root").agg(F.min("doc_id").alias("component"))
    named = member.join(least, "root").select("class", "component")
    out = rows.select("doc_id", "class", "n_shingles").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
