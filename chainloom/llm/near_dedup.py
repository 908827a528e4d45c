"""Near duplicates by ProbMinHash, banding and verification.

A text is the set of its five-word shingles.  Every shingle is a Poisson process whose rate is
its weight: each arrival goes to a random register, and a register keeps the shingle that
arrives first.  Two texts agree in a register with the probability Jaccard similarity of
their weights.  All weights are 1, however often a shingle occurs, so that this is the
similarity that is verified: repeated lines don't part a pair.  Arrivals later than
the time by which all registers are taken can't matter, so that a shingle's process ends
early.  Texts that agree in a band of registers share a bucket, and their shingle sets are
then compared exactly; a Jaccard similarity of at least ``SIMILAR`` makes a link, and
linked texts are one class.

Within a bucket every text is compared with a few pivots, not with all others.  Classes
merge, and in buckets that still hold several, the texts outside the largest class are
compared with all others in blocks of bounded size.  So a group of thousands of copies costs
a few comparisons for each, and no link between classes is lost.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from chainloom.llm import common

WORDS = 5
SIMILAR = 0.8
BANDS = 40
ROWS = 7
# So many texts of a bucket are pivots in the first turn, in the second, and so on.
PIVOTS = (1, 1)
# Members, and members outside the largest class, that are compared in one task.
BLOCK = 2048
BLOCK_OUTSIDE = 512
WORD = re.compile(r"\w+")

MIX_1, MIX_2, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(z: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit generator: equal inputs give equal, others independent bits."""
    z = (z ^ (z >> np.uint64(30))) * MIX_1
    z = (z ^ (z >> np.uint64(27))) * MIX_2
    return z ^ (z >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Distinct hashes of the runs of five words; a text of fewer words has one shingle, one
    without a word none."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(len(words) - WORDS + 1, 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(WORDS, len(words))):
        total = mixed(total * GOLDEN + hashes[i:i + n])
    return np.unique(total)


def registers(elements: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """For each of ``m`` registers the element that arrives first."""
    out = np.zeros(m, np.uint64)
    filled = np.zeros(m, bool)
    # By this time all registers are taken, but for one case in fifty; then time is doubled.
    horizon = m * (math.log(m) + 4) / weights.sum()
    while True:
        time, index = np.zeros(len(elements)), 0
        active = np.arange(len(elements))
        times, places, who = [], [], []
        while len(active):
            expected = float((weights[active] * (horizon - time[active])).max())
            c = int(expected + 2 * math.sqrt(expected)) + 2
            z = mixed(elements[active, None] + GOLDEN * np.arange(index + 1, index + c + 1, dtype=np.uint64))
            gaps = -np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[active, None]
            arrive = time[active, None] + np.cumsum(gaps, axis=1)
            row, col = np.nonzero(arrive <= horizon)
            times.append(arrive[row, col])
            places.append(((mixed(z[row, col] ^ GOLDEN) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32))
            who.append(active[row])
            time[active] = arrive[:, -1]
            index += c
            active = active[time[active] <= horizon]
        times, places, who = np.concatenate(times), np.concatenate(places).astype(np.int64), np.concatenate(who)
        late_first = np.argsort(-times, kind="stable")
        out[places[late_first]] = elements[who[late_first]]
        filled[places] = True
        if filled.all():
            return out
        horizon *= 2


def bands(text: str) -> list[int]:
    """A bucket for each band; none for a text without a word."""
    elements = shingles(text)
    if not len(elements):
        return []
    kept = registers(elements, np.ones(len(elements)), BANDS * ROWS).reshape(BANDS, ROWS)
    key = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
    for j in range(ROWS):
        key = mixed(key * GOLDEN + kept[:, j])
    return key.view(np.int64).tolist()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, copy (hash of the exact text) and buckets of each row with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = [bands(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), pa.array(buckets, pa.list_(pa.int64()))], ["doc_id", "copy", "buckets"])

    text = common.text_or_empty()
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(text.cast("binary")).alias("copy"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, copy string, buckets array<bigint>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id and the sorted 32-bit hashes of the shingles of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique((shingles(t) >> np.uint64(32)).astype(np.uint32).view(np.int32)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int32()))], ["doc_id", "own"])

    return docs.select("doc_id", common.text_or_empty().alias("text")).mapInArrow(run, "doc_id bigint, own array<int>")


def components(edges: DataFrame) -> DataFrame:
    """v and its class c, the least id that edges (a, b) lead to: labels fall along edges
    and along themselves until none changes."""
    both = common.written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "dedup-edges")
    labels = common.written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("c"), F.lit(-1).cast("bigint").alias("was")), "dedup-labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        lower = labels.select("v", "c").join(near.select(F.col("a").alias("v"), "m"), "v").select("v", F.least("c", "m").alias("c"), F.col("c").alias("was"))
        lower = common.written(lower, "dedup-lower")
        up = lower.select(F.col("v").alias("c"), F.col("c").alias("up"))
        labels = common.written(lower.join(up, "c").select("v", F.least("c", "up").alias("c"), "was"), "dedup-labels")
        if labels.where("c <> was").isEmpty():
            return labels.select("v", "c")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar, with their similarity."""
    with_b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("own").alias("of_b")), "b")
    both = with_b.join(sets.select(F.col("doc_id").alias("a"), F.col("own").alias("of_a")), "a")
    common_size = F.size(F.array_intersect("of_a", "of_b"))
    both = both.select("a", "b", (common_size / (F.size("of_a") + F.size("of_b") - common_size)).alias("similarity"))
    return both.where(F.col("similarity") >= SIMILAR)


def star(state: DataFrame, pivots: int) -> DataFrame:
    """Pairs of each member with the first few outside its bucket's largest class, where
    the two are of different classes."""
    order = Window.partitionBy("bucket").orderBy("x")
    first = state.where("outside").select("bucket", F.col("x").alias("p"), F.col("c").alias("pc"), F.row_number().over(order).alias("at"))
    met = state.join(first.where(F.col("at") <= pivots).drop("at"), "bucket").where("x <> p AND c <> pc")
    return met.select(F.least("x", "p").alias("a"), F.greatest("x", "p").alias("b")).distinct()


def compared(state: DataFrame, sets: DataFrame) -> DataFrame:
    """The links between different classes in each bucket.

    Any two members of different classes have one outside the largest class.  Those are
    dealt into blocks, as are all members, and each pair of blocks is compared in memory;
    only links leave it."""
    rows = state.join(sets.withColumnRenamed("doc_id", "x"), "x").select(
        "bucket", "x", "c", "own", "outside", F.ceil(F.col("n") / BLOCK).cast("int").alias("wide"),
        F.ceil((F.col("n") - F.col("most.n")) / BLOCK_OUTSIDE).cast("int").alias("high"),
    )
    rows = common.written(rows, "dedup-compared")
    deal = lambda blocks, salt: F.pmod(F.xxhash64("x", F.lit(salt)), F.col(blocks)).cast("int")
    left = rows.where("outside").withColumn("i", deal("high", 1)).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
    right = rows.withColumn("j", deal("wide", 2)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("high") - 1)))

    def run(outside: pa.Table, own: pa.Table) -> pa.Table:
        a, b, similarity = [], [], []
        if len(outside) and len(own):
            flat = own.column("own").combine_chunks().flatten().to_numpy()
            sizes = np.array([len(r) for r in own.column("own")])
            starts = np.cumsum(sizes) - sizes
            names, codes = np.unique(flat, return_inverse=True)
            ids, of = own.column("x").to_numpy(), own.column("c").to_numpy()
            for x, c, its in zip(outside.column("x").to_pylist(), outside.column("c").to_pylist(), outside.column("own")):
                values = np.asarray(its.values)
                mark = np.zeros(len(names), np.int64)
                at = np.minimum(np.searchsorted(names, values), len(names) - 1)
                mark[at[names[at] == values]] = 1
                both = np.add.reduceat(mark[codes], starts)
                near = both / (len(values) + sizes - both)
                for k in np.flatnonzero((near >= SIMILAR) & (of != c)):
                    a.append(min(x, int(ids[k])))
                    b.append(max(x, int(ids[k])))
                    similarity.append(float(near[k]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(similarity, pa.float64())})

    key = "bucket", "i", "j"
    left, right = left.select(*key, "x", "c", "own"), right.select(*key, "x", "c", "own")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "a bigint, b bigint, similarity double").dropDuplicates(["a", "b"])


def merged_classes(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The classes (v, c) after new links between them."""
    if links.isEmpty():
        return labels
    edges = links.select("a", "b")
    if labels is None:
        return components(edges)
    of_a, of_b = labels.select(F.col("v").alias("a"), F.col("c").alias("ca")), labels.select(F.col("v").alias("b"), F.col("c").alias("cb"))
    edges = edges.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(edges)
    moved = labels.join(joined.select(F.col("v").alias("c"), F.col("c").alias("to")), "c", "left").select("v", F.coalesce("to", "c").alias("c"))
    return common.written(moved.unionAll(joined.join(labels.select("v"), "v", "left_anti")), "dedup-classes")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, copy_of, n_links of each row with an id.

    ``class_id`` is the least id of the class, ``copy_of`` the least id with exactly the same
    text, ``n_links`` the number of verified links found at that text.  A null text counts as
    empty.  Texts without a word are only in a class with their exact copies.  Rows of one id
    are one document; of several texts, the one of least hash is compared.
    An empty table gives no rows; other columns are ignored.
    """
    drawn = sketches(docs).groupBy("doc_id").agg(F.min(F.struct("copy", "buckets")).alias("first")).select("doc_id", "first.*")
    drawn = common.written(drawn, "dedup-sketches")
    # One row for each exact text, whatever number of copies it has.
    texts = drawn.groupBy("copy").agg(F.min(F.struct("doc_id", "buckets")).alias("first")).select("copy", "first.*")
    texts = common.written(texts, "dedup-texts")
    members = texts.select(F.col("doc_id").alias("x"), F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = common.written(members.join(shared, "bucket"), "dedup-buckets")

    involved = members.select(F.col("x").alias("doc_id")).distinct().join(texts.select("doc_id", "copy"), "doc_id")
    involved = common.written(involved, "dedup-involved")
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.md5(common.text_or_empty().cast("binary")).alias("copy"))
    own = common.join_sized(own, involved, ["doc_id", "copy"], "left_semi", 64 * involved.count())
    sets = common.written(shingle_sets(own).dropDuplicates(["doc_id"]), "dedup-sets")

    links, labels = None, None
    for turn in range(len(PIVOTS) + 1):
        # Members of buckets that hold several classes, and the largest class of each.
        state = members.withColumn("c", F.col("x")) if labels is None else members.join(labels.withColumnRenamed("v", "x"), "x", "left").withColumn("c", F.coalesce("c", "x"))
        per_class = state.groupBy("bucket", "c").agg(F.count("*").alias("n"))
        several = per_class.groupBy("bucket").agg(F.max(F.struct("n", "c")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("classes")).where("classes > 1")
        state = common.written(state.join(several.select("bucket", "n", "most"), "bucket").withColumn("outside", F.col("c") != F.col("most.c")), "dedup-open")
        if state.isEmpty():
            break
        if turn < len(PIVOTS):
            found = verified(star(state, PIVOTS[turn]), sets)
        else:
            found = compared(state, sets)
        new = common.written(found, "dedup-links")
        links = new if links is None else links.unionAll(new)
        labels = merged_classes(labels, new)

    result = drawn.select("doc_id", "copy").join(texts.select("copy", F.col("doc_id").alias("copy_of")), "copy")
    result = result.groupBy("doc_id").agg(F.min("copy_of").alias("copy_of"))
    if labels is None:
        return result.select("doc_id", F.col("copy_of").alias("class_id"), "copy_of", F.lit(0).cast("bigint").alias("n_links"))
    ends = links.select(F.explode(F.array("a", "b")).alias("copy_of")).groupBy("copy_of").agg(F.count("*").alias("n_links"))
    of_text = texts.select(F.col("doc_id").alias("copy_of")).join(labels.select(F.col("v").alias("copy_of"), "c"), "copy_of", "left").join(ends, "copy_of", "left")
    of_text = of_text.select("copy_of", F.coalesce("c", "copy_of").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return result.join(of_text, "copy_of").select("doc_id", "class_id", "copy_of", "n_links")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows without those that are not the first of their class; rows without an id stay.
    Of several rows of the first id all stay."""
    found = classes(docs)
    gone = common.written(found.where("doc_id <> class_id").select(F.col("doc_id").alias("_gone")), "dedup-gone")
    n = gone.count()
    return docs.join(F.broadcast(gone) if 16 * n <= common.BROADCAST_BYTES else gone, docs["doc_id"] == gone["_gone"], "left_anti")
