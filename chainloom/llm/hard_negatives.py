"""Hard negatives by BOND: vectors are read a dimension at a time, and bounds on the rest
shrink the set of candidates.

Components become the integers floor(256 x).  For an anchor, the dimensions of a block of
rows are read in descending order of the anchor's magnitudes.  After some of them, a row's
score lies between its partial sum plus the least and plus the largest contribution that
the block's minima and maxima allow for the dimensions not read.  A row leaves the bitmap of
candidates as soon as that interval misses every wanted window, or lies below what is
already certain to take the places there.  The first scan finds an anchor's nearest rows of
its own label, the second the nearest rows of other labels in the window below each of them.

Anchors come in groups of a bounded number of values, each broadcast to all tasks; a task
keeps a few rows for each anchor and reads its rows block by block.

Defined results.  Rows with a null id, label or vector, or with a null or non-finite
component (also one that isn't finite after the scaling), take no part.  Only vectors of one
length are compared.  A row of the anchor's own id is neither its positive nor its negative;
equal anchors count once, other rows as often as they are stored.  A vector without
components scores 0.  Scores beyond 64 bits are held at the ends of that range.  An empty
table gives no rows.  Columns besides the three named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window, functions as F

from chainloom import session

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100  # a window is LOW..HIGH hundredths of the positive's score
READ = 8  # dimensions read between two prunings
BLOCK_VALUES = 1 << 20  # values of a block of rows
GROUP_VALUES = 1 << 20  # values of a group of anchors
EXACT = 2.0**53  # sums below it are exact in doubles
LONGEST = 2**63 - 1

CLEAN = "vec_id bigint, label bigint, vector array<double>"
POSITIVE = "anchor bigint, anchor_id bigint, vec_id bigint, score bigint"
NEGATIVE = "anchor bigint, anchor_id bigint, positive int, positive_id bigint, positive_score bigint, vec_id bigint, score bigint"


def scaled(rows: DataFrame) -> DataFrame:
    """Rows that take part, with components scaled but not yet floored: floor of a double may
    not fit 64 bits in SQL."""
    vector = F.transform("embedding", lambda x: x.cast("double") * SCALE)
    rows = rows.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)


def exact(vectors: np.ndarray, other: np.ndarray) -> bool:
    """Whether all inner products, and what they are made of, are exact in doubles."""
    if not vectors.size or not other.size:
        return True
    return float(np.abs(vectors).max()) * float(np.abs(other).max()) * max(vectors.shape[-1], 1) * 2 < EXACT


def as_objects(values: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in values.ravel()], dtype=object).reshape(values.shape)


def held_to_64_bits(scores: np.ndarray) -> np.ndarray:
    return np.clip(scores, -LONGEST - 1, LONGEST) if scores.dtype == object else scores


class Block:
    """Rows of one vector length, a column for each dimension, with each column's ends."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels = ids, labels
        self.columns = np.ascontiguousarray(vectors.T)
        self.least, self.most = self.columns.min(axis=1), self.columns.max(axis=1)
        self.whole = None

    def scan(self, anchor: np.ndarray, candidates: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the candidates that ``keep(lower, upper)`` leaves.

        ``candidates`` is the bitmap; dimensions are read in descending magnitude.
        """
        columns, least, most = self.columns, self.least, self.most
        if not exact(columns, anchor):
            if self.whole is None:
                self.whole = as_objects(columns), as_objects(least), as_objects(most)
            columns, least, most = self.whole
            anchor = as_objects(anchor)
        order = np.argsort(-np.abs(anchor), kind="stable")
        order = order[anchor[order] != 0]
        ends = np.stack([anchor[order] * least[order], anchor[order] * most[order]])
        # What the dimensions from a place on can still add, at least and at most.
        low = np.append(np.cumsum(ends.min(axis=0)[::-1])[::-1], 0)
        high = np.append(np.cumsum(ends.max(axis=0)[::-1])[::-1], 0)
        bitmap = candidates.copy()
        partial = np.zeros(len(bitmap), dtype=anchor.dtype)
        at = np.flatnonzero(bitmap)
        for start in range(0, len(order), READ):
            dims = order[start : start + READ]
            part = columns[dims] if len(at) == len(bitmap) else columns[np.ix_(dims, at)]
            partial[at] += anchor[dims] @ part
            read = start + len(dims)
            known = partial[at]
            stays = keep(held_to_64_bits(known + low[read]), held_to_64_bits(known + high[read]))
            bitmap[at[~stays]] = False
            at = np.flatnonzero(bitmap)
            if not len(at):
                break
        return at, held_to_64_bits(partial[at])


def kth_largest(values: np.ndarray, k: int):
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


def best(scores: list[int], ids: list[int], new_scores, new_ids, k: int) -> tuple[list[int], list[int]]:
    """The k first of both, larger scores first, then smaller ids."""
    both = sorted([*zip((-s for s in scores), ids, strict=True), *zip((-int(s) for s in new_scores), (int(i) for i in new_ids), strict=True)])[:k]
    return [-s for s, _ in both], [i for _, i in both]


def few(at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Which of the found rows may be among the k first; all ties stay."""
    least = kth_largest(scores, k)
    return np.ones(len(at), bool) if least is None else scores >= least


class Nearest:
    """An anchor's first rows of its own label."""

    def __init__(self):
        self.scores: list[int] = []
        self.ids: list[int] = []

    def read(self, block: Block, anchor_id: int, label: int, vector: np.ndarray) -> None:
        def keep(lower, upper):
            least = kth_largest(lower, POSITIVES)
            if len(self.scores) == POSITIVES:
                least = self.scores[-1] if least is None else max(least, self.scores[-1])
            return np.ones(len(upper), bool) if least is None else (upper >= least).astype(bool)

        at, scores = block.scan(vector, (block.labels == label) & (block.ids != anchor_id), keep)
        if len(at):
            stays = few(at, scores, POSITIVES)
            self.scores, self.ids = best(self.scores, self.ids, scores[stays], block.ids[at[stays]], POSITIVES)


class Windows:
    """For each of an anchor's positives the first rows of other labels in its window."""

    def __init__(self, positives: list[int]):
        self.ends = [(-(-LOW * p // HIGH), p) for p in positives]
        self.found: list[tuple[list[int], list[int]]] = [([], []) for _ in positives]

    def wanted(self, lower, upper) -> np.ndarray:
        stays = np.zeros(len(upper), bool)
        for (low, high), (scores, _) in zip(self.ends, self.found, strict=True):
            if low > high:
                continue
            certain = lower[((lower >= low) & (upper <= high)).astype(bool)]
            least = kth_largest(certain, NEGATIVES)
            if len(scores) == NEGATIVES:
                least = scores[-1] if least is None else max(least, scores[-1])
            floor = low if least is None else max(low, least)
            stays |= ((upper >= floor) & (lower <= high)).astype(bool)
        return stays

    def read(self, block: Block, anchor_id: int, label: int, vector: np.ndarray) -> None:
        at, scores = block.scan(vector, (block.labels != label) & (block.ids != anchor_id), self.wanted)
        for i, (low, high) in enumerate(self.ends):
            inside = ((scores >= low) & (scores <= high)).astype(bool)
            if inside.any():
                places, values = at[inside], scores[inside]
                stays = few(places, values, NEGATIVES)
                self.found[i] = best(*self.found[i], values[stays], block.ids[places[stays]], NEGATIVES)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Arrow rows gathered into blocks of a bounded number of values, by vector length."""
    held: dict[int, list[tuple]] = {}
    values = 0

    def made() -> Iterator[Block]:
        for parts in held.values():
            yield Block(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        held.clear()

    for batch in batches:
        ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        vectors = batch.column(2)
        lengths = np.diff(vectors.offsets.to_numpy())
        flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False))
        starts = np.concatenate([[0], np.cumsum(lengths)])
        for width in np.unique(lengths):
            rows = np.flatnonzero(lengths == width)
            held.setdefault(int(width), []).append((ids[rows], labels[rows], flat[starts[rows][:, None] + np.arange(width)].reshape(len(rows), int(width))))
        values += len(flat) + len(ids)
        if values >= BLOCK_VALUES:
            yield from made()
            values = 0
    yield from made()


def record(names: str, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [part.split() for part in names.split(", ")]
    for start in range(0, len(rows), 10_000):
        columns = zip(*rows[start : start + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if kind == "int" else pa.int64()) for c, (_, kind) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def scanned(rows: DataFrame, anchors: list[tuple], searches, schema: str, told) -> DataFrame:
    """Each task's results for a group of anchors.

    ``searches(i)`` makes the search of the i-th anchor (None: nothing is wanted), and
    ``told(i, anchor_id, search)`` lists its rows.
    """
    sent = rows.sparkSession.sparkContext.broadcast([(a, label, np.floor(np.array(v, dtype=float))) for _, a, label, v in anchors])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}
        for block in blocks(batches):
            for i, (anchor_id, label, vector) in enumerate(sent.value):
                if len(vector) != len(block.columns):
                    continue
                search = found[i] if i in found else found.setdefault(i, searches(i))
                if search is not None:
                    search.read(block, anchor_id, label, vector)
        yield from record(schema, [row for i, search in found.items() if search is not None for row in told(i, sent.value[i][0], search)])

    return rows.mapInArrow(run, schema)


def groups(anchors: DataFrame) -> list[int]:
    """Numbers of groups that hold at most about GROUP_VALUES values each."""
    values = anchors.agg(F.sum(F.size("vector") + 4)).first()[0] or 0
    return list(range(-(-values // GROUP_VALUES)))


def ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(rows: DataFrame, is_anchor) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for every
    row of (vec_id, label, embedding) that the condition ``is_anchor`` calls an anchor."""
    spark = rows.sparkSession
    path = session.scratch(spark, "hard-negatives")
    scaled(rows).write.parquet(f"{path}/rows")
    rows = spark.read.schema(CLEAN).parquet(f"{path}/rows")
    anchors = rows.where(is_anchor).distinct()
    numbers = groups(anchors)
    by_group = anchors.withColumn("group", F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(max(len(numbers), 1))))
    by_group.write.partitionBy("group").parquet(f"{path}/anchors")
    parts = [mined_group(spark, rows, f"{path}/anchors/group={g}", f"{path}/found", g) for g in numbers]
    out = None
    for part in filter(None, parts):
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], NEGATIVE + ", rank int")
    return out.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def mined_group(spark, rows: DataFrame, anchors_path: str, path: str, group: int) -> DataFrame | None:
    """Both scans for the anchors of a group; None if the group is empty."""
    try:
        read = spark.read.schema(CLEAN).parquet(anchors_path).collect()
    except AnalysisException:  # a group that no anchor fell into has no folder
        return None
    anchors = [(i, *row) for i, row in enumerate(sorted(map(tuple, read)))]

    nearest = scanned(
        rows, anchors, lambda i: Nearest(), POSITIVE,
        lambda i, anchor_id, search: [(i, anchor_id, v, s) for s, v in zip(search.scores, search.ids, strict=True)],
    )
    ranked(nearest, ["anchor"], POSITIVES).write.parquet(f"{path}-positives-{group}")
    positives: dict[int, list[tuple[int, int]]] = {}
    for row in spark.read.parquet(f"{path}-positives-{group}").orderBy("anchor", "rank").collect():
        positives.setdefault(row.anchor, []).append((row.vec_id, row.score))

    def told(i, anchor_id, search):
        return [
            (i, anchor_id, n, *positives[i][n], v, s)
            for n, (scores, ids) in enumerate(search.found) for s, v in zip(scores, ids, strict=True)
        ]

    found = scanned(rows, anchors, lambda i: Windows([s for _, s in positives[i]]) if i in positives else None, NEGATIVE, told)
    ranked(found, ["anchor", "positive"], NEGATIVES).write.parquet(f"{path}-negatives-{group}")
    return spark.read.parquet(f"{path}-negatives-{group}")


ORACLE = """
WITH held AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS vec_id, a.label = r.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM held a JOIN held r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id AND len(a.v) = len(r.v)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 5"""
