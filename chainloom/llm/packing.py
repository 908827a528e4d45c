"""Best-fit packing of documents into sequences of a fixed capacity, under conflicts.

Two pieces of one source, or of one duplicate cluster, never share a bin.  Bins stand in
the order of what is left in them, and each carries bitmaps of its sources and clusters.  A
piece goes to the bin it leaves the least space in: the search starts at the first residual
that can hold it and goes on to the next larger one until a bin without a conflict is found.

The rows are dealt by a hash of their id into groups of bounded size, which are packed
independently; so neither a large source nor a large cluster meets in one task, and each
group loses at most what its last bins leave empty.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chainloom.llm import common
from chainloom.llm.token_counts import with_token_counts

CAPACITY = 2048
GROUP_ROWS = 8192
# So many of a group's most frequent sources have an index of the bins without them.  Each
# source has a bit of its own, and the search for the others looks at the bins themselves.
INDEXED_SOURCES = 64


class Bins:
    """Open bins by residual.  ``levels[s]`` is a bitmap of the residuals at which there is
    a bin without source ``s``, so that the successor search is one shift.  Source 0 is in
    no bin; sources from ``sources`` on have no bitmap."""

    def __init__(self, capacity: int, sources: int):
        self.capacity = capacity
        self.sources = sources
        self.levels = [0] * sources
        self.without = [[0] * (capacity + 1) for _ in range(sources)]
        self.at: dict[int, dict[int, list[int]]] = defaultdict(dict)
        self.left: list[int] = []
        self.source_map: list[int] = []
        self.cluster_map: list[int] = []

    def file(self, b: int) -> None:
        left, own = self.left[b], self.source_map[b]
        self.at[left].setdefault(own, []).append(b)
        for s in range(self.sources):
            if not own >> s & 1:
                if not self.without[s][left]:
                    self.levels[s] |= 1 << left
                self.without[s][left] += 1

    def unfile(self, b: int) -> None:
        left, own = self.left[b], self.source_map[b]
        peers = self.at[left][own]
        peers.remove(b)
        if not peers:
            del self.at[left][own]
        for s in range(self.sources):
            if not own >> s & 1:
                self.without[s][left] -= 1
                if not self.without[s][left]:
                    self.levels[s] &= ~(1 << left)

    def tightest(self, size: int, source: int, cluster: int) -> int:
        """The compatible bin with the least residual of at least ``size``, the oldest among
        equals; -1 if there is none.  ``cluster`` is a bitmap of at most one bit."""
        open_levels = self.levels[source if source < self.sources else 0] >> size
        while open_levels:
            lowest = open_levels & -open_levels
            fitting = [
                b for own, bins in self.at[size + lowest.bit_length() - 1].items() if not own >> source & 1
                for b in ([min(bins)] if not cluster else [b for b in bins if not self.cluster_map[b] & cluster])
            ]
            if fitting:
                return min(fitting)
            open_levels ^= lowest
        return -1

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin of a piece and its start in it."""
        b = self.tightest(size, source, cluster)
        if b < 0:
            b = len(self.left)
            self.left.append(self.capacity)
            self.source_map.append(0)
            self.cluster_map.append(0)
        else:
            self.unfile(b)
        start = self.capacity - self.left[b]
        self.left[b] -= size
        self.source_map[b] |= 1 << source if source else 0
        self.cluster_map[b] |= cluster
        self.file(b)
        return b, start


def pack_group(sizes: Sequence[int], sources: Sequence[str | None], clusters: Sequence[int | None], capacity: int) -> list[tuple[int, int]]:
    """Bin and start of each piece, which come in the order they are placed in.  A null
    source or cluster conflicts with nothing."""
    # Slot 0 is for pieces that no other of the group conflicts with by source.
    counts = Counter(s for s in sources if s is not None)
    names = sorted((s for s, n in counts.items() if n > 1), key=lambda s: (-counts[s], s))
    slot = {s: i for i, s in enumerate(names, 1)}
    often = [c for c, n in Counter(c for c in clusters if c is not None).items() if n > 1]
    bit = {c: 1 << i for i, c in enumerate(often)}
    bins = Bins(capacity, min(len(names), INDEXED_SOURCES) + 1)
    return [bins.place(size, slot.get(source, 0), bit.get(cluster, 0)) for size, source, cluster in zip(sizes, sources, clusters)]


def pack(df: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Where each piece of each row goes: bin_id, doc_id, piece, piece_start (its place in
    the document), n_tokens, bin_start (its place in the bin).

    ``df`` has doc_id, n_tokens, source, cluster; other columns are ignored.  A row longer
    than the capacity is cut into full pieces, each a bin of its own, and a rest that is
    packed with the others.  A null or negative length counts as 0; such a row is placed too.
    Rows with equal ids are placed one by one.  An empty table gives no rows.
    """
    rows = common.written(
        df.select(
            "doc_id", F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_tokens"),
            F.col("source").cast("string").alias("source"), F.col("cluster").cast("bigint").alias("cluster"),
        ), "packing-sizes",
    )
    total = rows.agg(F.coalesce(F.sum(F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1))), F.lit(0))).first()[0]
    n_groups = max(1, math.ceil(total / group_rows))
    # Rows without an id, or of an id that occurs more than once, are dealt by their place too.
    repeated = common.written(rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("again")), "packing-repeated")
    rows = common.join_sized(rows.withColumn("place", F.monotonically_increasing_id()), repeated, ["doc_id"], "left", 64 * repeated.count())
    rows = rows.withColumn("place", F.when(F.col("doc_id").isNull() | F.col("again"), F.col("place")))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / capacity).cast("int") - 1, F.lit(0)))))
    pieces = pieces.select(
        "doc_id", "source", "cluster", "piece", (F.col("piece") * F.lit(capacity).cast("bigint")).alias("piece_start"),
        F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("piece") * capacity).alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "piece", "place"), F.lit(n_groups)).alias("group"),
    )

    def pack_one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        placed = pack_group(table.column("n_tokens").to_pylist(), table.column("source").to_pylist(), table.column("cluster").to_pylist(), capacity)
        bins, starts = np.array(placed, np.int64).T
        group = table.column("group")[0].as_py()
        return pa.table({
            "bin_id": pa.array(bins + (group << 32)), "doc_id": table.column("doc_id"), "piece": table.column("piece"),
            "piece_start": table.column("piece_start"), "n_tokens": table.column("n_tokens"), "bin_start": pa.array(starts),
        })

    id_type = dict(rows.dtypes)["doc_id"]
    return pieces.groupBy("group").applyInArrow(
        pack_one, f"bin_id bigint, doc_id {id_type}, piece int, piece_start bigint, n_tokens bigint, bin_start bigint"
    )


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """Packing of documents by the tokens of their whole text.  Equal texts are a duplicate
    cluster; a null text counts as empty."""
    text = common.text_or_empty()
    sized = with_token_counts(docs.select("doc_id", "source", text.alias("text"), F.xxhash64(text).alias("cluster")), path, pattern)
    return pack(sized, capacity)
