"""Conversation prefix trie, with subtree totals by centroid decomposition.

Each conversation is rebuilt from the first turns of another and its own later ones.  A turn
has a fingerprint that holds its depth; the running sums of fingerprints identify a prefix,
so that all prefixes come from one aggregation and the parent's key is a difference.  A node
is named by its smallest member and its depth.

Totals over subtrees come from a centroid decomposition of the forest of parent edges.  A
node weighs as many turns as its members have from it on, which the aggregation gives for
every subtree at once.  The centroid of a component is its deepest node that holds half of
the component's weight or more.  The total of what hangs below the centroid is added to every
node on the path from the centroid to the component's top; then the centroid is taken out and
what is left falls apart into components of half the weight at most.  Rounds of Spark jobs do
this for all heavy components together; a component that is light enough is finished inside
one task in the same way.  So long chains and hot prefixes need a logarithmic number of rounds.

No conversation has to fit a task: its turns are dealt by range, and running totals are
carried over the few parts it spans.  The ids of a node's ends are joined in pieces and
hashed as a stream, one node after the other, since SHA-256 is sequential.

Defined results.  Rows without a conversation id belong to no conversation and are left out.
Null roles and texts count as empty.  Turns of one number (null first) stand in the order of
role and text; repeated rows are repeated turns.  No conversation gives no node, also no
root.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from chainloom import session
from chainloom.llm import common

GROUP = 20  # conversations c - c % GROUP … share their first turns
HEADS = 4  # as many as crc32 % HEADS of them
COMPONENT_WEIGHT = 20_000  # up to which a component is finished in one task
IDS = 1024  # span of conversation ids in one piece of a node's ends
WORDS = r"[^\x20\x09-\x0D]+"

SUMS = ["s0", "s1", "s2", "s3"]
MARKS = ["m0", "m1", "m2", "m3"]
NODE = ["depth", *SUMS]


def stored(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def heads(conv_id: str = "conv_id") -> Column:
    return F.crc32(F.col(conv_id).cast("string").cast("binary")) % HEADS


def parts_in_order(turns: DataFrame) -> DataFrame:
    """Turns dealt by (conversation, order), with the number of the part; a conversation
    spans neighbouring parts."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64)]
    return turns.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())


def running(rows: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """Running sums of the columns over each conversation, in place of the columns.

    A part's rows are summed where they are; what earlier parts hold comes from one row for
    each conversation and part."""
    within = Window.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "part").agg(*[F.sum(c).alias(c) for c in columns])
    before = sums.select("conv_id", "part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in columns])
    rows = rows.withColumns({c: F.sum(c).over(within) for c in columns}).join(before, ["conv_id", "part"])
    return rows.withColumns({c: F.col(c) + F.col(f"before_{c}") for c in columns}).drop(*[f"before_{c}" for c in columns])


def placed_turns(spark: SparkSession, conversations: DataFrame, path: str) -> DataFrame:
    """(conv_id, part, place, print, words): every original turn with its place from 1."""
    text = F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint"), "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text")
    )
    parts = parts_in_order(turns).withColumns({
        "print": F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256),
        "words": F.regexp_count("text", F.lit(WORDS)).cast("bigint"),
    })
    parts = stored(spark, parts, f"{path}/parts").withColumn("place", F.lit(1).cast("bigint"))
    placed = running(parts, ["place"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")])
    return stored(spark, placed.select("conv_id", "part", "place", "print", "words"), f"{path}/placed")


def rebuilt_turns(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, part, depth, print, words) of the rebuilt conversations, and all conversations
    with their number of turns."""
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("size")).withColumns({"base": F.expr(f"conv_id - conv_id % {GROUP}"), "h": heads()})
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    sizes = sizes.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_size", F.lit(0))))
    # At most GROUP conversations take the first HEADS - 1 turns of another.
    first = placed.where(F.col("place") < HEADS).where(f"conv_id % {GROUP} = 0")
    first = first.select(F.col("conv_id").alias("base"), "place", "print", "words")
    taken = sizes.join(first, "base").where("place <= taken").select("conv_id", F.lit(-1).alias("part"), F.col("place").alias("depth"), "print", "words")
    spans = placed.groupBy("conv_id", "part").agg(F.lit(1)).join(sizes.select("conv_id", "h", "taken"), "conv_id").select("conv_id", "part", "h", "taken")
    own = placed.join(spans, ["conv_id", "part"]).where("place > h")
    own = own.select("conv_id", "part", F.expr("place - h + taken").alias("depth"), "print", "words")
    lengths = sizes.select("conv_id", F.expr("taken + greatest(size - h, 0)").alias("length"))
    return taken.unionByName(own), lengths


def prefixes(rebuilt: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for each conversation and depth: the prefix's key, the last turn's marks, words
    and the conversation's length.  Depth 0 has the key of zeros."""
    sha = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "print"), 256)
    word = lambda i: F.conv(F.substring(sha, 8 * i + 1, 8), 16, 10).cast("bigint")
    marked = rebuilt.select("conv_id", "part", "depth", "words", *[word(i).alias(m) for i, m in enumerate(MARKS)])
    summed = running(marked.withColumns({s: F.col(m) for s, m in zip(SUMS, MARKS, strict=True)}), SUMS, [F.col("depth")])
    per_part = marked.groupBy("conv_id", "part").agg(F.lit(1)).join(lengths, "conv_id").select("conv_id", "part", "length")
    zero = F.lit(0).cast("bigint")
    roots = lengths.select("conv_id", zero.alias("depth"), zero.alias("words"), "length", *[zero.alias(c) for c in MARKS + SUMS])
    return summed.join(per_part, ["conv_id", "part"]).drop("part").unionByName(roots)


def node_table(members: DataFrame) -> DataFrame:
    """A row for each prefix, with its parent's key."""
    nodes = members.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("words").alias("words"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight"), *[F.first(m).alias(m) for m in MARKS],
    )
    return nodes.withColumns({f"p{i}": F.col(s) - F.col(m) for i, (s, m) in enumerate(zip(SUMS, MARKS, strict=True))}).drop(*MARKS)


def with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with ``parent_conv_id`` and ``n_children``."""
    key = ["parent_depth", "p0", "p1", "p2", "p3"]
    nodes = nodes.withColumn("parent_depth", F.col("depth") - 1)
    named = lambda df, *more: df.select(F.col("depth").alias("parent_depth"), *[F.col(s).alias(f"p{i}") for i, s in enumerate(SUMS)], *more)
    children = nodes.where("depth > 0").groupBy(*key).agg(F.count("*").alias("n_children"))
    children = children.select(F.col("parent_depth").alias("depth"), *[F.col(f"p{i}").alias(s) for i, s in enumerate(SUMS)], "n_children")
    owners = named(nodes, F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    return nodes.join(owners, key, "left").drop(*key)


# --- subtree totals -------------------------------------------------------------------------------


def local_totals(parents: list[int], values: list[tuple[int, int]]) -> list[list[int]]:
    """Subtree totals in a component whose nodes stand parents first (top: -1), by centroids."""
    children: list[list[int]] = [[] for _ in parents]
    for node, parent in enumerate(parents):
        if parent >= 0:
            children[parent].append(node)
    taken = [False] * len(parents)
    totals = [[0] * len(values[0]) for _ in parents]
    size = [0] * len(parents)

    def below(top: int) -> list[int]:
        found = [top]
        for node in found:
            found += [c for c in children[node] if not taken[c]]
        return found

    tops = [0] if parents else []
    while tops:
        top = tops.pop()
        nodes = below(top)
        for node in nodes:
            size[node] = 1
        for node in reversed(nodes[1:]):
            size[parents[node]] += size[node]
        centroid = top
        while True:
            heavy = next((c for c in children[centroid] if not taken[c] and 2 * size[c] >= size[top]), None)
            if heavy is None:
                break
            centroid = heavy
        total = [sum(values[n][i] for n in below(centroid)) for i in range(len(values[0]))]
        at = centroid
        while True:
            totals[at] = [a + b for a, b in zip(totals[at], total, strict=True)]
            if at == top:
                break
            at = parents[at]
        taken[centroid] = True
        tops += [c for c in children[centroid] if not taken[c]]
        if centroid != top:
            tops.append(top)
    return totals


LIGHT = "conv_id bigint, depth bigint, n_leaves bigint, saved_tokens bigint"


def finished(light: DataFrame) -> DataFrame:
    """Totals of components that fit a task, one component after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        component, rows = None, []

        def close() -> None:
            if rows:
                place = {(r["conv_id"], r["depth"]): i for i, r in enumerate(rows)}
                parents = [-1 if i == 0 else place[r["parent_conv_id"], r["depth"] - 1] for i, r in enumerate(rows)]
                totals = local_totals(parents, [(r["leaf"], r["saved"]) for r in rows])
                made.extend((r["conv_id"], r["depth"], r["got_leaves"] + a, r["got_saved"] + b) for r, (a, b) in zip(rows, totals, strict=True))
                rows.clear()

        def told() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in (zip(*made, strict=True) if made else ([], [], [], []))]
            made.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "depth", "n_leaves", "saved_tokens"])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["top_conv"], row["top_depth"]) != component:
                    close()
                    component = row["top_conv"], row["top_depth"]
                rows.append(row)
            if len(made) >= 10_000:
                yield told()
        close()
        yield told()

    dealt = light.repartition("top_conv", "top_depth").sortWithinPartitions("top_conv", "top_depth", "depth")
    return dealt.mapInArrow(run, LIGHT)


def subtree_totals(spark: SparkSession, nodes: DataFrame, members: DataFrame, path: str, weight: int) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) over each node's subtree."""
    zero = F.lit(0).cast("bigint")
    top = nodes.where("depth = 0").select(F.col("conv_id").alias("top_conv"))
    open_ = nodes.select(
        "conv_id", "depth", "parent_conv_id", "weight", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("leaf"),
        F.expr("(n_convs - 1) * words").alias("saved"), zero.alias("got_leaves"), zero.alias("got_saved"), zero.alias("top_depth"),
    ).crossJoin(F.broadcast(top))  # the root, one row
    path_nodes = None
    parts = []
    is_top = (F.col("conv_id") == F.col("top_conv")) & (F.col("depth") == F.col("top_depth"))
    component = ["top_conv", "top_depth"]
    for turn in range(10_000):
        heavy = open_.where(is_top & (F.col("weight") > weight)).select(*component, F.col("weight").alias("whole"))
        heavy = stored(spark, heavy, f"{path}/heavy-{turn}")
        n_heavy = heavy.count()
        if not n_heavy:
            parts.append(finished(open_))
            break
        if path_nodes is None:
            owner = nodes.select(*NODE, F.col("conv_id").alias("at_conv"), F.col("parent_conv_id").alias("at_parent"))
            owning = nodes.select("conv_id").distinct()
            path_nodes = members.select("conv_id", *NODE).join(owning, "conv_id", "left_semi").join(owner, NODE)
            path_nodes = stored(spark, path_nodes.select(F.col("conv_id").alias("of_conv"), F.col("depth").alias("at_depth"), "at_conv", "at_parent"), f"{path}/paths")
        size = n_heavy * 64
        light = common.join_sized(open_, heavy.select(*component, F.lit(True).alias("is_heavy")), component, "left", size).where("is_heavy IS NULL").drop("is_heavy")
        parts.append(finished(light))
        rows = common.join_sized(open_, heavy, component, "inner", size)
        centroid = F.max_by(F.struct("conv_id", "depth", "weight"), "depth").alias("c")
        centroids = stored(spark, rows.where("2 * weight >= whole").groupBy(*component).agg(centroid), f"{path}/centroids-{turn}")
        rows = common.join_sized(rows, centroids, component, "inner", size)
        # A node below the centroid looks up its ancestor just below it, any other node the
        # centroid's ancestor of its own depth.
        lower = F.col("depth") > F.col("c.depth")
        rows = rows.withColumns({"of_conv": F.when(lower, F.col("conv_id")).otherwise(F.col("c.conv_id")), "at_depth": F.when(lower, F.col("c.depth") + 1).otherwise(F.col("depth"))})
        rows = rows.join(path_nodes, ["of_conv", "at_depth"], "left")
        rows = rows.withColumns({
            "below": F.coalesce(lower & (F.col("at_parent") == F.col("c.conv_id")), F.lit(False)),
            "on_path": F.coalesce(~lower & (F.col("at_conv") == F.col("conv_id")), F.lit(False)),
            "is_centroid": (F.col("depth") == F.col("c.depth")) & (F.col("conv_id") == F.col("c.conv_id")),
        })
        rows = stored(spark, rows.drop("of_conv", "at_depth", "at_parent", "whole"), f"{path}/rows-{turn}")
        sums = rows.where("below OR is_centroid").groupBy(*component).agg(F.sum("leaf").alias("sum_leaves"), F.sum("saved").alias("sum_saved"))
        rows = common.join_sized(rows, stored(spark, sums, f"{path}/sums-{turn}"), component, "inner", size)
        add = lambda got, sum_: F.col(got) + F.when(F.col("on_path"), F.col(sum_)).otherwise(0)
        rows = rows.withColumns({
            "got_leaves": add("got_leaves", "sum_leaves"), "got_saved": add("got_saved", "sum_saved"),
            "weight": F.col("weight") - F.when(F.col("on_path"), F.col("c.weight")).otherwise(0),
        })
        parts.append(rows.where("is_centroid").select("conv_id", "depth", F.col("got_leaves").alias("n_leaves"), F.col("got_saved").alias("saved_tokens")))
        moved = rows.where("NOT is_centroid").withColumns({
            "top_depth": F.when(F.col("below"), F.col("c.depth") + 1).otherwise(F.col("top_depth")),
            "top_conv": F.when(F.col("below"), F.col("at_conv")).otherwise(F.col("top_conv")),
        })
        open_ = stored(spark, moved.select(*open_.columns), f"{path}/open-{turn}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- ends -----------------------------------------------------------------------------------------


def end_hashes(members: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at a node.  Ids are joined within spans of IDS, a bounded
    number since a conversation ends once; the pieces of a node are hashed as a stream."""
    ends = members.where("depth = length").withColumn("piece", F.floor(F.col("conv_id") / IDS))
    joined = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    pieces = ends.groupBy(*NODE, "piece").agg(joined.alias("ids"))
    pieces = pieces.select(*NODE, "piece", "ids").repartition(*NODE).sortWithinPartitions(*NODE, "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, made = None, None, []

        def told() -> pa.RecordBatch:
            columns = list(zip(*made, strict=True)) if made else [[]] * 6
            made.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string())], names=[*NODE, "ends_sha256"])

        for batch in batches:
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != node:
                    if node is not None:
                        made.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if made:
                yield told()
        if node is not None:
            made.append((*node, digest.hexdigest()))
        yield told()

    return pieces.mapInArrow(run, "depth bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint, ends_sha256 string")


NO_ENDS = hashlib.sha256(b"").hexdigest()


def trie(conversations: DataFrame, weight: int = COMPONENT_WEIGHT) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations (conv_id, turn, role, text)."""
    spark = conversations.sparkSession
    path = session.scratch(spark, "prefix-trie")
    rebuilt, lengths = rebuilt_turns(placed_turns(spark, conversations, path))
    members = stored(spark, prefixes(rebuilt, stored(spark, lengths, f"{path}/lengths")), f"{path}/members")
    nodes = stored(spark, with_parents(stored(spark, node_table(members), f"{path}/keys")), f"{path}/nodes")
    totals = subtree_totals(spark, nodes, members, path, weight)
    out = nodes.join(end_hashes(members), NODE, "left").join(totals, ["conv_id", "depth"])
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


# CRC-32 of an id's text, bit by bit, since this SQL has no such function.
CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
  lambda r, b: list_reduce(list_prepend(xor(r, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))"""

ORACLE = f"""
WITH ordered AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT c, xor({CRC}, 4294967295::BIGINT) % 4 AS h FROM (SELECT DISTINCT c FROM ordered)),
turns AS (
  SELECT heads.c, place, role, text FROM heads JOIN ordered o ON o.c = heads.c - heads.c % 20 AND o.place <= h
  UNION ALL SELECT heads.c, place, role, text FROM heads JOIN ordered o ON o.c = heads.c AND o.place > h),
paths AS (
  SELECT heads.c AS c, coalesce(list(struct_pack(role := role, text := text) ORDER BY place) FILTER (place IS NOT NULL), []) AS path
  FROM heads LEFT JOIN turns ON turns.c = heads.c GROUP BY heads.c),
members AS (SELECT c, path, unnest(range(len(path) + 1)) AS depth FROM paths),
nodes AS (
  SELECT depth, path[:depth] AS key, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(path) = depth), '')) AS ends_sha256,
         (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(any_value(path)[depth].text, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM members GROUP BY depth, key),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.key[:n.depth] = n.key) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND n.key[:p.depth] = p.key)
SELECT t.conv_id, t.depth, t.parent_conv_id, t.n_convs, t.n_children,
       CAST(count(*) FILTER (u.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(u.saved) AS BIGINT) AS saved_tokens, t.ends_sha256
FROM linked t JOIN linked u ON u.depth >= t.depth AND u.key[:t.depth] = t.key
GROUP BY t.conv_id, t.depth, t.parent_conv_id, t.n_convs, t.n_children, t.ends_sha256"""
