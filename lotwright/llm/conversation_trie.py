"""A prefix trie of conversations, built as a Patricia tree: compressed edges, aggregates on them, unary nodes expanded at the end.

Prefixes are known by two 64-bit running hashes of their turns (a turn's hash has its place in it), so no conversation
has to fit a cell. Sorting the prefixes by those keys brings the members of a node together. Nodes with the same smallest
member and as many members have the same members, so they are one edge, whose lowest node is a branch, an end or a leaf.
Sums over subtrees are taken on edges by pointer doubling: after k rounds an edge has the sums of what lies less than 2**k
edges below it. Nodes within an edge follow from sums of words along it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwright.operators.sequences import blocks, running

from .common import small_batches, table, written

#: Ids that one cell of ``_endings`` may hold.
IDS = 4096
NODE = ["depth", "k1", "k2"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), a, b (hashes of role and text) and words of every turn, ordered by turn (null first), role and text.

    Null roles and texts are empty; repeated rows are turns of their own; rows without conv_id are left out. Positions
    come from one range partitioning of the whole table, so a conversation may be of any length.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = written(rows.select("conv_id", "place", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"), words.alias("words")), "turns")
    part = F.shiftright("place", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    start = F.sum("size").over(Window.orderBy("part")) - F.col("size")  # one row for each range
    rows = rows.withColumn("part", part).join(F.broadcast(sizes.select("part", start.alias("start"))), "part")
    rows = rows.withColumn("n", F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
    first = rows.groupBy(F.col("conv_id").alias("c")).agg(F.min("n").alias("first"))
    return rows.join(first, F.col("conv_id") == F.col("c")).select("conv_id", (F.col("n") - F.col("first")).alias("pos"), "a", "b", "words")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, size) of every rebuilt conversation, and their turns: conv_id, size, depth (from 1), a, b, words.

    The first h turns of conversation c - c % 20, then c's own after its first h; h is crc32 of c's digits, modulo 4.
    """
    own = rows.groupBy("conv_id").agg(F.count("*").alias("own"))
    own = own.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).withColumn("base", F.col("conv_id") - F.col("conv_id") % 20)
    there = own.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    own = own.join(there, "base", "left").withColumn("taken", F.least("h", F.coalesce("of_base", F.lit(0))))
    own = written(own.withColumn("size", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "rebuilt")
    heads = rows.where("pos < 3").withColumnRenamed("conv_id", "base").join(own.select("base", "conv_id", "h", "size"), "base").where("pos < h")
    tails = rows.join(own.select("conv_id", "h", "taken", "size"), "conv_id").where("pos >= h")
    turn = lambda df, depth: df.select("conv_id", "size", depth.cast("long").alias("depth"), "a", "b", "words")  # noqa: E731
    return own.select("conv_id", "size"), turn(heads, F.col("pos") + 1).union(turn(tails, F.col("pos") - F.col("h") + F.col("taken") + 1))


def keyed(rows: DataFrame) -> DataFrame:
    """conv_id, size, depth, words, the key (k1, k2) of the prefix that ends with the turn, and that of the one before (p1, p2).

    Running within pieces of 65,536 turns, whose own hashes are then carried on, so a long conversation is many tasks.
    """
    rows = rows.select("conv_id", "size", "depth", "words", blocks("depth").alias("piece"), F.xxhash64("depth", "a", "b").alias("x1"), F.xxhash64(F.lit(2), "b", "a", "depth").alias("x2"))
    rows = written(rows, "prefixes")
    upto = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy("conv_id", "piece").agg(F.bit_xor("x1").alias("y1"), F.bit_xor("x2").alias("y2"))
    pieces = pieces.select("conv_id", "piece", F.bit_xor("y1").over(before).alias("c1"), F.bit_xor("y2").over(before).alias("c2")).where("piece > 0")
    rows = rows.withColumns({"k1": F.bit_xor("x1").over(upto), "k2": F.bit_xor("x2").over(upto)}).join(pieces, ["conv_id", "piece"], "left")
    whole = lambda k, c: F.col(k).bitwiseXOR(F.coalesce(F.col(c), F.lit(0)))  # noqa: E731
    rows = rows.withColumns({"k1": whole("k1", "c1"), "k2": whole("k2", "c2")})
    return rows.select("conv_id", "size", "depth", "words", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"))


def _endings(ends: DataFrame) -> DataFrame:
    """NODE and ends_sha256: the digest of the node's conv_ids, ascending and comma-joined, for rows NODE, conv_id.

    Up to IDS neighbouring ids become one text in parallel; a node's texts then go through its digest in order. A digest
    is sequential by its nature, so a node's texts meet in one task, which holds one of them at a time.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    texts = ends.groupBy(*NODE, F.floor(F.col("conv_id") / IDS).alias("chunk")).agg(ids.alias("ids"))
    texts = texts.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for *node, own in zip(*(c.to_pylist() for c in batch.columns)):
                if node == last:
                    digest.update(b",")
                else:
                    if digest:
                        done.append((*last, digest.hexdigest()))
                    last, digest = node, hashlib.sha256()
                digest.update(own.encode())
            yield _rows(done)
        if digest:
            yield _rows([(*last, digest.hexdigest())])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()])], [*NODE, "ends_sha256"])

    with small_batches(ends.sparkSession):
        return written(texts.mapInArrow(work, "depth long, k1 long, k2 long, ends_sha256 string"), "endings")


def _same(names: list[str], others: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(names, others):
        out = out & (F.col(a) == F.col(b))
    return out


def _edges(nodes: DataFrame) -> DataFrame:
    """owner, n_convs, top, bottom, words, up_owner, up_n (the edge above; null at the root), n_children of the lowest node, saved, leaves (its own)."""
    edges = nodes.groupBy("owner", "n_convs").agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum("words").alias("words"),
        F.max_by(F.struct("k1", "k2"), "depth").alias("k"), F.min_by(F.struct("p1", "p2"), "depth").alias("p"),
    )  # fmt: skip
    edges = written(edges.select("owner", "n_convs", "top", "bottom", "words", "k.*", "p.*"), "edges")
    points = edges.select(F.col("owner").alias("up_owner"), F.col("n_convs").alias("up_n"), (F.col("bottom") + 1).alias("below"), F.col("k1").alias("q1"), F.col("k2").alias("q2"))
    edges = edges.join(points, _same(["top", "p1", "p2"], ["below", "q1", "q2"]), "left")
    edges = written(edges.select("owner", "n_convs", "top", "bottom", "words", "up_owner", "up_n"), "linked")
    children = edges.where("up_n IS NOT NULL").groupBy(F.col("up_owner").alias("owner"), F.col("up_n").alias("n_convs")).agg(F.count("*").alias("n_children"))
    edges = edges.join(children, ["owner", "n_convs"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return edges.withColumns({"saved": (F.col("n_convs") - 1) * F.col("words"), "leaves": (F.col("n_children") == 0).cast("long")})


def summed(edges: DataFrame) -> DataFrame:
    """owner, n_convs, saved and leaves over whole subtrees, for edges with their own. Rounds: the logarithm of the tree's height in edges."""
    state = written(edges.select("owner", "n_convs", F.col("up_owner").alias("to_owner"), F.col("up_n").alias("to_n"), "saved", "leaves"), "sums")
    while not state.where("to_n IS NOT NULL").isEmpty():
        moving = state.where("to_n IS NOT NULL")
        more = moving.groupBy(F.col("to_owner").alias("owner"), F.col("to_n").alias("n_convs")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        further = state.where("to_n IS NOT NULL").select(F.col("owner").alias("via_owner"), F.col("n_convs").alias("via_n"), F.col("to_owner").alias("next_owner"), F.col("to_n").alias("next_n"))
        state = state.join(more, ["owner", "n_convs"], "left").join(further, _same(["to_owner", "to_n"], ["via_owner", "via_n"]), "left")
        plus = lambda own, other: (F.col(own) + F.coalesce(F.col(other), F.lit(0))).alias(own)  # noqa: E731
        state = written(state.select("owner", "n_convs", F.col("next_owner").alias("to_owner"), F.col("next_n").alias("to_n"), plus("saved", "more_saved"), plus("leaves", "more_leaves")), "sums")
    return state.select("owner", "n_convs", "saved", "leaves")


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct beginning of the rebuilt conversations, the empty one of all of them included.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Nulls, ties and repeated rows are as in ``turns``; conversations that are rebuilt without a turn end at the root. An
    empty table has no root; other columns are ignored. Prefixes are equal if their lengths and 128 bits of hashes are.
    """
    sizes, rows = rebuilt(written(turns(conversations), "placed"))
    rows = written(keyed(rows), "keyed")
    node = lambda keys: [F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), *keys]  # noqa: E731
    nodes = rows.groupBy(*NODE).agg(*node([F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2")]))
    zero = lambda name: F.lit(0).cast("long").alias(name)  # noqa: E731
    root = sizes.agg(*node([])).where("n_convs > 0").select(*(zero(k) for k in NODE), "n_convs", "owner", *(zero(k) for k in ("words", "p1", "p2")))
    nodes = written(nodes.select(*NODE, "n_convs", "owner", "words", "p1", "p2").union(root), "nodes")
    ends = rows.where("depth = size").select(*NODE, "conv_id").union(sizes.where("size = 0").select(*(zero(k) for k in NODE), "conv_id"))
    ends = _endings(ends)
    edges = written(_edges(nodes), "edges")
    totals = summed(edges).withColumnRenamed("saved", "total")
    lines = edges.select("owner", "n_convs", "top", "bottom", F.col("words").alias("edge_words"), "up_owner", "n_children").join(totals, ["owner", "n_convs"])
    nodes = running(nodes.select(*NODE, "owner", "n_convs", "words"), ["owner", "n_convs"], ["depth"], "sum", F.col("words"), "above", blocks("depth"), before=True)
    out = nodes.join(lines, ["owner", "n_convs"]).join(ends, NODE, "left")
    suffix = F.col("edge_words") - F.col("above")  # words from this node to the edge's end
    return out.select(
        F.col("owner").alias("conv_id"), "depth",
        F.when(F.col("depth") > F.col("top"), F.col("owner")).otherwise(F.col("up_owner")).alias("parent_conv_id"),
        "n_convs",
        F.when(F.col("depth") < F.col("bottom"), F.lit(1)).otherwise(F.col("n_children")).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("total") - (F.col("n_convs") - 1) * (F.col("edge_words") - suffix)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )  # fmt: skip


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all ``conversations``."""
    return trie(table(spark, sf_dir, "conversations"))


#: crc32 of the digits of conv_id, modulo 4: shifts of one bit at a time over the bytes.
_H_SQL = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda y, i: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 4"""

#: The same rows by SQL, from all beginnings as lists.
OP13_SQL = rf"""
WITH m AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {_H_SQL} AS h FROM (SELECT DISTINCT conv_id FROM m)
), r AS (
  SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN m ON m.conv_id = c.base WHERE pos < h
  UNION ALL SELECT conv_id, 1, pos, role, text FROM c JOIN m USING (conv_id) WHERE pos >= h
), s AS (
  SELECT c.conv_id, coalesce(list(struct_pack(role := role, text := text) ORDER BY part, pos) FILTER (WHERE role IS NOT NULL), []) AS seq FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id
), n AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(seq) = d) AS ends
  FROM (SELECT conv_id, seq, d, list_slice(seq, 1, d) AS p FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM s)) GROUP BY p, d
), k AS (
  SELECT n.p, n.d, n.conv_id, n.n_convs, n.ends, u.conv_id AS parent, count(b.d) AS n_children, len(regexp_extract_all(n.p[n.d].text, '[^ 	-]+')) AS words
  FROM n LEFT JOIN n u ON u.d = n.d - 1 AND u.p = list_slice(n.p, 1, n.d - 1) LEFT JOIN n b ON b.d = n.d + 1 AND list_slice(b.p, 1, n.d) = n.p
  GROUP BY ALL
)
SELECT a.conv_id, a.d AS depth, a.parent AS parent_conv_id, a.n_convs, a.n_children, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves,
       CAST(sum((b.n_convs - 1) * coalesce(b.words, 0)) AS BIGINT) AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
FROM k a JOIN k b ON b.d >= a.d AND list_slice(b.p, 1, a.d) = a.p
GROUP BY a.p, a.conv_id, a.d, a.parent, a.n_convs, a.n_children, a.ends
"""
