"""The trie of conversation prefixes: which turns conversations share from their beginning, and what that saves.

A turn is known by the digest of its role and text; with its place it gives a 128-bit number, and a prefix's number is the
exclusive or of its turns'. Conversations become rows of eight turns, keyed by the number of what went before, so that one
ROLLUP over the eight columns aggregates every prefix of every block together: a node of depth d is the block d lies in, with
the columns after it rolled up. Sums over a subtree are sums over a node's members, so nothing walks up the trie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.manifest import CRC32_SQL
from quire.llm.ranking import ranked
from quire.plans.storage import materialize

WIDTH = 8
#: Blocks whose numbers one window sums up, and conversation ids that one text of a list holds.
RUN = 4096
_TURNS = [f"t{i}" for i in range(WIDTH)]


def turn_digest() -> Column:
    """The digest of role and text, null as empty; the role's length keeps the two apart."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, p, digest, n): turns from 0 in order of turn, null first, equal ones by digest; n is the text's bytes.

    Rows without a conv_id are left out.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", turn_digest().alias("digest"), size.alias("n"))
    return ranked(materialize(rows, "turns"), "conv_id", ["turn", "digest"], "turns").select("conv_id", F.col("rank").alias("p"), "digest", "n")


def with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c rebuilt: the first h turns of conversation c - c % 5, then its own after its first h; h = crc32(c) % 9.

    The remainder has the sign of c.

    Returns (conv_id, p, digest, n) and (conv_id): one that gets no turns is only in the second.
    """
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("long")
    convs = lengths.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_length", F.lit(0))))
    first = turns.where("p < 8").withColumnRenamed("conv_id", "base")
    heads = convs.join(first, "base").where("p < h").select("conv_id", "p", "digest", "n")
    tails = turns.join(convs, "conv_id").where("p >= h").select("conv_id", (F.col("p") - F.col("h") + F.col("taken")).alias("p"), "digest", "n")
    return heads.unionByName(tails), convs.select("conv_id")


def turn_blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, block, a, b, bytes, length, t0..t7): eight turns a row, with the number and bytes of all turns before them.

    length: the conversation's turns. A conversation without turns has one row of nulls. Numbers are summed up in runs of
    blocks and then over runs, so a conversation of any length is dealt out.
    """
    number = {"a": F.xxhash64(F.lit(1), "p", "digest"), "b": F.xxhash64(F.lit(2), "p", "digest")}
    turns = turns.withColumns(number)
    block = F.floor(F.col("p") / WIDTH)
    turn = F.struct("p", "a", "b", "n")
    rows = turns.groupBy("conv_id", block.alias("block")).agg(
        F.array_sort(F.collect_list(turn)).alias("turns"), F.bit_xor("a").alias("own_a"), F.bit_xor("b").alias("own_b"), F.sum("n").alias("own_n")
    )
    run = F.floor(F.col("block") / RUN).alias("run")
    runs = rows.groupBy("conv_id", run).agg(
        F.bit_xor("own_a").alias("run_a"), F.bit_xor("own_b").alias("run_b"), F.sum("own_n").alias("run_n"), F.sum(F.size("turns")).alias("run_length")
    )
    zero = F.lit(0).cast("long")
    every = Window.partitionBy("conv_id")
    earlier = every.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "conv_id", "run", F.sum("run_length").over(every).alias("length"), F.sum("run_n").over(every).alias("total"),
        *[F.coalesce(f(f"run_{c}").over(earlier), zero).alias(f"run_{c}") for c, f in (("a", F.bit_xor), ("b", F.bit_xor), ("n", F.sum))],
    )
    within = Window.partitionBy("conv_id", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("run", run).join(runs, ["conv_id", "run"])
    before = {c: F.coalesce(f(f"own_{c}").over(within), zero) for c, f in (("a", F.bit_xor), ("b", F.bit_xor), ("n", F.sum))}
    rows = rows.select(
        "conv_id", "block",
        before["a"].bitwiseXOR(F.col("run_a")).alias("a"), before["b"].bitwiseXOR(F.col("run_b")).alias("b"),
        (before["n"] + F.col("run_n")).alias("bytes"), "length", "total",
        *[F.get("turns", F.lit(i)).dropFields("p").alias(t) for i, t in enumerate(_TURNS)],
    )
    none = convs.join(rows.where("block = 0").select("conv_id"), "conv_id", "left_anti")
    return rows.unionByName(
        none.select("conv_id", *[zero.alias(c) for c in ("block", "a", "b", "bytes", "length", "total")], *[F.lit(None).cast(rows.schema[t].dataType).alias(t) for t in _TURNS])
    )


def _rolled_up(blocks: DataFrame, **sums: str) -> DataFrame:
    """A row for each prefix: depth, a and b (its number), up_a and up_b (its parent's), n (bytes of its last text), upto (bytes before that), and sums."""
    asked = ", ".join(f"{e} AS {k}" for k, e in sums.items())
    rows = blocks.sparkSession.sql(
        f"SELECT block, a AS key_a, b AS key_b, bytes, {', '.join(_TURNS)}, grouping_id() AS g, {asked} "
        f"FROM {{blocks}} GROUP BY block, a, b, bytes, ROLLUP ({', '.join(_TURNS)})",
        blocks=blocks,
    )
    level = F.lit(WIDTH) - F.bit_count("g")  # columns that are not rolled up
    rows = rows.withColumn("level", level)
    last = F.get(F.array(*_TURNS), F.col("level") - 1)
    # a prefix ends at a turn; the empty one is that of the first block
    rows = rows.where((F.col("level") == 0) & (F.col("block") == 0) | (F.col("level") > 0) & last.isNotNull())
    number = {k: F.col(f"key_{k}") for k in "ab"}
    size = F.col("bytes")
    for t in _TURNS:
        number = {k: v.bitwiseXOR(F.coalesce(F.col(f"{t}.{k}"), F.lit(0).cast("long"))) for k, v in number.items()}
        size = size + F.coalesce(F.col(f"{t}.n"), F.lit(0))
    rows = rows.withColumn("last", F.when(F.col("level") > 0, last)).withColumn("n", F.coalesce("last.n", F.lit(0)))
    return rows.select(
        (F.col("block") * WIDTH + F.col("level")).alias("depth"), number["a"].alias("a"), number["b"].alias("b"),
        number["a"].bitwiseXOR(F.col("last.a")).alias("up_a"), number["b"].bitwiseXOR(F.col("last.b")).alias("up_b"),
        "n", (size - F.col("n")).alias("upto"), *sums,
    )


def _listed(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256): the digest of the ids of ends (depth, a, b, conv_id), ascending and comma-joined.

    Ids are joined in texts of RUN; the few nodes with more than one text are hashed as a stream, text by text.
    """
    key = F.concat_ws(":", "depth", F.hex("a"), F.hex("b"))
    placed = ranked(materialize(ends.withColumn("key", key), "ends"), "key", ["conv_id"], "ends")
    part = F.floor(F.col("rank") / RUN).alias("part")
    texts = placed.groupBy("depth", "a", "b", part).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    texts = materialize(texts, "ends")
    many = texts.where("part = 1").select("depth", "a", "b")
    one = texts.join(many, ["depth", "a", "b"], "left_anti").select("depth", "a", "b", F.sha2("ids", 256).alias("ends_sha256"))
    long = texts.join(many, ["depth", "a", "b"], "left_semi").repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "part")
    return one.unionByName(long.mapInArrow(_streamed, one.schema))


def _streamed(batches):
    """Digests of consecutive texts of one node; a node's state is the hash alone."""
    import hashlib

    import pyarrow as pa

    def told(node, state):
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], names=["depth", "a", "b", "ends_sha256"])

    node, state = None, None
    for batch in batches:
        for depth, a, b, _, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if (depth, a, b) != node:
                if node is not None:
                    yield told(node, state)
                node, state = (depth, a, b), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if node is not None:
        yield told(node, state)


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of turns (conv_id, p, digest, n): every different sequence of first turns of conversations.

    convs names all conversations, turnless ones too. Columns: conv_id (the smallest member), depth, parent_conv_id (its parent's conv_id,
    null at the root), n_convs, n_children, n_leaves, saved_tokens (bytes of texts that need not be read again in its subtree) and
    ends_sha256 (of the members that end here). Without conversations there is no node. Sequences are compared by 128-bit numbers.
    """
    blocks = materialize(turn_blocks(turns, convs), "blocks")
    last_block = F.col("block") == F.greatest(F.ceil(F.col("length") / WIDTH) - 1, F.lit(0))
    first = _rolled_up(blocks, n_convs="count(1)", conv_id="min(conv_id)", longest="max(length)")
    first = materialize(first, "nodes")
    leaf = F.col("longest") == F.col("depth")  # no member goes on
    owned = first.groupBy("conv_id").agg(F.sum("n").alias("owned"), F.max(leaf.cast("long")).alias("ends_leaf"))
    zero = F.lit(0).cast("long")
    known = blocks.join(owned, "conv_id", "left").withColumns({"owned": F.coalesce("owned", zero), "ends_leaf": F.coalesce("ends_leaf", zero)})
    # over a subtree: members' bytes from here on, less those of each different text once, which its smallest member owns
    sums = _rolled_up(
        known, n_convs="count(1)", conv_id="min(conv_id)", n_leaves="sum(ends_leaf)", total="sum(total)", once="sum(owned)", kept="min_by(total - owned, conv_id)"
    )
    saved = F.col("total") - F.col("once") - (F.col("n_convs") - 1) * F.col("upto") - F.col("kept")
    nodes = sums.withColumn("saved_tokens", saved)
    children = first.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    ends = blocks.where(last_block)
    mark = {k: F.col(k) for k in "ab"}
    for t in _TURNS:
        mark = {k: v.bitwiseXOR(F.coalesce(F.col(f"{t}.{k}"), zero)) for k, v in mark.items()}
    listed = _listed(ends.select(F.col("length").alias("depth"), mark["a"].alias("a"), mark["b"].alias("b"), "conv_id"))
    # below the first node that a conversation owns, it owns the parent too: one node a conversation looks its parent up
    top = first.where("depth > 0").groupBy("conv_id").agg(F.min_by(F.struct("depth", "up_a", "up_b"), "depth").alias("top")).select("conv_id", "top.*")
    above = first.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("above"))
    parents = top.join(above, ["depth", "up_a", "up_b"]).select("conv_id", "depth", "above")
    key = ["depth", "a", "b"]
    joined = nodes.join(children, key, "left").join(listed, key, "left").join(parents, ["conv_id", "depth"], "left")
    return joined.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")).alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the head of the first of its five (with_shared_heads).

    Null roles and texts are empty, null turns come first, turns of one number go by the digest of role and text, repeated rows are
    turns of their own, rows without a conv_id are left out; an empty table gives no rows.
    """
    turns = materialize(numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    return prefix_trie(*with_shared_heads(turns))


OP13_SQL = f"""WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS p
    FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, {CRC32_SQL.format(x="conv_id")} % 9 AS h FROM o),
k AS (SELECT c.*, least(h, coalesce(n, 0)) AS taken FROM c LEFT JOIN (SELECT conv_id, count(*) AS n FROM o GROUP BY 1) l ON base = l.conv_id),
r AS MATERIALIZED (SELECT k.conv_id, p + 1 AS depth, role, text FROM k JOIN o ON o.conv_id = base AND p < h
    UNION ALL SELECT conv_id, p - h + taken + 1, role, text FROM k JOIN o USING (conv_id) WHERE p >= h),
path AS MATERIALIZED (SELECT conv_id, depth, strlen(text) AS n, string_agg(sha256(strlen(role)::VARCHAR || ':' || role || text), '')
    OVER (PARTITION BY conv_id ORDER BY depth) AS seq FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
len AS (SELECT conv_id, max(depth) AS length FROM path GROUP BY 1),
node AS MATERIALIZED (SELECT min(conv_id) AS conv_id, depth, seq, any_value(n) AS n, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256, max(length) = depth AS leaf
    FROM path JOIN len USING (conv_id) GROUP BY depth, seq),
sub AS (SELECT path.depth, path.seq, sum((n_convs - 1) * node.n)::BIGINT AS saved_tokens, count(*) FILTER (leaf) AS n_leaves
    FROM node JOIN path ON path.conv_id = node.conv_id AND path.depth <= node.depth GROUP BY 1, 2),
kids AS (SELECT depth - 1 AS depth, left(seq, 64 * (depth - 1)) AS seq, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1, 2)
SELECT node.conv_id, node.depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, node.ends_sha256
FROM node JOIN sub USING (depth, seq) LEFT JOIN kids USING (depth, seq)
LEFT JOIN node up ON up.depth = node.depth - 1 AND up.seq = left(node.seq, 64 * (node.depth - 1))"""
