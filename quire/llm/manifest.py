"""Merkle manifest of a dataset: a tree for each source, one over the sources, and a proof for every document.

Leaves of a source are cut into aligned blocks of 3^height; a block's tree and the proofs in it are made where the
block is. Above the blocks a butterfly runs: in round r the three blocks whose numbers differ in digit r (base 3)
swap the roots of their groups, and each hashes the parent for itself. After the last round every block holds the
source's root and its own upper proof; nothing is passed down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.ranking import ranked
from quire.plans.storage import materialize

FANOUT = 3
#: Levels of a tree that one block holds: 729 leaves.
HEIGHT = 6
_POWERS = [FANOUT**i for i in range(39)]


def record(*values: Column) -> Column:
    """The digest of values: each `-` if null, else its bytes' count, a colon and itself."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(text: Column) -> Column:
    """A document's leaf, with text as its text."""
    return record(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)


def levels_over(n: Column) -> Column:
    """Levels of hashing that bring n nodes to one."""
    return F.size(F.filter(F.array(*[F.lit(p) for p in _POWERS]), lambda p: p < n))


def _block_levels(leaves: Column, up: Column, height: int) -> Column:
    """The nodes of a block level by level: leaves, then up levels of hashed runs of three."""

    def above(below: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / FANOUT).cast("int"))
        return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(below, i * FANOUT + 1, FANOUT), ""), 256))

    steps = F.slice(F.array(*[F.lit(i) for i in range(height)]), F.lit(1), up)
    return F.aggregate(steps, F.array(leaves), lambda done, _: F.concat(done, F.array(above(F.element_at(done, -1)))))


def _siblings(levels: Column, i: Column, up: Column, height: int) -> Column:
    """For leaf i of a block: what stands before and after its node in each run of three, up levels of it."""

    def step(level: int) -> Column:
        nodes = F.element_at(levels, level + 1)
        own = F.floor(i / _POWERS[level]).cast("int")
        nth = own % FANOUT
        return F.struct(
            F.array_join(F.slice(nodes, own - nth + 1, nth), "").alias("before"),
            F.array_join(F.slice(nodes, own + 2, FANOUT - 1 - nth), "").alias("after"),
        )

    # a level is looked at only where the block has it
    return F.array_compact(F.array(*[F.when(F.lit(level) < up, step(level)) for level in range(height)]))


def _butterfly(blocks: DataFrame) -> DataFrame:
    """(key, block, root, above): every block's proof over blocks, and its group's root.

    blocks: (key, block, n_blocks, node), numbered from 0. Numbers up to a power of three are filled with empty blocks,
    two at most for each block, so that in every round each block sends its node to three and gets three: no block
    answers for a ragged edge. Rounds are as many as the largest group needs, one more for three times the blocks.
    """
    rounds = levels_over(F.col("n_blocks"))
    full = F.element_at(F.array(*[F.lit(p) for p in _POWERS]), F.col("rounds") + 1)
    own, more = F.col("block"), F.col("n_blocks") + 2 * F.col("block")
    filled = F.concat(F.array(own), F.filter(F.array(more, more + 1), lambda b: b < F.col("full")))
    state = (
        blocks.withColumn("rounds", rounds).withColumn("full", full)
        .select("key", "n_blocks", "rounds", own.alias("real"), F.explode(filled).alias("block"), "node")
        .select("key", "n_blocks", "rounds", "block", F.when(F.col("block") == F.col("real"), F.col("node")).alias("node"),
                F.array().cast("array<struct<before:string,after:string>>").alias("above"))
    )
    most = blocks.agg(F.max(rounds)).first()[0] or 0
    for r in range(most):
        digit = (F.floor(F.col("block") / _POWERS[r]) % FANOUT).cast("int")
        going = F.col("rounds") > r
        partners = F.array(*[F.col("block") + (d - F.col("digit")) * _POWERS[r] for d in range(FANOUT)])
        sent = state.withColumn("digit", digit).select(
            "key", "n_blocks", "rounds", "digit", "node", "above", F.col("block").alias("sender"),
            F.explode(F.when(going, partners).otherwise(F.array("block"))).alias("block"),
        )
        got = sent.groupBy("key", "n_blocks", "rounds", "block").agg(
            *[F.max(F.when(F.col("digit") == d, F.col("node"))).alias(f"node{d}") for d in range(FANOUT)],
            F.first(F.when(F.col("sender") == F.col("block"), F.col("above")), ignorenulls=True).alias("above"),
        )
        got = got.withColumn("digit", digit)
        nodes = [F.coalesce(f"node{d}", F.lit("")) for d in range(FANOUT)]
        none = F.lit("")
        before = F.concat(*[F.when(F.lit(d) < F.col("digit"), nodes[d]).otherwise(none) for d in range(FANOUT)])
        after = F.concat(*[F.when(F.lit(d) > F.col("digit"), nodes[d]).otherwise(none) for d in range(FANOUT)])
        together = F.concat(*nodes)
        state = got.select(
            "key", "n_blocks", "rounds", "block",
            F.when(going, F.when(together != "", F.sha2(together, 256))).otherwise(F.nullif(together, none)).alias("node"),
            F.when(going, F.array_append("above", F.struct(before.alias("before"), after.alias("after")))).otherwise(F.col("above")).alias("above"),
        )
    return state.where("block < n_blocks").select("key", "block", F.col("node").alias("root"), "above")


def proofs_in_groups(items: DataFrame, order: list[str], more: list[str], name: str, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """The members of each group key of items, block by block, with their proofs, and the blocks' own proofs.

    items: (key, leaf, ...), read twice; key is not null. Leaves are taken by order, nulls first, then by digest. A proof
    is a list of (before, after), from the leaf's level up: a node's parent is the digest of before, node and after. Returns
    (key, block, rows), each row with the columns more, leaf and its proof in the block, and (key, block, root, above). Only
    the second, one thin row for 3^height leaves, is ever joined by key.
    """
    size = FANOUT**height
    placed = ranked(items, "key", [*order, "leaf"], name)
    block = F.floor(F.col("rank") / size)
    blocks = placed.groupBy("key", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("rank", "leaf", *more))).alias("rows"))
    # a first block that is not full is the only one; a full one has all its levels in either case
    up = F.when(F.col("block") == 0, levels_over(F.size("rows"))).otherwise(height)
    levels = materialize(blocks, name).withColumn("up", up).withColumn("levels", _block_levels(F.col("rows.leaf"), F.col("up"), height))
    proven = F.transform(
        "rows",
        lambda x, i: F.struct(*[x[c].alias(c) for c in more], x["leaf"].alias("leaf"), _siblings(F.col("levels"), i, F.col("up"), height).alias("proof")),
    )
    held = materialize(levels.select("key", "block", F.element_at(F.element_at("levels", -1), 1).alias("node"), proven.alias("rows")), name)
    nodes = held.select("key", "block", "node")
    sizes = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n_blocks"))
    return held.select("key", "block", "rows"), _butterfly(nodes.join(sizes, "key"))


def manifest(docs: DataFrame, *more: Column, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof) and more: every document's place in the manifest of docs.

    Digests are SHA-256 in lowercase hex; proof is a list of (before, after) up to the root. Null doc_ids come first, nulls of
    the other columns are marked in the leaf, sources are ordered null first and then by bytes. Repeated rows are leaves of
    their own, next to each other, each with its own proof. An empty table gives no rows. Columns of docs other than
    doc_id, source, lang, n_chars and text take no part.
    """
    names = [f"_more{i}" for i in range(len(more))]
    key = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), "source"))
    leaves = docs.select("doc_id", key.alias("key"), leaf_digest(F.col("text")).alias("leaf"), *[c.alias(n) for c, n in zip(more, names, strict=True)])
    members, blocks = proofs_in_groups(materialize(leaves, "leaves"), ["doc_id"], ["doc_id", *names], "leaves", height)
    blocks = materialize(blocks, "subtrees")
    tops = blocks.where("block = 0").select(F.lit("").alias("key"), F.col("key").alias("source_key"), F.col("root").alias("leaf"))
    sources, above = proofs_in_groups(tops, ["source_key"], ["source_key"], "sources", height)
    above = sources.join(above, ["key", "block"]).select("root", "above", F.explode("rows").alias("row")).select(
        F.col("row.source_key").alias("key"), F.col("row.leaf").alias("subroot"), F.col("root").alias("top"), F.concat("row.proof", "above").alias("rest")
    )
    whole = blocks.join(above, "key").select("key", "block", "subroot", F.col("top").alias("root"), F.concat("above", "rest").alias("rest"))
    joined = members.join(whole, ["key", "block"]).select("subroot", "root", "rest", F.explode("rows").alias("row"))
    return joined.select("row.doc_id", "row.leaf", "subroot", "root", F.concat("row.proof", "rest").alias("proof"), *[f"row.{n}" for n in names])


def fold(leaf: Column, proof: Column) -> Column:
    """The root that leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda node, p: F.sha2(F.concat(p["before"], node, p["after"]), 256))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document, checked for a text whose line feeds are gone where crc32(doc_id) is even.

    A null doc_id is not tampered with; otherwise as manifest says.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    claimed = F.when(even, leaf_digest(F.translate("text", "\n", "")))
    rows = manifest(docs, claimed)
    folded = fold(F.coalesce("_more0", "leaf"), F.col("proof"))
    siblings = F.array_join(F.transform("proof", lambda p: F.concat(p["before"], p["after"])), "")
    told = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Unsigned CRC-32 of the decimal text x, bit by bit.
CRC32_SQL = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({x}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))))"""


def _sql_tree(name: str, levels: int) -> str:
    """CTEs from {name}n0 (grp, pos, h), the nodes, and {name}p0 (id, grp, pos, x, proof), the paths, to {name}s_ (id, grp, x, proof, top)."""
    out = []
    for i in range(levels):
        run = "PARTITION BY grp, pos // 3 ORDER BY pos ROWS BETWEEN"
        out.append(f"""{name}w{i} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY grp) AS n,
            coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
            coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name}n{i}),
        {name}p{i + 1} AS MATERIALIZED (SELECT id, p.grp, p.pos // 3 AS pos, CASE WHEN n > 1 THEN sha256(before || x || after) ELSE x END AS x,
            CASE WHEN n > 1 THEN proof || before || after ELSE proof END AS proof FROM {name}p{i} p JOIN {name}w{i} w ON p.grp = w.grp AND p.pos = w.pos),
        {name}n{i + 1} AS MATERIALIZED (SELECT grp, pos // 3 AS pos, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE min(h) END AS h
            FROM {name}w{i} GROUP BY grp, pos // 3)""")
    out.append(f"{name}s_ AS MATERIALIZED (SELECT id, p.grp, x, proof, h AS top FROM {name}p{levels} p JOIN {name}n{levels} n ON p.grp = n.grp)")
    return ",\n".join(out)


def _sql_record(*values: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')" for v in values) + ")"


#: Up to 3^12 documents a source and 3^6 sources.
OP11_SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS grp,
    {_sql_record("doc_id", "source", "lang", "n_chars", "text")} AS h,
    CASE WHEN {CRC32_SQL.format(x="doc_id")} % 2 = 0 THEN {_sql_record("doc_id", "source", "lang", "n_chars", "replace(text, chr(10), '')")} END AS claimed FROM documents),
a0 AS MATERIALIZED (SELECT id, grp, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, h, coalesce(claimed, h) AS x FROM d),
an0 AS (SELECT grp, pos, h FROM a0),
ap0 AS (SELECT id, grp, pos, x, '' AS proof FROM a0),
{_sql_tree("a", 12)},
bn0 AS MATERIALIZED (SELECT 0 AS grp, row_number() OVER (ORDER BY source) - 1 AS pos, h, source FROM (SELECT DISTINCT grp AS source, top AS h FROM as_)),
bp0 AS (SELECT id, 0 AS grp, pos, x, proof FROM as_ JOIN bn0 ON as_.grp = source),
{_sql_tree("b", 6)}
SELECT doc_id, d.h AS leaf, as_.top AS subroot, bs_.top AS root, sha256(bs_.proof) AS proof_sha256, bs_.x AS folded_root, bs_.x = bs_.top AS verified
FROM d JOIN as_ ON d.id = as_.id JOIN bs_ ON d.id = bs_.id"""
