"""Entities of many documents that name the same thing: equal texts, aliases, and texts that are nearly equal."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.similarity import alike_places, comparable
from quire.functions.text import normalize_text
from quire.plans.components import connected_components
from quire.plans.storage import materialize

#: Labels that may be one entity beside equal ones: (first, second) by order of entity_id. Fixed values.
COMPATIBLE = [
    ("method", "tool"), ("tool", "method"), ("person", "organization"), ("organization", "person"), ("gene_protein", "method"),
]


def alias_table(spark: SparkSession, entries: Iterable[tuple[str, str, list[str]]]) -> DataFrame:
    """(norm, canonical, alias_label) from (canonical, label, variants): a canonical text stands for itself, the first entry of a text holds."""
    rows = [(i, canonical, label, v) for i, (canonical, label, variants) in enumerate(entries) for v in [canonical, *variants]]
    table = spark.createDataFrame(rows, "nth int, canonical string, label string, variant string")
    told = table.select("nth", normalize_text(F.col("variant")).alias("norm"), F.struct(normalize_text(F.col("canonical")).alias("canonical"), "label").alias("of"))
    first = told.where("norm <> ''").groupBy("norm").agg(F.min_by("of", "nth").alias("of"))
    return first.select("norm", "of.canonical", F.col("of.label").alias("alias_label"))


def _compatible(a: str, b: str, pairs: list[tuple[str, str]]) -> Column:
    listed = F.struct(F.col(a).alias("a"), F.col(b).alias("b")).isin([F.struct(F.lit(x).alias("a"), F.lit(y).alias("b")) for x, y in pairs]) if pairs else F.lit(False)
    return (F.col(a) == F.col(b)) | listed


#: Texts that one task compares with as many others at a time.
TILE = 1024


def _tiled(texts: DataFrame) -> DataFrame:
    """texts with n, band and part: a tile holds about TILE texts of one block and nearly one length."""
    rows = texts.where("text <> '' and block is not null").select("id", "block", "text", F.char_length("text").alias("n"))
    rows = rows.withColumn("band", F.floor(16 * F.log("n")).cast("int"))
    parts = rows.groupBy("block", "band").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    return materialize(rows.join(F.broadcast(parts), ["block", "band"]).select("id", "block", "text", "n", "band", part.alias("part")), "tiles")  # a row for each length


def similar_texts(texts: DataFrame, percent: int, right: DataFrame | None = None) -> DataFrame:
    """(a, b): ids of texts of one block for which 200 LCS / (|a| + |b|) >= percent, a < b; with right, a of texts and b of right.

    texts and right: (id, block, text), ids being unique. Null and empty texts are alike to none. Texts lie in tiles by
    block and length; every two tiles whose lengths allow alike texts meet in a group of their own, where characters are counted and
    what these leave is compared exactly. All pairs of a block are looked at, of whatever texts: the work grows with their square,
    a task's memory does not grow.
    """
    here = _tiled(texts)
    there = here if right is None else _tiled(right)
    key = ["block", "band_a", "part_a", "band_b", "part_b"]

    def side(rows: DataFrame, of: str) -> DataFrame:
        return rows.withColumnsRenamed({"band": f"band_{of}", "part": f"part_{of}"})

    ends = [side(t, of).groupBy("block", f"band_{of}", f"part_{of}").agg(F.min("n").alias(f"low_{of}"), F.max("n").alias(f"high_{of}")) for t, of in ((here, "a"), (there, "b"))]
    fits = (F.col("low_a") * percent <= F.col("high_b") * (200 - percent)) & (F.col("low_b") * percent <= F.col("high_a") * (200 - percent))
    if right is None:
        fits &= F.struct("band_a", "part_a") <= F.struct("band_b", "part_b")
    met = materialize(ends[0].join(ends[1], "block").where(fits).select(*key), "met")
    left, other = (
        side(t, of).join(met, ["block", f"band_{of}", f"part_{of}"]).select(*[F.col(c).alias(f"{of}_{c}") for c in (*key, "id", "text")])
        for t, of in ((here, "a"), (there, "b"))
    )
    one_side = right is None

    def compare(names: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        i, j = alike_places(a["a_text"].to_pylist(), b["b_text"].to_pylist(), percent)
        found = pa.table({"a": a["a_id"].take(i), "b": b["b_id"].take(j)})
        within = one_side and [x.as_py() for x in names[1:3]] == [x.as_py() for x in names[3:]]
        return found.filter(pc.less(found["a"], found["b"])) if within else found

    types = [f"{c} {t.schema['id'].dataType.simpleString()}" for c, t in (("a", here), ("b", there))]
    pairs = left.groupBy(*[f"a_{c}" for c in key]).cogroup(other.groupBy(*[f"b_{c}" for c in key])).applyInArrow(compare, ", ".join(types))
    return pairs if right is not None else pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def resolve_entities(entities: DataFrame, aliases: DataFrame, percent: int = 85, pairs: list[tuple[str, str]] = COMPATIBLE) -> DataFrame:
    """(cluster_id, entity_id, text, label, confidence, norm, canonical, method): each entity, under the least id of those it is one with.

    entities: (entity_id, text, label, confidence), of repeated ids the most confident row; aliases as alias_table gives
    them. Entities are one if their normalised texts are equal and their labels compatible; if aliases lead them to one canonical text and
    each label is compatible with the alias's; or, of those that are still alone, if their labels are equal and their
    token_sort similarity reaches percent; and if a chain of these joins them. Every key's members are linked to its least id, never in
    pairs. method: exact if another member has the same text, else alias if aliases hold the text, else fuzzy; null where a
    cluster has one member. Null texts and labels match nothing.
    """
    best = entities.groupBy("entity_id").agg(F.max_by(F.struct("text", "label", "confidence"), F.struct("confidence", "text", "label")).alias("e")).select("entity_id", "e.*")
    named = materialize(best.withColumn("norm", normalize_text(F.col("text"))).join(aliases, "norm", "left"), "entities")
    ids = F.col("entity_id")
    per_label = named.where("norm is not null and label is not null").groupBy("norm", "label").agg(F.min("entity_id").alias("src"), F.max("entity_id").alias("last"))
    same = named.join(per_label, ["norm", "label"]).select("src", ids.alias("dst"))
    other = per_label.select("norm", F.col("label").alias("label_b"), F.col("last").alias("last_b"), F.col("src").alias("dst"))
    across = per_label.join(other, "norm").where((F.col("label") != F.col("label_b")) & _compatible("label", "label_b", pairs) & (F.col("src") < F.col("last_b"))).select("src", "dst")
    known = named.where(F.col("canonical").isNotNull() & _compatible("label", "alias_label", pairs))
    star = known.groupBy("canonical", "alias_label").agg(F.min("entity_id").alias("src"))
    alias = known.join(star, ["canonical", "alias_label"]).select("src", ids.alias("dst"))
    sure = same.unionByName(across).unionByName(alias)
    groups = materialize(connected_components(sure, "src", "dst"), "groups")
    alone = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size = 1").select(F.col("component").alias("entity_id"))
    texts = named.join(alone, "entity_id").select(ids.alias("id"), F.col("label").alias("block"), comparable(F.col("text")).alias("text"))
    near = similar_texts(materialize(texts, "texts"), percent)
    found = connected_components(near, "a", "b").select(F.col("node").alias("entity_id"), F.col("component").alias("near"))
    settled = groups.withColumnRenamed("node", "entity_id").join(found, "entity_id", "left")
    members = named.join(settled, "entity_id", "left").withColumn("cluster_id", F.coalesce("near", "component", "entity_id"))
    members = materialize(members.drop("near", "component"), "members")
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    alike = members.groupBy("cluster_id", "norm").agg(F.count(F.lit(1)).alias("n_same"))
    method = F.when(F.col("size") == 1, None).when(F.col("n_same") > 1, "exact").when(F.col("canonical").isNotNull(), "alias").otherwise("fuzzy")
    told = members.join(sizes, "cluster_id").join(alike, ["cluster_id", "norm"], "left")
    return told.select("cluster_id", "entity_id", "text", "label", "confidence", "norm", "canonical", method.alias("method"))


def entity_clusters(members: DataFrame) -> DataFrame:
    """(cluster_id, canonical_text, label, size, confidence, n_variants, method) of clusters of two or more.

    The longest text stands for all, of these the last; the label most members have, of these the one whose first member
    comes first; the least confidence. method: hybrid if exact and others came together, else alias, fuzzy or exact.
    """
    text = F.trim("text")
    by_label = members.groupBy("cluster_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("first"))
    label = by_label.groupBy("cluster_id").agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "first")).alias("label"))
    has = {m: F.max((F.col("method") == m).cast("int")) for m in ("exact", "alias", "fuzzy")}
    told = members.where("method is not null").groupBy("cluster_id").agg(
        F.max_by(text, F.struct(F.char_length(text), text)).alias("canonical_text"),
        F.count(F.lit(1)).alias("size"),
        F.min("confidence").alias("confidence"),
        F.countDistinct(text).alias("n_variants"),
        F.when((has["exact"] == 1) & ((has["alias"] == 1) | (has["fuzzy"] == 1)), "hybrid").when(has["alias"] == 1, "alias").when(has["fuzzy"] == 1, "fuzzy").otherwise("exact").alias("method"),
    )
    return told.join(label, "cluster_id").select("cluster_id", "canonical_text", "label", "size", "confidence", "n_variants", "method")
