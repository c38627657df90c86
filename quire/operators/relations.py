"""Relations between documents: citations, shared entities and methods, agreeing and contradicting triples and claims.

Documents are compared if they share an entity cluster or one refers to the other by its id. Pairs that share a cluster of few documents
are listed once; clusters of many are looked up for the pairs that a stage finds by its own keys. What two documents say is weighed once for both ways.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.similarity import at_least, comparable
from quire.operators.resolution import similar_texts
from quire.plans.storage import materialize, partitions_for

#: Share of a stage's best evidence in a relation's confidence. Fixed values.
STAGE_WEIGHTS = {"citation": 0.40, "entity": 0.20, "method": 0.15, "triple": 0.15, "claim": 0.10}
#: Tokens that make a sentence negative. Fixed values.
NEGATIONS = [
    "not", "no", "never", "doesn't", "don't", "didn't", "isn't", "aren't", "wasn't", "weren't", "cannot", "can't",
    "without", "lack", "absence", "fails", "failure",
]
#: Documents of one item that all meet in pairs; items of more are looked up for pairs found otherwise.
COMMON = 256
#: Rows of one key that a join's task may well hold; keys with more are dealt out by salts.
PLAIN_ROWS = 10_000
#: Claims of a document that may well lie in one row; the claims of documents with more stay rows.
PACKED = 64
#: Letters of different texts and patterns of claims that may well be sent to every task; of more, those of pairs are.
LETTERS = 16_000_000


def has_negation(sentence: Column) -> Column:
    """Whether a white-space token of the sentence is a negation; punctuation stays with its token."""
    return F.arrays_overlap(F.split(F.lower(sentence), r"(?U)\s+"), F.array(*[F.lit(w) for w in NEGATIONS]))


def _counted(sets: DataFrame) -> DataFrame:
    """(doc_id, item) of sets, repeated rows once, with often, the documents of an item, and size, the items of a document."""
    sets = sets.where("doc_id is not null and item is not null").distinct()
    often = sets.groupBy("item").agg(F.count(F.lit(1)).alias("often"))
    sizes = sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("size"))
    return materialize(sets.join(often, "item").join(sizes, "doc_id"), "sets")


def _meeting(known: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, n): pairs a < b that share n > 0 of the items that at most COMMON documents have."""
    few = known.where((F.col("often") > 1) & (F.col("often") <= COMMON))
    one, other = (few.select("item", F.col("doc_id").alias(x), F.col("size").alias(f"n_{x}")) for x in "ab")
    return one.join(other, "item").where("a < b").groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("n"))


def overlaps(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, overlap) of pairs of documents, a < b, with |A and B| / min(|A|, |B|) >= least > 0.

    sets: (doc_id, item), repeated rows count once.
    """
    known = _counted(sets)
    return _overlaps(known, materialize(_meeting(known), "meeting"), _crowd(known), least)


def _crowd(known: DataFrame) -> DataFrame | None:
    """(doc_id, item) of items that more than COMMON documents have; None if there are none, so that no pair looks for them."""
    crowd = known.where(F.col("often") > COMMON).select("doc_id", "item")
    return None if crowd.isEmpty() else crowd


def _overlaps(known: DataFrame, meeting: DataFrame, crowd: DataFrame | None, least: float) -> DataFrame:
    """overlaps of sets as _counted gives them and their _meeting pairs.

    Items of few documents are counted as these meet. For the others: if A is
    the smaller set, a pair that reaches least shares one of the |A| - ceil(least |A|) + 1 rarest items of A: only those look for
    partners, dealt out by salts on both sides. The rest of them is counted for the pairs that are left, one row for each.
    """
    if crowd is None:  # each pair is there once, with all that it shares
        shared = meeting.select("a", "b", "n", F.least("n_a", "n_b").alias("least"))
        return shared.where(F.col("n") >= F.col("least") * least - 1e-9).select("a", "b", (F.col("n") / F.col("least")).alias("overlap"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("often", "item"))
    rare = known.withColumn("rank", rank).where((F.col("rank") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1) & (F.col("often") > COMMON))
    salts = F.ceil(F.col("often") / PLAIN_ROWS).cast("int")
    asking = rare.select(F.col("doc_id").alias("small"), "item", F.col("size").alias("n_small"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    common = known.where(F.col("often") > COMMON)
    holding = common.select(F.col("doc_id").alias("large"), "item", F.col("size").alias("n_large"), F.pmod(F.hash("doc_id"), salts).alias("salt"))
    first = (F.col("n_small") < F.col("n_large")) | (F.col("n_small") == F.col("n_large")) & (F.col("small") < F.col("large"))
    turned = F.col("small") > F.col("large")
    asked = asking.join(holding, ["item", "salt"]).where((F.col("small") != F.col("large")) & first).select(
        F.least("small", "large").alias("a"), F.greatest("small", "large").alias("b"),
        F.when(turned, F.col("n_large")).otherwise(F.col("n_small")).alias("n_a"), F.when(turned, F.col("n_small")).otherwise(F.col("n_large")).alias("n_b"),
    )
    pairs = meeting.select("a", "b", "n_a", "n_b").unionByName(asked).distinct()
    held = pairs.join(common.select(F.col("doc_id").alias("a"), "item"), "a").join(common.select(F.col("doc_id").alias("b"), "item"), ["b", "item"])
    counted = meeting.unionByName(held.select("a", "b", "n_a", "n_b", F.lit(1).cast("long").alias("n")))
    shared = counted.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max(F.least("n_a", "n_b")).alias("least"))
    return shared.where(F.col("n") >= F.col("least") * least - 1e-9).select("a", "b", (F.col("n") / F.col("least")).alias("overlap"))


def _both_ways(pairs: DataFrame, *more: str) -> DataFrame:
    """(source_id, target_id, more) of pairs (a, b, more) and of the same turned round."""
    there = pairs.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), *more)
    return there.unionByName(pairs.select(F.col("b").alias("source_id"), F.col("a").alias("target_id"), *more))


def _comparable_pairs(pairs: DataFrame, crowd: DataFrame | None, meeting: DataFrame, cited: DataFrame) -> DataFrame:
    """Of pairs (source_id, target_id) those that share a cluster or whose source refers to the target."""
    pairs = pairs.distinct()
    near = meeting.select("a", "b")
    met = pairs.withColumns({"a": F.least("source_id", "target_id"), "b": F.greatest("source_id", "target_id")}).join(near, ["a", "b"], "left_semi")
    ends = ["source_id", "target_id"]
    found = met.select(*ends).unionByName(pairs.join(cited, ends, "left_semi"))
    if crowd is not None:
        shared = pairs.join(crowd.withColumnRenamed("doc_id", "source_id"), "source_id").join(crowd.withColumnRenamed("doc_id", "target_id"), ["target_id", "item"])
        found = found.unionByName(shared.select(*ends))
    return found.distinct()


def citation_evidence(documents: DataFrame, references: DataFrame, crowd: DataFrame | None, meeting: DataFrame, cited: DataFrame, percent: int = 85) -> DataFrame:
    """(source_id, target_id, ref_id): each reference with each compared document it means, by id, DOI or title.

    Of a title that many references and documents have only those meet that are compared.
    """
    refs = references.join(documents.select("doc_id"), "doc_id", "left_semi").select("doc_id", "ref_id", "target_id", F.lower(F.trim("doi")).alias("doi"), F.trim("title").alias("title"))
    docs = documents.select(F.col("doc_id").alias("of"), F.lower(F.trim("doi")).alias("doi"), F.trim("title").alias("title"))
    by_id = refs.join(docs.select(F.col("of").alias("target_id")), "target_id").select("doc_id", "ref_id", F.col("target_id").alias("of"))
    by_doi = refs.where("doi <> ''").join(docs.where("doi <> ''").select("of", "doi"), "doi").select("doc_id", "ref_id", "of")
    long = F.char_length("title") > 5
    asked, titles = (t.where(long).select(*c, comparable(F.col("title")).alias("text")) for t, c in ((refs, ["doc_id", "ref_id"]), (docs, ["of"])))
    # each different title once, by a number
    named = materialize(asked.select("text").union(titles.select("text")).where("text <> ''").distinct().select("text", F.monotonically_increasing_id().alias("id")), "titles")
    asked, titles = (materialize(t.join(named, "text").drop("text"), "titled") for t in (asked, titles))
    texts = [named.join(t.select("id").distinct(), "id", "left_semi").select("id", F.lit(0).alias("block"), "text") for t in (asked, titles)]
    alike = materialize(similar_texts(texts[0], percent, texts[1]), "alike")
    asked, titles = asked.withColumnRenamed("id", "a"), titles.withColumnRenamed("id", "b")
    two = meeting.select(F.col("a").alias("doc_id"), F.col("b").alias("of"))
    two = two.unionByName(two.select(F.col("of").alias("doc_id"), F.col("doc_id").alias("of"))).unionByName(cited.toDF("doc_id", "of"))
    # asked titles alone, and named ones alone, that some other is alike
    asked, titles = asked.join(alike.select("a"), "a", "left_semi"), titles.join(alike.select("b"), "b", "left_semi")
    listed = two.join(titles, "of").join(asked, "doc_id").join(alike, ["a", "b"], "left_semi").select("doc_id", "ref_id", "of")
    found = by_id.unionByName(by_doi)
    if crowd is not None:
        often = crowd.select("doc_id").distinct()
        found = found.unionByName(asked.join(often, "doc_id", "left_semi").join(alike, "a").join(titles.join(often.toDF("of"), "of", "left_semi"), "b").select("doc_id", "ref_id", "of"))
    found = found.where("doc_id <> of").distinct()
    found = materialize(found.select(F.col("doc_id").alias("source_id"), F.col("of").alias("target_id"), "ref_id"), "citations")
    ok = _comparable_pairs(found.select("source_id", "target_id"), crowd, meeting, cited)
    listed = listed.where("doc_id <> of").select(F.col("doc_id").alias("source_id"), F.col("of").alias("target_id"), "ref_id")
    return found.join(ok, ["source_id", "target_id"]).unionByName(listed).distinct()


def _cited(documents: DataFrame, references: DataFrame) -> DataFrame:
    known = documents.select("doc_id")
    pairs = references.where("target_id <> doc_id").join(known, "doc_id", "left_semi").select(F.col("doc_id").alias("source_id"), "target_id").distinct()
    return pairs.join(known.withColumnRenamed("doc_id", "target_id"), "target_id", "left_semi").select("source_id", "target_id")


def _summed(found: DataFrame, *more: str) -> DataFrame:
    """(a, b, more, best, supports, contradicts) of evidence (a, b, more, kind, confidence); that without confidence is not counted."""
    kinds = [F.count(F.when((F.col("kind") == k) & (F.col("confidence") > 0), 1)).alias(k) for k in ("supports", "contradicts")]
    return found.groupBy("a", "b", *more).agg(F.max("confidence").alias("best"), *kinds)


def _linked(cited: DataFrame) -> DataFrame:
    """(a, b, forth, back): pairs a < b of which a refers to b, or b to a."""
    there = F.col("source_id") < F.col("target_id")
    ends = F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")
    return cited.groupBy(*ends).agg(F.max(there).alias("forth"), F.max(~there).alias("back"))


def _each_way(found: DataFrame, linked: DataFrame) -> DataFrame:
    """(source_id, target_id, more) of pairs (a, b, both, more): both ways, or where both does not hold, the ways that a reference goes."""
    told, more = found.join(linked, ["a", "b"], "left"), [c for c in found.columns if c not in ("a", "b", "both")]
    ways = [F.struct(F.col(x).alias("source_id"), F.col(y).alias("target_id"), F.coalesce(F.col("both") | F.col(to), F.col("both"), F.col(to), F.lit(False)).alias("ok")) for x, y, to in (("a", "b", "forth"), ("b", "a", "back"))]
    return told.select(F.explode(F.filter(F.array(*ways), lambda w: w["ok"])).alias("way"), *more).select("way.source_id", "way.target_id", *more)


def _of_compared(pairs: DataFrame, crowd: DataFrame | None, meeting: DataFrame, linked: DataFrame) -> DataFrame:
    """(source_id, target_id, more) of pairs a < b (a, b, more), each way that they are compared."""
    told = pairs.join(meeting.select("a", "b", F.lit(True).alias("both")), ["a", "b"], "left")
    if crowd is not None:
        told = materialize(told, "evidence")
        rest = told.where("both is null").select("a", "b").join(crowd.withColumnRenamed("doc_id", "a"), "a").join(crowd.withColumnRenamed("doc_id", "b"), ["b", "item"])
        told = told.join(rest.select("a", "b", F.lit(True).alias("crowded")).distinct(), ["a", "b"], "left").withColumn("both", F.coalesce("both", "crowded")).drop("crowded")
    return _each_way(told, linked)


def triple_evidence(triples: DataFrame) -> DataFrame:
    """(a, b, best, supports, contradicts) for documents a < b with triples of one subject and predicate.

    Of every two, equal objects, both negated or neither: support by their mean confidence; other objects: contradiction by 0.8 of it;
    equal objects, one negated: contradiction by 0.9 of it.
    """
    one = triples.select(F.col("doc_id").alias("a"), "subject_id", "predicate", "object_id", "negated", "confidence")
    other = one.select("subject_id", "predicate", F.col("a").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("object_id", "negated", "confidence")])
    both = one.join(other, ["subject_id", "predicate"]).where("a < b")
    mean = (F.col("confidence") + F.col("confidence_b")) / 2
    same = F.col("object_id") == F.col("object_id_b")
    agree = same & (F.col("negated") == F.col("negated_b"))
    return _summed(both.select(
        "a", "b", F.when(agree, "supports").otherwise("contradicts").alias("kind"), F.when(agree, mean).when(same, mean * 0.9).otherwise(mean * 0.8).alias("confidence"),
    ))


def _numbered(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """rows with a number in place of column's value, null for null, and the values: (column, id)."""
    values = rows.select(column).where(F.col(column).isNotNull()).distinct().select(column, F.monotonically_increasing_id().alias("id"))
    values = materialize(values, "values")
    return rows.join(values.withColumnRenamed("id", "_id"), column, "left").drop(column).withColumnRenamed("_id", column), values


def claim_evidence(claims: DataFrame, clusters: DataFrame, cited: DataFrame) -> DataFrame:
    """(a, b, both, best, supports, contradicts) for documents a < b that share a cluster (both) or one of which refers to the other, with alike claims of one type.

    Alike: statements at 80, or a common pattern, or sentences at 70 (token_sort similarity). One of them negative:
    contradiction by 0.85 of their mean confidence; neither: support by 0.8; both: nothing. Types, patterns and texts go as numbers. Where
    different texts have few letters, all tasks get these; else pairs are written, and each two texts of fitting lengths are compared once. Claims meet by cluster, a document's in one row, or along a reference; those of crowded clusters and of documents of many claims meet
    by type and cluster. Documents that meet by several clusters give the same sums each time, and count once.
    """
    spark = claims.sparkSession
    one = claims.where("claim_type is not null").select(
        "doc_id", "claim_type", has_negation(F.col("sentence")).alias("neg"), "confidence", F.transform("patterns", lambda p: F.lower(F.trim(p))).alias("patterns"),
        comparable(F.col("statement")).alias("statement"), comparable(F.col("sentence")).alias("sentence"),
    )
    one, values = materialize(one.withColumn("letters", F.char_length("sentence")), "claims"), {}
    for c in ("claim_type", "patterns", "statement", "sentence"):
        one, values[c] = _numbered(one, c)
    one = materialize(one, "claims")
    fields = ["claim_type", "neg", "confidence", "patterns", "statement", "sentence", "letters"]
    shared = clusters.where("often > 1").select("doc_id", "item")
    counts = one.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    many = shared.join(counts.where(F.col("n") > PACKED), "doc_id", "left_semi").select("item")
    wide = materialize(many.unionByName(clusters.where(F.col("often") > COMMON).select("item")).distinct(), "wide")
    side = lambda t, of, *keys: t.select(*keys, F.col("doc_id").alias(of), *[F.col(c).alias(f"{c}_{of}") for c in fields])

    def in_rows(t: DataFrame) -> DataFrame:
        apart, mean = F.coalesce(F.col("neg_a") != F.col("neg_b"), F.lit(False)), (F.col("confidence_a") + F.col("confidence_b")) / 2
        fits = 70 * (F.col("letters_a") + F.col("letters_b")) <= 200 * F.least("letters_a", "letters_b")
        texts = [f"{c}_{of}" for c in ("patterns", "statement") for of in "ab"] + [F.when(fits, F.col(f"sentence_{of}")).alias(f"sentence_{of}") for of in "ab"]
        return t.where(~(F.col("neg_a") & F.col("neg_b"))).select("a", "b", "item", apart.alias("apart"), F.when(apart, mean * 0.85).otherwise(mean * 0.8).alias("confidence"), *texts)

    few = shared if (narrow := wide.isEmpty()) else shared.join(wide, "item", "left_anti")
    said = one.join(counts.where(F.col("n") <= PACKED), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("said"))
    said = said.select("doc_id", *[F.transform("said", lambda x: x[c]).alias(c) for c in fields])  # arrays of numbers are short
    # sent once for both sides
    packed = few.join(said, "doc_id").repartition(partitions_for(spark, 3 * clusters.count()), "item")
    two = side(packed, "a", "item").join(side(packed, "b", "item"), "item").where("a < b")
    two = two.select("*", F.posexplode("claim_type_a").alias("i", "type_a"))
    two = two.select("*", F.posexplode("claim_type_b").alias("j", "type_b")).where("type_a = type_b")
    met = [in_rows(two.select("a", "b", "item", *[F.get(f"{c}_{of}", F.col(at)).alias(f"{c}_{of}") for c in fields for of, at in (("a", "i"), ("b", "j"))]))]
    if not narrow:
        plain = one.join(shared.join(wide, "item", "left_semi"), "doc_id")
        rows = side(plain, "a", "item").join(side(plain, "b", "item").withColumnRenamed("claim_type_b", "claim_type_a"), ["item", "claim_type_a"]).where("a < b")
        met.append(in_rows(rows))
    linked = _linked(cited).select("a", "b")
    along = linked.join(side(one, "a"), "a").join(side(one, "b").withColumnRenamed("claim_type_b", "claim_type_a"), ["b", "claim_type_a"])
    met.append(in_rows(along.withColumn("item", F.lit(None).cast("string"))))
    met = reduce(DataFrame.unionByName, met)
    texts, columns = ("patterns", "statement", "sentence"), ["a", "b", "item", F.when(F.col("apart"), "contradicts").otherwise("supports").alias("kind"), "confidence"]
    sums = [F.max(c).alias(c) for c in ("best", "supports", "contradicts")]
    weigh = lambda found: _summed(found.select(*columns), "item").groupBy("a", "b").agg(F.max(F.col("item").isNotNull()).alias("both"), *sums)
    letters = reduce(DataFrame.unionByName, [values[c].select(F.char_length(F.col(c) if c != "patterns" else F.concat_ws(" ", c)).alias("n")) for c in texts])
    if (letters.agg(F.sum(F.col("n") + 8).alias("n")).first()["n"] or 0) <= LETTERS:  # a value takes some room beside its letters
        for c in texts:
            for of in "ab":
                met = met.join(F.broadcast(values[c].select(F.col("id").alias(f"{c}_{of}"), F.col(c).alias(f"{c}_of_{of}"))), f"{c}_{of}", "left")
        common = F.coalesce(F.arrays_overlap("patterns_of_a", "patterns_of_b"), F.lit(False))
        fuzzy = [F.coalesce(at_least(*[F.when(~common, F.col(f"{c}_of_{of}")) for of in "ab"], p), F.lit(False)) for c, p in (("statement", 80), ("sentence", 70))]
        return weigh(met.where(common | fuzzy[0] | fuzzy[1]))
    met = materialize(met, "met")
    n = met.count()

    def alike(rows: DataFrame, c: str, test: Callable[[Column, Column], Column], name: str) -> DataFrame:
        """Pairs of numbers of column c in rows whose values pass, each once."""
        ends = [values[c].select(F.col("id").alias(f"{c}_{of}"), F.col(c).alias(of)) for of in "ab"]
        pairs = rows.select(f"{c}_a", f"{c}_b").where(F.col(f"{c}_a").isNotNull() & F.col(f"{c}_b").isNotNull()).distinct()
        return materialize(pairs.join(ends[0], f"{c}_a").join(ends[1], f"{c}_b").where(test(F.col("a"), F.col("b"))).select(f"{c}_a", f"{c}_b", F.lit(True).alias(name)), "alike", n)

    common = alike(met, "patterns", F.arrays_overlap, "common")
    stated = alike(met, "statement", lambda a, b: at_least(a, b, 80), "stated")
    told = met.join(common, ["patterns_a", "patterns_b"], "left").join(stated, ["statement_a", "statement_b"], "left")
    settled, rest = told.where("common or stated"), told.where("common is null and stated is null")
    spoken = alike(rest, "sentence", lambda a, b: at_least(a, b, 70), "spoken")
    return weigh(settled.select(*met.columns).unionByName(rest.join(spoken, ["sentence_a", "sentence_b"]).select(*met.columns)))


def document_relations(
    documents: DataFrame, entities: DataFrame, references: DataFrame, triples: DataFrame, claims: DataFrame,
    entity_least: float = 0.2, method_least: float = 0.2, percent: int = 85,
) -> DataFrame:
    """(source_id, target_id, relation_type, stage, confidence, n): relations of each kind between two documents; n counts their evidence.

    documents: (doc_id, doi, title), doc_id being unique; entities: (doc_id, canonical, norm, label), canonical being the text of
    an entity's cluster, null if it has none; references: (doc_id, ref_id, target_id, doi, title); triples: (doc_id, subject_id,
    predicate, object_id, negated, confidence); claims: (doc_id, claim_id,
    claim_type, sentence, statement, patterns, confidence), claim_id being unique in its document.
    A stage's confidence is its weight times the best of its evidence. cites has its reverse cited_by; compares_with goes both ways;
    methods shared at 0.4 or more are uses_method, else extends. Null keys match nothing; an empty table adds no relations. The
    pairs of documents of a corpus too small to share anything are not compared.
    """
    known = documents.select("doc_id")
    clusters = _counted(entities.where("canonical is not null").select("doc_id", F.lower("canonical").alias("item")).join(known, "doc_id", "left_semi"))
    meeting = materialize(_meeting(clusters), "meeting")
    cited = materialize(_cited(documents, references), "cited")
    crowd, linked = _crowd(clusters), materialize(_linked(cited), "linked")

    def typed(rows: DataFrame, kind: Column, stage: str, n: Column = F.col("n")) -> DataFrame:
        return rows.select("source_id", "target_id", kind.alias("relation_type"), F.lit(stage).alias("stage"), (STAGE_WEIGHTS[stage] * F.col("best")).alias("confidence"), n.cast("long").alias("n"))

    one = F.lit(1.0)
    cites = citation_evidence(documents, references, crowd, meeting, cited, percent).groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("n"), F.max(one).alias("best"))
    back = cites.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "n", "best")
    shared = _both_ways(_overlaps(clusters, meeting, crowd, entity_least), "overlap").withColumnRenamed("overlap", "best")
    methods = entities.where("label = 'method'").select("doc_id", F.coalesce(F.lower("canonical"), "norm").alias("item")).join(known, "doc_id", "left_semi")
    used = _of_compared(overlaps(methods, method_least).withColumnRenamed("overlap", "best"), crowd, meeting, linked)

    def by_kind(rows: DataFrame, stage: str) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in ("supports", "contradicts")]))
        kinds = rows.select("source_id", "target_id", "best", each.alias("x")).select("source_id", "target_id", "best", "x.*").where("n > 0")
        return typed(kinds, F.col("kind"), stage)

    parts = [
        typed(cites, F.lit("cites"), "citation"), typed(back, F.lit("cited_by"), "citation"),
        typed(shared, F.lit("compares_with"), "entity", F.lit(1)),
        typed(used, F.when(F.col("best") >= 0.4, "uses_method").otherwise("extends"), "method", F.lit(1)),
        by_kind(_of_compared(triple_evidence(triples.join(known, "doc_id", "left_semi")), crowd, meeting, linked), "triple"),
        by_kind(_each_way(claim_evidence(claims.join(known, "doc_id", "left_semi"), clusters, cited), linked), "claim"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
