"""Triples from texts and entities: relations that sentences state, methods with data sets and metrics, and what claims say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.document_graphs import _holds
from quire.plans.storage import materialize

#: What verb forms mean. Fixed values.
PREDICATES = {
    "outperforms": ["outperforms", "outperform", "outperformed", "outperforming"],
    "improves": ["improves", "improve", "improved", "improving", "better than", "superior to"],
    "uses": ["uses", "use", "using", "used", "employs", "employed"],
    "introduces": ["introduces", "introduce", "introduced", "introducing", "proposes", "proposed"],
    "replaces": ["replaces", "replace", "replaced", "replacing"],
    "supports": ["supports", "support", "supported", "supporting"],
    "contradicts": ["contradicts", "contradict", "contradicted", "contradicting"],
    "achieves": ["achieves", "achieve", "achieved", "achieving", "obtains", "obtained"],
    "contains": ["contains", "contain", "contained", "containing", "consists of", "includes", "included"],
    "depends_on": ["depends on", "depended on", "depending on", "relies on", "relied on", "based on"],
    "evaluated_on": ["evaluated on", "tested on", "applied to", "benchmarked on", "measured on"],
}
#: Between up to five words on either side, what states a relation. Fixed values.
RELATIONS = [
    (r"outperforms?", "outperforms"), (r"improves?\s+(?:upon\s+)?", "improves"), (r"achieves?", "achieves"), (r"uses?", "uses"), (r"introduces?", "introduces"),
    (r"based\s+on", "depends_on"), (r"evaluated\s+on", "evaluated_on"), (r"replaces?", "replaces"), (r"supports?", "supports"), (r"contradicts?", "contradicts"),
    (r"contains?", "contains"), (r"(?:is\s+)?better\s+than", "improves"),
]
SIDE = r"(\w+(?:\s+\w+){0,4})"
#: The same side, whole words at a time: a word that does not end where it should is not tried again letter by letter.
WORDS = r"(\w++(?:\s++\w++){0,4})"
#: Letters without which a text states no relation of a predicate's pattern, in the order of RELATIONS; fixed values.
STEMS = ["outperform", "improve", "achieve", "use", "introduce", "based", "evaluated", "replace", "support", "contradict", "contain", "better"]
#: The predicate of a claim's type. Fixed values.
CLAIMS = {"methodological": "introduces", "comparative": "outperforms", "existence": "supports", "negation": "contradicts", "statistical": "achieves", "causal": "depends_on"}
# Factors of confidence, the least that is kept, and the pairs up to which those across chunks are made; fixed values.
STATED, CLAIMED, LEAST = 0.85, 0.80, 0.3
PAIRED = {"dataset": ("evaluated_on", 0.90, 0.70), "metric": ("achieves", 0.85, 0.65)}
PAIRS = 20


def normalized_predicate(raw: Column) -> Column:
    """What a verb form means, else the form itself, trimmed and in lower case."""
    low = F.lower(F.trim(raw))
    return F.coalesce(F.create_map(*[F.lit(x) for p, forms in PREDICATES.items() for f in forms for x in (f, p)])[low], low)


def relation_pattern(verb: str) -> str:
    tail = "" if verb.endswith(r"\s+)?") else r"\s+"
    return rf"{SIDE}\s+{verb}{tail}{SIDE}"


def relation_triples(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, subject_id, predicate, object_id, confidence): relations that a chunk states between two of its entities.

    chunks: (doc_id, chunk_id, text); entities: (doc_id, entity_id, nth, text, confidence, chunk_id), nth being their order. Each side of
    a match is the first entity of the chunk whose text it is, or one of whose words it is, or which it holds if that has several words.
    """
    found = F.flatten(F.array(*[_sides(verb, predicate, stem) for (verb, predicate), stem in zip(RELATIONS, STEMS, strict=True)]))
    matches = chunks.select("doc_id", "chunk_id", F.posexplode(found).alias("at", "m")).select("doc_id", "chunk_id", "at", "m.*")
    sides = matches.select("doc_id", "chunk_id", "at", "predicate", F.posexplode(F.array("a", "b")).alias("side", "said")).withColumn("said", F.lower(F.trim("said")))
    named = entities.where("trim(text) <> ''").select("doc_id", "entity_id", "nth", F.lower(F.trim("text")).alias("name"), "confidence", F.col("chunk_id").alias("of"))
    # the patterns are searched once; texts meet by chunk
    place = lambda t, chunk: t.where(F.col("doc_id").isNotNull() & F.col(chunk).isNotNull()).withColumn("doc_id", F.struct("doc_id", F.col(chunk).alias("chunk_id"))).drop(chunk)
    met = _holds(place(materialize(sides, "sides"), "chunk_id"), place(named, "of"), "said", "name")
    many = F.size(F.split("name", r"\s+")) > 1
    met = met.where(many | F.array_contains(F.split("said", r"\s+"), F.col("name")))
    key = ["doc_id", "at", "predicate"]
    first = met.groupBy(*key, "side").agg(F.min_by(F.struct("entity_id", "confidence"), F.struct("nth", "entity_id", "confidence")).alias("e"))
    both = first.groupBy(*key).agg(F.max(F.when(F.col("side") == 0, F.col("e"))).alias("s"), F.max(F.when(F.col("side") == 1, F.col("e"))).alias("o"))
    sure = F.round(F.least("s.confidence", "o.confidence") * STATED, 4)
    told = both.where("s.entity_id <> o.entity_id").select("doc_id.doc_id", "doc_id.chunk_id", F.col("s.entity_id").alias("subject_id"), "predicate", F.col("o.entity_id").alias("object_id"), sure.alias("confidence"))
    return told.where(F.col("confidence") >= LEAST)


def _sides(verb: str, predicate: str, stem: str) -> Column:
    """The texts before and after each statement of a relation.

    A match begins where a word does and takes whole words on either side, so these are searched as such, and only texts that hold the
    stem, however its letters are written, are searched at all. Both sides are read from the match.
    """
    pattern = rf"(?iU)(?<!\w){relation_pattern(verb).replace(SIDE, WORDS)}"
    plain = F.translate(F.lower("text"), "\u017f\u0131\u0307", "si")  # letters that the pattern takes for s and i
    found = F.when(F.contains(plain, F.lit(stem)), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    of = F.transform(found, lambda m: F.struct(F.regexp_extract(m, pattern, 1).alias("a"), F.regexp_extract(m, pattern, 2).alias("b"), F.lit(predicate).alias("predicate")))
    return F.coalesce(of, F.array().cast("array<struct<a:string,b:string,predicate:string>>"))


def paired_triples(entities: DataFrame, label: str) -> DataFrame:
    """(doc_id, chunk_id, subject_id, predicate, object_id, confidence): a document's methods with its entities of label (dataset or metric).

    entities: (doc_id, entity_id, nth, label, confidence, chunk_id). All pairs of one chunk; if these are under 20, pairs across chunks too, in
    the order of the methods and then of the others, until 20 are together. Only the first 40 of either can be among those.
    """
    predicate, near, far = PAIRED[label]
    ranked = entities.where(F.col("label").isin("method", label)).withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("nth")))
    side = lambda which, *names: ranked.where(F.col("label") == which).select("doc_id", *[F.col(c).alias(f"{c}_{names[0]}") for c in ("entity_id", "confidence", "chunk_id", "rank")])
    left, right = side("method", "m"), side(label, "o")
    same = left.join(right, (left.chunk_id_m == right.chunk_id_o) & (left.doc_id == right.doc_id)).drop(right.doc_id)
    some = same.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    first = lambda t, r: t.where(F.col(r) <= 2 * PAIRS)
    across = first(left, "rank_m").join(first(right, "rank_o"), "doc_id").where(~F.coalesce(F.col("chunk_id_m") == F.col("chunk_id_o"), F.lit(False)))
    across = across.join(some, "doc_id", "left").withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy("rank_m", "rank_o")))
    across = across.where(F.col("at") + F.coalesce("n", F.lit(0)) <= PAIRS)
    together = same.withColumn("factor", F.lit(near)).unionByName(across.drop("at", "n").withColumn("factor", F.when(F.col("chunk_id_m").eqNullSafe(F.col("chunk_id_o")), near).otherwise(far)))
    sure = F.round(F.least("confidence_m", "confidence_o") * F.col("factor"), 4)
    told = together.select("doc_id", F.coalesce("chunk_id_m", "chunk_id_o", F.lit("")).alias("chunk_id"), F.col("entity_id_m").alias("subject_id"), F.lit(predicate).alias("predicate"), F.col("entity_id_o").alias("object_id"), sure.alias("confidence"))
    return told.where(F.col("confidence") >= LEAST)


def claim_triples(claims: DataFrame, entities: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, subject_id, subject_text, predicate, object_id, object_text, negated, confidence) of claims, by their types.

    claims: (doc_id, claim_id, claim_type, sentence, confidence, chunk_id); the subject is the first method of the claim's chunk, else the
    document (documents: doc_id, title) under the name sub_ and the claim's id; the object is the claim, its text cut at 150 characters.
    """
    predicate = F.create_map(*[F.lit(x) for kv in CLAIMS.items() for x in kv])[F.col("claim_type")]
    method = entities.where("label = 'method' and chunk_id is not null").groupBy("doc_id", "chunk_id").agg(F.min_by(F.struct("entity_id", "text"), "nth").alias("m"))
    told = claims.withColumn("predicate", predicate).withColumn("sure", F.round(F.col("confidence") * CLAIMED, 4)).where((F.col("sure") >= LEAST) & F.col("predicate").isNotNull())
    told = told.join(method, ["doc_id", "chunk_id"], "left").join(documents.select("doc_id", "title"), "doc_id", "left")
    return told.select(
        "doc_id", "chunk_id", F.coalesce("m.entity_id", F.concat(F.lit("sub_"), "claim_id")).alias("subject_id"), F.coalesce("m.text", "title").alias("subject_text"), "predicate",
        F.col("claim_id").alias("object_id"), F.substring("sentence", 1, 150).alias("object_text"), (F.col("claim_type") == "negation").alias("negated"), F.col("sure").alias("confidence"),
    )


def deduplicated(triples: DataFrame) -> DataFrame:
    """(doc_id, triple_id, subject_id, predicate, object_id, confidence, n): equal triples of a document as one, by the best of them."""
    best = triples.groupBy("doc_id", "subject_id", "predicate", "object_id").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("predicate", "subject_id", "object_id"))
    return best.select("doc_id", F.format_string("triple_%03d", nth).alias("triple_id"), "subject_id", "predicate", "object_id", "confidence", "n")


def contribution_triples(facts: DataFrame, entities: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, subject_id, subject_text, predicate, object_id, object_text, evidence_id, confidence): what introduces each contribution.

    facts: (doc_id, fact_id, fact_type, value, chunk_id, section_id); chunks: (doc_id, chunk_id, section_id). The subject is the first method of the
    fact's chunk, else of its section's chunks, else the document by its title (documents: doc_id, title) at 0.6, under the name sub_ and
    the fact's id; confidence is 0.75 of the subject's. Values are cut at 120 characters.
    """
    methods = entities.where("label = 'method' and chunk_id is not null").select("doc_id", "chunk_id", "nth", F.struct("entity_id", "text", "confidence", F.col("chunk_id").alias("of")).alias("m"))
    of_chunk = methods.groupBy("doc_id", "chunk_id").agg(F.min_by("m", "nth").alias("near"))
    of_section = methods.join(chunks.select("doc_id", "chunk_id", "section_id"), ["doc_id", "chunk_id"]).groupBy("doc_id", "section_id").agg(F.min_by("m", "nth").alias("far"))
    told = facts.where("fact_type = 'contribution'").join(of_chunk, ["doc_id", "chunk_id"], "left").join(of_section, ["doc_id", "section_id"], "left").join(documents.select("doc_id", "title"), "doc_id", "left")
    m = F.coalesce("near", "far")
    sure = F.round(F.coalesce(m["confidence"], F.lit(0.6)) * 0.75, 4)
    return told.select(
        "doc_id", F.coalesce(m["of"], "chunk_id", "section_id", F.lit("")).alias("chunk_id"), F.coalesce(m["entity_id"], F.concat(F.lit("sub_"), "fact_id")).alias("subject_id"), F.coalesce(m["text"], F.col("title")).alias("subject_text"),
        F.lit("introduces").alias("predicate"), F.concat(F.lit("obj_"), "fact_id").alias("object_id"), F.substring("value", 1, 120).alias("object_text"), F.col("fact_id").alias("evidence_id"), sure.alias("confidence"),
    ).where(F.col("confidence") >= LEAST)
