"""Citations in the text: which references they mean, which chunk they stand in, and to what end they cite.

Each step takes only the citations that earlier ones left. Within a document, citations meet references by id, by year and by
common words, and chunks by words, so that a document of many citations and chunks does not give all their pairs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quire.functions.similarity import set_ratio
from quire.plans.storage import materialize

# What sentences say of the works they cite, in the order that settles ties. Fixed values.
INTENTS = {
    "supports": [
        r"consistent\s+with", r"in\s+agreement\s+with", r"confirms?", r"corroborates?", r"support(?:s|ed|ing)\s+by", r"in\s+line\s+with", r"aligns?\s+with",
    ],
    "contrasts": [r"unlike", r"in\s+contrast\s+to", r"contradicts?", r"however.*found", r"differs?\s+from", r"disagrees?\s+with", r"contrary\s+to", r"inconsistent\s+with"],
    "extends": [r"extends?", r"builds?\s+on", r"expands?", r"generaliz(?:es?|ing)", r"improves?\s+(?:on|upon)"],
    "uses_method": [
        r"using\s+the\s+method", r"following\s+the\s+approach", r"as\s+described\s+in", r"adopt(?:s|ed|ing)\s+(?:the\s+)?(?:method|approach|technique)",
        r"implemented\s+(?:as|in)", r"based\s+on\s+the\s+(?:method|framework|approach)",
    ],
    "background": [
        r"has\s+shown", r"demonstrated", r"established", r"well\s+known", r"widely\s+(?:used|adopted|accepted)",
        r"previous(?:ly)?\s+(?:studied|investigated|reported)", r"it\s+is\s+known\s+that",
    ],
    "compares": [r"compared\s+to", r"comparison\s+with", r"relative\s+to", r"outperforms?", r"as\s+opposed\s+to"],
}
#: An author, or two, or one and others, and a year. Fixed value.
AUTHOR_YEAR = r"\(?([A-Z][a-zA-Z'-]+(?:\s+(?:et\s+al\.?|&\s+[A-Z][a-zA-Z'-]+|and\s+[A-Z][a-zA-Z'-]+))?),?\s*(\d{4})\)?"
# Titles that a sentence holds at these scores are meant, if the next best is so far behind; fixed values, as are those below.
TITLE_SURE, TITLE_WITH_AUTHOR, TITLE_LEAD = 0.92, 0.85, 0.05
LONGEST_RANGE, LEAST_OVERLAP, SHORT = 50, 0.35, 80
#: Pairs of a document that are looked at one by one; where there would be more, words lead to them.
FEW_PAIRS = 4096

_CITED = ["doc_id", "nth"]


def flat(text: Column) -> Column:
    """Lower-cased, white space collapsed and trimmed."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def intent(sentence: Column) -> Column:
    """struct(intent, confidence) of a sentence: the intent of most patterns, 0.75 for two or more, 0.6 for one; null for none."""
    counted = F.array(*[
        F.struct(sum((sentence.rlike("(?i)" + p).cast("int") for p in ps), F.lit(0)).alias("n"), F.lit(-i).alias("first"), F.lit(name).alias("intent"))
        for i, (name, ps) in enumerate(INTENTS.items())
    ])
    told = lambda best: F.when(best["n"] > 0, F.struct(best["intent"].alias("intent"), F.when(best["n"] >= 2, 0.75).otherwise(0.6).alias("confidence")))
    return F.element_at(F.transform(F.array(F.array_max(counted)), told), 1)  # patterns are searched once


def marked_numbers(marker: Column) -> Column:
    """The numbers of the first [1, 3-5] of a marker, ranges of up to 50 spelled out, in order; empty if there is none."""
    inside = F.regexp_extract(marker, r"\[([0-9,\s\-]+)\]", 1)

    def spelled(part: Column) -> Column:
        low, high = (F.regexp_extract(part, r"^(\d{1,9})\s*-\s*(\d{1,9})$", i) for i in (1, 2))
        a, b = F.when(low != "", low).cast("int"), F.when(high != "", high).cast("int")
        alone = F.when(part.rlike(r"^\d{1,9}$"), F.array(part.cast("int")))
        return F.coalesce(alone, F.when((a <= b) & (b - a <= LONGEST_RANGE), F.sequence(a, b)), F.array().cast("array<int>"))

    parts = F.filter(F.split(F.trim(inside), r"\s*,\s*"), lambda p: p != "")
    return F.flatten(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), spelled(p)).otherwise(F.array().cast("array<int>"))))


def _ref(number: Column) -> Column:
    return F.format_string("ref_%03d", number)


@F.pandas_udf(DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """set_ratio of two flat texts, exact from TITLE_WITH_AUTHOR on."""
    return pd.Series([set_ratio(x, y, TITLE_WITH_AUTHOR) for x, y in zip(a, b, strict=True)])


def _left(citations: DataFrame, found: DataFrame) -> DataFrame:
    return citations.join(found.select(*_CITED).distinct(), _CITED, "left_anti")


def _crowded(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id) of documents in which rows of a and b give more than FEW_PAIRS pairs."""
    n = a.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(b.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")), "doc_id")
    return materialize(n.where(F.col("n") * F.col("m") > FEW_PAIRS).select("doc_id"), "crowded")


def _by_target(citations: DataFrame, references: DataFrame, raw_references: DataFrame) -> DataFrame:
    named = raw_references.where("target <> ''").select("doc_id", "target", _ref(F.col("number")).alias("ref_id"), "number").join(references.select("doc_id", "ref_id"), ["doc_id", "ref_id"])
    last = named.groupBy("doc_id", "target").agg(F.max_by("ref_id", "number").alias("ref_id"))
    parts = F.filter(F.transform(F.split("target", r"[\s,;]+"), lambda t: F.regexp_replace(t, "^#+", "")), lambda t: t != "")
    return citations.select(*_CITED, F.posexplode(parts).alias("at", "target")).join(last, ["doc_id", "target"]).select(*_CITED, "at", "ref_id")


def _by_number(citations: DataFrame, references: DataFrame) -> DataFrame:
    known = references.select("doc_id", "ref_id")
    listed = citations.select(*_CITED, F.posexplode(marked_numbers(F.col("marker"))).alias("at", "number"))
    found = listed.select(*_CITED, "at", _ref(F.col("number")).alias("ref_id")).join(known, ["doc_id", "ref_id"]).select(*_CITED, "at", "ref_id")
    one = _left(citations, found).select(*_CITED, F.regexp_extract("marker", r"\[(\d{1,9})\]", 1).alias("one")).where("one <> ''")
    alone = one.select(*_CITED, F.lit(0).alias("at"), _ref(F.col("one").cast("int")).alias("ref_id")).join(known, ["doc_id", "ref_id"])
    return found.unionByName(alone.select(*_CITED, "at", "ref_id"))


def _surname(author: Column) -> Column:
    return F.lower(F.trim(F.split(author, ",")[0]))


def _by_author(citations: DataFrame, references: DataFrame) -> DataFrame:
    pairs = F.arrays_zip(*[F.regexp_extract_all("marker", F.lit(AUTHOR_YEAR), F.lit(i)).alias(k) for i, k in ((1, "who"), (2, "year"))])
    said = citations.select(*_CITED, F.posexplode(pairs).alias("at", "x")).select(*_CITED, "at", F.lower(F.trim("x.who")).alias("who"), F.col("x.year").alias("year"))
    names = references.select("doc_id", "ref_id", "year", F.explode("authors").alias("author")).select("doc_id", "ref_id", "year", _surname(F.col("author")).alias("name"))
    met = said.join(names.where("name <> ''"), ["doc_id", "year"]).where(F.contains("who", "name"))
    # references in their order under each mention
    return met.select(*_CITED, F.struct("at", "ref_id").alias("at"), "ref_id").groupBy(*_CITED, "ref_id").agg(F.min("at").alias("at")).select(
        *_CITED, F.row_number().over(Window.partitionBy(*_CITED).orderBy("at")).alias("at"), "ref_id"
    )


def _by_title(citations: DataFrame, references: DataFrame) -> DataFrame:
    said = citations.where(F.char_length(F.regexp_replace("sentence", r"(?U)^\s+|\s+$", "")) >= 20).select(*_CITED, flat(F.col("sentence")).alias("said"))
    titled = references.where(F.char_length("title") >= 15).select("doc_id", "ref_id", flat(F.col("title")).alias("title"), F.transform("authors", _surname).alias("names"))
    words = lambda c: F.array_distinct(F.split(c, " "))
    # without a common word both texts must be about as long: lengths in neighbouring bands of a factor
    band = lambda c: F.floor(F.log(F.greatest(F.char_length(c), F.lit(1))) / F.log(F.lit(1.36)))
    crowded = _crowded(said, titled)
    few = said.join(crowded, "doc_id", "left_anti").join(titled.join(crowded, "doc_id", "left_anti"), "doc_id")
    few = few.where(F.arrays_overlap(words("said"), words("title")) | (F.abs(band("said") - band("title")) <= 1))
    much, names = said.join(crowded, "doc_id", "left_semi"), titled.join(crowded, "doc_id", "left_semi")
    by_word = much.select(*_CITED, F.explode(words("said")).alias("word")).join(names.select("doc_id", "ref_id", F.explode(words("title")).alias("word")), ["doc_id", "word"])
    near = much.select(*_CITED, F.explode(F.array(*[band("said") + d for d in (-1, 0, 1)])).alias("band")).join(names.select("doc_id", "ref_id", band("title").alias("band")), ["doc_id", "band"])
    pairs = by_word.select(*_CITED, "ref_id").unionByName(near.select(*_CITED, "ref_id")).distinct()
    met = few.unionByName(pairs.join(much, _CITED).join(names, ["doc_id", "ref_id"]).select(few.columns))
    both = met.withColumn("score", title_ratio("said", "title"))
    named = F.exists(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.contains(F.col("said"), n))
    held = both.where((F.col("score") >= TITLE_SURE) | (F.col("score") >= TITLE_WITH_AUTHOR) & named)
    best = held.groupBy(*_CITED).agg(F.max("score").alias("best"), F.max_by("ref_id", "score").alias("ref_id"), F.sort_array(F.collect_list("score"), False).alias("scores"))
    lead = F.coalesce(F.col("best") - F.try_element_at("scores", F.lit(2)), F.lit(1.0))
    return best.where(lead >= TITLE_LEAD).select(*_CITED, F.lit(0).alias("at"), "ref_id")


def referred(citations: DataFrame, references: DataFrame, raw_references: DataFrame) -> DataFrame:
    """(doc_id, nth, at, ref_id, how): the references each citation means, in order; how is target, regex, title or none.

    By the targets of the markup; of the rest by numbers in brackets, or authors and years; of the rest by a title that the
    sentence holds, if no other comes near. A citation that means none has one row without a reference.
    """
    left, found = citations, None
    steps = [
        ("target", lambda c: _by_target(c, references, raw_references)), ("regex", lambda c: _by_number(c, references)),
        ("regex", lambda c: _by_author(c, references)), ("title", lambda c: _by_title(c, references)),
    ]
    for how, step in steps:
        got = step(left).groupBy(*_CITED, "ref_id").agg(F.min("at").cast("int").alias("at")).withColumn("how", F.lit(how))
        got = materialize(got, "referred")
        found = got if found is None else found.unionByName(got)
        left = _left(left, got)
    none = left.select(*_CITED, F.lit(None).cast("string").alias("ref_id"), F.lit(0).alias("at"), F.lit("none").alias("how"))
    return found.unionByName(none).select(*_CITED, "at", "ref_id", "how")


def _containing(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, nth, place, section_id, short) of chunks that hold a citation's sentence, or else the first 80 characters of a longer one.

    Citations and chunks of a document that has few are compared at once. In others: a chunk that holds a sentence holds its inner
    words whole, so the longest of them leads to the chunks; sentences without inner words are compared with their document's chunks.
    """
    said = citations.select(*_CITED, flat(F.col("sentence")).alias("said")).where("said <> ''").withColumn("head", F.substring("said", 1, SHORT))
    texts = chunks.select("doc_id", "place", "section_id", flat(F.col("text")).alias("body"))
    crowded = _crowded(said, texts)
    few = said.join(crowded, "doc_id", "left_anti").join(texts.join(crowded, "doc_id", "left_anti"), "doc_id")
    said, texts = said.join(crowded, "doc_id", "left_semi"), texts.join(crowded, "doc_id", "left_semi")
    inner = F.split("head", " ")
    inner = F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.char_length(w).alias("n"), w.alias("word"))))["word"]
    said = said.withColumn("word", longest)
    words = texts.select("doc_id", "place", F.explode(F.array_distinct(F.split("body", " "))).alias("word"))
    led = said.where("word is not null").join(words, ["doc_id", "word"]).select(*_CITED, "said", "head", "place")
    rest = said.where("word is null").join(texts.select("doc_id", "place"), "doc_id").select(*_CITED, "said", "head", "place")
    met = few.unionByName(led.unionByName(rest).join(texts, ["doc_id", "place"]).select(few.columns))
    whole = F.contains("body", "said")
    return met.where(whole | (F.char_length("said") > SHORT) & F.contains("body", "head")).select(*_CITED, "place", "section_id", (~whole).alias("short"))


def _overlapping(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, nth, place, section_id, score) of chunks that hold at least 0.35 of a sentence's words of three letters or digits and more."""
    tokens = lambda text: F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))), lambda w: F.length(w) > 2)
    said = citations.select(*_CITED, tokens(F.col("sentence")).alias("words"))
    asked = said.select(*_CITED, F.size("words").alias("n"), F.explode("words").alias("word"))
    held = chunks.select("doc_id", "place", "section_id", F.explode(tokens(F.col("text"))).alias("word"))
    score = F.count(F.lit(1)) / F.first("n")
    return asked.join(held, ["doc_id", "word"]).groupBy(*_CITED, "place", "section_id").agg(score.alias("score")).where(F.col("score") >= LEAST_OVERLAP)


def placed(citations: DataFrame, chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, nth, place, how): the chunk of each citation; how is sentence, paragraph, overlap or last_resort.

    In the citation's section, if that has chunks: the chunk with its sentence, that of its paragraph (with the marker, if any has it),
    that of most of its words; else in the whole document by sentence and by words; else the section's first chunk, or the
    document's. Citations of documents without chunks are left out.
    """
    of = citations.join(sections.select("doc_id", F.col("position").alias("section_index"), F.col("section_id").alias("own")), ["doc_id", "section_index"], "left")
    of = of.select(*_CITED, "own", "marker", "paragraph_index")
    own = of.select(*_CITED, "own")
    here = lambda value: F.when(F.col("section_id") == F.col("own"), value)
    held = _containing(citations, chunks).join(own, _CITED).withColumn("x", F.struct("short", "place"))
    held = materialize(held.groupBy(*_CITED).agg(F.min(here(F.col("x"))).alias("held_here"), F.min("x").alias("held")), "held")
    mark = flat(F.coalesce("marker", F.lit("")))
    body = chunks.select("doc_id", F.col("section_id").alias("own"), "paragraph_index", "place", flat(F.col("text")).alias("body"))
    marked = (mark != "") & F.contains(F.col("body"), mark)
    # the chunk of a paragraph is asked for where none of the section holds the sentence, that of most words where there is no such paragraph
    left = materialize(_left(of, held.where("held_here is not null")), "left")
    paragraph = left.where("own is not null").join(body, ["doc_id", "own", "paragraph_index"]).groupBy(*_CITED).agg(F.min(F.struct((~marked).alias("other"), "place")).alias("paragraph"))
    paragraph = materialize(paragraph, "paragraphs")
    left = materialize(citations.select(*_CITED, "sentence").join(_left(left, paragraph).select(*_CITED), _CITED, "left_semi"), "left")
    alike = _overlapping(left, chunks.join(left.select("doc_id").distinct(), "doc_id", "left_semi")).join(own, _CITED).withColumn("x", F.struct((-F.col("score")).alias("score"), "place"))
    alike = alike.groupBy(*_CITED).agg(F.min(here(F.col("x"))).alias("alike_here"), F.min("x").alias("alike"))
    first = chunks.groupBy("doc_id").agg(F.min("place").alias("first"))
    first_here = chunks.groupBy("doc_id", F.col("section_id").alias("own")).agg(F.min("place").alias("first_here"))
    told = own.join(held, _CITED, "left").join(alike, _CITED, "left").join(paragraph, _CITED, "left").join(first_here, ["doc_id", "own"], "left").join(first, "doc_id")
    options = [("held_here.place", "sentence"), ("paragraph.place", "paragraph"), ("alike_here.place", "overlap"), ("held.place", "sentence"), ("alike.place", "overlap"), ("first_here", "last_resort"), ("first", "last_resort")]
    best = F.coalesce(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("place"), F.lit(how).alias("how"))) for c, how in options])
    return told.select(*_CITED, best.alias("best")).select(*_CITED, "best.*")


def link_citations(citations: DataFrame, references: DataFrame, raw_references: DataFrame, chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, citation_id, nth, ref_id, how, chunk_id, section_id, page, chunk_how, intent, intent_confidence): an edge for each reference of each citation.

    citations: (doc_id, nth, marker, sentence, target, section_index, paragraph_index), nth being unique in its document; references: (doc_id,
    ref_id, title, year, authors); raw_references: (doc_id, number, target); chunks: (doc_id, place, chunk_id, section_id, paragraph_index, text,
    page), place being their order; sections: (doc_id, position, section_id). The intent is that of the sentence, or of the chunk's first 200
    characters; a linked citation without one is background at 0.4. citation_id counts a document's edges, cit_001 on.
    """
    citations, chunks = materialize(citations, "citations"), materialize(chunks, "chunks")  # each is read for many steps
    meant, stands = referred(citations, references, raw_references), placed(citations, chunks, sections)
    told = citations.select(*_CITED, "sentence").join(stands.withColumnRenamed("how", "chunk_how"), _CITED)
    told = told.join(chunks.select("doc_id", "place", "chunk_id", "section_id", "page", F.substring("text", 1, 200).alias("head")), ["doc_id", "place"])
    context = F.coalesce(F.nullif("sentence", F.lit("")), F.col("head"))
    told = told.withColumn("said", intent(context)).drop("sentence", "head")
    edges = meant.join(told, _CITED)
    linked = F.max(F.col("ref_id").isNotNull()).over(Window.partitionBy(*_CITED))
    said = F.coalesce("said", F.when(linked, F.struct(F.lit("background").alias("intent"), F.lit(0.4).alias("confidence"))))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("nth", "at", "ref_id"))
    return edges.select("*", said.alias("why"), F.format_string("cit_%03d", number).alias("citation_id")).select(
        "doc_id", "citation_id", "nth", "ref_id", "how", "chunk_id", "section_id", "page", "chunk_how", F.col("why.intent").alias("intent"), F.col("why.confidence").alias("intent_confidence")
    )
