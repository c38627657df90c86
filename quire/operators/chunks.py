"""Chunks of sections: paragraphs, small ones merged, large ones cut between sentences. One fold of numbers a section, no shuffle but for reading order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import paragraphs, sentences, word_count


def _begins(counts: Column, breaks: Callable[[Column, Column], Column]) -> Column:
    """(begins, n): where groups of consecutive parts begin, by a fold over their word counts, and the last group's words.

    breaks: whether a group of so many words ends before a part of so many.
    """
    start = F.struct(F.array(F.lit(0)).alias("begins"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("i"))

    def step(s: Column, w: Column) -> Column:
        ends = (s["i"] > 0) & breaks(s["n"], w)
        return F.struct(
            F.when(ends, F.concat(s["begins"], F.array(s["i"]))).otherwise(s["begins"]).alias("begins"),
            F.when(ends, w).otherwise(s["n"] + w).alias("n"),
            (s["i"] + 1).alias("i"),
        )

    return F.aggregate(counts, start, step)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it, within other functions too."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _joined(parts: Column, begins: Column, between: str) -> Column:
    """The parts of each group as one text."""
    ends = F.concat(F.slice(begins, 2, F.greatest(F.size(begins) - 1, F.lit(0))), F.array(F.size(parts)))
    return F.zip_with(begins, ends, lambda a, b: F.array_join(F.slice(parts, a + 1, b - a), between))


def merge_small(parts: Column, least: int) -> Column:
    """Paragraphs merged with the next ones until they have `least` words; a last one that stays small joins the one before."""

    def finish(s: Column) -> Column:
        begins = s["begins"]
        return F.when((s["n"] < least) & (F.size(begins) > 1), F.slice(begins, 1, F.greatest(F.size(begins) - 1, F.lit(1)))).otherwise(begins)

    def merged(parts: Column) -> Column:
        fold = _begins(F.transform(parts, word_count), lambda n, _: n >= least)
        return F.when(F.size(parts) > 0, _let(_let(fold, finish), lambda begins: _joined(parts, begins, "\n\n"))).otherwise(parts)

    return _let(parts, merged)


def split_large(text: Column, most: int) -> Column:
    """A text as runs of whole sentences of at most so many words; a longer sentence is a run of its own."""

    def runs(parts: Column) -> Column:
        fold = _begins(F.transform(parts, word_count), lambda n, w: n + w > most)
        return F.when(F.size(parts) > 0, _let(fold["begins"], lambda begins: _joined(parts, begins, " "))).otherwise(F.array(text))

    return _let(F.transform(sentences(text, line_ends=False), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), runs)


def chunk_texts(content: Column, least: int = 150, most: int = 600, gap: str = r"\n\n") -> Column:
    """The chunks of a section's content as an array; empty for null and blank content."""
    parts = F.coalesce(paragraphs(content, gap), F.array().cast("array<string>"))
    whole = F.transform(merge_small(parts, least), lambda p: F.when(word_count(p) > most, split_large(p, most)).otherwise(F.array(p)))
    return F.filter(F.flatten(whole), lambda c: word_count(c) > 0)


def chunk_sections(sections: DataFrame, *more: str, least: int = 150, most: int = 600, gap: str = r"\n\n") -> DataFrame:
    """(doc_id, chunk_id, position, more, paragraph_index, reading_order, word_count, text) of sections (doc_id, position, content, more).

    Sections are read by position; chunk_id counts a document's chunks, chk_000 on. Sections of null or blank content give none;
    repeated sections give their chunks again.
    """
    cut = sections.select("doc_id", "position", *more, F.posexplode(chunk_texts(F.col("content"), least, most, gap)).alias("paragraph_index", "text"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("position", "paragraph_index")) - 1
    return cut.withColumn("reading_order", nth).select(
        "doc_id", F.format_string("chk_%03d", "reading_order").alias("chunk_id"), "position", *more, "paragraph_index", "reading_order", word_count(F.col("text")).alias("word_count"), "text"
    )
