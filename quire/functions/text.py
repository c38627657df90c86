"""Text expressions shared by the operators. Each maps null to null unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def normalize_text(text: Column) -> Column:
    """Trimmed, lower-cased, white space collapsed, trailing punctuation stripped."""
    low = F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"(?U)\s+", " "), r"[.,;:!?'\"()]+$", ""))


def words(text: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def sentences(text: Column, line_ends: bool = True) -> Column:
    """Cut after . ! ? before white space, and at line ends unless told not to; blank ones dropped."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+" + (r"|\n+" if line_ends else "")), lambda x: F.trim(x) != "")


def paragraphs(text: Column, gap: str = r"\n\n") -> Column:
    """Cut at double line feeds (or another gap), white space trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, gap), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(words(text)), " ")


#: Named and numbered HTML entities that are read; fixed values. The ampersand's is last, so nothing is read twice.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&#x27;": "'", "&nbsp;": "\u00a0", "&ndash;": "\u2013", "&amp;": "&"}
#: A DOI within a text. Fixed value.
DOI = r"(?i)\b(10\.\d{4,9}/[^\s\"<>]+)"
_DASHES = "\u2010\u2011\u2012\u2013\u2014\u2212"


def unescape(text: Column) -> Column:
    """The entities of ENTITIES as their characters."""
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def plain_dashes(text: Column) -> Column:
    return F.translate(text, _DASHES, "-" * len(_DASHES))


def normalize_doi(doi: Column) -> Column:
    """Entities, dashes and percent signs read, prefixes and trailing punctuation stripped, lower-cased; null if it holds no DOI.

    A text with a malformed percent sign is not decoded.
    """
    text = plain_dashes(F.trim(unescape(doi)))
    text = F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)^doi\s*:\s*", ""), r"(?i)^https?://(?:dx\.)?doi\.org/", "")
    found = F.coalesce(F.nullif(F.regexp_extract(text, DOI, 1), F.lit("")), text)
    bare = F.lower(F.regexp_replace(found, r"^[\s.,;:)\]}>/]+|[\s.,;:)\]}>/]+$", ""))
    return F.when(bare.startswith("10."), bare)


def reference_year(year: Column, raw: Column) -> Column:
    """Four digits of the year field, else the first 19xx or 20xx of the raw text."""
    return F.coalesce(
        F.nullif(F.regexp_extract(year, r"\d{4}", 0), F.lit("")),
        F.nullif(F.regexp_extract(raw, r"\b(?:19|20)\d{2}\b", 0), F.lit("")),
    )


def initial(text: Column) -> Column:
    """A text's first character in upper case, one character again: ß gives its capital, ligatures stay as they are."""
    first = F.substring(text, 1, 1)
    upper, title = F.upper(first), F.initcap(first)
    one = lambda c: F.char_length(c) <= 1
    return F.when(first == "ß", "ẞ").when(one(upper), upper).when(one(title), title).otherwise(first)
