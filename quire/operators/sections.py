"""Labels of a document's sections: what their headers say, what their texts say, and where they stand.

Headers are scored once each against a dictionary of variants. What is left depends on the labels of earlier sections, so a
document's sections are folded in order, as an array of small rows without their texts.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quire.functions.similarity import ratio, set_ratio
from quire.functions.text import once

# Words of headers that decide a label where no variant does; fixed values, tried in this order.
HEADER_WORDS = {
    "appendix": (0.78, r"appendix|appendices|supplementary|additional material"),
    "related_work": (0.74, r"related work|prior work|previous work|feature[- ]based approaches|transfer learning"),
    "methodology": (0.74, (
        r"method|methods|methodology|approach|architecture|model description|network architecture|implementation|implementation details|experimental setup|"
        r"training|fine[- ]?tuning|pre[- ]?training|hyperparameters?|optimizer|regularization|label smoothing|data augmentation|datasets?|data sets?|"
        r"training data|corpus|batching|hardware|schedule|system|procedure|algorithm|update rule|initialization|our approach|problem formulation|"
        r"learning objective|loss function|objective function|training objective|training loss|experimental protocol|experimental methodology|baselines|"
        r"training setup|training configuration|training protocol|model configuration|configurations|complexity analysis|time complexity|optimization|"
        r"learning|notations|preliminaries"
    )),
    "results": (0.74, (
        r"experiments?|experimental results?|evaluation|empirical evaluation|ablation|additional ablation|case stud(?:y|ies)|error analysis|results?\s+on|"
        r"quantitative|qualitative|comparison with|effect of|benchmarks?|performance|object detection|classification|translation|parsing|glue|squad|swag|"
        r"mnist|cifar|imagenet|pascal|ms coco|svhn|timit|reuters|baseline comparison|comparison results|performance comparison|parameter sensitivity|"
        r"sensitivity analysis|statistical analysis|runtime analysis|complexity analysis|efficiency|scalability|ablation analysis|qualitative examples|"
        r"quantitative analysis|qualitative analysis|comparative analysis|hyperparameter analysis"
    )),
    "discussion": (0.68, r"discussion|analysis|advantages and disadvantages|implications|extensions?"),
}
#: Headers under which nothing is inherited. Fixed values.
NEVER_INHERITED = r"\b(?:abstract|references?|bibliography|acknowledg(?:e)?ments?)\b"
# Thresholds and factors; fixed values.
SURE, TENTATIVE, TENTATIVE_FACTOR = 0.88, 0.70, 0.85
INHERITED_FACTOR, INHERITED_MOST, INHERITS_UP_TO = 0.85, 0.65, 0.45
#: Numbering before a header, stripped in this order. Fixed values.
PREFIXES = [
    r"^\s*[A-Z]\.\d+(?:\.\d+)*\s*", r"^\s*[A-Z]\s+(?=(?:Additional|Appendix|Supplementary|Ablation|Results)\b)",
    r"^\s*[\dIVXivx]+[.)]\s*", r"^\s*[A-Z][.)]\s*", r"^\s*[\d]+\s*[-]\s*",
]


def clean_header(header: Column) -> Column:
    """A header without its numbering, white space collapsed, in lower case; empty for null."""
    out = F.coalesce(header, F.lit(""))
    for p in PREFIXES:
        out = F.regexp_replace(out, p, "")
    return F.lower(F.regexp_replace(F.regexp_replace(out, r"(?U)\s+", " "), "^ | $", ""))


def variant_score(header: str, variant: str) -> float:
    """How well a cleaned header fits a variant, 0 to 1."""
    if not header or not variant:
        return 0.0
    if header == variant:
        return 1.0
    scores = []
    if len(variant.split()) >= 2 or len(variant) >= 12:
        by_set = set_ratio(header, variant)
        if by_set >= 0.90 and len(header) < 0.6 * len(variant):
            by_set = round(max(0.88 * by_set, 0.70), 4)  # a short header within a long variant says little
        if by_set == 1.0:
            return by_set  # nothing is higher
        scores.append(by_set)
        if re.search(rf"\b{re.escape(variant)}\b", header):
            scores.append(0.94)
    if header.startswith((f"{variant}:", f"{variant} -")):
        scores.append(0.93)
    return max([*scores, ratio(header, variant), ratio(" ".join(sorted(header.split())), " ".join(sorted(variant.split())))])


def _size(words: set[str]) -> int:
    """Length of words joined by spaces."""
    return sum(map(len, words)) + max(len(words) - 1, 0)


def score_bound(header: str, words: set[str], length: int, variant: str, of_variant: set[str]) -> float:
    """What variant_score cannot exceed, by lengths and common words alone.

    A ratio is at most that of the shorter length; words are the header's different ones, length that of all its words joined by single spaces.
    """
    if variant in header or words <= of_variant or of_variant <= words:
        return 1.0
    most = lambda a, b: 2 * min(a, b) / (a + b) if a and b else 0.0
    all_words, both = len(" ".join(variant.split())), _size(words & of_variant)
    x, y = _size(words), _size(of_variant)
    return max(most(len(header), len(variant)), most(length, all_words), most(x, y), most(both, x), most(both, y))


def best_variants(headers: DataFrame, variants: Mapping[str, list[str]], least: float = 0.0) -> DataFrame:
    """(header, label, score) of each different cleaned header: the first best of all variants, null if none scores above 0.

    A variant that cannot reach least, or the best before it, is not scored; where the best is under least it may be told as less, or null.
    """
    listed = [(label, v.lower().strip(), set(v.lower().split())) for label, vs in variants.items() for v in vs]
    told = StructType([StructField("label", StringType()), StructField("score", DoubleType())])

    @F.pandas_udf(told)
    def best(column: pd.Series) -> pd.DataFrame:
        rows = []
        for header in column:
            found = (None, 0.0)
            split = header.split()
            words, length = set(split), len(" ".join(split))
            for label, variant, of_variant in listed:
                bound = score_bound(header, words, length, variant, of_variant)
                if bound < least or bound <= found[1]:
                    continue
                score = variant_score(header, variant)
                if score > found[1]:
                    found = (label, score)
            rows.append(found)
        return pd.DataFrame(rows, columns=["label", "score"])

    return headers.select("header").distinct().withColumn("best", best("header")).select("header", "best.*")


def _either(label: str, confidence: float, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence")))


def _said(header: Column, body: Column) -> Column:
    """(label, confidence) by words of the header, else by words of the text; null if neither says anything."""
    low = F.lower(F.coalesce(body, F.lit("")))
    by_header = [_either(label, c, header.rlike(rf"\b(?:{words})\b")) for label, (c, words) in HEADER_WORDS.items()]
    future = low.contains("future") & (low.contains("work") | low.contains("direction"))
    return F.coalesce(*by_header, _either("limitations", 0.55, low.contains("limitation")), _either("future_work", 0.50, future))


#: Labels that decide by whether they came before.
_TOLD = ("introduction", "conclusion", "results", "discussion")


def _placed(x: Column, total: Column, seen: Column) -> Column:
    """(label, confidence) of a section that says nothing, by where it stands and which labels of _TOLD came before."""
    nested = x["parent"].isNotNull() | (x["level"] > 1)
    no = {label: ~seen[label] for label in _TOLD}
    return F.coalesce(
        _either("other", 0.3, nested),
        _either("introduction", 0.7, (x["i"] == 0) & no["introduction"]),
        _either("conclusion", 0.6, (x["i"] == total - 1) & no["conclusion"]),
        _either("discussion", 0.5, ~no["results"] & no["discussion"]),
        _either("other", 0.3, F.lit(True)),
    )


def label_sections(sections: DataFrame, variants: Mapping[str, list[str]]) -> DataFrame:
    """(doc_id, position, section_id, parent_section_id, level, label, confidence) of every section.

    sections: (doc_id, position, header, body, level, parent), positions of a document being 0 on without gaps and parent the
    position of the section above, or null. A variant at 0.88 names the label; at 0.70 too, with 0.85 of its score; else words of the
    header, then of the text, then a section's place decide. A section that is only `other` takes its parent's label if that came before.
    variants: a dictionary, by label; of equal scores its first holds. Null headers and texts are empty.
    """
    known = sections.select(
        "doc_id", F.col("position").alias("i"), F.coalesce("level", F.lit(1)).alias("level"), F.col("parent").cast("int").alias("parent"),
        clean_header(F.col("header")).alias("header"), F.col("body"),
    )
    known = known.select("*", _said(F.col("header"), F.col("body")).alias("said")).drop("body")
    scored = known.join(best_variants(known, variants, TENTATIVE), "header", "left").withColumnRenamed("label", "best")
    by_variant = F.when(F.col("score") >= SURE, F.round("score", 4)).when(F.col("score") >= TENTATIVE, F.round(F.col("score") * TENTATIVE_FACTOR, 4))
    named = F.when(by_variant.isNotNull(), F.struct(F.col("best").alias("label"), by_variant.alias("confidence"))).otherwise(F.col("said"))
    row = F.struct("i", "level", "parent", named.alias("named"), F.col("header").rlike(NEVER_INHERITED).alias("apart"))
    gathered = scored.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    total = F.size("rows")

    def told(done: Column, x: Column, own: Column) -> Column:
        parent = F.when((x["parent"] >= 0) & (x["parent"] < x["i"]), F.get(done, x["parent"]))
        takes = (own["label"] == "other") & (own["confidence"] <= INHERITS_UP_TO) & (x["level"] > 1) & ~x["apart"] & (parent["label"] != "other")
        sure = F.round(F.greatest(F.least(parent["confidence"] * INHERITED_FACTOR, F.lit(INHERITED_MOST)), own["confidence"]), 4)
        return F.when(F.coalesce(takes, F.lit(False)), F.struct(parent["label"].alias("label"), sure.alias("confidence"))).otherwise(own)

    def step(before: Column, x: Column) -> Column:
        made = once(F.coalesce(x["named"], _placed(x, x["total"], before["seen"])), lambda own: told(before["done"], x, own))
        after = lambda t: F.struct(F.concat(before["done"], F.array(t)).alias("done"), F.struct(*[(before["seen"][k] | (t["label"] == k)).alias(k) for k in _TOLD]).alias("seen"))
        return once(made, after)

    none = F.struct(F.array().cast("array<struct<label:string,confidence:double>>").alias("done"), F.struct(*[F.lit(False).alias(k) for k in _TOLD]).alias("seen"))
    placed = F.transform("rows", lambda x: x.withField("total", total))
    labels = F.aggregate(placed, none, step, lambda at: at["done"])
    # explode would have Spark fold once more, to see which documents have rows
    both = F.explode_outer(F.arrays_zip(F.col("rows").alias("row"), labels.alias("told")))
    out = gathered.select("doc_id", total.alias("total"), both.alias("x")).where("x is not null").select("doc_id", "total", "x.row.*", "x.told.*")
    above = F.when((F.col("parent") >= 0) & (F.col("parent") < F.col("total")), F.format_string("sec_%03d", F.col("parent") + 1))
    level = F.least(F.greatest("level", F.lit(1)), F.lit(6))
    return out.select("doc_id", F.col("i").alias("position"), F.format_string("sec_%03d", F.col("i") + 1).alias("section_id"), above.alias("parent_section_id"), level.alias("level"), "label", "confidence")
