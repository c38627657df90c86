"""From documents to token ids: quality, rules, near copies, benchmark passages, encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, jaccard, pieces, quality, rules
from quire.plans.storage import discard, materialize, read_back, tables_written, write_work

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from labels, scores at 0.3 or more.

    Only labels that op1_quality may learn from are used. Rows are judged by themselves: nulls and empty texts
    get a score like any text, repeated rows stand or fall together.
    """
    labels = quality.learning_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", 5, 0)
    with tables_written() as made:
        model = quality.fit_quality(materialize(quality.statistics_table(docs), "stats"), labels)
    for path in made:  # the model is all that is needed of them
        discard(spark, path)
    return quality.keep_good(docs, model, 0.3)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are probably good by the rules' votes.

    Null and empty texts go; repeated rows stand or fall together; an empty table stays empty.
    """
    return rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 on 5-word shingles form: the one with the least doc_id.

    Rows without a doc_id are kept, as are repeated rows of the one that stays.
    """
    with tables_written() as made:
        groups = jaccard.similar_groups(docs, size=5, num=80, den=100)
        gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
        path = write_work(gone, "gone")
    for other in set(made) - {path}:  # only the ids that go are read later
        discard(spark, other)
    return docs.join(read_back(gone, path), "doc_id", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null and empty texts hold none and are kept, as are repeated rows of a clean text; an empty benchmark keeps all.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, a row for each row; null and empty texts have none."""
    return pieces.encode(docs, pieces.Pieces.load())


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding", encoding),
]
#: Stages 1, 3 and 5 are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again by the next; what a stage left goes once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with tables_written() as made:
            out = stage(spark, docs, sf_dir)
            path = write_work(out, name.replace(" ", "-"))
        docs = read_back(out, path)
        for other in {*made, *before} - {path}:
            discard(spark, other)
        before = [path]
    return docs
