"""Quality classifier: kernel ridge regression by random Fourier features, calibrated by isotonic regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import columns as C
from quire.plans.storage import materialize

FOLDS = 5
#: Scores are pooled into so many steps before the isotonic fit.
STEPS = 2048

_UPPER = C.byte_class("", ((65, 90),))
_LETTER = C.byte_class("", ((65, 90), (97, 122), (0xC0, 0xFF)))  # one for each character above ASCII
_DIGIT = C.byte_class("", ((48, 57),))
_SYMBOL = C.byte_class("#*$%&<>")
_LOUD = C.byte_class("!?")
_BAR = C.byte_class("|")
_STOP = C.byte_class(".,;:")
_LINE = ~C.byte_class("\n")


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of each text's bytes are marked."""
    filled = np.flatnonzero(np.diff(offsets))
    out = np.zeros(len(offsets) - 1)
    if len(filled):
        out[filled] = np.add.reduceat(mask.view(np.uint8), offsets[filled], dtype=np.int64)
    return out


def _distinct(text: np.ndarray, hashed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each of n texts, and how often the most frequent one occurs."""
    key = np.sort((text.astype(np.uint64) << np.uint64(40)) | (hashed >> np.uint64(24)))
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    who = (key[first] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n)
    if len(first):
        runs = np.diff(np.append(first, len(key)))
        begin = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
        most[who[begin]] = np.maximum.reduceat(runs, begin)
    return np.bincount(who, minlength=n).astype(float), most


def document_statistics(column: pa.Array) -> np.ndarray:
    """A row of statistics, each of about unit range, for every text; null and empty texts give the same row."""
    parts = []
    for texts in C.slices(column, lower=False):
        n = len(texts)
        size = np.maximum(np.diff(texts.offsets), 1)
        found = C.words(texts, C.SPACE_WORDS)
        hashed = C.hashes(texts, found)
        count = found.counts.astype(float)
        some = np.maximum(count, 1)
        uniq, most = _distinct(found.text, hashed, n)
        inside = C.within(found, 2)
        pairs, _ = _distinct(found.text[: len(inside)][inside], C.grams(hashed, 2)[inside], n)
        lines = C.words(texts, _LINE)
        plain, _ = _distinct(lines.text, C.hashes(texts, lines), n)
        letters = _sums(_LETTER[texts.data], texts.offsets)
        length = np.bincount(found.text, found.end - found.start, n) / some
        n_lines = np.maximum(lines.counts, 1)
        parts.append(
            np.stack(
                [
                    np.log1p(count) / 10,
                    np.minimum(length, 20) / 10,
                    _sums(_UPPER[texts.data], texts.offsets) / np.maximum(letters, 1),
                    _sums(_DIGIT[texts.data], texts.offsets) / size,
                    np.minimum(_sums(_SYMBOL[texts.data], texts.offsets) / some, 2),
                    np.minimum(_sums(_LOUD[texts.data], texts.offsets) / some, 2),
                    np.minimum(_sums(_BAR[texts.data], texts.offsets) / some, 2),
                    np.minimum(_sums(_STOP[texts.data], texts.offsets) / some, 1),
                    letters / size,
                    uniq / some,
                    pairs / np.maximum(count - 1, 1),
                    most / some,
                    1 - plain / n_lines,
                    np.log1p(count / n_lines) / 5,
                    np.bincount(found.text, (found.end - found.start <= 3).astype(float), n) / some,
                ],
                axis=1,
            )
        )
    return np.concatenate(parts) if parts else np.zeros((0, N_STATISTICS))


N_STATISTICS = 15


@dataclass
class QualityModel:
    """What score() needs: standardisation, the random map, ridge weights and the calibration steps."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, statistics: np.ndarray) -> np.ndarray:
        x = np.clip((statistics - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)

    def score(self, statistics: np.ndarray) -> np.ndarray:
        return np.interp(self.features(statistics) @ self.weights, self.knots, self.levels)


def _isotonic(at: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over score steps: knots and the rising levels between them."""
    blocks: list[list[float]] = []
    for x, t, w in zip(at, total, n):
        blocks.append([t, w, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t1, w1, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t1, blocks[-1][1] + w1, blocks[-1][2], hi]
    knots = np.array([x for b in blocks for x in (b[2], b[3])])
    # half a row of each label to a block keeps levels off 0 and 1
    levels = np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks for _ in (0, 1)])
    return knots, np.maximum.accumulate(levels)


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the array of statistics of its whole text, a row for each row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = document_statistics(batch.column(1)).astype(np.float32)
            flat = pa.array(x.ravel())
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * N_STATISTICS, flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "stats"])

    return rows.mapInArrow(measure, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, stats array<float>")


def fit_quality(
    stats: DataFrame, labels: DataFrame, dims: int = 192, width: float = 3.5, ridge: float = 1e-3, seed: int = 17
) -> QualityModel:
    """Fit on stats (doc_id, stats) joined to labels (doc_id, label 0 or 1).

    Each partition sums the normal equations of its rows, for each of 5 folds by hash of the doc_id; the sums
    are added up by rows of the matrix. A fold's ridge scores come from the others' sums, so that the
    calibration sees scores of rows the weights have not met. Rows with a null id, label or statistics are
    left out; without rows of a label the score is the same everywhere (0.5 if there are no rows).
    """
    d = N_STATISTICS
    train = materialize(
        stats.join(labels.where("doc_id is not null and label is not null"), "doc_id").select(
            "stats", F.col("label").cast("double").alias("label"), F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold")
        ),
        "train",
    )
    moments = train.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(d)],
        *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(d)],
    ).first()
    rng = np.random.default_rng(seed)
    model = QualityModel(
        np.array([moments[f"m{i}"] or 0.0 for i in range(d)]),
        np.maximum(np.array([moments[f"s{i}"] or 0.0 for i in range(d)]), 1e-3),
        rng.normal(size=(d, dims)) / width,
        rng.uniform(0, 2 * np.pi, dims),
        np.zeros(dims + 1),
        np.array([0.0]),
        np.array([0.5]),
    )
    if not moments.n:
        return model
    m = dims + 1

    def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        return model.features(x), batch.column(1).to_numpy(), batch.column(2).to_numpy()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, m, m + 1))
        for batch in batches:
            z, y, fold = rows_of(batch)
            for k in range(FOLDS):
                part = z[fold == k]
                total[k] += part.T @ np.column_stack([part, y[fold == k]])
        for k in range(FOLDS):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array(list(total[k]), pa.list_(pa.float64()))],
                ["fold", "i", "row"],
            )

    def add(table: pa.Table) -> pa.Table:
        x = table.column("row").combine_chunks().flatten().to_numpy().reshape(-1, m + 1)
        return pa.table(
            {"fold": table.column("fold").slice(0, 1), "i": table.column("i").slice(0, 1), "row": pa.array([x.sum(0)], pa.list_(pa.float64()))}
        )

    kind = "fold int, i int, row array<double>"
    summed = np.zeros((FOLDS, m, m + 1))
    for r in train.mapInArrow(partial, kind).groupBy("fold", "i").applyInArrow(add, kind).collect():
        summed[r.fold, r.i] = r.row

    def solve(a: np.ndarray) -> np.ndarray:
        return np.linalg.solve(a[:, :m] + ridge * max(1.0, a[-1, m - 1]) * np.eye(m) / m, a[:, m])

    model.weights = solve(summed.sum(0))
    apart = [solve(summed.sum(0) - summed[k]) for k in range(FOLDS)]

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(STEPS), np.zeros(STEPS)
        for batch in batches:
            z, y, fold = rows_of(batch)
            raw = np.stack(apart)[fold.astype(int)]
            at = np.clip(((z * raw).sum(1) + 0.5) / 2 * STEPS, 0, STEPS - 1).astype(int)
            total += np.bincount(at, y, STEPS)
            n += np.bincount(at, minlength=STEPS)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used]), pa.array(n[used])], ["at", "t", "n"])

    pooled = sorted(
        train.mapInArrow(steps, "at long, t double, n double").groupBy("at").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).collect()
    )
    at = np.array([r.at for r in pooled])
    model.knots, model.levels = _isotonic(
        (at + 0.5) * 2 / STEPS - 0.5, np.array([r.t for r in pooled]), np.array([r.n for r in pooled])
    )
    return model


def score_statistics(stats: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score of each row of stats."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.select("doc_id", "stats").mapInArrow(score, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.3) -> DataFrame:
    """The rows of docs that score at least so much, with all their columns, in one pass over the texts."""
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(document_statistics(batch.column(at))) >= least))

    return docs.mapInArrow(keep, docs.schema)


def learning_labels(labels: DataFrame, column: str, mod: int, held: int) -> DataFrame:
    """doc_id and label of the rows of labels that are not held out; ids with two different labels are left out."""
    return (
        labels.where(F.col(column).isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % mod != held))
        .groupBy("doc_id")
        .agg(F.min(column).alias("label"), F.max(column).alias("other"))
        .where("label = other")
        .select("doc_id", "label")
    )


def held_out(mod: int, held: int):
    """Whether crc32 of the doc_id as text leaves that remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == held, F.lit(False))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    labels = learning_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", 5, 0)
    stats = materialize(statistics_table(spark.read.parquet(f"{sf_dir}/documents.parquet")), "stats")
    scored = score_statistics(stats, fit_quality(stats, labels))
    return scored.select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
