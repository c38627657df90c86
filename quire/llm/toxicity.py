"""Toxicity by a weighted grammar of clauses.

Small transducers read a clause's word classes: one for negation, whose scope fades after some words, one for
reported speech, which holds to the clause's end, one for targets. Their composition weighs every insult or
threat of the clause by where it stands; a document's score comes from its matched clauses.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import columns as C
from quire.llm.quality import held_out, learning_labels
from quire.plans.storage import materialize

# The words the grammar starts from. Insults that labels show are learned besides.
INSULTS = "bastard bitch clown cretin disgusting dumb fool freak garbage idiot imbecile jerk loser moron pathetic pig retard scum stupid trash vermin worthless".split()
THREATS = "beat burn crush destroy hang hurt kill murder rape shoot stab strangle".split()
INTENTS = "will shall gonna going must should deserve deserves".split()
TARGETS = "you your yours u he she they them him her these those this that everyone".split()
NEGATIONS = "not no never nobody neither nor isn't aren't wasn't don't doesn't didn't won't cannot can't without".split()
REPORTS = "said says wrote writes claimed claims reported reportedly quoted quote called alleged according told".split()

#: Characters of a stem, from and to.
LEAST_STEM, LONGEST_STEM = 3, 8

INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT, OTHER = "insult", "threat", "intent", "target", "negation", "report", "other"

Step = Callable[[Hashable, str], tuple[Hashable, float]]


@dataclass
class Transducer:
    """A start state and a step: (state, class of word) to (state, factor by which a core word here counts)."""

    start: Hashable
    step: Step


def negation(scope: int = 3, factor: float = 0.4) -> Transducer:
    """For so many words after a negation, core words count by factor."""

    def step(left: int, kind: str) -> tuple[int, float]:
        if kind == NEGATION:
            return scope, 1.0
        return max(0, left - 1), factor if left else 1.0

    return Transducer(0, step)


def reported(factor: float = 0.6) -> Transducer:
    """From a verb of saying to the clause's end core words count by factor."""
    return Transducer(False, lambda on, kind: (on or kind == REPORT, factor if on else 1.0))


def addressed(factor: float = 1.25) -> Transducer:
    """After a target core words count by factor."""
    return Transducer(False, lambda on, kind: (on or kind == TARGET, factor if on else 1.0))


def intended(factor: float = 0.25) -> Transducer:
    """Threats that no intent stands before count by factor."""
    return Transducer(
        False, lambda on, kind: (on or kind == INTENT, factor if kind == THREAT and not on else 1.0)
    )


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both at once: pairs of states, products of factors."""

    def step(state: tuple, kind: str) -> tuple[tuple, float]:
        (x, p), (y, q) = a.step(state[0], kind), b.step(state[1], kind)
        return (x, y), p * q

    return Transducer((a.start, b.start), step)


_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


@dataclass
class ToxicityModel:
    """Weights of core words and of stems, which are insults however they go on, and of the logistic curve over a
    document's clause features."""

    insults: dict[str, float]
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(THREATS, 1.0))
    curve: np.ndarray = field(default_factory=lambda: np.array([-3.0, 4.0, 1.0, 0.0]))
    stems: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.kinds: dict[str, str] = {}
        for kind, some in ((INTENT, INTENTS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, self.threats), (INSULT, self.insults)):
            self.kinds.update(dict.fromkeys(some, kind))
        self.weights = {**self.threats, **self.insults}
        self.grammar = reduce(compose, (negation(), reported(), addressed(), intended()))
        self.memo: dict[tuple, tuple] = {}
        self.core = ahocorasick.Automaton()
        for word in self.weights.keys() | self.stems.keys():
            self.core.add_word(word, (len(word), word in self.stems))
        if len(self.core):
            self.core.make_automaton()

    def __getstate__(self) -> dict:
        return {"insults": self.insults, "threats": self.threats, "curve": self.curve, "stems": self.stems}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def clause(self, words: list[str]) -> float:
        """What the core words of one clause weigh together."""
        state, total = self.grammar.start, 0.0
        for word in words:
            kind, weight = self._core(word)
            move = self.memo.get((state, kind))
            if move is None:
                move = self.memo[state, kind] = self.grammar.step(state, kind)
            state, factor = move
            if kind in (INSULT, THREAT):
                total += factor * weight
        return total

    def _core(self, word: str) -> tuple[str, float]:
        """A word's class and weight: its own, else that of the longest stem it begins with."""
        kind = self.kinds.get(word)
        if kind is None and self.stems:
            for k in range(min(len(word), LONGEST_STEM), LEAST_STEM - 1, -1):
                if (weight := self.stems.get(word[:k])) is not None:
                    return INSULT, weight
        return kind or OTHER, self.weights.get(word, 0.0)

    def features(self, text: str | None) -> tuple[float, float, float]:
        """(heaviest clause, all clauses, matched clauses) of a text."""
        low = (text or "").lower()
        if not len(self.core) or not any(self._whole(low, end, *found) for end, found in self.core.iter(low)):
            return 0.0, 0.0, 0.0
        weights = [w for c in _CLAUSE.split(low) if (w := self.clause(_WORD.findall(c))) > 0]
        return (max(weights), sum(weights), float(len(weights))) if weights else (0.0, 0.0, 0.0)

    @staticmethod
    def _whole(low: str, end: int, size: int, stem: bool) -> bool:
        at = end - size
        return not (at >= 0 and low[at].isalpha()) and (stem or not (end + 1 < len(low) and low[end + 1].isalpha()))

    @staticmethod
    def design(features: np.ndarray) -> np.ndarray:
        heavy, total, n = np.asarray(features, float).reshape(-1, 3).T
        return np.column_stack([np.ones_like(heavy), np.minimum(heavy, 1.0), np.log1p(total), np.log1p(n)])

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(features) @ self.curve, -30, 30)))


def _word_hashes(column: pa.Array) -> Iterator[tuple[C.Texts, C.Words, np.ndarray]]:
    """Words of a-z and characters above ASCII of the lower-cased texts, with their hashes."""
    low = pa.array([(t or "").lower() for t in column.to_pylist()], pa.large_string())
    for texts in C.slices(low):
        found = C.words(texts, _LETTERS)
        yield texts, found, C.hashes(texts, found)


_LETTERS = C.byte_class("", ((0x61, 0x7A), (0x80, 0xFF)))


def learn_insults(sample: DataFrame, most: int = 2000, stem_share: float = 0.8) -> tuple[dict[str, float], dict[str, float]]:
    """Words, and beginnings of words, that labelled documents show to be insults, with weights from 0.5 to 1.5.

    sample: (text, label). A word counts by the different words it follows, so that copies of one toxic
    document do not make all its words look toxic. The words of one beginning share their evidence: a family of
    three words or more is judged by their sums, where labels show each of them too seldom. A word or family is taken
    if chance gives such a split less than once in a hundred vocabularies; the `most` surest of either are kept.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy()
            for texts, found, hashed in _word_hashes(batch.column(0)):
                inside = np.flatnonzero(C.within(found, 2))
                bad = label[texts.first + found.text[1:][inside]].astype(np.int64)
                word, before = hashed[1:][inside], hashed[:-1][inside]
                with np.errstate(over="ignore"):  # a row of each once in this slice
                    _, one = np.unique(C.mix(word * np.uint64(3) + before) + bad.view(np.uint64), return_index=True)
                at, body = inside[one] + 1, texts.data.tobytes()
                spelt = [body[s:e].decode("utf-8") for s, e in zip(found.start[at].tolist(), found.end[at].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(spelt, pa.string()), pa.array(before[one].view(np.int64)), pa.array(bad[one])], ["word", "before", "bad"]
                )

    seen = sample.mapInArrow(pairs, "word string, before long, bad long").groupBy("word", "before").agg(
        F.max("bad").alias("bad"), F.max(1 - F.col("bad")).alias("good")
    )
    counts = materialize(seen.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "words")
    sizes = F.sequence(F.lit(LEAST_STEM), F.least(F.lit(LONGEST_STEM), F.length("word")))
    stems = (
        counts.where(F.length("word") >= LEAST_STEM)
        .select(F.explode(sizes).alias("k"), "word", "bad", "good")
        .groupBy(F.expr("substring(word, 1, k)").alias("word"))
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count(F.lit(1)).alias("members"))
        .where("members >= 3")
        .select("word", "bad", "good")
    )
    stems = materialize(stems, "stems")
    all_of = counts.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count(F.lit(1)).alias("n")).first()
    if not all_of.bad or not all_of.good:
        return {}, {}
    share = all_of.bad / (all_of.bad + all_of.good)
    tried = all_of.n + stems.count()
    n, p = F.col("bad") + F.col("good"), F.col("bad") / (F.col("bad") + F.col("good"))
    q = F.greatest(F.lit(1.0) - p, F.lit(1e-12))
    far = n * (p * F.log(p / share) + q * F.log(q / (1 - share)))

    def surest(table: DataFrame, least: float) -> dict[str, float]:
        rows = (
            table.where("bad >= 3")
            .withColumn("far", far)
            .where((p >= least) & (F.col("far") >= math.log(tried + 1) + 4.6))
            .orderBy(F.desc("far"), "word")
            .limit(most)
            .collect()
        )
        return {r.word: 0.5 + r.bad / (r.bad + r.good) for r in rows if r.word.isalpha()}

    return surest(counts, max(0.6, min(0.95, 3 * share))), surest(stems, max(stem_share, min(0.95, 3 * share)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 40_000, seed: int = 11) -> ToxicityModel:
    """Learn from docs (doc_id, text) and labels (doc_id, label).

    A bounded sample by parameter: by a hash of the id at most about sample / 2 documents of each label. Rows
    with nulls are left out; without labels the words the grammar starts from and a fixed curve hold.
    """
    counts = {r.label: r.n for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("label") == 1, sample / 2 / max(1, counts.get(1, 0))).otherwise(sample / 2 / max(1, counts.get(0, 0)))
    chosen = labels.where(draw < share)  # at most about `sample` short rows: small enough to broadcast
    texts = docs.where("text is not null").join(F.broadcast(chosen), "doc_id").select("text", F.col("label").cast("int").alias("label"))
    learned, stems = learn_insults(texts)
    model = ToxicityModel(dict.fromkeys(INSULTS, 1.0) | learned, stems=stems)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([shared.value.features(t) for t in batch.column(0).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2]), batch.column(1)], ["a", "b", "c", "label"])

    kind = "a double, b double, c double, label int"
    # equal features and labels are one row with a count, so little comes here
    rows = texts.mapInArrow(measure, kind).select(*[F.round(c, 2).alias(c) for c in "abc"], "label").groupBy("a", "b", "c", "label").agg(F.count(F.lit(1)).alias("n")).collect()
    if len({r.label for r in rows}) == 2:
        model.curve = _logistic(
            ToxicityModel.design(np.array([[r.a, r.b, r.c] for r in rows])),
            np.array([r.label for r in rows], float),
            np.array([r.n for r in rows], float),
        )
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton steps, with a ridge that keeps separable data finite."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - penalty * w
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        move = np.linalg.solve(bend, slope)
        w = w + move
        if np.abs(move).max() < 1e-9:
            break
    return w


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, and the heaviest, summed and counted matched clauses of each row of docs.

    Null and empty texts match nothing and get the score of a text without matches.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand words at most

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([shared.value.features(t) for t in batch.column(1).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shared.value.score(x)), pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2].astype(np.int64))],
                ["doc_id", "score", "heaviest_clause", "all_clauses", "n_clauses"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(read, f"doc_id {kind}, score double, heaviest_clause double, all_clauses double, n_clauses long")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = learning_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", 3, 1)
    return score_toxicity(docs, fit_toxicity(docs, labels)).select(
        "doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_clauses"
    )
