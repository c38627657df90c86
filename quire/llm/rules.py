"""Quality rules by weak supervision: rules vote or abstain, and what they agree on tells how far to trust each."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.storage import materialize

SPACE = r"[\x20\x09-\x0D]"
#: The start: the share of good texts, and how likely a rule votes bad and good on good texts, and on bad ones.
PRIOR, ON_GOOD, ON_BAD = 0.85, (0.02, 0.78), (0.45, 0.35)
#: Rounds of the estimate, and how many texts the start is worth in each.
ROUNDS, SMOOTH = 20, 5.0

#: name: (good if, bad if, else the rule abstains), over the columns of with_statistics; n_words > 0 holds there.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("50 * n_symbols <= n_words", "5 * n_symbols >= n_words"),
    "repeats": ("10 * n_repeat_words <= n_words", "2 * n_repeat_words >= n_words"),
    "lines": ("10 * n_dup_lines <= n_lines", "3 * n_dup_lines >= n_lines"),
    "length": ("word_chars between 3 * n_words and 10 * n_words", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    "upper": ("5 * n_upper <= n_letters", "2 * n_upper >= n_letters"),
    "shouting": ("50 * n_loud <= n_words", "5 * n_loud >= n_words"),
    "letters": ("10 * n_letters >= 9 * word_chars", "4 * n_letters <= 3 * word_chars"),
    "marks": ("100 * n_symbols <= word_chars", "20 * n_symbols >= word_chars"),
}


def _count(text: Column, chars: str) -> Column:
    """How many characters of a class a text has."""
    return (F.length(text) - F.length(F.regexp_replace(text, chars + "+", ""))).cast("long")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and a struct column `q` of whole-text statistics; docs has no column of that name or that begins with _.

    n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words (words in 3-word windows that occur at
    least twice, the first included), n_upper, n_letters, n_loud. All by expressions on the row: where a text
    has equal windows, their hashes are sorted with their places, and neighbours compared.
    """
    made = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    made = made.withColumn("_words", F.array_remove(F.split("_text", SPACE + "+"), ""))
    made = made.withColumn(
        "_windows",
        F.expr(
            "slice(zip_with(zip_with(_words, slice(_words, 2, greatest(size(_words), 1)), (a, b) -> xxhash64(a, b)), "
            "slice(_words, 3, greatest(size(_words), 1)), (h, c) -> xxhash64(h, c)), 1, greatest(size(_words) - 2, 0))"
        ),
    )
    # (hash, place) of every window, sorted: equal hashes are neighbours
    made = made.withColumn(
        "_marks",
        F.expr(
            "if(size(array_distinct(_windows)) = size(_windows), cast(array() as array<struct<h:bigint,i:int>>), "
            "sort_array(transform(_windows, (h, i) -> struct(h as h, i as i))))"
        ),
    )
    made = made.withColumn(
        "_twice",
        F.expr(
            "sort_array(array_distinct(flatten(filter(zip_with(_marks, slice(_marks, 2, greatest(size(_marks), 1)), "
            "(a, b) -> if(a.h = b.h, array(a.i, b.i), null)), x -> x is not null))))"
        ),
    )
    # windows that begin at sorted places cover 3 words each, fewer where the next begins sooner
    covered = F.expr(
        "aggregate(zip_with(_twice, slice(_twice, 2, greatest(size(_twice), 1)), (a, b) -> coalesce(least(3, b - a), 3)), 0L, (s, x) -> s + x)"
    )
    made = made.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))))
    text = F.col("_text")
    q = F.struct(
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        _count(text, r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        covered.alias("n_repeat_words"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        _count(text, "[!?]").alias("n_loud"),
    )
    # a generator of one row: what reads q reads a column, not copies of the expressions that make it
    return made.select(*docs.columns, F.explode(F.array(q)).alias("q"))


def votes() -> list[Column]:
    """1 good, -1 bad, 0 abstain, for each rule; texts without words get no votes."""
    out = []
    for good, bad in RULES.values():
        good, bad = _of_q(good), _of_q(bad)
        out.append(F.expr(f"case when q.n_words = 0 then 0 when {bad} then -1 when {good} then 1 else 0 end"))
    return out


def _of_q(rule: str) -> str:
    return re.sub(r"\b(n_\w+|word_chars)\b", r"q.\1", rule)


def base_failed() -> Column:
    return F.expr("q.n_words < 50 or 100 * q.n_repeat_words > 50 * q.n_words")


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]], list[dict[int, float]]]:
    """(share of good texts, how likely each vote of each rule is on good texts, and on bad ones).

    Expectation-maximisation over patterns: each combination of votes with its count; there are at most 3 to
    the number of rules. Rules are taken to vote independently; the start tells good from bad.
    """
    start = [{-1: m, 0: 1 - m - p, 1: p} for m, p in (ON_GOOD, ON_BAD)]
    prior, good, bad = PRIOR, [dict(start[0]) for _ in RULES], [dict(start[1]) for _ in RULES]
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        weights = [n * posterior(vote, prior, good, bad) for vote, n in patterns]
        share = sum(weights)
        prior = (share + SMOOTH * PRIOR) / (total + SMOOTH)
        for j in range(len(RULES)):
            for v in (-1, 0, 1):
                on_good = sum(w for (vote, _), w in zip(patterns, weights) if vote[j] == v)
                on_bad = sum(n - w for (vote, n), w in zip(patterns, weights) if vote[j] == v)
                good[j][v] = (on_good + SMOOTH * start[0][v]) / (share + SMOOTH)
                bad[j][v] = (on_bad + SMOOTH * start[1][v]) / (total - share + SMOOTH)
    return prior, good, bad


def posterior(vote: tuple[int, ...], prior: float, good: list[dict[int, float]], bad: list[dict[int, float]]) -> float:
    """Probability that a text with these votes is good."""
    a, b = prior, 1 - prior
    for v, g, h in zip(vote, good, bad):
        a *= g[v]
        b *= h[v]
    return a / (a + b)


def vote_counts(voted: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    """How often each combination of votes occurs among rows (base_failed, votes) that pass the base rules."""
    counted = voted.where("not base_failed").groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    return sorted((tuple(r.votes), r.n) for r in counted.collect())  # at most 3 to the number of rules


def good_probability(prior: float, good: list[dict[int, float]], bad: list[dict[int, float]]) -> Column:
    """posterior() of the column `votes`."""

    def likelihood(start: float, of: list[dict[int, float]]) -> Column:
        out = F.lit(start)
        for j, p in enumerate(of):
            v = F.col("votes")[j]
            out = out * F.when(v > 0, p[1]).when(v < 0, p[-1]).otherwise(p[0])
        return out

    a, b = likelihood(prior, good), likelihood(1 - prior, bad)
    return a / (a + b)


def _voted(rows: DataFrame, *kept: str) -> DataFrame:
    """kept columns of rows (text among its columns), base_failed and votes."""
    return with_statistics(rows).select(*kept, base_failed().alias("base_failed"), F.array(*votes()).alias("votes"))


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, q, base_failed, good_probability and kept for each row of docs; kept: not base_failed, and probably good.

    Texts that fail the base rules do not take part in the estimate. Null and empty texts have no words and fail;
    repeated rows are judged alike; an empty table gives an empty result; other columns are not read.
    """
    # written once: the estimate and the verdicts read the statistics
    voted = materialize(_voted(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "q"), "votes")
    p = good_probability(*estimate(vote_counts(voted)))
    return voted.select("doc_id", "q", "base_failed", p.alias("good_probability"), (~F.col("base_failed") & (p >= 0.5)).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that judge_quality keeps, with all their columns, whatever their names; texts never leave
    their partition. Null and empty texts go, repeated rows stand or fall together, an empty table stays empty.

    Statistics are made twice, for the estimate and for the verdicts: a table of whole rows between would cost as much disk as docs."""
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    text = columns[docs.columns.index(text_col)]
    voted = _voted(docs.select(F.struct(*columns).alias("row"), text.alias("text")), "row")
    p = good_probability(*estimate(vote_counts(voted)))
    return voted.where(~F.col("base_failed") & (p >= 0.5)).select("row.*")


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict for every document."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", *[F.col(f"q.{n}").alias(n) for n in names], "base_failed", "kept"
    )


def _sql() -> str:
    """The query in SQL: the estimate is a recursion over rounds, each a row of the prior and the accuracies."""
    m = len(RULES)
    vote = ", ".join(
        f"CASE WHEN n_words = 0 THEN 0 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v{j}"
        for j, (good, bad) in enumerate(RULES.values())
    )
    vs = ", ".join(f"v{j}" for j in range(m))

    def likelihood(start: str, c: str) -> str:
        return start + "".join(f" * CASE v{j} WHEN 1 THEN {c}p{j} WHEN -1 THEN {c}m{j} ELSE {c}z{j} END" for j in range(m))

    good, bad = likelihood("prior", "g"), likelihood("(1 - prior)", "b")
    p = f"({good}) / (({good}) + ({bad}))"
    starts = {"g": (ON_GOOD[0], 1 - ON_GOOD[0] - ON_GOOD[1], ON_GOOD[1]), "b": (ON_BAD[0], 1 - ON_BAD[0] - ON_BAD[1], ON_BAD[1])}
    cells = [(c, k, j, v, starts[c][i]) for c in "gb" for i, (k, v) in enumerate((("m", -1), ("z", 0), ("p", 1))) for j in range(m)]
    first = ", ".join(f"CAST({x} AS DOUBLE) AS {c}{k}{j}" for c, k, j, _, x in cells)
    weight = {"g": "n * p", "b": "n * (1 - p)"}
    step = ", ".join(
        f"(sum(CASE WHEN v{j} = {v} THEN {weight[c]} ELSE 0.0 END) + {SMOOTH} * {x}) / (sum({weight[c]}) + {SMOOTH})" for c, _, j, v, x in cells
    )
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
c AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM c) GROUP BY doc_id),
s AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS n_letters,
    length(regexp_replace(t, '[^!?]', '', 'g')) AS n_loud FROM w LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {vote} FROM s),
pat AS (SELECT {vs}, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
em AS (SELECT 0 AS k, CAST({PRIOR} AS DOUBLE) AS prior, {first}
    UNION ALL
    SELECT k + 1, (sum(n * p) + {SMOOTH} * {PRIOR}) / (sum(n) + {SMOOTH}), {step}
    FROM (SELECT em.k, pat.*, {p} AS p FROM em, pat WHERE em.k < {ROUNDS}) GROUP BY k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND {p} >= 0.5 AS kept
FROM v, (SELECT * FROM em WHERE k = {ROUNDS}) AS em
"""


OP8_SQL = _sql()
