"""References of documents matched against a catalogue of works: by DOI, else by title, authors and year."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.similarity import common_lengths, shared_letters
from quire.plans.storage import materialize

# Shares of title, author, year and DOI in a candidate's score, and the scores that resolve; fixed values.
TITLE, AUTHOR, YEAR, HAS_DOI = 0.64, 0.18, 0.12, 0.06
RESOLVED, AMBIGUOUS = 0.70, 0.50
#: What each field adds to a reference's confidence, and what its status does. Fixed values.
FIELDS, STATUS = {"title": 0.25, "authors": 0.15, "year": 0.10, "venue": 0.10, "raw_text": 0.10}, {"resolved": 0.30, "ambiguous": 0.18}
#: The rarest words of a title by which it looks for works.
RARE_WORDS = 3
#: Questions, and works, of a block that meet at a time; blocks of up to SMALL of both share a group of about SHARED.
TILE, SMALL, SHARED = 1024, 64, 256


def author_name(name: Column) -> Column:
    """`Surname, Given` of a name; a name of one word, or with an empty side of its comma, stays."""
    text = F.regexp_replace(F.trim(T.unescape(F.coalesce(name, F.lit("")))), r"(?U)\s+", " ")
    text = F.regexp_replace(text, r"(?<=[a-z])(?=[A-Z])", " ")  # names run together
    text = F.regexp_replace(text, r"^([A-Z]{1,3})([A-Z][a-z].*)$", "$1 $2")
    family, given = F.trim(F.regexp_extract(text, r"^([^,]*),(.*)$", 1)), F.trim(F.regexp_extract(text, r"^([^,]*),(.*)$", 2))
    whole = F.when((family != "") & (given != ""), F.concat(family, F.lit(", "), given)).otherwise(text)
    return F.when(text.contains(","), whole).otherwise(F.regexp_replace(text, r"^(.*\S)\s+(\S+)$", "$2, $1"))


def surname(name: Column) -> Column:
    """The lower-cased letters, digits and hyphens of a name's surname; empty for none."""
    full = author_name(name)
    return F.regexp_replace(F.lower(F.split(full, ",")[0]), "[^a-z0-9-]", "")


def clean_title(title: Column) -> Column:
    """Entities and dashes read, white space collapsed, no punctuation at its ends; empty for null."""
    text = F.trim(F.regexp_replace(T.plain_dashes(T.unescape(F.coalesce(title, F.lit("")))), r"(?U)\s+", " "))
    return F.regexp_replace(text, r"^[ .,:;]+|[ .,:;]+$", "")


def match_title(title: Column) -> Column:
    """A title's words in lower case without punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(clean_title(title)), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def _alike(left: list[str], right: list[str]) -> np.ndarray:
    """The best of plain, token_sort and token_set ratios of each two texts as match_title gives them, none empty."""
    at, n = np.arange(len(left)), lambda texts: np.array([len(t) for t in texts], dtype=np.int64)

    def ratios(a: list[str], b: list[str]) -> np.ndarray:
        return 2 * common_lengths(a, b, at, at) / (n(a) + n(b))

    by_order = [[" ".join(sorted(t.split())) for t in texts] for texts in (left, right)]
    sets = [(set(a.split()), set(b.split())) for a, b in zip(left, right, strict=True)]
    both = [" ".join(sorted(x & y)) for x, y in sets]
    with_both = [[f"{c} {" ".join(sorted(xy[k] - xy[1 - k]))}".strip() for c, xy in zip(both, sets, strict=True)] for k in (0, 1)]
    common = 2 * n(both) / (n(both) + np.minimum(n(with_both[0]), n(with_both[1])))
    held = np.array([bool(x & y) and (x <= y or y <= x) for x, y in sets], dtype=bool)
    return np.where(held, 1.0, np.max([ratios(left, right), ratios(*by_order), common, ratios(*with_both)], axis=0))


def _bounds(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What _alike of every two titles is at least and at most, by words, lengths and letters, and where that is exact: where one is empty or has all words of the other."""
    words = [[sorted(set(t.split())) for t in titles] for titles in (left, right)]
    place = {w: k for k, w in enumerate(sorted({w for side in words for ws in side for w in ws}))}
    has = [np.zeros((len(side), len(place)), dtype=np.float32) for side in words]
    for side, h in zip(words, has, strict=True):
        for k, ws in enumerate(side):
            h[k, [place[w] for w in ws]] = 1
    both = has[0] @ has[1].T
    common = np.maximum((has[0] * np.array([len(w) + 1 for w in place], dtype=np.float32)) @ has[1].T - 1, 0).astype(np.float64)
    different = [[" ".join(ws) for ws in side] for side in words]
    (m, n), (x, y) = (tuple(np.array([len(t) for t in side], dtype=np.int64) for side in sides) for sides in ((left, right), different))
    empty = (m[:, None] == 0) | (n[None, :] == 0)
    held = (both > 0) & ((both == has[0].sum(axis=1)[:, None]) | (both == has[1].sum(axis=1)[None, :]))
    at_least = np.where(both > 0, 2 * common / np.maximum(common + np.minimum(x[:, None], y[None, :]), 1), 0.0)
    letters = [2 * shared_letters(*sides) / np.maximum(a[:, None] + b[None, :], 1) for sides, a, b in (((left, right), m, n), (different, x, y))]
    at_most = np.maximum(at_least, np.maximum(*letters))
    return np.where(held, 1.0, np.where(empty, 0.0, at_least)), np.where(held, 1.0, np.where(empty, 0.0, at_most)), held | empty


def _best_of_tile(asked: pa.Table, held: pa.Table) -> pa.Table:
    """(question, item_id, found, score): the best work of each question that has one in its block; works that cannot be the best are not compared."""
    held = held.take(pc.sort_indices(held, sort_keys=[("item_id", "ascending")]))  # of equal ones the first
    (titles, a), (others, b) = (np.unique(np.array(t["title"].to_pylist(), dtype=object), return_inverse=True) for t in (asked, held))
    low, high, exact = _bounds(list(titles), list(others))
    both = lambda c: (asked[c].to_pylist(), held[c].to_pylist())

    def same(left: list, right: list) -> np.ndarray:
        code = {}
        codes = [np.array([code.setdefault(v, len(code)) for v in side]) for side in (left, right)]
        return codes[0][:, None] == codes[1][None, :]

    names, years = both("names"), both("year")
    place = {w: k for k, w in enumerate({w for side in names for ws in side for w in ws})}
    has = [np.zeros((len(side), len(place)), dtype=np.float32) for side in names]
    for side, h in zip(names, has, strict=True):
        for k, ws in enumerate(side):
            h[k, [place[w] for w in ws]] = 1
    some = [np.array([len(ws) > 0 for ws in side]) for side in names]
    by_author = np.where(some[0][:, None], np.where(some[1][None, :], (has[0] @ has[1].T > 0) * 1.0, 0.0), 0.5)
    by_author = np.where(some[0][:, None] & ~some[1][None, :], 0.0, by_author)
    by_year = np.where(np.array([y is None for y in years[0]])[:, None], 0.5, same(*years) * 1.0)
    has_doi = pc.is_valid(held["found"]).to_numpy(zero_copy_only=False).astype(np.float64)[None, :]
    meet = same(*both("block"))

    def score(by_title: np.ndarray) -> np.ndarray:
        return np.where(meet, TITLE * by_title + AUTHOR * by_author + YEAR * by_year + HAS_DOI * has_doi, -np.inf)

    at = np.ix_(a, b)
    least = np.maximum(score(low[at]).max(axis=1), asked["least"].to_numpy())
    can = meet & (score(high[at]) >= least[:, None] - 1e-9)
    i, j = np.nonzero(can & ~exact[at])
    pairs = np.unique(a[i].astype(np.int64) * len(others) + b[j])
    for part in np.array_split(pairs, len(pairs) // 8192 + 1):
        x, y = part // len(others), part % len(others)
        low[x, y] = _alike(list(titles[x]), list(others[y]))
    scores = np.where(can, score(low[at]), -np.inf)
    best = scores.argmax(axis=1)
    most = scores[np.arange(len(best)), best]
    told = np.flatnonzero(most > -np.inf)
    chosen = held.take(pa.array(best[told]))
    return pa.table({"question": asked["question"].take(pa.array(told)), "item_id": chosen["item_id"], "found": chosen["found"], "score": most[told]})


def _best(found: DataFrame) -> DataFrame:
    """(question, item_id, found, score): a question's best, of equal ones the least item_id."""
    best = found.groupBy("question").agg(F.min_by(F.struct("item_id", "found", "score"), F.struct((-F.col("score")).alias("s"), "item_id")).alias("best"))
    return best.select("question", "best.*")


def _best_in_blocks(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(question, item_id, found, score): for each question the best of the works that share a block with it.

    asked: (block, question, title, names, year, least), works under the score least do not matter; held: (block, item_id, found, title, names, year). Pairs are neither
    written nor sent: tiles of a block's questions and works meet, small blocks share a group. The work grows with the pairs, a task's memory does not.
    """
    sizes = asked.groupBy("block").agg(F.count(F.lit(1)).alias("asks")).join(held.groupBy("block").agg(F.count(F.lit(1)).alias("holds")), "block")
    small = (F.col("asks") <= SMALL) & (F.col("holds") <= SMALL)
    sizes = materialize(sizes.withColumn("small", small), "blocks")
    shared = sizes.where("small").agg(F.sum(F.greatest("asks", "holds")).alias("n")).first()["n"] or 0
    key = F.when(F.col("small"), F.pmod(F.xxhash64("block"), F.lit(-(-shared // SHARED) or 1))).otherwise(F.xxhash64("block"))
    parts = {c: F.ceil(F.col(c) / TILE).cast("int") for c in ("asks", "holds")}
    sizes = sizes.select("block", key.alias("key"), *[p.alias(c) for c, p in parts.items()])

    def dealt(rows: DataFrame, id_: str, mine: str, theirs: str) -> DataFrame:
        rows = rows.join(sizes, "block").withColumn(f"part_{mine}", F.pmod(F.xxhash64(id_), F.col(mine)).cast("int"))
        rows = rows.withColumn(f"part_{theirs}", F.explode(F.sequence(F.lit(0), F.col(theirs) - 1))).drop("asks", "holds")
        return rows.select(*[F.col(c).alias(f"{mine}_{c}") for c in rows.columns])

    keys = ["key", "part_asks", "part_holds"]
    left, right = dealt(asked, "question", "asks", "holds"), dealt(held, "item_id", "holds", "asks")
    types = [f"question {asked.schema['question'].dataType.simpleString()}", *[f"{c} {held.schema[c].dataType.simpleString()}" for c in ("item_id", "found")], "score double"]

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.rename_columns([c.removeprefix("asks_") for c in a.column_names]), b.rename_columns([c.removeprefix("holds_") for c in b.column_names])
        found = _best_of_tile(a, b) if len(a) and len(b) else None
        return found if found is not None else pa.table({"question": a["question"][:0], "item_id": b["item_id"][:0], "found": b["found"][:0], "score": pa.array([], pa.float64())})

    return _best(left.groupBy(*[f"asks_{k}" for k in keys]).cogroup(right.groupBy(*[f"holds_{k}" for k in keys])).applyInArrow(compare, ", ".join(types)))


def best_works(questions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(question, item_id, found, score): the best of the works that share a DOI of the raw text, the year and a surname, or one of the three rarest words of the title.

    questions: (question, title, names, year, raw_doi); catalogue: (item_id, title, names, year, doi), both prepared. Words are rare
    by the works that hold them. Of works that share year and surname with a question without title, which score alike but for
    a DOI, the first with a DOI and the first without are enough. Blocks of years and surnames come last, as what words found sets a bound.
    """
    works = catalogue.withColumnRenamed("doi", "found")
    held = works.where("title <> ''").select("title", F.explode(F.array_distinct(F.split("title", " "))).alias("word"))
    often = held.groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    titles = questions.where("title <> ''").select("title").distinct()
    asked = titles.select("title", F.explode(F.array_distinct(F.split("title", " "))).alias("word")).join(often, "word")
    nth = F.row_number().over(Window.partitionBy("title").orderBy("often", "word"))
    rare = asked.withColumn("rank", nth).where(F.col("rank") <= RARE_WORDS).select("title", "word")
    ask, hold = ["question", "title", "names", "year", F.lit(-1.0).alias("least")], ["item_id", "found", "title", "names", "year"]
    block = lambda kind, *c: F.concat_ws("\n", F.lit(kind), *c).alias("block")
    named = lambda t, *cols: t.where("year is not null").select("*", F.explode(F.array_distinct("names")).alias("name")).select(*cols)
    first = named(works, "item_id", "found", "year", "name").groupBy("year", "name", F.col("found").isNull()).agg(F.min_by(F.struct("item_id", "found"), "item_id").alias("w"))
    first = first.select(block("u", "year", "name"), "w.*", F.lit("").alias("title"), F.array("name").alias("names"), "year")
    asking = [
        questions.join(rare, "title").select(block("w", "word"), *ask), questions.where("raw_doi is not null").select(block("d", "raw_doi"), *ask),
        named(questions.where("title = ''"), block("u", "year", "name"), *ask),
    ]
    holding = [
        works.where("title <> ''").select(F.explode(F.array_distinct(F.split("title", " "))).alias("word"), *hold).select(block("w", "word"), *hold),
        works.where("found is not null").select(block("d", "found"), *hold), first.select("block", *hold),
    ]
    found = materialize(_best_in_blocks(*(reduce(DataFrame.unionByName, rows) for rows in (asking, holding))), "found")
    bound = questions.where("title <> ''").join(found.select("question", F.col("score").alias("least")), "question", "left")
    others = _best_in_blocks(named(bound, block("n", "year", "name"), *ask[:4], F.coalesce("least", F.lit(-1.0)).alias("least")), named(works, block("n", "year", "name"), *hold))
    return _best(found.unionByName(others))


def resolve_references(references: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(doc_id, ref_id, status, source, item_id, doi, score, confidence, diagnosis) of every reference.

    references: (doc_id, ref_id, title, authors, year, venue, doi, raw_text), ref_id being unique in its document; catalogue: (item_id, title,
    authors, year, doi). A reference with a DOI is resolved by it (source own). Else the best candidate decides (ties by the least
    item_id): with a DOI and 0.70 or more it is resolved, from 0.50 ambiguous (source catalogue), else unresolved. The score is 0.64
    of the titles' similarity, 0.18 for a common surname, 0.12 for the year (half of these where the reference has none), 0.06 for a DOI.
    diagnosis names what an unresolved reference lacks.
    """
    ids = ["doc_id", "ref_id"]
    year = T.reference_year(F.col("year"), F.coalesce("raw_text", F.lit("")))
    names = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), surname), lambda n: n != "")
    raw_doi = T.normalize_doi(F.nullif(F.regexp_extract("raw_text", T.DOI, 1), F.lit("")))
    told = references.select("*", match_title(F.col("title")).alias("_title"), names(F.col("authors")).alias("_names"), year.alias("_year"), raw_doi.alias("_raw_doi"))
    # references that ask for the same are one question
    same = F.md5(F.to_json(F.struct(F.col("_title").alias("title"), F.array_sort(F.array_distinct("_names")).alias("names"), F.col("_year").alias("year"), F.col("_raw_doi").alias("raw_doi"))))
    full = {c: F.coalesce(F.col(c), F.lit("")) != "" for c in ("title", "year", "venue")} | {"authors": F.coalesce(F.size("authors") > 0, F.lit(False)), "raw_text": F.trim(F.coalesce("raw_text", F.lit(""))) != ""}
    complete = sum((F.when(full[c], w).otherwise(0.0) for c, w in FIELDS.items()), F.lit(0.0))
    lacks = [("missing_title", ~full["title"]), ("missing_authors", ~full["authors"]), ("missing_year", F.col("_year").isNull()), ("raw_text_contains_doi", F.col("_raw_doi").isNotNull())]
    told = told.select(
        *ids, "doi", F.when(F.coalesce("doi", F.lit("")) == "", F.unhex(same)).alias("question"), complete.alias("complete"), F.concat_ws(",", *[F.when(c, name) for name, c in lacks]).alias("lacks"),
        F.struct(F.col("_title").alias("title"), F.col("_names").alias("names"), F.col("_year").alias("year"), F.col("_raw_doi").alias("raw_doi")).alias("q"),
    )
    told = materialize(told, "references")
    asking = told.where("question is not null").groupBy("question").agg(F.first("q").alias("q"))
    asking = materialize(asking.select("question", "q.*"), "questions")
    works = catalogue.select("item_id", match_title(F.col("title")).alias("title"), names(F.col("authors")).alias("names"), F.col("year").cast("string").alias("year"), T.normalize_doi(F.col("doi")).alias("doi"))
    best = best_works(asking, materialize(works, "works")).select("question", F.struct("item_id", "found", "score").alias("best"))
    out = told.drop("q").join(best, "question", "left")
    own = F.coalesce("doi", F.lit("")) != ""
    found = F.col("best.found").isNotNull()
    status = F.when(own | found & (F.col("best.score") >= RESOLVED), "resolved").when(found & (F.col("best.score") >= AMBIGUOUS), "ambiguous").otherwise("unresolved")
    sure = F.col("complete") + F.when(F.col("status") == "resolved", STATUS["resolved"]).when((F.col("status") == "ambiguous") & own, STATUS["ambiguous"]).otherwise(0.0)
    why = F.concat_ws(",", F.when(F.col("best").isNull(), "no_candidate").otherwise("low_score"), F.nullif("lacks", F.lit("")))
    hit = F.col("status").isin("resolved", "ambiguous") & ~own
    return out.withColumn("status", status).select(
        *ids, "status", F.when(own, "own").when(hit, "catalogue").otherwise("none").alias("source"), F.when(hit, F.col("best.item_id")).alias("item_id"),
        F.when(own, F.col("doi")).when(hit, F.col("best.found")).alias("doi"), F.round("best.score", 6).alias("score"), F.round(F.least(sure, F.lit(1.0)), 4).alias("confidence"),
        F.when(F.col("status") == "unresolved", why).alias("diagnosis"),
    )
