"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import columns as C

#: A k-gram of GRAM words, the least of SPAN consecutive ones: any shared run of GRAM + SPAN - 1 = 10 words is met.
WINDOW, GRAM = 10, 5


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values."""
    size = max(0, len(values) - n + 1)
    low = values[:size].copy()
    for j in range(1, n):
        np.minimum(low, values[j : j + size], out=low)
    return low


def _as_texts(text: str) -> C.Texts:
    return next(C.slices(pa.array([text]), most_bytes=1 << 62))


class Fingerprints:
    """What some benchmark items leave to look for: winnowed fingerprints and the windows themselves.

    windows maps a window's words, joined by a space, to the items that hold it; marks holds for windows of
    full length the least k-gram hash of each, short the hashes of the whole items that are shorter.
    """

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.windows: dict[bytes, tuple[str, ...]] = {}
        marks: list[np.ndarray] = [np.zeros(0, np.uint64)]
        short: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            texts = _as_texts(text or "")
            found = C.words(texts, C.PLAIN_WORDS)
            n = len(found.start)
            if not n:
                continue
            hashed = C.hashes(texts, found)
            size = min(n, window)
            plain = [texts.data[s:e].tobytes() for s, e in zip(found.start, found.end)]
            for i in range(n - size + 1):
                key = b" ".join(plain[i : i + size])
                held = self.windows.get(key, ())
                if str(item) not in held:
                    self.windows[key] = (*held, str(item))
            if size == window:
                marks.append(_least(C.grams(hashed, gram), window - gram + 1))
            else:
                short.setdefault(size, []).append(C.grams(hashed, size))
        self.marks = np.unique(np.concatenate(marks))
        self.short = {n: np.unique(np.concatenate(x)) for n, x in short.items()}

    def candidates(self, hashed: np.ndarray, found: C.Words) -> Iterator[tuple[int, np.ndarray]]:
        """(length, starts) of the word windows that share a fingerprint with an item."""
        if len(self.marks) and len(hashed) >= self.window:
            low = _least(C.grams(hashed, self.gram), self.window - self.gram + 1)
            # neighbouring windows mostly keep the same minimum: look each run of equal ones up once
            run = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
            met = np.repeat(_member(low[run], self.marks), np.diff(np.append(run, len(low))))
            yield self.window, np.flatnonzero(met & C.within(found, self.window))
        for n, known in self.short.items():
            if len(hashed) >= n:
                yield n, np.flatnonzero(_member(C.grams(hashed, n), known) & C.within(found, n))


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def _scan(prints: Fingerprints, column: pa.Array) -> tuple[list[int], list[list[dict]], list[list[str]]]:
    """Words, hit spans and item ids of each text."""
    n_words: list[int] = []
    spans: list[list[dict]] = []
    items: list[list[str]] = []
    for texts in C.slices(column):
        found = C.words(texts, C.PLAIN_WORDS)
        hashed = C.hashes(texts, found)
        hit: dict[int, list[tuple[int, int]]] = {}
        held: dict[int, set[str]] = {}
        for size, starts in prints.candidates(hashed, found):
            for i in starts.tolist():
                key = b" ".join(
                    texts.data[s:e].tobytes() for s, e in zip(found.start[i : i + size], found.end[i : i + size])
                )
                names = prints.windows.get(key)
                if names:  # the words themselves agree, not only their hashes
                    d = int(found.text[i])
                    at = i - int(found.first[d])
                    hit.setdefault(d, []).append((at, at + size))
                    held.setdefault(d, set()).update(names)
        n_words += found.counts.tolist()
        for d in range(len(texts)):
            merged: list[list[int]] = []
            for low, high in sorted(hit.get(d, ())):  # a hit grows over the windows that touch it
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], high)
                else:
                    merged.append([low, high])
            spans.append([{"start": a, "end": b} for a, b in merged])
            items.append(sorted(held.get(d, ())))
    return n_words, spans, items


SCHEMA = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"
_ARROW = [
    pa.int64(),
    pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
    pa.list_(pa.string()),
]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_chars: int = 32_000_000,
) -> DataFrame:
    """id, n_words, spans of hit words (end exclusive, merged) and the items found, a row for each row of docs.

    Words are runs of digits, a-z and characters above ASCII after A-Z are lower-cased. A window is 10
    consecutive words of an item; an item of fewer words is one window. Training and benchmark fingerprints
    meet in each task: the benchmark is cut into blocks of about block_chars characters (a documented bound of
    what one broadcast holds), every document is scanned against every block, and where there is more than
    one block, each row's findings are put together by key afterwards. Each hash match is checked on the words.

    Null or empty texts have no words and no hits; repeated rows each give their row; items with a null id or
    without words are ignored; rows of one item id count as one item; an empty benchmark gives no hits. Other
    columns of docs are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bench = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("body")).where(
        "item is not null and body is not null"
    )
    chars = bench.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    parts = []
    for b in range(blocks):
        block = bench.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        prints = spark.sparkContext.broadcast(Fingerprints([(r.item, r.body) for r in block.collect()]))
        parts.append(_against(rows, prints))
    if blocks == 1:
        return parts[0].drop("key")
    together = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "key").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        (F.count(F.lit(1)) / blocks).cast("int").alias("times"),
    )
    merge = F.expr(
        "aggregate(spans, cast(array() as array<struct<start:bigint,end:bigint>>), (done, x) -> "
        "if(size(done) > 0 and element_at(done, -1).end >= x.start, "
        "concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, "
        "'end', greatest(element_at(done, -1).end, x.end)))), concat(done, array(x))))"
    )
    return together.select(
        "doc_id", "n_words", merge.alias("spans"), "items", F.explode(F.expr("sequence(1, times)")).alias("copy")
    ).drop("copy")


def _against(rows: DataFrame, prints) -> DataFrame:
    keyed = rows.select("doc_id", F.xxhash64("text").alias("key"), "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans, items = _scan(prints.value, batch.column(2))
            arrays = [pa.array(x, t) for x, t in zip((n_words, spans, items), _ARROW)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *arrays], ["doc_id", "key", "n_words", "spans", "items"]
            )

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(scan, f"doc_id {kind}, key long, {SCHEMA}")


def n_hit() -> F.Column:
    """Hit words of a row of find_contamination."""
    return F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.start)")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = 32_000_000) -> DataFrame:
    """The rows of docs that hold no window of any benchmark item, with all their columns.

    One pass over the texts for each block of the benchmark; rows never leave their partition.
    """
    spark = docs.sparkSession
    bench = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    chars = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    at = docs.columns.index("text")
    for b in range(blocks):
        block = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        prints = spark.sparkContext.broadcast(Fingerprints([(r.item_id, r.text) for r in block.collect()]))

        def clean(batches: Iterator[pa.RecordBatch], prints=prints) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans = _scan(prints.value, batch.column(at))[1]
                yield batch.filter(pa.array([not s for s in spans], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every benchmark item in every document."""
    found = find_contamination(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
      WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS g
       FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, lens WHERE len(w) >= m)),
h AS (SELECT doc_id, i, m, item_id FROM dw JOIN bw USING (m, g)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM
        (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM h))
      GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM
        (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN it USING (doc_id)
"""
