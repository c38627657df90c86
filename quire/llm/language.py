"""Language identification by cross-parsing: how few phrases of a language's labelled text make up a document.

A suffix automaton of labelled text knows every substring of it. Reading a document, it takes the longest
phrase it knows, begins anew, and so on; the language whose text gives the fewest phrases, weighed by what
naming one of its phrases costs, wins. Documents are read side by side, a character of each at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.quality import held_out

SPACE, OTHER, PAD = 0, 1, 2
#: Characters of a document that are read side by side with those of others; phrases go on over a block's end.
BLOCK = 1024


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def plain_letters(text: str) -> str:
    """Lower-cased letters; every run of anything else is one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the least automaton of all substrings of text; state 0 is the start."""
    follow: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return follow


@dataclass
class LanguageModel:
    """names, and for each the transitions (states x codes; 0: none) and the bits a phrase costs."""

    names: list[str]
    alphabet: dict[str, int]
    tables: list[np.ndarray]
    bits: np.ndarray

    @classmethod
    def fit(cls, texts: dict[str, str]) -> LanguageModel:
        names = sorted(n for n in texts if texts[n])
        alphabet = {c: i + 3 for i, c in enumerate(sorted({c for n in names for c in texts[n]} - {" "}))} | {" ": SPACE}
        tables = []
        for name in names:
            follow = suffix_automaton(texts[name])
            table = np.zeros((len(follow), len(alphabet) + 2), np.int32)
            for state, out in enumerate(follow):
                for c, to in out.items():
                    table[state, alphabet[c]] = to
            table[:, PAD] = np.arange(len(follow))
            tables.append(table)
        return cls(names, alphabet, tables, np.log2([len(texts[n]) + 1 for n in names]))

    def codes(self) -> np.ndarray:
        """The code of each code point."""
        table = np.where(_letters(), OTHER, SPACE).astype(np.uint8 if len(self.alphabet) < 250 else np.uint16)
        for c, code in self.alphabet.items():
            table[ord(c)] = code
        return table

    def phrases(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Phrases of each language (columns) in each text; the texts' codes follow one another, counts of each.

        Blocks of all texts are read at once, each as if a phrase began with it, and where phrases begin is noted.
        A block is then read again from where the last phrase of the one before ends, until a phrase begins where one
        was noted: from there both readings are the same. Blocks whose beginning that moves are read once more, until none
        does, so that phrases are those of reading each text from end to end.
        """
        out = np.zeros((len(counts), len(self.names)), np.int64)
        if not len(codes):
            return out
        blocks_of = -(-counts // BLOCK)
        owner = np.repeat(np.arange(len(counts)), blocks_of)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks_of) - blocks_of, blocks_of)
        limit = np.cumsum(counts)[owner]
        start = limit - counts[owner] + nth * BLOCK
        end = np.minimum(start + BLOCK, limit)
        later, goes_on = np.flatnonzero(nth > 0), np.flatnonzero(end < limit)  # block later[i] follows goes_on[i]
        sizes = end - start
        order = np.argsort(-sizes, kind="stable")
        place = start[order][:, None] + np.arange(BLOCK)
        real = np.arange(BLOCK) < sizes[order][:, None]
        columns = np.ascontiguousarray(np.where(real, codes[np.minimum(place, len(codes) - 1)], PAD).T)
        falling = -sizes[order]
        for k, table in enumerate(self.tables):
            flat, width = table.ravel(), table.shape[1]
            state = np.zeros(len(owner), np.int32)
            begins = np.zeros(columns.shape, bool)
            for at in range(-int(falling[0])):
                live = int(np.searchsorted(falling, -at, "left"))
                code, here = columns[at, :live], state[:live]
                to = flat[here * width + code]
                stop = to == 0
                # a phrase begins after one ended or after a character that the language lacks, which is one by itself
                begins[at, :live] = stop | (here == 0)
                np.copyto(to, flat[code], where=stop)
                state[:live] = to
            noted = np.zeros(len(codes) + 1, bool)
            noted[place[real]] = begins.T[real]
            before = np.concatenate(([0], np.cumsum(noted)))
            found = before[end] - before[start]
            at_end = np.zeros(len(owner), np.int32)
            at_end[order] = state
            leaves = limit.copy()
            leaves[goes_on], _ = self._read(flat, width, codes, end[goes_on], at_end[goes_on], end[goes_on], limit[goes_on], noted)
            noted_leaves = leaves.copy()
            todo = later
            while len(todo):
                entry = leaves[todo - 1]
                at, begun = self._read(flat, width, codes, entry, np.zeros(len(todo), np.int32), end[todo], limit[todo], noted)
                met = at < end[todo]
                found[todo] = begun + np.where(met, before[end[todo]] - before[np.minimum(at, end[todo])], 0)
                now = np.where(met, noted_leaves[todo], at)
                moved = todo[(now != leaves[todo]) & (end[todo] < limit[todo])]
                leaves[todo] = now
                todo = moved + 1
            out[:, k] = np.bincount(owner, found, len(counts)).astype(np.int64)
        return out

    @staticmethod
    def _read(
        flat: np.ndarray, width: int, codes: np.ndarray, at: np.ndarray, state: np.ndarray, end: np.ndarray, limit: np.ndarray, noted: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Read on from at in state until a phrase begins that is noted or at end or later, or the text's limit:
        that place, and how many phrases began before it."""
        at, state, begun = at.copy(), state.copy(), np.zeros(len(at), np.int64)
        lanes = np.arange(len(at))
        while len(lanes):
            lanes = lanes[at[lanes] < limit[lanes]]
            pos, here = at[lanes], state[lanes]
            code = codes[pos]
            to = flat[here * width + code]
            begins = (to == 0) | (here == 0)
            on = ~(begins & (noted[pos] | (pos >= end[lanes])))
            lanes, to, code, begins = lanes[on], to[on], code[on], begins[on]
            begun[lanes] += begins
            state[lanes] = np.where(to == 0, flat[code], to)
            at[lanes] += 1
        return at, begun

    def identify(self, column: pa.Array) -> tuple[list[str | None], np.ndarray]:
        """The language of each text and how sure it is: und and 0 where there is no letter."""
        lut = self.codes()
        texts = column.to_pylist()
        cost = np.zeros((len(texts), len(self.names)))
        seen = np.zeros(len(texts), bool)
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < 4_000_000):
                size += len(texts[j] or "")
                j += 1
            self._costs([t or "" for t in texts[i:j]], lut, cost[i:j], seen[i:j])
            i = j
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = cost.argmin(1)
        # odds of one bit in eight: neighbouring phrases are far from independent
        odds = np.exp2(-np.minimum((cost - cost.min(1, keepdims=True)) / 8, 500))
        sure = 1 / odds.sum(1)
        return [self.names[b] if s else "und" for b, s in zip(best, seen)], np.where(seen, sure, 0.0)

    def _costs(self, texts: list[str], lut: np.ndarray, cost: np.ndarray, seen: np.ndarray) -> None:
        lowered = [t.lower() for t in texts]
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = lut[points]
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
        # one space for a run of what is no letter, none at the beginning
        begin = np.concatenate((np.ones(min(1, len(owner)), bool), owner[1:] != owner[:-1]))
        before = np.concatenate((np.zeros(min(1, len(codes)), codes.dtype), codes[:-1]))
        keep = (codes != SPACE) | ((before != SPACE) & ~begin)
        codes, owner = codes[keep], owner[keep]
        counts = np.bincount(owner, minlength=len(texts))
        seen[:] = counts > 0
        if not self.names:
            return
        cost[:] = self.phrases(codes, counts) * self.bits


def fit_languages(
    docs: DataFrame, letters: int = 30_000, sample: int = 300, longest: int = 20_000, seed: int = 7
) -> LanguageModel:
    """Learn from rows of docs (doc_id, text, lang) with a lang.

    A bounded sample by parameter: of each language about `sample` documents of at most `longest` characters,
    chosen by a hash of the id, of whose whole texts the first ones up to `letters` letters are taken, as many
    of each language where all have as much. Rows with a null in a column are left out; a language without
    letters is not learned.
    """
    usable = docs.where("doc_id is not null and lang is not null and text is not null").where(
        F.length("text") <= longest
    )
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, sample / n).otherwise(share)
    got: dict[str, list[tuple[float, int, str]]] = {}
    for r in usable.withColumn("draw", draw).where(F.col("draw") < share).select("lang", "draw", "doc_id", "text").collect():
        got.setdefault(r.lang, []).append((r.draw, r.doc_id, r.text))
    whole: dict[str, str] = {}
    for lang, rows in got.items():
        parts, size, known = [], 0, set()
        for _, _, text in sorted(rows):
            plain = plain_letters(text)
            if plain and plain not in known and size < letters:
                known.add(plain)
                parts.append(plain)
                size += len(plain)
        whole[lang] = " ".join(parts)
    return LanguageModel.fit(whole)


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score for each row of docs; null or letterless texts are und with score 0.

    Texts are read whole, from end to end. Of languages that cost the same the first by name is taken; repeated rows each
    give their row; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as `letters` letters a language

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 4096):
                part = batch.slice(a, 4096)
                names, sure = shared.value.identify(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(sure)], ["doc_id", "lang_pred", "score"]
                )

    return rows.mapInArrow(read, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit_languages(docs.where(~held_out(4, 2)))
    return identify_languages(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
