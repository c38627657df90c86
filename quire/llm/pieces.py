"""SentencePiece encoding, decoding and counting: a Viterbi search that an Aho-Corasick automaton drives.

The automaton reads a text once. At each position it yields the pieces that end there, the longest first, by
following its output links; each may improve the best score of the position. A later candidate must be
strictly better, so of equal segmentations the one with the longest last piece stands, as in the library.

A piece never holds the space mark after another character in the vocabularies this reads, so every best path
passes through the places where a run of space marks begins: the text falls into units, each solved by itself
and remembered. Where a vocabulary does hold such pieces, the whole text is one unit.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
UNK_PENALTY = 10.0
#: Where the tokenizer's model lies for the driver, which sends its pieces to the executors.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Units of at most so many characters, and about twice so many of them, are remembered by a worker: those met
#: since the last so many new ones, and those met before.
SHORT, REMEMBERED = 64, 250_000
_UNIT = re.compile(rf"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass
class Pieces:
    """The vocabulary: scores of the pieces that match text, ids, the ids of the 256 bytes or none, the unknown id."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int] | None
    unk_id: int
    texts: list[str]
    dummy_prefix: bool = True

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        """Read a SentencePiece model file, its scores taken as those of a unigram model.

        Raises ValueError for models that normalise text by more than marking spaces.
        """
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm = model.normalizer_spec
        if norm.name not in ("", "identity") or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only identity normalisation that keeps white space is supported")
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        ids, scores, texts, unk = {}, {}, [], 0
        byte_ids: dict[int, int] = {}
        for i, p in enumerate(model.pieces):
            texts.append("" if p.type == kind.CONTROL else p.piece)
            if p.type == kind.NORMAL:
                ids[p.piece], scores[p.piece] = i, p.score
            elif p.type == kind.USER_DEFINED:
                raise ValueError("user-defined pieces are not supported")
            elif p.type == kind.UNKNOWN:
                unk = i
                texts[i] = " ⁇ "
            elif p.type == kind.BYTE:
                byte_ids[int(p.piece[3:-1], 16)] = i
        return cls(ids, scores, [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else None, unk, texts, norm.add_dummy_prefix)


    def digest(self) -> str:
        """A hash of all that segments by: equal for equal vocabularies."""
        if not hasattr(self, "_digest"):
            body = repr((self.texts, self.scores, self.byte_ids, self.unk_id, self.dummy_prefix))
            self._digest = hashlib.blake2b(body.encode("utf-8", "surrogatepass")).hexdigest()
        return self._digest


class Segmenter:
    """Encodes, counts and decodes texts with a vocabulary."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.unk_score = min(pieces.scores.values(), default=0.0) - UNK_PENALTY
        self.single = {p for p in pieces.scores if len(p) == 1}
        self.apart = not any(MARK in p.lstrip(MARK) for p in pieces.scores)
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        if pieces.scores:
            self.automaton.make_automaton()
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.counted: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.bytes_of = {i: b for b, i in enumerate(pieces.byte_ids or [])}

    def marked(self, text: str) -> str:
        text = text.replace(" ", MARK)
        return MARK + text if self.pieces.dummy_prefix and text else text

    def units(self, text: str) -> list[str]:
        marked = self.marked(text)
        return _UNIT.findall(marked) if self.apart else [marked] if marked else []

    def _relax(self, unit: str) -> Iterator[tuple[int, int, float, bool]]:
        """(end, start, score, unknown) of every edge, ends rising and for an end the starts rising."""
        at, single = 0, self.single
        if self.pieces.scores:
            for last, (size, score) in self.automaton.iter(unit):
                while at < last:  # positions that no piece ends at
                    if unit[at] not in single:
                        yield at + 1, at, self.unk_score, True
                    at += 1
                yield last + 1, last + 1 - size, score, False
        while at < len(unit):
            if unit[at] not in single:
                yield at + 1, at, self.unk_score, True
            at += 1

    def _solve(self, unit: str) -> tuple[int, ...]:
        best: list[float | None] = [0.0] + [None] * len(unit)
        back = [(0, False)] * (len(unit) + 1)
        for end, start, score, unknown in self._relax(unit):
            before = best[start]
            if before is not None and (best[end] is None or before + score > best[end]):
                best[end] = before + score
                back[end] = (start, unknown)
        out: list[int] = []
        end = len(unit)
        while end:
            start, unknown = back[end]
            out += reversed(self._unknown(unit[start:end])) if unknown else (self.pieces.ids[unit[start:end]],)
            end = start
        return tuple(reversed(out))

    def _unknown(self, char: str) -> list[int]:
        if self.pieces.byte_ids:
            return [self.pieces.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]
        return [self.pieces.unk_id]

    def _count(self, unit: str) -> int:
        """Pieces of the best path, without the path: each position carries its best score and their number."""
        best: list[float | None] = [0.0] + [None] * len(unit)
        pieces = [0] * (len(unit) + 1)
        for end, start, score, unknown in self._relax(unit):
            before = best[start]
            if before is not None and (best[end] is None or before + score > best[end]):
                best[end] = before + score
                pieces[end] = pieces[start] + (len(self._unknown(unit[start:end])) if unknown else 1)
        return pieces[-1]

    def packed(self, text: str | None) -> bytes:
        """Ids of a text as 32-bit numbers; none for null and empty."""
        (fresh, known), out = self.known, []
        for unit in self.units(text or ""):
            ids = fresh.get(unit)
            if ids is None:
                ids = known.get(unit)
                if ids is None:
                    ids = array("i", self._solve(unit)).tobytes()
                if len(unit) <= SHORT:
                    if len(fresh) >= REMEMBERED:
                        fresh, known = self.known = {}, fresh
                    fresh[unit] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null and empty."""
        return array("i", self.packed(text)).tolist()

    def count(self, text: str | None) -> int:
        """len(encode(text)), without the ids."""
        (fresh, known), total = self.counted, 0
        for unit in self.units(text or ""):
            n = fresh.get(unit)
            if n is None:
                n = known.get(unit)
                if n is None:
                    n = self._count(unit)
                if len(unit) <= SHORT:
                    if len(fresh) >= REMEMBERED:
                        fresh, known = self.counted = {}, fresh
                    fresh[unit] = n
            total += n
        return total

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: bytes joined to characters, marks to spaces, the prefix taken off."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            byte = self.bytes_of.get(i)
            if byte is not None:
                held.append(byte)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            out.append(self.pieces.texts[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if self.pieces.dummy_prefix and text.startswith(" ") else text


_here: dict[str, Segmenter] = {}


def _segmenter(shared) -> Segmenter:
    """This worker's segmenter for a broadcast vocabulary; built once, kept over tasks."""
    pieces = shared.value
    key = pieces.digest()
    if key not in _here:
        _here.clear()
        _here[key] = Segmenter(pieces)
    return _here[key]


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_pieces, and whether decoding gives the text back, for each row of docs.

    Null and empty texts have no ids. A text that itself holds the space mark decodes to spaces there, and
    reports round_trip false. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # a tokenizer's vocabulary: some MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _segmenter(shared)
        for batch in batches:
            for a in range(0, len(batch), 200):  # ids are long: few rows to a batch
                part = batch.slice(a, 200)
                texts = part.column(1).to_pylist()
                ids = [tool.packed(t) for t in texts]
                sizes = np.array([0] + [len(x) // 4 for x in ids]).cumsum()
                flat = np.frombuffer(b"".join(ids), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.ListArray.from_arrays(sizes.astype(np.int32), pa.array(flat)),
                        pa.array(np.diff(sizes).astype(np.int64)),
                        pa.array([tool.decode(array("i", x)) == (t or "") for x, t in zip(ids, texts)]),
                    ],
                    ["doc_id", "ids", "n_pieces", "round_trip"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_pieces long, round_trip boolean")


def decode(encoded: DataFrame, pieces: Pieces, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text for each row of ids; null ids give a null text, no ids an empty one."""
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _segmenter(shared)
        for batch in batches:
            texts = [None if x is None else tool.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def count_pieces(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_pieces for each row of docs, by the count-only search; 0 for null and empty texts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _segmenter(shared)
        for batch in batches:
            for a in range(0, len(batch), 1000):
                part = batch.slice(a, 1000)
                counts = [tool.count(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_pieces"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_pieces long")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and whether they decode to the document."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), Pieces.load())


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pieces every document has."""
    return count_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), Pieces.load())
