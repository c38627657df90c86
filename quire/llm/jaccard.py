"""Exact Jaccard join on word n-grams, and the groups that its links form.

Two sets that are similar enough differ in at most d elements, where d follows from their sizes. Sets are put
into bands of similar size; in a band whose largest sets differ by at most d, the hash space is cut into more
than d tiles, so that similar sets agree wholly in at least one tile that is not empty. The hash of a tile's
content is its signature: documents that share one are candidates, and no link is lost. Candidates are held
against each other by hashed bitmaps of their shingles, as long as their sizes need, whose differing bits bound the
overlap from above, and what passes by the exact intersection of the sorted shingle arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import columns as C
from quire.plans.components import connected_components
from quire.plans.storage import discard, materialize, read_back, write_work

#: Texts are taken in runs of whole ones of about so many bytes, which bounds a task's memory.
SLICE_BYTES = 1 << 20
#: Sets that a task remembers so as to sign equal ones only once; beyond it the memory starts anew, which costs
#: some more rows and loses nothing.
REMEMBERED = 200_000
#: Ids that may be broadcast (about 50 MB), counted before; more of them are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Sets and signatures are brought together in so many shares by hash, one after the other: a shuffle, which stays on
#: disk until its table is written, holds one share.
SHARES = 4
#: Documents of one signature that are checked pair by pair against the others in one piece.
BLOCK = 1000
#: Rows of cells that are checked together, about.
CELL_ROWS = 20_000


class Bands:
    """Size bands for similarity num/den, and the tiles of each."""

    def __init__(self, num: int, den: int, ratio: float = 1.5):
        self.num, self.den = num, den
        top = 1
        while self.distance(2 * (top + 1)) == 0:
            top += 1
        tops = [top]
        while tops[-1] < 1 << 40:
            tops.append(max(tops[-1] + 1, int(tops[-1] * ratio)))
        self.tops = np.array(tops, np.int64)
        far = np.array([self.distance(2 * t) for t in tops], np.int64)
        # some tiles more than the pigeonhole needs, for sets that leave tiles empty
        self.spare = np.where(far == 0, 0, np.where(far < 4, 2, 3 + far // 15))
        self.tiles = far + 1 + self.spare

    def distance(self, sizes: int) -> int:
        """Most elements in which two linked sets of so many elements together can differ."""
        return (self.den - self.num) * sizes // (self.den + self.num)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.tops, n, "left")

    def signatures(self, sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the set, signature) for every tile of its band and of those that a larger partner may be in.

        sets: the sorted distinct hashes of one set after the other; sizes: of each, none of them 0.
        """
        own, top = self.of(sizes), self.of(sizes * self.den // self.num)
        found = []
        for step in range(int((top - own).max(initial=0)) + 1):
            chosen = np.flatnonzero(own + step <= top)
            if len(chosen) < len(sizes):
                part = sets[np.repeat(own + step <= top, sizes)]
            else:
                part = sets
            found.append(self._of_band(part, sizes[chosen], own[chosen] + step, chosen))
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])

    def _of_band(self, sets: np.ndarray, sizes: np.ndarray, band: np.ndarray, index: np.ndarray):
        tiles = self.tiles[band]
        base = np.cumsum(tiles) - tiles
        owner = np.repeat(np.arange(len(sizes)), sizes)
        tile = ((sets >> np.uint64(32)) * tiles.astype(np.uint64)[owner]) >> np.uint64(32)
        key = base[owner] + tile.astype(np.int64)  # does not fall, as sets are sorted
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        with np.errstate(over="ignore"):
            content = np.add.reduceat(C.mix(sets), first)
        who = owner[first]
        out_who, out_tile, out_sum = [who], [tile[first]], [content]
        empty = tiles - np.bincount(who, minlength=len(sizes))
        # only empty tiles may be shared by a pair if each of both leaves that many
        for d in np.flatnonzero(empty > self.spare[band]):
            held = np.zeros(tiles[d], bool)
            held[tile[first[who == d]].astype(np.int64)] = True
            rest = np.flatnonzero(~held).astype(np.uint64)
            out_who.append(np.full(len(rest), d))
            out_tile.append(rest)
            out_sum.append(np.zeros(len(rest), np.uint64))
        who, tile, content = (np.concatenate(x) for x in (out_who, out_tile, out_sum))
        with np.errstate(over="ignore"):
            place = C.mix((band[who].astype(np.uint64) << np.uint64(40)) + tile + np.uint64(1))
            return index[who], C.mix(content + place)


def shingle_sets(texts: C.Texts, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of the size-word shingles of each text."""
    found = C.words(texts, C.SPACE_WORDS)
    hashed = C.hashes(texts, found)
    all_grams = C.grams(hashed, size)
    for first, n in zip(found.first.tolist(), found.counts.tolist()):
        if n >= size:
            yield np.unique(all_grams[first : first + n - size + 1])
        elif n:
            yield C.grams(hashed[first : first + n], n)
        else:
            yield np.zeros(0, np.uint64)


def bitmap(grams: np.ndarray, far: int) -> np.ndarray:
    """Which of its bits an odd number of shingles falls on, as longs.

    The bits are a power of two, 6 or more for each element in which a linked set may differ. Two sets differ in
    at least as many elements as their bitmaps in bits, and the halves of a bitmap, xored, are the one of half
    the bits, so those of different length can be compared.
    """
    bits = 64
    while bits < 6 * far:
        bits *= 2
    at = (grams & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    """Arrays of 64-bit numbers as an Arrow column."""
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64)))


def _sketches(docs: DataFrame, bands: Bands, size: int) -> DataFrame:
    """(doc, n, k1, k2, bits, sigs) of each row of (doc, text): how many shingles, a 128-bit hash of their set, its
    bitmap and signatures.

    bits and sigs are null for rows without shingles or doc, and where the task has seen an equal set.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for texts in C.slices(batch.column(1), SLICE_BYTES):
                ids = batch.column(0).slice(texts.first, len(texts))
                sizes, keys, fresh = [], [], []
                kept: list[np.ndarray] = []
                for doc, grams in zip(ids.to_pylist(), shingle_sets(texts, size)):
                    key = hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) and doc is not None else None
                    sizes.append(len(grams))
                    keys.append(key or bytes(16))
                    fresh.append(key is not None and key not in seen)
                    if fresh[-1]:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(key)
                        kept.append(grams)
                bits, signed = [None] * len(sizes), [None] * len(sizes)
                at = np.flatnonzero(fresh)
                if kept:
                    lengths = np.array([len(x) for x in kept], np.int64)
                    who, found = bands.signatures(np.concatenate(kept), lengths)
                    order = np.argsort(who, kind="stable")
                    cuts = np.cumsum(np.bincount(who, minlength=len(kept)))[:-1]
                    for i, grams, some in zip(at.tolist(), kept, np.split(found[order].view(np.int64), cuts)):
                        bits[i], signed[i] = bitmap(grams, bands.distance(2 * len(grams))), some
                blank = pa.array([k == bytes(16) for k in keys])
                halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(sizes, pa.int64()),
                        *[pa.array(np.ascontiguousarray(halves[:, j]), mask=blank.to_numpy(zero_copy_only=False)) for j in (0, 1)],
                        pa.array(bits, pa.list_(pa.int64())),
                        pa.array(signed, pa.list_(pa.int64())),
                    ],
                    ["doc", "n", "k1", "k2", "bits", "sigs"],
                )

    return docs.mapInArrow(sketch, "doc long, n long, k1 long, k2 long, bits array<long>, sigs array<long>")


def _shingles(docs: DataFrame, size: int) -> DataFrame:
    """(doc, grams): the sorted shingles of each row of (doc, text)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in C.slices(batch.column(1), SLICE_BYTES):  # arrays are long: few rows to a batch
                sets = list(shingle_sets(texts, size))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, len(texts)), _lists(sets)], ["doc", "grams"])

    return docs.mapInArrow(measure, "doc long, grams array<long>")


def _may_link(num: int, den: int) -> Column:
    """Whether sizes and bitmaps of sides x and y allow the similarity: the overlap is at most half of what the
    sizes sum to less the differing bits."""
    x, y = (
        f"if(size({a}_bits) > size({b}_bits), zip_with(slice({a}_bits, 1, size({b}_bits)), slice({a}_bits, size({b}_bits) + 1, "
        f"size({b}_bits)), (p, q) -> p ^ q), {a}_bits)"
        for a, b in ("xy", "yx")
    )
    differ = F.expr(f"aggregate(zip_with({x}, {y}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)")
    sizes = F.expr("x_n + y_n")
    near = F.expr(f"{den} * least(x_n, y_n) >= {num} * greatest(x_n, y_n)")  # settles most, before any bit is counted
    return near & (F.lit(den + num) * (sizes - differ) >= F.lit(2 * num) * sizes)


def _rows(offsets: np.ndarray, longs: np.ndarray, at: np.ndarray, width: int, to: int) -> np.ndarray:
    """Bitmaps of `width` longs, a row for each of at, folded to `to` longs."""
    bits = longs[offsets[at][:, None] + np.arange(width)]
    while bits.shape[1] > to:
        bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
    return bits


def _near_pairs(table: pa.Table, num: int, den: int) -> pa.Table:
    """(x, y), x < y, of rows (sig, low, high, own, doc, part, n, bits): pairs that share sig, low and high, are in
    different parts, between the blocks low and high if these differ, and that sizes and bitmaps allow."""
    sig, low, high, own, doc, part, n = (table.column(c).to_numpy() for c in ("sig", "low", "high", "own", "doc", "part", "n"))
    lists = table.column("bits").combine_chunks()
    offsets, longs = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)  # numpy counts bits of a signed number's absolute value
    width = np.diff(offsets)
    order = np.lexsort((doc, high, low, sig))
    sig, low, high, own, doc, part, n, width = (x[order] for x in (sig, low, high, own, doc, part, n, width))
    new = (sig[1:] != sig[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    first = np.flatnonzero(np.concatenate(([True], new)))
    ends = np.repeat(np.append(first[1:], len(sig)), np.diff(np.append(first, len(sig))))  # of each row's cell
    found = []

    def far(left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether bitmaps differ by too much; on any number of axes, the last being longs."""
        differ = np.bitwise_count(left ^ right).sum(-1, dtype=np.int32)
        return (den + num) * (sizes - differ) < 2 * num * sizes

    def held(x: np.ndarray, y: np.ndarray) -> None:
        """Add the pairs of rows x and y that their whole bitmaps allow."""
        wide = width[x] * (1 << 20) + width[y]
        for w in np.unique(wide).tolist():
            p, q = x[wide == w], y[wide == w]
            a, b = w >> 20, w & ((1 << 20) - 1)
            at_once = max(1, 500_000 // max(a, b))
            for j in range(0, len(p), at_once):
                i, k = p[j : j + at_once], q[j : j + at_once]
                near = ~far(_rows(offsets, longs, order[i], a, min(a, b)), _rows(offsets, longs, order[k], b, min(a, b)), n[i] + n[k])
                found.append(np.stack([doc[i[near]], doc[k[near]]]))

    def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether rows are in different parts and blocks, and of like size."""
        like = den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y])
        return like & (part[x] != part[y]) & (doc[x] != doc[y]) & ((low[x] == high[x]) | (own[x] != own[y]))

    large = ends - np.repeat(first, np.diff(np.append(first, len(sig)))) > 16
    at, step = np.flatnonzero(~large), 0
    while len(at):  # rows of small cells against those so many places on
        step += 1
        at = at[at + step < ends[at]]
        ok = apart(at, at + step)
        held(at[ok], at[ok] + step)
    for begin in first[large[first]].tolist():  # rows of a large cell against all later ones, by folded bitmaps first
        end = int(ends[begin])
        size = max(1, int(width[begin:end].min()) // 2)
        bits = np.empty((end - begin, size), np.uint64)
        for w in np.unique(width[begin:end]).tolist():
            own_width = begin + np.flatnonzero(width[begin:end] == w)
            bits[own_width - begin] = _rows(offsets, longs, order[own_width], w, size)
        at_once = max(1, 250_000 // bits.size)
        for i in range(begin, end, at_once):
            rows = np.arange(i, min(i + at_once, end))
            x, y = np.nonzero(~far(bits[rows - begin, None], bits[None, i - begin :], n[rows, None] + n[None, i:end]))
            x, y = x + i, y + i
            x, y = x[x < y], y[x < y]
            ok = apart(x, y)
            held(x[ok], y[ok])
    pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
    return pa.table({"x": pairs[0], "y": pairs[1]})


def _side(table: DataFrame, name: str, *cols: str) -> DataFrame:
    return table.select(F.col("doc").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in cols])


def _hinted(ids: DataFrame) -> DataFrame:
    """A table of one id column to semi-join with long rows: broadcast if counted small, else left to a shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _linked(close: DataFrame, shingles: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (x, y) those that link, by intersecting the sorted arrays; only arrays of their documents travel."""
    needed = close.select(F.explode(F.array("x", "y")).alias("doc")).distinct()
    arrays = shingles.join(needed, "doc", "left_semi")
    full = close.select("x", "y").join(_side(arrays, "y", "grams"), "y").join(_side(arrays, "x", "grams"), "x").select("x", "y", "x_grams", "y_grams")

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(c.offsets.to_numpy(), c.values.to_numpy().view(np.uint64)) for c in (batch.column(2), batch.column(3))]
            ok = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                a, b = (values[at[i] : at[i + 1]] for at, values in parts)
                place = np.searchsorted(a, b)
                both = int((a[np.minimum(place, len(a) - 1)] == b).sum())
                ok[i] = den * both >= num * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(ok))

    return full.mapInArrow(intersect, "x long, y long")


def similar_groups(
    docs: DataFrame,
    size: int = 5,
    num: int = 80,
    den: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: the group that exact links num/den on size-word shingles form.

    A-Z are lower-cased, words are anything but ASCII white space; a text of fewer words than size is one
    shingle; null and empty texts have none and link with nothing. Equal sets link at whatever size and go on as
    their least document. First every candidate is checked against the least document of most of its signatures,
    then against those of the others where that leaves them in different groups; signatures whose documents still
    are in different groups are checked pair by pair across them, so that no link is lost. Groups of near copies,
    however large, are settled by the first steps and never give all their pairs.

    ids are integers. Rows of one id count as one document and share its group, even if their texts differ; a null id gives a null
    component_id. Ties cannot occur; repeated rows each give their row; an empty table gives an empty result;
    other columns are not read.
    """
    spark = docs.sparkSession
    made: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(write_work(df, name))
        return read_back(df, made[-1])

    def keep_shares(make: Callable[[int], DataFrame], name: str) -> DataFrame:
        """One table of all shares."""
        before = len(made)
        shares = [keep(make(k), name) for k in range(SHARES)]
        return spark.read.schema(shares[0].schema).parquet(*[p for p in made[before:] if f"/{name}-" in p])

    def drop(*names: str) -> None:
        for path in [p for p in made if p.rpartition("/")[2].rpartition("-")[0] in names]:
            discard(spark, path)
            made.remove(path)

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    sketches = keep(_sketches(rows, Bands(num, den), size), "sketches")

    # equal sets go on as one, with their least document
    def equal_sets(k: int) -> DataFrame:
        return sketches.where(F.pmod("k1", F.lit(SHARES)) == k).groupBy("k1", "k2").agg(
            F.min("doc").alias("doc"), F.max("n").alias("n"), F.first("bits", True).alias("bits"), F.first("sigs", True).alias("sigs")
        )

    sets = keep_shares(equal_sets, "sets")
    own = sketches.select("doc", "n", "k1", "k2").join(sets.select("k1", "k2", F.col("doc").alias("first")), ["k1", "k2"], "left")
    own = keep(own.select("doc", "n", "first"), "own")
    same = own.where("first <> doc").select(F.col("first").alias("x"), F.col("doc").alias("y"))
    drop("sketches")

    # documents that share a signature with another, each with the least one of that signature
    def sharing(k: int) -> DataFrame:
        drop("least")
        signed = sets.select("doc", F.explode("sigs").alias("sig")).where(F.pmod("sig", F.lit(SHARES)) == k)
        least = signed.groupBy("sig").agg(F.min("doc").alias("x"), F.max("doc").alias("most")).where("x < most").select("sig", "x")
        # the least ones grow with the input: sorted and merged at any size, never broadcast; hot signatures can be split
        least = keep(least, "least").hint("merge")
        return signed.join(least, "sig").select("sig", "x", F.col("doc").alias("y"))

    shared = keep_shares(sharing, "shared")
    star = keep(shared.where("x <> y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("times")), "star")
    some = keep(star.select(F.explode(F.array("x", "y")).alias("doc")).distinct(), "candidates")
    bits = keep(sets.select("doc", "n", "bits").join(some, "doc", "left_semi"), "bits")
    drop("sets", "least")
    near = star.join(_side(bits, "x", "n", "bits"), "x").join(_side(bits, "y", "n", "bits"), "y").where(_may_link(num, den))
    near = keep(near.select("x", "y", "times"), "near")

    def arrays(pairs: DataFrame) -> DataFrame:
        """Shingles of the pairs' documents, from their texts."""
        needed = keep(pairs.select(F.explode(F.array("x", "y")).alias("doc")).distinct(), "needed")
        return _shingles(rows.join(_hinted(needed), "doc", "left_semi").select("doc", "text"), size)

    # the likeliest partner of each first; of the others, what that leaves in different groups
    shingles = keep(arrays(near), "shingles")
    best = near.groupBy("y").agg(F.max(F.struct("times", (-F.col("x")).alias("x"))).alias("best"))
    links = keep(_linked(best.select((-F.col("best.x")).alias("x"), "y"), shingles, num, den), "links")
    others = _apart(near, connected_components(links, "x", "y")).select("x", "y")
    links = keep(links.unionByName(_linked(keep(others, "others"), shingles, num, den)), "links")
    labels = keep(connected_components(links, "x", "y"), "labels")
    drop("shingles", "others")

    # signatures whose documents are still in different groups: all their pairs across groups
    apart = keep(_apart(star, labels).select("x", "y"), "apart")
    across = keep(_across(shared, labels, apart, bits, num, den, keep), "across")
    drop("shared", "parts", "rest", "star", "near")
    links = links.unionByName(_linked(across, keep(arrays(across), "shingles"), num, den))
    groups = keep(connected_components(keep(links.unionByName(same), "links"), "x", "y"), "groups")
    placed = own.join(groups, own.doc == groups.node, "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id")
    )
    out = materialize(placed, "placed")
    for path in made:
        discard(spark, path)
    return out


def _across(shared: DataFrame, labels: DataFrame, apart: DataFrame, bits: DataFrame, num: int, den: int, keep: Callable) -> DataFrame:
    """(x, y), each once, x < y: pairs in different groups that share a signature and that their bitmaps allow, but
    those with the least document of the signature, which are checked before.

    Of signatures with the same documents one is enough. A signature of many documents is cut into blocks, any two
    of which meet in a cell: no signature is one task's work. Cells are dealt out by hash, about CELL_ROWS rows
    together.
    """
    others = shared.where("x <> y")
    split = others.join(apart, ["x", "y"], "left_semi").select("sig").distinct()
    part = labels.select(F.col("node").alias("doc"), "component")
    rest = others.join(split, "sig", "left_semi").select("sig", F.col("y").alias("doc")).join(part, "doc", "left")
    rest = keep(rest.select("sig", "doc", F.coalesce("component", "doc").alias("part")), "parts")
    mixed = (
        rest.groupBy("sig")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.min("part").alias("low"),
            F.max("part").alias("high"),
            *[F.bit_xor(F.xxhash64("doc", F.lit(i))).alias(f"docs{i}") for i in (1, 2)],
        )
        .where("low < high")
        .groupBy("size", "docs1", "docs2")
        .agg(F.min("sig").alias("sig"))
        .select("sig", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    )
    rest = keep(rest.join(mixed, "sig"), "rest")
    groups = 1 + (rest.agg(F.sum("blocks")).first()[0] or 0) // CELL_ROWS
    cells = (
        rest.join(bits, "doc")
        .withColumn("own", F.pmod(F.hash("doc"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("sig", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "doc", "part", "n", "bits")
    )
    dealt = cells.groupBy(F.pmod(F.xxhash64("sig", "low", "high"), F.lit(groups)).alias("cell"))
    met = dealt.applyInArrow(lambda table: _near_pairs(table, num, den), "x long, y long")
    return met.distinct().join(apart, ["x", "y"], "left_anti")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (x, y) whose documents are in different groups so far."""
    x = labels.select(F.col("node").alias("x"), F.col("component").alias("x_part"))
    y = labels.select(F.col("node").alias("y"), F.col("component").alias("y_part"))
    return pairs.join(x, "x", "left").join(y, "y", "left").where(F.coalesce("x_part", "x") != F.coalesce("y_part", "y"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents at 85/100 on 4-word shingles."""
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4, num=85, den=100)


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 3], ' ')) AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
      WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM w UNION SELECT r.node, e.y FROM r JOIN e ON r.reach = e.x)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles,
       (SELECT min(reach) FROM r WHERE r.node = w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id)
"""
