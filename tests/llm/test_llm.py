"""The ten operators on small tables: contracts, brute force, nulls, empties, repeats, clashing columns."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import columns, decontaminate, jaccard, language, licenses, pieces, quality, rules, toxicity, urls

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def _docs(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], schema)


def _prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats, a very long text, and columns whose names clash with results."""
    texts = [(1, None), (2, ""), (3, "  \n "), (4, "One two."), (4, "One two."), (None, "no id"), (6, "wörd " * 30_000)]
    return spark.createDataFrame(
        [(i, t, "en", "s", 0, 1, 2.0, "x") for i, t in texts],
        "doc_id long, text string, lang string, source string, n_words int, n int, score double, bucket string",
    )


def _brute_groups(texts, size, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    group = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * len(sets[a] | sets[b]):
            low, high = sorted((group[a], group[b]))
            group = [low if g == high else g for g in group]
    return {i: (len(sets[i]), group[i]) for i in range(len(texts))}


@pytest.mark.parametrize("size,num,den", [(4, 85, 100), (5, 80, 100)])
def test_jaccard_matches_brute_force(spark, size, num, den):
    rng = random.Random(5)
    texts = [None, "", "a", "a", "A b", "a b"]
    for _ in range(25):
        base = _prose(rng, rng.choice([3, 6, 9, 12, 25, 60, 150])).split()
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3 + len(base) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(_docs(spark, texts), size, num, den).collect()}
    assert got == _brute_groups(texts, size, num, den)


def test_bands_lose_no_link():
    rng = np.random.default_rng(3)
    for num, den in ((85, 100), (80, 100)):
        bands = jaccard.Bands(num, den)
        for n in list(range(1, 60)) + [100, 333, 1000, 4000]:
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            d = bands.distance(2 * n)
            drop = d // 2
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, drop).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if den * both >= num * (len(a) + len(b) - both):
                sig = [set(bands.signatures(x, np.array([len(x)]))[1].tolist()) for x in (a, b)]
                assert sig[0] & sig[1], (n, drop)


def test_hashes_tell_words_apart(spark):
    """A polynomial modulo a power of two gives a Thue-Morse word and its complement one hash."""
    texts = []
    for bits in (3, 6, 10, 11, 12):
        word = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << bits))
        texts += [word, word.translate(str.maketrans("ab", "ba"))]
    texts += ["abcdefgh", "abcdefgha", "abcdefghab", "a" * 256, "a" * 257, "b" + "a" * 256]
    column = columns.pa.array(texts)
    for got in columns.slices(column):
        hashed = columns.hashes(got, columns.words(got, columns.SPACE_WORDS))
        assert len(set(hashed.tolist())) == len(texts) == len(hashed)
    groups = jaccard.similar_groups(_docs(spark, texts)).collect()
    assert all(r.component_id == r.doc_id for r in groups)


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    for n, m in ((300, 310), (300, 500), (40, 41), (2000, 2300)):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: n - 20], rng.integers(0, 1 << 63, m - n + 20).astype(np.uint64)])
        x, y = jaccard.bitmap(a, n // 7), jaccard.bitmap(b, m // 7)
        while len(x) != len(y):
            x, y = (v[: len(v) // 2] ^ v[len(v) // 2 :] if len(v) > min(len(x), len(y)) else v for v in (x, y))
        differ = int(np.unpackbits((x ^ y).view(np.uint8)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_signatures_that_stay_mixed(spark, monkeypatch):
    """Many documents around one passage, in several groups: every link across is found, in blocks of any size."""
    rng = random.Random(9)
    core = _prose(rng, 100).split()
    texts = []
    for _ in range(60):
        copy = list(core)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        texts.append(" ".join(copy))
    expected = _brute_groups(texts, 5, 80, 100)
    assert 1 < len({g for _, g in expected.values()}) < 60
    for block in (2000, 7):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(_docs(spark, texts)).collect()}
        assert got == expected


@pytest.mark.parametrize("count", [12, 40])
def test_near_pairs_keep_every_link(count):
    rng = np.random.default_rng(2)
    core = rng.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    bands, rows = jaccard.Bands(85, 100), []
    for i in range(count):
        gone = rng.permutation(400)[: rng.integers(0, 60)]
        some = np.concatenate([np.delete(core, gone), rng.integers(0, 1 << 63, rng.integers(0, 20)).astype(np.uint64)])
        rows.append(np.unique(some))
    table = columns.pa.table({
        "sig": [1] * count, "low": [0] * count, "high": [0] * count, "own": [0] * count, "doc": list(range(count)), "part": list(range(count)),
        "n": [len(r) for r in rows], "bits": [jaccard.bitmap(r, bands.distance(2 * len(r))).tolist() for r in rows],
    })
    got = jaccard._near_pairs(table, 85, 100)
    found = set(zip(got.column("x").to_pylist(), got.column("y").to_pylist()))
    linked = {(i, j) for i, j in itertools.combinations(range(count), 2) if 100 * len(np.intersect1d(rows[i], rows[j])) >= 85 * len(np.union1d(rows[i], rows[j]))}
    assert linked and linked <= found and len(found) < count * (count - 1) // 2


def test_one_id_with_two_texts(spark):
    a, b = _prose(random.Random(1), 60), _prose(random.Random(2), 60)
    rows = spark.createDataFrame([(5, a), (5, b), (7, a), (9, b), (11, a + " tail"), (3, b + " tail"), (1, "other text")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard.similar_groups(rows).collect()}
    assert got == {(5, 3), (7, 3), (9, 3), (11, 3), (3, 3), (1, 1)}


def test_rules_keep_any_columns(spark):
    good = "The quick brown fox jumps over the lazy dog while seven other animals watch from the green hill beyond the river. " * 1
    texts = [good + _prose(random.Random(i), 60) for i in range(6)] + [None, "", "short text", "buy now " * 60]
    names = ["kept", "good_probability", "base_failed", "votes", "q", "_words", "_text", "row", "n_words", "a.b", "c`d"]
    schema = "doc_id long, text string, " + ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    docs = spark.createDataFrame([(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)], schema)
    docs = docs.union(docs.where("doc_id = 0"))
    got = rules.keep_good(docs)
    assert got.columns == docs.columns
    expected = {r.doc_id for r in rules.judge_quality(docs).collect() if r.kept}
    rows = [tuple(r) for r in got.collect()]
    assert {r[0] for r in rows} == expected and not expected & {6, 7, 8, 9}
    assert all(r[2:] == tuple(f"{n}{r[0]}" for n in names) for r in rows)
    assert sum(r[0] == 0 for r in rows) == (2 if 0 in expected else 0)
    assert rules.keep_good(docs.limit(0)).count() == 0


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(7)
    items = [_prose(rng, n) for n in (30, 12, 10, 4, 1)] + [None, "", "!!"]
    texts = [None, "", items[3].upper(), items[4]]
    for _ in range(30):
        w = _prose(rng, 40).split()
        source = rng.choice(items[:4]).split()
        k = rng.randrange(1, len(source) + 1)
        s = rng.randrange(len(source) - k + 1)
        w[10:10] = source[s : s + k]
        texts.append(", ".join(w))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def words(t):
        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    def brute(t):
        w, hit, found = words(t), set(), set()
        for item, text in enumerate(items):
            v = words(text)
            n = min(10, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add(str(item))
        return len(w), len(hit), sorted(found)

    for block in (32_000_000, 100):  # in one block, in several
        got = decontaminate.find_contamination(_docs(spark, texts), bench, block_chars=block).withColumn("n_hit", decontaminate.n_hit())
        assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in got.collect()} == {i: brute(t) for i, t in enumerate(texts)}
        kept = decontaminate.drop_contaminated(_docs(spark, texts), bench, block_chars=block)
        assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(texts) if not brute(t)[1]}


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces.load()


def test_pieces_match_the_library(vocabulary, tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(pieces.MODEL, "rb").read())
    model.trainer_spec.model_type = 1  # the same pieces and scores as a unigram model
    for p in model.pieces:
        p.score = max(p.score, -40_000.0)  # far scores exceed the library's 32-bit sums
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    library, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.Segmenter(pieces.Pieces.load(str(path)))
    rng = random.Random(1)
    texts = ["", " ", "  a", "a\n\nb", "é∑梦x", "the theatre, theaenes."] + ["".join(rng.choice("thea  nrs,.éß\n") for _ in range(200)) for _ in range(200)]
    for t in texts:
        assert own.encode(t) == library.encode(t)
        assert own.count(t) == len(library.encode(t))
        assert own.decode(own.encode(t)) == t


def test_pieces_by_brute_force(vocabulary):
    small = pieces.Pieces({"▁": 3, "a": 4, "b": 5, "ab": 6, "▁a": 7, "aba": 8, "ba": 9}, {"▁": -2.0, "a": -2.0, "b": -2.0, "ab": -4.0, "▁a": -4.0, "aba": -5.0, "ba": -3.0}, None, 0, ["⁇", "", "", "▁", "a", "b", "ab", "▁a", "aba", "ba"])
    tool = pieces.Segmenter(small)
    names = {v: k for k, v in small.ids.items()}

    def best(marked):
        if not marked:
            return 0.0
        return max([small.scores[p] + best(marked[: -len(p)]) for p in small.scores if marked.endswith(p)] + ([tool.unk_score + best(marked[:-1])] if marked[-1] not in small.scores else []))

    for n in range(7):
        for t in map("".join, itertools.product("abc ", repeat=n) if n < 5 else random.Random(n).sample(list(itertools.product("ab c", repeat=n)), 60)):
            score = sum(tool.unk_score if i == 0 else small.scores[names[i]] for i in tool.encode(t))
            assert score == best(tool.marked(t)) and tool.count(t) == len(tool.encode(t))


def test_pieces_on_odd_rows(odd, vocabulary):
    rows = pieces.encode(odd, vocabulary).collect()
    assert len(rows) == 7 and all(r.round_trip for r in rows)
    assert [len(r.ids) for r in rows if r.doc_id in (1, 2)] == [0, 0]
    back = pieces.decode(pieces.encode(odd, vocabulary), vocabulary).collect()
    assert sorted((r.text for r in back)) == sorted(t or "" for t in [None, "", "  \n ", "One two.", "One two.", "no id", "wörd " * 30_000])
    assert {r.n_pieces for r in pieces.count_pieces(odd, vocabulary).collect()} == {r.n_pieces for r in rows}


def test_other_operators_on_odd_rows(spark, odd):
    groups = jaccard.similar_groups(odd).collect()
    assert len(groups) == 7 and [r.component_id for r in groups if r.doc_id is None] == [None]
    assert [r.component_id for r in groups if r.doc_id == 4] == [4, 4]
    empty = odd.limit(0)
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    found = decontaminate.find_contamination(odd, bench).collect()
    assert len(found) == 7 and [list(r["items"]) for r in found if r.doc_id == 4] == [["1"], ["1"]]
    stats = quality.statistics_table(odd)
    labels = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in quality.score_statistics(stats, quality.fit_quality(stats, labels)).collect()} == {0.5}
    model = language.LanguageModel.fit({"en": "one two three four", "de": "eins zwei drei wörd"})
    named = language.identify_languages(odd, model).collect()
    assert len(named) == 7 and {r.lang_pred for r in named if r.doc_id in (1, 2, 3)} == {"und"}
    assert [r.lang_pred for r in named if r.doc_id == 6] == ["de"]
    judged = rules.judge_quality(odd).collect()
    assert len(judged) == 7 and {r.kept for r in judged if r.doc_id in (1, 2, 3, 4)} == {False}
    scored = toxicity.score_toxicity(odd, toxicity.ToxicityModel({"one": 1.0})).collect()
    assert len(scored) == 7 and len({r.score for r in scored if r.doc_id in (1, 2, 3)}) == 1
    tpl = licenses.template_table(spark)
    files = odd.select(F.col("doc_id").cast("string").alias("path"), "text", F.lit(None).cast("boolean").alias("is_license_file"), "n_words")
    assert {r.origin for r in licenses.scan_licenses(files, tpl).collect()} == {"none"}
    pages = odd.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"), F.lit("x").alias("host"))
    assert {(r.host, r.path, r.verdict) for r in urls.judge_urls(pages, urls.page_outcomes(pages), urls.RULES).collect()} == {("", "", "allow")}
    for df in (
        jaccard.similar_groups(empty), decontaminate.find_contamination(empty, bench.limit(0)), rules.judge_quality(empty),
        language.identify_languages(empty, language.fit_languages(empty)), quality.statistics_table(empty),
        licenses.scan_licenses(files.limit(0), tpl), urls.judge_urls(pages.limit(0), urls.page_outcomes(pages.limit(0)), []),
    ):
        assert df.count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1024])
def test_language_phrases(monkeypatch, block):
    """Phrases of whole texts, read from end to end, whatever the blocks and the texts beside them."""
    monkeypatch.setattr(language, "BLOCK", block)
    rng = np.random.default_rng(5)
    sources = {"a": "abcabd", "b": "xyz", "c": "".join(rng.choice(list("abc "), 300))}
    model = language.LanguageModel.fit(sources)
    texts = ["abcabd", "", "abab", "xyzx", "zzz", "q", "ab xyz", "bdabca" * 700, sources["c"] * 9]
    texts += ["".join(rng.choice(list("abcdxyzq "), n, p=[0.25, 0.2, 0.2, 0.1, 0.1, 0.05, 0.04, 0.01, 0.05])) for n in rng.integers(1, 400, 40)]
    plain = [language.plain_letters(t) for t in texts]
    codes = np.array([model.alphabet.get(c, language.OTHER) for t in plain for c in t], np.uint8)
    got = model.phrases(codes, np.array([len(t) for t in plain]))
    for row, text in zip(got, plain):
        for k, name in enumerate(model.names):
            i = n = 0
            while i < len(text):
                j = i + 1
                while j <= len(text) and text[i:j] in sources[name]:
                    j += 1
                i, n = max(i + 1, j - 1), n + 1
            assert row[k] == n, (text, name)


def test_toxicity_grammar():
    model = toxicity.ToxicityModel({"idiot": 1.0})
    weigh = lambda t: model.features(t)[0]
    assert weigh("you idiot") > weigh("idiot") > weigh("he said idiot") > weigh("he never said not idiot") > 0
    assert weigh("i will kill you") > weigh("kill the process") > 0
    assert weigh("idiotic") == weigh("a clean clause. you") == weigh("") == weigh(None) == 0


def test_toxicity_stems(spark):
    """Words that labels show too seldom share the evidence of their beginning; ordinary beginnings give no stem."""
    ends = [a + b for a in "aeiou" for b in "klmnprst"]
    rows = [(f"w{chr(97 + i % 26)}x today vilm{ends[i % 40]} walks house{ends[i % 40]}", 1) for i in range(80)]
    rows += [(f"w{chr(97 + i % 26)}x today friend{ends[i % 40]} walks house{ends[i % 40]}", 0) for i in range(400)]
    rows = [(" ".join(f"{w} p{ends[(i * 7 + j) % 40]}{ends[i % 40]}" for j, w in enumerate(t.split())), y) for i, (t, y) in enumerate(rows)]
    words, stems = toxicity.learn_insults(spark.createDataFrame([(" ".join(reversed(t.split())), y) for t, y in rows], "text string, label int"))
    assert "vil" in stems and all(s.startswith("vil") for s in stems)
    model = toxicity.ToxicityModel(words, {}, stems=stems)
    assert model.features("you vilmzzz")[0] > 0 and model.features("you evilm, devil friendak houseak") == (0.0, 0.0, 0.0)
    assert toxicity.learn_insults(spark.createDataFrame([], "text string, label int")) == ({}, {})


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    one = quality.op1_quality(spark, sf).where("held_out").join(labels, "doc_id").where("quality is not null")
    assert one.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.95
    four = language.op4_language(spark, sf).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert four.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.97
    ten = toxicity.op10_toxicity(spark, sf).where("held_out").join(labels, "doc_id")
    assert ten.where("toxic = 0 and predicted = 1").count() == 0
    assert ten.where("toxic = 1 and predicted = 1").count() > 0.7 * ten.where("toxic = 1").count()


def test_queries_match_sql(spark):
    import duckdb

    from quire.llm import registry
    from tests.test_queries import _plain

    sf, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations"):
        db.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in registry.SQL.items():
        expected, df = db.sql(sql), registry.QUERIES[name](spark, sf)
        assert _plain([tuple(r) for r in df.collect()], df.columns) == _plain(expected.fetchall(), expected.columns), name


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, left, sf)
        assert after.columns == docs.columns and 0 < after.count() <= left.count(), name
        left = corpus_pipeline.materialize(after, "stage")
    texts = {r.doc_id: r.text for r in left.collect()}
    brute = _brute_groups(list(texts.values()), 5, 80, 100)
    assert all(group == i for i, (n, group) in brute.items() if n)
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == set(texts) and all(r.round_trip for r in out)


def test_pipeline_stages_on_odd_rows(spark, odd):
    """Nulls, empties, repeats, clashing columns and empty tables go through every stage."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    some = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").limit(40)
    rows = some.select("*", *[F.lit(c).alias(c) for c in ("kept", "q", "votes", "row", "component", "x", "stats")])
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0), rows):
            got = stage(spark, docs, sf)
            if name != "SentencePiece encoding":
                assert got.columns == docs.columns and got.count() <= docs.count(), name
            else:
                assert got.count() == docs.count()
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, odd, sf).collect()}
    assert kept == {1, 2, 3, 4, None, 6}
    twice = rows.union(rows)
    for name, stage in corpus_pipeline.STAGES[:4]:
        one, two = stage(spark, rows, sf).count(), stage(spark, twice, sf).count()
        assert two == 2 * one, name


def test_pipeline_stages_stand_alone(spark):
    """A stage's result is whole whatever is called after it: nothing it reads is deleted by another call."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    halves = [docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")]
    for name, stage in corpus_pipeline.STAGES:
        first, second = (stage(spark, half, sf) for half in halves)
        assert second.count() + first.count() <= docs.count() and second.count() > 0, name
