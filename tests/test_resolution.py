"""Entity resolution against brute force."""

import random
import re

import pytest

from quire.operators import resolution as R


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def alike(a, b, percent):
    return bool(a) and bool(b) and 200 * lcs(a, b) >= percent * (len(a) + len(b))


def _texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        text = "".join(rng.choice("abcé ") for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 11, 12, 13, 15, 16, 24, 40])))
        out.append(text)
        for _ in range(rng.choice([0, 1, 2])):  # changed here and there
            at = [rng.randrange(len(text) + 1) for _ in range(1 + len(text) // 9)]
            out.append("".join(c + (rng.choice("xyé") if i in at else "") for i, c in enumerate(text) if rng.random() > 0.06))
    return out


@pytest.mark.parametrize("percent,seed", [(85, 1), (85, 2), (70, 3), (95, 4)])
def test_similar_texts(spark, percent, seed):
    """No pair is lost to the filters, none is made up, whatever the lengths."""
    texts = [(i, i % 2, t) for i, t in enumerate(_texts(seed, 70))] + [(9000, 0, None), (9001, 0, "")]
    rows = spark.createDataFrame(texts, "id long, block int, text string")
    expected = {(i, j) for i, a, s in texts for j, b, t in texts if i < j and a == b and alike(s, t, percent)}
    assert {tuple(r) for r in R.similar_texts(rows, percent).collect()} == expected and len(expected) > 5
    other = [(i, b, t) for i, b, t in texts if i % 3]
    right = spark.createDataFrame([(i + 10_000, b, t) for i, b, t in other], "id long, block int, text string")
    expected = {(i, j + 10_000) for i, a, s in texts for j, b, t in other if a == b and alike(s, t, percent)}
    assert {tuple(r) for r in R.similar_texts(rows, percent, right).collect()} == expected


def norm(text):
    return re.sub(r"[.,;:!?'\"()]+$", "", re.sub(r"\s+", " ", text.strip().lower())).strip()


ALIASES = [("Deep Net", "method", ["DNN", "deep  nets"]), ("Other Net", "method", ["DNN", "on"]), ("Set One", "dataset", ["s1"])]


def _resolve(entities):
    alias = {}
    for canonical, label, variants in ALIASES:
        for v in [canonical, *variants]:
            alias.setdefault(norm(v), (norm(canonical), label))
    best = {}
    for e in entities:
        if e[0] not in best or (e[3], e[1] or "") > (best[e[0]][3], best[e[0]][1] or ""):
            best[e[0]] = e
    best = dict(sorted(best.items()))
    up = {i: i for i in best}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    def join(a, b):
        a, b = sorted((top(a), top(b)))
        up[b] = a

    ok = lambda a, b: a is not None and (a == b or (a, b) in R.COMPATIBLE)
    known = {i: norm(e[1]) for i, e in best.items() if e[1] is not None}
    for i in known:
        for j in known:
            if i < j and known[i] == known[j] and ok(best[i][2], best[j][2]):
                join(i, j)
    groups = {}
    for i, n in known.items():
        if n in alias and ok(best[i][2], alias[n][1]):
            groups.setdefault(alias[n], []).append(i)
    for members in groups.values():
        for i in members[1:]:
            join(members[0], i)
    size = lambda i: sum(top(j) == top(i) for j in best)
    single = [i for i in known if size(i) == 1]
    key = lambda i: " ".join(sorted(known[i].split()))
    pairs = [(i, j) for i in single for j in single if i < j and best[i][2] is not None and best[i][2] == best[j][2] and alike(key(i), key(j), 85)]
    for i, j in pairs:
        join(i, j)
    told = {}
    for i in best:
        others = [j for j in best if j != i and top(j) == top(i)]
        how = None if not others else "exact" if any(known.get(j) == known[i] for j in others) else "alias" if known[i] in alias else "fuzzy"
        told[i] = (top(i), how)
    return told


def test_resolution(spark):
    rng = random.Random(3)
    texts = ["Deep Net", "dnn.", "deep nets", "Set One", "s1", "On", "Other net", "graph search engine", "engine graph searcx", "engine graf search", "alpha beta gamma", "beta  gamma alphas", "(x)", "X(", None]
    labels = ["method", "tool", "dataset", "gene_protein", "person", "organization", None]
    rows = [(i, rng.choice(texts), rng.choice(labels), rng.choice([0.5, 0.9])) for i in range(60)]
    rows += [rows[3], (5, "graph search engine", "other", 0.95), (100, "lonely words here", "other", 0.4), (101, "lonely word here", "other", 0.6), (102, "word here lonely", "metric", 0.6)]
    entities = spark.createDataFrame(rows, "entity_id long, text string, label string, confidence double")
    members = R.resolve_entities(entities, R.alias_table(spark, ALIASES))
    got = {r.entity_id: (r.cluster_id, r.method) for r in members.collect()}
    assert got == _resolve(rows) and {m for _, m in got.values()} == {"exact", "alias", "fuzzy", None}
    described = {r.cluster_id: r for r in R.entity_clusters(members).collect()}
    assert set(described) == {c for c, m in got.values() if m} and described[100].method == "fuzzy" and described[100].canonical_text == "lonely words here"
    assert R.resolve_entities(entities.limit(0), R.alias_table(spark, ALIASES)).count() == 0
