"""Manifest, line dedup and the prefix trie against brute force, on odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quire.llm import lines, manifest, prefixes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _part int, rank string, hash string, key string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _write(spark, rows, schema, path, name):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def _documents(seed, n):
    rng = random.Random(seed)
    texts = [None, "", "\n", "a\nb", " A \n\nb\t", "É\né\nx" * 3, "z" * 5000, "a\r\na"]
    rows = [(i, rng.choice(texts), rng.choice(["en", None]), rng.choice(["w", "w", "w", "w", "", None, "é", "v"]), rng.choice([3, None]), 1, "r", "h", "k") for i in range(n)]
    rows += [(None, "a\nb", None, "w", 1, 1, "r", "h", "k"), rows[0], rows[0], (-7, "a\n", "en", None, 2, 1, "r", "h", "k")]
    return rows


def _tree(leaves):
    """The root, and for each leaf its siblings as (before, after)."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for p, i in zip(proofs, at, strict=True):
            run = i - i % 3
            p.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
        nodes = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], proofs


def _leaf(doc_id, text, lang, source, n_chars):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def _manifest(rows):
    by = defaultdict(list)
    for r in rows:
        doc_id, text, lang, source, n_chars = r[:5]
        even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        changed = text.replace("\n", "") if even and text is not None else text
        by[source].append((doc_id is not None, doc_id, _leaf(doc_id, text, lang, source, n_chars), _leaf(doc_id, changed, lang, source, n_chars)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _tree([x[2] for x in sorted(by[s], key=lambda x: (x[0], x[1] or 0, x[2]))]) for s in order}
    if not rows:
        return []
    root, tops = _tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        members = sorted(by[s], key=lambda x: (x[0], x[1] or 0, x[2]))
        for (_, doc_id, leaf, changed), proof in zip(members, trees[s][1], strict=True):
            folded = changed
            for before, after in proof + top:
                folded = sha(before, folded, after)
            out.append((doc_id, leaf, trees[s][0], root, sha(*(b + a for b, a in proof + top)), folded, folded == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 60])
def test_manifest(spark, tmp_path, n):
    rows = _documents(n, n) if n else []
    got = manifest.op11_merkle(spark, _write(spark, rows, DOCS, tmp_path, "documents")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == _manifest(rows)


@pytest.mark.parametrize("height,n", [(1, 200), (2, 85)])
def test_manifest_of_many_blocks(spark, height, n):
    """Rounds of the butterfly, ragged edges included, give the tree that one block would."""
    rows = [(i, f"t{i}", None, "a" if i % 9 else "b", None, 1, "r", "h", "k") for i in range(n)]
    found = manifest.manifest(spark.createDataFrame(rows, DOCS), height=height)
    got = found.select("doc_id", "leaf", "subroot", "root", "proof", manifest.fold(found.leaf, found.proof).alias("folded")).collect()
    expected = {r[0]: r for r in _manifest(rows)}
    assert len(got) == n
    for r in got:
        assert (r.leaf, r.subroot, r.root) == expected[r.doc_id][1:4] and r.folded == r.root
        assert sha(*(p.before + p.after for p in r.proof)) == expected[r.doc_id][4]


@pytest.mark.parametrize("plain", [1000, 2])
def test_line_dedup(spark, tmp_path, monkeypatch, plain):
    """The same with and without salts; repeated rows of one document count once."""
    monkeypatch.setattr(lines, "PLAIN_PLACES", plain)
    rows = _documents(5, 80) + [(3, "only here\nA", None, "w", 1, 1, "r", "h", "k")] * 12
    strip = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            holders[strip(line)].add(r[0])
    expected = []
    for r in rows:
        all_lines = (r[1] or "").split("\n")
        kept = [x for x in all_lines if strip(x) == "" or len(holders[strip(x)]) < 10]
        expected.append((r[0], len(all_lines), len(all_lines) - len(kept), sha("\n".join(kept))))
    got = lines.op12_lines(spark, _write(spark, rows, DOCS, tmp_path, "documents")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(expected, key=repr)
    assert sum(r[2] for r in expected) > 50 and len(holders["only here"]) == 1
    whole = lines.drop_frequent_lines(spark.createDataFrame(rows, DOCS), 2, 2)
    assert set(DOCS.replace(",", "").split()[::2]) <= set(whole.columns) and whole.count() == len(rows)
    assert lines.drop_frequent_lines(spark.createDataFrame([], DOCS)).count() == 0


def _trie(rows):
    own = defaultdict(list)
    digest = lambda role, text: hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(int(c / 5) * 5, [])[:h] + ts[h:])
    members = defaultdict(set)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].add(c)
    out = []
    for node, who in members.items():
        below = [m for m in members if m[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(c for c in who if len(built[c]) == len(node)))
        out.append((
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who), sum(len(m) == len(node) + 1 for m in below),
            sum(not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in below) for m in below),
            sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m), sha(ends),
        ))
    return sorted(out, key=repr)


@pytest.mark.parametrize("run,seed", [(4096, 1), (2, 2), (1, 3)])
def test_prefix_trie(spark, tmp_path, monkeypatch, run, seed):
    """Copies, conversations longer than a block of columns, turnless ones, and lists of ids that are hashed text by text."""
    monkeypatch.setattr(prefixes, "RUN", run)
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["é", "b", "", None])) for c in range(-3, 40) for t in range(rng.choice([1, 2, 3, 4, 9]))]
    rows += [(100 + 5 * c, t, "user", f"turn {t}") for c in range(9) for t in range(23 + c % 3)]
    rows += [(None, 1, "user", "x"), (7, None, "user", "x"), (7, None, None, None), (8, 1, "user", "b"), (8, 1, "user", "b"), (71, 0, "user", "alone")]
    path = _write(spark, rows, "conv_id long, turn long, role string, text string", tmp_path, "conversations")
    got = prefixes.op13_prefixes(spark, path).collect()
    assert sorted((tuple(r) for r in got), key=repr) == _trie(rows)
    assert max(r.depth for r in got) > 16


def test_prefix_trie_of_nothing(spark, tmp_path):
    assert prefixes.op13_prefixes(spark, _write(spark, [], "conv_id long, turn long, role string, text string", tmp_path, "conversations")).count() == 0
