"""Citation linking against brute force."""

import random
import re

from pyspark.sql import functions as F

from quire.functions.similarity import set_ratio
from quire.operators import citations as L

flat = lambda t: " ".join(t.split()).lower()


def _numbers(marker):
    m = re.search(r"\[([0-9,\s\-]+)\]", marker)
    out = []
    for part in re.split(r"\s*,\s*", m.group(1).strip()) if m else []:
        if r := re.match(r"^(\d+)\s*-\s*(\d+)$", part):
            a, b = int(r[1]), int(r[2])
            out += list(range(a, b + 1)) if a <= b and b - a <= 50 else []
        elif part.isdigit():
            out.append(int(part))
    return out


def _refer(cit, refs, raw):
    """refs: {ref_id: (title, year, authors)} of the document."""
    marker, sentence, target = cit[2] or "", cit[3] or "", cit[4] or ""
    once = lambda xs: list(dict.fromkeys(xs))
    known = {t: f"ref_{n:03d}" for n, t in raw if t and f"ref_{n:03d}" in refs}
    if got := [known[t] for t in (p.lstrip("#") for p in re.split(r"[\s,;]+", target)) if t in known]:
        return once(got), "target"
    if got := [r for r in (f"ref_{n:03d}" for n in _numbers(marker)) if r in refs]:
        return once(got), "regex"
    if (m := re.search(r"\[(\d+)\]", marker)) and f"ref_{int(m[1]):03d}" in refs:
        return [f"ref_{int(m[1]):03d}"], "regex"
    names = lambda authors: [a.split(",")[0].strip().lower() for a in authors]
    got = [r for m in re.finditer(L.AUTHOR_YEAR, marker) for r, (_, year, authors) in sorted(refs.items()) if year == m[2] and any(n and n in m[1].lower().strip() for n in names(authors))]
    if got:
        return once(got), "regex"
    held = []
    for r, (title, _, authors) in sorted(refs.items()):
        if len(sentence.strip()) >= 20 and title and len(title) >= 15:
            score = set_ratio(flat(sentence), flat(title))
            if score >= 0.92 or score >= 0.85 and any(n in flat(sentence) for n in names(authors)):
                held.append((score, r))
    held.sort(reverse=True)
    if held and (len(held) == 1 or held[0][0] - held[1][0] >= 0.05):
        return [held[0][1]], "title"
    return [None], "none"


def _place(cit, chunks, sections):
    marker, sentence = cit[2] or "", cit[3] or ""
    own = dict(sections).get(cit[5])
    here = [c for c in chunks if own is not None and c[3] == own]

    def holding(among):
        said = flat(sentence)
        for test in [said] + ([said[:80]] if len(said) > 80 else []) if said else []:
            for c in among:
                if test in flat(c[5]):
                    return c

    def alike(among):
        tokens = lambda t: {w for w in re.findall(r"[a-z0-9]+", t.lower()) if len(w) > 2}
        words = tokens(sentence)
        scores = [(len(words & tokens(c[5])) / len(words) if words else 0, c) for c in among]
        best = max((s for s, _ in scores), default=0)
        return next(c for s, c in scores if s == best) if best >= 0.35 else None

    paragraph = [c for c in here if c[4] == cit[6]]
    if c := holding(here or chunks):
        return c, "sentence"
    if paragraph:
        return next((c for c in paragraph if flat(marker) and flat(marker) in flat(c[5])), paragraph[0]), "paragraph"
    for found, how in ((alike(here or chunks), "overlap"), (holding(chunks), "sentence"), (alike(chunks), "overlap")):
        if found:
            return found, how
    return ((here or chunks)[0], "last_resort") if chunks else (None, None)


def test_linking(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "Gamma", "de", "x1", "network", "supports", "unlike", "extends", "builds on", "outperforms"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    cits, refs, raws, chunks, sections = [], [], [], [], []
    for d in range(40):
        n_refs = rng.choice([0, 3, 6])
        titles = [say(rng.choice([1, 3, 4])) for _ in range(n_refs)]
        refs += [(d, f"ref_{i + 1:03d}", titles[i], rng.choice(["1999", "2001", None]), rng.choice([["Alpha, B", "Smith, J"], ["Li"], [], ["", "Beta"]])) for i in range(n_refs)]
        raws += [(d, i + 1, rng.choice([f"b{i}", "b1", None])) for i in range(n_refs + 1)]
        sections += [(d, s, f"sec_{s:03d}") for s in range(3)]
        texts = [" ".join(say(rng.choice([2, 6, 20])) + "\n" for _ in range(rng.choice([1, 3]))) + rng.choice(["", "[1]"]) for _ in range(rng.choice([0, 1, 6]))]
        chunks += [(d, i, f"chk_{i:03d}", f"sec_{rng.randrange(2):03d}", rng.randrange(2), t, i) for i, t in enumerate(texts)]
        for k in range(8):
            some = rng.choice(texts).split() if texts and rng.random() < 0.6 else say(rng.choice([0, 1, 5, 25])).split()
            at = rng.randrange(len(some) + 1)
            sentence = rng.choice([" ".join(some[at : at + rng.choice([1, 2, 4, 30])]), say(3), "", None, f"{rng.choice(titles or ['q'])} {say(1)}"])
            marker = rng.choice(["[1, 3-5]", "[9]", "[,] [2]", "(Smith et al., 1999)", "Alpha & Li, 2001; Beta 1999", "[5-2]", "[ 2 - 3 ]", "", None])
            cits.append((d, k, marker, sentence, rng.choice([None, "", "#b0 #b1", "b7", "#b2;#b2,b0"]), rng.choice([0, 1, 2, 9]), rng.randrange(3)))
    frame = spark.createDataFrame
    got = L.link_citations(
        frame(cits, "doc_id long, nth int, marker string, sentence string, target string, section_index int, paragraph_index int"),
        frame(refs, "doc_id long, ref_id string, title string, year string, authors array<string>"), frame(raws, "doc_id long, number int, target string"),
        frame(chunks, "doc_id long, place int, chunk_id string, section_id string, paragraph_index int, text string, page int"), frame(sections, "doc_id long, position int, section_id string"),
    ).collect()
    expected, seen = set(), set()
    for c in cits:
        mine = {r[1]: r[2:] for r in refs if r[0] == c[0]}
        ids, how = _refer(c, mine, [r[1:] for r in raws if r[0] == c[0]])
        chunk, where = _place(c, [x for x in chunks if x[0] == c[0]], [s[1:] for s in sections if s[0] == c[0]])
        if chunk is None:
            continue
        context = c[3] or chunk[5][:200]
        counts = [(sum(bool(re.search(p, context, re.I)) for p in ps), name) for name, ps in L.INTENTS.items()]
        most = max(n for n, _ in counts)
        why = (next(name for n, name in counts if n == most), 0.75 if most >= 2 else 0.6) if most else ("background", 0.4) if ids != [None] else (None, None)
        seen |= {how, where}
        expected |= {(c[0], c[1], r, how, chunk[2], chunk[3], where, *why) for r in ids}
    assert {(r.doc_id, r.nth, r.ref_id, r.how, r.chunk_id, r.section_id, r.chunk_how, r.intent, r.intent_confidence) for r in got} == expected and len(got) == len(expected)
    assert seen == {"target", "regex", "title", "none", "sentence", "paragraph", "overlap", "last_resort"}
    assert sorted(r.citation_id for r in got if r.doc_id == 1) == [f"cit_{i + 1:03d}" for i in range(sum(e[0] == 1 for e in expected))]


def test_set_ratio_with_a_least():
    """What is not computed because it cannot reach the least stays below it; all else is exact."""
    from quire.functions.similarity import ratio, set_ratio

    rng = random.Random(19)
    for _ in range(3000):
        a, b = (" ".join(rng.choice(["ab", "abc", "b", "cab", "de", "dé"]) for _ in range(rng.randrange(6))) for _ in range(2))
        x, y = set(a.split()), set(b.split())
        both = " ".join(sorted(x & y))
        one, two = (f"{both} {' '.join(sorted(z - (x & y)))}".strip() for z in (x, y))
        want = 0.0 if not x or not y else 1.0 if both and (x <= y or y <= x) else max([ratio(one, two), *([ratio(both, one), ratio(both, two)] if both else [])])
        assert set_ratio(a, b) == want
        assert (got := set_ratio(a, b, 0.85)) == want or got < 0.85 > want


def test_crowded_linking(spark, monkeypatch):
    """Documents with more citations and chunks than are compared one by one come out the same; words lead to their pairs."""
    monkeypatch.setattr(L, "FEW_PAIRS", 3)
    test_linking(spark)


def test_parts_are_computed_once(spark):
    """Cutting a text names its paragraphs once, not once for every chunk and use."""
    from quire.operators.chunks import chunk_texts

    plan = spark.range(1).select(chunk_texts(F.concat("id", F.lit(" a\n\nb")), 1, 2))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(concat(") <= 2
