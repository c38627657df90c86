"""Section labels and chunks against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import chunks as C
from quire.operators import sections as S

VARIANTS = {"introduction": ["Introduction", "overview"], "methodology": ["proposed method", "data"], "results": ["results", "experimental results"], "conclusion": ["conclusion", "concluding remarks"], "references": ["references"]}


def test_variant_scores():
    """Known scores of each rule."""
    assert S.variant_score("results", "results") == 1.0
    assert S.variant_score("remarks concluding", "concluding remarks") == 1.0
    assert S.variant_score("method", "proposed method") == 0.88
    assert S.variant_score("our experimental results here", "experimental results") == 1.0
    assert S.variant_score("data: sources", "data") == 0.93 and S.variant_score("datasets", "data") == 2 * 4 / 12
    assert round(S.variant_score("experimental resultsx", "experimental results"), 4) == round(40 / 41, 4)
    assert S.variant_score("", "data") == 0.0


@pytest.mark.parametrize("header,clean", [("1. Intro  duction", "intro duction"), ("A.3.1 Data", "data"), ("IV) Results", "results"), ("2 - Method", "method"), ("B Ablation x", "ablation x"), ("A. Proof", "proof"), (None, ""), ("  Plain ", "plain")])
def test_clean_header(spark, header, clean):
    assert spark.createDataFrame([(header,)], "h string").select(S.clean_header(F.col("h"))).first()[0] == clean


def _label(rows):
    """One document's sections, in order, one after the other."""
    done = []
    for i, (header, body, level, parent) in enumerate(rows):
        h = header or ""
        for p in S.PREFIXES:
            h = re.sub(p, "", h)
        h, low = re.sub(r"\s+", " ", h).strip().lower(), (body or "").lower()
        best, score = None, 0.0
        for label, vs in VARIANTS.items():
            for v in vs:
                if (s := S.variant_score(h, v.lower())) > score:
                    best, score = label, s
        seen = {x for x, _ in done}
        by_header = next(((label, c) for label, (c, words) in S.HEADER_WORDS.items() if re.search(rf"\b(?:{words})\b", h)), None)
        if score >= 0.70:
            own = (best, round(score if score >= 0.88 else score * 0.85, 4))
        elif by_header:
            own = by_header
        elif "limitation" in low:
            own = ("limitations", 0.55)
        elif "future" in low and ("work" in low or "direction" in low):
            own = ("future_work", 0.5)
        elif parent is not None or level > 1:
            own = ("other", 0.3)
        elif i == 0 and "introduction" not in seen:
            own = ("introduction", 0.7)
        elif i == len(rows) - 1 and "conclusion" not in seen:
            own = ("conclusion", 0.6)
        elif "results" in seen and "discussion" not in seen:
            own = ("discussion", 0.5)
        else:
            own = ("other", 0.3)
        if own[0] == "other" and parent is not None and level > 1 and 0 <= parent < i and not re.search(S.NEVER_INHERITED, h) and done[parent][0] != "other":
            own = (done[parent][0], round(max(min(done[parent][1] * 0.85, 0.65), own[1]), 4))
        done.append(own)
    return done


def test_labels(spark):
    rng = random.Random(1)
    headers = ["1. Introduction", "Propposed method", "Resultz", "A.1 Training", "Xyz", "Zzz abstract", "", None, "Discussion of qq", "2 - Data", "Appendix B", "Qq ww", "Conclusion"]
    bodies = ["", None, "a limitation", "Future directions", "plain"]
    docs = {d: [(rng.choice(headers), rng.choice(bodies), rng.choice([1, 1, 2, 3, 9]), rng.choice([None, None, i - 1, i - 2, i + 1, -1])) for i in range(rng.choice([1, 2, 6, 12]))] for d in range(60)}
    rows = [(d, i, *s, "clash") for d, ss in docs.items() for i, s in enumerate(ss)]
    sections = spark.createDataFrame(rows, "doc_id long, position int, header string, body string, level int, parent int, label string")
    got = {(r.doc_id, r.position): r for r in S.label_sections(sections, VARIANTS).collect()}
    expected = {(d, i): x for d, ss in docs.items() for i, x in enumerate(_label(ss))}
    assert {k: (r.label, r.confidence) for k, r in got.items()} == expected and len({x[0] for x in expected.values()}) >= 8
    assert all(1 <= r.level <= 6 and r.section_id == f"sec_{r.position + 1:03d}" for r in got.values())
    assert S.label_sections(sections.limit(0), VARIANTS).count() == 0


def _chunk(content, least, most):
    words = lambda t: len(t.split())
    merged = []
    for p in [p.strip() for p in (content or "").split("\n\n") if p.strip()]:
        if merged and words(merged[-1]) < least:
            merged[-1] += "\n\n" + p
        else:
            merged.append(p)
    if len(merged) > 1 and words(merged[-1]) < least:
        last = merged.pop()
        merged[-1] += "\n\n" + last
    out = []
    for p in merged:
        runs = []
        for s in [s.strip() for s in re.split(r"(?<=[.!?])\s+", p) if s.strip()] if words(p) > most else [p]:
            if runs and words(runs[-1]) + words(s) <= most:
                runs[-1] += " " + s
            else:
                runs.append(s)
        out += runs
    return out


def test_chunks(spark):
    rng = random.Random(2)
    sentence = lambda: " ".join(rng.choice("ab") for _ in range(rng.choice([1, 3, 9]))) + rng.choice([".", "!", "", ".\n"])
    text = lambda: "\n\n".join(" ".join(sentence() for _ in range(rng.choice([0, 1, 2, 5]))) for _ in range(rng.choice([1, 2, 8])))
    rows = [(d, p, text(), "clash") for d in range(30) for p in range(3)] + [(90, 0, None, "x"), (91, 0, "", "x"), (92, 0, " \n\n \n", "x"), (93, 0, "w " * 100, "x")]
    got = {}
    for r in C.chunk_sections(spark.createDataFrame(rows, "doc_id long, position int, content string, words string"), least=6, most=12).orderBy("doc_id", "reading_order").collect():
        got.setdefault(r.doc_id, []).append((r.position, r.paragraph_index, r.text, r.chunk_id))
    expected = {}
    for d, p, content, _ in rows:
        for k, t in enumerate(_chunk(content, 6, 12)):
            of = expected.setdefault(d, [])
            of.append((p, k, t, f"chk_{len(of):03d}"))
    assert got == expected and max(len(v) for v in got.values()) > 6


def test_score_bound():
    """No score is above its bound, so that none that could count is left out, and a long header is left out by its length."""
    import random

    from quire.operators import sections as S

    rng = random.Random(3)
    vocabulary = ["in", "the", "results", "of", "method", "methods", "und", "das", "related", "work", "a", "x-y", "introduction:"]
    text = lambda most: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(most)))
    for _ in range(4000):
        header, variant = text(8), text(4) or "in the"
        split = header.split()
        bound = S.score_bound(header, set(split), len(" ".join(split)), variant, set(variant.split()))
        assert S.variant_score(header, variant) <= bound, (header, variant)
    long = "a header of many words that no entry holds"
    assert S.score_bound(long, set(long.split()), len(long), "conclusion", {"conclusion"}) < S.TENTATIVE
