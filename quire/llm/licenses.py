"""License scans: lines of files against license templates by TF-IDF cosine, then directories pass licenses down."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.storage import materialize

# What licenses are commonly named by in headers.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MPL-2.0", "This Source Code is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Licensed under CC0 1.0 public domain dedication"),
]
ANCHOR = r"(?i)licen[cs]e|copyright|spdx"
LEAST = 0.6


def _terms(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+"), "")


def match_lines(lines: DataFrame, templates: DataFrame, least: float = LEAST) -> DataFrame:
    """line, license and similarity of each distinct line that a template reaches, the best one of each.

    lines: (line); templates: (license, template). Weights are term counts times ln((1 + n) / (1 + df)) + 1 over
    all distinct lines and templates; only shared terms meet, by a join. Ties go to the first license by name.
    """
    texts = lines.select("line").where("line is not null").distinct()
    parts = texts.select(F.lit(0).alias("side"), "line", F.col("line").alias("body")).unionByName(
        templates.select(F.lit(1).alias("side"), F.col("license").alias("line"), F.col("template").alias("body"))
    )
    counts = parts.select("side", "line", F.explode(_terms(F.col("body"))).alias("term")).groupBy("side", "line", "term").agg(
        F.count(F.lit(1)).alias("tf")
    )
    counts = materialize(counts, "terms")
    n = F.broadcast(counts.select("side", "line").distinct().agg(F.count(F.lit(1)).alias("n_all")))  # one row
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = counts.join(df, "term").join(n).select(
        "side", "line", "term", (F.col("tf") * (F.log((1 + F.col("n_all")) / (1 + F.col("df"))) + 1)).alias("w")
    )
    norms = weighed.groupBy("side", "line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weighed = weighed.join(norms, ["side", "line"]).select("side", "line", "term", (F.col("w") / F.col("norm")).alias("w"))
    ours = weighed.where("side = 0").select("line", "term", F.col("w").alias("a"))
    theirs = weighed.where("side = 1").select(F.col("line").alias("license"), "term", F.col("w").alias("b"))
    return (
        ours.join(theirs, "term")
        .groupBy("line", "license")
        .agg(F.round(F.sum(F.col("a") * F.col("b")), 6).alias("similarity"))
        .groupBy("line")
        .agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("best"))
        .select("line", F.col("best.license").alias("license"), (-F.col("best.s")).alias("similarity"))
        .where(F.col("similarity") >= least)
    )


def scan_licenses(files: DataFrame, templates: DataFrame, least: float = LEAST) -> DataFrame:
    """path, license, similarity, origin and source_path, a row for each row of files.

    files: (path, text, is_license_file). Lines that hold an anchor word (license, copyright, SPDX) are matched;
    a file's own license is its most similar line's, then the first license by name (origin `header`). A
    directory has the license of its license files (the most similar, then the first path); a file without its
    own takes that of the nearest directory above it (origin `inherited`), or none (origin `none`, nulls).
    Equal lines and equal directories are matched once however many files have them.

    A null path has no directory; a null or empty text no header; repeated rows each give their row; a null
    is_license_file counts as false; an empty table gives an empty result.
    """
    rows = files.select("path", "text", F.coalesce("is_license_file", F.lit(False)).alias("is_license_file"))
    own = _own(rows, templates, least)
    keyed = rows.select(
        "path",
        "is_license_file",
        F.xxhash64("text").alias("key"),
        F.expr("left(path, length(path) - length(substring_index(path, '/', -1)) - 1)").alias("dir"),
    )
    headed = keyed.join(own, ["path", "key"], "left")
    return _inherit(materialize(headed, "headers"))


def _inherit(headed: DataFrame) -> DataFrame:
    """Files (path, dir, is_license_file, license, similarity) with what the directories above them give."""
    given = (
        headed.where("is_license_file and license is not null")
        .groupBy("dir")
        .agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license", "path")).alias("best"))
        .select(F.col("dir").alias("above"), F.col("best.license").alias("dir_license"), F.col("best.path").alias("dir_source"), (-F.col("best.s")).alias("dir_similarity"))
    )
    # each directory once, with every directory it lies in: '' is the top
    dirs = headed.select("dir").where("dir is not null").distinct()
    above = dirs.select("dir", F.explode(F.expr("concat(array(''), transform(sequence(1, size(split(dir, '/'))), i -> substring_index(dir, '/', i)))")).alias("above")).distinct()
    nearest = (
        above.join(given, "above")
        .groupBy("dir")
        .agg(F.max(F.struct(F.length("above").alias("depth"), "dir_license", "dir_source", "dir_similarity")).alias("near"))
        .select("dir", "near.*")
    )
    return headed.join(nearest, "dir", "left").select(
        "path",
        F.coalesce("license", "dir_license").alias("license"),
        F.when(F.col("license").isNotNull(), F.col("similarity")).otherwise(F.col("dir_similarity")).alias("similarity"),
        F.when(F.col("license").isNotNull(), "header").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("dir_source")).alias("source_path"),
    )


def _own(rows: DataFrame, templates: DataFrame, least: float) -> DataFrame:
    """path, key (hash of the text), license, similarity of the files whose own lines match."""
    lines = materialize(
        rows.where(F.col("text").rlike(ANCHOR) & F.col("path").isNotNull()).select(
            "path", F.xxhash64("text").alias("key"), F.explode(F.split("text", "\n")).alias("raw")
        )
        .where(F.col("raw").rlike(ANCHOR))
        .select("path", "key", F.trim("raw").alias("line"))
        .distinct(),
        "lines",
    )
    return (
        lines.join(match_lines(lines, templates, least), "line")
        .groupBy("path", "key")
        .agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("best"))
        .select("path", "key", F.col("best.license").alias("license"), (-F.col("best.s")).alias("similarity"))
    )


# Fixed values: (license, a term that no text of it lacks, words); notices, SPDX tags, titles and sentences of the licenses' own texts.
_NAMED = {
    "MIT": "mit", "Apache-2.0": "apache", "GPL-2.0": "gpl", "GPL-3.0": "gpl", "LGPL-2.1": "lgpl", "LGPL-3.0": "lgpl", "AGPL-3.0": "agpl", "MPL-2.0": "mpl",
    "BSD-2-Clause": "bsd", "BSD-3-Clause": "bsd", "ISC": "isc", "CC0-1.0": "cc0", "CC-BY-4.0": "cc", "CC-BY-SA-4.0": "cc", "CC-BY-NC-4.0": "cc",
    "CC-BY-ND-4.0": "cc", "CC-BY-NC-SA-4.0": "cc", "CC-BY-NC-ND-4.0": "cc",
}
_KEYS = {"Apache-2.0": "apache", "MIT": "mit", "MPL-2.0": "mozilla", "BSD-3-Clause": "bsd", "CC0-1.0": "cc0"}
_GNU = [("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3")]
_CC = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
FORMS = (
    [(a, _KEYS.get(a, "cc" if a[:2] == "CC" else "gnu"), t) for a, t in TEMPLATES]
    + [(a, k, f"SPDX-License-Identifier: {a}") for a, k in _NAMED.items()]
    + [(a, "gnu", f"GNU {m}General Public License{v}") for a, m, n in _GNU for v in (f" version {n}", f" v{n}", f" as published by the Free Software Foundation, either version {n} of the License")]
    + [("GPL", "gnu", "GNU General Public License"), ("LGPL", "gnu", "GNU Lesser General Public License"), ("AGPL", "gnu", "GNU Affero General Public License")]
    + [(f"CC-{a}-4.0", "cc", f"CC {a} 4.0") for a, _ in _CC]
    + [(f"CC-{a}-4.0", "attribution", f"{c}{t} 4.0 International") for a, t in _CC for c in ("", "Creative Commons ")]
    + [
        ("CC0-1.0", "cc0", "CC0 1.0 Universal"),
        ("MIT", "mit", "MIT License"),
        ("MIT", "mit", "The MIT License (MIT)"),
        ("MIT", "hereby", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        ("Apache-2.0", "apache", "Apache License"),
        ("Apache-2.0", "apache", "Apache License 2.0"),
        ("Apache-2.0", "apache", "Apache License Version 2.0, January 2004"),
        ("Apache-2.0", "applicable", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
        ("MPL-2.0", "mozilla", "Mozilla Public License Version 2.0"),
        ("MPL-2.0", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
        ("GPL-2.0", "gnu", "GNU General Public License Version 2, June 1991"),
        ("GPL-3.0", "gnu", "GNU General Public License Version 3, 29 June 2007"),
        ("GPL-3.0", "copyleft", "The GNU General Public License is a free, copyleft license for software and other kinds of works"),
        ("LGPL-3.0", "gnu", "GNU Lesser General Public License Version 3, 29 June 2007"),
        ("AGPL-3.0", "gnu", "GNU Affero General Public License Version 3, 19 November 2007"),
        ("BSD-2-Clause", "bsd", "BSD 2-Clause License"),
        ("BSD-3-Clause", "bsd", "BSD 3-Clause License"),
        ("BSD-2-Clause", "redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
        ("BSD-3-Clause", "endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
        ("ISC", "isc", "ISC License"),
        ("ISC", "permission", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted"),
    ]
)
_NOTICE = re.compile(r"Licensed|Released|This |SPDX|.* as published by|Unless|Permission|Redistribution|Neither|CC ")
GATE = r"(?i)licen[cs]e|copyright|spdx|redistribut|hereby\s+granted|creative\s+commons|\bcc0\b|\bcc[ -]by\b"
CLOSE = 0.9
#: A text is a license file if its form is this part of its words (the short licenses' own sentences are), or if a title
#: is its first word or its second: notices and SPDX tags, which open any source file, are no titles.
SHARE, OPENING = 0.1, 2


def _weighed_forms(forms: DataFrame) -> DataFrame:
    """forms with offset (of the key), words (count), weights (term -> tf * idf), norm, and every term's idf as one map."""
    split = forms.groupBy("license", "term", _terms(F.col("template")).alias("body")).agg(F.max("title").alias("title"))
    every = split.agg(F.collect_list("body").alias("bodies"))
    idf = F.expr(
        "map_from_entries(transform(array_distinct(flatten(bodies)), t -> struct(t, ln((1D + size(bodies)) / (1 + size(filter(bodies, b -> array_contains(b, t))))) + 1)))"
    )
    every = every.select(idf.alias("idf"), (F.log(1.0 + F.size("bodies")) + 1).alias("unknown"))
    return split.crossJoin(F.broadcast(every)).select(
        "license", "term", "title", "body", "idf", "unknown", F.size("body").alias("words"), (F.array_position("body", F.col("term")) - 1).cast("int").alias("offset"), F.sqrt(_square(F.col("body"))).alias("norm")
    )


def _square(body: Column) -> Column:
    """Squared length of an array's TF-IDF vector: a term that comes n times adds n times n * idf^2."""
    weight = lambda t: F.coalesce(F.try_element_at("idf", t), "unknown")
    return F.aggregate(body, F.lit(0.0), lambda s, t: s + F.size(F.filter(body, lambda x: x == t)) * weight(t) * weight(t))


def match_texts(texts: DataFrame, forms: DataFrame, least: float = LEAST) -> DataFrame:
    """key, license, similarity, share and opens of each text that a form reaches, the best one of each.

    texts: (key, text), each key once; forms: (license, term, template, title), term being one of the template's. Around
    each place of a form's term in the text, the window of as many words as the form is compared with it, wherever
    lines end: TF-IDF cosine, weights over the forms (ln((1 + n) / (1 + df)) + 1). First come windows of CLOSE
    or more, then those of the most common weight (similarity times the form's length), then the most similar, then licenses by name.
    share is the window's part of the text's words; opens says that a CLOSE title of the same license begins
    among the first OPENING words.
    """
    known = _weighed_forms(forms)
    far = forms.select(F.size(_terms(F.col("template"))).alias("n")).agg(F.max("n").alias("far"), F.lit(0).alias("_")).drop("_")
    keys = forms.agg(F.collect_set("term").alias("keys")).crossJoin(far)
    terms = _terms(F.regexp_replace("text", "(?i)licence", "license"))
    near = F.expr(
        "transform(filter(sequence(0, size(terms) - 1), i -> array_contains(keys, terms[i])), "
        "i -> struct(i AS nth, terms[i] AS term, least(i, far) AS at, slice(terms, greatest(i - far, 0) + 1, 2 * far + 1) AS near))"
    )
    places = (
        texts.where(F.col("text").rlike(GATE))
        .select("key", terms.alias("terms"))
        .where(F.size("terms") > 0)
        .crossJoin(F.broadcast(keys))
        .select("key", F.size("terms").alias("n_terms"), F.explode(near).alias("place"))
        .select("key", "n_terms", "place.*")
    )
    start = F.greatest(F.col("at") - F.col("offset"), F.lit(0))
    end = F.least(F.col("at") - F.col("offset") + F.col("words"), F.size("near"))
    windows = places.join(F.broadcast(known), "term").withColumn("window", F.slice("near", start + 1, end - start))
    weight = lambda t: F.coalesce(F.try_element_at("idf", t), "unknown")
    common = F.aggregate("body", F.lit(0.0), lambda s, t: s + F.size(F.filter("window", lambda x: x == t)) * weight(t) * weight(t))
    scored = windows.withColumn("matched", common / F.sqrt(_square(F.col("window"))))
    scored = scored.withColumn("similarity", F.round(F.col("matched") / F.col("norm"), 6)).where(F.col("similarity") >= least)
    rank = F.struct(
        (F.col("similarity") < CLOSE).alias("loose"), (-F.round("matched", 6)).alias("s"), (-F.col("similarity")).alias("c"), "license", (-F.size("window") / F.col("n_terms")).alias("share")
    )
    opening = F.when((F.col("nth") - F.col("offset") < OPENING) & F.col("title") & (F.col("similarity") >= CLOSE), F.col("license"))
    best = scored.groupBy("key").agg(F.min(rank).alias("best"), F.collect_set(opening).alias("opening"))
    return best.select(
        "key", "best.license", (-F.col("best.c")).alias("similarity"), (-F.col("best.share")).alias("share"), F.array_contains("opening", F.col("best.license")).alias("opens")
    )


def scan_license_texts(files: DataFrame, forms: DataFrame, least: float = LEAST) -> DataFrame:
    """As scan_licenses, but each file's whole text is compared with forms (license, term, template, title) by match_texts.

    files: (path, text) and optionally is_license_file; without it, or where it is null, a text is a license file
    if SHARE of its words are the license's form, or if it opens with its title, however long it is. Equal texts
    are compared once.
    """
    given = F.col("is_license_file") if "is_license_file" in files.columns else F.lit(None).cast("boolean")
    keyed = files.select("path", given.alias("given"), F.sha2("text", 256).alias("key"), _directory().alias("dir"))
    found = match_texts(_gated(files), forms, least)
    headed = keyed.join(found, "key", "left").select(
        "path",
        F.coalesce("given", (F.col("share") >= SHARE) | F.col("opens"), F.lit(False)).alias("is_license_file"),
        "dir",
        F.when(F.col("path").isNotNull(), F.col("license")).alias("license"),
        "similarity",
    )
    return _inherit(materialize(headed, "headers"))


def _gated(files: DataFrame) -> DataFrame:
    """(key, text) of the texts that may hold a form, each once."""
    return files.where(F.col("text").rlike(GATE)).select(F.sha2("text", 256).alias("key"), "text").dropDuplicates(["key"])


def _directory() -> Column:
    return F.expr("left(path, length(path) - length(substring_index(path, '/', -1)) - 1)")


def form_table(spark: SparkSession) -> DataFrame:
    """The forms as a DataFrame (license, term, template, title)."""
    rows = [(a, k, t, not _NOTICE.match(t)) for a, k, t in FORMS]
    return spark.createDataFrame(rows, "license string, term string, template string, title boolean")


def template_table(spark: SparkSession) -> DataFrame:
    """The templates as a DataFrame (license, template)."""
    return spark.createDataFrame(TEMPLATES, "license string, template string")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license of every document.

    documents has no paths: document i of a source lies at source/(i div 1000)/(i div 100)/i, and texts of
    under 400 characters with a license line stand for license files.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.expr("concat_ws('/', coalesce(source, ''), doc_id div 1000, doc_id div 100, doc_id)")
    short = F.length("text") < 400
    found = scan_licenses(docs.select(path.alias("path"), "text", short.alias("is_license_file")), template_table(spark))
    return found.select(F.substring_index("path", "/", -1).cast("long").alias("doc_id"), "path", "license", "similarity", "origin", "source_path")


def op2_licenses_all_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op2_licenses, with every form of FORMS wherever it stands in a text; beyond SQL, tests hold it against known texts.

    Paths differ in depth: a third of the documents lie at source/i, a third at source/(i div 1000)/i and a third
    at source/(i div 1000)/(i div 100)/i; what is a license file, the texts decide.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.expr("concat_ws('/', coalesce(source, ''), if(doc_id % 3 >= 1, doc_id div 1000, null), if(doc_id % 3 = 2, doc_id div 100, null), doc_id)")
    found = scan_license_texts(docs.select(path.alias("path"), "text"), form_table(spark))
    return found.select(F.substring_index("path", "/", -1).cast("long").alias("doc_id"), "path", "license", "similarity", "origin", "source_path")


OP2_SQL = (
    "WITH tpl(license, template) AS (VALUES "
    + ", ".join(f"('{a}', '{b}')" for a, b in TEMPLATES)
    + r"""),
f AS (SELECT doc_id, concat_ws('/', coalesce(source, ''), doc_id // 1000, doc_id // 100, doc_id) AS path,
        concat_ws('/', coalesce(source, ''), doc_id // 1000, doc_id // 100) AS dir, text FROM documents),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM f WHERE text IS NOT NULL),
l AS (SELECT DISTINCT doc_id, trim(raw) AS line FROM l0 WHERE regexp_matches(raw, '(?i)licen[cs]e|copyright|spdx')),
parts AS (SELECT DISTINCT 0 AS side, line, line AS body FROM l UNION ALL SELECT 1, license, template FROM tpl),
c AS (SELECT side, line, term, count(*) AS tf FROM (SELECT side, line, unnest(regexp_extract_all(translate(body,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS term FROM parts) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM c GROUP BY ALL),
nn AS (SELECT count(*) AS n FROM (SELECT DISTINCT side, line FROM c)),
w AS (SELECT side, line, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM c JOIN df USING (term), nn),
u AS (SELECT side, line, term, w / sqrt(sum(w * w) OVER (PARTITION BY side, line)) AS w FROM w),
s AS (SELECT a.line, b.line AS license, round(sum(a.w * b.w), 6) AS similarity FROM u a JOIN u b ON a.term = b.term AND a.side = 0 AND b.side = 1
      GROUP BY ALL),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY line ORDER BY similarity DESC, license) = 1),
own AS (SELECT doc_id, license, similarity FROM l JOIN m USING (line) WHERE similarity >= 0.6
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, license) = 1),
h AS (SELECT f.*, own.license, own.similarity FROM f LEFT JOIN own USING (doc_id)),
g AS (SELECT dir AS above, license AS dl, path AS dp, similarity AS ds FROM h WHERE license IS NOT NULL AND length(text) < 400
      QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, license, path) = 1),
near AS (SELECT d.dir, dl, dp, ds FROM (SELECT DISTINCT dir FROM h) d JOIN g ON d.dir = g.above OR starts_with(d.dir, g.above || '/')
      QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(g.above) DESC) = 1)
SELECT doc_id, path, coalesce(license, dl) AS license, CASE WHEN license IS NOT NULL THEN similarity ELSE ds END AS similarity,
  CASE WHEN license IS NOT NULL THEN 'header' WHEN dl IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN license IS NOT NULL THEN path ELSE dp END AS source_path
FROM h LEFT JOIN near USING (dir)
"""
)
