"""License scans: TF-IDF cosine of lines and licence files to templates, then inheritance down directories.

All of it is DataFrame expressions. A unit of text is a sparse vector of term
counts times inverse document frequency over all documents and templates. The
template of greatest cosine names the licence if the cosine reaches the
threshold. Units are the lines, the blocks of 2 to ``BLOCK`` lines (blank ones
apart) that begin and end with a line of whose terms, plain words apart, at
least half and one are terms of statements and headers, and the whole text of a file that speaks for
its directory.

A line or block without any of a header's anchors, terms without which the
rest of the template cannot reach the threshold, is passed over: by the
Cauchy-Schwarz inequality none of those could match, so the filter drops
nothing. Full licence texts are matched by whole texts and blocks alike, but
only headers have anchors.

A file without a licence of its own takes that of the nearest directory above
it that has a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from herald.llm._common import materialize, text_of

#: Names of public licences and the statements that refer to them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
_SPDX = (
    "Apache-2.0", "MIT", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0",
    "BSD-3-Clause", "MPL-2.0"
)
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this program."
#: Titles, tags and standard headers, which lines and blocks are held against besides.
HEADERS = TEMPLATES + [(s, f"SPDX-License-Identifier: {s}") for s in _SPDX] + [
    ("MIT", "MIT License"), ("MIT", "Licensed under the MIT license"), ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), (
        "LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"
    ), ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("GPL-3.0", _GNU.format("", "3")), ("GPL-2.0", _GNU.format("", "2")), ("LGPL-3.0", _GNU.format("Lesser ", "3")), (
        "LGPL-2.1", _GNU.format("Lesser ", "2.1")
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
]
_FOLDER = Path(__file__).resolve().parent / "licences"


def full_texts() -> list[tuple[str, str]]:
    """The full licence texts of the folder ``licences``, by name."""
    return [(f.stem, f.read_text("utf-8")) for f in sorted(_FOLDER.glob("*.txt"))]


#: Most lines of a block.
BLOCK = 24
#: Names of licence files, in any case.
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
#: Words of any prose, which are anchors only where nothing else will do.
COMMON = {"a", "all", "and", "any", "are", "by", "in", "is", "of", "or", "that", "the", "this", "to", "under", "with", "without"}
#: Further words that no block begins or ends for.
PLAIN = COMMON | {
    "an", "as", "at", "be", "but", "can", "either", "even", "for", "from", "have", "if", "it", "may", "more", "no", "not", "on", "one",
    "see", "should", "so", "such", "which", "will", "whom", "you"
}
#: Terms are runs of these, lower case.
_TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def _terms(text: str) -> Counter:
    return Counter(re.findall(_TERM, text.lower()))


def template_weights(
    templates: list[tuple[str, str]] = TEMPLATES, docs: int = 0, seen: dict[str, int] | None = None
) -> tuple[list[tuple[int, str, str, float]], float]:
    """Rows (template, licence, term, idf, share of the unit vector), and the idf of a term of no template and no document.

    ``seen`` has the number of documents of each template term, of ``docs`` in all.
    """
    counts = [_terms(t) for _, t in templates]
    n = len(counts) + docs
    df = Counter(t for c in counts for t in c)
    df.update({t: k for t, k in (seen or {}).items() if t in df})
    idf = {t: math.log((n + 1) / (k + 1)) + 1 for t, k in df.items()}
    rows = []
    for i, c in enumerate(counts):
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in c.items()))
        rows += [(i, templates[i][0], t, idf[t], k * idf[t] / norm) for t, k in sorted(c.items())]
    return rows, math.log(n + 1) + 1


def anchors(rows: list[tuple], threshold: float) -> list[str]:
    """Terms of which any matching line has one: of each template the heaviest uncommon ones, until the rest is below the threshold."""
    out = set()
    for i in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == i), key=lambda r: (r[2] in COMMON, -r[4], -len(r[2]), r[2]))
        left = 1.0
        for r in own:
            if left < threshold**2 - 1e-9:
                break
            out.add(r[2])
            left -= r[4] ** 2
    return sorted(out)


def _term_list(col: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(_TERM), F.lit(0))


def _frequencies(texts: DataFrame) -> DataFrame:
    """Rows (term, df): of each term the number of rows of ``texts`` that have it."""
    return texts.select(F.explode(F.array_distinct(_term_list("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def match_units(units: DataFrame, rows: list[tuple], docs: int, df: DataFrame, unseen: float, threshold: float = 0.8) -> DataFrame:
    """The best template of each distinct unit of text (column ``unit``) that reaches ``threshold``: (unit, licence, score).

    ``rows`` and ``unseen`` are those of :func:`template_weights`, ``docs`` counts documents and templates, ``df`` has the documents of each term.
    Null units match nothing, equal ones count once, and of equal scores the
    first template counts. An empty table gives none.
    """
    spark: SparkSession = units.sparkSession
    table = spark.createDataFrame(
        [(r[0], r[1], r[2], float(r[3]), float(r[4])) for r in rows], "template int, licence string, term string, idf double, share double"
    )
    # a unit can be a long text, so its terms carry a digest of it
    units = units.select("unit").distinct().withColumn("u", F.unhex(F.md5("unit")))
    counted = units.select("u", F.explode(_term_list("unit")).alias("term")).groupBy("u", "term").agg(F.count("*").alias("k"))
    # the templates are fixed text, so the table has some thousand rows
    idf = F.broadcast(table.select("term", "idf").distinct())
    other = F.log((docs + 1) / (F.col("df") + 1)) + 1
    weighed = counted.join(idf, "term", "left").join(df, "term", "left")
    length = weighed.groupBy("u").agg(F.sqrt(F.sum(F.pow(F.col("k") * F.coalesce("idf", other, F.lit(unseen)), 2))).alias("norm"))
    dot = counted.join(F.broadcast(table), "term").groupBy("u", "template", "licence").agg(
        F.sum(F.col("k") * F.col("idf") * F.col("share")).alias("dot")
    )
    scored = dot.join(length, "u").select(
        "u", "template", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score")
    ).filter(F.col("score") >= threshold)
    best = scored.groupBy("u").agg(F.max_by(F.struct("licence", "score"), F.struct(F.col("score"), -F.col("template"))).alias("b"))
    return units.join(best, "u").select("unit", "b.licence", "b.score")


def _blocks(lines: Column, vocabulary: list[str]) -> Column:
    """Blocks of 2 to ``BLOCK`` of ``lines`` whose first and last have at least half of their terms but plain words, and one, in ``vocabulary``."""
    known = F.array(*[F.lit(t) for t in vocabulary if t not in PLAIN])
    plain = F.array(*[F.lit(t) for t in sorted(PLAIN)])
    like = F.transform(
        lines,
        lambda x: F.arrays_overlap(_term_list(x), known) & (
            2 * F.size(F.array_intersect(_term_list(x), known)) >= F.size(F.array_except(_term_list(x), plain))
        )
    )
    ends = F.filter(F.transform(like, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    return F.flatten(
        F.transform(
            ends,
            lambda i: F.transform(
                F.filter(ends, lambda j: (j > i) & (j < i + BLOCK)), lambda j: F.array_join(F.slice(lines, i + 1, j - i + 1), "\n")
            )
        )
    )


def scan(
    files: DataFrame, threshold: float = 0.8, licence_file: Column | None = None, headers: list[tuple[str, str]] = HEADERS
) -> DataFrame:
    """One row (file_id, path, own_licence, own_score, licence, via, from_dir) for each row of ``files`` (file_id, path, text).

    ``own_licence`` is that of the best line or block of lines, of a file that
    speaks for its directory also of the whole text; on a tie the first by name. ``via`` is ``own``,
    ``inherited`` with the directory in ``from_dir``, or null. Which files
    speak for their directory is ``licence_file``, by default the name; of
    several in a directory the best score decides, then the name of the
    licence. A null text has no licence; a null path inherits nothing. Equal
    rows are each returned. Empty tables are allowed; other columns are not
    read.
    """
    templates = headers + full_texts()
    vocabulary = sorted({t for _, x in headers for t in _terms(x)})
    speaks = F.coalesce(F.regexp_like("path", F.lit(LICENCE_FILE)) if licence_file is None else licence_file, F.lit(False))
    base = files.select(
        F.col("file_id"), F.col("path").cast("string").alias("path"), text_of("text").alias("text")
    ).withColumn("speaks", speaks)
    df = materialize(_frequencies(base))
    n_files = base.count()
    all_terms = sorted({t for _, x in templates for t in _terms(x)})
    wanted = F.broadcast(files.sparkSession.createDataFrame([(t,) for t in all_terms], "term string"))
    # as many rows as the templates have terms
    seen = {r.term: r.df for r in df.join(wanted, "term").collect()}
    rows, unseen = template_weights(templates, n_files, seen)
    any_anchor = r"(?i)(?<![a-z0-9])(" + "|".join(
        re.escape(a) for a in anchors([r for r in rows if r[0] < len(headers)], threshold)
    ) + ")(?![a-z0-9])"
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.regexp_like(x, F.lit(any_anchor)))
    full = F.filter(F.split("text", "\n", -1), lambda x: F.regexp_like(x, F.lit("[A-Za-z0-9]")))
    blocks = F.filter(_blocks(full, vocabulary), lambda x: F.regexp_like(x, F.lit(any_anchor)))
    none_ = F.array().cast("array<string>")
    units = F.when(F.regexp_like("text", F.lit(any_anchor)), F.concat(lines, blocks)).otherwise(none_)
    units = F.array_distinct(F.concat(units, F.when(F.col("speaks"), F.array("text")).otherwise(none_)))
    held = materialize(base.select("file_id", "path", "speaks", units.alias("units")))
    unit = held.select(F.explode("units").alias("unit"))
    found = materialize(match_units(unit, rows, n_files + len(templates), df, unseen, threshold))
    own = held.select("units").distinct().filter(F.size("units") > 0).select("units", F.explode("units").alias("unit")).join(found, "unit")
    own = own.groupBy("units").agg(
        F.min(F.struct((-F.col("score")).alias("s"), F.col("licence").alias("l"))).alias("b")
    ).select("units", F.col("b.l").alias("own_licence"), (-F.col("b.s")).alias("own_score"))
    matched = held.filter(F.size("units") > 0).join(own, "units", "left").select("file_id", "path", "speaks", "own_licence", "own_score")
    none = held.filter(F.size("units") == 0).select(
        "file_id", "path", "speaks", F.lit(None).cast("string").alias("own_licence"), F.lit(None).cast("double").alias("own_score")
    )
    files_ = matched.unionByName(none).withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", ""))

    given = matched.filter(
        "speaks and own_licence is not null and path is not null"
    ).withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", ""))
    given = given.groupBy("dir").agg(
        F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_licence").alias("l"))).alias("b")
    ).select(F.col("dir").alias("above"), F.col("b.l").alias("inherited"))
    # every directory once, with the directories above it, nearest last
    parts = F.split("dir", "/")
    chain = F.concat(
        F.array(F.lit("")),
        F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        )
    )
    up = held.filter("path is not null").select(
        F.regexp_replace("path", r"/?[^/]*$", "").alias("dir")
    ).distinct().select("dir", F.posexplode(chain).alias("depth", "above"))
    near = up.join(given, "above").groupBy("dir").agg(F.max_by(F.struct("above", "inherited"), "depth").alias("n")).select(
        "dir", F.col("n.above").alias("from"), F.col("n.inherited").alias("inherited")
    )
    joined = files_.join(near, "dir", "left")
    licence = F.coalesce("own_licence", "inherited")
    via = F.when(F.col("own_licence").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited")
    return joined.select(
        "file_id", "path", "own_licence", "own_score", licence.alias("licence"), via.alias("via"),
        F.when(via == "inherited", F.col("from")).alias("from_dir")
    )


def documents_as_files(docs: DataFrame) -> DataFrame:
    """``documents`` as files at several depths; a document that opens with a licence statement speaks for its directory.

    The path is ``source/lang/doc_id`` for ids divisible by three, with the
    thousand before doc_id for those that leave 1, and thousand and hundred for
    those that leave 2. Null parts are written ``-``; a null id lies at the
    shallowest place. Rows are kept one by one, other columns are not read.
    """
    n = F.col("doc_id")
    left = F.pmod(n, F.lit(3))
    part = lambda size, test: F.when(test, F.floor(n / size).cast("string"))
    path = F.concat_ws(
        "/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), part(1000, left >= 1), part(100, left == 2),
        F.coalesce(n.cast("string"), F.lit("-"))
    )
    return docs.select(n.alias("file_id"), path.alias("path"), "text")


def opens_with_licence() -> Column:
    """Whether a text's first line names a licence, for tables without file names."""
    return F.regexp_like(F.split_part(F.col("text"), F.lit("\n"), F.lit(1)), F.lit(r"(?i)licen[cs]e"))


def sql(threshold: float = 0.8) -> str:
    """The scan of ``documents`` for DuckDB; the templates' weights are written out."""
    rows, unseen = template_weights()
    values = ", ".join(f"({r[0]}, '{r[1]}', '{r[2]}', {r[3]!r}::DOUBLE, {r[4]!r}::DOUBLE)" for r in rows)
    return rf"""
WITH w(template, licence, term, idf, share) AS (VALUES {values}),
f AS (SELECT doc_id, source || '/' || lang || CASE WHEN doc_id % 3 >= 1 THEN '/' || (doc_id // 1000) ELSE '' END || CASE WHEN doc_id % 3 = 2 THEN '/' || (doc_id // 100) ELSE '' END AS dir, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM f),
u AS (SELECT DISTINCT unit FROM l),
t AS (SELECT unit, unnest(regexp_extract_all(lower(unit), '{_TERM}')) AS term FROM u),
c AS (SELECT unit, term, count(*) AS k FROM t GROUP BY ALL),
n AS (SELECT unit, sqrt(sum(power(k * coalesce(idf, {unseen!r}::DOUBLE), 2))) AS norm FROM c LEFT JOIN (SELECT DISTINCT term, idf FROM w) USING (term) GROUP BY 1),
d AS (SELECT unit, template, licence, sum(k * idf * share) AS dot FROM c JOIN w USING (term) GROUP BY ALL),
s AS (SELECT unit, template, licence, round(dot / norm, 6) AS score FROM d JOIN n USING (unit) WHERE round(dot / norm, 6) >= {threshold}),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY unit ORDER BY score DESC, template) = 1),
o AS (SELECT l.doc_id, b.licence, b.score FROM l JOIN b USING (unit) QUALIFY row_number() OVER (PARTITION BY l.doc_id ORDER BY b.score DESC, b.licence) = 1),
g AS (SELECT f.dir, o.licence FROM o JOIN f USING (doc_id) WHERE regexp_matches(split_part(f.text, chr(10), 1), '(?i)licen[cs]e') QUALIFY row_number() OVER (PARTITION BY f.dir ORDER BY o.score DESC, o.licence) = 1),
p AS (SELECT dir, string_split(dir, '/') AS parts FROM (SELECT DISTINCT dir FROM f)),
a AS (SELECT dir, unnest(range(1, len(parts) + 1)) AS depth, parts FROM p),
h AS (SELECT a.dir, arg_max(g.licence, depth) AS licence, arg_max(g.dir, depth) AS from_dir FROM a JOIN g ON g.dir = array_to_string(a.parts[1:depth], '/') GROUP BY 1)
SELECT f.doc_id, f.dir || '/' || f.doc_id AS path, o.licence AS own_licence, o.score AS own_score, coalesce(o.licence, h.licence) AS licence,
       CASE WHEN o.licence IS NOT NULL THEN 'own' WHEN h.licence IS NOT NULL THEN 'inherited' END AS via,
       CASE WHEN o.licence IS NULL THEN h.from_dir END AS from_dir
FROM f LEFT JOIN o USING (doc_id) LEFT JOIN h ON f.dir = h.dir
"""
