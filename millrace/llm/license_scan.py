"""Licence scan: normalised segments against licence templates by the Dice coefficient of their word bigrams.

Segments of a text are its lines, its paragraphs of more than one line (blank lines part them), and
the whole text if it has more than one paragraph. Texts are normalised to lower-case a-z, 0-9 and
single spaces. With n and m distinct bigrams, Dice is at most 2 min(n, m) / (n + m), so a template
is compared only if t / (2 - t) <= n / m <= (2 - t) / t for the threshold t; a segment that is too
short for every template is left before its bigrams are made.

One pass without a shuffle: the templates are literals, a fixed number of them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short public licence notices.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).strip().split()


def _bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+", " "))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """``doc_id``, ``kind`` (line, paragraph, text), ``line_no`` of the segment's first line from 0, ``license_id``, ``dice``.

    One row for each segment and template with a Dice coefficient of ``threshold`` or more. Null and
    empty texts, and segments or templates under two words, match nothing. Repeated rows give repeated results.
    """
    known = {k: _bigrams(_words(v)) for k, v in sorted((templates or TEMPLATES).items())}
    known = {k: b for k, b in known.items() if b}
    if not known:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit("").alias("kind"), F.lit(0).alias("line_no"), F.lit("").alias("license_id"), F.lit(0.0).alias("dice")).limit(0)
    least = threshold / (2 - threshold)
    shortest = min(len(b) for b in known.values()) * least + 1
    every = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(len(b)).alias("m"), F.array(*map(F.lit, b)).alias("b")) for k, b in known.items()])

    def made(kind: str, i: Column, s: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("line_no"), s.alias("s"))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("l"))
    last = F.size("l") - 1

    def full(i: Column) -> Column:
        return (i >= 0) & (i <= last) & F.get("l", i).rlike(r"[^ \t\r]")

    # Paragraphs lie between the lines that have, and whose neighbour hasn't, more than white space.
    firsts = F.filter(F.sequence(F.lit(0), last), lambda i: full(i) & ~full(i - 1))
    lasts = F.filter(F.sequence(F.lit(0), last), lambda i: full(i) & ~full(i + 1))
    rows = rows.withColumns({"f": firsts, "e": lasts})
    lines = F.transform("l", lambda s, i: made("line", i, s))
    paragraphs = F.zip_with("f", "e", lambda i, j: F.when(j > i, made("paragraph", i, F.array_join(F.slice("l", i + 1, j - i + 1), "\n"))))
    whole = F.array(F.when(F.size("f") > 1, made("text", F.lit(0), F.array_join("l", "\n"))))
    seg = rows.select("doc_id", F.explode(F.concat(lines, paragraphs, whole)).alias("g")).where("g is not null")
    seg = seg.where(F.length("g.s") >= 2 * shortest - 1)
    seg = seg.select("doc_id", "g.kind", "g.line_no", F.split(normalise(F.col("g.s")), " ").alias("w"))
    seg = seg.where(F.size("w") >= max(2, shortest))
    n = F.size("w")
    bigrams = F.array_distinct(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat_ws(" ", F.col("w")[i], F.col("w")[i + 1])))
    seg = seg.select("doc_id", "kind", "line_no", bigrams.alias("b"))
    sized = F.filter(every, lambda t: (F.size("b") >= F.lit(least) * t["m"]) & (F.size("b") * F.lit(least) <= t["m"]))
    dice = F.transform(sized, lambda t: F.struct(t["id"].alias("license_id"), (F.size(F.array_intersect(F.col("b"), t["b"])) * F.lit(2.0) / (F.size("b") + t["m"])).alias("dice")))
    hits = seg.select("doc_id", "kind", "line_no", F.explode(F.filter(dice, lambda d: d["dice"] >= threshold)).alias("h"))
    return hits.select("doc_id", "kind", "line_no", "h.license_id", F.round("h.dice", 6).alias("dice"))


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql() -> str:
    known = {k: _bigrams(_words(v)) for k, v in TEMPLATES.items()}
    rows = ", ".join(f"('{k}', {b!r})" for k, b in known.items())
    return f"""
WITH t(license_id, tb) AS (VALUES {rows}),
l AS (SELECT doc_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS s
      FROM documents, range(1, len(string_split(coalesce(text, ''), chr(10))) + 1) r(i)),
g AS (SELECT doc_id, 'line' AS kind, line_no, s FROM l
      UNION ALL
      SELECT doc_id, 'paragraph', 0, text FROM documents WHERE contains(text, chr(10)) AND NOT regexp_matches(text, '(^|\n)[ \t\r]*(\n|$)')),
w AS (SELECT doc_id, kind, line_no, string_split(trim(regexp_replace(translate(s, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM g),
b AS (SELECT doc_id, kind, line_no, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS b FROM w WHERE len(w) > 1),
d AS (SELECT doc_id, kind, line_no, license_id, 2.0 * len(list_intersect(b, tb)) / (len(b) + len(tb)) AS dice FROM b, t)
SELECT doc_id, kind, CAST(line_no AS INTEGER) AS line_no, license_id, round(CAST(dice AS DOUBLE), 6) AS dice FROM d WHERE dice >= 0.8
"""


#: For texts without blank lines, as in the check's tables.
LICENSE_SQL = _sql()
