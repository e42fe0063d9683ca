"""License scan: Dice coefficient over word bigrams against licence templates (DataFrame operations only).

The templates are few and fixed, so they are literals of the plan: notices, headers and openings, and whole licence
texts. A unit (a line, a run of lines, or the whole text) is compared with a template only if their numbers of distinct
bigrams allow the threshold: 2 * min / (a + b) >= t. A unit at the threshold holds at least t / (2 - t) of the
template's distinct bigrams, and all of its bigrams are bigrams of the text. So each text is read once against a hash
set of all templates' bigrams; only templates of which it has enough are compared with its units, in most texts none.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text
from .fingerprints import let

THRESHOLD = 0.8

# Wording of public licences and of their usual notices.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS '
        "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution."
    ),
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}

FULL = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-3.0", "MIT", "MPL-2.0")


def all_templates() -> dict[str, str]:
    """``TEMPLATES`` and the whole texts in ``license_texts``."""
    folder = resources.files(__package__) / "license_texts"
    return TEMPLATES | {f"{n} text": (folder / f"{n}.txt").read_text("utf-8") for n in FULL}


def template_bigrams(text: str) -> list[str]:
    w = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def _need(b: list[str], threshold: float) -> float:
    """The least number of a template's bigrams in a unit at the threshold, and so the unit's least size."""
    return len(b) * threshold / (2 - threshold) - 1e-9


def _array(items: list[str]) -> Column:
    """One literal, however many items (none holds a line feed)."""
    return F.split(F.lit("\n".join(items)), "\n") if items else F.array().cast("array<string>")


def _words(unit: Column) -> Column:
    """Lower-cased runs of a-z and 0-9."""
    bare = F.trim(F.regexp_replace(F.lower(unit), "[^a-z0-9]+", " "))
    return let(bare, lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, " ")))


def _pairs(w: Column) -> Column:
    return F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))).otherwise(F.array().cast("array<string>"))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _in(x: str, items: list[str]) -> str:
    """SQL: whether ``x`` is one of literals (letters, digits and blanks), which Spark looks up in a hash set."""
    return f"{x} IN (" + ", ".join(f"'{i}'" for i in items) + ")"


def _shared(grams: dict[str, list[str]]) -> Column:
    """The distinct bigrams of the column ``text`` that any template has."""
    every = sorted({x for b in grams.values() for x in b})
    if not every:
        return F.array().cast("array<string>")
    words = "split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ')), ' ')"
    pairs = "CASE WHEN size(w) > 1 THEN transform(sequence(0, size(w) - 2), i -> concat_ws(' ', get(w, i), get(w, i + 1))) ELSE array() END"
    return F.expr(f"array_distinct(filter(get(transform(array({words}), w -> {pairs}), 0), x -> {_in('x', every)}))")


def _possible(grams: dict[str, list[str]], threshold: float) -> Column:
    """The names of the templates of which the column ``shared`` holds what a unit at the threshold needs."""
    enough = [f"CASE WHEN size(filter(shared, x -> {_in('x', b)})) >= {_need(b, threshold):.9f}D THEN {_quoted(name)} END" for name, b in sorted(grams.items()) if b]
    none = F.array().cast("array<string>")
    if not enough:
        return none
    least = min(_need(b, threshold) for b in grams.values() if b)
    return F.when(F.size("shared") >= least, F.expr(f"array_compact(array({', '.join(enough)}))")).otherwise(none)


def _open(grams: dict[str, list[str]], threshold: float) -> Column:
    """array<struct<name, n, need, high, b>>: the possible templates with their numbers of bigrams, the least and the most
    of a unit at the threshold, and the bigrams; names in descending order. One literal, so lambdas are not unrolled."""

    def one(name: str, b: list[str]) -> str:
        high = int(len(b) * (2 - threshold) / threshold + 1e-9)
        return f"named_struct('name', {_quoted(name)}, 'n', {len(b)}, 'need', {_need(b, threshold):.9f}D, 'high', {high}, 'b', split({_quoted(chr(10).join(b))}, '\\n'))"

    every = [one(name, b) for name, b in sorted(grams.items(), reverse=True) if b]
    kind = "array<struct<name:string,n:int,need:double,high:int,b:array<string>>>"
    return F.filter(F.expr(f"CAST(array({', '.join(every)}) AS {kind})"), lambda t: F.array_contains(F.col("possible"), t["name"]))


_HIT = "struct<dice:double,license:string>"


def _best(unit: Column, templates: Column, threshold: float) -> Column:
    """struct<dice, license> of the best of the templates at or above the threshold, else null; ties: the first name.
    ``unit``: words."""

    def score(a):
        n = F.size(a)
        fits = F.filter(templates, lambda t: (n >= t["need"]) & (n <= t["high"]))
        tried = F.transform(fits, lambda t: F.struct((2 * F.size(F.array_intersect(a, t["b"])) / (n + t["n"])).alias("dice"), t["name"].alias("license")))
        return F.reduce(tried, F.lit(None).cast(_HIT), lambda x, y: F.when((y["dice"] >= threshold) & (x.isNull() | (y["dice"] >= x["dice"])), F.struct(y["dice"].alias("dice"), y["license"].alias("license"))).otherwise(x))

    return let(F.array_distinct(_pairs(unit)), score)


def _apart(runs: Column) -> Column:
    """Of runs in order (best first, with from and to), those that share no line with a better one."""
    meets = lambda x: lambda y: (y["from"] <= x["to"]) & (y["to"] >= x["from"])
    return F.reduce(runs, F.slice(runs, 1, 0), lambda out, x: F.when(F.exists(out, meets(x)), out).otherwise(F.concat(out, F.array(x))))


def _runs_of(t: Column, pairs: Column, line: Column, common: Column, threshold: float) -> Column:
    """array<struct<same, dice, license, from, to>>: runs of two lines or more that carry one template.

    ``pairs``: all bigrams in order; ``line``: the line of each word; ``common``: the template's bigrams that occur. A
    line at either end that adds no bigram of the template only lowers the coefficient, so runs begin at lines with
    one. From a start the text is read once: a bigram counts where it first occurs behind it.
    """

    def from_line(places, first):
        def scored(new):
            def step(acc, k):
                x, after = F.get(new, k), F.get(new, k + 1)
                same = acc["same"] + x["hit"].cast("int")
                dice = 2 * same / (k + 1 + t["n"])
                ends = (after.isNull() | (after["to"] > x["to"])) & (x["to"] > first) & (dice >= threshold)
                return F.struct(same.alias("same"), F.greatest(acc["best"], F.when(ends, F.struct(dice.alias("dice"), same.alias("same"), (-x["to"]).alias("back")))).alias("best"))

            none = F.struct(F.lit(0).alias("same"), F.lit(None).cast("struct<dice:double,same:int,back:int>").alias("best"))
            folded = F.reduce(F.sequence(F.lit(0), F.least(F.size(new), t["high"]) - 1), none, step, lambda acc: acc["best"])
            return F.when(F.size(F.filter(new, lambda x: x["hit"])) >= t["need"], folded)

        at = (F.array_position(line, first) - 1).cast("int")
        best = let(let(at, lambda p: F.filter(places, lambda x: (x["at"] >= p) & (x["before"] < p))), scored)
        return let(best, lambda r: F.when(r.isNotNull(), F.struct(r["dice"].alias("dice"), r["same"].alias("same"), t["name"].alias("license"), first.alias("from"), (-r["back"]).alias("to"))))

    def placed(s):
        def one(x, i):
            prior = F.get(s, i - 1)
            return F.struct(x["at"].alias("at"), F.when(prior["b"] == x["b"], prior["at"]).otherwise(-1).alias("before"), F.get(line, x["at"] + 1).alias("to"), F.array_contains(common, x["b"]).alias("hit"))

        return F.sort_array(F.transform(s, one))

    def every(places):
        starts = F.array_distinct(F.transform(F.filter(places, lambda x: x["hit"]), lambda x: F.get(line, x["at"])))
        return F.sort_array(F.array_compact(F.transform(starts, lambda first: from_line(places, first))), asc=False)

    order = F.sort_array(F.transform(pairs, lambda x, i: F.struct(x.alias("b"), i.alias("at"))))
    runs = let(let(let(order, placed), every), _apart)
    return F.transform(runs, lambda x: F.struct(x["same"].alias("same"), x["dice"].alias("dice"), x["license"].alias("license"), x["from"].alias("from"), x["to"].alias("to")))


_RUNS = "array<struct<same:int,dice:double,license:string,from:int,to:int>>"


def _runs(lines: Column, templates: Column, threshold: float) -> Column:
    """Runs of lines over the templates: those with more bigrams in common first, none sharing a line with another."""

    def tried(pairs, line):
        def of(distinct):
            none = F.array().cast(_RUNS)
            found = lambda t: lambda common: F.when(F.size(common) >= t["need"], _runs_of(t, pairs, line, common, threshold).cast(_RUNS)).otherwise(none)
            enough = F.filter(templates, lambda t: F.size(distinct) >= t["need"])
            return F.flatten(F.transform(enough, lambda t: let(F.array_intersect(distinct, t["b"]), found(t))))

        return let(let(F.array_distinct(pairs), of), lambda r: let(F.sort_array(r, asc=False), _apart))

    line = F.flatten(F.transform(lines, lambda w, i: F.array_repeat(i, F.size(w))))
    return let(_pairs(F.flatten(lines)), lambda pairs: let(line, lambda n: tried(pairs, n)))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_hits (lines), licenses (sorted, distinct), best_dice, text_license.

    A line or a whole text carries the template with the largest Dice coefficient of distinct word bigrams (ties: the
    first name in order) if that is ``threshold`` or more; so does a run of two or more lines, where runs that share
    lines with one that has more bigrams in common with its template (ties: the larger coefficient) do not count.
    ``text_license`` is the whole text's, ``licenses`` those of its lines, of runs of its lines and of the whole.
    ``templates``: name -> text, by default ``all_templates()``. Null counts as empty and has no hit; other columns are
    ignored; repeated rows give repeated results; an empty table gives an empty result.
    """
    grams = {name: template_bigrams(t) for name, t in (all_templates() if templates is None else templates).items()}
    rows = id_text(docs, id_col, text_col).withColumn("shared", _shared(grams)).select("doc_id", "text", _possible(grams, threshold).alias("possible"))

    def scanned(templates):
        def units(lines):
            hits = F.array_compact(F.transform(lines, lambda x: _best(x, templates, threshold)))
            return F.struct(hits.alias("hits"), _best(F.flatten(lines), templates, threshold).alias("whole"), _runs(lines, templates, threshold).alias("runs"))

        return units

    lines = F.transform(F.split("text", "\n"), _words)
    found = rows.select("doc_id", F.when(F.size("possible") > 0, let(_open(grams, threshold), lambda t: let(lines, scanned(t)))).alias("f"))
    hits = F.coalesce("f.hits", F.array().cast("array<struct<dice:double,license:string>>"))
    runs = F.coalesce(F.transform("f.runs", lambda x: F.struct(x["dice"].alias("dice"), x["license"].alias("license"))), F.array().cast("array<struct<dice:double,license:string>>"))
    found = found.select("doc_id", hits.alias("hits"), F.col("f.whole").alias("whole"), runs.alias("runs"))
    every = F.array_compact(F.concat("hits", "runs", F.array("whole")))
    return found.select(
        "doc_id",
        F.size("hits").cast("long").alias("n_hits"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(every, lambda x: x["license"]))), "; ").alias("licenses"),
        F.round(F.array_max(F.transform(every, lambda x: x["dice"])), 6).alias("best_dice"),
        F.col("whole.license").alias("text_license"),
    )


def oracle() -> str:
    values = ",\n    ".join("('" + n + "', [" + ", ".join(f"'{b}'" for b in template_bigrams(t)) + "])" for n, t in TEMPLATES.items())
    return rf"""
WITH t(license, b) AS (VALUES
    {values}
), u AS (
  SELECT doc_id, false AS whole, unnest(string_split(coalesce(text, ''), chr(10))) AS unit,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ix FROM documents
  UNION ALL SELECT doc_id, true, coalesce(text, ''), 0 FROM documents
), w AS (
  SELECT doc_id, whole, ix, string_split(trim(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM u
), g AS (
  SELECT doc_id, whole, ix, list_distinct(list_transform(list_zip(w[1:-2], w[2:]), lambda x: x[1] || ' ' || x[2])) AS a FROM w WHERE len(w) > 1
), s AS (
  SELECT doc_id, whole, ix, license, 2 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM g, t
  WHERE len(a) >= len(b) * {THRESHOLD} / {2 - THRESHOLD} AND len(a) <= len(b) * {2 - THRESHOLD} / {THRESHOLD}
), h AS (
  SELECT * FROM s WHERE dice >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id, whole, ix ORDER BY dice DESC, license) = 1
)
SELECT d.doc_id, count(*) FILTER (WHERE NOT whole) AS n_hits,
       coalesce(string_agg(DISTINCT license, '; ' ORDER BY license), '') AS licenses,
       round(max(dice), 6) AS best_dice, max(license) FILTER (WHERE whole) AS text_license
FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id GROUP BY d.doc_id
"""
