"""License scans: word-bigram Dice against templates, in DataFrame functions alone.

A text is normalised to lower-case words of letters and digits, whatever its lines. A template can reach the
threshold only where the text holds a certain share of its bigrams: Dice d of a window needs sizes within the factor d / (2 - d) of each
other, and so as large a share in common. In texts that hold it every window of the template's length is looked at, at the text's end also shorter ones:
the window moves by one bigram, and the counts of distinct bigrams change by the one that leaves and the one that enters.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selfsim.llm.common import texts_of

DICE = 0.8
#: The place after a bigram's last one in a text.
NEVER = 2**31 - 1
#: Notices by which texts state their licence, whole short licences, and passages that only one long licence has.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "\"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
)


def words_of(text: str) -> list[str]:
    return re.sub("[^A-Za-z0-9]+", " ", text).strip().lower().split(" ")


def compiled(templates: tuple[tuple[str, str], ...], least: float) -> list[tuple[int, str, list[str], int, int, int]]:
    """(number, name, distinct bigrams, bigrams of a window, least and most distinct bigrams of a window) of the templates of two words or more."""
    out = []
    for k, (name, text) in enumerate(templates):
        w = words_of(text)
        own = list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))
        if own:
            out.append((k, name, own, len(w) - 1, math.ceil(len(own) * least / (2 - least) - 1e-9), math.floor(len(own) * (2 - least) / least + 1e-9)))
    return out


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once, however often it is read."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) within a row's expression, the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = DICE) -> DataFrame:
    """(doc_id, license, dice, first_word, n_matches), a row for each row of docs.

    license is that of the template whose best window has the largest Dice of at least ``least``
    (ties: the template earlier in the list, then a window that begins with one of its bigrams, then the earlier window), dice is
    rounded to six places, first_word counts the window's place in words from 0, n_matches the templates that reach it. Without any:
    null, null, -1, 0; so for null, empty and one-word texts. Repeated rows and null ids stay; other columns are not read.
    """
    known = compiled(templates, least)
    none = F.lit(None)
    df = texts_of(docs)
    if not known:
        return df.select("doc_id", none.cast("string").alias("license"), none.cast("double").alias("dice"), F.lit(-1).cast("long").alias("first_word"), F.lit(0).cast("long").alias("n_matches"))
    one = lambda k, name, own, size, lo, hi: F.struct(F.lit(-k).alias("k"), F.lit(name).alias("name"), F.array(*map(F.lit, own)).alias("own"), F.lit(size).alias("size"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
    all_of, every = F.array(*[one(*t) for t in known]), sorted({b for t in known for b in t[2]})
    w = F.split(F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " "))), " ")
    df = held(df.select("doc_id", w.alias("w")), "bg", F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))).drop("w")
    df = held(df, "hits", F.array_distinct(F.filter("bg", lambda b: b.isin(every))))
    df = held(df, "near", F.filter(all_of, lambda t: (F.size("hits") >= t["lo"]) & (F.size(F.array_intersect("hits", t["own"])) >= t["lo"])))

    # where each bigram's equals before and after it stand, by place; only in texts that are near a template
    df = held(df, "same", F.when(F.size("near") > 0, F.sort_array(F.transform("bg", lambda b, i: F.struct(b.alias("b"), i.alias("i"))))).otherwise(F.array().cast("array<struct<b:string,i:int>>")))
    df = held(df, "at", F.expr(f"sort_array(transform(same, (x, j) -> struct(x.i AS i, IF(get(same, j - 1).b = x.b, get(same, j - 1).i, -1) AS last, IF(get(same, j + 1).b = x.b, get(same, j + 1).i, {NEVER}) AS next)))"))

    def best(t: Column) -> Column:
        def windows(ours: Column) -> Column:
            """The best of the windows that hold a bigram of the template; ours tells by place which bigrams are its."""
            begin = F.greatest(F.array_position(ours, 1).cast("int") - t["size"], F.lit(0))
            end = F.size(ours) - F.array_position(F.reverse(ours), 1).cast("int")
            first = F.slice("bg", begin + 1, t["size"])

            def move(now: Column, s: Column) -> Column:
                far = s + t["size"]
                dice = F.when(now["n"].between(t["lo"], t["hi"]), 2.0 * now["alike"] / (now["n"] + F.size(t["own"]))).otherwise(0.0)
                top = F.greatest(now["top"], F.struct(dice.alias("dice"), F.get(ours, s).alias("begins"), (-s).alias("s")))
                left, entered = F.get("at", s)["next"] >= far, F.get("at", far)["last"] <= s
                changed = lambda value, by: value - F.when(left, by(s)).otherwise(0) + F.when(entered, by(far)).otherwise(0)
                return F.struct(changed(now["n"], lambda _: F.lit(1)).alias("n"), changed(now["alike"], lambda i: F.get(ours, i)).alias("alike"), top.alias("top"))

            none_yet = F.struct(F.lit(-1.0).alias("dice"), F.lit(0).alias("begins"), F.lit(0).alias("s"))
            start = F.struct(F.size(F.array_distinct(first)).alias("n"), F.size(F.array_intersect(first, t["own"])).alias("alike"), none_yet.alias("top"))
            return F.aggregate(F.sequence(begin, end), start, move, lambda now: now["top"])

        top = let(F.transform("bg", lambda b: F.when(b.isin(every) & F.array_contains(t["own"], b), 1).otherwise(0)), windows)
        return let(top, lambda x: F.struct(x["dice"].alias("dice"), t["k"].alias("k"), x["s"].alias("s"), t["name"].alias("name")))

    df = held(df, "m", F.filter(F.transform("near", best), lambda x: x["dice"] >= least))
    df = df.select("doc_id", "m", F.array_max("m").alias("best"))
    return df.select("doc_id", F.col("best.name").alias("license"), F.round("best.dice", 6).alias("dice"), F.coalesce(-F.col("best.s"), F.lit(-1)).cast("long").alias("first_word"), F.size("m").cast("long").alias("n_matches"))


def _sql() -> str:
    known = compiled(TEMPLATES, DICE)
    texts = ", ".join("({}, '{}', {}, {}, {}, {})".format(k, name, len(own), size, lo, hi) for k, name, own, size, lo, hi in known)
    norm = "string_split(lower(trim(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')"
    big = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    given = ", ".join("({}, '{}')".format(k, TEMPLATES[k][1].replace("'", "''")) for k, *_ in known)
    return f"""
WITH t(tk, name, own, size, lo, hi) AS (VALUES {texts}),
tb AS (SELECT DISTINCT tk, unnest({big}) AS x FROM (SELECT tk, {norm.format('s')} AS w FROM (VALUES {given}) AS v(tk, s))),
d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {norm.format("coalesce(text, '')")} AS w FROM documents),
e AS MATERIALIZED (SELECT k, unnest(bg) AS x, generate_subscripts(bg, 1) AS i FROM (SELECT k, {big} AS bg FROM d)),
m AS MATERIALIZED (SELECT e.k, tb.tk, e.i, e.x FROM e JOIN tb USING (x)),
s AS MATERIALIZED (SELECT k, tk, size, unnest(range(greatest(1, min(i) - size + 1), max(i) + 1)) AS i FROM m JOIN t USING (tk) GROUP BY k, tk, size, lo HAVING count(DISTINCT x) >= lo),
p AS (SELECT k, tk, i, unnest(range(i, i + size)) AS j FROM s),
w AS (SELECT p.k, p.tk, p.i, count(DISTINCT e.x) AS n, count(DISTINCT tb.x) AS alike, bool_or(e.i = p.i AND tb.x IS NOT NULL) AS begins FROM p JOIN e ON e.k = p.k AND e.i = p.j LEFT JOIN tb ON tb.tk = p.tk AND tb.x = e.x GROUP BY ALL),
b AS (SELECT k, tk, name, i, 2.0 * alike / (n + own) AS dice, row_number() OVER (PARTITION BY k, tk ORDER BY 2.0 * alike / (n + own) DESC, begins DESC, i) AS r FROM w JOIN t USING (tk) WHERE n BETWEEN lo AND hi AND 2.0 * alike / (n + own) >= {DICE}),
g AS (SELECT k, arg_max(name, (dice, -tk)) AS license, max(dice) AS dice, arg_max(i, (dice, -tk)) AS i, count(*) AS n FROM b WHERE r = 1 GROUP BY k)
SELECT doc_id, license, round(dice, 6) AS dice, CAST(coalesce(i - 1, -1) AS BIGINT) AS first_word, CAST(coalesce(n, 0) AS BIGINT) AS n_matches FROM d LEFT JOIN g USING (k)
"""


SQL = _sql()
