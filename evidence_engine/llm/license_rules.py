"""Licence scans by sentence rules. DataFrame functions only.

A text is cut into sentences and single lines, these are normalised (lower case, letters, digits and dots
of version numbers, single spaces) and looked up among known licence sentences. Both kinds are merged by
their places, counted in characters other than spaces, which no cut takes away; of a line and a sentence
that overlap the longer counts. The identifiers found, in the order of the text, are matched against ordered
licence rules. A rule is a sequence of identifiers that must occur in this order; a rule takes its
identifiers away from those after it, as often as it matches, so longer rules stand before the shorter ones
that they contain.

Everything is linear in the text, however many notices it holds. For the rules an identifier is one character. Whether a
rule matches at all is one pass of a pattern that never goes back. How often, and what it takes, is one pass that counts
for each step of the rule how many matches have come so far: an identifier goes to the last step that waits for it, so
earlier matches are served first, as if they were taken one after the other. Lists and strings that grow in a pass grow
in blocks of 1,024. Lines and sentences are sorted by place and meet only within groups that overlap.

Texts without any of the words that every known sentence has one of can't match and skip the cutting; a table of
sentences that don't all have one makes every text be cut.

Edge cases: a null or empty text has no sentences; a sentence that stands both as a line and as a sentence
counts once for each place; repeated rows give repeated rows; null ids are carried.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences as they are published, by identifier.
SENTENCES = {
    "all-rights": "All rights reserved.",
    "apache-2-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2-head": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-2-use": "you may not use this file except in compliance with the License.",
    "apache-2-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2-asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-2-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-line": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-see": "See the GNU General Public License for more details.",
    "gpl-2-free": "This program is free software;",
    "gpl-2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl-2-later": "either version 2 of the License, or (at your option) any later version.",
    "lgpl-2-free": "This library is free software;",
    "lgpl-2-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "lgpl-2-later": "either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2-line": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-3-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "epl-1-grant": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl-2-grant": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl-2-line": "Licensed under the Eclipse Public License 2.0.",
    "zlib-asis": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-event": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib-line": "Licensed under the zlib License.",
    "artistic-2-line": "Licensed under the Artistic License 2.0.",
    "artistic-2-free": "This is free software, licensed under: The Artistic License 2.0 (GPL Compatible)",
    "mpl-head": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl-2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl-2-copy-http": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-2-line": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2-licensed": "Licensed under the Mozilla Public License 2.0.",
    "cc-by-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-line": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

# Ordered rules, licence and the identifiers that must follow each other.
RULES = (
    ("Apache-2.0", ("apache-2-head", "apache-2-use", "apache-2-copy", "apache-2-asis", "apache-2-see")),
    ("Apache-2.0", ("apache-2-head", "apache-2-use")),
    ("Apache-2.0", ("apache-2-line",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-line",)),
    ("MIT", ("mit-licensed",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("AGPL-3.0-or-later", ("agpl-3-free",)),
    ("AGPL-3.0-only", ("agpl-3-line",)),
    ("LGPL-2.1-or-later", ("lgpl-2-free", "lgpl-2-terms", "lgpl-2-later")),
    ("LGPL-2.1-only", ("lgpl-2-line",)),
    ("LGPL-3.0-or-later", ("lgpl-3-free",)),
    ("LGPL-3.0-only", ("lgpl-3-line",)),
    ("GPL-2.0-or-later", ("gpl-2-free", "gpl-2-terms", "gpl-2-later", "gpl-warranty", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl-2-free", "gpl-2-terms", "gpl-2-later")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-warranty", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0-only", ("gpl-3-line",)),
    ("GPL-2.0-only", ("gpl-2-line",)),
    ("MPL-2.0", ("mpl-head", "mpl-2-copy")),
    ("MPL-2.0", ("mpl-head", "mpl-2-copy-http")),
    ("MPL-2.0", ("mpl-2-line",)),
    ("MPL-2.0", ("mpl-2-licensed",)),
    ("EPL-1.0", ("epl-1-grant",)),
    ("EPL-2.0", ("epl-2-grant",)),
    ("EPL-2.0", ("epl-2-line",)),
    ("Zlib", ("zlib-asis", "zlib-event", "zlib-grant")),
    ("Zlib", ("zlib-line",)),
    ("Artistic-2.0", ("artistic-2-line",)),
    ("Artistic-2.0", ("artistic-2-free",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-line",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-line",)),
    ("CC-BY-4.0", ("cc-by-line",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("CC0-1.0", ("cc0-line",)),
    ("Unlicense", ("unlicense",)),
    ("all-rights-reserved", ("all-rights",)),
)

# The line that names a licence by its SPDX identifier, one for each licence that a rule knows.
_SPDX = dict.fromkeys(name for name, _ in RULES if name != "all-rights-reserved")
SENTENCES |= {f"spdx-{name}": f"SPDX-License-Identifier: {name}" for name in _SPDX}
RULES += tuple((name, (f"spdx-{name}",)) for name in _SPDX)

#: Every known sentence has one of these words; for other tables that don't, the sieve is left out.
ANCHOR = "(?i)licen[sc]|permi[st]|redistribut|reserved|copyright|software|program|mozilla"
CUT = r"(?<=[.!?;])\s+|\n\s*\n"


def normalized(text: str) -> str:
    """What normalize() makes of a text, for the fixed sentences."""
    return re.sub("[^a-z0-9.]+", " ", text.lower()).strip(" .")


def normalize(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9.]+", " "), F.lit(" ."))


def _units(text: Column) -> tuple[Column, Column]:
    """Sentences of the whole text, and its single lines."""
    sentences = F.split(F.regexp_replace(text, r"\r", ""), CUT)
    lines = F.split(F.regexp_replace(text, r"\r", ""), r"\n")
    return sentences, lines


BLOCK = 1024


def _grown(items: Column, state: dict[str, Column], empty: Column, step) -> Column:
    """Folds items; step(state, item) gives the new state and what the item adds to `out` (of empty's kind), which is
    gathered by blocks, so that what has been gathered is not copied for every item."""
    last = lambda xs: F.greatest(F.lit(0), F.ceil(F.size(xs) / BLOCK).cast("int") - 1)
    cut = lambda xs: F.transform(F.sequence(F.lit(0), last(xs)), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))
    blocks = F.transform(F.array(items), cut)[0]  # as a lambda's argument items is worked out once, not for each block
    begin = F.struct(*(c.alias(k) for k, c in state.items()), empty.alias("out"))

    def one(now: Column, item: Column) -> Column:
        new, added = step(now, item)
        return F.struct(*(new.get(k, now[k]).alias(k) for k in state), F.when(added.isNull(), now["out"]).otherwise(F.concat(now["out"], added)).alias("out"))

    def block(now: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(*(now[k].alias(k) for k in state), empty.alias("out")), one)
        return F.transform(F.array(inner), lambda x: F.struct(*(x[k].alias(k) for k in state), F.concat(now["out"], x["out"]).alias("out")))[0]

    return F.aggregate(blocks, begin, block)


def _placed(units: Column, known: Column) -> Column:
    """The known units: where they begin and end, and the identifier's mark."""
    kind = "array<struct<at:int,end:int,mark:string>>"
    sized = F.transform(units, lambda u: F.struct(F.length(F.regexp_replace(u, r"\s", "")).alias("n"), F.try_element_at(known, normalize(u)).alias("mark")))

    def step(now: Column, u: Column):
        end = now["end"] + u["n"]
        return {"end": end}, F.when(u["mark"].isNotNull(), F.array(F.struct(now["end"].alias("at"), end.alias("end"), u["mark"].alias("mark"))))

    return _grown(sized, {"end": F.lit(0)}, F.array().cast(kind), step)["out"]


def _merged(sentences: Column, lines: Column) -> Column:
    """The marks of both lists in order. Of a sentence and a line that overlap the longer counts, of equal ones the sentence;
    a sentence gives way only to a line that counts."""
    tagged = lambda xs, line: F.transform(xs, lambda x: F.struct(x["at"].alias("at"), x["end"].alias("end"), F.lit(line).alias("line"), x["mark"].alias("mark")))
    overlap = lambda x, y: (x["at"] < y["end"]) & (y["at"] < x["end"])
    length = lambda x: x["end"] - x["at"]

    def settled(group: Column) -> Column:
        beaten = lambda x: F.exists(group, lambda y: ~y["line"] & overlap(x, y) & (length(y) >= length(x)))
        return F.filter(group, lambda x: F.when(x["line"], ~beaten(x)).otherwise(~F.exists(group, lambda y: y["line"] & overlap(x, y) & ~beaten(y))))

    both = F.array_sort(F.concat(tagged(sentences, False), tagged(lines, True)))
    none = F.array().cast("array<struct<at:int,end:int,line:boolean,mark:string>>")

    def step(now: Column, x: Column):
        apart = x["at"] >= now["end"]
        group = F.when(apart, F.array(x)).otherwise(F.concat(now["group"], F.array(x)))
        return {"end": F.greatest(now["end"], x["end"]), "group": group}, F.when(apart, settled(now["group"]))

    found = _grown(both, {"end": F.lit(0), "group": none}, none, step)
    every = F.transform(F.array(found), lambda x: F.concat(x["out"], settled(x["group"])))[0]
    return F.transform(F.when(sentences == lines, tagged(sentences, False)).otherwise(every), lambda x: x["mark"])


def _taken(left: Column, seq: Column) -> Column:
    """What is left of the marks once a rule has taken its own as often as it matches."""
    marks, steps = F.split(left, ""), F.sequence(F.lit(0), F.size(seq) - 1)

    def goes_to(counts: Column, mark: Column) -> Column:
        """The last step that waits for this mark, or -1."""
        waits = lambda s: (seq[s] == mark) & ((s == 0) | (F.get(counts, s - 1) > counts[s]))
        return F.when(F.array_contains(seq, mark), F.aggregate(steps, F.lit(-1), lambda best, s: F.when(waits(s), s).otherwise(best))).otherwise(-1)

    def counted(counts: Column, to: Column) -> Column:
        return F.transform(counts, lambda n, s: F.when(s == to, n + 1).otherwise(n))

    def count(counts: Column, mark: Column) -> Column:
        return F.when(F.array_contains(seq, mark), counted(counts, goes_to(counts, mark))).otherwise(counts)

    zeros = F.transform(steps, lambda _: F.lit(0))
    full = F.element_at(F.aggregate(marks, zeros, count), -1)

    def step(now: Column, mark: Column):
        to = goes_to(now["counts"], mark)
        return {"counts": F.when(to >= 0, counted(now["counts"], to)).otherwise(now["counts"])}, F.when((to < 0) | (F.get(now["counts"], to) >= now["full"]), mark)

    return _grown(marks, {"counts": zeros, "full": full}, F.lit(""), step)["out"]


def scan(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), sentences: dict[str, str] | None = None, rules=None) -> DataFrame:
    """The kept columns, n_sentences long, sentence_ids and licenses (arrays, in the order of the text and of the rules)."""
    sentences, rules = sentences or SENTENCES, RULES if rules is None else rules
    mark_of = {i: chr(0x21 + k) if k < 0x5E else chr(0x4E00 + k) for k, i in enumerate(sentences)}
    known = F.create_map(*(F.lit(x) for i, s in sentences.items() for x in (normalized(s), mark_of[i])))
    named = F.create_map(*(F.lit(x) for i, m in mark_of.items() for x in (m, i)))
    text = F.col(text_col).cast("string")
    base = df.select(*keep, (F.when(text.rlike(ANCHOR), text) if all(re.search(ANCHOR, s) for s in sentences.values()) else text).alias("_text"))
    cut, lines = _units(F.col("_text"))
    # A sentence over several lines shows in the first list, one without an end mark in the second.
    found = base.withColumn("_s", _placed(cut, known)).withColumn("_l", _placed(lines, known))
    found = found.withColumn("_marks", F.coalesce(F.when(F.size("_s") + F.size("_l") > 0, _merged(F.col("_s"), F.col("_l"))), F.array().cast("array<string>")))

    def pattern(seq: tuple[str, ...]) -> str:
        return "^" + "".join(rf"[^{re.escape(mark_of[i])}]*+{re.escape(mark_of[i])}" for i in seq)

    usable = [(name, seq) for name, seq in rules if all(i in mark_of for i in seq)]
    kind = "array<struct<name:string,seq:array<string>,match:string>>"
    table = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*(F.lit(mark_of[i]) for i in seq)).alias("seq"), F.lit(pattern(seq)).alias("match")) for name, seq in usable)).cast(kind)
    start = F.struct(F.array_join("_marks", "").alias("left"), F.array().cast("array<string>").alias("names"))

    def step(state: Column, rule: Column) -> Column:
        left = F.when(F.size(rule["seq"]) == 1, F.replace(state["left"], rule["seq"][0], F.lit(""))).otherwise(_taken(state["left"], rule["seq"]))
        return F.when(F.rlike(state["left"], rule["match"]), F.struct(left.alias("left"), F.concat(state["names"], F.array(rule["name"])).alias("names"))).otherwise(state)

    licenses = F.when(F.size("_marks") > 0, F.array_distinct(F.aggregate(table, start, step)["names"])).otherwise(F.array().cast("array<string>"))
    return found.select(*keep, F.size("_marks").cast("long").alias("n_sentences"), F.transform("_marks", lambda m: named[m]).alias("sentence_ids"), licenses.alias("licenses"))
