"""Operator 4. Licence recognition by sentence rules.

A text is normalised (lower case, runs of anything but a-z and 0-9 become one
space; S stands for the end of a sentence, that is a closing mark or a blank
line, and L for a single line break with any comment mark after it). Known
licence sentences are found in it over line breaks: those of LONG words or more
wherever they stand, shorter ones where they begin and end at a sentence's or a
line's bounds. The text becomes a string of sentence identifiers, with a dot
for each other sentence. Rules are sequences of identifiers in order, with at
most GAP other sentences between two; a rule is a regular expression over that
string. All of it runs in the JVM, without a join or a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = 3
#: Words from which a known sentence is known in the middle of another, too.
LONG = 8
#: Ends of sentences: closing marks before white space, or line breaks in the table of known ones.
SPLIT = r"[\n\r]+|[.;:!?]+\s+"

#: Known sentences: identifier -> text.
SENTENCES: dict[str, str] = {
    "rights": "All rights reserved.",
    "mit.name": "The MIT License (MIT)",
    "mit.name2": "MIT License",
    "mit.notice": "Released under the MIT License.",
    "mit.notice2": "Licensed under the MIT License.",
    "mit.notice3": "This project is licensed under the MIT License.",
    "mit.grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit.condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit.warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit.liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache.title": "Apache License Version 2.0, January 2004",
    "apache.notice": "Licensed under the Apache License, Version 2.0.",
    "apache.head": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache.may": "you may not use this file except in compliance with the License.",
    "apache.copy": "You may obtain a copy of the License at",
    "apache.unless": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache.see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl.notice3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl.free": "This program is free software",
    "gpl.terms2": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl.terms2a": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl.title2": "GNU General Public License Version 2, June 1991",
    "gpl.title3": "GNU General Public License Version 3, 29 June 2007",
    "gpl.only2": "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl.only3": "under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
    "lgpl.title21": "GNU Lesser General Public License Version 2.1, February 1999",
    "lgpl.title3": "GNU Lesser General Public License Version 3, 29 June 2007",
    "lgpl.either21": "either version 2.1 of the License, or (at your option) any later version.",
    "agpl.title3": "GNU Affero General Public License Version 3, 19 November 2007",
    "gpl.either2": "either version 2 of the License, or (at your option) any later version.",
    "gpl.either3": "either version 3 of the License, or (at your option) any later version.",
    "gpl.hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl.implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl.see": "See the GNU General Public License for more details.",
    "lgpl.terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl.see": "See the GNU Lesser General Public License for more details.",
    "agpl.terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "agpl.see": "See the GNU Affero General Public License for more details.",
    "bsd.grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd.endorse": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd.asis": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl.notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl.title": "Mozilla Public License Version 2.0",
    "mpl.copys": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl.copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc.by": "Licensed under CC BY 4.0.",
    "cc.bysa": "Licensed under CC BY-SA 4.0.",
    "cc.bync": "Licensed under CC BY-NC 4.0.",
    "cc.byncsa": "Licensed under CC BY-NC-SA 4.0.",
    "cc.bynd": "Licensed under CC BY-ND 4.0.",
    "cc.by.long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc.bync.long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "public": "This work is in the public domain.",
}

#: Ordered rules: (rule, licence, identifiers in order).
RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("proprietary.rights", "LicenseRef-all-rights-reserved", ("rights",)),
    ("mit.full", "MIT", ("mit.grant", "mit.condition", "mit.warranty", "mit.liability")),
    ("mit.core", "MIT", ("mit.grant", "mit.condition")),
    ("mit.name", "MIT", ("mit.name",)),
    ("mit.name2", "MIT", ("mit.name2",)),
    ("mit.notice", "MIT", ("mit.notice",)),
    ("mit.notice2", "MIT", ("mit.notice2",)),
    ("mit.notice3", "MIT", ("mit.notice3",)),
    ("apache.text", "Apache-2.0", ("apache.title",)),
    ("apache.notice", "Apache-2.0", ("apache.notice",)),
    ("apache.header", "Apache-2.0", ("apache.head", "apache.may", "apache.copy", "apache.unless", "apache.see")),
    ("gpl3.notice", "GPL-3.0-only", ("gpl.notice3",)),
    ("gpl2.header", "GPL-2.0-or-later", ("gpl.free", "gpl.terms2a", "gpl.either2", "gpl.hope", "gpl.implied", "gpl.see")),
    ("gpl3.header", "GPL-3.0-or-later", ("gpl.free", "gpl.terms2a", "gpl.either3", "gpl.hope", "gpl.implied", "gpl.see")),
    ("gpl2.only", "GPL-2.0-only", ("gpl.only2",)),
    ("gpl3.only", "GPL-3.0-only", ("gpl.only3",)),
    ("gpl2.text", "GPL-2.0", ("gpl.title2",)),
    ("gpl3.text", "GPL-3.0", ("gpl.title3",)),
    ("lgpl21.header", "LGPL-2.1-or-later", ("lgpl.terms", "lgpl.either21", "lgpl.see")),
    ("lgpl3.header", "LGPL-3.0-or-later", ("lgpl.terms", "gpl.either3", "lgpl.see")),
    ("lgpl21.text", "LGPL-2.1", ("lgpl.title21",)),
    ("lgpl3.text", "LGPL-3.0", ("lgpl.title3",)),
    ("agpl3.text", "AGPL-3.0", ("agpl.title3",)),
    ("agpl.header", "AGPL-3.0-or-later", ("agpl.terms", "gpl.either3", "agpl.see")),
    ("bsd2", "BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("bsd3", "BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("isc", "ISC", ("isc.grant",)),
    ("mpl2", "MPL-2.0", ("mpl.notice", "mpl.copy")),
    ("mpl2.https", "MPL-2.0", ("mpl.notice", "mpl.copys")),
    ("mpl2.text", "MPL-2.0", ("mpl.title",)),
    ("cc.by", "CC-BY-4.0", ("cc.by",)),
    ("cc.bysa", "CC-BY-SA-4.0", ("cc.bysa",)),
    ("cc.bync", "CC-BY-NC-4.0", ("cc.bync",)),
    ("cc.byncsa", "CC-BY-NC-SA-4.0", ("cc.byncsa",)),
    ("cc.bynd", "CC-BY-ND-4.0", ("cc.bynd",)),
    ("cc.by.long", "CC-BY-4.0", ("cc.by.long",)),
    ("cc.bync.long", "CC-BY-NC-4.0", ("cc.bync.long",)),
    ("cc0", "CC0-1.0", ("cc0",)),
    ("unlicense", "Unlicense", ("unlicense",)),
    ("public", "LicenseRef-public-domain", ("public",)),
)


def normalise(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def known() -> dict[str, str]:
    """Normalised sentence -> identifier, of the known texts that are one sentence; sequences() has the others."""
    out: dict[str, str] = {}
    for key, text in SENTENCES.items():
        parts = [p for p in map(normalise, re.split(SPLIT, text)) if p]
        if len(parts) == 1:
            out.setdefault(parts[0], key)
    return out


def sequences() -> dict[str, str]:
    """Normalised sentences joined by S -> identifier, of the known texts of several sentences that are not all known themselves."""
    names, out = known(), {}
    for key, text in SENTENCES.items():
        parts = [p for p in map(normalise, re.split(SPLIT, text)) if p]
        if len(parts) > 1 and not all(p in names for p in parts):
            out[" S ".join(parts)] = key
    return out


def marked(text: Column) -> Column:
    """The text normalised, with S for each end of a sentence and L for each other line break."""
    out = F.regexp_replace(F.lower(text), r"\r\n?", "\n")
    # What is before a line's first letter or digit is indentation and comment marks; a line without any is blank.
    out = F.regexp_replace(out, r"(^|\n)[^a-z0-9\n]+", "$1")
    out = F.regexp_replace(out, r"[.;:!?]+\s+|\n\n+", " S ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\n", " L "), "[^a-z0-9SL]+", " "))


def known_pattern(sentences: list[str]) -> str:
    """Any of the normalised sentences, the longest first; its words may stand on several lines. Those with a first word in common share it."""
    by: dict[tuple[bool, str], list[str]] = {}
    for x in sorted(sentences, key=lambda x: (-len(x), x)):
        by.setdefault((len(x.split()) >= LONG, x.split()[0]), []).append(x.partition(" ")[2])
    over = lambda x: x.replace(" ", "(?: L)? ")
    # The bounds of short ones are behind a test of the word itself, which fails sooner.
    of = {k: "|".join(w + ("(?: L)? (?:" + "|".join(map(over, rest)) + ")" if rest[0] else "") for (size, w), rest in by.items() if size is k and (rest[0] or len(rest) == 1)) for k in (True, False)}
    return rf"\b(?:(?:{of[True]})\b|(?<=^|[SL] )(?:{of[False]})(?= [SL]|$))"


def rule_pattern(keys: tuple[str, ...]) -> str:
    return (r"(?:\.|<[a-z0-9.]+>){0," + str(GAP) + "}").join("<" + re.escape(k) + ">" for k in keys)


def _check() -> None:
    """Every rule can match: its sentences are known, each by its own identifier, and no two known ones are alike."""
    names = known() | sequences()
    missing = {k for _, _, keys in RULES for k in keys} - set(names.values())
    if missing or any(len(s.split()) == 1 for s in names):
        raise ValueError(f"sentences that no text can have: {sorted(missing)}")


_check()


def recognised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rule, license, sentences: one row for each rule that a text matches; sentences are its known ones in order.

    Null, empty and unlicensed texts give no rows; null ids and repeated rows pass through; texts are scanned whole;
    overlapping rules all count; an empty table gives no rows. Other columns are not looked at.
    """
    names = known() | sequences()
    table = F.create_map(*(F.lit(x) for pair in sorted(names.items()) for x in pair))
    pattern = known_pattern(list(names))
    chosen = docs.select(F.col(id_col).alias("doc_id"), marked(F.col(text_col).cast("string")).alias("text")).where(F.col("text").rlike(pattern))
    parts = F.regexp_extract_all(F.regexp_replace("text", pattern, "<$0>"), F.lit("<[^>]*>|[a-z0-9][^<>S]*"), F.lit(0))
    ids = F.transform(parts, lambda p: F.when(F.startswith(p, F.lit("<")), F.try_element_at(table, F.regexp_replace(F.regexp_replace(p, "[<>]", ""), " L ", " "))))
    found = chosen.select("doc_id", ids.alias("ids"))
    line = F.concat_ws("", F.transform("ids", lambda x: F.coalesce(F.concat(F.lit("<"), x, F.lit(">")), F.lit("."))))
    coded = found.select("doc_id", line.alias("line"), F.concat_ws(" ", F.filter("ids", lambda x: x.isNotNull())).alias("sentences"))
    rules = F.array(*(F.when(F.col("line").rlike(rule_pattern(keys)), F.struct(F.lit(rule).alias("rule"), F.lit(licence).alias("license"))) for rule, licence, keys in RULES))
    return coded.select("doc_id", "sentences", F.explode(F.array_compact(rules)).alias("r")).select("doc_id", "r.rule", "r.license", "sentences")


def oracle_sql() -> str:
    """DuckDB SQL of recognised() over documents, from the tables SENTENCES and RULES alone.

    The sentences are replaced one after another, the longest first, which comes to the same unless two overlap in a
    text; each bound is written twice, as the expressions have no look-around.
    """
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    plain = {}
    for key, text in SENTENCES.items():
        words = re.sub("[^a-z0-9S]+", " ", re.sub(r"[.;:!?]+\s+(?=\S)", " S ", text.lower())).split()
        plain.setdefault(tuple(words), key)
    whole = {w: k for w, k in plain.items() if "S" not in w or not all(tuple(p.split()) in plain for p in " ".join(w).split(" S "))}
    text = "text"
    for words, key in sorted(whole.items(), key=lambda x: (-len(" ".join(x[0])), x[0])):
        body = "(?: L L)? ".join(words).replace("S(?: L L)? ", "S ").replace("(?: L L)? S ", " S S ")
        if len(words) >= LONG:
            text = f"regexp_replace({text}, '\\b{body}\\b', '<{key}>', 'g')"
        else:
            text = f"regexp_replace({text}, '([SL]) {body} ([SL])', '\\1 <{key}> \\2', 'g')"
    rules = ", ".join(f"({quote(r)}, {quote(c)}, {quote(rule_pattern(k))})" for r, c, k in RULES)
    return f"""
    WITH rules(rule, license, pattern) AS (VALUES {rules}),
    lines AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '\\r\\n?', chr(10), 'g'), '(^|\\n)[^a-z0-9\\n]+', '\\1', 'g') AS text FROM documents),
    bounds AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[.;:!?]+[\\t-\\r ]+|\\n\\n+', ' S S ', 'g'), '\\n', ' L L ', 'g') AS text FROM lines),
    clean AS (SELECT doc_id, 'S ' || trim(regexp_replace(text, '[^a-z0-9SL]+', ' ', 'g')) || ' S' AS text FROM bounds),
    coded AS (SELECT doc_id, regexp_extract_all({text}, '<[^>]*>|[a-z0-9][^<>S]*') AS parts FROM clean),
    line AS (SELECT doc_id, list_aggregate(list_transform(parts, lambda p: CASE WHEN p[1] = '<' THEN p ELSE '.' END), 'string_agg', '') AS line,
                    list_aggregate(list_transform(list_filter(parts, lambda p: p[1] = '<'), lambda p: p[2:-2]), 'string_agg', ' ') AS sentences FROM coded)
    SELECT doc_id, rule, license, sentences FROM line, rules WHERE regexp_matches(line, pattern)"""
