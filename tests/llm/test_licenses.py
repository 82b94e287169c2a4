import textwrap

from stepwright.llm import licenses as L


def found(docs):
    out = {}
    for r in L.recognised(docs).collect():
        out.setdefault(r["doc_id"], set()).add(r["rule"])
    return out


def full(*keys):
    return "\n".join(L.SENTENCES[k] for k in keys)


def test_rules(docs_of):
    mit = ("mit.grant", "mit.condition", "mit.warranty", "mit.liability")
    docs = [
        (1, full(*mit)),
        (2, full(mit[0], mit[1]) + "\n" + "Other words.\n" * 3 + full(mit[2], mit[3])),
        (3, full(mit[0]) + "\n" + "Other words.\n" * 4 + full(mit[1])),
        (4, full(mit[1], mit[0])),
        (5, "Text before. " + L.SENTENCES["mit.notice"] + " Text after."),
        (6, "  LICENSED under --- the apache license,\tVersion 2.0.\n"),
        (7, "we like the MIT License very much"),
        (8, full("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse")),
        (9, full("rights") + "\n" + full("cc0")),
    ]
    got = found(docs_of(docs))
    assert got == {1: {"mit.full", "mit.core"}, 2: {"mit.full", "mit.core"}, 5: {"mit.notice"}, 6: {"apache.notice"}, 8: {"bsd2", "bsd3"}, 9: {"proprietary.rights", "cc0"}}


def test_every_single_sentence_is_known():
    known = L.known()
    for key, text in L.SENTENCES.items():
        if len([p for p in L.re.split(L.SPLIT, text) if L.normalise(p)]) == 1:
            assert known[L.normalise(L.re.split(L.SPLIT, text)[0])] == key


def test_odd_rows(odd, none, docs_of):
    assert found(odd) == {} and found(none) == {}
    many = docs_of([(None, L.SENTENCES["cc0"]), (1, L.SENTENCES["cc0"]), (1, L.SENTENCES["cc0"]), (2, "word " * 100_000 + "\n" + L.SENTENCES["public"])])
    assert sorted((r["doc_id"] or 0, r["rule"]) for r in L.recognised(many).collect()) == [(0, "cc0"), (1, "cc0"), (1, "cc0"), (2, "public")]


def wrapped(mark, *keys, gap="\n"):
    """The sentences as a file has them: a paragraph, wrapped at 72 columns, each line after a comment mark."""
    lines = textwrap.wrap(" ".join(L.SENTENCES[k] for k in keys), 72)
    return gap.join(mark + x for x in lines)


def test_wrapped_at_line_ends(docs_of):
    mit = ("mit.grant", "mit.condition", "mit.warranty", "mit.liability")
    docs = []
    for mark in ("", "# ", " * ", "// ", ";; ", "-- "):
        n = len(docs)
        blank = "\n" + mark.rstrip() + "\n"
        docs += [
            (n, "Copyright (c) 2020 A. Person" + blank + wrapped(mark, *mit) + "\n"),
            (n + 1, mark + "MIT License\n" + wrapped(mark, mit[0]) + blank + wrapped(mark, mit[1]) + blank + wrapped(mark, mit[2], mit[3])),
            (n + 2, wrapped(mark, "bsd.grant") + blank + wrapped(mark + "* ", "bsd.source") + "\n" + wrapped(mark, "bsd.binary") + blank + "more text"),
            (n + 3, wrapped(mark, "isc.grant", gap="\r\n") + "\r\n"),
            (n + 4, wrapped(mark, "gpl.terms2") + " " + L.SENTENCES["rights"]),
            (n + 5, "a text of\n" + mark + "two lines\n" + wrapped(mark, "unlicense")),
            (n + 6, mark + "words " + wrapped(mark, "isc.grant")[len(mark) :]),
        ]
    got = found(docs_of(docs))
    for n in range(0, len(docs), 7):
        assert got[n] == {"mit.full", "mit.core"} and got[n + 1] == {"mit.full", "mit.core", "mit.name2"}
        assert got[n + 2] == {"bsd2"} and got[n + 3] == {"isc"} and got[n + 4] == {"proprietary.rights"} and got[n + 5] == {"unlicense"} and got[n + 6] == {"isc"}


def test_each_rule_matches_its_own_text(docs_of):
    docs = [(n, wrapped(mark, *keys) + "\n") if mark else (n, full(*keys)) for n, (mark, (_, _, keys)) in enumerate((m, r) for m in ("", "# ") for r in L.RULES if not m or all(L.SENTENCES[k][-1] in ".:;" for k in r[2]))]
    names = [rule for m in ("", "# ") for rule, _, keys in L.RULES if not m or all(L.SENTENCES[k][-1] in ".:;" for k in keys)]
    got = found(docs_of(docs))
    assert [n for n, rule in enumerate(names) if rule not in got.get(n, ())] == []
    assert set(names) == {rule for rule, _, _ in L.RULES} and "mpl2" in names[len(L.RULES) :]


MIT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD2 = """Copyright 2020 A. Person

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
BSD3 = BSD2 + """
3. Neither the name of the Example Foundation nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
APACHE = """Copyright [yyyy] [name of copyright owner]

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GNU = """This {thing} is free software{sign} you can redistribute it and/or
modify it under the terms of the GNU {lesser}General Public
License as published by the Free Software Foundation; either
version {version} of the License, or (at your option) any later version.

This {thing} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
{lesser}General Public License for more details.

You should have received a copy of the GNU {lesser}General Public
License along with this {thing}; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at {http}://mozilla.org/MPL/2.0/.
"""
FILES = {
    "mit": (MIT, {"MIT"}),
    "bsd2": (BSD2 + BSD_END, {"BSD-2-Clause"}),
    "bsd3": (BSD3 + BSD_END, {"BSD-2-Clause", "BSD-3-Clause"}),
    "apache": (APACHE, {"Apache-2.0"}),
    "apache.text": ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n", {"Apache-2.0"}),
    "gpl2": (GNU.format(thing="program", sign=";", lesser="", version="2"), {"GPL-2.0-or-later"}),
    "gpl3": (GNU.format(thing="program", sign=":", lesser="", version="3"), {"GPL-3.0-or-later"}),
    "gpl3.text": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007", {"GPL-3.0"}),
    "lgpl21": (GNU.format(thing="library", sign=";", lesser="Lesser ", version="2.1"), {"LGPL-2.1-or-later"}),
    "lgpl3": (GNU.format(thing="program", sign=":", lesser="Lesser ", version="3"), {"LGPL-3.0-or-later"}),
    "agpl3": (GNU.format(thing="program", sign=":", lesser="Affero ", version="3"), {"AGPL-3.0-or-later"}),
    "mpl": (MPL.format(http="http"), {"MPL-2.0"}),
    "mpls": (MPL.format(http="https"), {"MPL-2.0"}),
}


def unwrapped(text):
    return " ".join(text.split())


def test_verbatim_files(docs_of):
    """As files have them: as they are, in comments, wrapped anew, with other line ends, and in one line."""
    forms = []
    for name, (text, want) in FILES.items():
        paragraphs = text.strip("\n").split("\n\n")
        forms += [(name, want, text), (name, want, "some code before\n\n" + text.replace("\n", "\r\n"))]
        forms += [(name, want, "\n".join(mark + line for line in text.split("\n"))) for mark in ("# ", " * ", "// ", "-- ", ";; ", "<!-- ")]
        forms += [(name, want, "/*\n" + "\n".join(" * " + line for line in text.split("\n")) + " */\nint x;")]
        if not name.endswith(".text"):
            forms += [(name, want, "\n\n".join(textwrap.fill(p, width) for p in paragraphs)) for width in (40, 100)]
            forms += [(name, want, "\n".join(map(unwrapped, paragraphs))), (name, want, unwrapped(text))]
    docs = docs_of([(k, t) for k, (_, _, t) in enumerate(forms)])
    got = {}
    for r in L.recognised(docs).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    wrong = [(name, text[:60], got.get(k)) for k, (name, want, text) in enumerate(forms) if got.get(k) != want]
    assert wrong == []


def test_sql_on_fixtures(docs_of):
    """The SQL, which replaces sentence after sentence, on all files above and on each sentence in prose and alone."""
    import duckdb

    rows = [(k, t) for k, t in enumerate([t for t, _ in FILES.values()] + [unwrapped(t) for t, _ in FILES.values()])]
    for key in L.SENTENCES:
        for form in ("{}", "words before {} and after", "A title.\n{}\nMore.", "# a\n# {}\n", "{}\n{}", "{} {}"):
            rows.append((len(rows), form.replace("{}", L.SENTENCES[key])))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = sorted(con.execute("select doc_id, rule, license, sentences from (" + L.oracle_sql() + ")").fetchall())
    got = sorted((r["doc_id"], r["rule"], r["license"], r["sentences"]) for r in L.recognised(docs_of(rows)).collect())
    assert got == want and len(got) > 150
