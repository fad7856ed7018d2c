import os

import pytest

from sieveline.llm import licenses

MIT = "\n".join(s for i, s in licenses.SENTENCES if i in ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")).replace("\n", ".\n") + "."


def wrapped(text):
    """Lines broken before some words that are in lower case, or between words in capitals."""
    for word in ("of this software", "in the Software without", "to use, copy", "(the ", "copies or", "IMPLIED, INCLUDING", "COPYRIGHT HOLDERS"):
        text = text.replace(" " + word, "\n" + word)
    return text


CASES = [
    ("Some words.\nReleased under the MIT License.", ["MIT"], ["mit-ref"]),
    ("x licensed UNDER the apache license, version 2.0!", None, None),
    ("Text. Licensed under the Apache License, Version 2.0. More. All rights reserved.", ["Apache-2.0", "all-rights-reserved"], ["apache2-ref", "reserved"]),
    ("MIT License\n\n" + MIT, ["MIT"], ["mit-name", "mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    (wrapped(MIT), ["MIT"], ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("Permission is nothing", None, None),
    ("This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.", ["GPL-3.0-only", "CC-BY-NC-4.0"], ["gpl3-ref", "cc-by-nc-ref"]),
    ("See the GNU General Public License for more details.", [], ["gpl-see"]),
    (None, None, None),
    ("", None, None),
    ("word " * 300_000 + ".\nLicensed under CC BY 4.0.", ["CC-BY-4.0"], ["cc-by-ref"]),
]


def brute(text):
    import re

    if text is None:
        return None
    for pattern in (licenses._WRAP_LOWER[0], licenses._WRAP_UPPER[0]):
        text = re.sub(pattern, r"\1 \2", text)
    table = {licenses.normalised(s): i for i, s in licenses.SENTENCES}
    found = [(at, table[n]) for at, s in enumerate(re.split(licenses._END, text)) if (n := licenses.normalised(s)) in table]
    if not found:
        return None
    seq = []
    for k, (at, name) in enumerate(found):
        if k and found[k - 1][0] < at - 1:
            seq.append("~")
        seq.append(name)
    names = []
    for name, rule in licenses.RULES:
        rule = rule.split()
        i = 0
        while i + len(rule) <= len(seq):
            if seq[i : i + len(rule)] == rule:
                if name not in names:
                    names.append(name)
                seq[i : i + len(rule)] = ["~"]
            i += 1
    return names, [name for _, name in found]


def test_cases(spark):
    rows = [(i, t) for i, (t, _, _) in enumerate(CASES)] + [(0, CASES[0][0]), (0, "All rights reserved"), (None, "All rights reserved.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as sentence", "2 as version", "3 as licenses")
    got = licenses.scan(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((list(r.licenses), list(r.sentences)))
    for i, (text, names, ids) in enumerate(CASES[1:], 1):
        assert by.get(i) == (None if names is None else [(names, ids)]), i
        assert by.get(i) == (None if brute(text) is None else [brute(text)])
    assert sorted(by[0]) == [(["MIT"], ["mit-ref"]), (["all-rights-reserved"], ["reserved"])] and len(by[None]) == 1
    assert licenses.scan(df.limit(0)).count() == 0


MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy
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
BSD2_BODY = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3_BODY = BSD2_BODY + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED.
"""


def as_comment(text, mark):
    return "".join(f"{mark}{line}".rstrip() + "\n" for line in text.split("\n"))


def narrow(text):
    """Each paragraph wrapped anew, before capitals and quotes, too."""
    import textwrap

    return "\n\n".join(textwrap.fill(p, 31) for p in text.split("\n\n"))


def test_verbatim_texts(spark):
    forms = {
        "plain": str,
        "crlf": lambda t: t.replace("\n", "\r\n"),
        "indent": lambda t: as_comment(t, "    "),
        "block": lambda t: "/*\n" + as_comment(t, " * ") + " */\nint x;\n",
        "hash": lambda t: as_comment(t, "# "),
        "narrow": narrow,
        "narrow block": lambda t: as_comment(narrow(t), " * "),
    }
    bodies = {"MIT": MIT_BODY, "BSD-2-Clause": BSD2_BODY + BSD_END, "BSD-3-Clause": BSD3_BODY + BSD_END}
    cases = [(name, form, "Copyright (c) 2020 A\n\n" + body) for name, body in bodies.items() for form in forms]
    rows = [(i, forms[form](text)) for i, (_, form, text) in enumerate(cases)]
    # other sentences between still part them
    rows.append((-1, BSD2_BODY.replace("\n2. ", "\nSomething else.\n\n2. ")))
    got = {r.doc_id: list(r.licenses) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(name, form): got.get(i) for i, (name, form, _) in enumerate(cases)} == {(name, form): [name] for name, form, _ in cases}
    assert got[-1] == []


def test_each_sentence_is_found(spark):
    header = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\n"
    rows = [*enumerate(s for _, s in licenses.SENTENCES), (-1, header), (-2, "The MIT. License")]
    got = {r.doc_id: (list(r.licenses), list(r.sentences)) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i][1] if i in got else None for i in range(len(licenses.SENTENCES))} == {i: [x] for i, (x, _) in enumerate(licenses.SENTENCES)}
    assert got[-1] == (["MPL-2.0"], ["mpl2-ref"]) and -2 not in got


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = sorted((r[0], list(r[1]), list(r[2])) for r in con.execute(licenses.sql()).fetchall())
    assert sorted((r.doc_id, list(r.licenses), list(r.sentences)) for r in licenses.scan(spark.read.parquet(path)).collect()) == want


_GPL = """This {what} is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation{comma} either version {n} of the License, or
(at your option) any later version.
"""

#: Notices as they stand in files, by licence.
NOTICES = {
    "GPL-3.0-or-later": _GPL.format(what="program", mark=":", kind="", comma=",", n="3")
    + """
This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
""",
    "GPL-2.0-or-later": _GPL.format(what="program", mark=";", kind="", comma=";", n="2"),
    "LGPL-2.1-or-later": _GPL.format(what="library", mark=";", kind="Lesser ", comma=";", n="2.1"),
    "LGPL-3.0-or-later": _GPL.format(what="library", mark=":", kind="Lesser ", comma=",", n="3"),
    "AGPL-3.0-or-later": _GPL.format(what="program", mark=":", kind="Affero ", comma=",", n="3"),
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
    "EPL-2.0": """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/
""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
""",
    "BSL-1.0": """Distributed under the Boost Software License, Version 1.0.
(See accompanying file LICENSE_1_0.txt)
""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.
""",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n",
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n",
    "CDDL-1.0": """The contents of this file are subject to the terms of the
Common Development and Distribution License (the License).
""".replace(" (the License)", ""),
    "Artistic-2.0": "You may redistribute and/or modify it under the\nterms of the Artistic License 2.0.\n",
    "CC0-1.0": """To the extent possible under law, the author has waived all
copyright and related or neighboring rights to this work.
""",
    **{
        f"CC-BY{code}-4.0": f"This work is licensed under a\nCreative Commons Attribution{name} 4.0 International License.\n"
        for code, name in [("", ""), ("-SA", "-ShareAlike"), ("-NC", "-NonCommercial"), ("-ND", "-NoDerivatives"), ("-NC-SA", "-NonCommercial-ShareAlike"), ("-NC-ND", "-NonCommercial-NoDerivatives")]
    },
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
""",
}


def test_notices_in_files(spark):
    forms = {
        "plain": lambda line: line,
        "indented": lambda line: f"    {line}" if line else line,
        "hash": lambda line: f"# {line}".rstrip(),
        "slashes": lambda line: f"// {line}".rstrip(),
        "stars": lambda line: f" * {line}".rstrip(),
    }
    assert len(NOTICES) >= 20
    rows, want = [], {}
    for name, notice in NOTICES.items():
        for form, change in forms.items():
            text = "\n".join(map(change, f"Copyright someone\n\n{notice}\nOther text follows here".split("\n")))
            want[len(rows)] = (name, form)
            rows.append((len(rows), f"/*\n{text}\n */" if form == "stars" else text))
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = {want[i]: got.get(i) for i in want if got.get(i) != [want[i][0]]}
    assert not missed


def test_each_sentence_knows_itself(spark):
    rows = [(i, s + ".") for i, (_, s) in enumerate(licenses.SENTENCES)]
    got = {r.doc_id: r.sentences for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got.get(i) for i, _ in rows} == {i: [k] for i, (k, _) in enumerate(licenses.SENTENCES)}
