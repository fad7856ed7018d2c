"""Licence scan by sentence recognition and ordered rules.

A text is cut into sentences at line ends and after ``.``, ``!`` or ``?`` (lines that
are visibly wrapped are joined first), and every sentence is normalised to its
lower-case ASCII letters and digits, parted by single blanks, so indents and comment
marks don't count. Known licence sentences have identifiers (``SENTENCES``; several
wordings may share one). They may go over any line ends, and over ends of sentences
only where they are cut themselves ("v. 2.0"). The identifiers of a text, in order, with a gap wherever other sentences
lie between, make its sequence; blank lines and bare list numbers are no sentences.
``RULES`` lists sequences for licences, the more specific first: each rule that
occurs adds its licence and takes its sentences away from later rules.

All known sentences are one regular expression, so all texts are scanned in one pass
and only hits are shuffled. The SQL differs: there, blank lines and list numbers make
gaps, and sentences go neither over line ends that aren't visibly wrapped nor over cuts.

Defined results: a row (doc_id, licenses, sentences) for each text with a known
sentence; ``licenses`` may be empty if no rule matches. Null and empty texts have
none. Equal rows give one row; rows of one doc_id with different texts one each; a
null doc_id is a value like any other. Very long texts are scanned whole. Other columns
are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (identifier, sentence)
SENTENCES = [
    ("mit-name", "MIT License"),
    ("mit-name", "The MIT License"),
    ("mit-name", "The MIT License (MIT)"),
    ("mit-ref", "Released under the MIT License"),
    ("mit-ref", "Licensed under the MIT License"),
    ("mit-ref", "This project is licensed under the MIT License"),
    ("mit-ref", "Distributed under the MIT License"),
    ("mit-ref", "SPDX-License-Identifier: MIT"),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit-warranty", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'),
    ("mit-liability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-ref", "SPDX-License-Identifier: ISC"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-source", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd2-ref", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd3-ref", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd3-ref", "Licensed under the BSD 3-Clause License"),
    ("apache2-ref", "Licensed under the Apache License, Version 2.0"),
    ("apache2-ref", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("apache2-ref", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'),
    ("apache2-ref", "SPDX-License-Identifier: Apache-2.0"),
    ("apache2-obtain", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache2-warranty", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
    ("apache2-see", "See the License for the specific language governing permissions and limitations under the License"),
    ("gpl2-ref", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl2-ref", "SPDX-License-Identifier: GPL-2.0-only"),
    ("gpl3-ref", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl3-ref", "Licensed under the GNU General Public License, version 3"),
    ("gpl3-ref", "SPDX-License-Identifier: GPL-3.0-only"),
    ("gpl3-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl3-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl2-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl2-later", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("gpl-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("gpl-see", "See the GNU General Public License for more details"),
    ("gpl-copy", "You should have received a copy of the GNU General Public License along with this program"),
    ("lgpl21-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("lgpl21-later", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("lgpl3-later", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl3-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl3-later", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("agpl3-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("agpl3-later", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("epl2-ref", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("epl2-ref", "SPDX-License-Identifier: EPL-2.0"),
    ("zlib-warranty", "This software is provided 'as-is', without any express or implied warranty"),
    ("zlib-liability", "In no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("zlib-ref", "SPDX-License-Identifier: Zlib"),
    ("bsl1-ref", "Distributed under the Boost Software License, Version 1.0"),
    ("bsl1-ref", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("bsl1-ref", "SPDX-License-Identifier: BSL-1.0"),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd-ref", "SPDX-License-Identifier: 0BSD"),
    ("wtfpl-title", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("wtfpl-title", "SPDX-License-Identifier: WTFPL"),
    ("cddl1-ref", "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("cddl1-ref", "SPDX-License-Identifier: CDDL-1.0"),
    ("artistic2-ref", "You may redistribute and/or modify it under the terms of the Artistic License 2.0"),
    ("artistic2-ref", "SPDX-License-Identifier: Artistic-2.0"),
    ("cc-by-sa-ref", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nd-ref", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa-ref", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd-ref", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("lgpl3-ref", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("agpl3-ref", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("mpl2-ref", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl2-ref", "SPDX-License-Identifier: MPL-2.0"),
    ("cc0-ref", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc0-ref", "SPDX-License-Identifier: CC0-1.0"),
    ("cc-by-ref", "Licensed under CC BY 4.0"),
    ("cc-by-ref", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-ref", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-ref", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-ref", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved"),
]

#: (licence, sequence of identifiers), the more specific first
RULES = [
    ("MIT", "mit-grant mit-notice mit-warranty mit-liability"),
    ("MIT", "mit-grant mit-notice mit-warranty"),
    ("ISC", "isc-grant"),
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-endorse"),
    ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary"),
    ("Apache-2.0", "apache2-ref apache2-obtain apache2-warranty apache2-see"),
    ("Apache-2.0", "apache2-ref apache2-obtain"),
    ("Zlib", "zlib-warranty zlib-liability zlib-grant"),
    ("GPL-3.0-or-later", "gpl3-later gpl-warranty gpl-see"),
    ("GPL-2.0-or-later", "gpl2-later gpl-warranty gpl-see"),
    ("GPL-3.0-or-later", "gpl3-later"),
    ("GPL-2.0-or-later", "gpl2-later"),
    ("LGPL-2.1-or-later", "lgpl21-later"),
    ("LGPL-3.0-or-later", "lgpl3-later"),
    ("AGPL-3.0-or-later", "agpl3-later"),
    ("EPL-2.0", "epl2-ref"),
    ("Zlib", "zlib-grant"),
    ("Zlib", "zlib-ref"),
    ("BSL-1.0", "bsl1-ref"),
    ("0BSD", "0bsd-grant"),
    ("0BSD", "0bsd-ref"),
    ("WTFPL", "wtfpl-title"),
    ("CDDL-1.0", "cddl1-ref"),
    ("Artistic-2.0", "artistic2-ref"),
    ("MIT", "mit-name"),
    ("MIT", "mit-ref"),
    ("ISC", "isc-ref"),
    ("BSD-2-Clause", "bsd2-ref"),
    ("BSD-3-Clause", "bsd3-ref"),
    ("Apache-2.0", "apache2-ref"),
    ("GPL-3.0-only", "gpl3-ref"),
    ("GPL-2.0-only", "gpl2-ref"),
    ("LGPL-3.0-only", "lgpl3-ref"),
    ("AGPL-3.0-only", "agpl3-ref"),
    ("MPL-2.0", "mpl2-ref"),
    ("CC0-1.0", "cc0-ref"),
    ("CC-BY-NC-SA-4.0", "cc-by-nc-sa-ref"),
    ("CC-BY-NC-ND-4.0", "cc-by-nc-nd-ref"),
    ("CC-BY-ND-4.0", "cc-by-nd-ref"),
    ("CC-BY-NC-4.0", "cc-by-nc-ref"),
    ("CC-BY-SA-4.0", "cc-by-sa-ref"),
    ("CC-BY-4.0", "cc-by-ref"),
    ("Unlicense", "unlicense"),
    ("all-rights-reserved", "reserved"),
]

_WRAP_LOWER = (r"([a-zA-Z,;)\"])\r?\n([a-z(])", "1 2")
_WRAP_UPPER = (r"([A-Z][A-Z,]+)\r?\n([A-Z][A-Z])", "1 2")
_END = r"[.!?]+(?:[ \t\r]+|$)|\r?\n|[.!?]+\r?\n"
_NOISE = r"[^a-z0-9]+"
#: Nothing but bare list numbers.
_NUMBERS = r"\A(?:[SL][0-9]{1,3})*\z"


def normalised(sentence: str) -> str:
    import re

    return re.sub(_NOISE, " ", sentence.lower()).strip()


def _unwrapped(text):
    for pattern, _ in (_WRAP_LOWER, _WRAP_UPPER):
        text = F.regexp_replace(text, pattern, "$1 $2")
    return text


def _known_pattern() -> str:
    """Any known sentence between two ends, where single words may be parted by line ends,
    and where the sentence itself is cut, as after the abbreviation in "v. 2.0", by that cut."""
    import re

    forms = {"[ LS]".join(n.replace(" ", "[ L]") for x in re.split(_END, s) if (n := normalised(x))): normalised(s) for _, s in SENTENCES}
    sentences = sorted(forms, key=lambda x: (-len(forms[x]), x))
    return f"[SL]({'|'.join(sentences)})(?=[SL])"


def _marked(text):
    """The normalised text, with S for the ends of sentences and L for other line ends."""
    text = F.regexp_replace(F.lower(_unwrapped(text)), r"[.!?]+(?:[ \t\r\n]+|\z)", "S")
    for pattern, mark in ((r"[^a-z0-9S\n]+", " "), (r" ?\n[ \n]*", "L"), (r"[ L]?S[ LS]*", "S")):
        text = F.regexp_replace(text, pattern, mark)
    return F.concat(F.lit("S"), F.btrim(text, F.lit(" LS")), F.lit("S"))


def scan(docs: DataFrame) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # B and E around each known sentence; what is before a B lies between two of them
    said = texts.select("doc_id", F.xxhash64("text").alias("version"), F.regexp_replace(_marked(F.col("text")), _known_pattern(), "B$1E").alias("said"))
    hits = said.filter(F.contains("said", F.lit("E"))).dropDuplicates(["doc_id", "version"])
    ids = F.create_map(*[F.lit(x) for s in sorted({(normalised(s), i) for i, s in SENTENCES}) for x in s])
    parts = F.split("said", "E")
    found = F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda x: F.struct(
            (~F.substring_index(x, "B", 1).rlike(_NUMBERS)).alias("gap"),
            F.element_at(ids, F.translate(F.substring_index(x, "B", -1), "LS", "  ")).alias("sentence_id"),
        ),
    )
    by_text = hits.select("doc_id", found.alias("found"))
    parts = F.transform("found", lambda x, i: F.concat(F.when((i > 0) & x["gap"], F.lit("~ ")).otherwise(F.lit("")), x["sentence_id"]))
    by_text = by_text.select("doc_id", F.transform("found", lambda x: x["sentence_id"]).alias("sentences"), F.concat(F.lit(" "), F.array_join(parts, " "), F.lit(" ")).alias("seq"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f" {seq} ").alias("seq")) for name, seq in RULES])
    start = F.struct(F.col("seq").alias("seq"), F.expr("cast(array() as array<string>)").alias("names"))

    def apply(state, rule):
        hit = F.contains(state["seq"], rule["seq"])
        return F.struct(
            F.replace(state["seq"], rule["seq"], F.lit(" ~ ")).alias("seq"),
            F.when(hit, F.array_union(state["names"], F.array(rule["name"]))).otherwise(state["names"]).alias("names"),
        )

    return by_text.select("doc_id", F.aggregate(rules, start, apply, lambda s: s["names"]).alias("licenses"), "sentences")


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql() -> str:
    """The same scan in DuckDB's SQL."""
    table = ", ".join(f"({_literal(s)}, {_literal(i)})" for s, i in sorted({(normalised(s), i) for i, s in SENTENCES}))
    text = "text"
    for pattern, _ in (_WRAP_LOWER, _WRAP_UPPER):
        text = f"regexp_replace({text}, {_literal(pattern)}, '\\1 \\2', 'g')"
    steps, seq, last = [], "seq", "r0"
    for k, (name, ids) in enumerate(RULES, 1):
        rule = _literal(f" {ids} ")
        steps.append(
            f"r{k} AS (SELECT doc_id, version, sentences, replace(seq, {rule}, ' ~ ') AS seq, "
            f"CASE WHEN contains(seq, {rule}) AND NOT list_contains(names, {_literal(name)}) THEN list_append(names, {_literal(name)}) ELSE names END AS names FROM {last})"
        )
        last = f"r{k}"
    return f"""WITH known(sentence, sentence_id) AS (VALUES {table}),
cut AS (SELECT DISTINCT doc_id, text AS version, string_split_regex({text}, {_literal(_END)}) AS parts FROM documents WHERE text IS NOT NULL),
said AS (SELECT doc_id, version, unnest(parts) AS raw, generate_subscripts(parts, 1) AS place FROM cut),
hits AS (SELECT doc_id, version, place, sentence_id FROM (SELECT *, trim(regexp_replace(lower(raw), '{_NOISE}', ' ', 'g')) AS sentence FROM said) JOIN known USING (sentence)),
gaps AS (SELECT *, lag(place) OVER (PARTITION BY doc_id, version ORDER BY place) < place - 1 AS gap FROM hits),
r0 AS (SELECT doc_id, version, list(sentence_id ORDER BY place) AS sentences, ' ' || string_agg(CASE WHEN gap THEN '~ ' ELSE '' END || sentence_id, ' ' ORDER BY place) || ' ' AS seq, []::VARCHAR[] AS names FROM gaps GROUP BY doc_id, version),
{(',' + chr(10)).join(steps)}
SELECT doc_id, names AS licenses, sentences FROM {last}"""
