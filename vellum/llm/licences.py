"""Licence scan by sentence rules: known sentences become identifiers, and ordered rules read the identifier sequences."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, by identifier. Case, punctuation and spacing don't count.
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit_line": ("Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "SPDX-License-Identifier: MIT", "Distributed under the MIT License"),
    "mit_grant": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',),
    "mit_notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "mit_as_is": ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',),
    "mit_liability": ("IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",),
    "isc_grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "isc_line": ("Licensed under the ISC License", "SPDX-License-Identifier: ISC"),
    "bsd_grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "bsd_source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "bsd_binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    "bsd_endorse": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "bsd3_line": ("Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"),
    "bsd2_line": ("Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"),
    "apache_line": ("Licensed under the Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License")', "SPDX-License-Identifier: Apache-2.0", "This project is licensed under the Apache License, Version 2.0"),
    "apache_use": ("you may not use this file except in compliance with the License",),
    "apache_as_is": ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',),
    "apache_see": ("See the License for the specific language governing permissions and limitations under the License",),
    "gpl3_line": ("This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only"),
    "gpl2_line": ("This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only"),
    "gpl3_later": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "gpl2_later": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "SPDX-License-Identifier: GPL-2.0-or-later"),
    "gpl_warranty": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",),
    "gpl_see": ("See the GNU General Public License for more details",),
    "agpl_line": ("Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only"),
    "lgpl_line": ("Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only"),
    "mpl_line": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "mpl_copy": ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",),
    "cc0_line": ("Licensed under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"),
    "cc_by_line": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc_by_sa_line": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc_by_nc_line": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc_by_nd_line": ("Licensed under CC BY-ND 4.0", "SPDX-License-Identifier: CC-BY-ND-4.0"),
    "unlicense": ("This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"),
    "all_rights": ("All rights reserved",),
}

# Licences by the sequence of identifiers that states them. Earlier rules win and use their sentences up.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is", "mit_liability")),
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("Apache-2.0", ("apache_line", "apache_use", "apache_as_is", "apache_see")),
    ("Apache-2.0", ("apache_line", "apache_as_is", "apache_see")),
    ("GPL-3.0-or-later", ("gpl3_later", "gpl_warranty", "gpl_see")),
    ("GPL-2.0-or-later", ("gpl2_later", "gpl_warranty", "gpl_see")),
    ("MPL-2.0", ("mpl_line", "mpl_copy")),
    ("GPL-3.0-or-later", ("gpl3_later",)),
    ("GPL-2.0-or-later", ("gpl2_later",)),
    ("ISC", ("isc_grant",)),
    ("MIT", ("mit_line",)),
    ("ISC", ("isc_line",)),
    ("BSD-3-Clause", ("bsd3_line",)),
    ("BSD-2-Clause", ("bsd2_line",)),
    ("Apache-2.0", ("apache_line",)),
    ("GPL-3.0-only", ("gpl3_line",)),
    ("GPL-2.0-only", ("gpl2_line",)),
    ("AGPL-3.0-only", ("agpl_line",)),
    ("LGPL-3.0-only", ("lgpl_line",)),
    ("MPL-2.0", ("mpl_line",)),
    ("CC0-1.0", ("cc0_line",)),
    ("CC-BY-4.0", ("cc_by_line",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_line",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_line",)),
    ("CC-BY-ND-4.0", ("cc_by_nd_line",)),
    ("Unlicense", ("unlicense",)),
)

#: Where a sentence ends: closing punctuation before white space or the end of the text, and the end of a line.
LINE_END = r"[.!?]+(?:\s|$)|[\r\n]+"
#: The same for sentences that run over several lines.
TEXT_END = r"[.!?]+(?:\s|$)|\n\s*\n"
#: The same with clauses apart, for texts whose line ends are lost.
CLAUSE_END = r"[.!?:;]+(?:\s|$)|\n\s*\n"
ENDS = {"by_line": LINE_END, "by_text": TEXT_END, "by_clause": CLAUSE_END}
OTHER = r"[^a-z0-9]+"
#: The number of a list item before a sentence.
NUMBER = "^[0-9]+ "

#: Words of which every known sentence holds one, so that other sentences need no normalising.
KEYWORDS = ("licens", "permission", "distribut", "copyright", "software", "warrant", "rights")


def known_pieces(sentences: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """Normalised sentence -> identifier. A form with an end inside it (`v. 2.0`) is known by what stands before."""
    normal = lambda s: re.sub(OTHER, " ", re.split(LINE_END, s.lower())[0]).strip()
    return {normal(form): name for name, forms in sentences.items() for form in forms}


def keywords_of(known: dict[str, str]) -> list[str]:
    """KEYWORDS, and the longest word of each known sentence that holds none of them."""
    others = {max(s.split(), key=len) for s in known if not any(k in s for k in KEYWORDS)}
    return [*KEYWORDS, *sorted(others)]


def _sequence(text: Column, ends: str, known: dict[str, str]) -> Column:
    """The identifiers of a text's known sentences in order, as `<a><b>`."""
    held = lambda s: reduce(Column.__or__, [F.contains(s, F.lit(k)) for k in keywords_of(known)])
    kept = F.filter(F.split(F.lower(text), ends), held)
    stated = F.transform(kept, lambda s: F.regexp_replace(F.trim(F.regexp_replace(s, OTHER, " ")), NUMBER, ""))
    ids = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.array_join(F.transform(F.filter(stated, lambda s: s.isin(list(known))), lambda s: F.concat(F.lit("<"), F.element_at(ids, s), F.lit(">"))), "")


def _apply(sequence: Column, rules: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """Licences whose rules fit, in the order of the rules; sentences that a rule has used fit no later one."""
    table = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit("".join(f"<{x}>" for x in ids)).alias("ids")) for name, ids in rules])
    start = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("found"))

    def step(at: Column, rule: Column) -> Column:
        fits = F.contains(at["left"], rule["ids"])
        left = F.when(fits, F.replace(at["left"], rule["ids"], F.lit("|"))).otherwise(at["left"])
        found = F.when(fits & ~F.array_contains(at["found"], rule["licence"]), F.array_append(at["found"], rule["licence"])).otherwise(at["found"])
        return F.struct(left.alias("left"), found.alias("found"))

    none = F.array().cast("array<string>")
    return F.when(F.length(sequence) > 0, F.aggregate(table, start, step)["found"]).otherwise(none)


def scan_licences(docs: DataFrame, sentences: dict[str, tuple[str, ...]] | None = None, rules=RULES) -> DataFrame:
    """Licences that documents state: doc_id, sentences (identifiers in order), licences (sorted, `,` between; empty: none).

    The whole text is cut into sentences three times: at line ends, over line ends, and at colons and semicolons too, so that
    one-line statements, texts wrapped over lines and texts in one line are met. A known sentence becomes its identifier,
    others drop out, and the ordered rules read each sequence; the longest one is returned. Each document is judged from its
    own row: nothing shuffles. Null and empty texts state nothing; repeated rows are judged alike; other columns of `docs` are
    ignored.
    """
    known = known_pieces(SENTENCES if sentences is None else sentences)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", *[_sequence(text, ends, known).alias(name) for name, ends in ENDS.items()])
    found = reduce(F.array_union, [_apply(F.col(name), rules) for name in ENDS])
    sequence = reduce(lambda a, b: F.when(F.length(a) >= F.length(b), a).otherwise(b), map(F.col, ENDS))
    return rows.select("doc_id", sequence.alias("sentences"), F.array_join(F.array_sort(found), ",").alias("licences"))


def op7_licences(spark, sf_dir: str) -> DataFrame:
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """The same steps as DuckDB SQL: one step of the chain for each rule."""
    known = known_pieces(SENTENCES)
    ids = "MAP {" + ", ".join(f"'{s}': '<{x}>'" for s, x in known.items()) + "}"

    def sequence(ends: str) -> str:
        pieces = f"list_transform(string_split_regex(lower(coalesce(text, '')), '{ends}'), lambda s: regexp_replace(trim(regexp_replace(s, '{OTHER}', ' ', 'g')), '{NUMBER}', ''))"
        return f"array_to_string(list_transform(list_filter({pieces}, lambda s: map_contains(ids, s)), lambda s: ids[s]), '')"

    steps = [f"""s0 AS (SELECT doc_id, {sequence(LINE_END)} AS a, {sequence(TEXT_END)} AS b, {sequence(CLAUSE_END)} AS c FROM documents, (SELECT {ids} AS ids)),
r0 AS (SELECT doc_id, a, b, c, a AS x, b AS y, c AS z, []::VARCHAR[] AS f FROM s0)"""]
    for k, (name, rule) in enumerate(RULES, 1):
        r = "".join(f"<{x}>" for x in rule)
        left = ", ".join(f"replace({x}, '{r}', '|') AS {x}" for x in "xyz")
        fits = " OR ".join(f"contains({x}, '{r}')" for x in "xyz")
        steps.append(f"r{k} AS (SELECT doc_id, a, b, c, {left}, CASE WHEN {fits} THEN list_append(f, '{name}') ELSE f END AS f FROM r{k - 1})")
    longest = "CASE WHEN length(CASE WHEN length(a) >= length(b) THEN a ELSE b END) >= length(c) THEN CASE WHEN length(a) >= length(b) THEN a ELSE b END ELSE c END"
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, {longest} AS sentences, array_to_string(list_sort(list_distinct(f)), ',') AS licences FROM r{len(RULES)}"


OP7_SQL = _sql()
