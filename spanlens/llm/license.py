"""License scans: TF-IDF cosine of notices and licence files to templates, then inheritance from the nearest directory.

Units are the lines and the paragraphs (runs of lines between blank ones, comment marks aside) that hold one of CUES,
and whole files named like LICENSE or COPYING; every whole text is looked at. A unit's terms weigh (1 + ln tf) * idf.
idf is that of the templates, which are texts of licences, their titles, short notices and SPDX tags; a term of no
template weighs STRANGE, so a holder's name costs a notice little however large the corpus is, and no file's licence
depends on other files. The template with the largest cosine over all units of a file is the file's licence if it
reaches the threshold; of equal ones the one with more terms, so that a title with its version wins over a bare one. A
file without its own takes the licence of the licence files in the nearest directory above it. Directories are resolved
once each, before files are joined to them, so a directory with any share of all files costs one row. Only template
terms are broadcast, and their number is fixed by the templates. DataFrame functions and SQL only.
"""

from __future__ import annotations

import re
from math import log, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CUES = ("licen", "copyright", "spdx", "permission", "redistribut", "warrant", "public domain", "gpl", "free software", "creative commons", "cc by", "cc-by")
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
BLANK = r"\n[ \t\r/*#;%!<>|~=+.-]*\n"
FILE_NAMES = r"^(licen[cs]e|copying|notice|copyright|unlicense)([^a-z].*)?$"
STRANGE = 2.0
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1_2 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
_FREE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_BOOST = 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'


def _gnu(name: str, of: str, version: str, thing: str = "program") -> str:
    """The notice by which files name a version of a GNU licence."""
    end = "" if name == "GPL" else f" {of}"
    return f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU{end} General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


#: Licences, and the texts, titles and notices by which files name them (SPDX tags are added by rule).
TEXTS: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", _gnu("AGPL", "Affero", "3")),
    "Apache-2.0": ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Licensed under the Apache License, Version 2.0.", "Apache License 2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    "BSD-2-Clause": ("BSD 2-Clause License", f"{_BSD} {_BSD_1_2} {_BSD_END}", _BSD, "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 2-Clause License."),
    "BSD-3-Clause": ("BSD 3-Clause License", f"{_BSD} {_BSD_1_2} {_BSD_3} {_BSD_END}", _BSD_3, "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", _BOOST, "Distributed under the Boost Software License, Version 1.0."),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0.", "Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Creative Commons CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0."),
    "EPL-2.0": ("Eclipse Public License - v 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    "GPL": ("GNU GENERAL PUBLIC LICENSE", "Licensed under the GNU General Public License."),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991", _gnu("GPL", "", "2"), "This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _gnu("GPL", "", "3"), "This work is licensed under the GNU General Public License, version 3."),
    "ISC": ("ISC License", f"{_ISC} {_ISC_END}", _ISC),
    "LGPL-2.1": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", _gnu("LGPL", "Lesser", "2.1", "library"), "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _gnu("LGPL", "Lesser", "3", "library"), "This library is licensed under the GNU Lesser General Public License, version 3."),
    "MIT": ("MIT License", f"{_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY}", _MIT, "Released under the MIT License.", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", _FREE, "The Unlicense"),
    "Zlib": ("zlib License", _ZLIB),
}


def _with_tags(texts: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    """(licence, template) with the SPDX tags of each licence, those of GNU licences also with their endings."""
    out = [(name, text) for name, own in texts.items() for text in own]
    for name in texts:
        ends = ("", "-only", "-or-later") if "GPL-" in name else ("",)
        out += [(name, f"SPDX-License-Identifier: {name}{end}") for end in ends]
    return out


TEMPLATES = _with_tags(TEXTS)


def template_terms(templates: list[tuple[str, str]] = TEMPLATES) -> list[tuple[str, int, int, str, float, float]]:
    """Rows (licence, template, its number of terms, term, idf, weight over the template's length)."""
    counts = []
    for _, text in templates:
        own: dict[str, int] = {}
        for term in re.findall(TERM, text.lower()):
            own[term] = own.get(term, 0) + 1
        counts.append(own)
    df: dict[str, int] = {}
    for own in counts:
        for term in own:
            df[term] = df.get(term, 0) + 1
    idf = {t: log((1 + len(templates)) / (1 + n)) + 1 for t, n in df.items()}
    out = []
    for at, ((name, _), own) in enumerate(zip(templates, counts, strict=True)):
        weight = {t: (1 + log(n)) * idf[t] for t, n in own.items()}
        length = sqrt(sum(w * w for w in weight.values()))
        out += [(name, at, len(own), t, idf[t], w / length) for t, w in weight.items()]
    return out


def _vocabulary(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """term, idf and the templates that hold it: (name, at, terms, w)."""
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    by: dict[tuple[str, float], list[str]] = {}
    for name, at, terms, term, idf, w in template_terms(templates):
        by.setdefault((term, idf), []).append(f"named_struct('name', {quote(name)}, 'at', {at}, 'terms', {terms}, 'w', {w!r}D)")
    rows = ", ".join(f"({quote(term)}, {idf!r}D, array({', '.join(own)}))" for (term, idf), own in by.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(term, idf, own)")


def parent(path: Column) -> Column:
    """Directory of a path; empty for a bare name."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/+$", "")


def _licence_name(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"[^/]*$", 0).rlike(FILE_NAMES)


def own_licences(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.6) -> DataFrame:
    """(file, licence, score) of each file(file, text) with a unit whose cosine to a template reaches the threshold.

    Of equal scores the template with more terms is taken, then the first name. Texts go through one exchange, by file
    and unit, and only those of units.
    """
    cue = lambda x: " or ".join(f"contains(lower({x}), '{c}')" for c in CUES)
    text = files.select("file", F.coalesce("text", F.lit("")).alias("text")).where(cue("text"))
    whole = F.when(_licence_name(F.col("file")), F.array("text")).otherwise(F.expr("cast(array() as array<string>)"))
    units = text.select("file", F.explode(F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", BLANK), whole))).alias("words")).where(cue("words"))
    units = units.withColumn("unit", F.xxhash64("words")).dropDuplicates(["file", "unit"])
    terms = units.select("file", "unit", F.explode(F.regexp_extract_all(F.lower("words"), F.lit(f"({TERM})"), F.lit(1))).alias("term"))
    tf = terms.groupBy("file", "unit", "term").agg(F.count("*").alias("tf"))
    known = tf.join(F.broadcast(_vocabulary(files.sparkSession, templates)), "term", "left")
    weighed = known.select("file", "unit", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(STRANGE))).alias("w"), F.posexplode_outer("own").alias("n", "o"))
    square = F.when(F.coalesce("n", F.lit(0)) == 0, F.col("w") * F.col("w")).otherwise(0.0)
    dots = weighed.groupBy("file", "unit", F.col("o.at").alias("at")).agg(F.first("o.name").alias("name"), F.first("o.terms").alias("terms"), F.sum(F.col("w") * F.col("o.w")).alias("dot"), F.sum(square).alias("square"))
    found = dots.groupBy("file", "unit").agg(F.sqrt(F.sum("square")).alias("norm"), F.collect_list(F.when(F.col("dot").isNotNull(), F.struct("dot", "terms", "name"))).alias("all"))
    best = F.expr(f"filter(transform(all, x -> named_struct('less', -round(x.dot / norm, 6), 'fewer', -x.terms, 'licence', x.name)), y -> -y.less >= {threshold})")
    top = found.select("file", F.array_min(best).alias("b")).where("b is not null").groupBy("file").agg(F.min("b").alias("b"))
    return top.select("file", "b.licence", (-F.col("b.less")).alias("score"))


def license_scan(files: DataFrame, path_col: str = "path", text_col: str = "text", **scan) -> DataFrame:
    """One row per distinct path: path, licence, score, found (``own``, ``inherited`` or ``none``), licence_dir.

    A path that occurs in several rows counts as one file with the best unit of all. A null path is left out; a null or
    empty text has no unit. Directory licences come from files named like LICENSE or COPYING with their own licence,
    best score first, then name; a file in the same directory inherits it too. Other columns are left out. An empty
    table gives no rows.
    """
    rows = files.select(F.col(path_col).cast("string").alias("file"), F.col(text_col).cast("string").alias("text")).where("file is not null")
    own = own_licences(rows, **scan)
    paths = rows.select("file").distinct()
    holders = own.where(_licence_name(F.col("file"))).withColumn("dir", parent(F.col("file"))).groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("less"), "licence")).alias("best"))
    dirs = paths.select(parent(F.col("file")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    steps = dirs.select("dir", F.explode(above).alias("up"))
    near = steps.join(holders.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("up", "best"), F.length("up")).alias("near"))
    out = paths.join(own, "file", "left").withColumn("dir", parent(F.col("file"))).join(near, "dir", "left")
    mine, theirs = F.col("licence").isNotNull(), F.col("near").isNotNull()
    return out.select(
        F.col("file").alias(path_col),
        F.coalesce("licence", F.col("near.best.licence")).alias("licence"),
        F.coalesce("score", -F.col("near.best.less")).alias("score"),
        F.when(mine, "own").when(theirs, "inherited").otherwise("none").alias("found"),
        F.when(mine, F.lit(None)).otherwise(F.col("near.up")).alias("licence_dir"),
    )
