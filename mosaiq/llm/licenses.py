"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU_HEADER = """This {thing} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version.
This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details.
You should have received a copy of the GNU {kind} along with this {thing}."""
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'


def _gnu(kind: str, version: str, thing: str = "program") -> str:
    old = version.startswith("2")
    return _GNU_HEADER.format(kind=kind, version=version, thing=thing, stop=";" if old else ":", comma=";" if old else ",")


# The notices that public licences ask for, whole where they are short, then their openings and short lines that name a licence.
TEMPLATES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0 opening": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "Apache-2.0 file": 'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.',
    "MIT": _MIT_GRANT + ' The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT grant": _MIT_GRANT,
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": f"{_BSD_OPENING} {_BSD_TWO} {_BSD_END}",
    "BSD-2-Clause opening": _BSD_OPENING,
    "BSD-3-Clause": f"{_BSD_OPENING} {_BSD_TWO} {_BSD_THIRD} {_BSD_END}",
    "GPL-2.0": _gnu("General Public License", "2"),
    "GPL-3.0": _gnu("General Public License", "3"),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1", "library"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3", "library"),
    "AGPL-3.0": _gnu("Affero General Public License", "3"),
    "GPL-2.0 file": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "GPL-3.0 file": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "LGPL-2.1 file": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "LGPL-3.0 file": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "AGPL-3.0 file": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MPL-2.0 file": "Mozilla Public License Version 2.0 1. Definitions",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Proprietary": "All rights reserved.",
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT line": "Released under the MIT License.",
    "MIT title": "MIT License",
    "ISC line": "Licensed under the ISC License.",
    "BSD-2-Clause line": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause line": "Licensed under the BSD 3-Clause License.",
    "MPL-2.0 line": "Licensed under the Mozilla Public License, version 2.0.",
    "GPL-2.0 line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1 line": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0 line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 line": "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 line": "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0 line": "This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0 line": "This work is licensed under a Creative Commons Attribution NonCommercial ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0 line": "This work is licensed under a Creative Commons Attribution NonCommercial NoDerivatives 4.0 International License.",
    "CC0-1.0 line": "Released under CC0 1.0 Universal, public domain dedication.",
}
TEMPLATES |= {f"CC-{x}-4.0 short": f"Licensed under CC {x} 4.0." for x in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")}
TEMPLATES |= {f"{x} SPDX": f"SPDX-License-Identifier: {x}" for x in sorted({k.split(" ")[0] for k in TEMPLATES} - {"Proprietary"})}
#: What says nothing more than that rights are held; any licence in the same file goes before it.
WEAKEST = "Proprietary"
TRIGGERS = r"licen[cs]e|copyright|permission|redistribut|public domain|rights reserved|spdx|free software|\bwarrant(?:y|ies)\b|\bliab(?:le|ility)\b"
FILE_NAMES = r"^(licen[cs]e|copying|notice|unlicense)(\..*)?$"
LEAST_COSINE = 0.6
#: A word that fewer than one in so many headers have weighs as if one in so many had it, at any size of the corpus.
RAREST = 1000


def tokens(text: Column) -> Column:
    """Lower-case letter and digit runs as a column."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda x: x != "")


def name_words(template: str, text: str) -> set[str]:
    """The words a line must hold to match: those of the licence's name that the template has, numbers only after SPDX."""
    words = lambda x: {w for w in re.split("[^a-z0-9]+", x.lower()) if w}
    return {w for w in words(template.split(" ")[0]) & words(text) if "spdx" in words(text) or not w.isdigit()}


def header_texts(text: Column) -> Column:
    """What of a text may state a licence, as distinct strings of words.

    Lines that speak of licences, one by one; paragraphs that do, however their lines are broken
    and commented; and all such paragraphs of the text together, which is the header or the licence
    file as a whole. A paragraph ends where a line has no letter or digit.
    """
    speaks = lambda x: F.lower(x).rlike(TRIGGERS)
    plain = lambda x: F.array_join(tokens(x), " ")
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), speaks)
    paragraphs = F.transform(F.filter(F.split(whole, r"\n(?:[^\p{L}\p{N}\n]*\n)+"), speaks), plain)
    together = F.when(F.size(paragraphs) > 1, F.array(F.array_join(paragraphs, " "))).otherwise(F.array().cast("array<string>"))
    return F.when(speaks(whole), F.array_distinct(F.concat(F.transform(lines, plain), paragraphs, together))).otherwise(F.array().cast("array<string>"))


def scan(files: DataFrame, *, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: dict[str, str] | None = None, least_cosine: float = LEAST_COSINE) -> DataFrame:
    """The licence of every file; one row per row of files.

    Columns: doc_id, path, own_license and own_score (best template of any of the file's
    header_texts(), by cosine of TF-IDF), license (own or inherited), license_from ("own",
    "directory" or null), license_dir (the directory it comes from). A file without one of its own
    inherits from the nearest directory above it, its own first, that holds a licence file
    (FILE_NAMES) with a match; of several the smallest licence name counts. A template that names
    its licence matches only what holds that name (name_words), whatever else they share, and
    WEAKEST counts only where nothing else matches. Whole texts are looked at, however long. A null
    text has no licence; a null path inherits nothing; ties of score go to the smaller name;
    repeated rows are judged one by one; other columns are ignored; an empty table gives an empty
    result.
    """
    templates = TEMPLATES if templates is None else templates
    spark = files.sparkSession
    rows = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), header_texts(F.col(text_col)).alias("lines"))
    rows = materialize(rows.withColumn("row_id", F.monotonically_increasing_id()), "licence-rows")
    # Headers are distinct; copies of one cost a single row, and a number stands for it from here on.
    headers = rows.select(F.explode("lines").alias("text")).groupBy(F.md5("text").alias("key")).agg(F.min("text").alias("text"), F.count("*").alias("uses"))
    headers = materialize(headers.withColumn("line", F.monotonically_increasing_id()), "licence-headers")
    vocabulary = spark.createDataFrame(sorted({(k.split(" ")[0], k, v) for k, v in templates.items()}), "license string, template string, text string")
    known = vocabulary.select("license", "template", F.explode(tokens(F.col("text"))).alias("token")).groupBy("license", "template", "token").agg(F.count("*").alias("tf"))
    needed = spark.createDataFrame([(k, w, 1) for k, v in sorted(templates.items()) for w in sorted(name_words(k, v))], "template string, token string, needed int")
    known = known.join(needed, ["template", "token"], "left").fillna(0, ["needed"])
    terms = materialize(headers.select("line", "uses", F.explode(tokens(F.col("text"))).alias("token")).groupBy("line", "uses", "token").agg(F.count("*").alias("tf")), "licence-terms")
    # Inverse document frequency over all headers, bounded by RAREST; a word that no header has counts as rare.
    lines = headers.agg(F.coalesce(F.sum("uses"), F.lit(0)).alias("n"))
    n = lines.first()["n"]
    idf = materialize(terms.groupBy("token").agg(F.sum("uses").alias("df")).select("token", F.log(F.least((F.lit(float(n)) + 1) / (F.col("df") + 1), F.lit(float(RAREST)))).alias("raw")).select("token", (F.col("raw") + 1).alias("idf")), "licence-idf")
    rare = math.log(min(n + 1, RAREST)) + 1
    known = known.join(idf, "token", "left").withColumn("weight", F.col("tf") * F.coalesce("idf", F.lit(rare)))
    known = materialize(known.withColumn("norm", F.sqrt(F.sum(F.col("weight") ** 2).over(Window.partitionBy("template")))).select("license", "template", "token", (F.col("weight") / F.col("norm")).alias("unit"), "needed", F.sum("needed").over(Window.partitionBy("template")).alias("names")), "licence-templates")
    weighed = terms.join(idf, "token").withColumn("weight", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("line").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    # The templates are a fixed list of a few hundred terms, so their side is small whatever the corpus.
    dots = weighed.join(F.broadcast(known), "token").groupBy("line", "license", "template").agg(F.sum(F.col("weight") * F.col("unit")).alias("dot"), F.sum("needed").alias("named"), F.max("names").alias("names")).where("named = names")
    scored = dots.join(norms, "line").select("line", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= least_cosine)
    # Least first: the weakest last, then by falling score, then by name.
    rank = F.struct((F.col("license") == WEAKEST).alias("weak"), (-F.col("score")).alias("s"), "license")
    best = materialize(scored.groupBy("line").agg(F.min(rank).alias("m")), "licence-matches")
    matched = best.join(headers.select("line", "key"), "line").select("key", "m")
    per_row = rows.select("row_id", F.explode(F.transform("lines", F.md5)).alias("key")).join(matched, "key").groupBy("row_id").agg(F.min("m").alias("m"))
    own = materialize(rows.drop("lines").join(per_row, "row_id", "left").select("row_id", "doc_id", "path", F.col("m.license").alias("own_license"), (-F.col("m.s")).alias("own_score")), "licence-own")
    parts = F.split("path", "/")
    directory = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    holders = own.where(F.col("own_license").isNotNull() & F.lower(F.element_at(parts, -1)).rlike(FILE_NAMES)).select(directory.alias("dir"), "own_license").groupBy("dir").agg(F.min("own_license").alias("dir_license"))
    # Directories, not files, go up the tree: each one once, however many files it has.
    dirs = own.where(F.col("own_license").isNull() & F.col("path").isNotNull()).select(directory.alias("of")).distinct().withColumn("names", F.split("of", "/"))
    above = dirs.select("of", F.explode(F.sequence(F.lit(0), F.size("names"))).alias("depth"), "names").select("of", "depth", F.array_join(F.slice("names", F.lit(1), F.col("depth")), "/").alias("dir"))
    nearest = above.join(holders, "dir").groupBy("of").agg(F.max(F.struct("depth", "dir", "dir_license")).alias("h")).select("of", F.col("h.dir").alias("license_dir"), F.col("h.dir_license").alias("dir_license"))
    out = own.withColumn("of", directory).join(materialize(nearest, "licence-nearest"), "of", "left")
    has = F.col("own_license").isNotNull()
    return out.select("doc_id", "path", "own_license", "own_score", F.when(has, F.col("own_license")).otherwise(F.col("dir_license")).alias("license"), F.when(has, F.lit("own")).when(F.col("dir_license").isNotNull(), F.lit("directory")).alias("license_from"), F.when(~has, F.col("license_dir")).alias("license_dir"))
