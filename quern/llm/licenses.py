"""License scans: sparse TF-IDF cosine of headers and license files to templates, then inheritance by directory.

1. Units of a document: every line, every block of consecutive lines that
   aren't blank (headers), and the whole text (license files). Words are runs of
   letters and digits in lower case, "licence" spelt "license". Words weigh tf
   times idf; idf comes from the documents of the whole corpus that hold a word
   of the templates, the templates counting as documents too.
2. Candidates. A unit at a cosine of c to a template shares words with it whose
   weights have c squared of its squared length. The rarest words of
   a template that leave less than that are its keys: a unit without any key of
   any template can't reach the threshold, and is not compared. The whole text
   is compared if it holds a key of a template of several sentences.
3. The candidates' words are joined with the templates' weights. The best
   template at a cosine of ``MIN_COSINE`` or more, with two words shared at
   least, is the unit's license; a document's is that of its best unit.
4. A document is a license file if its whole text has a license, or if its
   blocks and lines with one hold at least half of its words.
5. A document without a license of its own takes that of the license file in
   the nearest directory above it: directories are joined with their ancestors,
   and the deepest match wins.

The templates bound their vocabulary, so its weights and keys may be literals
and broadcasts. Texts don't shuffle, but for the words of the candidates.

Defined cases: null or empty text has no license of its own and may inherit; a
null path has no directory; ties between templates go to the first listed,
between units to the whole text, then the first block, in it the block before
its lines; between license files of a directory to the least path; repeated
rows get equal results; an empty table gives an empty result. Only the id, the
text and the path are read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import Scratch, salted_join

_WARRANTY = (
    "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a "
    "particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action "
    "of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution."
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
    "prior written permission."
)
_BSD_WARRANTY = (
    "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties "
    "of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, "
    "incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or "
    "business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any "
    "way out of the use of this software, even if advised of the possibility of such damage."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0"
)
_APACHE_BASIS = (
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF "
    "ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)


def _gnu(name: str, version: int) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either "
        f"version {version} of the License, or (at your option) any later version."
    )


def _gnu_hope(name: str) -> str:
    return (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        f"PARTICULAR PURPOSE. See the GNU {name} for more details."
    )


_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"

#: Names, public notices, headers and texts of common licenses. What two licenses share word by word goes to the first.
TEMPLATES = (
    ("MIT", "MIT License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", _MIT),
    ("MIT", _MIT_NOTICE),
    ("MIT", _WARRANTY),
    ("MIT", f"MIT License {_MIT} {_MIT_NOTICE} {_WARRANTY}"),
    ("Apache-2.0", "Apache License Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE_BASIS),
    ("Apache-2.0", f"{_APACHE} {_APACHE_BASIS}"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-3.0", _gnu(_GPL, 3)),
    ("GPL-3.0", f"{_gnu(_GPL, 3)} {_gnu_hope(_GPL)}"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-2.0", _gnu(_GPL, 2)),
    ("GPL-2.0", f"{_gnu(_GPL, 2)} {_gnu_hope(_GPL)}"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("LGPL-3.0", f"{_gnu(_LGPL, 3)} {_gnu_hope(_LGPL)}"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("AGPL-3.0", f"{_gnu(_AGPL, 3)} {_gnu_hope(_AGPL)}"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", _BSD_NAMES),
    ("BSD-3-Clause", f"{_BSD} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-2-Clause", _BSD),
    ("BSD-2-Clause", _BSD_SOURCE),
    ("BSD-2-Clause", _BSD_BINARY),
    ("BSD-2-Clause", _BSD_WARRANTY),
    ("BSD-2-Clause", f"{_BSD} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_WARRANTY}"),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC0-1.0", "Dedicated to the public domain under a CC0 1.0 License."),
)
MIN_COSINE, MIN_SHARED = 0.7, 2
FILE_SHARE = 0.5
#: Words from which on a template is a text, which whole documents are compared with.
LONG = 20
#: What parts words (of lower-cased text) and blocks.
GAP = r"[^a-z0-9]+"
BLANK_LINES = r"\n[ \t\r]*\n"
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(GAP, text.lower().replace("licenc", "licens")) if w]


def vocabulary() -> list[str]:
    return sorted({w for _, t in TEMPLATES for w in words_of(t)})


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.replace(F.lower(text), F.lit("licenc"), F.lit("licens")), GAP), lambda w: w != "")


def inverse_frequencies(texts: DataFrame) -> tuple[dict[str, float], float]:
    """idf of the templates' words, and of any other word, over all rows of ``texts(text)``."""
    known = vocabulary()
    found = texts.select(F.explode(F.array_intersect(split_words(F.col("text")), F.array(*map(F.lit, known)))).alias("w")).groupBy("w").count()
    df = {r["w"]: r["count"] for r in found.collect()}  # one row a word of the templates, at most
    n = texts.count() + len(TEMPLATES)
    for _, t in TEMPLATES:
        for w in set(words_of(t)):
            df[w] = df.get(w, 0) + 1
    return {w: math.log((1 + n) / (1 + df[w])) + 1 for w in known}, math.log(1 + n) + 1


def vectors(idf: dict[str, float]) -> list[dict[str, float]]:
    """Each template's words with their weights over its length."""
    out = []
    for _, text in TEMPLATES:
        own = words_of(text)
        vec = {w: own.count(w) * idf[w] for w in sorted(set(own))}
        size = math.sqrt(sum(x * x for x in vec.values()))
        out.append({w: x / size for w, x in vec.items()})
    return out


def keys(vecs: list[dict[str, float]], idf: dict[str, float], least: int = 0) -> list[str]:
    """Words of which a unit must hold one to reach ``MIN_COSINE`` with any template of ``least`` words or more."""
    out = set()
    for vec, (_, text) in zip(vecs, TEMPLATES, strict=True):
        left = 1.0
        for w, x in sorted(vec.items(), key=lambda p: (-idf[p[0]], p[0])) if len(words_of(text)) >= least else ():
            # A slack keeps rounding on the safe side.
            if left < MIN_COSINE**2 - 1e-6:
                break
            out.add(w)
            left -= x * x
    return sorted(out)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: dict[str, str]) -> DataFrame:
    """A small table made in the JVM from one literal; values hold no blanks."""
    text = F.lit("\n".join(" ".join(map(str, r)) for r in rows))
    fields = spark.range(1, numPartitions=1).select(F.explode(F.split(text, "\n")).alias("x")).select(F.split("x", " ").alias("x"))
    return F.broadcast(fields.select(*[F.col("x")[i].cast(kind).alias(name) for i, (name, kind) in enumerate(schema.items())]))


def units(texts: DataFrame, short: list[str], long: list[str]) -> DataFrame:
    """(rid, b, l, unit) of the candidates among the units of ``texts(rid, text)``: l is -1 for a block, and so are b and l for a text."""
    holds = lambda text, words: F.arrays_overlap(split_words(text), F.array(*map(F.lit, words)))
    blocks = texts.select("rid", F.posexplode(F.split("text", BLANK_LINES)).alias("b", "block")).select("rid", "b", F.split(F.trim(F.col("block"), F.lit("\n")), "\n").alias("lines"))
    blocks = blocks.where(holds(F.array_join("lines", "\n"), short))
    lines = blocks.select("rid", "b", F.posexplode("lines").alias("l", "unit")).where(holds(F.col("unit"), short))
    many = blocks.where(F.size("lines") > 1).select("rid", "b", F.lit(-1).alias("l"), F.array_join("lines", "\n").alias("unit"))
    whole = texts.where(F.col("text").rlike(BLANK_LINES) & holds(F.col("text"), long)).select("rid", F.lit(-1).alias("b"), F.lit(-1).alias("l"), F.col("text").alias("unit"))
    return lines.unionByName(many).unionByName(whole)


def matches(scratch: Scratch, texts: DataFrame) -> DataFrame:
    """(rid, b, l, i, score, n, total): the units of ``texts(rid, text)`` with a license, the number of their template, their words and those of their text.

    Equal texts share ``rid`` and count as one: their words come several times, which changes no cosine.
    """
    spark = scratch.spark
    idf, other = inverse_frequencies(texts)
    vecs = vectors(idf)
    short, long = keys(vecs, idf), keys(vecs, idf, LONG)
    holds = F.arrays_overlap(split_words(F.col("text")), F.array(*map(F.lit, short)))
    some = scratch.save(texts.where(holds))
    found = units(some, short, long)
    unit = ("rid", "b", "l")
    words = found.select(*unit, F.explode(split_words(F.col("unit"))).alias("w")).groupBy(*unit, "w").agg(F.count("*").alias("tf"))
    weights = literal_rows(spark, [(w, repr(v)) for w, v in sorted(idf.items())], {"w": "string", "v": "double"})
    words = scratch.save(words.join(weights, "w", "left").select(*unit, "w", (F.col("tf") * F.coalesce("v", F.lit(other))).alias("u")))
    norms = words.groupBy(*unit).agg(F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("norm"))
    tables = literal_rows(spark, [(i, w, repr(x)) for i, vec in enumerate(vecs) for w, x in vec.items()], {"i": "int", "w": "string", "x": "double"})
    dots = words.join(tables, "w").groupBy(*unit, "i").agg(F.sum(F.col("u") * F.col("x")).alias("dot"), F.count("*").alias("shared")).where(F.col("shared") >= MIN_SHARED)
    near = dots.join(norms, [*unit]).select(*unit, "i", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= MIN_COSINE)
    best = near.groupBy(*unit).agg(F.max(F.struct("score", (-F.col("i")).alias("i"))).alias("m")).select(*unit, (-F.col("m.i")).alias("i"), "m.score")
    sizes = found.select(*unit, F.regexp_count("unit", F.lit(WORD)).cast("long").alias("n"))
    total = some.select("rid", F.regexp_count("text", F.lit(WORD)).cast("long").alias("total"))
    one = lambda rows, by, value: rows.groupBy(*by).agg(F.max(value).alias(value))
    return scratch.save(best.join(one(sizes, unit, "n"), [*unit]).join(one(total, ("rid",), "total"), "rid").select(*unit, "i", "score", "n", "total"))


def own_licenses(scratch: Scratch, texts: DataFrame) -> DataFrame:
    """(rid, own_license, score, n_matches, is_license_file) of the texts with a license."""
    found = matches(scratch, texts)
    names = F.array(*[F.lit(n) for n, _ in TEMPLATES])
    first = F.max(F.struct("score", (-F.col("b")).alias("b"), (-F.col("l")).alias("l"), (-F.col("i")).alias("i"))).alias("m")
    # A block's words count once: its own if it has a license, or those of its lines.
    held = found.where("b >= 0").groupBy("rid", "b").agg(F.coalesce(F.max(F.when(F.col("l") < 0, F.col("n"))), F.sum("n")).alias("n")).groupBy("rid").agg(F.sum("n").alias("held"))
    top = found.groupBy("rid").agg(first, F.count("*").alias("n_matches"), F.max(F.col("b") < 0).alias("whole"), F.max("total").alias("total"))
    return top.join(held, "rid", "left").select(
        "rid",
        F.element_at(names, (F.lit(1) - F.col("m.i")).cast("int")).alias("own_license"),
        F.col("m.score").alias("score"),
        "n_matches",
        (F.col("whole") | (F.coalesce("held", F.lit(0)) >= FILE_SHARE * F.col("total"))).alias("is_license_file"),
    )


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, key: str = "doc_id", path: Column | None = None) -> DataFrame:
    """One row a file: key, path, own_license, score, n_matches, is_license_file, license, inherited_from.

    ``path`` is an expression over ``files``, by default its column ``path``.
    """
    scratch = Scratch(files.sparkSession, "licenses")
    rows = files.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("text"), (F.col("path") if path is None else path).alias("path"))
    texts = rows.select(F.xxhash64("text").alias("rid"), "text")
    own = own_licenses(scratch, texts)
    rows = rows.select("key", "path", directory(F.col("path")).alias("dir"), F.xxhash64("text").alias("rid")).join(own, "rid", "left").drop("rid")
    rows = scratch.save(rows.withColumn("n_matches", F.coalesce("n_matches", F.lit(0).cast("long"))).withColumn("is_license_file", F.coalesce("is_license_file", F.lit(False))))
    given = rows.where("is_license_file and dir is not null").groupBy(F.col("dir").alias("above")).agg(F.min(F.struct("path", "own_license")).alias("g"))
    parts = F.split("dir", "/")
    dirs = rows.where("dir is not null").select("dir").distinct()
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))).alias("a")).select("dir", "a.*").distinct()
    near = above.join(given, "above").groupBy("dir").agg(F.max(F.struct("depth", F.col("g.path").alias("path"), F.col("g.own_license").alias("lic"))).alias("near"))
    rows = salted_join(rows, near, "dir", F.struct("key", "path"))
    return rows.select(
        F.col("key").alias(key), "path", "own_license", "score", "n_matches", "is_license_file",
        F.coalesce("own_license", F.col("near.lic")).alias("license"),
        F.when(F.col("own_license").isNull(), F.col("near.path")).alias("inherited_from"),
    )
