"""Licences of files: cosine of their passages to templates, and inheritance from the nearest directory that has one.

1. A passage is a line, a sentence of a line, two or three lines together, the first lines of the file together (``HEADERS``), or the whole text
   of a licence file (by its name). Templates are one-line notices and full licence texts or the head of a long one.
2. A passage and a template are vectors of words, weighted by their count and by how few files of the corpus have the word. Words of no template
   count with the weight of a word that no file has. Only passages that can reach the least cosine are looked at: the rarest words of a template
   that together hold more than the rest may lack are its signs, and a passage without any sign cannot reach it.
3. A file's licence is that of its best passage. A full text goes before a notice, since its sentences are notices of other licences, too, and
   that all rights are reserved counts only where no licence is named, since many licence texts say so of their holders. A licence file also
   gives its licence to its directory, the best one if there are several.
4. A file without a licence of its own gets that of the nearest directory above it that has one: every directory is joined with the
   licences of all directories on its path, and the files with the result of their directory.

Nulls: a null text has no lines, a null path no directories. Rows with equal or null ``doc_id`` are files of their own as long as
their paths differ; equal rows get equal results. Columns other than ``doc_id``, ``path`` and ``text`` are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.llm.scratch import written

# Notices by which files name their licence, with its public short name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("Proprietary", "All rights reserved"),
)
RESERVED = "Proprietary"
_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)


def _gnu_notice(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} License as published by the "
        f"Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed "
        "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        f"PARTICULAR PURPOSE. See the GNU {name} License for more details. You should have received a copy of the GNU {name} License along with "
        "this program."
    )


# Licence texts and the notices of several sentences that licences ask for; of texts of many pages their first ones.
FULL_TEXTS = (
    (
        "MIT",
        "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR "
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
        "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("BSD-2-Clause", _BSD + _AS_IS),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _AS_IS),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
        "or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION "
        "1. Definitions. License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 "
        "of this document. Licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the License. "
        "Legal Entity shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common "
        "control with that entity.",
    ),
    ("GPL-3.0", _gnu_notice("General Public", "3")),
    ("GPL-2.0", _gnu_notice("General Public", "2")),
    ("LGPL-3.0", _gnu_notice("Lesser General Public", "3")),
    (
        "GPL-3.0",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and "
        "distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, "
        "copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take "
        "away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to "
        "share and change all versions of a program--to make sure it remains free software for all its users.",
    ),
    (
        "GPL-2.0",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy "
        "and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most software are "
        "designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your "
        "freedom to share and change free software--to make sure the software is free for all its users.",
    ),
    (
        "LGPL-3.0",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to "
        "copy and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser General "
        "Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional "
        "permissions listed below.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "MPL-2.0",
        "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to "
        "the creation of, or owns Covered Software. 1.2. Contributor Version means the combination of the Contributions of others (if any) used "
        "by a Contributor and that particular Contributor's Contribution. 1.3. Contribution means Covered Software of a particular Contributor.",
    ),
)
LEAST = 0.6
# First lines of a file that are scored together, and neighbouring lines anywhere in it.
HEADERS = (5, 10, 20, 40)
JOINED = (2, 3)
LICENSE_NAMES = r"(?i)^(licen[cs]e|copying|notice)\b.*"
WORD = r"[a-z0-9]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def template_words(templates) -> list[tuple[int, str, int]]:
    """(number of the template, word, count) of the templates."""
    out = []
    for i, (_, text) in enumerate(templates):
        words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
        out += [(i, w, words.count(w)) for w in sorted(set(words))]
    return out


def word_weights(files: DataFrame, vocabulary: list[str]) -> tuple[dict[str, float], float]:
    """Inverse document frequency of the templates' words over all files, and that of a word in no file."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    found = files.select(F.explode(F.array_intersect(_words(F.coalesce("text", F.lit(""))), known)).alias("word"))
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = files.count()
    return {w: math.log((1 + n) / (1 + counts.get(w, 0))) + 1 for w in vocabulary}, math.log(1 + n) + 1


def signs(templates: list[tuple[int, str, int]], idf: dict[str, float], least: float) -> list[str]:
    """Words of which a passage must have one. By the inequality of Cauchy and Schwarz a passage's cosine to a template is at most the root of
    the share of the template's squared weight that lies in words which the passage has. Rare words come first, so that few passages have any."""
    out: set[str] = set()
    for number in {t[0] for t in templates}:
        weights = sorted(((idf[w], (idf[w] * n) ** 2, w) for t, w, n in templates if t == number), reverse=True)
        left = total = sum(v for _, v, _ in weights)
        for _, value, word in weights:
            # Without the words so far, what is left does not suffice.
            if left < least**2 * total:
                break
            out.add(word)
            left -= value
    return sorted(out)


def passages(text: Column, whole: Column) -> Column:
    """Structs of the first ``line`` and the words ``w`` of everything that is scored in a text; all of it as one where ``whole``."""
    lines = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("line"), _words(line).alias("w"), line.alias("text")))
    n = F.size(lines)
    at = lambda line, w: F.struct(line.alias("line"), w.alias("w"))
    single = F.transform(lines, lambda x: at(x["line"], x["w"]))
    cut = F.transform(lines, lambda x: F.struct(x["line"].alias("line"), F.split(x["text"], r"(?<=[.!?;:])\s+", -1).alias("parts")))
    several = F.filter(cut, lambda x: F.size(x["parts"]) > 1)
    sentences = F.flatten(F.transform(several, lambda x: F.transform(x["parts"], lambda part: at(x["line"], _words(part)))))
    joined = []
    for k in JOINED:
        windows = F.transform(single, lambda x: at(x["line"], F.flatten(F.slice(single["w"], x["line"] + 1, F.lit(k)))))  # noqa: B023
        joined.append(F.slice(windows, F.lit(1), F.greatest(n - k + 1, F.lit(0))))
    top = lambda k: F.array(at(F.lit(0), F.flatten(F.slice(single["w"], F.lit(1), F.lit(k)))))
    none = F.slice(single, F.lit(1), F.lit(0))
    # A shorter text is all in the header of the size before.
    headers = [F.when(n > least, top(k)).otherwise(none) for least, k in zip((max(JOINED), *HEADERS), HEADERS, strict=False)]
    every = F.array(at(F.lit(0), F.flatten(single["w"])))
    return F.concat(single, sentences, *joined, *headers, F.when(whole & (n > max(HEADERS)), every).otherwise(none))


def licensed_lines(files: DataFrame, templates=TEMPLATES, least: float = LEAST, texts=FULL_TEXTS, names: str = LICENSE_NAMES) -> DataFrame:
    """``doc_id, path, line, license, score`` of the best passage of every file that has one; ``line`` is its first."""
    spark: SparkSession = files.sparkSession
    every = (*templates, *texts)
    known = template_words(every)
    vocabulary = sorted({w for _, w, _ in known})
    idf, unknown = word_weights(files, vocabulary)
    needed = F.array(*[F.lit(w) for w in signs(known, idf, least)])
    text = F.coalesce("text", F.lit(""))
    named = F.coalesce(F.regexp_extract("path", r"[^/]*$", 0).rlike(names), F.lit(False))
    # Files without any sign go before their passages are made.
    hopeful = files.filter(F.arrays_overlap(_words(text), needed))
    found = hopeful.select("doc_id", "path", F.explode(passages(text, named)).alias("_p"))
    found = found.select("doc_id", "path", F.col("_p.line").alias("line"), F.col("_p.w").alias("_words"))
    found = found.filter(F.arrays_overlap("_words", needed)).withColumn("passage", F.monotonically_increasing_id())
    # Numbers are fixed once written. Passages are shuffled whole, so none of the sums below moves their words again.
    lines = written(found, "licence-lines").repartition("passage")
    key = ["passage", "doc_id", "path", "line"]
    words = lines.select(*key, F.explode("_words").alias("word")).groupBy(*key, "word").agg(F.count(F.lit(1)).alias("n"))
    # As many rows as the templates have words.
    weights = spark.createDataFrame([(w, float(idf[w])) for w in vocabulary], "word string, idf double")
    norms = [math.sqrt(sum((idf[w] * n) ** 2 for u, w, n in known if u == t)) for t in range(len(every))]
    shares = [(t, w, float(idf[w] * n / norms[t])) for t, w, n in known]
    against = spark.createDataFrame(shares, "template int, word string, share double")
    weighed = words.join(F.broadcast(weights), "word", "left").withColumn("v", F.col("n") * F.coalesce("idf", F.lit(unknown)))
    norm = weighed.groupBy("passage").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dots = weighed.join(F.broadcast(against), "word").groupBy(*key, "template").agg(F.sum(F.col("v") * F.col("share")).alias("dot"))
    scored = dots.join(norm, "passage").select(*key, "template", F.round(F.col("dot") / F.col("norm"), 9).alias("score"))
    license = F.element_at(F.array(*[F.lit(name) for name, _ in every]), F.col("template") + 1)
    scored = scored.filter(F.col("score") >= least).withColumn("license", license)
    order = [(F.col("license") == RESERVED).alias("r"), (F.col("template") < len(templates)).alias("t"), (-F.col("score")).alias("s")]
    best = F.min(F.struct(*order, "line", "license")).alias("b")
    return scored.groupBy("doc_id", "path").agg(best).select("doc_id", "path", "b.line", "b.license", (-F.col("b.s")).alias("score"))


def directory(path: Column) -> Column:
    """What is before the last slash; a path without one lies in the root, which is the empty string."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/+$", "")


def ancestors(folder: Column) -> Column:
    """The directory itself and all above it, nearest first, with the root."""
    parts = F.split(folder, "/", -1)
    size = F.size(parts)
    every = F.transform(F.sequence(F.lit(0), size - 1), lambda up: F.array_join(F.slice(parts, F.lit(1), size - up), "/"))
    return F.array_distinct(F.concat(every, F.array(F.lit(""))))


def inherited(files: DataFrame, own: DataFrame, names: str = LICENSE_NAMES) -> DataFrame:
    """``doc_id, path, license, score, line, inherited_from, distance`` of every file; the last two tell the directory and how far up it is, the
    line and score are those of the file's own licence. A file without any has nulls."""
    name = F.regexp_extract("path", r"[^/]*$", 0)
    given = own.filter(name.rlike(names)).withColumn("dir", directory(F.col("path")))
    best = F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("b")
    given = written(given.groupBy("dir").agg(best).select(F.col("dir").alias("_from"), F.col("b.license").alias("_given")), "directory-licences")
    placed = files.select("doc_id", "path").withColumn("_dir", directory(F.col("path")))
    folders = placed.select("_dir").filter("_dir is not null").distinct()
    above = folders.select("_dir", F.posexplode(ancestors(F.col("_dir"))).alias("distance", "_from")).join(given, "_from")
    nearest = above.groupBy("_dir").agg(F.min(F.struct("distance", "_from", "_given")).alias("n"))
    nearest = written(nearest.select(F.col("_dir").alias("_of"), "n.*"), "nearest-licences")
    mine = own.select(F.col("doc_id").alias("_id"), F.col("path").alias("_path"), "line", "license", "score")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("path").eqNullSafe(F.col("_path"))
    found = placed.join(mine, same, "left").join(nearest, F.col("_dir") == F.col("_of"), "left")
    none = F.col("license").isNull()
    return found.select(
        "doc_id",
        "path",
        F.coalesce("license", "_given").alias("license"),
        "score",
        "line",
        F.when(none, F.col("_from")).alias("inherited_from"),
        F.when(none, F.col("distance")).alias("distance"),
    )


def scan(files: DataFrame, templates=TEMPLATES, least: float = LEAST, names: str = LICENSE_NAMES, texts=FULL_TEXTS) -> DataFrame:
    """The licence of every file, its own or the nearest directory's."""
    plain = files.select("doc_id", F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    return inherited(plain, written(licensed_lines(plain, templates, least, texts, names), "file-licences"), names)


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: a folder for each source, in it one for each language, in it folders of a thousand and of a hundred ids.
    One in ten files is a licence file, by a hash of its id, which no source or language is aligned with; a quarter of these lies in the folders
    of each depth, all other files in those of a hundred ids."""
    i = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    part = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), "/", "_"), F.lit("none"))
    folders = F.array(part("source"), part("lang"), F.floor(i / 1000).cast("string"), F.floor(i / 100).cast("string"))
    # With the language, which the folder of a source does not tell.
    licence = F.concat_ws("-", F.lit("LICENSE"), part("lang"), i.cast("string"))
    draw = F.pmod(F.xxhash64(i), F.lit(40))
    depth = (F.floor(draw / 10) + 1).cast("int")
    above = F.concat_ws("/", F.slice(folders, F.lit(1), depth), licence)
    leaf = F.concat_ws("/", folders, F.concat(i.cast("string"), F.lit(".txt")))
    return docs.select("doc_id", F.when(draw % 10 == 0, above).otherwise(leaf).alias("path"), "text")
