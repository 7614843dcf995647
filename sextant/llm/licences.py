"""Licence scan by sparse TF-IDF cosine, then inheritance from directories (operator 3).

Lines that speak of a licence, the four lines from each on, paragraphs and runs
of paragraphs are compared with template notices, from one line to a whole
licence, as sparse TF-IDF vectors. A file without a licence of its own takes
that of the nearest directory above it that holds a licence file, found by
joins on paths.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import text_or_empty, written

# Clauses that licences share, and notices and whole short licences by SPDX identifier.
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_HOLDERS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_NO_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_AS_IS = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_USEFUL = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details. You should have received a copy of the GNU {} along with this program. If not, see https://www.gnu.org/licenses/."
_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", f"{_APACHE} {_AS_IS}"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", _GRANT),
    ("MIT", f"{_GRANT} {_NO_WARRANTY}"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", _GNU.format(_GPL, 3)),
    ("GPL-3.0", f"{_GNU.format(_GPL, 3)} {_USEFUL.format(_GPL, _GPL)}"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", _GNU.format(_GPL, 2)),
    ("GPL-2.0", f"{_GNU.format(_GPL, 2)} {_USEFUL.format(_GPL, _GPL)}"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", _GNU.format(_LGPL, 3)),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", _GNU.format(_LGPL, 2.1)),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", _GNU.format(_AGPL, 3)),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", f"{_REDISTRIBUTION} {_SOURCE} {_BINARY} {_NAMES}"),
    ("BSD-3-Clause", f"{_REDISTRIBUTION} {_SOURCE} {_BINARY} {_NAMES} {_HOLDERS}"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-2-Clause", f"{_REDISTRIBUTION} {_SOURCE} {_BINARY}"),
    ("BSD-2-Clause", f"{_REDISTRIBUTION} {_SOURCE} {_BINARY} {_HOLDERS}"),
    ("ISC", "Licensed under the ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0 Creative Commons Attribution"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0 Creative Commons Attribution ShareAlike"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0 Creative Commons Attribution NonCommercial"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "CC0 1.0 Universal public domain dedication"),
    ("Unlicense", "This is free and unencumbered software released into the public domain Unlicense"),
    ("Proprietary", "Copyright all rights reserved proprietary and confidential"),
    ("Proprietary", "All rights reserved"),
]
#: Counts only where a file has no notice of another licence, since open licences reserve rights, too.
WEAKEST = "Proprietary"
HINT = r"(?i)licen[cs]|copyright|all rights reserved|public domain|spdx|\bcc0\b|redistribut|warrant|permission|without even|free software|provided .{0,40}as.is"
SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+(?: (?:OR|AND|WITH) [A-Za-z0-9.+-]+)*)"
#: Names of licence files, without a directory.
FILE_NAME = r"(?i)^((un)?licen[cs]e|copying)([._-].*)?$"
#: Words that every notice has and that weigh nothing.
STOP = ["the", "of", "and", "to", "in", "a", "an", "or", "is", "this", "that", "for", "with", "by", "be", "it", "on", "as", "are", "at", "any"]
#: A unit counts as a notice from this cosine on.
LEAST = 0.5
#: Lines of a header, from one that speaks of a licence on.
HEADER = 4
#: Between paragraphs: lines that hold nothing, or only the marks of a comment.
BETWEEN = r"\R(?:[ \t]*[#*;%/<!>-]*[ \t]*\R)+"


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits, stop words left out."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda w: ~w.isin(STOP))


def template_words() -> list[tuple[int, str, str]]:
    """(number, licence, word) of each word of each template."""
    return [(i, k, w) for i, (k, t) in enumerate(TEMPLATES) for w in re.findall(r"[^\W_]+", t.lower()) if w not in STOP]


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is computed once, however often later columns and filters name it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def squares(words: Column) -> Column:
    """The sum of the squared counts of the distinct words."""
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("s"))

    def add(a: Column, w: Column) -> Column:
        k = F.when(a["w"] == w, a["k"] + 1).otherwise(1)  # the k-th of its kind adds 2k - 1
        return F.struct(w.alias("w"), k.alias("k"), (a["s"] + 2 * k - 1).alias("s"))

    return F.aggregate(F.array_sort(words), start, add, lambda a: a["s"])


def notice_units(files: DataFrame) -> DataFrame:
    """(file, level, line, rest, known) of what may be a notice; files are (file, text).

    Levels: 0 lines that speak of a licence, 1 the HEADER lines from each on, 2
    paragraphs with such a line, 3 runs of two and more such paragraphs. line is
    the line, the paragraph or the first paragraph of the run. known are the
    unit's words that templates have, rest the squared counts of its others. A
    unit that can't reach LEAST is left out, and no other: words of no template
    weigh most and once each at least, the others weigh at most that, and their
    squared counts are at most the square of their number."""
    some = files.where(F.col("text").rlike(HINT))
    some = _once(some, "ls", F.split("text", r"\R"))
    some = _once(some, "ps", F.split("text", BETWEEN))
    some = _once(some, "told", F.filter(F.sequence(F.lit(0), F.size("ls") - 1), lambda i: F.get("ls", i).rlike(HINT)))
    some = _once(some, "flags", F.transform("ps", lambda p: p.rlike(HINT)))
    flag = lambda i: F.coalesce(F.get("flags", i), F.lit(False))
    every = F.sequence(F.lit(0), F.size("ps") - 1)
    first = F.filter(every, lambda i: flag(i) & ((i == 0) | ~flag(i - 1)) & flag(i + 1))
    last = F.filter(every, lambda i: flag(i) & (i > 0) & flag(i - 1) & ~flag(i + 1))
    unit = lambda level, line, text: F.struct(F.lit(level).alias("level"), line.alias("line"), text.alias("t"))
    units = F.concat(
        F.transform("told", lambda i: unit(0, i, F.get("ls", i))),
        F.transform("told", lambda i: unit(1, i, F.array_join(F.slice("ls", i + 1, HEADER), " "))),
        F.transform(F.filter(every, flag), lambda i: unit(2, i, F.get("ps", i))),
        F.transform(F.arrays_zip(first.alias("a"), last.alias("b")), lambda r: unit(3, r["a"], F.array_join(F.slice("ps", r["a"] + 1, r["b"] - r["a"] + 1), " "))),
    )
    rows = some.select("file", F.explode(units).alias("u")).select("file", "u.level", "u.line", "u.t")
    rows = _once(rows, "words", words_of(F.col("t"))).drop("t")
    vocabulary = sorted({w for _, _, w in template_words()})
    rows = _once(rows, "known", F.filter("words", lambda w: w.isin(vocabulary)))
    rows = rows.where((F.size("known") > 0) & (F.pow(F.size("known").cast("double"), 2) * (1 - LEAST**2) >= LEAST**2 * (F.size("words") - F.size("known"))))
    return rows.select("file", "level", "line", squares(F.filter("words", lambda w: ~w.isin(vocabulary))).alias("rest"), "known")


def _weights(tokens: DataFrame, keys: list[str], idf: DataFrame) -> DataFrame:
    """Rows of keys and word with their TF-IDF weight."""
    tf = tokens.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("tf"))
    return tf.join(F.broadcast(idf), "word").withColumn("w", F.col("tf") * F.col("idf")).drop("idf")


def matched_notices(units: DataFrame) -> DataFrame:
    """(file, level, line, licence, score): the best template of each unit from LEAST on; ties go to the first name.

    The frequencies of words are counted over all units and templates. Only the
    templates' own words (a fixed list) have weights of their own; any other
    word weighs as one seen once."""
    spark = units.sparkSession
    key = ["file", "level", "line"]
    template_tokens = spark.createDataFrame(template_words(), "template int, licence string, word string")
    own = template_tokens.select("template", "word").distinct()
    units = written(units, "licence-units")
    tokens = units.select(*key, "rest", F.explode("known").alias("word"))
    total = units.count() + len(TEMPLATES)
    seen = units.select(F.explode(F.array_distinct("known")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    in_templates = own.groupBy("word").agg(F.count(F.lit(1)).alias("m"))
    idf = in_templates.join(seen, "word", "left").select("word", (F.log((F.lit(total) + 1.0) / (F.coalesce("n", F.lit(0)) + F.col("m") + 1.0)) + 1.0).alias("idf"))
    idf = spark.createDataFrame(idf.collect(), idf.schema)  # at most the templates' words
    rarest = F.log((F.lit(total) + 1.0) / 2.0) + 1.0
    t = _weights(template_tokens, ["template", "licence"], idf)
    t = t.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("template")))).select("template", "licence", "word", (F.col("w") / F.col("norm")).alias("u"))
    d = _weights(tokens, [*key, "rest"], idf)
    norm = d.groupBy(*key, "rest").agg(F.sum(F.col("w") * F.col("w")).alias("s")).select(*key, F.sqrt(F.col("s") + F.col("rest") * rarest * rarest).alias("norm"))
    dot = d.join(F.broadcast(t), "word").groupBy(*key, "template", "licence").agg(F.sum(F.col("w") * F.col("u")).alias("dot"))
    score = F.round(F.col("dot") / F.col("norm"), 9)
    scored = dot.join(norm, key).withColumn("score", score).where(F.col("score") >= LEAST)
    best = scored.groupBy(*key).agg(F.min(F.struct(-F.col("score"), "licence")).alias("b"))
    return best.select(*key, F.col("b.licence").alias("licence"), (-F.col("b.col1")).alias("score"))


def directory(path: Column) -> Column:
    """The directory of a path, empty at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def above(folder: Column) -> Column:
    """The folder and all folders above it, down to the root, nearest first."""
    parts = F.split(folder, "/")
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def licences(files: DataFrame, id_col: str, path: Column, text_col: str = "text") -> DataFrame:
    """(id, licence, how, score, from_path) of each row of files.

    how is own (an SPDX line, with score 1; else the notice of the best score,
    then of the smallest unit and the first line; Proprietary only where no
    other is found), inherited (from the licence file of from_path, the nearest
    directory above) or none. A licence file is one of the usual names, or a
    text whose lines all speak of a licence. Of several in one directory the
    least path counts. Null texts count as empty; rows with a null path inherit
    nothing; repeated rows repeat; other columns are ignored. No rows give no
    rows."""
    rows = files.select(F.col(id_col).alias("id"), path.cast("string").alias("path"), text_or_empty(text_col).alias("text"))
    mark = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-"))
    keyed = rows.withColumn("file", F.substring(F.unhex(F.sha2(F.concat_ws("\0", mark("path"), mark("id"), "text"), 256)), 1, 16))
    notices = written(matched_notices(notice_units(keyed.select("file", "text"))), "licence-notices")
    first = F.struct(F.col("licence") == WEAKEST, -F.col("score"), "level", "line", "licence")
    own = written(notices.groupBy("file").agg(F.min(first).alias("b")).select("file", F.col("b.licence").alias("found"), (-F.col("b.col2")).alias("best")), "licence-own")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    solid = F.col("text").rlike(HINT) & (F.size(F.filter(F.split("text", r"\R"), lambda x: (F.trim(x) != "") & ~x.rlike(HINT))) == 0)
    stated = F.when(F.col("text").rlike(SPDX), F.regexp_extract("text", SPDX, 1)).alias("stated")
    narrow = written(keyed.select("file", "id", "path", directory(F.col("path")).alias("folder"), (name.rlike(FILE_NAME) | solid).alias("is_licence"), stated), "licence-files")
    with_own = narrow.join(own, "file", "left").withColumns({"licence": F.coalesce("stated", "found"), "score": F.when(F.col("stated").isNotNull(), 1.0).otherwise(F.col("best"))})
    holders = with_own.where("is_licence AND licence IS NOT NULL AND path IS NOT NULL").groupBy("folder").agg(F.min(F.struct("path", "licence", "score")).alias("h"))
    holders = written(holders.select(F.col("folder").alias("up"), F.col("h.licence").alias("h_licence"), F.col("h.score").alias("h_score")), "licence-folders")
    folders = written(narrow.where("folder IS NOT NULL").select("folder").distinct(), "licence-folder-list")
    steps = folders.select("folder", F.posexplode(above(F.col("folder"))).alias("steps", "up"))
    nearest = steps.join(holders, "up").groupBy("folder").agg(F.min(F.struct("steps", "up", "h_licence", "h_score")).alias("n")).select("folder", "n.*")
    out = with_own.join(written(nearest, "licence-nearest"), "folder", "left")
    how = F.when(F.col("licence").isNotNull(), "own").when(F.col("h_licence").isNotNull(), "inherited").otherwise("none")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("licence", "h_licence").alias("licence"),
        how.alias("how"),
        F.coalesce("score", "h_score").alias("score"),
        F.when(how == "inherited", F.col("up")).alias("from_path"),
    )
