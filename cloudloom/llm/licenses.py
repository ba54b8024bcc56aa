"""Licence scans: TF-IDF cosine of licence headers to templates, then inheritance from the nearest directory above.

1. The lines of a file that speak of licences are its header.  Compared are the header, its lines, the notices within them, the paragraphs that such a line
   stands in, together and with the one before and after, and a licence file (LICENSE, COPYING, ...) as a whole; the best counts.
2. Headers and templates are sparse TF-IDF vectors with the document frequencies of all words over all headers; the
   template of the greatest cosine names the licence.  A notice that shares its line with a holder's name is compared on its own too.
   Words of templates and of at least 1 / COMMON of the headers go to every task; rarer ones meet their counts in a join.
3. A directory has the licence of its licence file.  A file without one of its own takes that of the nearest directory
   above it: every different directory is joined with its ancestors, and files with directories.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.llm._graph import hot_join, shared
from cloudloom.llm._rows import tidied

# Whole texts of the short licences, and of all licences their titles, preambles and usual notices.
_AS_IS_BSD = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_GNU_NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
_FSF = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "MIT License " + _MIT_GRANT),
    ("MIT", "MIT License " + _MIT_GRANT + " " + _MIT_AS_IS),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU_NOTICE.format(2)),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. " + _FSF),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", _GNU_NOTICE.format(3)),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _FSF),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. " + _FSF),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _FSF),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _FSF),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-2-Clause", f"BSD 2-Clause License {_BSD_HEAD} {_BSD_TWO}"),
    ("BSD-2-Clause", f"BSD 2-Clause License {_BSD_HEAD} {_BSD_TWO} {_AS_IS_BSD}"),
    ("BSD-3-Clause", "BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", f"BSD 3-Clause License {_BSD_HEAD} {_BSD_TWO} {_BSD_THIRD}"),
    ("BSD-3-Clause", f"BSD 3-Clause License {_BSD_HEAD} {_BSD_TWO} {_BSD_THIRD} {_AS_IS_BSD}"),
    ("ISC", "ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC", f"ISC License {_ISC_GRANT} {_ISC_AS_IS}"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License. CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. The Unlicense."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
#: Lines with one of these, in any case, belong to the header. Plain substrings: most texts have none, and are done with at the speed of a search.
CUES = ("licens", "licenc", "copyright", "spdx", "permission is hereby", "redistribut", "public domain", "creative commons", "cc by", "cc-by", "cc0", "unencumbered")
#: Base names of licence files.
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|unlicense)([._-].*)?$"
#: Cosine from which a header is taken for a template's licence.
LEAST_COSINE = 0.6
#: Words of at least 1 / COMMON of the headers are sent to every task.
COMMON = 1 << 16
#: Words that a task passes on at a time.
FLUSH = 400_000
#: Directories with at least 1 / HOT of all files meet their licence in a broadcast.
HOT = 1024

_TOKEN = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def header(text: str | None) -> str:
    """The lines that speak of licences."""
    low = (text or "").lower()
    cues = [c for c in CUES if c in low]
    return "\n".join(line for line in text.split("\n") if any(c in line.lower() for c in cues)) if cues else ""


_COMMENT = re.compile(r"^[\s#*/;%!-]+|[\s*/#-]+$")


def paragraphs(text: str) -> list[str]:
    """The paragraphs of a text that speak of licences, each alone and with all that follow each other; comment marks at the ends of lines don't count."""
    blocks, block = [], []
    for line in (*(_COMMENT.sub("", x) for x in text.split("\n")), ""):
        if line:
            block.append(line)
        elif block:
            blocks.append("\n".join(block))
            block = []
    cued = [any(c in b.lower() for c in CUES) for b in blocks]
    out = [b for b, c in zip(blocks, cued) if c]
    # a run of paragraphs, none more than two away from one with a cue: a licence text within a file
    near = [any(cued[max(0, i - 2) : i + 3]) for i in range(len(blocks))]
    begin = 0
    for i in range(len(blocks) + 1):
        if i == len(blocks) or not near[i]:
            if i - begin > 1:
                out.append("\n".join(blocks[begin:i]))
            begin = i + 1
    return list(dict.fromkeys(out))


def compared(text: str | None, whole: bool) -> list[str]:
    """What is compared of a file: its header, lines, notices and paragraphs, and all of it if ``whole``."""
    own = header(text)
    lines = sorted({line for line in own.split("\n") if line.strip()})
    each = dict.fromkeys([own, *lines, *(x for line in lines for x in pieces(line)), *(paragraphs(text) if own else []), *([text or ""] if whole else [])])
    return [x for x in each if x]


def tokens(text: str) -> Counter[str]:
    return Counter(_TOKEN.findall(text.lower()))


_SENTENCE, _HOLDER = re.compile(r"(?<=[.;])\s+"), re.compile(r"(?i)copyright|\(c\)|\u00a9|all rights reserved")


def pieces(line: str) -> list[str]:
    """The parts of a line that may be a notice of their own: its sentences, what follows a holder's name, and all that names no holder."""
    sentences = [x for x in _SENTENCE.split(line) if x.strip()]
    own = [*sentences, *(y for x in sentences if _HOLDER.search(x) for y in re.split(r",\s+", x)[1:])]
    rest = " ".join(x for x in sentences if not _HOLDER.search(x))
    return [x for x in dict.fromkeys([*own, rest]) if x != line and any(c in x.lower() for c in CUES)]


_VOCABULARY = frozenset(t for _, text in TEMPLATES for t in tokens(text))


class Matcher:
    """Cosines to the templates; ``df`` counts the headers with each word, out of ``n``."""

    def __init__(self, df: dict[str, int], n: int):
        self.idf = {t: 1 + math.log((1 + n) / (1 + df.get(t, 0))) for t in _VOCABULARY | (df.keys() - {""})}
        self.other = 1 + math.log(1 + n)  # a word that no template has
        self.templates = []
        for name, text in TEMPLATES:
            vector = self._vector(tokens(text))
            norm = math.sqrt(sum(x * x for x in vector.values()))
            self.templates.append((name, {t: x / norm for t, x in vector.items()}))

    def _vector(self, counts: Counter[str]) -> dict[str, float]:
        return {t: (1 + math.log(c)) * self.idf.get(t, self.other) for t, c in sorted(counts.items())}

    def __call__(self, text: str) -> tuple[str | None, float]:
        """The licence of the nearest template and its cosine; the first template on ties."""
        vector = self._vector(tokens(text))
        norm = math.sqrt(sum(x * x for x in vector.values()))
        if not norm:
            return None, 0.0
        best = max(self.templates, key=lambda t: sum(x * t[1].get(w, 0.0) for w, x in vector.items()))
        return best[0], min(1.0, sum(x * best[1].get(w, 0.0) for w, x in vector.items()) / norm)

    def partly(self, text: str) -> dict:
        """The nearest template, the product with it, the square of the length over the words that are known here, and the others with their times."""
        counts = tokens(text)
        vector = self._vector({t: c for t, c in counts.items() if t in self.idf})
        best = max(self.templates, key=lambda t: sum(x * t[1].get(w, 0.0) for w, x in vector.items()))
        product = sum(x * best[1].get(w, 0.0) for w, x in vector.items())
        rare = [{"token": t, "times": c} for t, c in sorted(counts.items()) if t not in self.idf]
        return {"name": best[0], "product": product, "square": sum(x * x for x in vector.values()), "rare": rare}


def _counter(vocabulary: frozenset[str] | None):
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if own := header(text):
                    seen[""] += 1
                    seen.update(tokens(own).keys() if vocabulary is None else vocabulary & tokens(own).keys())
            if len(seen) > FLUSH:
                yield out()
                seen.clear()
        yield out()

    return frequencies


def frequencies(files: DataFrame, vocabulary: frozenset[str] | None = None) -> DataFrame:
    """(token, n): the headers of ``files`` (text) with each word, or each of the vocabulary; with "", all headers."""
    return files.select("text").mapInArrow(tidied(_counter(vocabulary)), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def detect(files: DataFrame, *, keep: list[str] | None = None, least: float = LEAST_COSINE) -> DataFrame:
    """Each row of ``files`` (path, text) as the struct ``row`` of its columns ``keep`` (all by default), with detected, the licence of its header, and cosine.

    Only words of the templates are counted here, and lines are compared whole: for files whose headers hold little else.  scan_licenses uses detect_all.
    Null and empty texts have no header and cosine 0; a null path names no licence file.  Rows that repeat are rows of their own, an empty table gives an empty one.
    """
    # One row for each word of the templates' vocabulary at most, whatever the files are.
    df = frequencies(files, _VOCABULARY).collect()
    counts = {r["token"]: r["n"] for r in df}
    matcher = files.sparkSession.sparkContext.broadcast(Matcher(counts, counts.get("", 0)))
    rows = files.select(F.struct(*(keep or ["*"])).alias("row"), F.col("text").alias("t"), F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE), F.lit(False)).alias("whole"))

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher.value
        for batch in batches:
            found = []
            for text, whole in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = header(text)
                name, cosine = match(own) if own else (None, 0.0)
                # its best single line: a notice among other lines about licences
                lines = {line for line in own.split("\n") if line.strip()} if own else set()
                for name_, cosine_ in [match(x) for x in sorted(lines)] + ([match(text or "")] if whole else []):
                    if cosine_ > cosine:
                        name, cosine = name_, cosine_
                found.append((name if cosine >= least else None, cosine))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["row", "detected", "cosine"])

    return rows.mapInArrow(tidied(matched), T.StructType([rows.schema["row"], *T._parse_datatype_string("detected string, cosine double").fields]))


def detect_all(files: DataFrame, *, keep: list[str] | None = None, least: float = LEAST_COSINE, common: int = COMMON) -> DataFrame:
    """As detect(), with the frequencies of all header words, and with the pieces of each line compared on their own too."""
    df = shared(frequencies(files))
    n = df.where("token = ''").agg(F.sum("n")).first()[0] or 0
    known = (F.col("n") * common >= n) | F.col("token").isin(sorted(_VOCABULARY | {""}))
    matcher = files.sparkSession.sparkContext.broadcast(Matcher({r["token"]: r["n"] for r in df.where(known).collect()}, n))
    rows = files.select(F.struct(*(keep or ["*"])).alias("row"), F.col("text").alias("t"), F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE), F.lit(False)).alias("whole"))
    part = pa.struct([("k", pa.int32()), ("name", pa.string()), ("product", pa.float64()), ("square", pa.float64()), ("rare", pa.list_(pa.struct([("token", pa.string()), ("times", pa.int64())])))])

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher.value
        for batch in batches:
            found = []
            for text, whole in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found.append([{"k": k, **match.partly(x)} for k, x in enumerate(compared(text, whole))] or None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(part))], ["row", "parts"])

    schema = T.StructType([rows.schema["row"], *T._parse_datatype_string("parts array<struct<k int, name string, product double, square double, rare array<struct<token string, times long>>>>").fields])
    found = shared(rows.mapInArrow(tidied(matched), schema).withColumn("rid", F.monotonically_increasing_id()))
    told = found.where(F.col("parts").isNotNull())
    each = told.select("rid", F.explode("parts").alias("part")).select("rid", "part.*")
    words = each.select("rid", "k", "name", "product", "square", F.explode_outer("rare").alias("word"))
    # without rarer words, a key of its own that is no word: nulls would all go to one task
    words = words.withColumn("token", F.coalesce("word.token", F.concat(F.lit(" "), F.col("rid").cast("string")))).withColumn("times", F.col("word.times")).drop("word")
    rare = df.where(~known).select("token", F.col("n").alias("df"))
    weight = (1 + F.log("times")) * (1 + F.log((1 + n) / (1 + F.coalesce("df", F.lit(0)))))
    more = F.coalesce(F.sum(weight * weight), F.lit(0.0))
    lengths = words.join(rare, "token", "left").groupBy("rid", "k").agg(F.first("name").alias("name"), F.first("product").alias("product"), F.sqrt(F.first("square") + more).alias("length"))
    cosine = F.when(F.col("length") > 0, F.least(F.lit(1.0), F.col("product") / F.col("length"))).otherwise(0.0)
    best = lengths.select("rid", "k", "name", cosine.alias("cosine")).groupBy("rid").agg(F.max_by(F.struct("name", "cosine"), F.struct("cosine", -F.col("k"))).alias("best"))
    named = told.join(best, "rid").select("row", F.when(F.col("best.cosine") >= least, F.col("best.name")).alias("detected"), F.col("best.cosine").alias("cosine"))
    return named.unionByName(found.where(F.col("parts").isNull()).select("row", F.lit(None).cast("string").alias("detected"), F.lit(0.0).alias("cosine")))


def scan_licenses(files: DataFrame, *, keep: list[str] | None = None, least: float = LEAST_COSINE, hot: int = HOT) -> DataFrame:
    """Each row of ``files`` (path, text) as the struct ``row`` of its columns ``keep``, with its licence.

    keep must name path; by default it is all columns.
    Added: license, how (``header``: its own; ``directory``: that of the nearest directory above, its own included; null if there is none),
    from_dir (that directory), detected, cosine.  Paths are separated by slashes.  Two licence files in a directory: the greater
    cosine, then the last name.

    A null or empty text has no header.  A null path lies in no directory and inherits nothing.  Rows that repeat
    are rows of their own.  An empty table gives an empty table.
    """
    found = shared(detect_all(files, keep=keep, least=least))  # three uses below
    parts = F.split("row.path", "/")
    placed = found.withColumn("dir", F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"))
    name = F.element_at(parts, -1)
    best = F.max_by("detected", F.struct("cosine", "detected"))
    of_dir = placed.where(F.col("detected").isNotNull() & name.rlike(LICENCE_FILE)).groupBy("dir").agg(best.alias("dir_license")).withColumnRenamed("dir", "above")
    dirs = placed.select("dir").where(F.col("dir").isNotNull()).distinct()
    steps = F.split("dir", "/")
    ancestors = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(steps, 1, i), "/").alias("above")))).alias("up"))
    nearest = ancestors.select("dir", "up.*").join(of_dir, "above").groupBy("dir").agg(F.max_by(F.struct("above", "dir_license"), "depth").alias("got"))
    both = hot_join(placed.withColumn("dir", F.coalesce("dir", F.concat(F.lit("/"), F.monotonically_increasing_id().cast("string")))), nearest.hint("merge"), ["dir"], "left", hot=hot)
    own = F.col("detected").isNotNull()
    return both.select(
        "row",
        F.coalesce("detected", "got.dir_license").alias("license"),
        F.when(own, F.lit("header")).when(F.col("got").isNotNull(), F.lit("directory")).alias("how"),
        F.when(~own, F.col("got.above")).alias("from_dir"),
        "detected",
        "cosine",
    )
