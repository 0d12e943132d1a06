"""Licences of files: TF-IDF cosine of header blocks and licence files to templates, then the nearest directory's licence file.

What is compared are runs of neighbouring lines as they stand in headers, sentences, single lines, whole files, and
stretches of a template's length around its longest word, so neither wrapping nor what surrounds a notice hides it.
DataFrame functions only.
"""

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk.llm.shared import matched, settled

LEAST = 0.8
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"
WORDS = "[^a-z0-9]+"

# What the headers and notices of common licences say.
TEMPLATES = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

# Heads, paragraphs and whole short texts of common licences, as published.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,'
    " FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER"
    " LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN"
    " THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal"
    " in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"
    " copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright"
    " notice and this permission notice appear in all copies."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation"
    " and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"
    " without specific prior written permission."
)
_APACHE = (
    "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES"
    " OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free"
    " Software Foundation, either version 3 of the License, or (at your option) any later version."
)
TEXTS = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", _GNU.format("Affero ")),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); ' + _APACHE),
    ("BSD-2-Clause", "BSD 2-Clause License " + _BSD),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License " + _BSD + _BSD_THIRD),
    ("BSD-3-Clause", _BSD_THIRD.strip()),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", _GNU.format("")),
    ("ISC", "ISC License"),
    ("ISC", _ISC),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", _GNU.format("Lesser ")),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", _MIT),
    ("MIT", "MIT License " + _MIT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can"
        " obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this"
        " software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
]

# How a text is cut: lines, blocks between lines without a letter or digit, and sentences within blocks.
_GAP = r"\n[^A-Za-z0-9\n]*\n"
CUTS = ("\n", _GAP, rf"[.!?;:][ \t\r\n]+|{_GAP}")


def split_words(text: str) -> list[str]:
    return [w for w in re.split(WORDS, text.lower()) if w]


def bags(templates=None) -> list[tuple[str, Counter]]:
    return [(name, Counter(split_words(text))) for name, text in (templates or [*TEMPLATES, *TEXTS])]


def pivots(templates=None) -> list[tuple[str, int, int]]:
    """``(word, words before it, words of the template)`` of every template's longest word, the first of equals."""
    found = set()
    for _, text in templates or [*TEMPLATES, *TEXTS]:
        words = split_words(text)
        longest = max(words, key=len)
        found.add((longest, words.index(longest), len(words)))
    return sorted(found)


def text_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORDS), lambda w: w != "")


def units(text: Column, words: Column, templates=None) -> Column:
    """The word lists of a text that are compared, each once: its lines, blocks, sentences, stretches and the whole.

    A stretch has as many words as a template and stands so that the template's longest word is in its place.
    """
    by_word = {}
    for word, before, n in pivots(templates):
        by_word.setdefault(word, []).append(F.struct(F.lit(before).alias("before"), F.lit(n).alias("n")))
    table = F.create_map(*[x for word, specs in by_word.items() for x in (F.lit(word), F.array(*specs))])
    places = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda p: p["w"].isin(list(by_word)))
    stretches = F.flatten(
        F.transform(
            places,
            lambda p: F.transform(F.try_element_at(table, p["w"]), lambda s: F.slice(words, F.greatest(p["i"] - s["before"], F.lit(0)) + 1, s["n"])),
        )
    )
    pieces = F.concat(*[F.split(text, cut) for cut in CUTS])
    return F.array_distinct(F.concat(F.transform(pieces, text_words), F.array(words), stretches))


def inverse_frequency(lines: int, df: int) -> float:
    return math.log((1 + lines) / (1 + df)) + 1


def anchors(templates: list[tuple[str, Counter]], idf: dict[str, float], least: float) -> set[str]:
    """Words of which a line must have one to come near a template.

    By Cauchy and Schwarz a line without a template's heaviest words reaches at most the share
    of the template's norm that the other words have.
    """
    found = set()
    for _, bag in templates:
        weight = sorted(((n * idf[w], w) for w, n in bag.items()), reverse=True)
        left = norm = sum(x * x for x, _ in weight)
        for x, word in weight:
            if left < (least * 0.999) ** 2 * norm:
                break
            found.add(word)
            left -= x * x
    return found


def reachable(words: Column, known: list[tuple[str, Counter]], idf: dict[str, float], rare: float, least: float) -> Column:
    """False only for parts whose foreign words alone keep every cosine below ``least``.

    With k foreign words, d distinct ones, a part's norm beside the templates' words is at least ``rare * k / sqrt(d)``.
    Its product with a unit template is at most the sum over its other words of what each can add to any template:
    the largest such value for the few heavy words, an eighth of it for the rest.
    """
    adds = {}
    for _, bag in known:
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in bag.items()))
        for w, n in bag.items():
            adds[w] = max(adds.get(w, 0.0), n * idf[w] ** 2 / norm)
    most = max(adds.values())
    heavy = sorted(w for w, x in adds.items() if x > most / 8)
    light = sorted(w for w, x in adds.items() if x <= most / 8)
    foreign = F.filter(words, lambda w: ~w.isin([*heavy, *light]))
    n_heavy = F.size(F.filter(words, lambda w: w.isin(heavy))) if heavy else F.lit(0)
    product = n_heavy * most + (F.size(words) - F.size(foreign) - n_heavy) * (most / 8)
    beside = F.size(foreign) / F.sqrt(F.greatest(F.size(F.array_distinct(foreign)), F.lit(1))) * rare
    return product * (1 + 1e-9) >= least / math.sqrt(max(1e-12, 1 - least * least)) * beside * (1 - 1e-9)


def own_licences(files: DataFrame, least: float = LEAST, templates=None) -> DataFrame:
    """``file_id, text_hash, licence, score``: files with a part near to a template.

    A word weighs its count in the part times ``ln((1 + lines) / (1 + lines with it)) + 1`` over all lines of the
    table; words that no template has weigh as if no line had them.  The parts of every text that has one of the words
    without which nothing comes near (`anchors`) are compared, see `units`.  The best cosine wins, ties go to the
    first licence by name.  Equal (file_id, text) rows are one; null ids count like others; null and empty texts have
    no licence; an empty table gives no rows.
    """
    known = bags(templates)
    vocabulary = sorted({w for _, bag in known for w in bag})
    spark = files.sparkSession
    texts = files.where(F.col("text").isNotNull()).select("file_id", "text")
    listed = F.array(*map(F.lit, vocabulary))
    # null stands for the line itself, so one pass counts lines and words
    marks = F.transform(
        F.split("text", "\n"), lambda line: F.concat(F.array_intersect(text_words(line), listed), F.array(F.lit(None).cast("string")))
    )
    counted = {r["word"]: r["count"] for r in texts.select(F.explode(F.flatten(marks)).alias("word")).groupBy("word").count().collect()}
    total = counted.get(None, 0)
    idf = {w: inverse_frequency(total, counted.get(w, 0)) for w in vocabulary}
    rare = inverse_frequency(total, 0)
    needed = F.array(*map(F.lit, sorted(anchors(known, idf, least))))

    marked = texts.select("file_id", F.xxhash64("text").alias("text_hash"), "text", text_words(F.col("text")).alias("words"))
    marked = marked.where(F.arrays_overlap("words", needed))
    parted = marked.select("file_id", "text_hash", F.posexplode(units(F.col("text"), F.col("words"), templates)).alias("nth", "words"))
    part = ["file_id", "text_hash", "nth"]
    # rows that occur several times count every word as often more, which no cosine notices
    candidates = parted.where(F.arrays_overlap("words", needed) & reachable(F.col("words"), known, idf, rare, least))
    terms = candidates.select(*part, F.explode("words").alias("word")).groupBy(*part, "word").agg(F.count("*").alias("tf"))
    weights = spark.createDataFrame(sorted(idf.items()), "word string, idf double")
    terms = settled(
        terms.join(weights, "word", "left").select(*part, "word", (F.col("tf") * F.coalesce("idf", F.lit(rare))).alias("weight")), "licence-terms"
    )
    rows = []
    for number, (name, bag) in enumerate(known):
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in bag.items()))
        rows += [(number, name, w, n * idf[w] / norm) for w, n in sorted(bag.items())]
    shares = spark.createDataFrame(rows, "number int, licence string, word string, share double")
    norms = terms.groupBy(*part).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = terms.join(shares, "word").groupBy(*part, "number", "licence").agg(F.sum(F.col("weight") * F.col("share")).alias("dot"))
    scored = matched(dots, norms, *part).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= least)
    # the best part of a file, then the first licence by name
    best = scored.groupBy("file_id", "text_hash").agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("best"))
    return best.select("file_id", "text_hash", "best.licence", (-F.col("best.minus")).alias("score"))


def directory(path: Column) -> Column:
    """The path without its last part; the empty string for top files."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, least: float = LEAST, templates=None, licence_file: str = LICENCE_FILE) -> DataFrame:
    """``file_id, path, licence, origin, score`` of every row of ``files(file_id, path, text)``.

    A file's own licence comes from its lines (origin ``own``).  Files without one take that of the licence
    file in the nearest directory at or above theirs (``inherited``, with that file's score); of several
    licence files in a directory the one with the best score, then the first licence by name, counts.
    Others have null in all three.  Null texts and null paths inherit or are inherited from like empty ones: a null path lies
    nowhere and inherits nothing.  Directories are resolved once each, not per file.
    """
    own = own_licences(files, least, templates)
    keyed = files.select("file_id", "path", F.xxhash64("text").alias("text_hash"))
    keyed = keyed.withColumn("known", F.col("text_hash").isNotNull())
    renamed = own.select(F.col("file_id").alias("own_id"), F.col("text_hash").alias("own_hash"), F.col("licence").alias("own_licence"), F.col("score").alias("own_score"))
    marked = keyed.join(renamed, F.col("file_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")), "left").select(
        "file_id", "path", directory(F.col("path")).alias("dir"), "own_licence", "own_score"
    )
    marked = settled(marked, "licence-own")
    named = F.regexp_extract("path", r"[^/]*$", 0).rlike(licence_file)
    grants = marked.where(named & F.col("own_licence").isNotNull()).groupBy(F.col("dir").alias("above"))
    grants = grants.agg(F.min(F.struct((-F.col("own_score")).alias("minus"), F.col("own_licence").alias("licence"))).alias("best"))
    parts = F.split("dir", "/")
    depths = F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts)))
    climbed = marked.where("path is not null and own_licence is null").select("dir").distinct()
    climbed = climbed.select("dir", F.explode(F.transform(depths, lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("above")))).alias("up"))
    climbed = climbed.select("dir", "up.depth", "up.above")
    nearest = climbed.join(grants, "above").groupBy("dir").agg(F.max_by("best", "depth").alias("best"))
    out = marked.join(nearest.withColumnRenamed("dir", "own_dir"), (F.col("dir") == F.col("own_dir")) & F.col("path").isNotNull() & F.col("own_licence").isNull(), "left")
    return out.select(
        "file_id",
        "path",
        F.coalesce("own_licence", "best.licence").alias("licence"),
        F.when(F.col("own_licence").isNotNull(), "own").when(F.col("best").isNotNull(), "inherited").alias("origin"),
        F.coalesce("own_score", -F.col("best.minus")).alias("score"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: four files to a directory, four directories to the next, below their source's.

    The table has no paths.  The first file of every directory is its licence file; that of a directory's first
    directory stands one level higher, and so on, so a quarter of all documents are licence files, at four depths.
    """
    own = F.col("doc_id")
    source = F.coalesce("source", F.lit("none"))

    def below(*parts):
        return F.concat_ws("/", source, *[p.cast("string") for p in parts])

    top, middle, low = (F.floor(own / n) for n in (64, 16, 4))
    licence = F.lit("LICENSE")
    name = (
        F.when(own % 256 == 0, below(licence))
        .when(own % 64 == 0, below(top, licence))
        .when(own % 16 == 0, below(top, middle, licence))
        .when(own % 4 == 0, below(top, middle, low, licence))
        .otherwise(below(top, middle, low, F.concat(own, F.lit(".txt"))))
    )
    return docs.select(own.alias("file_id"), name.alias("path"), "text")
