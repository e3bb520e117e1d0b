"""Licence scan by a positional index of rare words.

Texts are read once: a file's row keeps which words of the templates' key phrases it has, and,
if it has all words of some key phrase, the places of the templates' words. From these rows the
document frequency of every key word is counted over all documents. The RARE words of highest IDF of each
key phrase go into an index of postings (template, position). A posting of a word at a place says
where the template would have to start; a start that at least two rare words agree on is a
candidate. A candidate becomes a label if one of the template's mandatory key phrases stands at
its place in the file. Score: the largest part of a template's words that stand at their places;
BASE_SCORE at least where a base phrase stands.

All of it is DataFrame operations. The templates bound the index and the frequencies, nothing
else is collected, and only rows that may have a label are shuffled, by a number of their own.

Cases: a null or empty text has no words: counts 0, empty labels, null first and last place.
Repeated rows count in the document frequencies as often as they come.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_az, materialize, text_or_empty

#: What parts words, and the phrases whose every place counts.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
BASE_SCORE = 0.5

RARE = 2

#: Label, a passage of at most 63 words, the mandatory key phrases of which one must stand at its place.
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version"
_GNU_KEY = "gnu {0}general public license as published by the free software foundation either version {1} of the license"
TEMPLATES = (
    ("mit", "released under the MIT license", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "obtaining a copy of this software and associated documentation files")),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", ("above copyright notice and this permission notice shall be included",)),
    ("mit", "SPDX-License-Identifier: MIT", ("spdx license identifier mit",)),
    ("apache-2.0", "licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", ("apache license version 2 0", "you may not use this file except in compliance with the license")),
    ("apache-2.0", "www.apache.org/licenses/LICENSE-2.0", ("apache org licenses license 2 0",)),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0", ("spdx license identifier apache 2 0",)),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    ("gpl-3.0", _GNU.format("", "3"), (_GNU_KEY.format("", "3"),)),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0", ("spdx license identifier gpl 3 0",)),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    ("gpl-2.0", _GNU.format("", "2"), (_GNU_KEY.format("", "2"),)),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0", ("spdx license identifier gpl 2 0",)),
    ("lgpl", "licensed under the GNU Lesser General Public License", ("gnu lesser general public license",)),
    ("agpl-3.0", "licensed under the GNU Affero General Public License, version 3", ("gnu affero general public license version 3",)),
    ("agpl-3.0", _GNU.format("Affero ", "3"), (_GNU_KEY.format("affero ", "3"),)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("redistribution and use in source and binary forms",)),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ("redistributions of source code must retain the above copyright notice",)),
    ("bsd-3", "may not be used nor may the names of its contributors be used to endorse or promote products derived from this software without specific prior written permission", ("used to endorse or promote products derived from this software without specific prior written permission",)),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file")),
    ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0", ("eclipse public license 2 0",)),
    ("epl-2.0", "under the terms of the Eclipse Public License, v. 2.0", ("eclipse public license v 2 0",)),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and distribute this software",)),
    ("zlib", "In no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable for any damages",)),
    ("bsl-1.0", "distributed under the Boost Software License, Version 1.0", ("boost software license version 1 0",)),
    ("cc-by-4.0", "licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0",)),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial 4 0",)),
    ("cc-by-nc-sa-4.0", "licensed under CC BY-NC-SA 4.0", ("cc by nc sa 4 0",)),
    ("cc-by-nd-4.0", "licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
    ("cc0-1.0", "dedicated to the public domain under CC0 1.0", ("cc0 1 0",)),
    ("unlicense", "free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("anyone is free to copy modify publish use compile sell or distribute this software",)),
)


def template_words(text: str) -> list[str]:
    return [w for w in re.split(GAP, text.translate({c: c + 32 for c in range(65, 91)})) if w]


def _lowered(text: Column) -> Column:
    """A-Z in lower case; other letters may be too, which no template sees. The two signs whose lower case has an ASCII letter take the slower way."""
    return F.when(F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130")), lower_az(text)).otherwise(F.lower(text))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(_lowered(text), GAP), "")


def _vocabulary() -> list[str]:
    return sorted({w for _, passage, _ in TEMPLATES for w in template_words(passage)})


def _phrases() -> list[list[str]]:
    return [k.split() for k in sorted({k for _, _, keys in TEMPLATES for k in keys})]


def _key_words() -> list[str]:
    return sorted({w for p in _phrases() for w in p})


def _literals(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def document_frequencies(files: DataFrame) -> tuple[int, dict[str, int]]:
    """Documents in all, and those that have each key word; files has column seen."""
    rows = files.select(F.explode(F.concat("seen", F.array(F.lit(0).cast("byte"))))).groupBy("col").count().collect()  # at most a row for each key word
    counts = {r["col"]: r["count"] for r in rows}
    return counts.get(0, 0), {w: counts.get(i, 0) for i, w in enumerate(_key_words(), 1)}


def rare_postings(total: int, frequencies: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """word -> (template, place), for the RARE words of highest IDF in each key phrase (ties by word).

    They are taken from every key phrase so that no file that has one is missed.
    """
    idf = lambda w: math.log((1 + total) / (1 + frequencies.get(w, 0)))
    postings: dict[str, set[tuple[int, int]]] = defaultdict(set)
    for t, (_, passage, keys) in enumerate(TEMPLATES):
        words = template_words(passage)
        for key in keys:
            rare = sorted(set(key.split()), key=lambda w: (-idf(w), w))[:RARE]
            for place in (i for m in _key_masks(words, (key,)) for i in range(len(words)) if m >> i & 1):
                if words[place] in rare:
                    postings[words[place]].add((t, place))
    return {w: sorted(p) for w, p in postings.items()}


def _mask(places: list[int]) -> int:
    return sum(1 << p for p in set(places))


def _key_masks(words: list[str], keys: tuple[str, ...]) -> list[int]:
    """Bits of the template places that each standing of a key phrase takes."""
    found = []
    for key in keys:
        parts = key.split()
        found += [_mask(list(range(i, i + len(parts)))) for i in range(len(words) - len(parts) + 1) if words[i : i + len(parts)] == parts]
    return found


def _base_places(phrase: str) -> Column:
    """Places, from 0, where the phrase's words stand consecutively."""
    parts = phrase.split()
    stands = lambda i: F.slice("words", i + 1, F.lit(len(parts))) == _literals(parts)
    found = F.filter(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0))), stands)
    return F.when(F.contains("line", F.lit(f" {phrase} ")), found).otherwise(F.array().cast("array<int>"))


def _template_rows(docs: DataFrame, postings: dict[str, list[tuple[int, int]]]) -> DataFrame:
    """word, t, place, rare: every word of every template."""
    rare = {(w, t, p) for w, ps in postings.items() for t, p in ps}
    rows = [(w, t, p, (w, t, p) in rare) for t, (_, passage, _) in enumerate(TEMPLATES) for p, w in enumerate(template_words(passage))]
    return docs.sparkSession.createDataFrame(rows, "word string, t int, place int, rare boolean")


def _case(by_template: list[Column]) -> Column:
    return F.get(F.array(*by_template), F.col("t"))


def _files(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_words, places of the base phrases, seen (numbers of key words), and hits: places of template words, in files that have all words of a key phrase."""
    worded = docs.select("doc_id", _words(text_or_empty()).alias("words"))
    worded = worded.withColumn("keys", F.array_intersect("words", _literals(_key_words())))
    may = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.array_contains("keys", w) for w in sorted(set(p), key=len, reverse=True)]) for p in _phrases()])
    spots = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(_vocabulary()))
    hits = F.when(may, F.transform(spots, lambda i: F.struct(i.alias("i"), F.get("words", i).alias("word"))))
    line = F.when(F.array_contains("keys", "license"), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    seen = F.transform("keys", lambda w: F.array_position(_literals(_key_words()), w).cast("byte"))
    return worded.withColumn("line", line).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), *[_base_places(p).alias(b) for b, p in BASE.items()], seen.alias("seen"), hits.alias("hits"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (label, place, share of each verified passage)."""
    files = materialize(_files(docs))
    postings = rare_postings(*document_frequencies(files))

    # Each hit is looked up; templates that start at one place meet there, as bits of the places that match.
    some = files.where("hits is not null")
    spread = some.select("row", F.explode("hits").alias("hit")).select("row", "hit.i", "hit.word")
    posted = spread.join(F.broadcast(_template_rows(docs, postings)), "word")  # a row for each word of the templates
    bit = F.expr("shiftleft(1L, place)")
    met = posted.groupBy("row", "t", (F.col("i") - F.col("place")).alias("start")).agg(F.bit_or(bit).alias("mask"), F.bit_or(F.when(F.col("rare"), bit).otherwise(F.lit(0).cast("long"))).alias("rare"))
    words = [template_words(passage) for _, passage, _ in TEMPLATES]
    keyed = _case([F.exists(F.array(*[F.lit(m).cast("long") for m in _key_masks(ws, keys)]), lambda m: F.col("mask").bitwiseAND(m) == m) for ws, (_, _, keys) in zip(words, TEMPLATES)])
    share = F.bit_count("mask") / _case([F.lit(float(len(ws))) for ws in words])
    verified = met.where((F.bit_count("rare") >= RARE) & keyed)
    match = F.struct(F.greatest(F.col("start"), F.lit(0)).alias("place"), _case([F.lit(label) for label, _, _ in TEMPLATES]).alias("label"), share.alias("share"))
    matches = verified.groupBy("row").agg(F.sort_array(F.collect_list(match)).alias("matches"))

    kind = "array<struct<place:int,label:string,share:double>>"
    joined = files.where("hits is null").withColumn("matches", F.lit(None).cast(kind)).unionByName(some.join(matches, "row", "left"))
    found = F.coalesce("matches", F.array().cast(kind))
    places = F.flatten(F.array(*BASE))
    base = F.array_compact(F.array(*[F.when(F.size(b) > 0, F.lit(b)) for b in BASE]))
    labels = F.sort_array(F.array_distinct(F.concat(base, F.transform(found, lambda m: m["label"]))))
    score = F.greatest(F.coalesce(F.array_max(F.transform(found, lambda m: m["share"])), F.lit(0.0)), F.when(F.size(places) > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0)))
    return joined.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
        found.alias("matches"),
    )
