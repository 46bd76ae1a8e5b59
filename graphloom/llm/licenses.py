"""Licence scan by a positional rare-token index, in DataFrame operations only.

Templates are word sequences (whole licence texts, notices and phrases) with a label and a mandatory key phrase. One pass
over the texts keeps, per document, its words in place, with null for words that occur in no template. Document
frequencies of those words over all documents give their IDF, and the rarest word of a template's key phrase is its
anchor. Then each document is looked up by itself: every place of an anchor proposes a start of that template, ``place -
relative position``; the template's other postings are intersected with the words at their relative positions; and a start
counts if the whole key phrase is in place. Its coverage is the share of the template's words in place, so it falls as a
licence text is changed. Candidates come from anchors only, and no word of a document meets a posting otherwise.

The templates fix the size of the index: it is part of the plan, and nothing is joined or shuffled but the word counts.

Edge cases: null text is empty; empty texts have no word and no label; repeated ids and null ids are documents of their
own; an empty table gives no row; further columns are ignored; a very long text is one row, looked at in time
proportional to its words and its anchors.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, ascii_lower, id_and_text, materialize, read

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The phrases whose places are counted, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_FREE = "is free software you can redistribute it and or modify it under the terms of the {0} as published by the free software foundation either version {1} of the license or at your option any later version"
_HOPE = "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {0} for more details"
#: (label, template, mandatory key phrase). Words of a template outside the key phrase may differ.
TEMPLATES = [
    ("agpl", "gnu affero general public license", "gnu affero general public license"),
    ("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    ("gpl-3.0", "gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2", "gnu general public license version 2"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd", "cc by nd"),
    ("cc-by", "creative commons attribution", "creative commons attribution"),
    ("mpl", "mozilla public license", "mozilla public license"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _WARRANTY + " "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
        "or the use or other dealings in the software",
        "permission is hereby granted free of charge",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "permission to use copy modify and or distribute",
    ),
    ("bsd", _BSD, "redistribution and use in source and binary forms"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "person or organization obtaining a copy of the software"),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "you may not use this file except in compliance with the license",
    ),
    ("gpl-3.0", _FREE.format("gnu general public license", 3), "terms of the gnu general public license as published by the free software foundation either version 3"),
    ("gpl-2.0", _FREE.format("gnu general public license", 2), "terms of the gnu general public license as published by the free software foundation either version 2"),
    ("lgpl", _FREE.format("gnu lesser general public license", 3), "terms of the gnu lesser general public license"),
    ("agpl", _FREE.format("gnu affero general public license", 3), "terms of the gnu affero general public license"),
    ("gpl", _HOPE.format("gnu general public license"), "in the hope that it will be useful but without any warranty"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "free and unencumbered software"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "has dedicated the work to the public domain"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    ("cc-by-sa", "creative commons attribution sharealike", "creative commons attribution sharealike"),
    ("cc-by-nc", "creative commons attribution noncommercial", "creative commons attribution noncommercial"),
    ("wtfpl", "do what the fuck you want to public license", "you want to public license"),
]


POSTING = ("template", "label", "base", "word", "rel", "mandatory", "n_words", "n_mandatory")


def _posting_rows() -> list[tuple]:
    rows = []
    for t, (label, words, key, base) in enumerate([*[(b, a, a, True) for a, b in BASE.items()], *[(*x, False) for x in TEMPLATES]]):
        words, key = words.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        rows += [(t, label, base, w, i, at <= i < at + len(key), len(words), len(key)) for i, w in enumerate(words)]
    return rows


def _postings(spark: SparkSession) -> DataFrame:
    """A row for each word of each template: a table whose size the templates fix."""
    return spark.range(1).select(F.inline(_constant([dict(zip(POSTING, row)) for row in _posting_rows()], "array<struct<template:int,label:string,base:boolean,word:string,rel:int,mandatory:boolean,n_words:int,n_mandatory:int>>")))


def _constant(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def template_words() -> list[str]:
    return sorted({w for text in [*BASE, *[t for _, t, _ in TEMPLATES]] for w in text.split()})


def word_places(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, words: the words of each document in order, null in the place of those of no template."""
    # lower() differs from lower-casing A-Z in no word that a template could have, but for the Kelvin sign, which becomes a k
    low = F.when(F.col("text").contains("K"), ascii_lower(F.col("text"))).otherwise(F.lower("text"))
    words = F.regexp_extract_all(low, F.lit(WORD), 0)
    vocabulary = template_words()
    own = F.transform("words", lambda w: F.when(w.isin(vocabulary), w))
    return id_and_text(docs).select("doc_id", words.alias("words")).select("doc_id", F.size("words").cast("long").alias("n_words"), own.alias("words"))


def anchored(postings: DataFrame, places: DataFrame) -> DataFrame:
    """The postings with idf of each word, and whether it is its template's anchor (the rarest of the key phrase; ties by place)."""
    df = places.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(places.count() + 1) / (F.coalesce("df", F.lit(0)) + 1))
    rank = F.row_number().over(W.partitionBy("template").orderBy(F.desc("mandatory"), F.desc("idf"), "rel"))
    return postings.join(df, "word", "left").select(*postings.columns, idf.alias("idf")).withColumn("anchor", rank == 1)


def license_matches(index: DataFrame) -> Column:
    """Of a column words: the verified matches as structs of label, base, start and coverage, one for each template and start.

    The index comes to the driver, as many rows as the templates have words.
    """
    rows = sorted(index.collect(), key=lambda r: (r.template, r.rel))
    templates, anchors = {}, {}
    for r in rows:
        own = templates.setdefault(r.template, {"label": r.label, "base": r.base, "n_words": r.n_words, "n_key": r.n_mandatory, "key": [], "rest": []})
        own["key" if r.mandatory else "rest"].append({"word": r.word, "rel": r.rel})
        if r.anchor:
            anchors.setdefault(r.word, []).append({"template": r.template, "rel": r.rel})
    posting = "array<struct<word:string,rel:int>>"
    bank = _constant([templates[t] for t in sorted(templates)], f"array<struct<label:string,base:boolean,n_words:int,n_key:int,key:{posting},rest:{posting}>>")
    starts_of = _constant(anchors, "map<string,array<struct<template:int,rel:int>>>")
    words = F.col("words")

    def in_place(postings: Column, start: Column) -> Column:
        return F.size(F.filter(postings, lambda p: F.get(words, start + p.rel) == p.word))

    def proposed(hit: Column) -> Column:
        return F.transform(F.element_at(starts_of, hit.word), lambda p: F.struct(F.get(bank, p.template).alias("t"), (hit.at - p.rel).alias("start")))

    hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(sorted(anchors)), F.struct(w.alias("word"), i.alias("at")))), lambda h: h.isNotNull())
    found = F.filter(F.flatten(F.transform(hits, proposed)), lambda c: in_place(c.t.key, c.start) == c.t.n_key)
    return F.transform(found, lambda c: F.struct(c.t.label.alias("label"), c.t.base.alias("base"), c.start.alias("start"), ((c.t.n_key + in_place(c.t.rest, c.start)) / c.t.n_words).alias("coverage")))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (largest coverage of any match; else 0)."""
    places = materialize(word_places(docs), "license-words")
    found = places.select("doc_id", "n_words", license_matches(anchored(_postings(docs.sparkSession), places)).alias("found"))
    base = F.filter("found", lambda m: m.base)

    def labels(matches: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m.label))), ",")

    starts = F.transform(base, lambda m: m.start.cast("long"))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("found")).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda m: m.coverage)), F.lit(0.0)).alias("score"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


#: The same by matching every word of every text with every posting.
OP8_SQL = f"""
WITH postings({", ".join(POSTING)}) AS (VALUES {", ".join(str(row) for row in _posting_rows())}),
docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
places AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM docs),
found AS (
  SELECT doc_id, template, label, base, pos - rel AS start, count(*) / n_words AS coverage FROM places JOIN postings USING (word)
  GROUP BY doc_id, template, label, base, pos - rel, n_words, n_mandatory HAVING count(*) FILTER (mandatory) = n_mandatory
), sums AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM found GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN sums USING (doc_id)
"""
