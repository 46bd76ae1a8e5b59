import re

from pyspark.sql import functions as F

from graphloom.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MIT = (
    "Copyright (c) 2020 A. Person\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "mit license MIT-LICENSE mit  license license mit",
    "This work is licensed under the GNU General Public License, version 3.\nAlso CC BY-NC 4.0.",
    "cc, by cc by by cc Éby cc by",
    "Permission is hereby granted, free of charge, to all persons obtaining a copy of this software",
    "all rights reserved. GNU general public. license",
    "gnu affero general public license",
    "\u212a cc by mit licen\u017fe",
    MIT,
    MIT.replace("merge, publish,", "merge, change,").replace("substantial", "larger"),
    MIT.replace("granted", "given"),
]


def plain(text):
    words, starts, labels = WORD.findall((text or "").translate(LOWER)), [], set()
    for phrase, label in licenses.BASE.items():
        phrase = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
        starts += own
        labels |= {label} if own else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_against_brute_force(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "words").unionByName(spark.createDataFrame([(300 + i, t, "w") for i, t in enumerate(TEXTS)], "doc_id long, text string, words string"))
    want = sorted((str(r.doc_id), *plain(r.text)) for r in docs.collect())
    got = licenses.license_scan(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    labels = {r.doc_id: (r.labels, r.score) for r in got}
    assert labels[300] == ("apache,apache-2.0", 1.0) and labels[302] == ("cc-by,cc-by-nc,gpl,gpl-3.0", 1.0)
    assert labels[304][0] == "mit" and 0 < labels[304][1] < 0.2 and labels[305] == ("all-rights-reserved,gpl", 1.0) and labels[306] == ("agpl", 1.0)
    assert labels[0] == ("", 0.0)
    assert labels[308] == ("mit", 1.0) and labels[309][0] == "mit" and 0.95 < labels[309][1] < 1 and "mit" not in labels[310][0]


def test_candidates_come_from_anchors(spark):
    """The anchor is the rarest word of the key phrase, and a document without it meets no posting."""
    common = [(i, "free software that is hereby of charge") for i in range(9)]
    places = licenses.word_places(spark.createDataFrame([*common, (9, "permission granted")], "doc_id long, text string"))
    index = licenses.anchored(licenses._postings(spark), places)
    anchors = {r.template: r.word for r in index.where("anchor").collect()}
    words = {}
    for t, _, _, word, _, mandatory, _, _ in licenses._posting_rows():
        if mandatory:
            words.setdefault(t, []).append(word)
    for t, own in words.items():
        n = {w: sum(w in text.split() for _, text in [*common, (9, "permission granted")]) for w in own}
        assert n[anchors[t]] == min(n.values())
    none = index.withColumn("anchor", F.lit(False))
    assert places.select(F.size(licenses.license_matches(none)).alias("n")).where("n > 0").count() == 0


def test_empty(no_docs):
    assert licenses.license_scan(no_docs).count() == 0
