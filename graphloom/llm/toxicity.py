"""Counterfactual-regularised toxicity classifier.

Features are the presence of words and of character runs within words. Those that depend on the label most (chi-squared
over the labelled rows, counted by Spark, above a cut that grows with their number) and the words that name groups carry a logistic model. Every labelled sentence
gives counterfactual pairs: one that names a group has the name replaced, any other gets a name that a hash of it picks put
in, and either is compared with the same sentence with each other name of the kind and with the kind's neutral word. The
loss adds ``swap_weight`` times the mean squared change of the logit over all pairs, so that naming a group moves the
score little either way, also where the name shares runs of characters with an insult.

Fitting uses at most about ``FIT_ROWS`` labelled rows, of which the driver gets the numbers of the selected features,
and of the pairs their distinct changes of features with counts. Scoring is one pass without a shuffle; each Python worker keeps the features of words seen before.

Edge cases: null text is empty and is scored (by the model's constant); a null id is held out; repeated ids are scored
row by row; without labelled rows of both classes the score is their share of label 1 (0.0 without any); an empty table
gives no row; further columns are ignored; a very long text is scored whole, as the set of its words.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, id_and_text, read, training_rows

FIT_ROWS = 20_000
FEATURES = 4096
#: A feature's least rows and chi-squared; the latter can't exceed the number of rows n, so both count n / (n + FEW_ROWS) fold.
LEAST_ROWS, LEAST_CHI2, FEW_ROWS = 8, 30.0, 200
RUNS = (4, 5)
SWAP_WEIGHT = 4.0
EDGE = ".,;:!?\"'()[]{}<>|*#$%&-_"
CACHE = 400_000
#: By kind, a neutral word and the words that name groups; each of these may stand for the others of its kind.
IDENTITY = (
    ("people", ("women", "men", "girls", "boys")),
    ("person", ("woman", "man", "girl", "boy")),
    ("people", ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "mormons")),
    ("religious", ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "mormon")),
    ("local", ("black", "white", "asian", "latino", "african", "european", "arab")),
    ("neighbours", ("moroccans", "algerians", "germans", "mexicans", "turks", "poles", "nigerians")),
    ("ordinary", ("gay", "straight", "lesbian", "bisexual", "transgender")),
    ("people", ("immigrants", "refugees", "foreigners", "natives", "citizens")),
    ("person", ("immigrant", "refugee", "foreigner", "native", "citizen")),
    ("ordinary", ("disabled", "blind", "deaf", "old", "young", "homeless", "jobless", "childless")),
    ("leute", ("frauen", "männer", "mädchen", "jungen", "muslime", "christen", "juden", "ausländer", "flüchtlinge", "behinderte", "marokkaner", "türken")),
    ("gens", ("femmes", "hommes", "filles", "garçons", "musulmans", "chrétiens", "juifs", "étrangers", "réfugiés", "handicapés", "marocains", "algériens")),
    ("personas", ("mujeres", "hombres", "niñas", "niños", "musulmanes", "cristianos", "judíos", "extranjeros", "refugiados", "marroquíes", "gitanos", "moros")),
)
KINDS = {w: (neutral, own) for neutral, own in IDENTITY for w in own}
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD_FEATURES: dict = {}


def words_of(text: str) -> set[str]:
    return {w.strip(EDGE) for w in text.lower().split()} - {""}


def features_of(word: str) -> list[str]:
    """The word itself and its runs of characters, with marks at its ends."""
    marked = f"<{word}>"
    return [f"={word}", *{marked[i : i + n] for n in RUNS for i in range(len(marked) - n + 1)}]


def rewritings(text: str) -> list[tuple[str, str]]:
    """Sentences of the text that name a group, each with every other name of the kind and with the neutral word in its place."""
    out = []
    for sentence in _SENTENCE.findall(text.lower()):
        for w in sorted(words_of(sentence) & KINDS.keys()):
            neutral, own = KINDS[w]
            out += [(sentence, re.sub(rf"(?<!\w){re.escape(w)}(?!\w)", other, sentence)) for other in (*own, neutral) if other != w]
    return out


def swaps(text: str) -> list[tuple[set[str], str, str]]:
    """(the sentence's other words, name, what stands in its place) of the counterfactual pairs of each sentence."""
    names, out = list(KINDS), []
    for sentence in _SENTENCE.findall(text.lower()):
        words = words_of(sentence)
        own = sorted(words & KINDS.keys()) or ([names[zlib.crc32(sentence.encode("utf-8", "surrogatepass")) % len(names)]] if words else [])
        out += [(words - {w}, w, other) for w in own for other in (*KINDS[w][1], KINDS[w][0]) if other != w]
    return out


def select_features(rows: DataFrame, most: int = FEATURES) -> list[str]:
    """The features of rows (text, y) that depend most on y: a bounded number, counted over all rows by Spark."""

    def count(batches):
        seen: dict[str, list[int]] = {}

        def flush():
            keys = list(seen)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([seen[k][i] for k in keys], pa.int64()) for i in (0, 1)]], ["feature", "zeros", "ones"])
            seen.clear()
            return out

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set()
                for w in words_of(text):
                    own.update(features_of(w))
                for f in own:
                    (seen.get(f) or seen.setdefault(f, [0, 0]))[y] += 1
                if len(seen) > 400_000:
                    yield flush()
        if seen:
            yield flush()

    totals = dict(rows.groupBy("y").count().collect())
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return []
    a, b = F.col("ones"), F.col("zeros")
    c, d = n1 - a, n0 - b
    chi2 = (n0 + n1) * F.pow(a * d - b * c, 2) / ((a + b).cast("double") * (c + d) * n1 * n0)
    counted = rows.select("text", "y").mapInArrow(count, "feature string, zeros long, ones long").groupBy("feature").agg(F.sum("zeros").cast("double").alias("zeros"), F.sum("ones").cast("double").alias("ones"))
    share = (n0 + n1) / (n0 + n1 + FEW_ROWS)
    best = counted.where((a + b >= max(2.0, LEAST_ROWS * share)) & (c + d > 0)).withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2 * share).orderBy(F.desc("chi2"), "feature").limit(most)
    return [r.feature for r in best.select("feature").collect()]


def feature_numbers(text: str, number: dict[str, int]) -> list[int]:
    return sorted({number[f] for w in words_of(text) for f in features_of(w) if f in number})


def training_sets(rows: DataFrame, number: dict[str, int]) -> list:
    """(y, numbers): the selected features of each row."""

    def apply(batches):
        for batch in batches:
            own = [feature_numbers(t, number) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, pa.list_(pa.int32()))], ["y", "numbers"])

    return rows.select("text", "y").mapInArrow(apply, "y int, numbers array<int>").collect()  # FIT_ROWS rows at most


def swap_changes(texts, number: dict[str, int]) -> dict[tuple, int]:
    """How often each change of features (lost, gained) comes up among the counterfactual pairs of the texts."""
    of_word: dict[str, frozenset] = {}

    def numbers(word: str) -> frozenset:
        own = of_word.get(word)
        if own is None:
            own = frozenset(number[f] for f in features_of(word) if f in number)
            if len(of_word) < CACHE:
                of_word[word] = own
        return own

    out: dict[tuple, int] = {}
    for text in texts:
        for rest, name, other in swaps(text):
            here = frozenset().union(*map(numbers, rest))
            lost, gained = numbers(name) - here, numbers(other) - here
            if lost != gained:
                key = (tuple(sorted(lost - gained)), tuple(sorted(gained - lost)))
                out[key] = out.get(key, 0) + 1
    return out


def swap_sets(rows: DataFrame, number: dict[str, int]) -> list:
    """(lost, gained, n) over all pairs of all rows; counts are summed by Spark."""
    kind = "lost array<int>, gained array<int>, n long"

    def apply(batches):
        for batch in batches:
            own = swap_changes(batch.column(0).to_pylist(), number)
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in own], pa.list_(pa.int32())) for i in (0, 1)] + [pa.array(list(own.values()), pa.int64())], ["lost", "gained", "n"])

    return rows.select("text").mapInArrow(apply, kind).groupBy("lost", "gained").agg(F.sum("n").alias("n")).orderBy("lost", "gained").collect()


def fit_logistic(sets: list, swapped: list, k: int, swap_weight: float = 1.0, ridge: float = 2e-4, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and constant that minimise mean log loss + swap_weight * mean squared change of the logit + ridge, by Adam.

    sets: (y, numbers) of each row. swapped: (lost, gained, n) of the counterfactual pairs.
    """

    def flat(lists):
        return np.concatenate([*[np.asarray(x, np.int64) for x in lists], np.zeros(0, np.int64)]), np.repeat(np.arange(len(lists)), [len(x) for x in lists])

    y = np.array([s[0] for s in sets], float)
    col, row = flat([s[1] for s in sets])
    (ca, ra), (cb, rb) = flat([p[0] for p in swapped]), flat([p[1] for p in swapped])
    share = np.array([p[2] for p in swapped], float)
    share /= max(share.sum(), 1.0)
    theta, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    theta[k] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for t in range(1, steps + 1):
        w = theta[:k]
        z = np.bincount(row, w[col], len(y)) + theta[k]
        miss = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)
        grad = np.append(np.bincount(col, miss[row], k) + ridge * w, miss.sum())
        if len(share):
            push = 2 * swap_weight * share * (np.bincount(ra, w[ca], len(share)) - np.bincount(rb, w[cb], len(share)))
            grad[:k] += np.bincount(ca, push[ra], k) - np.bincount(cb, push[rb], k)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:k], float(theta[k])


class ToxicityModel:
    """Weights of features, and the constant; token tells workers whether their cached words belong to this model."""

    def __init__(self, weights: dict[str, float], constant: float, token: str):
        self.weights, self.constant, self.token = weights, constant, token

    def scores(self, texts: list[str]) -> np.ndarray:
        cache = _WORD_FEATURES.setdefault(self.token, {})
        if len(_WORD_FEATURES) > 1:
            for other in [t for t in _WORD_FEATURES if t != self.token]:
                del _WORD_FEATURES[other]
        z = []
        for text in texts:
            found: set[str] = set()
            for w in set(text.lower().split()):
                own = cache.get(w)
                if own is None:
                    bare = w.strip(EDGE)
                    own = tuple(f for f in features_of(bare) if f in self.weights) if bare else ()
                    if len(cache) < CACHE:
                        cache[w] = own
                if own:
                    found.update(own)
            z.append(self.constant + sum(self.weights[f] for f in sorted(found)))
        return 1 / (1 + np.exp(-np.clip(np.array(z, float), -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = FIT_ROWS, swap_weight: float = SWAP_WEIGHT) -> ToxicityModel:
    import uuid

    from .common import materialize

    rows = materialize(training_rows(docs, labels, "toxic", max_rows).select("text", "y"), "toxic-rows")
    names = select_features(rows)
    if not names:
        share = rows.agg(F.avg("y")).first()[0] or 0.0
        return ToxicityModel({}, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), uuid.uuid4().hex)
    named = {f"={w}" for neutral, own in IDENTITY for w in (neutral, *own)}
    names += sorted(named - set(names))
    number = {f: i for i, f in enumerate(names)}
    weights, constant = fit_logistic(training_sets(rows, number), swap_sets(rows, number), len(names), swap_weight)
    return ToxicityModel({f: float(w) for f, w in zip(names, weights) if abs(w) > 1e-6}, constant, uuid.uuid4().hex)


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    def apply(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1).to_pylist()))], ["doc_id", "score"])

    return id_and_text(docs).mapInArrow(apply, "doc_id long, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
