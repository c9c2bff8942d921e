"""Subject areas of documents: one-versus-rest linear classifiers over hashed word n-grams of sentences.

There are no address paths in this corpus, so the weak labels come from the section metadata there is: the listed terms of each
subject in the document's language, and the hand labels. A sentence with a listed term of a subject is a positive; a sentence of a
document without any is a negative; the others are left out of the first round and labelled by its result for the second. The
n-grams that stand beside listed terms thus get weight for the two thirds of terms that are not listed, while n-grams
of several subjects are pulled down by each other's documents. A document has a subject if a quarter of its sentences score above that
subject's threshold, which is calibrated on all hand-labelled documents.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BUCKETS = 1 << 18
#: Most documents, and characters of one, in the bounded sample that the classifiers are fitted on.
SAMPLE_DOCS, SAMPLE_CHARS = 6000, 40_000
SHARE = 0.25
GRID = tuple(x / 4 for x in range(-14, 9))
#: Bounds of a worker's caches; a full one is emptied.
CACHED = 300_000

_FOLD = {}
for _c in range(0x80, 0x250):
    _n = "".join(x for x in unicodedata.normalize("NFKD", chr(_c)) if not unicodedata.combining(x))
    if _n != chr(_c):
        _FOLD[_c] = _n
_MARKS = dict.fromkeys(range(0x300, 0x370))
_WORDS = re.compile(r"\w+|[.!?]+(?=\s|$)")


def fold(text: str) -> str:
    """Lower case without accents, so that composed, decomposed and stripped spellings meet."""
    return text.lower().translate(_FOLD | _MARKS if not text.isascii() else {})


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence; a sentence ends at . ! ? before white space or the end, and has at least one word."""
    out, words = [], []
    for w in _WORDS.findall(fold(text)):
        if w[0] in ".!?":
            if words:
                out.append(words)
                words = []
        else:
            words.append(w)
    return [*out, words] if words else out


def bucket(ngram: str) -> int:
    return zlib.crc32(ngram.encode("utf-8", "surrogatepass")) % BUCKETS


class Ngrams:
    """Buckets of the words and word pairs of sentences, as row and column numbers."""

    def __init__(self, columns: dict[int, int] | None = None):
        self.columns, self.cache = columns, {}

    def column(self, ngram: str) -> int:
        found = self.cache.get(ngram)
        if found is None:
            if len(self.cache) > CACHED:
                self.cache.clear()
            b = bucket(ngram)
            found = self.cache[ngram] = b if self.columns is None else self.columns.get(b, -1)
        return found

    def pairs(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, column) of each n-gram once per sentence; columns that the model lacks are left out."""
        get, column, rows, cols = self.cache.get, self.column, [], []
        for i, words in enumerate(lists):
            seen, last = set(), None
            for w in words:
                c = get(w)
                seen.add(column(w) if c is None else c)
                if last is not None:
                    p = last + " " + w
                    c = get(p)
                    seen.add(column(p) if c is None else c)
                last = w
            seen.discard(-1)
            rows.extend([i] * len(seen))
            cols.extend(seen)
        return np.array(rows, np.int64), np.array(cols, np.int64)


def _logistic(rows, cols, width, target, mask, rounds=40, rate=0.3, decay=2e-5):
    """Weights and bias of one logistic classifier, by full-batch Adagrad over the rows of mask."""
    use = mask[rows]
    r, c, y = (np.cumsum(mask) - 1)[rows[use]], cols[use], target[mask]
    n = max(1, len(y))
    w, g2, b, b2 = np.zeros(width), np.full(width, 1e-8), -3.0, 1e-8
    for _ in range(rounds):
        e = 1 / (1 + np.exp(-(np.bincount(r, w[c], minlength=len(y)) + b))) - y
        g = 100 * (np.bincount(c, e[r], minlength=width) / n + decay * w)
        gb = 100 * e.sum() / n
        g2, b2 = g2 + g * g, b2 + gb * gb
        w, b = w - rate * g / np.sqrt(g2), b - rate * gb / np.sqrt(b2)
    return w, b


class Model:
    """Columns of the buckets in use, their weights per subject, biases and thresholds."""

    def __init__(self, subjects, columns, weights, bias):
        self.subjects, self.columns, self.weights, self.bias = subjects, columns, weights, bias
        self.thresholds = np.full(len(subjects), -1.0)

    def scores(self, ngrams: Ngrams, lists: list[list[str]]) -> np.ndarray:
        rows, cols = ngrams.pairs(lists)
        return np.stack([np.bincount(rows, self.weights[cols, k], minlength=len(lists)) for k in range(len(self.subjects))], 1) + self.bias


class Sample:
    """The n-grams of the sampled sentences, and what terms and hand labels say of them: what each subject's classifier is fitted on."""

    def __init__(self, docs: pd.DataFrame, terms: pd.DataFrame, labels: pd.DataFrame, min_count: int = 3):
        self.subjects = sorted(set(terms["subject"].dropna()))
        at = {s: k for k, s in enumerate(self.subjects)}
        listed: dict[str, dict[str, list]] = {}  # language: first word: (its other words, subject)
        for s, lang, term in zip(terms["subject"], terms["lang"], terms["term"], strict=True):
            if s is not None and term and (words := [w for x in sentences(term) for w in x]):
                listed.setdefault(lang, {}).setdefault(words[0], []).append((words[1:], at[s]))
        known: dict[int, set[int]] = {}
        for doc, s in zip(labels["doc_id"], labels["subject"], strict=True):
            known.setdefault(doc, set()).update({at[s]} if s in at else set())
        lists, doc, hit, hand = [], [], [], []
        for n, (ident, lang, text) in enumerate(zip(docs["doc_id"], docs["lang"], docs["text"], strict=True)):
            firsts, by_hand = listed.get(lang, {}), known.get(ident, ())
            for words in sentences(text):
                lists.append(words)
                doc.append(n)
                hit.append([k for i, w in enumerate(words) if w in firsts for more, k in firsts[w] if words[i + 1 : i + 1 + len(more)] == more])
                hand.append(by_hand)
        self.size, self.doc = len(lists), np.array(doc, np.int64)
        self.y, self.stated = np.zeros((self.size, len(self.subjects)), bool), np.zeros((self.size, len(self.subjects)), bool)
        for i, (found, by_hand) in enumerate(zip(hit, hand, strict=True)):
            self.y[i, found] = True
            self.stated[i, list(by_hand)] = True
        rows, cols = Ngrams().pairs(lists)
        counts = np.bincount(cols, minlength=BUCKETS)
        use = (counts >= min_count) & (counts < max(20, 0.15 * self.size))  # what stands nearly everywhere tells nothing
        keep = use[cols]
        self.rows, self.cols, self.width = rows[keep], (np.cumsum(use) - 1)[cols[keep]], int(use.sum())
        self.buckets = np.flatnonzero(use)

    def classifier(self, k: int) -> tuple[np.ndarray, float]:
        """(weights, bias) of subject k against the rest: a first round on sentences with listed terms, a second on its result."""
        docs = int(self.doc[-1]) + 1 if self.size else 0
        per = lambda x: np.bincount(self.doc, x, minlength=docs) if self.size else np.zeros(0)
        y = self.y[:, k]
        mask = y | self.y.any(1) | ((per(y)[self.doc] == 0) & ~self.stated[:, k])
        w, b = _logistic(self.rows, self.cols, self.width, y.astype(float), mask)
        above = np.bincount(self.rows, w[self.cols], minlength=self.size) + b > -2
        share = (per(above) / np.maximum(per(np.ones(self.size)), 1))[self.doc]
        target = (above & (share >= 0.2)) | y
        return _logistic(self.rows, self.cols, self.width, target.astype(float), target | ~above)

    def model(self, fitted: list[tuple[np.ndarray, float]]) -> Model:
        weights = np.stack([w for w, _ in fitted], 1) if fitted else np.zeros((self.width, 0))
        strong = np.abs(weights).max(1, initial=0) > 0.02
        return Model(self.subjects, {int(b): i for i, b in enumerate(self.buckets[strong])}, weights[strong], np.array([b for _, b in fitted]))


def fit(docs: pd.DataFrame, terms: pd.DataFrame, labels: pd.DataFrame, spark: SparkSession | None = None) -> Model:
    """Classifiers from sampled documents (doc_id, lang, text), listed terms and hand labels; with a session each subject's in a task of its own."""
    sample = Sample(docs, terms, labels)
    ks = range(len(sample.subjects))
    if spark is None or not len(sample.subjects):
        return sample.model([sample.classifier(k) for k in ks])
    sent = spark.sparkContext.broadcast(sample)  # bounded by the sample

    def one(batches):
        for batch in batches:
            for k in batch["k"]:
                w, b = sent.value.classifier(int(k))
                yield pd.DataFrame({"k": [k], "w": [w.tobytes()], "b": [b]})

    rows = spark.createDataFrame([(k,) for k in ks], "k int").repartition(len(sample.subjects), "k").mapInPandas(one, "k int, w binary, b double").collect()
    found = {r["k"]: (np.frombuffer(r["w"]), r["b"]) for r in rows}
    sent.unpersist()
    return sample.model([found[k] for k in ks])


def _shares(model: Model, thresholds: list):
    """Of each document the share of sentences above each threshold (one per subject, or the grid for all)."""

    def run(batches):
        ngrams = Ngrams(model.columns)
        for batch in batches:
            lists, sizes = [], []
            for text in batch["text"]:
                found = sentences(text)
                lists.extend(found)
                sizes.append(len(found))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            z = model.scores(ngrams, lists) if lists else np.zeros((0, len(model.subjects)))
            n = np.maximum(np.array(sizes), 1)
            for name, t in thresholds:
                d, k = np.nonzero((np.stack([np.bincount(doc, z[:, k] > t[k], minlength=len(n)) for k in range(len(t))], 1) / n[:, None] >= SHARE - 1e-9))
                yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[d], "subject": np.array(model.subjects, object)[k], "threshold": name})

    return run


def train(docs: DataFrame, terms: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Classifiers fitted on a bounded sample of documents, with thresholds calibrated on all hand-labelled ones."""
    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", "lang", "text")
    # the documents with the smallest hashes: as many at any size of the corpus, and copies count once
    keys = texts.filter(F.length("text") <= SAMPLE_CHARS).select(F.xxhash64("doc_id").alias("h")).distinct().orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    sample = texts.filter((F.xxhash64("doc_id") <= F.lit(keys)) & (F.length("text") <= SAMPLE_CHARS)).groupBy("doc_id").agg(F.first("lang").alias("lang"), F.first("text").alias("text"))
    picked = sample.toPandas().sort_values("doc_id", kind="stable")
    hand = labels.filter("doc_id is not null and subject is not null").distinct()
    of_sample = hand.join(F.broadcast(docs.sparkSession.createDataFrame([(int(x),) for x in picked["doc_id"]], "doc_id long")), "doc_id", "left_semi").toPandas()
    model = fit(picked, terms.toPandas(), of_sample, docs.sparkSession)
    # calibration: hits, misses and false alarms of each subject at each threshold of the grid
    labelled = texts.select("doc_id", "text").join(hand.select("doc_id").distinct(), "doc_id", "left_semi")
    grid = [(t, np.full(len(model.subjects), t)) for t in GRID]
    said = labelled.mapInPandas(_shares(model, grid), "doc_id long, subject string, threshold double").distinct()
    true = hand.withColumn("_true", F.lit(1))
    by = said.join(true, ["doc_id", "subject"], "left").groupBy("subject", "threshold").agg(F.count("_true").alias("hits"), F.count(F.lit(1)).alias("named")).collect()
    real = {r["subject"]: r["n"] for r in hand.join(labelled.select("doc_id"), "doc_id", "left_semi").groupBy("subject").agg(F.count(F.lit(1)).alias("n")).collect()}
    hits, named = np.zeros((2, len(model.subjects), len(GRID)))
    where = {s: k for k, s in enumerate(model.subjects)}
    for r in by:
        k, g = where[r["subject"]], GRID.index(r["threshold"])
        hits[k, g], named[k, g] = r["hits"], r["named"]
    n = np.array([real.get(s, 0) for s in model.subjects], float)
    pool = lambda x: x + 0.5 * x.sum(0, keepdims=True)  # a subject with few labels leans on all
    f1 = 2 * pool(hits) / np.maximum(pool(named) + pool(n[:, None] * np.ones((1, len(GRID)))), 1)
    smooth = np.stack([np.convolve(np.pad(x, 1, mode="edge"), [0.25, 0.5, 0.25], "valid") for x in f1]) if n.sum() else f1
    if n.sum():
        model.thresholds = np.array([np.mean(np.array(GRID)[x >= x.max() - 1e-3]) for x in smooth])
    return model


def subject_areas(docs: DataFrame, terms: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, subject): the subjects that at least a quarter of a document's sentences treat; whole texts, all documents.

    Null and empty texts, and texts without words, have no subject; repeated rows give their subjects once; without terms
    or documents there are no rows. Other columns are ignored. Without hand labels a default threshold stands.
    """
    return _areas(train(docs, terms, labels, sample_docs), docs)


def _areas(model: Model, docs: DataFrame) -> DataFrame:
    if not model.subjects:
        return docs.sparkSession.createDataFrame([], "doc_id long, subject string")
    texts = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.mapInPandas(_shares(model, [(0.0, model.thresholds)]), "doc_id long, subject string, threshold double")
    return found.select("doc_id", "subject").distinct()


def composition(docs: DataFrame, areas: DataFrame) -> DataFrame:
    """(subject, documents, share): how many documents treat each subject; their shares of all documents may sum to more than 1."""
    total = max(1, docs.filter("doc_id is not null").count())
    return areas.groupBy("subject").agg(F.count(F.lit(1)).alias("documents")).withColumn("share", F.col("documents") / total)


def held_out(docs: DataFrame, terms: DataFrame, labels: DataFrame, parts: int = 2) -> float:
    """F1 over hand labels that neither the fit nor the thresholds saw: each part of the labelled documents is judged by a model of the others."""
    hits = found = true = 0
    part = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(parts))
    for k in range(parts):
        rest, own = labels.filter(part != k), labels.filter((part == k) & F.col("subject").isNotNull())
        asked = docs.join(own.select("doc_id").distinct(), "doc_id", "left_semi")
        said = _areas(train(docs, terms, rest), asked)
        real = own.filter("subject <> 'none'").distinct().join(asked.select("doc_id"), "doc_id", "left_semi").distinct()
        hits += said.join(real, ["doc_id", "subject"]).count()
        found += said.count()
        true += real.count()
    return 2 * hits / max(1, found + true)
