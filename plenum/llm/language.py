"""Language of documents and of the segments of mixed ones.

Model: sparse multinomial logistic regression on TF-IDF weights of character n-grams (1 to 4 letters, word edges
marked, hashed to ``FEATURES`` slots), trained by follow-the-regularised-leader with elastic-net penalties on the clean
sentences of a sample table (at most ``TRAIN_ROWS`` of them), then calibrated by a temperature fitted on out-of-fold
scores. Term frequencies are shares of a sentence's n-grams, so a sentence's score is the sum over its words, and each
distinct word is scored once in a worker, not at every place where it stands.

Segmentation: texts are normalised (NFKC, lower case, marks of width zero dropped) and cut at sentence ends, quotation
marks and line breaks; neighbouring sentences of one language form a segment. A language counts for a document when a
whole sentence (``WHOLE`` words or more) is written in it with confidence ``SURE``, one beside the document's main
language with ``OTHER``; shorter pieces follow their neighbours. Words of more than ``LONGEST`` letters or with a letter
repeated four times are codes, no words.

Defined results
* null, empty and wordless texts (digits, symbols, other scripts) have no language and give no row;
* samples in fewer than two languages tell nothing apart: no rows;
* when no sentence is whole, the document's pieces are judged together if they hold three words or more;
* a null id is kept; rows repeated give equal rows; whole texts are read, whatever their length; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.runtime import received, ship

FEATURES, TRAIN_ROWS = 1 << 15, 20_000
#: Labelled documents, and sentences of one language from them, that the second training may use.
LABELLED_DOCS, PER_LANGUAGE = 4000, 800
WHOLE, SURE, OTHER = 5, 0.9, 0.98
#: Names of the languages in the notations met in catalogues (ISO 639-1, 639-2 B and T, English and own names).
NAMES = {
    "en": ["en", "eng", "english"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano", "castilian"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands", "flemish"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
}
_WORD = re.compile(r"[a-zß-öø-ÿœæāăąćčęěğīłńňōőřśşšţťūůűźżž]+")
_EDGE = re.compile(r"(?<=[.!?…])\s+|[.!?…]+(?=[\"“”«»])|[\"“”«»„\r\n  \u0085]+|(?<=[.!?…])(?=[^\W\d_a-z])")
_GONE = re.compile("[​-‏⁠﻿­]")


#: Share of a held-out label given to all languages alike in the calibration.
SMOOTHING = 0.004
#: Longest word, in letters.
LONGEST = 40
_CODE = re.compile(r"(.)\1{3}")


def _words(text: str) -> list[str]:
    return [w for w in _WORD.findall(text) if len(w) <= LONGEST and not (len(w) > 3 and _CODE.search(w))]


def _folded(text: str) -> str:
    return unicodedata.normalize("NFKC", _GONE.sub("", text)).lower()


def _grams(word: str) -> list[int]:
    w = f"^{word}$"
    return [zlib.crc32(w[i : i + n].encode()) % FEATURES for n in (1, 2, 3, 4) for i in range(len(w) - n + 1) if n > 1 or 0 < i < len(w) - 1]


class Model:
    """Weights, bias and temperature; ``logits`` are linear in a sentence's mean n-gram."""

    def __init__(self, langs, weights, bias, temperature):
        self.langs, self.weights, self.bias, self.temperature = langs, weights.astype("f4"), bias, temperature
        self.words: dict[str, int] = {}
        self.rows = np.zeros((1024, len(langs) + 1), "f4")

    def word_rows(self, words: list[str]) -> np.ndarray:
        """Summed weights of each word's n-grams, and their number."""
        at = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            k = self.words.get(w)
            if k is None:
                if len(self.words) >= 400_000:  # bounded memory; scores are the same when computed again
                    self.words.clear()
                    at_once = self.rows[at[:i]].copy()
                    return np.vstack([at_once, self.word_rows(words[i:])])
                k = self.words[w] = len(self.words)
                if k >= len(self.rows):
                    self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
                g = _grams(w)
                self.rows[k, :-1] = self.weights[g].sum(0)
                self.rows[k, -1] = len(g)
            at[i] = k
        return self.rows[at]

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        z = (sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias) / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def __getstate__(self):
        return self.langs, self.weights, self.bias, self.temperature

    def __setstate__(self, state):
        self.__init__(*state)


def _ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, epochs: int = 12, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
    rng = np.random.default_rng(3)
    z, n = np.zeros((FEATURES, k)), np.zeros((FEATURES, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def solved(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            at, v = x[i]
            w, b = solved(z[at], n[at], l1), solved(zb, nb, 0.0)
            s = v @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = v[:, None] * p[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha * b
            nb += p * p
    return solved(z, n, l1), solved(zb, nb, 0.0)


def train(samples: list[tuple[str, str]], scale: float = 30.0, epochs: int = 12, folds: int = 5) -> Model | None:
    """A calibrated model from (text, language) pairs; fewer than two languages cannot be told apart and give none."""
    samples = [(t, l) for t, l in samples if t and l and _words(_folded(t))][:TRAIN_ROWS]
    langs = sorted({l for _, l in samples})
    if len(langs) < 2:
        return None
    y = np.array([langs.index(l) for _, l in samples])
    counted = []
    for t, _ in samples:
        g = [f for w in _words(_folded(t)) for f in _grams(w)]
        counted.append((*np.unique(g, return_counts=True), len(g)))
    df = np.zeros(FEATURES)
    for at, _, _ in counted:
        df[at] += 1
    idf = np.log((1 + len(samples)) / (1 + df)) + 1
    x = [(at, scale * c / total * idf[at]) for at, c, total in counted]
    fold = np.random.default_rng(5).permutation(len(x)) % 5
    held = np.zeros((len(x), len(langs)))
    out = np.zeros(len(x), bool)
    for f in range(folds):
        rest = np.flatnonzero(fold != f)
        w, b = _ftrl([x[i] for i in rest], y[rest], len(langs), epochs)
        for i in np.flatnonzero(fold == f):
            held[i], out[i] = x[i][1] @ w[x[i][0]] + b, True

    def loss(temperature):
        z = held[out] / temperature
        z = z - z.max(1, keepdims=True)
        log_p = z - np.log(np.exp(z).sum(1, keepdims=True))
        # labels smoothed a little: separable samples must not drive the temperature to nought
        return -((1 - SMOOTHING) * log_p[np.arange(len(z)), y[out]] + SMOOTHING * log_p.mean(1)).mean()

    temperature = min(np.geomspace(0.2, 10, 60), key=loss)
    w, b = _ftrl(x, y, len(langs), epochs)
    model = Model(langs, w * idf[:, None] * scale, b, float(temperature))
    model.held_out_accuracy = float((held[out].argmax(1) == y[out]).mean())
    return model


def _units(text: str) -> list[str]:
    return [u for u in _EDGE.split(unicodedata.normalize("NFKC", _GONE.sub("", text))) if u]


def _judged(model: Model, texts: list[str | None]):
    """For each text its units (words, best language, confidence, unit text)."""
    units, owner, n_words, words = [], [], [], []
    for i, t in enumerate(texts):
        for u in _units(t) if t else ():
            w = _words(u.lower())
            if w:
                units.append(u)
                owner.append(i)
                n_words.append(len([x for x in w if len(x) > 1]))
                words.append(w)
    if not units:
        return units, np.zeros(0, int), np.zeros(0, int), np.zeros((0, len(model.langs) + 1))
    rows = model.word_rows([w for ws in words for w in ws])
    starts = np.cumsum([0] + [len(w) for w in words[:-1]])
    return units, np.array(owner), np.array(n_words), np.add.reduceat(rows, starts)


def _languages(model: Model, n_words: np.ndarray, sums: np.ndarray) -> dict[int, float]:
    """Language index -> confidence of one document's units."""
    p = model.probabilities(sums)
    best, sure = p.argmax(1), p.max(1)
    whole = (n_words >= WHOLE) & (sure >= SURE)
    if whole.any():
        main = np.bincount(best[whole], weights=n_words[whole]).argmax()
        counts = whole & ((best == main) | (sure >= OTHER))
        return {int(l): float(sure[counts & (best == l)].max()) for l in np.unique(best[counts])}
    if n_words.sum() < 3:
        return {}
    q = model.probabilities(sums.sum(0, keepdims=True))[0]
    return {int(q.argmax()): float(q.max())}


def _documents(model):
    def run(batches: Iterator[pa.RecordBatch]):
        m = received(model)
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                _, owner, n_words, sums = _judged(m, texts)
                edges = np.searchsorted(owner, np.arange(len(texts) + 1))
                out = []
                for i, key in enumerate(keys):
                    if edges[i] < edges[i + 1]:
                        found = _languages(m, n_words[edges[i] : edges[i + 1]], sums[edges[i] : edges[i + 1]])
                        if found:
                            out.append((i, [m.langs[l] for l in found], list(found.values())))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array([o[0] for o in out], pa.int64())), part.column(2).take(pa.array([o[0] for o in out], pa.int64())),
                     pa.array([o[1] for o in out], pa.list_(pa.string())), pa.array([o[2] for o in out], pa.list_(pa.float64()))],
                    names=["doc", "given", "langs", "confidences"])

    return run


def _segments(model):
    def run(batches: Iterator[pa.RecordBatch]):
        m = received(model)
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                texts = part.column(1).to_pylist()
                units, owner, n_words, sums = _judged(m, texts)
                out = []
                if len(units):
                    p = m.probabilities(sums)
                    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
                    for i in range(len(texts)):
                        a, b = edges[i], edges[i + 1]
                        if a == b or not _languages(m, n_words[a:b], sums[a:b]):
                            continue
                        best = p[a:b].argmax(1)
                        trusted = (n_words[a:b] >= WHOLE) & (p[a:b].max(1) >= SURE)
                        if trusted.any():  # short pieces follow the last whole sentence before them, leading ones the first
                            at = np.maximum.accumulate(np.where(trusted, np.arange(b - a), -1))
                            at[at < 0] = np.flatnonzero(trusted)[0]
                            best = best[at]
                        else:
                            best[:] = m.probabilities(sums[a:b].sum(0, keepdims=True))[0].argmax()
                        runs = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
                        for n, (x, y) in enumerate(zip(runs, np.r_[runs[1:], b - a])):
                            q = m.probabilities(sums[a + x : a + y].sum(0, keepdims=True))[0]
                            out.append((i, n, m.langs[best[x]], float(q[best[x]]), " ".join(units[a + x : a + y]).strip()))
                cols = list(zip(*out)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.string())],
                    names=["doc", "segment", "lang", "confidence", "text"])

    return run


def canonical(lang: Column) -> Column:
    """The two-letter code that a label in any notation names, or null."""
    bare = F.regexp_extract(F.lower(F.trim(lang)), r"^(\p{L}+)(?:[-_].*)?$", 1)
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(bare.isin(names), F.lit(code)).otherwise(out)
    return out


def fitted(samples: DataFrame, docs: DataFrame | None = None, labelled: int = LABELLED_DOCS) -> Model | None:
    """The model of a table of clean sentences (sample_id, text, lang), at most ``TRAIN_ROWS`` of them.

    With ``docs`` it is trained once more with sentences of up to ``labelled`` labelled documents (smallest hashes of the id)
    in which the first model, sentence by sentence, finds the label's language and no other; at most ``PER_LANGUAGE`` each.
    """
    rows = samples.filter("text IS NOT NULL AND lang IS NOT NULL").orderBy("sample_id").limit(TRAIN_ROWS).select("text", "lang").collect()
    clean = [(r[0], r[1]) for r in rows]
    model = train(clean)
    if docs is None or model is None:
        return model
    named = docs.select("doc_id", "text", canonical(F.col("lang")).alias("label")).filter("label IS NOT NULL AND length(text) BETWEEN 20 AND 3000")
    picked = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).select("text", "label").collect()
    more: dict[str, list[str]] = {l: [] for l in model.langs}
    for text, label in picked:
        units, _, n_words, sums = _judged(model, [text])
        if label in more and len(units):
            best = model.probabilities(sums).argmax(1)
            whole = n_words >= WHOLE
            agree = np.array([model.langs[b] == label for b in best])
            # one sentence off may be an error of the first model, a second one is another language
            if whole.any() and (~agree & whole).sum() <= 0.1 * whole.sum():
                more[label] += [u for u, w in zip(units, whole) if w][: max(0, PER_LANGUAGE - len(more[label]))]
    return train(clean + [(u, l) for l, us in more.items() for u in us], epochs=4, folds=1)


def document_languages(docs: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence, n_langs, label): one row for each language of each document; ``label`` is the given one as a code."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if (made := fitted(samples, docs)) is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, lang string, confidence double, n_langs int, label string")
    model = ship(docs.sparkSession, made)
    found = docs.select("doc_id", "text", "lang").mapInArrow(_documents(model), f"doc {kind}, given string, langs array<string>, confidences array<double>")
    return found.select(F.col("doc").alias("doc_id"), F.explode(F.arrays_zip("langs", "confidences")).alias("x"), F.size("langs").alias("n_langs"), canonical(F.col("given")).alias("label")).select(
        "doc_id", F.col("x.langs").alias("lang"), F.col("x.confidences").alias("confidence"), "n_langs", "label")


def document_segments(docs: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id, segment, lang, confidence, text): the runs of one language in each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if (made := fitted(samples, docs)) is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, segment int, lang string, confidence double, text string")
    model = ship(docs.sparkSession, made)
    found = docs.select("doc_id", "text").mapInArrow(_segments(model), f"doc {kind}, segment int, lang string, confidence double, text string")
    return found.withColumnRenamed("doc", "doc_id")


def corrected_labels(docs: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id, lang) of documents whose label does not name their one language, and of those in several languages."""
    found = document_languages(docs, samples)
    return found.filter("n_langs > 1 OR label IS NULL OR label <> lang").select("doc_id", "lang").distinct()
