"""Toxicity by multiple-instance learning: sentences are the instances, only documents carry labels.

A sentence's probability is a logistic function of the summed weights of its words; a
document is toxic if any sentence is (noisy-or): P = 1 - prod(1 - p_s). Training maximises
the likelihood of the document labels through that formula, so blame reaches the sentences
that explain a label, and the trained sentence scores locate the offending ones.

A word's weight is the sum of the weights of its features: the word itself and its
prefixes of two to eight letters, which generalise over endings. Features that toxic rows
of the sample don't hold clearly more often than other rows get no weight.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from math import log, sqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, release, text_slices, widened

#: Labelled rows the fit uses at most, of each label: a bounded sample, the first in an order by hash.
SAMPLE = 2000
#: Bytes of text that the fit takes to the driver at most.
MOST_BYTES = 256 << 20
THRESHOLD = 0.3
#: Standard errors by which a feature's log odds must exceed 0 to get a weight.
CLEAR = 4.0
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_WORDED = re.compile(r"[^.!?\n]*?[^\W\d_][^.!?\n]*")
_CACHE_LIMIT = 120_000
#: Code points of texts that are scored before their rows go on.
_BATCH = 1_000_000


def features(word: str) -> list[str]:
    """A lower-case word as a feature, and its prefixes."""
    return ["=" + word, *["^" + word[:n] for n in range(2, min(8, len(word)) + 1)]]


def clear_features(texts, toxic) -> list[str]:
    """Those found in toxic documents clearly more often than in others, sorted. Texts in lower case."""
    yes, no = Counter(), Counter()
    for text, y in zip(texts, toxic, strict=True):
        if y:
            yes.update({f for w in set(_WORD.findall(text)) for f in features(w)})
    for f in [f for f, n in yes.items() if n < 3]:
        del yes[f]
    for text, y in zip(texts, toxic, strict=True):
        if not y:
            no.update({f for w in set(_WORD.findall(text)) for f in features(w) if f in yes})
    rows = sum(map(bool, toxic)), sum(not y for y in toxic)

    def z(f):
        p, n = yes[f] + 0.5, no[f] + 0.5
        return (log(p / (rows[0] + 1.5 - p)) - log(n / (rows[1] + 1.5 - n))) / sqrt(1 / p + 1 / n)

    return sorted(f for f in yes if yes[f] + no[f] >= 4 and z(f) >= CLEAR)


def fit(texts, toxic, rounds: int = 300, rate: float = 0.1, ridge: float = 1e-5) -> tuple[dict[str, float], float]:
    """Weights and bias that maximise the penalised noisy-or likelihood, by Adam on all rows at once. Without rows of both
    labels there are no weights, and every score is near the share of toxic rows."""
    y = np.asarray(toxic, dtype=float)
    if not len(y) or y.min() == y.max():
        return {}, -12.0 if not len(y) or y.max() == 0 else 2.0
    lower = [(t or "").lower() for t in texts]
    chosen = clear_features(lower, toxic)
    slot = {f: i for i, f in enumerate(chosen)}
    known: dict[str, tuple[int, ...]] = {}
    feature, size, doc = [], [], []
    for d, text in enumerate(lower):
        for words in filter(None, (set(_WORD.findall(x)) for x in _SENTENCE.findall(text))):
            before = len(feature)
            for w in sorted(words):
                if w not in known:
                    known[w] = tuple(slot[f] for f in features(w) if f in slot) or ()
                feature += known[w]
            size.append(len(feature) - before)
            doc.append(d)
    feature, doc = np.array(feature, dtype=np.int64), np.array(doc, dtype=np.int64)
    sentence = np.repeat(np.arange(len(size)), size)
    if not len(doc):
        return {}, -12.0
    theta, m, v = (np.zeros(len(chosen) + 1) for _ in range(3))
    theta[-1] = -5.0
    for step in range(1, rounds + 1):
        z = np.clip(theta[-1] + np.bincount(sentence, weights=theta[feature], minlength=len(doc)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.clip(np.bincount(doc, weights=np.logaddexp(0, z), minlength=len(y)), 1e-9, 50)
        blame = (1 - y) - y * np.exp(-none) / -np.expm1(-none)
        dz = p * blame[doc] / len(y)
        grad = np.append(np.bincount(feature, weights=dz[sentence], minlength=len(chosen)) + ridge * theta[:-1], dz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return {f: float(x) for f, x in zip(chosen, theta, strict=False)}, float(theta[-1])


class Scorer:
    """Scores texts with fitted weights; remembers words it has met, up to a limit."""

    def __init__(self, theta: dict[str, float], bias: float):
        self.theta, self.bias, self.known = theta, bias, {}

    def word(self, w: str) -> float:
        if len(self.known) > _CACHE_LIMIT:
            self.known.clear()
        theta = self.theta
        out = self.known[w] = sum(theta.get(f, 0.0) for f in features(w))
        return out

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, logit) of each sentence that has words."""
        low = text.lower()
        low = low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)
        known, weight = self.known, {}
        for w in set(_WORD.findall(low)):
            x = known.get(w)
            if x := self.word(w) if x is None else x:
                weight[w] = x
        if not weight:
            return [(*m.span(), self.bias) for m in _WORDED.finditer(low)]
        return [(*m.span(), self.bias + sum(weight.get(w, 0.0) for w in sorted(set(_WORD.findall(m[0]))))) for m in _WORDED.finditer(low)]


def score_text(scorer: Scorer, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
    """The noisy-or score (0 without words) and the sentences with their own probabilities."""
    parts = scorer.sentences(text or "")
    if not parts:
        return 0.0, []
    z = np.clip([x[2] for x in parts], -30, 30)
    p = 1 / (1 + np.exp(-z))
    return float(-np.expm1(-np.logaddexp(0, z).sum())), [(a, b, q) for (a, b, _), q in zip(parts, p.tolist(), strict=True)]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], float]:
    """Fit on at most `sample` rows of each label whose crc32(doc_id as text) mod 4 is not 2. Repeated rows of a text count once;
    the fit's texts are gathered on the driver, so more than MOST_BYTES of them are an error: take a smaller sample then."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and crc32(cast(doc_id as string)) % 4 <> 2")
    first = [own.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = first[0].union(first[1]).distinct()
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").distinct()
    got = _bounded(got).toArrow()
    rows = sorted(zip(got["doc_id"].to_pylist(), map(hash_text, got["text"].to_pylist()), got["text"].to_pylist(), got["toxic"].to_pylist(), strict=True), key=lambda r: (r[0], r[1], r[3]))
    model = fit([r[2] for r in rows], [r[3] for r in rows])
    del got, rows
    release()
    return model


def _bounded(rows: DataFrame) -> DataFrame:
    """rows, after a look at the size of their texts."""
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of labelled texts, more than {MOST_BYTES}")
    return rows


def hash_text(text: str | None) -> int:
    return crc32((text or "").encode("utf-8", "surrogatepass"))


def _worker(shared) -> Scorer:
    return kept(shared.id, lambda: Scorer(*shared.value))


class _Model:
    """A broadcast with a name that lets a worker keep its scorer between tasks."""

    def __init__(self, spark, value, name):
        self.sent, self.id = spark.sparkContext.broadcast(value), name

    @property
    def value(self):
        return self.sent.value


def score(docs: DataFrame, model: tuple[dict[str, float], float]) -> DataFrame:
    """docs (text and any other columns) with __toxicity double, __offending array<struct<start, end, score>>.

    Null, empty and wordless texts score 0. Repeated rows score alike. __offending lists the sentences whose own probability
    reaches the threshold, by code point offsets into the text. Texts are read whole, sentence by sentence; an empty table
    stays empty. Columns of docs with one of the two names are replaced.
    """
    docs = docs.drop("__toxicity", "__offending")
    shared = _Model(docs.sparkSession, model, uuid.uuid4().hex)
    at = docs.columns.index("text")

    def scored(batches):
        scorer = _worker(shared)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for whole in batches:
            for a, texts in text_slices(whole.column(at), _BATCH):
                batch, found, bad = whole.slice(a, len(texts)), [], []
                for text in texts:
                    toxic, parts = score_text(scorer, text)
                    found.append(toxic)
                    bad.append([{"start": b, "end": c, "score": s} for b, c, s in parts if s >= THRESHOLD])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64()), pa.array(bad, kind)], names=[*batch.schema.names, "__toxicity", "__offending"])

    spot = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
    return widened(docs, scored, [T.StructField("__toxicity", T.DoubleType()), T.StructField("__offending", spot)])
