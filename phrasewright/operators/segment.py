"""Word segmentation: the best path through a word graph, and a hidden Markov model for what the dictionary doesn't hold.

A word's weight is the logarithm of its share of all occurrences. The path of the largest sum
is found from the end of a run backwards. Characters that it leaves alone, two or more in a
row, are cut again by a model with four states: a character begins a word, is inside one, ends
one, or is one. The model is estimated from the same list of words in Spark; what comes to the
driver of it is at most four numbers for each character.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasewright.functions.normal import points
from phrasewright.operators import keys as K
from phrasewright.operators.scan import spread

BEGIN, INSIDE, END, ALONE = range(4)
#: What may stand before each state, and which states may end a run.
BEFORE = {BEGIN: (END, ALONE), INSIDE: (BEGIN, INSIDE), END: (BEGIN, INSIDE), ALONE: (END, ALONE)}
LAST = (END, ALONE)
HAN = "㐀-䶿一-鿿"
#: Runs that a task remembers.
SHORT, KNOWN, PIECE = 12, 1 << 17, 16
_PIECES = re.compile(r"\s+|\S+")
_OTHER = r"[A-Za-z0-9]+(?:\.[0-9]+)?%?|\s+|."


@dataclass(frozen=True)
class Model:
    """Logarithms: of a run's first state, of a state after another, of a character in each state, and of one never seen there."""

    start: tuple[float, ...]
    follow: dict[tuple[int, int], float]
    said: dict[str, tuple[float, ...]]
    unseen: tuple[float, ...]

    def states(self, run: str) -> list[int]:
        """The likeliest states of a run's characters."""
        score = [s + e for s, e in zip(self.start, self.said.get(run[0], self.unseen), strict=True)]
        back = []
        for c in run[1:]:
            said = self.said.get(c, self.unseen)
            came = [max(BEFORE[s], key=lambda b: score[b] + self.follow[b, s]) for s in range(4)]  # noqa: B023
            score = [score[b] + self.follow[b, s] + said[s] for s, b in enumerate(came)]
            back.append(came)
        out = [max(LAST, key=lambda s: score[s])]
        for came in reversed(back):
            out.append(came[out[-1]])
        return out[::-1]

    def cut(self, run: str) -> list[str]:
        """A run in words."""
        out, begin = [], 0
        for i, state in enumerate(self.states(run)):
            if state in LAST:
                out.append(run[begin : i + 1])
                begin = i + 1
        return out


def estimated(words: DataFrame) -> Model:
    """The model of words (word, n): how often a character is seen in each state, how often a state follows another inside a
    word, and between words as if a word didn't depend on the one before it. Counts are one more than seen."""
    size, n = F.length("word"), F.col("n").cast("double")
    kept = words.where((size > 0) & (n > 0))
    state = lambda i: F.when(size == 1, ALONE).when(i == 0, BEGIN).when(i == size - 1, END).otherwise(INSIDE)
    each = kept.select(n.alias("n"), size.alias("size"), F.posexplode(F.split("word", "")).alias("i", "ch"))
    size = F.col("size")
    seen = {(r.ch, r.state): r.n for r in each.groupBy("ch", state(F.col("i")).alias("state")).agg(F.sum("n").alias("n")).collect()}
    size = F.length("word")
    sums = kept.agg(*(F.sum(F.when(test, x * n).otherwise(0.0)).alias(name) for name, test, x in (("one", size == 1, 1), ("two", size == 2, 1), ("more", size > 2, 1), ("inner", size > 3, size - 3)))).first()
    one, two, more, inner = (x or 0.0 for x in sums)
    alone, begins = one + 1, two + more + 1
    ln = lambda a, b: math.log(a / b)
    start = (ln(begins, alone + begins), -math.inf, -math.inf, ln(alone, alone + begins))
    follow = {(BEGIN, INSIDE): ln(more + 1, two + more + 2), (BEGIN, END): ln(two + 1, two + more + 2), (INSIDE, INSIDE): ln(inner + 1, more + inner + 2), (INSIDE, END): ln(more + 1, more + inner + 2)}
    follow |= {(a, b): start[b] for a in LAST for b in (BEGIN, ALONE)}
    letters = sorted({c for c, _ in seen})
    total = [sum(v for (_, s), v in seen.items() if s == state) + len(letters) + 1 for state in range(4)]
    said = {c: tuple(ln(seen.get((c, s), 0.0) + 1, total[s]) for s in range(4)) for c in letters}
    return Model(start, follow, said, tuple(ln(1, t) for t in total))


class Segmenter:
    """keys: slot words with the number of occurrences; total: their sum."""

    def __init__(self, keys: K.Keys, total: float, model: Model | None, inside: str = HAN):
        self.keys, self.model, self.total = keys, model, math.log(max(total, 1.0))
        self.parts = re.compile(f"(?P<run>[{inside}]+)|{_OTHER}", re.S)
        self.weight: dict[int, float] = {}
        #: What runs of up to SHORT characters were cut to; runs between marks come again and again.
        self.known: dict[str, list[str]] = {}
        #: Tokens of what stood between white space, up to PIECE characters.
        self.cut_pieces: dict[str, list[tuple[int, str]]] = {}

    def words(self, text: str) -> tuple[list[int], list[int], list[float]]:
        """Of all dictionary words in a text, by their starts and then lengths: where those of each place begin, lengths, weights."""
        start, length, record = self.keys.find(points(text))
        order = np.lexsort((length, start))
        known, of = np.unique(record[order], return_inverse=True)
        for r in known.tolist():
            if r not in self.weight:
                self.weight[r] = math.log(float(self.keys.value("words", r))) - self.total
        weights = np.array([self.weight[r] for r in known.tolist()])
        return np.searchsorted(start[order], np.arange(len(text) + 1)).tolist(), length[order].tolist(), weights[of].tolist() if len(known) else []

    def path(self, run: str, a: int = 0, b: int | None = None, words=None) -> list[str]:
        """The words of the best path through run[a:b], the longer word where two paths weigh the same. A character that is no
        word counts once."""
        b = len(run) if b is None else b
        at, length, weight = words or self.words(run)
        best, step = [0.0] * (b - a + 1), [1] * (b - a)
        for i in range(b - 1, a - 1, -1):
            top, size = best[i - a + 1] - self.total, 1
            for j in range(at[i], at[i + 1]):
                n = length[j]
                if i + n > b:
                    break
                if (way := weight[j] + best[i - a + n]) >= top or n == 1:
                    top, size = way, n
            best[i - a], step[i - a] = top, size
        out, i = [], a
        while i < b:
            out.append(run[i : i + step[i - a]])
            i += step[i - a]
        return out

    def cut(self, run: str, a: int = 0, b: int | None = None, words=None) -> list[str]:
        """run[a:b] in words; characters alone go to the model, unless together they are a word that the path left."""
        out, alone = [], ""
        for word in [*self.path(run, a, b, words), ""]:
            if len(word) == 1:
                alone += word
                continue
            if len(alone) > 1 and self.model and not self.keys.has("words", alone):
                out += self.model.cut(alone)
            else:
                out += alone
            alone = ""
            if word:
                out.append(word)
        return out

    def tokens(self, text: str) -> list[tuple[int, str]]:
        """(start, word) of a text: runs of script in words; Latin words, numbers and blanks as they stand; other characters alone."""
        out, words = [], self.words(text)
        for m in self.parts.finditer(text):
            at = m.start()
            if not m["run"]:
                out.append((at, m[0]))
                continue
            run = m[0]
            if (cut := self.known.get(run)) is None:
                cut = self.cut(text, at, m.end(), words)
                if len(run) <= SHORT and len(self.known) < KNOWN:
                    self.known[run] = cut
            for word in cut:
                out.append((at, word))
                at += len(word)
        return out

    def columns(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The tokens of texts as columns: number of the text, start, word. No token reaches over an end of white space, so what
        stands between is cut once for all texts and its tokens are taken as often as it occurs."""
        index: dict[str, int] = {}
        found = [_PIECES.findall(t) for t in texts]
        code = np.array([index.setdefault(p, len(index)) for f in found for p in f], dtype=np.int64)
        pieces = list(index)
        solid = [i for i, p in enumerate(pieces) if not p[0].isspace()]
        tokens: list[list[tuple[int, str]]] = [[(0, p)] for p in pieces]
        fresh = [i for i in solid if pieces[i] not in self.cut_pieces]
        if fresh:
            # Together, as a search has a price of its own; the line feeds between them are tokens themselves.
            which, at = iter(fresh), 0
            i = next(which)
            tokens[i] = []
            for start, word in self.tokens("\n".join(pieces[i] for i in fresh)):
                if word == "\n":
                    i, at = next(which), start + 1
                    tokens[i] = []
                else:
                    tokens[i].append((start - at, word))
            for i in fresh:
                if len(pieces[i]) <= PIECE and len(self.cut_pieces) < KNOWN:
                    self.cut_pieces[pieces[i]] = tokens[i]
        fresh = set(fresh)
        for i in solid:
            if i not in fresh:
                tokens[i] = self.cut_pieces[pieces[i]]
        each, long = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (tokens, pieces))
        offset = np.fromiter((s for t in tokens for s, _ in t), dtype=np.int64, count=int(each.sum()))
        words = pa.array([w for t in tokens for _, w in t], pa.string())
        of = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        size, begin = each[code], (np.cumsum(each) - each)[code]
        place = np.cumsum(long[code]) - long[code]
        # From the start of the own text.
        first = np.searchsorted(of, np.arange(len(texts)))
        place -= np.append(place, 0)[first][of]
        nth = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.repeat(of, size), np.repeat(place, size) + offset[nth], words.take(pa.array(nth))


def segmented(texts: DataFrame, words: DataFrame, model: Model | None = None, inside: str = HAN) -> DataFrame:
    """(doc_id, start, word) of texts (doc_id, text), start in characters from 0. words: (word, n), any number of them, distinct.

    model: of what no word covers, estimated from the words if it isn't given. Null and empty texts have no words; words that
    are null or empty or don't occur (n < 1) are left out.
    """
    model = model or estimated(words)
    kept = words.where("char_length(word) > 0 and n >= 1")
    total = kept.agg(F.sum("n")).first()[0] or 0
    name = K.written({"words": kept.select(F.col("word").alias("key"), F.col("n").cast("string").alias("value"))})
    sent = texts.sparkSession.sparkContext.broadcast((model, float(total), inside))

    def walked(batches):
        model, total, inside = sent.value
        own = Segmenter(K.mapped(name), total, model, inside)
        for whole in batches:
            for a in range(0, whole.num_rows, 64):
                batch = whole.slice(a, 64)
                row, start, words = own.columns([t or "" for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(start, pa.int32()), words], names=["doc_id", "start", "word"])

    return spread(texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(walked, "doc_id long, start int, word string")
