"""N-best SentencePiece segmentation: forward Viterbi scores guide a backward A* search over the piece lattice.

A text becomes " " + text; a space is the vocabulary's space mark. A segmentation's score is
the sum of its pieces' scores, and the best N by score are found. Characters without a piece
(and literal space marks) are spelt in byte pieces at a score below any piece's, so decoding
gives back every text exactly.

The lattice falls apart where no piece of the vocabulary holds two neighbouring characters
together. Viterbi runs on words, many of one length at once (on those segments, if a word is
long), A* on segments; a document's best N combine the best N of its segments. Between
variants of a document with equal scores, the earliest segment that differs decides for the
lower rank.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
import uuid
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import kept, slices, widened

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Pairs of code points below _LOW are looked up in a table. Words up to _WIDE are scored many at a time. A sum of scores under -_FAR is no path.
_WIDE, _BASE, _NONE, _FAR, _LOW = 24, np.uint64(0x9E3779B97F4A7C55), -(1 << 60), 1 << 58, 512
#: Odd: deals the sums of short pieces out over all upper bits.
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
MARK, N_BEST = "▁", 4
_CACHE_LIMIT = 200_000
#: So many words are scored, and so many words of a text put together, at a time.
_AT_ONCE, _BLOCK = 2048, 200_000
#: Scores that aren't whole numbers are kept in this part of one.
_FINE = 1_000_000


def load(path: str = MODEL) -> dict:
    """Pieces with their scores from a SentencePiece model file that the driver can read. Scores are whole numbers of 1 / scale:
    those of a pair-merging model as they are, those of a unigram model to six places."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    plain, byte = {}, {}
    for i in range(size):
        if sp.is_byte(i):
            byte[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            plain[sp.id_to_piece(i)] = (i, sp.get_score(i))
    scale = 1 if all(score == round(score) for _, score in plain.values()) else _FINE
    return {"plain": {p: (i, round(score * scale)) for p, (i, score) in plain.items()}, "byte": byte, "size": size, "scale": scale}


class Lattice:
    """Encodes and decodes with the pieces of load(); remembers words, up to a limit."""

    def __init__(self, pieces: dict, n: int = N_BEST):
        self.n, self.byte, self.scale = n, pieces["byte"], pieces.get("scale", 1)
        self.plain = {p.replace(MARK, " "): x for p, x in pieces["plain"].items()}
        self.longest = max(map(len, self.plain), default=1)
        self.joined = {pair for p in self.plain for pair in zip(p, p[1:], strict=False)}
        self.pairs = np.array(sorted((ord(a) << 21) | ord(b) for a, b in self.joined), dtype=np.int64)
        self.low = np.zeros((_LOW, _LOW), dtype=bool)
        for a, b in self.joined:
            if a < chr(_LOW) and b < chr(_LOW):
                self.low[ord(a), ord(b)] = True
        self.begins = {p[:i]: None for p in self.plain for i in range(1, len(p))} | self.plain
        self.below = min((s for _, s in self.plain.values() if s > -(10**8) * self.scale), default=0) - 10 * self.scale
        self.spelling = [b""] * pieces["size"]
        for p, (i, _) in self.plain.items():
            self.spelling[i] = p.encode()
        for b, i in self.byte.items():
            self.spelling[i] = bytes([b])
        self.bytes_of = np.array([len(x) for x in self.spelling], dtype=np.int64)
        # The numbers of pieces as they stand in a digest's text, filled up with zero bytes.
        self.told = np.frombuffer(b"".join([b"%d," % i + bytes(7 - len(str(i))) for i in range(pieces["size"])]), dtype=np.uint64)
        keys = {_poly(p) * int(_SPREAD) & (1 << 64) - 1: x for p, x in self.plain.items()}
        self.keys = np.sort(np.fromiter(keys, dtype=np.uint64, count=len(keys)))
        self.key_ids = np.array([keys[int(k)][0] for k in self.keys], dtype=np.int32)
        self.key_scores = np.array([keys[int(k)][1] for k in self.keys], dtype=np.int64)
        # By the upper bits of a key, the first with these, and how many share them at most.
        upper = (self.keys >> np.uint64(44)).astype(np.int64)
        self.place, self.shared = np.full(1 << 20, -1, dtype=np.int32), int(np.bincount(upper).max(initial=0)) if len(upper) else 0
        self.place[upper[::-1]] = np.arange(len(upper))[::-1]
        self.filled = self.place >= 0
        # One more than any, so that there is a last one without pieces too.
        self.keys, self.key_ids, self.key_scores = np.append(self.keys, ~np.uint64(0)), np.append(self.key_ids, np.int32(-1)), np.append(self.key_scores, _NONE)
        # What is known of words, by row: score, loss, uses, whether the pieces spell the word, and the place and number of its pieces.
        self.rows, self.names, self.known, self.flat, self.flat_size = _Rows(), [], np.zeros(0, dtype=_WORD), np.zeros(0, dtype=np.int32), 0
        self.parts: dict[str, tuple] = {}
        self.options: dict[str, tuple[list, bool]] = {}
        self.near: dict[str, list] = {}

    def edges(self, s: str) -> list[list[tuple[int, tuple[int, ...], int]]]:
        """By start: (end, pieces, score). A character without a piece is one edge of byte pieces."""
        begins, size, out = self.begins, len(s), []
        for i in range(size):
            here = []
            for j in range(i + 1, size + 1):
                x = begins.get(s[i:j], 0)
                if x:
                    here.append((j, x[0:1], x[1]))
                elif x == 0:
                    break
            if not here or here[0][0] > i + 1:
                here.append((i + 1, tuple([self.byte[b] for b in s[i].encode("utf-8", "surrogatepass")]), self.below))
            out.append(here)
        return out

    @staticmethod
    def forward(edges) -> list[int]:
        """Viterbi: the best score of each beginning of a segment."""
        best = [0] + [-(1 << 62)] * len(edges)
        for i, here in enumerate(edges):
            so_far = best[i]
            for j, _, score in here:
                if so_far + score > best[j]:
                    best[j] = so_far + score
        return best

    def nearest(self, s: str) -> tuple[int, tuple[int, ...], int | None]:
        """Best score and pieces, and what the second best loses (None without one): the second best differs in an edge, so
        it is the best path through an edge off the first. Of equally good paths the first takes the longer pieces from the start."""
        edges = self.edges(s)
        best, size = self.forward(edges), len(s)
        back = [0] * (size + 1)
        for i in range(size - 1, -1, -1):
            back[i] = max([score + back[j] for j, _, score in edges[i]])
        top, at, path, second = best[size], 0, (), None
        for i, here in enumerate(edges):
            so_far, on = best[i], -1
            if i == at:
                on, ids, _ = max([x for x in here if so_far + x[2] + back[x[0]] == top])
                path += ids
                at = on
            for j, _, score in here:
                if j != on and (second is None or so_far + score + back[j] > second):
                    second = so_far + score + back[j]
        return top, path, None if second is None else top - second

    @property
    def words(self) -> dict[str, tuple[tuple[int, ...], int, int]]:
        """What is known of words: (pieces of the best, its score, the smallest loss of a segment's second best)."""
        return {self.name(k): (tuple(self.flat[x["at"] : x["at"] + x["count"]].tolist()), int(x["score"]), int(x["loss"])) for k, x in enumerate(self.known[: len(self.names)])}

    def name(self, row: int) -> str:
        return (b" " + self.names[row]).decode("utf-8", "surrogatepass")

    def prime(self, texts: list[str]) -> list[np.ndarray]:
        """The rows of each text's words in what is known, after new ones were scored at once. The rows hold until the next call."""
        if len(self.rows) > _CACHE_LIMIT:
            self.forget()
        found, ends = split(texts)
        met, before = found.dictionary.to_numpy(zero_copy_only=False).tolist(), len(self.rows)
        try:
            rows = np.fromiter(map(self.rows.__getitem__, met), dtype=np.int64, count=len(met))
            if len(self.rows) > before:
                self.learn([met[i] for i in np.flatnonzero(rows >= before).tolist()])
        except BaseException:
            self.rows, self.names, self.flat_size = _Rows(), [], 0
            raise
        rows = rows[found.indices.to_numpy()]
        self.known["uses"][: len(self.rows)] += np.bincount(rows, minlength=len(self.rows))
        return [rows[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def forget(self) -> None:
        """Keeps words met again, at most half of the limit, those met most often lately."""
        known = self.known[: len(self.names)]
        keep = np.flatnonzero(known["uses"] > 1)
        if len(keep) > _CACHE_LIMIT // 2:
            keep = np.sort(keep[np.argsort(-known["uses"][keep], kind="stable")[: _CACHE_LIMIT // 2]])
        self.names, self.flat = [self.names[i] for i in keep.tolist()], self.pieces(keep)
        self.rows = _Rows(zip(self.names, range(len(keep)), strict=True))
        self.known, self.flat_size = known[keep], len(self.flat)
        self.known["uses"] //= 2
        self.known["at"] = np.cumsum(self.known["count"]) - self.known["count"]

    def learn(self, names: list[bytes]) -> None:
        """Scores new words, without their first space, and adds them after those known."""
        words = [" " + w.decode("utf-8", "surrogatepass") for w in names]
        new, sizes = np.zeros(len(words), dtype=_WORD), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order, found = np.argsort(sizes, kind="stable"), []
        for here, scores, losses, counts, ids in self.by_length(words, order, sizes):
            new["score"][here], new["loss"][here], new["count"][here] = scores, losses, counts
            found.append(ids)
        long = order[np.searchsorted(sizes[order], _WIDE + 1) :].tolist()
        cut = self.all_segments([words[i] for i in long])
        self.learn_parts(set(chain.from_iterable(cut)))
        for i, segments in zip(long, cut, strict=True):
            ids, score, loss = self.sum_of(segments)
            new[i] = score, loss, 0, 0, len(ids), False
            found.append(np.array(ids, dtype=np.int32))
        ids, ends = np.concatenate(found), np.cumsum(new["count"][order])
        new["at"][order] = self.flat_size + ends - new["count"][order]
        new["same"][order] = self.spelt([names[i] for i in order.tolist()], ids, ends)
        before, size = len(self.names), self.flat_size + len(ids)
        self.known = _longer(self.known, before, before + len(new))
        self.known[before : before + len(new)] = new
        self.flat = _longer(self.flat, self.flat_size, size)
        self.flat[self.flat_size : size], self.flat_size = ids, size
        self.names += names

    def by_length(self, words: list[str], order: np.ndarray, sizes: np.ndarray):
        """(indices, *together()) of words up to _WIDE, by order of their sizes."""
        upto = np.searchsorted(sizes[order], np.arange(1, _WIDE + 2)).tolist()
        for start, end in zip(upto, upto[1:], strict=False):
            for a in range(start, end, _AT_ONCE):
                here = order[a : min(a + _AT_ONCE, end)]
                yield (here, *self.together([words[i] for i in here.tolist()]))

    def learn_parts(self, segments: set[str]) -> None:
        """Scores new segments of long words and remembers them."""
        fresh = segments.difference(self.parts)
        if len(self.parts) + len(fresh) > _CACHE_LIMIT:
            self.parts.clear()
            fresh = segments
        fresh = list(fresh)
        sizes = np.fromiter(map(len, fresh), dtype=np.int64, count=len(fresh))
        for here, scores, losses, counts, ids in self.by_length(fresh, np.argsort(sizes, kind="stable"), sizes):
            ids, ends = ids.tolist(), np.cumsum(counts).tolist()
            for i, score, loss, a, b in zip(here.tolist(), scores.tolist(), losses.tolist(), [0, *ends], ends, strict=False):
                self.parts[fresh[i]] = score, tuple(ids[a:b]), None if loss >= _FAR else loss

    def spelt(self, names: list[bytes], ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """By word, whether its pieces, which end at these, spell it."""
        told, upto = self.spelling_of(ids.tolist()), np.cumsum(self.bytes_of[ids])[ends - 1].tolist()
        return np.fromiter((told[a:b] == b" " + w for w, a, b in zip(names, [0, *upto], upto, strict=False)), dtype=bool, count=len(names))

    def spelling_of(self, ids) -> bytes:
        return b"".join(_taken(self.spelling, ids))

    def pieces(self, rows: np.ndarray) -> np.ndarray:
        """The pieces of known words, one after the other."""
        counts = self.known["count"][rows]
        ends = np.cumsum(counts)
        return self.flat[np.repeat(self.known["at"][rows] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]

    def digest_of(self, rows: np.ndarray) -> str:
        """SHA-256 of the numbers of known words' pieces, comma-joined."""
        out, last = hashlib.sha256(), b""
        for a in range(0, len(rows), _BLOCK):
            out.update(last + (text := self.told[self.pieces(rows[a : a + _BLOCK])].tobytes().translate(None, b"\0"))[:-1])
            last = text[-1:]
        return out.hexdigest()

    def all_segments(self, words: list[str]) -> list[list[str]]:
        """segments() of many words."""
        text, sizes = "".join(words), np.array([len(w) for w in words], dtype=np.int64)
        if not text:
            return [self.segments(w) for w in words]
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        begins, small = np.ones(len(points), dtype=bool), points < _LOW
        small = small[:-1] & small[1:]
        near = np.flatnonzero(small)
        begins[near + 1] = ~self.low[points[near], points[near + 1]]
        far = np.flatnonzero(~small)
        if len(self.pairs) and len(far):
            pairs = (points[far] << 21) | points[far + 1]
            begins[far + 1] = self.pairs[np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)] != pairs
        starts = np.cumsum(sizes) - sizes
        begins[starts] = True
        cuts = np.flatnonzero(begins).tolist()
        parts = [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]
        upto = np.append(np.searchsorted(cuts, starts), len(cuts)).tolist()
        return [parts[a:b] for a, b in zip(upto, upto[1:], strict=False)]

    def together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """nearest() of many words of one length, by columns: scores, losses (_FAR without a second best), numbers of pieces, pieces."""
        count, wide = len(words), len(words[0])
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(count, wide).T.astype(np.uint64, order="C")
        sums, powers = np.zeros((wide + 1, count), dtype=np.uint64), np.ones(wide + 1, dtype=np.uint64)
        for i in range(wide):
            sums[i + 1] = sums[i] * _BASE + points[i] + np.uint64(1)
            powers[i + 1 :] *= _BASE
        most, scores = min(self.longest, wide), [None]
        for size in range(1, most + 1):
            h = ((sums[size:] - sums[:-size] * powers[size]) * _SPREAD).reshape(-1)
            near = np.flatnonzero(self.filled[(h >> np.uint64(44)).view(np.int64)])
            at, hit = self.find(h[near])
            x = np.full(h.size, self.below if size == 1 else _NONE)
            x[near[hit]] = self.key_scores[at[hit]]
            scores.append(x.reshape(-1, count))
        back, best, take = np.full((wide + 1, count), _NONE), np.full((wide + 1, count), _NONE), np.zeros((wide, count), dtype=np.int8)
        back[wide], best[0] = 0, 0
        for i in range(wide - 1, -1, -1):
            for size in range(1, min(most, wide - i) + 1):
                x = scores[size][i] + back[i + size]
                np.copyto(take[i], size, where=x >= back[i])
                np.maximum(back[i], x, out=back[i])
        for j in range(1, wide + 1):
            for size in range(1, min(most, j) + 1):
                np.maximum(best[j], best[j - size] + scores[size][j - size], out=best[j])
        at = np.zeros(count, dtype=np.int8)
        for i in range(wide):
            take[i] *= at == i
            at += take[i]
        second = np.full(count, _NONE)
        for size in range(1, most + 1):
            through = best[: wide + 1 - size] + scores[size] + back[size:]
            through[take[: wide + 1 - size] == size] = _NONE
            np.maximum(second, through.max(axis=0), out=second)
        losses = back[0] - second
        losses[losses > _FAR] = _FAR
        word, i = np.nonzero(take.T)
        size = take[i, word].astype(np.int64)
        at, hit = self.find((sums[i + size, word] - sums[i, word] * powers[size]) * _SPREAD)
        ids = self.key_ids[at]
        if not hit.all():
            ids, word = self.in_bytes(ids, word, np.where(hit, -1, points[i, word].astype(np.int64)))
        return back[0], losses, np.bincount(word, minlength=count), ids

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of keys among the pieces' and whether they are there."""
        at = np.maximum(self.place[(keys >> np.uint64(44)).view(np.int64)], 0)
        for _ in range(self.shared - 1):
            at += (self.keys[at] < keys) & (at + 1 < len(self.keys))
        return at, self.keys[at] == keys

    def in_bytes(self, ids: np.ndarray, word: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and their words with the byte pieces of points in place of theirs, where these aren't below 0."""
        spelt = {p: [self.byte[b] for b in chr(p).encode("utf-8", "surrogatepass")] for p in np.unique(points[points >= 0]).tolist()}
        counts = np.ones(len(ids), dtype=np.int64)
        for p, new in spelt.items():
            counts[points == p] = len(new)
        starts, out = np.cumsum(counts) - counts, np.repeat(ids, counts)
        for p, new in spelt.items():
            out[starts[points == p][:, None] + np.arange(len(new))] = new
        return out, np.repeat(word, counts)

    def search(self, s: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The n best (score, pieces) of a segment, or all if there are fewer, by A* from its end: the forward scores are
        exactly what the rest can still get. Equal scores: the path extended last goes on first, by its longest piece."""
        edges, out, pushed = self.edges(s), [], 0
        best, ending = self.forward(edges), [[] for _ in range(len(s) + 1)]
        for i, here in enumerate(edges):
            for j, ids, score in here:
                ending[j].append((i, ids, score))
        heap = [(-best[-1], 0, len(s), 0, None)]
        while heap and len(out) < n:
            f, _, at, done, path = heapq.heappop(heap)
            if not at:
                ids = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((-f, tuple(ids)))
                continue
            for i, ids, score in reversed(ending[at]):
                pushed += 1
                heapq.heappush(heap, (-(done + score + best[i]), -pushed, i, done + score, (ids, path)))
        return out

    def segments(self, word: str) -> list[str]:
        """Cut where no piece reaches across."""
        if self.joined.issuperset(zip(word, word[1:])):  # noqa: B905
            return [word]
        cuts = [i for i, pair in enumerate(zip(word, word[1:]), 1) if pair not in self.joined]  # noqa: B905
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def sum_of(self, segments: list[str]) -> tuple[tuple[int, ...], int, int]:
        """(pieces of the best, its score, the smallest loss of a segment's second best)."""
        if len(segments) == 1:
            score, ids, loss = self.parts.get(segments[0]) or self.part(segments[0])
            return ids, score, _FAR if loss is None else loss
        get = self.parts.get
        scores, pieces, losses = zip(*[get(s) or self.part(s) for s in segments], strict=True)
        return tuple(chain.from_iterable(pieces)), sum(scores), min([x for x in losses if x is not None], default=_FAR)

    def rivals(self, word: str) -> list[tuple[int, int]]:
        """The n - 1 smallest losses of a word's segments, with their places below zero."""
        if (out := self.near.get(word)) is None:
            if len(self.near) >= _CACHE_LIMIT // 8:
                self.near.clear()
            losses = [((self.parts.get(s) or self.part(s))[2], -place) for place, s in enumerate(self.segments(word))]
            out = self.near[word] = sorted(x for x in losses if x[0] is not None)[: self.n - 1]
        return out

    def from_first(self, options, s: str):
        """The segment's n best, led by the one that encode() takes."""
        first = (self.parts.get(s) or self.nearest(s))[:2]
        return [first, *[x for x in options if x != first]][: self.n]

    def best_of(self, s: str) -> tuple[list[tuple[int, tuple[int, ...]]], bool]:
        """The segment's n best and whether all spell it, remembered."""
        if (out := self.options.get(s)) is None:
            if len(self.options) >= _CACHE_LIMIT // 8:
                self.options.clear()
            options = self.from_first(self.search(s, self.n), s)
            out = self.options[s] = options, all(self.spelling_of(ids) == s.encode("utf-8", "surrogatepass") for _, ids in options)
        return out

    def part(self, s: str) -> tuple:
        if len(self.parts) >= _CACHE_LIMIT:
            self.parts.clear()
        out = self.parts[s] = self.nearest(s)
        return out

    def variants(self, rows: np.ndarray) -> tuple[int, list[tuple[int, list[tuple[int, int, tuple[int, ...]]]]], bool]:
        """The best score and the n best as (score, changes) of an entry of prime(), and whether all spell the text. A change
        replaces the pieces of a segment, named by its word and place."""
        most, near, known = self.n - 1, [], self.known
        total, whole = int(known["score"][rows].sum()), bool(known["same"][rows].all())
        # A text's nearest rivals stand in the words with the nearest ones, of equally near ones in the last.
        least = known["loss"][rows[::-1]]
        for _ in range(min(most, len(least))):
            at = int(least.argmin())
            if least[at] >= _FAR:
                break
            least[at], k = _FAR, len(least) - 1 - at
            near += [(loss, -k, place) for loss, place in self.rivals(self.name(rows[k]))]
        variants = [(0, (), [])]
        for _, k, place in sorted(sorted(near)[:most], key=lambda x: (-x[1], -x[2])):
            options, same = self.best_of(self.segments(self.name(rows[-k]))[-place])
            whole = whole and same
            variants = sorted(((loss + options[0][0] - score, ranks + (r,), [*changes, (-k, -place, ids_)] if r else changes) for loss, ranks, changes in variants for r, (score, ids_) in enumerate(options)), key=lambda v: v[:2])[: self.n]
        return total, [(total - loss, changes) for loss, _, changes in variants], whole

    def encode(self, text: str, primed=None) -> tuple[list[int], int, list[tuple[int, list[tuple[int, int, tuple[int, ...]]]]]]:
        """The best pieces and score, and the n best. primed: the text's entry of prime()."""
        rows = self.prime([text])[0] if primed is None else primed
        total, best, _ = self.variants(rows)
        return self.pieces(rows).tolist(), total, best

    def applied(self, text: str, changes) -> list[int]:
        """The pieces of one of the n best."""
        changed = {(k, p): ids for k, p, ids in changes}
        out: list[int] = []
        for k, w in enumerate(words_of(text)):
            for p, s in enumerate(self.segments(w)):
                out += changed.get((k, p)) or self.search(s, 1)[0][1]
        return out

    def decode(self, ids) -> str:
        return b"".join(_taken(self.spelling, ids)).decode("utf-8", "surrogatepass")[1:]


class _Rows(dict):
    """Rows by word, a new word's is the next."""

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        return row


_WORD = np.dtype([("score", np.int64), ("loss", np.int64), ("uses", np.int64), ("at", np.int64), ("count", np.int64), ("same", bool)], align=True)


def _longer(column: np.ndarray, used: int, size: int) -> np.ndarray:
    """A column whose used rows stay, with room for so many."""
    if size <= len(column):
        return column
    out = np.zeros(max(size, len(column) * 3 // 2), dtype=column.dtype)
    out[:used] = column[:used]
    return out


def _taken(table: list, ids) -> tuple:
    return itemgetter(*ids)(table) if len(ids) > 1 else tuple([table[i] for i in ids])


def _poly(s: str) -> int:
    out = 0
    for c in s:
        out = (out * int(_BASE) + ord(c) + 1) & (1 << 64) - 1
    return out


def words_of(text: str) -> list[str]:
    """Runs of spaces with what follows them; no piece holds a space after another character."""
    return _WORDS.findall(" " + text)


_WORDS, _REST = re.compile(r" +[^ ]*"), re.compile(rb" ( *[^ ]*)")


def split(texts: list[str]) -> tuple[pa.DictionaryArray, list[int]]:
    """words_of() many texts in UTF-8, without the first space of each, and where each text's end."""
    found, counts = [], []
    for plain, some in groupby([t.encode("utf-8", "surrogatepass") for t in texts], lambda t: t[:1] != b" " and b"  " not in t):
        lists = pc.split_pattern(pa.array(some, pa.binary()), b" ") if plain else pa.array([_REST.findall(b" " + t) for t in some], pa.list_(pa.binary()))
        found.append(lists.flatten())
        counts += pc.list_value_length(lists).to_pylist()
    return pa.concat_arrays(found).dictionary_encode(), np.cumsum(counts).tolist()


def encode(docs: DataFrame, path: str = MODEL, n: int = N_BEST, with_pieces: bool = True) -> DataFrame:
    """docs with n_pieces, piece_score, nbest_scores (best first), nbest_changes, pieces_sha256 (of the best's numbers,
    comma-joined), round_trip (whether decoding gave the text), and pieces array<int> unless with_pieces is false.

    nbest_changes tells for each of the n best (for the best: nothing) which segments, named by word and place, have other
    pieces than in the best; round_trip covers these too. Null and empty texts are the lone space before them (round_trip
    then compares with ''). Repeated rows give equal rows, and such that follow each other are encoded once. Texts of any
    length are walked word by word. A column of docs with one of these names is replaced; an empty table stays empty.
    """
    change = T.StructType([T.StructField("word", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("pieces", T.ArrayType(T.IntegerType()))])
    changes_kind = pa.list_(pa.list_(pa.struct([("word", pa.int32()), ("place", pa.int32()), ("pieces", pa.list_(pa.int32()))])))
    added = {
        "n_pieces": (T.LongType(), pa.int64()), "piece_score": (T.DoubleType(), pa.float64()), "nbest_scores": (T.ArrayType(T.DoubleType()), pa.list_(pa.float64())),
        "nbest_changes": (T.ArrayType(T.ArrayType(change)), changes_kind), "pieces_sha256": (T.StringType(), pa.string()), "round_trip": (T.BooleanType(), pa.bool_()),
    }
    if with_pieces:
        added["pieces"] = (T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))
    docs = docs.drop(*added)
    sent, name, at = docs.sparkSession.sparkContext.broadcast((load(path), n)), uuid.uuid4().hex, docs.columns.index("text")

    def one(lattice, rows):
        score, best, whole = lattice.variants(rows)
        told = [[{"word": k, "place": p, "pieces": new} for k, p, new in changes] for _, changes in best]
        row = int(lattice.known["count"][rows].sum()), score / lattice.scale, [s / lattice.scale for s, _ in best], told, lattice.digest_of(rows), whole
        return (*row, lattice.pieces(rows)) if with_pieces else row

    def encoded(batches):
        lattice = kept(name, lambda: Lattice(*sent.value))
        # Nothing here is cyclic: the collector would only walk through the remembered words again and again.
        collects = gc.isenabled()
        gc.disable()
        try:
            yield from coded(lattice, batches)
        finally:
            if collects:
                gc.enable()

    def coded(lattice, batches):
        for whole in batches:
            for a in range(0, max(whole.num_rows, 1), 1000):
                batch, rows = whole.slice(a, 1000), []
                texts = [text or "" for text in batch.column(at).to_pylist()]
                for b, c in slices([len(text) for text in texts], 2_000_000):
                    for i, primed in enumerate(lattice.prime(texts[b:c]), b):
                        rows.append(rows[-1] if i and texts[i] == texts[i - 1] else one(lattice, primed))
                columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), added.values(), strict=True)] if rows else [pa.array([], kind) for _, kind in added.values()]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])

    return widened(docs, encoded, [T.StructField(c, kind) for c, (kind, _) in added.items()])
