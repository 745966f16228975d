"""Translation of whole texts: the left-to-right scan over phrases, rules, numbers and readings.

Which dictionaries hold is settled with DataFrames (`lexicon`) and written to one file that
all tasks of a machine map (`keys`). A text is searched once for all keys; which phrase may be
taken at each place is then settled for all places together, and what depends on what was
taken before walks from one chosen piece to the next.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasewright.functions import normal, numbers
from phrasewright.operators import dictionaries as D
from phrasewright.operators import keys as K
from phrasewright.operators import rules as R

#: What ends a sentence for the word that follows; the reach of the overlap and name tests; the wider view of a rule.
ENDERS = ("\n", "\t", ". ", '"', "'", "? ", "! ", '." ', '?" ', '!" ', ": ")
INNER, WIDE = 20, 100
#: Words and chains of words that a task remembers, and the characters that a chain stands for at most.
_WORDS, _CHAIN = 1 << 16, 40
#: What stands for a line's state before a word: after a blank, after a blank that ends a sentence, after a line feed, at the start.
LAST = ("x ", ". ", "\n", "")
_ENDS = frozenset(e[-1] for e in ENDERS)
_MARK = re.compile(r"""[\t:("'.?!]|\n(?!\Z)""")
_SPECIAL = np.isin(np.arange(128), [ord(c) for c in "\"'.?!"])
SLOTS = ("phrases", "names", "raw", "nouns", "surnames", "suffixes")


@dataclass(frozen=True)
class Options:
    """wrap: [brackets] around words; algorithm 0, 1 or 2: the overlap test; names_first: phrases that hide a name are refused."""

    scan: int = 30
    algorithm: int = 1
    names_first: bool = True
    wrap: bool = False


@dataclass
class Lexicon:
    """name: of the dictionary file; readings: by character; rules: rows of rules.prepared()."""

    name: str = ""
    readings: dict = field(default_factory=dict)
    rules: list = field(default_factory=list)

    @classmethod
    def of(cls, readings: dict | None = None, rules: list | None = None, **slots: dict[str, str]) -> Ready:
        """From dictionaries in memory, ready on this machine."""
        return Ready(K.Keys.of(**{s: slots.get(s, {}) for s in SLOTS}), readings or {}, rules or [])

    def ready(self) -> Ready:
        """The same for all tasks of a worker, with the words that they learnt."""
        if not _READY or _READY[0] != self:
            _READY[:] = self, Ready(K.mapped(self.name), self.readings, self.rules)
        return _READY[1]


_READY: list = []


class _Words(dict):
    """What is said for the record of a phrase, a character's code point below zero, or a number's own text: (word, its UTF-16
    units, whether it is plain). Before and after a plain word nothing depends on its letters."""

    def __init__(self, keys: K.Keys, readings: dict, wrap: bool):
        self.keys, self.readings, self.wrap = keys, readings, wrap

    def __missing__(self, code: int | str) -> tuple[str, int, bool]:
        if len(self) >= _WORDS:
            self.clear()
        said = code if isinstance(code, str) else self.keys.value("phrases", code) if code >= 0 else self.readings[chr(~code)]
        said = f"[{said}]" if self.wrap else said
        out = self[code] = said, units(said), plain(said)
        return out


class Ready:
    """A lexicon as a task uses it."""

    def __init__(self, keys: K.Keys, readings: dict, rules: list):
        self.keys, self.readings, self.matcher = keys, readings, R.Rules(rules, keys)
        self.read = normal.table_of(readings)
        self.words = {wrap: _Words(keys, readings, wrap) for wrap in (False, True)}
        #: By options, and apart for scans without ranges.
        self.chains: dict[Options | tuple, _Chains] = {}
        #: By code point: whether a reading or a key holds the character. No key reaches over one that none holds.
        self.inked = self.read.copy()
        for edges, _ in keys.levels:
            for a in range(0, len(edges), K.BATCH):
                self.inked[keys.characters(edges[a : a + K.BATCH])] = True
        #: Whether a word ends after a blank, or after a line feed: no key reaches over either.
        self.feed = not self.inked[10]
        self.blank = self.feed and not self.inked[32]
        #: What may stand beside a blank in a number, by code point.
        self.numeral = normal.table_of("0123456789 \t" + numbers.NUMBER_CHARS)

    def ends(self, codes: np.ndarray) -> list[int]:
        """Where the words of a text end that isn't empty, with the blank or line feed after each, over which neither a key nor a
        number reaches."""
        over = (codes == 10) & self.feed
        if self.blank:
            beside = np.append(self.numeral[codes], False)
            over |= (codes == 32) & ~(beside[1:] & np.roll(beside, 1)[:-1])
        over[-1] = True
        return (np.flatnonzero(over) + 1).tolist()


class _Raw:
    """The keys that aren't numbers, for numbers.spans()."""

    def __init__(self, keys: K.Keys):
        self.keys = keys

    def __contains__(self, word: str) -> bool:
        return self.keys.has("raw", word)


def collected(tables: dict[str, DataFrame], readings: DataFrame, rules: DataFrame | None = None) -> Lexicon:
    """Dictionaries (key, value) by slot, written to a file; readings, at most one for each code point, and rules come to the driver."""
    read = {r.key: r.value for r in readings.where("key is not null and value is not null and char_length(key) = 1").select("key", "value").toLocalIterator()}
    return Lexicon(K.written(tables), read, [r.asDict() for r in R.prepared(rules).collect()] if rules is not None else [])


def lexicon(pairs: DataFrame, overrides: dict[str, DataFrame] | None = None, patches: dict[str, DataFrame] | None = None, one_meaning: bool = False) -> Lexicon:
    """From (dict, line_no, key, value) with dict vietphrase, names, names2, pronouns, surnames, suffixes, readings or rules.

    An override replaces a whole dictionary (an empty one empties it). Patches of vietphrase and readings go before the
    base's entries, though names still go before patched phrases. Dictionaries may have any number of keys.
    """
    source = lambda name: (overrides or {}).get(name, pairs.where(F.col("dict") == name))
    empty = pairs.limit(0)
    patch = lambda name: (patches or {}).get(name, empty)
    scanned = lambda name: D.scannable(source(name))
    line = lambda x: x.withColumn("line_no", F.lit(0))
    raw = D.overlaid(patch("vietphrase"), scanned("vietphrase"))
    names = D.overlaid(scanned("names2"), scanned("names"))
    phrases = D.overlaid(line(names), line(raw))
    tables = {
        "phrases": D.one_meaning(phrases) if one_meaning else phrases, "names": names, "raw": raw,
        "nouns": D.noun_values(source("pronouns"), line(names)), "surnames": D.first_wins(source("surnames")), "suffixes": D.first_wins(source("suffixes")),
    }
    return collected(tables, D.overlaid(patch("readings"), source("readings").where(F.length("key") == 1)), D.first_wins(source("rules")))


class _Line:
    """The text so far, the end of what was appended since the last word began, and its pieces: where each begins in the source (it
    ends where the next begins), and its range in the target. Without ranges pieces are only counted."""

    __slots__ = ("parts", "last", "size", "blank", "count", "ranges", "n", "first", "start", "length")

    def __init__(self, astral: bool, ranges: bool = True):
        self.parts, self.last, self.size, self.blank = [], "", 0, False
        # UTF-16 units are characters where no character takes two.
        self.count = units if astral else len
        self.ranges, self.n, self.first, self.start, self.length = ranges, 0, [], [], []

    def raw(self, text: str) -> None:
        self.parts.append(text)
        # Three characters tell a sentence's end.
        self.last = (self.last + text)[-3:]
        self.blank = text[-1:] == " "
        self.size += self.count(text)

    def word(self, text: str, own: int) -> None:
        """Appends a word of so many units."""
        last = self.last
        if last[-1:] in _ENDS and last.endswith(ENDERS):
            new = capital(text)
            own = own if new == text else units(new)
        elif last[-1:] in (" ", "("):
            new = text
        else:
            new = " " + text
            own += 1
        if self.blank and text[:1] in (",", ".", "?", "!", ""):
            self.parts[-1] = self.parts[-1][:-1]
            if not self.parts[-1]:
                self.parts.pop()
            self.size -= 1
            self.blank = bool(self.parts) and self.parts[-1][-1:] == " "
        if new:
            self.parts.append(new)
            self.blank = new[-1] == " "
        self.last = new[-3:]
        self.size += own

    def pair(self, first: int, start: int, length: int) -> None:
        """A piece of the target stands for the characters from the first on."""
        if self.ranges:
            self.first.append(first)
            self.start.append(start)
            self.length.append(length)
        else:
            self.n += 1

    def enter(self, state: int) -> None:
        """As after what LAST has for the state."""
        self.last, self.blank = LAST[state], state < 2

    def state(self) -> int | None:
        """The state after a blank or a line feed; None after anything else."""
        if self.last[-1:] == " ":
            return int(self.last.endswith(ENDERS)) if self.blank else None
        return 2 if self.last[-1:] == "\n" else None

    def run(self, text: str, a: int, b: int, base: int = 0) -> None:
        """Characters that stand for themselves."""
        own, at = text[a:b], self.size
        if not self.ranges:
            self.n += b - a
        else:
            self.first += range(base + a, base + b)
            if (total := self.count(own)) == b - a:
                self.start += range(at, at + total)
                self.length += [1] * total
            else:
                for c in own:
                    self.start.append(at)
                    self.length.append(units(c))
                    at += units(c)
        self.raw(own)

    def done(self, x: normal.Aligned) -> tuple[str, list, list]:
        """The text, the ranges of source and target; without ranges, two times (their number,)."""
        said = "".join(self.parts)
        if not self.ranges:
            return said, (self.n,), (self.n,)
        if not self.first:
            return said, [[], []], [[], []]
        first = np.array(self.first, dtype=np.int64)
        last = np.append(first[1:] - 1, len(x.start) - 1)
        start = x.start[first]
        return said, [start, (x.start + x.size)[last] - start], [np.array(self.start, dtype=np.int64), np.array(self.length, dtype=np.int64)]


def units(text: str) -> int:
    """UTF-16 units."""
    return len(text) if text.isascii() or max(text) <= "￿" else len(text) + sum(c > "￿" for c in text)


def plain(word: str) -> bool:
    """Whether a word takes no blank away before it, and no word begins a sentence after it and a blank."""
    return bool(word) and word[0] not in ",.?!" and word[-1] not in " .?!:\"'\n\t("


def capital(text: str) -> str:
    """The first letter in upper case, that after an opening bracket where there is one."""
    at = 1 if text[:1] == "[" and len(text) > 1 else 0
    return text[:at] + text[at : at + 1].upper() + text[at + 1 :]


class _Names:
    """Where names begin in a text."""

    def __init__(self, keys: K.Keys, size: int, found: tuple[np.ndarray, np.ndarray, np.ndarray]):
        start, length, record = found
        own = np.asarray(keys.mask)[record] & keys.bit["names"] > 0
        start, length = start[own], length[own]
        begins = np.zeros(size + 2, dtype=np.int64)
        begins[start[(length >= 2) & (length <= INNER)] + 1] = 1
        #: How many places before each have a name of two characters or more.
        self.before = np.cumsum(begins)
        self.all = set((start << 6 | length).tolist())

    def hidden(self, at: int, size: int) -> bool:
        """Whether a name of two characters or more begins inside a stretch, which is no name itself."""
        return size >= 2 and (at << 6 | size) not in self.all and bool(self.before[at + size] > self.before[at + 1])


class _Choice:
    """For all places of a text: the longest phrase that may be taken."""

    def __init__(self, keys: K.Keys, size: int, found: tuple[np.ndarray, np.ndarray, np.ndarray], options: Options):
        start, length, record = found
        mask = np.asarray(keys.mask)[record]
        is_name = mask & keys.bit["names"] > 0
        begins = _Names(keys, size, found).before
        phrase = mask & keys.bit["phrases"] > 0
        start, length, record, is_name = start[phrase], length[phrase], record[phrase], is_name[phrase]
        inside = (length >= 2) & ~is_name & (begins[start + length] > begins[start + 1])
        ok = length <= options.scan
        if options.names_first:
            ok &= ~inside
        if options.algorithm in (0, 2):
            longest = np.zeros(size + K.LONGEST, dtype=np.int64)
            reach = length <= INNER
            longest[start[reach]] = length[reach]
            floor = length if options.algorithm == 0 else np.maximum(length, 3)
            hides = np.zeros(len(start), dtype=bool)
            for d in range(1, int(length.max(initial=0))):
                hides |= (d < length) & (longest[start + d] > floor)
            ok &= ~hides | (is_name & options.names_first)
        #: By place the size and the record of the phrase, and a bit for the length of each phrase there, taken or not.
        self.sizes, self.records, self.lengths = (np.zeros(size, dtype=np.int64) for _ in range(3))
        # Keys come the shortest first, so the longest stays.
        self.sizes[start[ok]], self.records[start[ok]] = length[ok], record[ok]
        np.add.at(self.lengths, start, np.left_shift(1, length))


class _RuleTries:
    """When a rule may be tried: not again at a place that failed, nor before the match that is pending, nor inside a stretch
    that was found to hold none."""

    def __init__(self, text: str, codes: np.ndarray, lex: Ready, places: R.Places, reach: int):
        self.text, self.lex, self.places, self.reach = text, lex, places, reach
        # Rules are shut up to a place; up to the one of calm a try fails.
        self.shut, self.calm, self.free_to, self.pending, self.failed_at = -1, -1, -1, -1, -1
        #: Where the next string or noun of a rule, or person, begins, and the nearest end of one.
        self.first, self.near = -1, -1
        ends = np.where((codes == 10) | (codes == 9), np.arange(len(codes)), len(codes))
        #: Where the line of each place ends.
        self.line_end = np.minimum.accumulate(ends[::-1])[::-1]

    def open(self, at: int, size: int) -> bool:
        return self.failed_at != at and self.free_to < at + size - 1 and at >= self.pending

    def read(self, at: int) -> bool:
        return self.text[at : at + 1] in self.lex.readings

    def hides_name(self, at: int, size: int) -> bool:
        codes = normal.points(self.text[at : at + size + INNER])
        return _Names(self.lex.keys, len(codes), self.lex.keys.find(codes)).hidden(0, size)

    def at(self, at: int, size: int) -> tuple[int, str] | None:
        """(length, rendered) of a rule that applies at this place, seen through a window of this size."""
        if self.near > at + size or not (m := self.places.best(at, at + size)):
            return self.failed(at, size)
        self.pending = at + m.index
        if m.index or ("{n}" not in m.key and self.hides_name(at, m.length)):
            return None
        said = self.lex.matcher.render(self.text[at : at + m.length], m)
        return None if said is None else (m.length, said.strip())

    def failed(self, at: int, size: int) -> None:
        self.pending, self.free_to, self.failed_at = at - 1, at + size - 1, at
        text, end, size, readings = self.text, at + WIDE, len(self.text), self.lex.readings
        while end < size and text[end - 1] in readings:
            end += 1
        # Until a window shows something, tries that don't look wider or know what they would see fail, and leave no trace but that of
        # the last of them.
        if end > size:
            self.calm = self.near - self.reach - 1
        elif self.first >= end:
            self.free_to = end - 1
        elif (sure := self.places.sure(at, end)) >= 0:
            self.calm = min(sure, self.near - self.reach - 1)
        elif self.places.best(at, end) is None:
            self.free_to = end - 1

    def tried(self, at: int, phrases: int, least: int) -> tuple[int, str] | None:
        """A rule's match at this place that is tried before any phrase that may be taken, in windows of this many characters or
        more; phrases has a bit for the length of each phrase there."""
        hit, line, self.calm = None, int(self.line_end[at]), -1
        if at > self.first:
            self.first, self.near = self.places.ahead(at)
        for size in range(min(self.reach, line - at), least - 1, -1):
            # A smaller window isn't open either.
            if not self.open(at, size) or (not phrases >> size & 1 and (hit := self.at(at, size))):
                break
        # No window of a line is open within a stretch that reaches its end.
        self.shut = max(self.free_to - self.reach + 1, self.pending - 1, line if self.free_to >= line - 1 else -1)
        return hit

    def catch_up(self, at: int, i: int, ends: list[int], stretch) -> None:
        """Makes the last try before a place of word i, of those that calm let out. stretch(i): that of a word."""
        while True:
            base, s = ends[i - 1] if i else 0, stretch(i)
            for p in reversed([p for p in s.places() if base + p < at]):
                if base + p <= self.failed_at or at - base - p >= self.reach:
                    return
                self.tried(base + p, s.lengths[p], s.least[p])
                if self.failed_at == base + p:
                    return
            if base <= self.failed_at:
                return
            i -= 1


class _Stretch:
    """What is said at each place of a text, and for how many characters, where no rule applies."""

    __slots__ = ("text", "found", "raw", "least", "lengths", "read", "step", "code")

    def __init__(self, source: str, lex: Ready, options: Options):
        found = numbers.spans(source, _Raw(lex.keys))
        self.text = swapped(source)
        codes, size = normal.points(self.text), len(source)
        self.found = codes, lex.keys.find(codes)
        choice = _Choice(lex.keys, size, self.found[1], options)
        read = lex.read[codes]
        spoken = read & (choice.sizes == 0)
        step, code = np.where(spoken, 1, choice.sizes), np.where(spoken, ~codes.astype(np.int64), choice.records)
        special = (step > 0) | _SPECIAL[np.minimum(codes, 127)]
        special[list(found)] = True
        #: Whether a character stands for itself, whatever is beside it.
        self.raw = (~special).tolist()
        #: The least size of a rule's window that goes before what is said.
        least = np.maximum(choice.sizes + 1, 3)
        for at, (length, _) in found.items():
            least[at] = max(least[at], length)
        self.least, self.lengths, self.read, self.step, self.code = least.tolist(), choice.lengths.tolist(), read.tolist(), step.tolist(), code.tolist()
        for at, (length, number) in found.items():
            if choice.sizes[at] < length:
                said = numbers.phrase(number)
                self.step[at], self.code[at] = (length, said) if said is not None else (1, ~int(codes[at])) if read[at] else (0, 0)

    def part(self, a: int, b: int) -> _Stretch:
        """The stretch from one place to another, over both of which nothing reaches."""
        out = object.__new__(_Stretch)
        out.text, out.raw, out.least, out.lengths, out.read, out.step, out.code = self.text[a:b], self.raw[a:b], self.least[a:b], self.lengths[a:b], self.read[a:b], self.step[a:b], self.code[a:b]
        return out

    def places(self) -> Iterator[int]:
        """Where its pieces begin."""
        at = 0
        while at < len(self.step):
            yield at
            at += self.step[at] or 1


class _Walk:
    """From one chosen piece to the next."""

    def __init__(self, line: _Line, words: _Words, rules: _RuleTries | None = None):
        self.line, self.words, self.rules = line, words, rules

    def go(self, s: _Stretch, at: int = 0, base: int = 0, mark: int = -1, hit: tuple[int, str] | None = None) -> int:
        """From a place of the text, in a stretch that begins at base, to the end of the stretch, or beyond where a rule's match ends
        there. hit: what a rule says at the mark, before which none is tried."""
        line, words, rules, size = self.line, self.words, self.rules, len(s.text)
        while (p := at - base) < size:
            now, stop = None, size
            if at == mark:
                now = hit
            elif at < mark:
                stop = mark - base
            elif rules is not None:
                if at > rules.shut:
                    now = rules.tried(at, s.lengths[p], s.least[p])
                stop = min(stop, rules.shut + 1 - base)
            length = s.step[p]
            if now or length:
                key = s.code[p]
                if now:
                    length, said = now
                    said, late = f"[{said}]" if words.wrap else said, True
                    own, more = units(said), rules.read(at + length)
                else:
                    (said, own, _), late = words[key], isinstance(key, str) or key >= 0
                    more = p + length < size and s.read[p + length]
                begin = line.size
                line.word(said, own)
                # The target of a reading begins before the blank that parts it from what stands before.
                line.pair(at, max(0, line.size - own) if late else begin, own)
                at += length
                if more:
                    line.raw(" ")
            elif s.raw[p]:
                end = p + 1
                while end < stop and s.raw[end]:
                    end += 1
                line.run(s.text, p, end, base)
                at = base + end
            else:
                _single(s.text, p, line, base)
                at += 1
        return at


class _Chains(dict):
    """What is said for a word with the blank or line feed after it, over which nothing reaches: by the line's state before it
    the text, how many pieces it has, the state after it, its units, where its pieces begin in the target, and their units (false if
    not looked for yet, None where a blank before it is taken away or the word is too long to be remembered); then the stretch that
    holds the word, from where to where, its events for rules if it has any but strings that number rules need, and the latter."""

    def __init__(self, lex: Ready, options: Options, ranges: bool):
        self.lex, self.options, self.ranges, self.words = lex, options, ranges, lex.words[options.wrap]

    def learn(self, words: set[str]) -> dict[str, tuple]:
        """Adds words that aren't known. Returns those that are too long to be remembered."""
        # A line feed parts them, over which nothing reaches; where it doesn't, a text is one word, and they come one by one.
        words, out, at = list(words), {}, 0
        whole = _Stretch("\n".join(words), self.lex, self.options)
        held = self._events(whole, words) if self.lex.matcher else {}
        for i, w in enumerate(words):
            end = at + len(w)
            events = held.get(i)
            own = whole, at, end, events if events and (events.spans or events.people) else None, events.numbers if events else ()
            if len(w) > _CHAIN:
                out[w] = None, None, None, None, *own
            else:
                after = (None if self.ranges else self.simply(w, whole, at, end)) or self.said(whole.part(at, end), 0)
                self[w] = (after, after, after, False, *own) if whole.raw[at] else (after, False, False, False, *own)
            at = end + 1
        return out

    def enter(self, word: str, state: int) -> tuple:
        """What is known of a word, with what is said in a state."""
        known = self[word]
        if known[state] is False:
            self[word] = known = *known[:state], self.said(known[4].part(*known[5:7]), state), *known[state + 1 :]
        return known

    def _events(self, whole: _Stretch, words: list[str]) -> dict[int, R.Events]:
        """By number of a word, its events, from its beginning on."""
        ends = list(accumulate(len(w) + 1 for w in words))
        out: dict[int, R.Events] = {}
        spans, people, fitting = self.lex.matcher.events(*whole.found)

        def own(at):
            i = bisect_right(ends, at)
            return out.setdefault(i, R.Events([], {}, [])), ends[i - 1] if i else 0

        for a, b, of in spans:
            x, base = own(a)
            x.spans.append((a - base, b - base, of))
        for a, sizes in people.items():
            x, base = own(a)
            x.people[a - base] = sizes
        for a, of in fitting:
            x, base = own(a)
            x.numbers.append((a - base, of))
        return out

    def simply(self, word: str, s: _Stretch, p: int, size: int) -> tuple | None:
        """As said() of a word from place p of a stretch on, after a blank and without ranges, if there are only plain words and
        characters that aren't marks."""
        if _MARK.search(word):
            return None
        out, n, step, code, raw, words, blank = [], 0, s.step, s.code, s.raw, self.words, True
        while p < size:
            if length := step[p]:
                said, _, simple = words[code[p]]
                if not simple:
                    return None
                out.append(said if blank else " " + said)
                blank = False
                n += 1
                p += length
            elif raw[p]:
                end = p + 1
                while end < size and raw[end]:
                    end += 1
                out.append(s.text[p:end])
                blank = s.text[end - 1] == " "
                n += end - p
                p = end
            else:
                return None
        return "".join(out), n, 0 if word[-1] == " " else 2 if word[-1] == "\n" else None

    def said(self, s: _Stretch, state: int) -> tuple | None:
        line = _Line(True, self.ranges)
        line.enter(state)
        line.parts = [line.last]
        _Walk(line, self.words).go(s)
        if line.parts[0] != LAST[state]:
            return None
        said = "".join(line.parts[1:])
        return (said, len(line.first), line.state(), line.size, line.start, line.length) if self.ranges else (said, line.n, line.state())


def scan(x: normal.Aligned, lex: Ready, options: Options, ranges: bool = True) -> tuple[str, list, list]:
    """The translation of a normalised text, and the ranges of source and target that belong together, as starts and lengths;
    with ranges false, the number of these in place of both."""
    return next(scan_all([x], lex, options, ranges))


def scan_all(texts: list[normal.Aligned], lex: Ready, options: Options, ranges: bool = True) -> Iterator[tuple[str, list, list]]:
    """scan() of each of some texts, whose new words are learnt together."""
    chains = lex.chains.setdefault(options if ranges else (options, ranges), _Chains(lex, options, ranges))
    if len(chains) > _WORDS:
        chains.clear()
    codes = [normal.points(x.text) for x in texts]
    ends = [lex.ends(c) if len(c) else [] for c in codes]
    words = [[x.text[a:b] for a, b in zip([0, *own], own, strict=False)] for x, own in zip(texts, ends, strict=True)]
    known = [list(map(chains.get, own)) for own in words]
    new = {w for own, found in zip(words, known, strict=True) if None in found for w, k in zip(own, found, strict=True) if k is None}
    long = {}
    for some in [new] if lex.feed else [{w} for w in new]:
        long |= chains.learn(some) if some else {}
    for i, x in enumerate(texts):
        if not x.text:
            yield _Line(True, ranges).done(x)
            continue
        found = [k or chains.get(w) or long[w] for w, k in zip(words[i], known[i], strict=True)] if None in known[i] else known[i]
        yield _scan(x, codes[i], ends[i], found, chains)


def _scan(x: normal.Aligned, codes: np.ndarray, ends: list[int], known: list[tuple], chains: _Chains) -> tuple[str, list, list]:
    """From what is known of a text's words, and with rules tried at their pieces where they may be; a word that is long, or in which a
    rule applies, is walked piece by piece."""
    lex, options, ranges = chains.lex, chains.options, chains.ranges
    line, text, rules = _Line(True, ranges), swapped(x.text), None
    if lex.matcher:
        codes, events = codes if text is x.text else normal.points(text), R.Events([], {}, [])
        for i in [i for i, word in enumerate(known) if word[7]]:
            base, own = ends[i - 1] if i else 0, known[i][7]
            events.spans.extend((base + a, base + b, of) for a, b, of in own.spans)
            events.people.update((base + a, sizes) for a, sizes in own.people.items())
        events.numbers.extend(x for word in known for x in word[8])
        if places := R.Places(lex.matcher, text, codes, events):
            rules = _RuleTries(text, codes, lex, places, options.scan)
    stretch = lambda i: known[i][4].part(*known[i][5:7])
    walk, size, parts, total, n, state, i, at = _Walk(line, chains.words, rules), len(text), line.parts, 0, 0, 3, 0, 0
    first, starts, lengths = line.first, line.start, line.length
    # Rules needn't be tried up to here; quiet: though they might be.
    shut, quiet = -1 if rules else size, False
    while at < size:
        # Whole words without a try.
        while at < size and (end := ends[i]) <= shut + 1 and (said := known[i][state]):
            parts.append(said[0])
            state = said[2]
            if ranges:
                first += [at + p for p in stretch(i).places()]
                starts += [total + p for p in said[4]]
                lengths += said[5]
                total += said[3]
            else:
                n += said[1]
            at = end
            i += 1
        if at >= size:
            break
        word, end, mark, hit = known[i], ends[i], -1, None
        if word[state] is False:
            known[i] = chains.enter(x.text[at:end], state)
            continue
        if word[state] and end > shut + 1:
            s = stretch(i)
            for p in s.places():
                if at + p > shut:
                    if quiet:
                        rules.catch_up(at + p, i, ends, stretch)
                    hit, shut = rules.tried(at + p, s.lengths[p], s.least[p]), max(rules.shut, rules.calm)
                    quiet = shut > rules.shut
                    if hit or end <= shut + 1:
                        mark = at + p
                        break
            if not hit:
                shut = max(shut, end - 1)
                continue
        if quiet:
            rules.catch_up(at, i, ends, stretch)
        line.enter(state)
        line.size, quiet = total, False
        while True:
            at = walk.go(stretch(i), at, ends[i - 1] if i else 0, mark, hit)
            i, state = bisect_right(ends, at), line.state()
            # Until a word begins in a state that is known.
            if at >= size or (state is not None and at == ends[i - 1]):
                break
        total = line.size
        shut = rules.shut if rules else size
    line.n += n
    return line.done(x)


def swapped(text: str) -> str:
    """余 and 多 after the unit that follows them."""
    return re.sub("([余多])([百千万亿])", r"\2\1", text) if "余" in text or "多" in text else text


def _single(text: str, at: int, line: _Line, base: int = 0) -> None:
    """A character without a reading: a quote with a space before it, or as it is. Its target begins before the space."""
    c, after, start = text[at], text[at + 1 : at + 2], line.size
    if c in "\"'" and not line.last.endswith((" ", ".", "?", "!", "\t")) and after not in ("", " ", ","):
        line.raw(" " + c)
    else:
        decimal = c == "." and at > 0 and "0" <= text[at - 1] <= "9" and "0" <= after <= "9"
        line.raw(c + " " if c in ".?!" and after not in ("", " ", '"', "'") and not decimal else c)
    line.pair(base + at, start, units(c))


def read_aloud(x: normal.Aligned, readings: dict) -> tuple[str, list, list]:
    """Readings only: every known character by its reading, a space between words; all options are ignored."""
    line, text = _Line(True), x.text
    for at, c in enumerate(text):
        start = line.size
        if c in readings:
            said = readings[c]
            line.word(said, units(said))
            if text[at + 1 : at + 2] in readings:
                line.raw(" ")
        else:
            said = "" if c == "　" else c
            line.raw(said)
        line.pair(at, start, units(said))
    return line.done(x)


_RESULT, _RANGES = "doc_id long, translated string, n_spans long", f", source_ranges array<{normal.RANGE}>, target_ranges array<{normal.RANGE}>"


def _listed(rows: list) -> pa.Array:
    """[starts, lengths] of each row as lists of ranges."""
    ends = np.append(0, np.cumsum([len(s) for s, _ in rows])).astype(np.int32)
    flat = [pa.array(np.concatenate([np.zeros(0, np.int32), *(np.asarray(r[i], dtype=np.int32) for r in rows)])) for i in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(flat, ["start", "length"]))


def spread(texts: DataFrame) -> DataFrame:
    """Texts for work that costs far more than moving them: dealt out anew if they lie in fewer partitions than there are cores."""
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(4 * cores) if texts.rdd.getNumPartitions() < cores else texts


def translated(texts: DataFrame, lex: Lexicon, options: Options = Options(), mode: str = "phrases", normalise: bool = False, simplify: tuple[str, str] = ("", ""), ignored=(), ranges: bool = True) -> DataFrame:
    """(doc_id, translated, n_spans, source_ranges, target_ranges) of each text; mode "readings" takes only readings.

    n_spans counts the ranges, which are left out with ranges false. With normalise, texts are normalised first, and source ranges still point into the given text.
    Null texts are empty and give nothing. Texts that lie in too few partitions are dealt out anew; else no row is shuffled.
    """
    session = texts.sparkSession
    texts = spread(texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    names = ["doc_id", "translated", "n_spans", *(["source_ranges", "target_ranges"] if ranges else [])]
    # Readings are always told with their ranges.
    counted = not ranges and mode != "readings"
    sent = session.sparkContext.broadcast((lex, options, normal.tables(simplify, lex.readings, ignored)))

    def walked(batches):
        own, options, known = sent.value
        ready = own.ready()
        for whole in batches:
            for a in range(0, max(whole.num_rows, 1), 64):
                batch = whole.slice(a, 64)
                xs = [normal.standardize(text or "", *known, ranges=not counted) if normalise else normal.Aligned(text or "") for text in batch.column("text").to_pylist()]
                rows = [read_aloud(x, ready.readings) for x in xs] if mode == "readings" else list(scan_all(xs, ready, options, ranges))
                counts = pa.array([r[1][0] if counted else len(r[1][0]) for r in rows], pa.int64())
                listed = () if not ranges else [_listed([r[i] for r in rows]) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.string()), counts, *listed], names=names)

    return texts.mapInArrow(walked, _RESULT + (_RANGES if ranges else ""))
