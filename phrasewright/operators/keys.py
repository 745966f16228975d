"""Dictionaries of any size that all tasks of a machine share: a trie in one file, mapped into memory.

Keys come sorted from Spark, a batch at a time, and become levels of a trie: level n has an
edge for each beginning of n + 1 characters, written as (number of the beginning before it,
character) in one integer. Sorted keys give sorted edges, so a step down the trie is a binary
search in a level, and a whole text takes it for all its places at once. Where a beginning is
a key, its record tells in which of several dictionaries (slots) it stands and what it is
worth there. The file is sent to each machine once, and mapped by its workers, so neither the
driver nor a task ever holds the dictionaries.
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys longer than this aren't taken: nothing in a scan looks that far. Characters that are made into edges at a time.
LONGEST, BATCH = 62, 1 << 20
_CODE = np.uint64(21)


class _Builder:
    """Writes the parts of a trie, piece by piece, to a folder."""

    def __init__(self, slots: tuple[str, ...], folder: str):
        self.slots, self.folder, self.sizes = slots, folder, [0] * LONGEST
        self.rows, self.last, self.open, self.astral = 0, "", {}, False
        self.at = dict.fromkeys(slots, 0)

    def put(self, name: str, array: np.ndarray) -> None:
        if name not in self.open:
            self.open[name] = (open(os.path.join(self.folder, name), "wb"), array.dtype.str)  # noqa: SIM115
        self.open[name][0].write(array.tobytes())

    def add(self, keys: list[str], values: dict[str, list]) -> None:
        """Keys in order of their code points, after all earlier ones, with their value in each slot (None: not there)."""
        step = max(1, BATCH // LONGEST)
        for a in range(0, len(keys), step):
            self._edges(keys[a : a + step])
        mask = np.zeros(len(keys), dtype=np.uint8)
        for bit, slot in enumerate(self.slots):
            held = values[slot]
            mask |= np.array([v is not None for v in held], dtype=np.uint8) << bit
            said = [(v or "").encode("utf-8", "surrogatepass") for v in held]
            ends = self.at[slot] + np.cumsum([len(v) for v in said], dtype=np.int64)
            self.put(f"ends.{slot}", ends)
            joined = np.frombuffer(b"".join(said), dtype=np.uint8)
            self.astral |= bool((joined >= 0xF0).any())
            self.put(f"text.{slot}", joined)
            self.at[slot] = int(ends[-1]) if len(ends) else self.at[slot]
        self.put("mask", mask)

    def _edges(self, keys: list[str]) -> None:
        sizes = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
        codes = np.zeros((len(keys) + 1, LONGEST), dtype=np.uint32)
        for row, key in enumerate([self.last, *keys]):
            codes[row, : len(key)] = _codes(key)
        # How many characters each key has in common with the one before it.
        common = np.logical_and.accumulate(codes[1:] == codes[:-1], axis=1).sum(axis=1)
        common = np.minimum(common, np.minimum(sizes, np.append(len(self.last), sizes[:-1])))
        parent = np.zeros(len(keys), dtype=np.int64)
        for level in range(int(sizes.max(initial=0))):
            new = (sizes > level) & (common <= level)
            number = self.sizes[level] - 1 + np.cumsum(new)
            self.put(f"edges.{level}", (parent[new].astype(np.uint64) << _CODE) | codes[1:][new, level].astype(np.uint64))
            self.put(f"record.{level}", np.where(sizes == level + 1, self.rows + np.arange(len(keys)), -1)[new])
            self.sizes[level] += int(new.sum())
            parent = number
        self.rows, self.last = self.rows + len(keys), keys[-1] if keys else self.last

    def finish(self) -> str:
        """One file of all parts: the length of its table of contents, the table, the parts."""
        parts, table, at = [], {}, 0
        for name, (file, kind) in self.open.items():
            file.close()
            size = os.path.getsize(os.path.join(self.folder, name))
            table[name] = (kind, at, size)
            parts.append(name)
            at += -(-size // 8) * 8
        head = json.dumps({"slots": self.slots, "astral": self.astral, "parts": table}).encode()
        head += b" " * (-len(head) % 8)
        path = os.path.join(self.folder, f"keys-{uuid.uuid4().hex}")
        with open(path, "wb") as out:
            out.write(len(head).to_bytes(8, "little") + head)
            for name in parts:
                with open(os.path.join(self.folder, name), "rb") as part:
                    while piece := part.read(1 << 20):
                        out.write(piece)
                out.write(b"\0" * (-table[name][2] % 8))
                os.remove(os.path.join(self.folder, name))
        return path


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Keys:
    """A trie file, mapped."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        size = int.from_bytes(raw[:8].tobytes(), "little")
        head = json.loads(raw[8 : 8 + size].tobytes())
        part = lambda name: np.asarray(raw[8 + size + head["parts"][name][1] :][: head["parts"][name][2]]).view(head["parts"][name][0]) if name in head["parts"] else None
        #: Whether a value holds a character of two UTF-16 units.
        self.slots, self.astral = tuple(head["slots"]), head["astral"]
        self.bit = {slot: 1 << i for i, slot in enumerate(self.slots)}
        self.levels = []
        while (edges := part(f"edges.{len(self.levels)}")) is not None:
            self.levels.append((edges, part(f"record.{len(self.levels)}")))
        none = np.zeros(0, dtype=np.uint8)
        self.mask = part("mask") if part("mask") is not None else none
        self.values = {slot: (part(f"ends.{slot}"), part(f"text.{slot}")) for slot in self.slots}
        # Bounded by the number of code points: most places of a text end here.
        self.first = np.full(0x110000, -1, dtype=np.int32)
        if self.levels:
            self.first[self.levels[0][0].astype(np.int64)] = np.arange(len(self.levels[0][0]))
        self.value = lru_cache(1 << 16)(self._value)
        self.record = lru_cache(1 << 16)(self._record)

    @classmethod
    def of(cls, **slots: dict[str, str]) -> Keys:
        """From dictionaries in memory."""
        with tempfile.TemporaryDirectory() as folder:
            builder = _Builder(tuple(slots), folder)
            words = sorted({k for d in slots.values() for k in d if k and len(k) <= LONGEST})
            builder.add(words, {s: [d.get(w) for w in words] for s, d in slots.items()})
            return cls(builder.finish())

    @staticmethod
    def characters(edges: np.ndarray) -> np.ndarray:
        """The code points of edges."""
        return (edges & np.uint64((1 << 21) - 1)).astype(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, record) of all keys in a text, the shortest first and then from left to right."""
        found = []
        node = self.first[codes]
        start = np.flatnonzero(node >= 0)
        node = node[start].astype(np.int64)
        for level, (edges, record) in enumerate(self.levels):
            if level:
                inside = start + level < len(codes)
                start, node = start[inside], node[inside]
                sought = (node.astype(np.uint64) << _CODE) | codes[start + level].astype(np.uint64)
                node = np.minimum(np.searchsorted(edges, sought), len(edges) - 1)
                alive = edges[node] == sought
                start, node = start[alive], node[alive]
            if not len(start):
                break
            key = record[node]
            held = key >= 0
            found.append((start[held], np.full(int(held.sum()), level + 1), key[held]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def _record(self, word: str) -> int:
        """The record of a word, -1 without one."""
        node = 0
        if not word or len(word) > len(self.levels):
            return -1
        for (edges, _), code in zip(self.levels, map(ord, word), strict=False):
            sought = np.uint64(node << 21 | code)
            node = int(np.searchsorted(edges, sought))
            if node >= len(edges) or edges[node] != sought:
                return -1
        return int(self.levels[len(word) - 1][1][node])

    def _value(self, slot: str, record: int) -> str:
        ends, text = self.values[slot]
        return text[ends[record - 1] if record else 0 : ends[record]].tobytes().decode("utf-8", "surrogatepass")

    def has(self, slot: str, word: str) -> bool:
        record = self.record(word)
        return record >= 0 and bool(self.mask[record] & self.bit[slot])

    def get(self, slot: str, word: str) -> str | None:
        record = self.record(word)
        return self.value(slot, record) if record >= 0 and self.mask[record] & self.bit[slot] else None


def written(tables: dict[str, DataFrame]) -> str:
    """The name of a file, known to all executors, of dictionaries (key, value) by slot, each with distinct keys.

    Spark merges and sorts the keys; the driver takes them from one partition after another and appends them to the file, so
    it holds one batch. The file then goes out with SparkContext.addFile: an executor that is lost or joins later fetches it
    again. Null and empty keys, null values and keys of more than LONGEST characters are left out.
    """
    slots = tuple(tables)
    every = None
    for slot, frame in tables.items():
        one = frame.where((F.length("key") > 0) & (F.length("key") <= LONGEST) & F.col("value").isNotNull())
        one = one.select("key", *(F.col("value").alias(s) if s == slot else F.lit(None).cast("string").alias(s) for s in slots))
        every = one if every is None else every.unionByName(one)
    merged = every.groupBy("key").agg(*(F.max(s).alias(s) for s in slots)).orderBy("key")
    context = every.sparkSession.sparkContext
    # The driver serves the file from here as long as it runs.
    folder = tempfile.mkdtemp(prefix="phrasewright-keys-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    builder, keys, values = _Builder(slots, folder), [], {s: [] for s in slots}
    for row in merged.toLocalIterator():
        keys.append(row.key)
        for s in slots:
            values[s].append(row[s])
        if len(keys) >= BATCH // LONGEST:
            builder.add(keys, values)
            keys, values = [], {s: [] for s in slots}
    builder.add(keys, values)
    path = builder.finish()
    context.addFile(path)
    return os.path.basename(path)


_MAPPED: dict[str, Keys] = {}


def mapped(name: str) -> Keys:
    """The file of a name, mapped once in a worker."""
    if name not in _MAPPED:
        _MAPPED[name] = Keys(SparkFiles.get(name))
    return _MAPPED[name]
