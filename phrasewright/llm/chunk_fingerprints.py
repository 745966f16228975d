"""Document fingerprints from content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text (the last 32 bytes decide its value). A
chunk ends where the hash is small: below the hard limit while the chunk is shorter than
the normal size, below the easy limit after it, which gathers sizes near the normal one;
chunks under the least size don't end and chunks of the most size do. Boundaries depend on
nearby bytes only, so an edit changes the chunks around it and no others. A fingerprint is
the set of chunk digests, each weighted by the bytes it covers.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, settle, slices, text_key

LEAST, NORMAL, MOST = 8, 32, 128
HARD, EASY = 1 << (32 - 7), 1 << (32 - 3)
GEAR = (mix64(np.arange(256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_GAP = 32
_BATCH = 1_000_000


def gear_hashes(parts: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """The rolling hash after each byte, and where each part begins; gaps keep parts apart."""
    gap = b"\0" * _GAP
    data = np.frombuffer(gap.join([b"", *parts, b""]), dtype=np.uint8)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    starts = np.cumsum(sizes + _GAP) - sizes
    h = GEAR[data]
    edges = np.concatenate([[0], np.stack([starts, starts + sizes], axis=1).reshape(-1), [len(data)]])
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        h[a:b] = 0
    width = 1
    while width < _GAP:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h, starts.tolist()


def boundaries(hard: list[int], easy: list[int], size: int) -> list[int]:
    """Chunk ends in a text of so many bytes; hard and easy: sorted ends that the limits allow, from its start."""
    ends, at, i, j = [], 0, 0, 0
    while at < size:
        end = min(at + MOST, size)
        i = bisect_left(hard, at + LEAST, i)
        if i < len(hard) and hard[i] <= min(at + NORMAL, end):
            end = hard[i]
        else:
            j = bisect_left(easy, at + NORMAL + 1, j)
            if j < len(easy) and easy[j] < end:
                end = easy[j]
        ends.append(end)
        at = end
    return ends


def fingerprints(texts: list[str]) -> list[dict[int, int]]:
    """Chunk digest -> bytes covered, for each text."""
    out: list[dict[int, int]] = []
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    digest = xxhash.xxh3_64_intdigest
    for a, b in slices([len(p) for p in parts], _BATCH):
        h, starts = gear_hashes(parts[a:b])
        easy = np.flatnonzero(h < EASY)
        hard = easy[h[easy] < HARD]
        for p, s in zip(parts[a:b], starts, strict=True):
            own = [(x[np.searchsorted(x, s) : np.searchsorted(x, s + len(p))] - s + 1).tolist() for x in (hard, easy)]
            weights: dict[int, int] = {}
            at = 0
            for end in boundaries(*own, len(p)):
                d = digest(p[at:end])
                weights[d] = weights.get(d, 0) + end - at
                at = end
            out.append(weights)
    return out


def named(weights: dict[int, int]) -> str:
    """A name for a fingerprint; equal for equal ones."""
    return hashlib.sha256(np.array(sorted(weights.items()), dtype=np.uint64).tobytes()).hexdigest()


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of a's bytes in chunks that b has as well (at most as often); of an empty a: 1 if b is empty too, else 0."""
    total = sum(a.values())
    if not total:
        return float(not b)
    return sum(min(w, b[d]) for d, w in a.items() if d in b) / total


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_chunks long"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
_NAMES = [x.split()[0] for x in COLUMNS.split(", ")]


def _results(ids, texts, following, own, after):
    """Result rows of documents given the next texts and the fingerprints of both."""
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following, strict=True)]
    changed = fingerprints(edited)
    rows = [
        (i, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), named(f), named(c), containment(f, c), containment(f, n), len(f))
        for i, t, e, f, c, n in zip(ids, texts, edited, own, changed, after, strict=True)
    ]
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)]


def _in_order(batches):
    """Rows of a partition in order -> results for all but the last row; the first and last row's text for the joints."""
    from pyspark import TaskContext

    part, held, first = TaskContext.get().partitionId(), None, True
    names = ["part", "end", "text", *_NAMES]
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
        for a, b in slices([len(t) for t in texts], _BATCH):
            prints = fingerprints(texts[a:b])
            chain = ([held] if held else []) + list(zip(ids[a:b], texts[a:b], prints, strict=True))
            if first and chain:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array(["first"]), pa.array([chain[0][1]]), pa.array([chain[0][0]], pa.int64()), *(pa.array([None], k) for k in _KINDS[1:])], names=names)
                first = False
            held, done = chain[-1], chain[:-1]
            if done:
                columns = _results([x[0] for x in done], [x[1] for x in done], [x[1] for x in chain[1:]], [x[2] for x in done], [x[2] for x in chain[1:]])
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(done), pa.int64()), pa.nulls(len(done), pa.string()), pa.nulls(len(done), pa.string()), *columns], names=names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array(["last"]), pa.array([held[1]]), pa.array([held[0]], pa.int64()), *(pa.array([None], k) for k in _KINDS[1:])], names=names)


def _joints(batches):
    for batch in batches:
        ids, texts, following = (batch.column(c).to_pylist() for c in ("doc_id", "text", "following"))
        yield pa.RecordBatch.from_arrays(_results(ids, texts, following, fingerprints(texts), fingerprints(following)), names=_NAMES)


def fingerprint_and_edit(docs: DataFrame) -> DataFrame:
    """One row per row of docs (COLUMNS): its fingerprint, and that of its text with the last half taken from the next document.

    The next document is the one with the next smaller doc_id; after the last comes the first. Null doc_ids come last; rows
    with equal doc_ids follow by a hash of their texts. Null texts are empty. One row alone is its own next.

    Rows are range-partitioned by doc_id and each partition walks its rows in order, so texts are shuffled once. Only the
    partitions' first and last rows meet afterwards (two rows per partition).
    """
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(text_key(), F.lit(0).cast("long")).alias("tkey"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tkey")]
    ranged = columns.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("doc_id").desc_nulls_last()).sortWithinPartitions(*order)
    walked = settle(ranged.mapInArrow(_in_order, "part long, end string, text string, " + COLUMNS), "walked")
    firsts = walked.where("end = 'first'").select("part", "text")
    lap = Window.orderBy("part")
    ahead = firsts.select("part", F.coalesce(F.lead("text").over(lap), F.first("text").over(lap)).alias("following"))
    joints = walked.where("end = 'last'").select("part", "doc_id", "text").join(ahead, "part").select("doc_id", "text", "following").mapInArrow(_joints, COLUMNS)
    return walked.where("end is null").select(*_NAMES).unionByName(joints)
