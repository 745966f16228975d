"""Near-duplicate detection by DartMinHash over five-word shingles, banded joins and components.

A document is the multiset of its word 5-shingles (a text of one to four words is one
shingle); its weights are the multiplicities. Darts fall on the plane (weight, rank) of
every shingle as a Poisson process that depends on the shingle alone. The darts below a
document's weights, up to a rank that admits about ``K ln K + 2 K`` of them, are dealt
to K coordinates, and the dart of smallest rank represents its coordinate. Two documents
agree on a coordinate with the probability of their weighted Jaccard similarity.

Weights are whole numbers, so the regions of the plane are unit cells with a Poisson(1)
number of darts each.
"""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, mix64, observed, released, settle, sized_broadcast, slices, text_key

BANDS, ROWS, SHINGLE, SIMILARITY = 16, 4, 5, 0.8
K = BANDS * ROWS
DARTS = K * log(K) + 2 * K
#: Of the K coordinates, in four bits each, so many agree in all but two in a million pairs of similarity 0.8.
AGREEING = 36
#: Shingles of the documents that a block of comparisons holds, about.
BLOCK = 200_000
#: A shingle in so many documents of a comparison, or fewer, is rare; one in more than HOT is hot.
RARE, HOT = 8, 1000
#: Parts into which common shingles are counted.
PARTS = 64
#: Cumulative Poisson(1) probabilities; beyond the last the chance is below 1e-12.
_CDF = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, n + 1, dtype=float)) for n in range(15)])
_CELLS = 400_000


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def shingles(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles of each document and the document of each; words and starts as flat arrays."""
    counts = np.diff(starts)
    made = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), made)
    first = starts[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(made) - made, made)
    width = np.minimum(counts, SHINGLE)[doc]
    h = mix64(width.astype(np.uint64))
    for j in range(SHINGLE):
        at = np.minimum(first + j, max(len(words) - 1, 0))
        h = np.where(j < width, mix64(h ^ words[at]), h)
    return h, doc


def weighted(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with its multiplicity, ordered by document and shingle."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], doc[at], np.diff(np.append(at, len(h)))


def _throw(h, doc, weight, reach, n_docs):
    """Smallest-rank dart of each (document, coordinate) among ranks below reach; unfilled ones stay at infinity."""
    rank_cells = np.ceil(reach[doc]).astype(np.int64)
    cells = weight * rank_cells
    best_rank = np.full(n_docs * K, np.inf)
    best_dart = np.zeros(n_docs * K, dtype=np.uint64)
    for a, b in slices(cells.tolist(), _CELLS):
        n = cells[a:b]
        owner = np.repeat(np.arange(a, b), n)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        column, row = np.divmod(nth, rank_cells[owner])
        cell = mix64(h[owner] ^ mix64((column.astype(np.uint64) << np.uint64(32)) | row.astype(np.uint64)))
        thrown = np.searchsorted(_CDF, _unit(mix64(cell ^ np.uint64(1))), side="right")
        of = np.repeat(np.arange(len(owner)), thrown)
        if not len(of):
            continue
        j = np.arange(len(of)) - np.repeat(np.cumsum(thrown) - thrown, thrown)
        dart = mix64(cell[of] + (j.astype(np.uint64) + np.uint64(2)) * np.uint64(0xD1342543DE82EF95))
        rank = row[of] + _unit(dart)
        d = doc[owner[of]]
        inside = rank < reach[d]
        dart, rank, d = mix64(dart[inside]), rank[inside], d[inside]
        slot = d * K + (dart % np.uint64(K)).astype(np.int64)
        order = np.lexsort((dart, rank, slot))
        slot, rank, dart = slot[order], rank[order], dart[order]
        lead = np.ones(len(slot), dtype=bool)
        lead[1:] = slot[1:] != slot[:-1]
        slot, rank, dart = slot[lead], rank[lead], dart[lead]
        better = (rank < best_rank[slot]) | ((rank == best_rank[slot]) & (dart < best_dart[slot]))
        best_rank[slot[better]], best_dart[slot[better]] = rank[better], dart[better]
    return best_rank.reshape(n_docs, K), best_dart.reshape(n_docs, K)


def sketch(h, doc, weight, n_docs: int) -> np.ndarray:
    """K dart hashes per document. Coordinates that got no dart make the document's reach double until all have one."""
    out = np.zeros((n_docs, K), dtype=np.uint64)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    reach = np.where(total > 0, DARTS / np.maximum(total, 1), 0)
    open_ = np.flatnonzero(total > 0)
    while len(open_):
        local = np.full(n_docs, -1)
        local[open_] = np.arange(len(open_))
        use = local[doc] >= 0
        rank, dart = _throw(h[use], local[doc[use]], weight[use], reach[open_], len(open_))
        full = np.isfinite(rank).all(axis=1)
        out[open_[full]] = dart[full]
        open_ = open_[~full]
        reach[open_] *= 2
    return out


def _word_hashes(df: DataFrame) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")
    return df.withColumn("words", F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>")))


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    starts = np.asarray(column.offsets)
    return np.asarray(column.values)[starts[0] : starts[-1]].view(np.uint64), (starts - starts[0]).astype(np.int64)


def _sketched(batches):
    for batch in batches:
        words, starts = _flat(batch.column("words"))
        for a, b in slices(np.diff(starts).tolist(), _CELLS):
            at = starts[a : b + 1] - starts[a]
            own = words[starts[a] : starts[b]]
            n, counts = b - a, np.diff(at)
            h, doc = shingles(own, at)
            bands = np.zeros((n, BANDS), dtype=np.uint64)
            short = np.zeros((n, K // 16), dtype=np.uint64)
            if len(h):
                darts = sketch(*weighted(h, doc), n).reshape(n, BANDS, ROWS)
                nibbles = (mix64(darts.reshape(n, K // 16, 16)) & np.uint64(15)) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
                short = np.bitwise_or.reduce(nibbles, axis=2)
                bands[:] = np.arange(BANDS, dtype=np.uint64)
                for r in range(ROWS):
                    bands = mix64(bands ^ darts[:, :, r])
            key = np.zeros((2, n), dtype=np.uint64)
            if len(own):
                place = np.arange(len(own), dtype=np.uint64) - np.repeat(at[:-1], counts).astype(np.uint64)
                for side in range(2):
                    each = np.append(np.uint64(0), mix64(own ^ mix64(place * np.uint64(2) + np.uint64(side))))
                    with np.errstate(over="ignore"):
                        summed = np.cumsum(each)
                        key[side] = mix64(summed[at[1:]] - summed[at[:-1]] + counts.astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(a, n), batch.column("tkey").slice(a, n), pa.array(counts),
                    pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64)),
                    pa.ListArray.from_arrays(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32), pa.array(bands.reshape(-1).view(np.int64))),
                    pa.ListArray.from_arrays(np.arange(0, n * K // 16 + 1, K // 16, dtype=np.int32), pa.array(short.reshape(-1).view(np.int64))),
                ],
                names=["doc_id", "tkey", "n_words", "k1", "k2", "bands", "short"],
            )


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, n_words, k1, k2, bands, short) of each row; k1 and k2 are equal for equal word sequences, short holds
    four bits of each coordinate."""
    df = _word_hashes(docs.select(F.col("doc_id").cast("long"), F.col("text"))).select("doc_id", F.coalesce(text_key(), F.lit(0).cast("long")).alias("tkey"), "words")
    return df.mapInArrow(released(_sketched), "doc_id long, tkey long, n_words long, k1 long, k2 long, bands array<long>, short array<long>")


def _shingle_sets(batches):
    for batch in batches:
        words, starts = _flat(batch.column("words"))
        for a, b in slices(np.diff(starts).tolist(), _CELLS):
            n = b - a
            h, doc, weight = weighted(*shingles(words[starts[a] : starts[b]], starts[a : b + 1] - starts[a]))
            nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
            elements = mix64(np.repeat(h, weight) + nth.astype(np.uint64))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(doc, weight), minlength=n))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, n), pa.ListArray.from_arrays(offsets, pa.array(elements.view(np.int64)))], names=["node", "h"])


def jaccard(one: frozenset, other: frozenset) -> float:
    """Of two sets; 0 if both are empty. Where the n-th repeat of a shingle is its own element, the weighted similarity."""
    shared = len(one & other)
    total = len(one) + len(other) - shared
    return shared / total if total else 0.0


def _compared(batches):
    """Rows sorted by block, in each block first its sets and then its pairs."""
    block, sets = None, {}
    for batch in batches:
        elements, ends = np.asarray(batch.column("h").values), np.asarray(batch.column("h").offsets)
        firsts, seconds, scores = [], [], []
        for i, (of, pair, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "pair", "a", "b")), strict=True)):
            if of != block:
                block, sets = of, {}
            if pair:
                firsts.append(a)
                seconds.append(b)
                scores.append(jaccard(sets[a], sets[b]))
            else:
                sets[a] = frozenset(elements[ends[i] : ends[i + 1]].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64()), pa.array(scores, pa.float64())], names=["a", "b", "similarity"])


def _similarities(pairs: DataFrame, sets: DataFrame, blocks: int) -> DataFrame:
    """Similarity of each pair (a, b). The nodes are dealt to blocks, and a set goes once to each two blocks that have a pair
    with it, however many pairs there are."""
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    pairs = settle(pairs.select((F.least(own("a"), own("b")) * blocks + F.greatest(own("a"), own("b"))).alias("block"), F.lit(True).alias("pair"), "a", "b", F.array().cast("array<long>").alias("h")), "pairs")
    wanted = pairs.select("block", F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = wanted.join(sets, "node").select("block", F.lit(False).alias("pair"), F.col("node").alias("a"), F.col("node").alias("b"), "h").unionByName(pairs)
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "block").sortWithinPartitions("block", "pair").mapInArrow(released(_compared), "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of the undirected edges (a, b): the smallest node each can reach. Every round takes the
    neighbours' smallest label and then the label of that label, so chains shorten by halves."""
    both = settle(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label")), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        step = step.join(jump, "mid", "left").select("node", "was", F.least("mid", F.coalesce("far", "mid")).alias("label"))
        step, seen = observed(step, "labels", changed=F.count_if(F.col("label") != F.col("was")))
        labels = step.select("node", "label")
        if not seen["changed"]:
            return labels


def _hubs(spread: DataFrame) -> DataFrame:
    """The member of each bucket of (bucket, b, crowd, label) that shares its buckets with most others, and its label."""
    first = F.min(F.struct((-F.col("crowd")).alias("h"), "b", "label"))
    return spread.groupBy("bucket").agg(first.alias("x")).select("bucket", F.col("x.b").alias("hub"), F.col("x.label").alias("hub_label"))


def _agreeing(one: str, other: str):
    """In how many of the K coordinates two short sketches agree."""
    total = F.lit(K)
    for i in range(K // 16):
        x = F.col(one)[i].bitwiseXOR(F.col(other)[i])
        for by in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        total = total - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def _rare(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, h, n) for the shingles that n <= RARE of the nodes hold."""
    elements = sets.join(nodes, "node").select("node", F.explode("h").alias("h"))
    counts = settle(elements.groupBy("h").agg(F.count("*").alias("n")), "counts")
    hot = sized_broadcast(counts.where(F.col("n") > HOT).select("h"))
    return settle(elements.join(hot, "h", "left_anti").join(counts.where(F.col("n") <= RARE), "h").select("node", "h", "n"), "rare")


def _sharing_rare(rare: DataFrame, of_node: DataFrame, similarity: float) -> DataFrame:
    """Pairs (b, o) of different classes that share a rare shingle among their rarest ones. Sets whose similarity reaches s
    share s of each, so the rarest that they share is among the rarest total - s * total + 1 of both."""
    rank = F.row_number().over(Window.partitionBy("node").orderBy("n", "h"))
    first = rare.withColumn("rank", rank).where("n > 1").join(of_node, "node")
    first = first.where(F.col("rank") <= F.col("total") - F.ceil(F.col("total") * similarity - 1e-9) + 1)
    first = settle(first.select("h", F.col("node").alias("b"), "label"), "rarest")
    other = first.select("h", F.col("b").alias("o"), F.col("label").alias("own"))
    return first.join(other, "h").where("b < o and label <> own").select("b", "o").distinct()


def _histograms(batches):
    """Of the elements of each node (node, h): their number and how many fall in each of PARTS parts."""
    for batch in batches:
        n, column = batch.num_rows, batch.column("h")
        ends = np.asarray(column.offsets).astype(np.int64)
        elements, owner = np.asarray(column.values)[ends[0] : ends[-1]].view(np.uint64), np.repeat(np.arange(n), np.diff(ends))
        parts = np.bincount(owner * PARTS + (elements % np.uint64(PARTS)).astype(np.int64), minlength=n * PARTS).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(np.diff(ends)), pa.ListArray.from_arrays(np.arange(0, n * PARTS + 1, PARTS, dtype=np.int32), pa.array(parts))], names=["node", "common", "parts"])


def _in_reach(spread: DataFrame, asked: DataFrame, hubs: DataFrame, scored: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (b, o) of different classes that may be links, as of what is known without comparing them.

    Either they share a rare shingle, or what they share is no more than the shingles of either that aren't rare: most
    members of a large group of near copies have too many edits of their own for a link without a shared one, and the rest
    meet within their buckets. There the distance 1 - similarity obeys the triangle inequality, so the distances to the
    bucket's hub differ by 1 - similarity at most, and shingle totals by that factor. Distances and totals are cut into
    steps, and only neighbouring steps meet. Pairs whose sketches agree too little for a link go before they are written, and
    so do those that can't share enough: of the common shingles in each of PARTS parts, no more than the smaller number. A
    pair is named once, in the first of the buckets in which it meets. What is known of a node is written before it goes to
    its buckets, and the pairs that met before those that share a rare shingle: a plan of all these joins would begin its
    shuffles at once and keep their tables in the driver together.
    """
    reach = 1 - similarity
    step, ratio = max(reach, 0.01), max(1 / similarity, 1.01) if similarity > 0 else 1e9
    inside = settle(spread.join(asked.select("bucket").distinct(), "bucket").select("bucket", "b", "label", "total"), "inside")
    of_node = settle(inside.select(F.col("b").alias("node"), "label", "total").distinct(), "inside-nodes")
    rare = _rare(of_node.select("node"), sets)
    held = of_node.join(sets, "node").join(rare.groupBy("node").agg(F.collect_list("h").alias("rare")), "node", "left")
    held = held.select("node", F.array_except("h", F.coalesce("rare", F.array().cast("array<long>"))).alias("h"), "total").where(F.size("h") >= F.col("total") * similarity - 1e-9)
    asked_in = asked.groupBy(F.col("o").alias("node")).agg(F.collect_list("bucket").alias("asked"))
    owned = held.select("node", "h").mapInArrow(released(_histograms), "node long, common long, parts array<int>").join(nodes.select("node", "short", "bands"), "node").join(asked_in, "node", "left")
    owned = settle(owned, "owned")
    carried = ("total", "common", "parts", "short", "bands", "asked")
    to_hub = inside.join(owned.withColumnRenamed("node", "b"), "b").join(hubs.select("bucket", "hub"), "bucket")
    to_hub = to_hub.select("bucket", F.col("b").alias("x"), "hub", "label", *carried, F.least("b", "hub").alias("a"), F.greatest("b", "hub").alias("b"))
    far = F.when(F.col("x") == F.col("hub"), 0.0).otherwise(1 - F.col("similarity"))
    placed = settle(to_hub.join(scored, ["a", "b"], "left").select("bucket", F.col("x").alias("b"), "label", *carried, far.alias("far")), "placed")
    placed = placed.withColumns({"step": F.floor(F.col("far") / step), "zone": F.floor(F.log("total") / log(ratio))})
    beside = placed.join(asked.select("bucket", F.col("o").alias("b"), "own"), ["bucket", "b"])
    beside = beside.select("bucket", F.col("b").alias("o"), "own", *(F.col(c).alias(f"o_{c}") for c in ("far", *carried)), "step", "zone")
    for key in ("step", "zone"):
        beside = beside.withColumn(key, F.explode(F.sequence(F.col(key) - 1, F.col(key) + 1)))
    alike = (F.abs(F.col("far") - F.col("o_far")) <= reach + 1e-9) & (F.least("total", "o_total") >= F.greatest("total", "o_total") * similarity - 1e-9)
    least = (F.col("total") + F.col("o_total")) * (similarity / (1 + similarity)) - 1e-6
    most = F.aggregate(F.zip_with("parts", "o_parts", lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)
    needed = AGREEING if similarity >= SIMILARITY - 1e-9 else 0
    once = (F.array_min(F.array_intersect("bands", "o_asked")) == F.col("bucket")) & ((F.col("b") < F.col("o")) | F.col("asked").isNull() | ~F.arrays_overlap("asked", "o_bands"))
    may = (F.col("label") != F.col("own")) & alike & (F.least("common", "o_common") >= least) & (_agreeing("short", "o_short") >= needed) & once & (most >= least)
    met = settle(placed.join(beside, ["bucket", "step", "zone"]).where(may).select("b", "o"), "met")
    return met.unionByName(_sharing_rare(rare, of_node, similarity))


def _relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, label) after further links: the classes so far are the nodes of a small graph."""
    if labels is None:
        return components(links)
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
    joined = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = components(joined.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")))
    higher = between.select(F.col("node").alias("label"), F.col("label").alias("top"))
    moved = labels.join(higher, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    fresh = between.join(labels.select("node"), "node", "left_anti")
    return settle(moved.unionByName(fresh), "labels")


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, tkey (of the text), n_words, class_id, keeper.

    Rows of one class are joined by links of weighted Jaccard similarity >= similarity over five-word shingles. class_id is
    the class's smallest doc_id; keeper marks the row (or repeated rows) with that doc_id and smallest tkey. Texts without
    words (null, empty, only punctuation) take no part: each is its own class. Equal word sequences are one node from the
    start, so groups of copies of any size cost one sketch and no pairs.

    Candidates are nodes that share a bucket of a band, and each link is checked exactly. Links inside a class add nothing,
    so not all are looked at: each node is compared with its bucket's hub (the member in the most crowded buckets), then
    those in another class than the hub with a second hub of their own, and what still differs from the hub's class with
    every member of another class that the rare shingles, the distance to the hub, the length and the sketch leave
    possible. So no bucket is capped and no link between the classes found is skipped, but for what sketches can't tell:
    of links of 0.8 two in 10,000 share no band, and two in a million agree in too few coordinates for the last turn.
    """
    rows = settle(sketches(docs), "sketches")
    named = rows.where("n_words > 0")
    by_key = named.groupBy("k1", "k2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "tkey")).alias("m"), F.first("bands").alias("bands"), F.first("short").alias("short"), F.greatest(F.first("n_words") - (SHINGLE - 1), F.lit(1)).alias("total"))
    nodes = settle(by_key.select("k1", "k2", F.col("m.doc_id").alias("doc_id"), F.col("m.tkey").alias("tkey"), F.xxhash64("k1", "k2").alias("node"), "bands", "short", "total"), "nodes")
    banded = nodes.select(F.col("node").alias("b"), "total", F.explode("bands").alias("bucket"))
    crowded = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = settle(banded.join(crowded, "bucket"), "shared")
    members = settle(shared.join(shared.groupBy("b").agg(F.sum("n").alias("crowd")), "b").select("bucket", "b", "crowd", "total"), "members")
    wanted = members.select(F.col("b").alias("node")).distinct()
    of_node = wanted.join(nodes.select("node", "doc_id", "tkey"), "node")
    texts = docs.select(F.col("doc_id").cast("long"), "text").withColumn("tkey", text_key())
    texts = texts.join(of_node, texts.doc_id.eqNullSafe(of_node.doc_id) & (texts.tkey == of_node.tkey)).select("node", "text")
    sets = _word_hashes(texts).select("node", "words").mapInArrow(released(_shingle_sets), "node long, h array<long>").dropDuplicates(["node"])
    sets, seen = observed(sets, "shingles", elements=F.sum(F.size("h")))
    blocks = max(1, (seen["elements"] or 0) // BLOCK)
    labels, known = None, None
    for turn in ("hub", "second hub", "rest"):
        if labels is None:
            spread = members.withColumn("label", F.col("b"))
            hubs = settle(_hubs(spread), "hubs")
            pairs = spread.join(hubs, "bucket").where("b <> hub").select("b", F.col("hub").alias("o"))
        else:
            spread = members.join(labels.withColumnRenamed("node", "b"), "b", "left").select("bucket", "b", "crowd", "total", F.coalesce("label", "b").alias("label"))
            spread = settle(spread, "labelled")
            differing = spread.join(_hubs(spread), "bucket").where("label <> hub_label").select("bucket", "b", "crowd", "label")
            differing, seen = observed(differing, "differing", rows=F.count(F.lit(1)))
            if not seen["rows"]:
                break
            # The hub of those that differ meets the whole bucket; at last, all of them do.
            if turn == "second hub":
                asked = _hubs(differing).select("bucket", F.col("hub").alias("o"), F.col("hub_label").alias("own"))
                pairs = spread.join(asked, "bucket").where("label <> own").select("b", "o")
            else:
                pairs = _in_reach(spread, differing.select("bucket", F.col("b").alias("o"), F.col("label").alias("own")), hubs, known, nodes, sets, similarity)
        pairs = pairs.select(F.least("b", "o").alias("a"), F.greatest("b", "o").alias("b")).distinct()
        if known is not None:
            pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
        scored = settle(_similarities(pairs, sets, blocks), "scored")
        known = scored if known is None else known.unionByName(scored)
        labels = _relabelled(labels, scored.where(F.col("similarity") >= similarity).select("a", "b"))
    firsts = nodes.join(labels, "node", "left").select("k1", "k2", "doc_id", "tkey", F.coalesce("label", "node").alias("label"))
    firsts = settle(firsts, "firsts")
    heads = firsts.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "tkey")).alias("head"))
    classes = firsts.select("k1", "k2", "label").join(heads, "label").select("k1", "k2", "head")
    out = rows.drop("bands", "short").join(classes, ["k1", "k2"], "left")
    alone = F.col("n_words") == 0
    return out.select(
        "doc_id", "tkey", "n_words",
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.when(alone, True).otherwise(F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("tkey") == F.col("head.tkey"))).alias("keeper"),
    )


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that remain when each class keeps one: the smallest doc_id (ties: smallest tkey; repeated rows: one).
    They have the columns of docs, whatever their names."""
    kept = near_duplicate_classes(docs, similarity).where("keeper").select(F.col("doc_id").alias("kept_id"), F.col("tkey").alias("kept_key")).distinct()
    kept = settle(kept, "kept")
    moved, back = aside(docs, "__id", "__key", "kept_id", "kept_key")
    keyed = moved.withColumns({"__id": F.col("doc_id").cast("long"), "__key": F.coalesce(text_key(), F.lit(0).cast("long"))})
    joined = keyed.join(kept, F.col("__id").eqNullSafe(F.col("kept_id")) & (F.col("__key") == F.col("kept_key")), "left_semi")
    return joined.dropDuplicates(["__id", "__key"]).select(*back)
