"""Bit-sliced search, spelling variants and the prefix trie against plain versions, with odd inputs."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from phrasewright.llm import bit_sliced, license_rules, prefix_trie, spelling_variants, vantage_trees

_VECTORS = "vec_id long, embedding array<double>, label int, score int, rank int, shard string"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in rows], _VECTORS)


def _plain_top(rows, k, every):
    q = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _ in q if i % every == 0}):
        asks = min(v for j, v in q if j == i)
        found = sorted((-sum(a * b for a, b in zip(asks, v, strict=True)), j) for j, v in q if j != i and len(v) == len(asks))[:k]
        out += [(i, n, j, -s) for n, (s, j) in enumerate(found, 1)]
    return out


@pytest.mark.parametrize(("shard", "block"), [(40, 3), (100_000, 1000)])
def test_op11_against_all_pairs(spark, shard, block):
    rnd = random.Random(1)
    rows = [(i, [rnd.uniform(-0.6, 0.6) for _ in range(12)]) for i in range(150)]
    rows += [(i, [0.1] * 12) for i in range(-40, -20)] + [(40, rows[40][1])] * 30 + [(41, [0.5] * 12)] * 3 + [(60, [-0.5] * 12)]
    rows += [(200 + i, [0.0] * 12) for i in range(5)] + [(300, None), (320, [None] * 12), (340, [float("nan")] * 12), (360, [float("inf")] * 12), (None, [1.0] * 12)]
    rows += [(400, [0.3, 0.4]), (401, [-0.3, 7.9]), (402, [1e-9, -1e-9]), (420, []), (421, [])]
    got = sorted(tuple(r) for r in bit_sliced.top_scores(_vectors(spark, rows), 20, 20, shard=shard, block=block).collect())
    assert got == _plain_top(rows, 20, 20)


def test_op11_large_components_and_empty_table(spark):
    rows = [(0, [1e300, -1.0]), (1, [1e300, 3.0]), (2, [-1e300, 0.0])]
    most = math.floor(math.sqrt(2**60 / 2))
    got = [tuple(r) for r in bit_sliced.top_scores(_vectors(spark, rows), 5, 20).orderBy("rank").collect()]
    assert got == [(0, 1, 1, most * most - 64 * 192), (0, 2, 2, -most * most)]
    assert bit_sliced.top_scores(_vectors(spark, []), 5, 20).count() == 0


def test_op11_index_holds_every_row(spark):
    rows = [(i, [i / 100, -i / 50]) for i in range(90)] + [(7, [0.07, -0.14])] * 50
    held = bit_sliced.index(bit_sliced.quantised(_vectors(spark, rows)), shard=20).collect()
    assert len(held) > 2 and sum(sum(r.copies) for r in held) == 140 and sorted(i for r in held for i in r.ids) == list(range(90))


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _plain_variants(rows):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [x for x in words if _near(w, x)] for w in words}
    form = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: f if f and words[f] >= 5 * words[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def _check_variants(spark, rows):
    docs = spark.createDataFrame([(i, t, "a", 1, "b", 2) for i, t in rows], "doc_id long, text string, word string, n int, root string, id int")
    got = {r.word: tuple(r)[1:] for r in spelling_variants.group_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == _plain_variants(rows)
    return got


def test_op12_against_all_pairs(spark):
    rnd = random.Random(2)
    base = ["".join(rnd.choices("abÀ", k=rnd.randint(6, 7))) for _ in range(60)]
    rows = [(i, " ".join(w.capitalize() if rnd.random() < 0.2 else w for w in rnd.choices(base, weights=[0.9**k for k in range(60)], k=90))) for i in range(300)]
    got = _check_variants(spark, rows)
    assert any(f for f, *_ in got.values()) and any(n > 2 for *_, n, _ in got.values())


def test_op12_chains_ties_and_odd_texts(spark):
    words = {"letters": 625, "lettera": 125, "letterab": 25, "lettrab": 5, "aaaaaa": 30, "aaaaaaa": 5, "baaaaa": 30, "abcdefg": 9, "abcdegf": 9, "mountain": 50, "mountaim": 50, "mountais": 9}
    rows = [(None, " ".join(f"{w}," for w, n in words.items() for _ in range(n))), (1, None), (2, ""), (3, "!?"), (4, "short"), (4, "short")]
    giant = "".join(random.Random(3).choices("abcdefgh", k=30_000))
    rows += [(None, f"{giant} {giant[:-1]}")] * 5 + [(None, "×÷ñ÷×ñ " * 5)]
    got = _check_variants(spark, rows)
    assert got["lettrab"][:2] == ("letterab", "letters") and got["mountais"][0] == "mountaim"
    assert got["abcdefg"][3] == 0 and got[giant][3] == 1 and "×÷ñ÷×ñ" in got
    assert spelling_variants.group_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _plain_trie(rows):
    said = lambda r: hashlib.sha256(f"{len(r[0].encode())}:{r[0]}{r[1]}".encode()).digest()
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [t for _, _, t in sorted(x, key=lambda y: (y[0], y[1], said(y[2])))] for c, x in own.items()}
    nodes, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, mine in own.items():
        base, h = c - int(math.fmod(c, 5)), zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(base, [])[:h] + mine[h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
    children = collections.Counter(p[:-1] for p in nodes if p)
    saved, leaves = collections.Counter(), collections.Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members) - 1) * (len(p[-1][1].encode()) if p else 0)
            leaves[p[:d]] += children[p] == 0
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in nodes.items())


def _check_trie(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, n_convs int, base string")
    got = prefix_trie.trie(df).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    want = _plain_trie(rows)
    assert sorted((tuple(r) for r in got), key=lambda r: r[:2]) == want
    return want


def _talk(seed, n):
    rnd = random.Random(seed)
    texts = ["hello", "", None, "été", "why?", "x" * 500]
    rows = []
    for c in range(-n, n):
        copied = rnd.random() < 0.3
        for t in range(rnd.randint(1, 14)):
            rows.append((c, t if rnd.random() < 0.9 else None, rnd.choice(("user", "assistant", None)), texts[t % 6] if copied else rnd.choice(texts)))
    return rows


@pytest.mark.parametrize("nodes", [1, 7, 50_000])
def test_op13_against_plain_version(spark, monkeypatch, nodes):
    monkeypatch.setattr(prefix_trie, "NODES", nodes)
    monkeypatch.setattr(prefix_trie, "PIECE", 20)
    rows = _talk(4, 60) + [(None, 1, "user", "lost")] + [(1000, 1, "user", "same")] * 4 + [(1001, 1, "user", "same")] * 2
    rows += [(c, t, "user", f"common {t}") for c in range(2000, 2300) for t in range(10)]
    _check_trie(spark, rows)


def test_op13_deep_paths_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "NODES", 100)
    # Each conversation leaves the one before it one turn later, and one has very many turns.
    rows = [(5 * c, t, "user", f"t{min(t, 20 - c)}:{t if t < 20 - c else c}") for c in range(20) for t in range(25)]
    rows += [(7, t, "user", f"turn {t}") for t in range(500)]
    want = _check_trie(spark, rows)
    assert max(r[1] for r in want) > 490
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(df).count() == 0


def test_op13_contract_example(spark):
    turns = ["a", "b", "c"]
    rows = [(c, t, "user", x) for c in (10, 15, 20) for t, x in enumerate(turns)]
    want = _check_trie(spark, rows)
    assert [r[:7] for r in want] == [(10, d, None if d == 0 else 10, 3, int(d < 3), 1, 2 * (3 - max(d - 1, 0)) if d else 6) for d in range(4)]
    assert list(itertools.islice((r[7] for r in want if r[1] == 3), 1)) == [hashlib.sha256(b"10,15,20").hexdigest()]


def test_op4_places_and_detections_in_proportion(spark):
    def seconds(phrase, n):
        docs = spark.createDataFrame([(1, (phrase + " ") * n)], "doc_id long, text string")
        began = time.time()
        row = license_rules.scan(docs).select(F.size("__base").alias("base"), F.size("__detections").alias("found")).first()
        assert row.base == (n if "reserved" in phrase else 0) and row.found == n * (1 if "reserved" in phrase else 3)
        return time.time() - began

    for phrase in ("all rights reserved", "mit license gpl copyright x"):
        seconds(phrase, 500)
        # Four times the text: far below the sixteen times of quadratic work.
        assert seconds(phrase, 32_000) < 7 * max(seconds(phrase, 8_000), 0.5)


def test_op3_one_result_for_a_query(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 5.0]), (100, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [4.0, 4.0]), (2, [0.0, 1.0])]
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in vantage_trees.nearest(_vectors(spark, rows), k=10, every=100).orderBy("rank").collect()]
    # [0, 5] is the smallest of its vectors.
    want = sorted((math.dist((0.0, 5.0), v), i) for i, v in rows if i != 100)
    assert got == [(100, n, i, round(d, 6)) for n, (d, i) in enumerate(want, 1)]
