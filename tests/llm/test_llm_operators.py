"""The training-data operators on small tables: plain versions beside them, and nulls, empties, ties, repeats and empty tables."""

import collections
import hashlib
import html
import itertools
import random
import re

import numpy as np
import pytest

from phrasewright.llm import arc_to_warc, chunk_fingerprints, dart_minhash, entropy_mix, kneser_ney, license_rules, nbest_pieces, page_blocks, toxicity, vantage_trees

ODD = [(1, None), (2, ""), (3, " \n "), (4, "..."), (5, "a"), (5, "a"), (None, "a b c d e f g"), (6, "x" * 50_000)]


def _prose(seed, n=120):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choices("etaoinshr", k=rnd.randint(2, 7))) for _ in range(n))


def _docs(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t, "en", f"s{n % 3}" if n % 4 else None, len(t or "")) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 as score", "2 as size", "3 as label") if extra else df


@pytest.fixture(scope="module")
def near(spark):
    base = [_prose(i) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t.replace(" ", "  ").upper()) for i, t in enumerate(base[:4])]
    rows += [(200 + i, base[0] + f" {w}") for i, w in enumerate(("one", "two", "three"))]
    return rows


def test_op1_round_trip(spark):
    big = "é" * 60
    rows = [(-1, None, None), (-2, "a b\nc", ""), (-5, "u", big), (-3, "u", big), (-4, "v", big), (None, "w", big), (-5, "u", big), (-9, "s", "short"), (-8, "s", "short")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in arc_to_warc.archive(pages).collect())
    want = collections.Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= 100 and i != -5
        want[(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", -5 if revisit else None)] += 1
    assert got == want
    assert arc_to_warc.archive(pages.limit(0)).count() == 0


def test_op1_many_members_in_a_file(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 900}</p>" + "same words " * 20) for i in range(6000)]
    got = arc_to_warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    assert {r.page_id: r.refers_to for r in got} == {i: i % 900 if i >= 900 else None for i in range(6000)}
    assert len({r.record_id for r in got}) == 6000


def test_op1_heavy_digests_go_another_way(spark, monkeypatch):
    monkeypatch.setattr(arc_to_warc, "HEAVY", 2)
    rows = [("f", n, n if n else None, d, 200) for n, d in enumerate("aaaabbc")]
    got = arc_to_warc.revisits(spark.createDataFrame(rows, "file string, nth long, page_id long, digest string, payload_bytes long")).collect()
    assert {r.nth: r.refers_to for r in got} == {0: 1, 2: 1, 3: 1, 5: 4}


def test_op1_formats():
    for version in (1, 2):
        body = b"HTTP/1.0 200 OK\r\n\r\nhello\nworld"
        data = arc_to_warc.arc_version_block(version, "x.arc") + arc_to_warc.arc_header(version, "http://a/b c", len(body), "19970203040506") + body + b"\n"
        ((header, content, _),) = arc_to_warc.parse_arc(data)
        assert content == body and header["URL"] == "http://a/b%20c" and header["version"] == version
        ((warc, block),) = arc_to_warc.parse_warc(arc_to_warc.convert(header, content))
        assert warc["warc-type"] == "response" and warc["warc-date"] == "1997-02-03T04:05:06Z" and block == body
        with pytest.raises(arc_to_warc.ArcError):
            list(arc_to_warc.parse_arc(data[:-5]))


def test_op2_targets_and_copies(spark):
    rows = [(i, _prose(i, random.Random(i).randint(1, 200))) for i in range(300)] + ODD
    got = entropy_mix.mix(_docs(spark, rows)).collect()
    sizes = collections.Counter()
    for r in got:
        assert r["__size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert 0 <= r["__copies"] <= 2
        sizes[r.source] += r["__size"]
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, open_, total = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        level = (total - sum(goal.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            goal |= {s: level * weight[s] for s in open_}
            break
        goal |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    for s in order:
        mine = [r for r in got if r.source == s]
        assert abs(mine[0]["__target"] - goal[s]) < 1e-6 * max(1, goal[s])
        taken = sum(r["__size"] * r["__copies"] for r in mine)
        assert abs(taken - goal[s]) <= max(r["__size"] for r in mine if r["__size"] < 300 or len(mine) < 3)
    assert entropy_mix.copied(_docs(spark, rows)).columns == _docs(spark, rows).columns
    assert entropy_mix.mix(_docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("factor, least", [(1.0, 1.0), (vantage_trees.FACTOR, 0.9)])
def test_op3_against_brute_force(spark, factor, least):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(1500, 16)) + rng.integers(0, 4, (1500, 1))
    m[700:760] = m[100]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rank int, score int")
    got = collections.defaultdict(list)
    for r in vantage_trees.nearest(df, factor=factor, shard=400, block=8).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert set(got) == set(range(0, 1500, 100))
    right = 0
    for q in got:
        d = np.sqrt(((m - m[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(1500), d)).tolist() if i != q][:10]
        right += len(set(want) & set(got[q])) / 10
        assert factor < 1 or got[q] == want
    assert right / len(got) >= least
    assert vantage_trees.nearest(df.limit(0)).count() == 0


def _scan_plainly(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    line = " " + " ".join(words) + " "
    base = sorted((label, i) for p, label in license_rules.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    spans = sorted({(line[: m.start()].count(" ") - 1, -line[: m.end()].count(" "), -p, label) for label, p, _, e in license_rules.rules() for m in re.finditer(f"(?<= )(?:{e})(?= )", line)})
    kept = [s for k, s in enumerate(spans) if not any(o[0] <= s[0] and o[1] <= s[1] and o[2] <= s[2] for o in spans[:k])]
    return len(words), base, [(s[3], -s[2], s[0], -s[1]) for s in kept]


def test_op4_against_plain_scan(spark):
    texts = ["CC BY CC BY-SA 4.0 cc by cc by. All Rights Reserved! GNU General Public License v3 or later", "Licensed under the Apache License, Version 2.0. MIT License", "general public license " * 200, "x cc byx acc by cc  by", "İ ünï LICENSE copyright 2020 Acme Inc all rights reserved", "proprietary and confidential", "mit license mit"]
    rows = ODD + list(enumerate(texts, 50))
    for r in license_rules.scan(_docs(spark, rows)).collect():
        n, base, kept = _scan_plainly(r.text)
        assert (r["__n_words"], sorted((b.label, b.start) for b in r["__base"])) == (n, base)
        assert [tuple(d) for d in r["__detections"]] == kept
        assert 0 <= r["__score"] <= 1 and list(r["__labels"]) == sorted({b for b, _ in base} | {k[0] for k in kept})
    assert license_rules.scan(_docs(spark, rows).limit(0)).count() == 0


def test_op5_learns_and_locates(spark):
    rows, labels = list(ODD), []
    for i in range(600):
        bad = i % 4 == 0
        parts = [_prose(i * 31 + k, 9).capitalize() + "." for k in range(6)]
        if bad:
            parts[i % 6] = parts[i % 6][:-1] + random.Random(i).choice([" you moron", " what scum", " scummy idiot"]) + "."
        rows.append((1000 + i, " ".join(parts)))
        labels.append((1000 + i, 1, int(bad)))
    docs, known = _docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, known)).collect()}
    assert got[1]["__toxicity"] == got[2]["__toxicity"] == 0.0
    held = [(i, y) for i, _, y in labels if toxicity.crc32(str(i).encode()) % 4 == 2]
    assert all((got[i]["__toxicity"] >= toxicity.THRESHOLD) == bool(y) for i, y in held)
    for i, y in held:
        if y:
            assert any(re.search("moron|scum|idiot", got[i].text[s.start : s.end]) for s in got[i]["__offending"])
    assert toxicity.score(docs.limit(0), toxicity.fit([], [])).count() == 0


def test_op6_edits_and_containment(spark):
    rows = [(i, _prose(i, 150)) for i in range(40)] + [(1, None), (2, ""), (5, "a"), (5, "a"), (None, "żółw 😀 " * 30)]
    got = chunk_fingerprints.fingerprint_and_edit(_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    ids = sorted((i for i, _ in rows[:40] if i not in (1, 2, 5)), reverse=True)
    by, text = {r.doc_id: r for r in got}, dict(rows[:40])
    for a, b in zip(ids, ids[1:]):
        if a - b == 1:
            t, n = text[a], text[b]
            assert by[a].edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()
            assert 0.3 < by[a].near_edited < 0.7 and by[a].near_next < 0.1
    ones = chunk_fingerprints.fingerprints([text[7], text[7]])
    assert chunk_fingerprints.containment(*ones) == 1.0 and chunk_fingerprints.named(ones[0]) == chunk_fingerprints.named(ones[1])
    long = _prose(77, 3000)
    whole, shifted = chunk_fingerprints.fingerprints([long, "zzz " + long])
    assert chunk_fingerprints.containment(whole, shifted) > 0.9
    assert chunk_fingerprints.fingerprint_and_edit(_docs(spark, rows).limit(0)).count() == 0
    (alone,) = chunk_fingerprints.fingerprint_and_edit(_docs(spark, [(1, "abcd")])).collect()
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and alone.near_next == 1.0


def test_op6_boundaries_by_hand():
    data = _prose(3, 400).encode()
    h, (start,) = chunk_fingerprints.gear_hashes([data])
    want = []
    for i in range(len(data)):
        v = 0
        for b in data[max(0, i - 31) : i + 1]:
            v = (v * 2 + int(chunk_fingerprints.GEAR[b])) % 2**32
        want.append(v)
    assert h[start : start + len(data)].tolist() == want


def _similar(a, b):
    def bag(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    x, y = bag(a), bag(b)
    return sum((x & y).values()) / sum((x | y).values())


def test_op7_classes(spark, near):
    rows = near + [(300, None), (301, ""), (302, "!!!"), (303, "!!!"), (0, near[0][1])]
    got = dart_minhash.near_duplicate_classes(_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r.class_id for r in got}
    named = [(i, t) for i, t in near]
    label = {i: i for i, _ in named}
    for _ in named:
        for (i, a), (j, b) in itertools.combinations(named, 2):
            if _similar(a, b) >= 0.8:
                label[i] = label[j] = min(label[i], label[j])
    assert {i: of[i] for i, _ in named} == label
    assert all(of[i] == i for i in (300, 301, 302, 303))
    kept = dart_minhash.one_of_each(_docs(spark, rows))
    assert kept.columns == _docs(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*label.values(), 300, 301, 302, 303})
    assert dart_minhash.near_duplicate_classes(_docs(spark, rows).limit(0)).count() == 0


def test_op7_sketches_estimate_similarity():
    rnd = np.random.default_rng(5)
    for shared in (0.3, 0.6, 0.9):
        pool = rnd.integers(0, 2**63, 600).astype(np.uint64)
        n = int(300 * 2 * shared / (1 + shared))
        a, b = pool[:300], np.concatenate([pool[:n], pool[300 : 600 - n]])
        agree = []
        for salt in range(6):
            h = np.concatenate([dart_minhash.mix64(x ^ np.uint64(salt)) for x in (a, b)])
            s = dart_minhash.sketch(h, np.repeat([0, 1], [len(a), len(b)]), np.ones(len(h), dtype=np.int64), 2)
            agree.append((s[0] == s[1]).mean())
        assert abs(np.mean(agree) - n / (len(a) + len(b) - n)) < 0.12


def test_op8_separates(spark):
    rows = list(ODD) + [(1000 + i, _prose(i, 80)) for i in range(300)] + [(2000 + i, " ".join(w + "%%%" for w in _prose(i, 40).split())) for i in range(20)]
    labels = spark.createDataFrame([(1000 + i, 1, 0) for i in range(280)] + [(2000, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in kneser_ney.classify(_docs(spark, rows), labels).collect()}
    assert not got[1]["__keep"] and got[1]["__perplexity"] is None
    assert all(got[1000 + i]["__keep"] for i in range(300)) and not any(got[2000 + i]["__keep"] for i in range(20))
    assert kneser_ney.classify(_docs(spark, rows).limit(0), labels).count() == 0



def test_op9_against_enumeration(spark):
    lattice, rnd = nbest_pieces.Lattice(nbest_pieces.load(), 4), random.Random(1)
    for _ in range(120):
        text = "".join(rnd.choice("aab tthe,.é\n▁ 漢") for _ in range(rnd.randint(0, 7)))
        ids, score, best = lattice.encode(text)
        every = []
        for word in nbest_pieces.words_of(text):
            for s in lattice.segments(word):
                edges, found = lattice.edges(s), []

                def walk(at, total):
                    if at == len(s):
                        found.append(total)
                    for j, _, x in edges[at] if at < len(s) else ():
                        walk(j, total + x)

                walk(0, 0)
                every.append(sorted(found, reverse=True)[:6])
        want = sorted((sum(c) for c in itertools.product(*every)), reverse=True)[:4]
        assert [s for s, _ in best] == want and score == want[0]
        variants = [tuple(lattice.applied(text, c)) for _, c in best]
        assert variants[0] == tuple(ids) and len(set(variants)) == len(variants)
        assert all(lattice.decode(v) == text for v in variants)
    out = nbest_pieces.encode(_docs(spark, ODD + [(9, "the cat sat ▁ 漢字 😀\n")])).collect()
    assert all(r.round_trip for r in out) and len(out) == len(ODD) + 1
    fresh = nbest_pieces.Lattice(nbest_pieces.load(), 4)
    fresh.prime([_prose(4, 300)])
    assert all(lattice.nearest(s) == x for s, x in fresh.parts.items())


@pytest.fixture(scope="module")
def labeller():
    return page_blocks.train(pages=400, rounds=10)


def test_op10_held_out_pages(spark, labeller):
    rnd, vectors, wrong, total = random.Random(99), page_blocks.Vectors(), 0, 0
    for _ in range(80):
        page, kept = page_blocks.sample_page(rnd)
        kept = [" ".join(html.unescape(k).split()) for k in kept]
        found, at = page_blocks.blocks(page), 0
        guess = page_blocks.probabilities(labeller, [vectors.of(found)])[0] > 0.5
        for (text, _, _), g in zip(found, guess, strict=True):
            good = at < len(kept) and text == kept[at]
            at += good
            wrong += good != g
            total += 1
    assert wrong / total < 0.04
    page = '<html><head><title>t</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav><div class="ad">buy now</div><article><h1>Title &amp; more</h1><p>First  part\nof it.<p>Second &lt;part&gt;.</article><footer>&copy; x</footer>'
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<p"), (1, "u", page)]
    got = page_blocks.extract(spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, n_chars int"), labeller).collect()
    assert [r.text for r in got] == ["Title & more\nFirst part of it.\nSecond <part>.", "", "", "", "Title & more\nFirst part of it.\nSecond <part>."]
    assert all(r.n_chars == len(r.text) for r in got)


def test_columns_that_clash_are_left_alone(spark):
    names = ["__size", "__s", "__line", "__base", "__toxicity", "__key", "__id", "__row", "__copies", "a.b"]
    rows = [(i, _prose(i, 30), "en", "s") for i in range(6)] + [(9, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", *(f"{n} as `{c}`" for n, c in enumerate(names)))
    for kept in (dart_minhash.one_of_each(docs), entropy_mix.copied(docs)):
        assert kept.columns == docs.columns and all(tuple(r[4:]) == tuple(range(len(names))) for r in kept.collect())
    assert license_rules.scan(docs).select("__base").first()[0] == [] and toxicity.score(docs, ({}, -12.0)).where("__toxicity < 0.5").count() == 7
    assert entropy_mix.mix(docs).columns.count("__size") == 1


def test_op4_many_matches(spark):
    text = "all rights reserved cc by " * 4000
    row = license_rules.scan(spark.createDataFrame([(text,)], "text string")).first()
    assert len(row["__base"]) == 8000 and row["__base"][-1].start in (19995, 19998) and row["__n_words"] == 20000
