"""Ranges between units, characters and bytes, the way back from a scanned text, blocked separators, references, magnitudes, quoting."""

import random
import re

from pyspark.sql import functions as F

from phrasewright.functions import normal, numbers, ranges
from phrasewright.functions import text as X
from phrasewright.operators import names as N

LETTERS = "aé中😀\n "


def _plain(text, start, length):
    """(char start, char length, byte start, byte length), or None."""
    units = text.encode("utf-16-le")
    try:
        head, body = (units[2 * a : 2 * b].decode("utf-16-le") for a, b in ((0, start), (start, start + length)))
    except UnicodeDecodeError:
        return None
    if start < 0 or length < 0 or 2 * (start + length) > len(units):
        return None
    return len(head), len(body), len(head.encode()), len(body.encode())


def test_located(spark):
    rnd = random.Random(1)
    texts = {i: "".join(rnd.choices(LETTERS, k=rnd.randint(0, 12))) for i in range(40)}
    asked = [(i, s, n) for i, t in texts.items() for s in range(-1, len(t) + 4) for n in (0, 1, 2, 5, -1)]
    df = spark.createDataFrame([(i, t or None) for i, t in texts.items()], "doc_id long, text string")
    got = ranges.located(df, spark.createDataFrame([*asked, (999, 0, 1)], "doc_id long, start long, length long")).collect()
    assert len(got) == len(asked)
    for r in got:
        want = _plain(texts[r.doc_id], r.start, r.length)
        assert r.aligned == (want is not None), r
        if want:
            assert (r.char_start, r.char_length, r.byte_start, r.byte_length) == want
    own = ranges.Boundaries("a中😀b")
    assert [x.tolist() for x in own.in_bytes([1, 2, 0, 2], [1, 2, 5, 1])] == [[1, 4, 0, 4], [3, 4, 9, 4], [True, True, True, False]]
    assert [x.tolist() for x in own.in_units([1, 4, 2], [3, 4, 1])] == [[1, 2, 2], [1, 2, 0], [True, True, False]]
    assert ranges.located(df, df.selectExpr("doc_id", "0L as start", "0L as length").limit(0)).count() == 0


def test_scanned_text():
    known = normal.tables(("", ""), "他很好红中", ["红中", "他"])
    own = ranges.Scanned("😀红中好😀他好", *known)
    assert own.text == "😀\n\n好😀\n好" and own.blocked == [False, True, True, False, False, True, False]
    start, length, kept = own.back([0, 2, 4, 5, 4, 7, 8, 1, 4, 9], [2, 1, 1, 2, 3, 1, 1, 1, 0, 1])
    assert kept.tolist() == [True, False, True, True, True, False, True, False, False, False]
    assert [(s, n) for s, n, k in zip(start.tolist(), length.tolist(), kept, strict=True) if k] == [(0, 2), (4, 1), (5, 2), (4, 3), (8, 1)]


def _plain_blanked(text, phrases):
    cells = [(c, i, i + 1, False) for i, c in enumerate(text)]
    for p in sorted(phrases, key=lambda p: (len(p), p), reverse=True):
        i = 0
        while i < len(cells):
            if "".join(c for c, *_ in cells[i : i + len(p)]) == p and not any(b for *_, b in cells[i : i + len(p)]):
                cells[i : i + len(p)] = [("\0", cells[i][1], cells[i + len(p) - 1][2], True)]
            i += 1
    hidden = {j for _, a, b, blocked in cells if blocked for j in range(a, b)}
    return "".join("\n" if j in hidden else c for j, c in enumerate(text))


def test_blocked_separators():
    rnd = random.Random(2)
    for _ in range(300):
        phrases = {"".join(rnd.choices("甲乙😀", k=rnd.randint(1, 3))) for _ in range(3)}
        text = "".join(rnd.choices("甲乙丙😀", k=rnd.randint(2, 15)))
        got, flags = normal.blanked(text, *normal.tables(("", ""), "", list(phrases)))
        assert got == _plain_blanked(text, phrases) and [c == "\n" for c in got] == flags
    x = normal.Aligned("甲乙丙乙丙")
    x.separate("乙丙")
    assert (x.text, x.ranges, x.blocked.tolist()) == ("甲\n\n", [(0, 1), (1, 2), (3, 2)], [False, True, True])
    x.sub(re.compile("甲\n"), lambda m: "Z")
    assert (x.text, x.ranges, x.blocked.tolist()) == ("Z\n", [(0, 3), (3, 2)], [True, True])


def test_mapped_back(spark):
    df = spark.createDataFrame([(1, "😀红中好"), (2, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, 4, 1), (1, 2, 1), (2, 0, 0)], "doc_id long, start long, length long")
    got = {(r.doc_id, r.start): (r.source_start, r.source_length, r.kept) for r in ranges.mapped_back(df, asked, ignored=["红中"]).collect()}
    assert got[1, 4] == (4, 1, True) and not got[1, 2][2] and not got[2, 0][2]


def test_references_magnitudes_and_quotes(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    said = F.lit("&apos;&lt;&gt;&#65;&#x1F600;&#xD800;&quot;&nope;&eacute;&ccedil;")
    assert one(normal.decoded_entities(said, legacy=True)) == "'<&gt;A😀&#xD800;&quot;&nope;&eacute;ç" and len(normal.LEGACY) == 174
    for n in (0, 9_999, 10_000, 123_456_789, 10**12, 10**16, 10**16 + 5, 12_345_678_901_234_567, 2**63 - 1, -9_999, -10_000, -123_456):
        assert one(X.magnitude_text(F.lit(n))) == numbers.magnitude(n), n
    assert numbers.magnitude(10**12) == "1 vạn ức" and numbers.magnitude(10**16) == "1 ức ức" and numbers.magnitude(-123_456) == ""
    assert one(N.places(F.lit(r"xa\Ebxa\Eb"), F.lit(r"a\Eb"))) == [2, 7] and one(N.contexts(F.lit(r"xa\Eby"), F.lit(r"a\Eb"))) == [r"x【a\Eb】y"]
