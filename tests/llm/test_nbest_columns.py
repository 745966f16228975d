"""Words are scored many at once, and what is known of them lies in columns."""

import hashlib

from phrasewright.llm import nbest_pieces

TEXTS = ["the cat sat on the mat", " two  spaces ", "", "x7f3 漢字 ▁ 😀\nnext", "漢字" * 20 + " a", "the\x00cat \ud800 unhappiness,"]


def test_short_words_are_scored_at_once(monkeypatch):
    lattice, one_by_one = nbest_pieces.Lattice(nbest_pieces.load()), []
    for name in ("sum_of", "nearest"):
        method = getattr(lattice, name)
        monkeypatch.setattr(lattice, name, lambda s, f=method: one_by_one.append(s) or f(s))
    lattice.prime([t for t in TEXTS if len(t) < 30])
    assert not one_by_one and len(lattice.words) > 10
    plain = nbest_pieces.Lattice(nbest_pieces.load())
    for word, (ids, score, loss) in lattice.words.items():
        top, path, lost = plain.nearest(word)
        assert (ids, score, loss) == (path, top, nbest_pieces._FAR if lost is None else lost)


def test_words_met_again_stay_known(monkeypatch):
    monkeypatch.setattr(nbest_pieces, "_CACHE_LIMIT", 40)
    lattice, plain = nbest_pieces.Lattice(nbest_pieces.load()), nbest_pieces.Lattice(nbest_pieces.load())
    for i in range(12):
        texts = [*TEXTS, " ".join(f"often rare{i}x{k}" for k in range(15))]
        for text, primed in zip(texts, lattice.prime(texts), strict=True):
            ids, score, best = lattice.encode(text, primed)
            assert (ids, score, best) == plain.encode(text)
            assert lattice.digest_of(primed) == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert lattice.decode(ids) == text and lattice.variants(primed)[2]
        lattice.forget()
        assert b"often" in lattice.rows and f"rare{i}x1".encode() not in lattice.rows and len(lattice.rows) <= 20


def test_a_word_that_is_not_spelt_shows():
    pieces = nbest_pieces.load()
    lattice = nbest_pieces.Lattice(pieces)
    lattice.spelling[pieces["plain"]["▁the"][0]] = b" thf"
    assert [lattice.variants(rows)[2] for rows in lattice.prime(["the cat", "a cat"])] == [False, True]
