"""What the lattice remembers beside words and segments."""

from phrasewright.llm import nbest_pieces


def test_nearest_segments_are_searched_once(monkeypatch):
    pieces, searched = nbest_pieces.load(), []
    lattice, plain = nbest_pieces.Lattice(pieces), nbest_pieces.Lattice(pieces)
    search = lattice.search
    monkeypatch.setattr(lattice, "search", lambda s, n: searched.append(s) or search(s, n))
    texts = ["the cat sat on the mat", "a cat on the mat sat", "x7f3 漢字 ▁ 😀", ""] * 3
    got = [lattice.encode(t, p) for t, p in zip(texts, lattice.prime(texts), strict=True)]
    assert len(searched) == len(set(searched))
    assert got == [plain.encode(t) for t in texts]
    assert all([x[0] for x in lattice.rivals(w)][:1] == [loss][: loss < nbest_pieces._FAR] for w, (_, _, loss) in lattice.words.items())
