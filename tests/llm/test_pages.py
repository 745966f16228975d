"""Elements without content or end tag must not take the rest of a page with them."""

import time

import pytest

from phrasewright.llm import page_blocks


def _texts(page):
    return [text for text, _, _ in page_blocks.blocks(page)]


@pytest.mark.parametrize("tag", ["svg", "iframe", "video", "audio", "object", "math", "canvas", "select", "noscript", "template"])
def test_self_closed_and_endless(tag):
    for start in (f"<{tag}/>", f'<{tag} class="i"/>', f"<{tag} a=b />", f"<{tag} hidden/>", f"<{tag} class='i'>", f"<{tag.upper()} src=/a/>"):
        assert _texts(f"<article><p>One.</p>{start}<p>Two.</p><p>Three.</p></article>") == ["One.", "Two.", "Three."], start
    assert _texts(f"<p>One.</p><{tag} a=b><b>no text</b></{tag.upper()} ><p>Two.</p>") == ["One.", "Two."]


@pytest.mark.parametrize("tag", ["script", "style", "textarea"])
def test_to_the_end(tag):
    assert _texts(f"<p>One.</p><{tag}>x <p>y</p>") == ["One."]
    assert _texts(f'<p>One.</p><{tag} src="a" /><p>Two.</p>') == ["One.", "Two."]
    assert _texts(f"<p>One.</p><{tag} src=/a/>x</{tag}><p>Two.</p>") == ["One.", "Two."]


def test_head_without_end():
    body = "<article><p>Text one.</p><p>Text two.</p></article>"
    whole = page_blocks.blocks(f"<html><head><title>t</title></head><body>{body}</body></html>")
    assert [b[0] for b in whole] == ["Text one.", "Text two."]
    head = "<html><head><meta charset=x><title>t</title><script>var a='<p>';</script><style>p {}</style><link rel=a>"
    assert page_blocks.blocks(f"{head}<body>{body}") == whole
    assert _texts(head + body) == _texts(head.replace("<head>", "<head class=a>") + "</head>" + body) == ["Text one.", "Text two."]
    assert page_blocks.blocks(head + body)[0][1] == (("html",), ("article",), ("p",))
    assert _texts("<head><title>t</title>Plain text.") == ["Plain text."]
    assert page_blocks.blocks("<html><head>\nPlain <p>One.</p>")[1][1] == (("html",), ("p",))


def test_many_endless_are_linear():
    start = time.time()
    assert len(_texts("<svg><iframe><p>x</p>" * 20_000)) == 20_000
    assert time.time() - start < 10
