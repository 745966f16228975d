"""Main text of web pages: a recurrent labeller reads a page's blocks in order and marks those of the article.

A block is the text between two block-level tags. Its vector joins its hashed tag path (the
elements it stands in, with their classes, ids and roles), its hashed words, and a few
numbers. A bidirectional LSTM in numpy reads the whole sequence both ways and gives each
block the probability of belonging to the article.

The model is trained here, on pages that `sample_page` composes from layouts with and
without each kind of boilerplate; their words are invented, so nothing is learnt from them
but the few that boilerplate uses everywhere.
"""

from __future__ import annotations

import html as entities
import random
import re
import uuid
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import widened

PATH, WORDS, NUMBERS, HIDDEN = 160, 64, 8, 20
SIZE = PATH + WORDS + NUMBERS
PAGES, ROUNDS, SEED = 700, 14, 7
#: Elements whose content is never text, those of them that reach to the end of a page without an end tag, elements of a head; elements that don't end a block.
RAW = frozenset("script style noscript template svg math iframe object textarea select canvas video audio title".split())
TO_END = frozenset("script style textarea".split())
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript object script style template title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<end>>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
#: A tag that closes itself: its slash isn't the end of an unquoted value.
_CLOSED = re.compile(r"(?:\A|[\s\"']|=\s*(?:\"[^\"]*\"|'[^']*')|\A[^=]*|\s[^\s=]+)/\Z")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_WORD = re.compile(r"\w+")


def bucket(token: str, size: int) -> int:
    return crc32(token.encode("utf-8", "surrogatepass")) % size


def _element(tag: str, rest: str) -> tuple[str, ...]:
    parts = {"." + p for m in _NAMES.finditer(rest) for p in _PART.findall((m[1] or m[2] or m[3] or "").lower())} if "=" in rest else ()
    return (tag, *sorted(parts))


def blocks(page: str) -> list[tuple[str, tuple[tuple[str, ...], ...], float]]:
    """(text, path, share of its characters in links) of each block with text, in order."""
    out, stack, parts, linked, links, last = [], [], [], 0, 0, 0

    def flush():
        nonlocal linked
        text = "".join(parts)
        if "&" in text:
            text = entities.unescape(text)
        text = " ".join(text.split())
        if text:
            out.append((text, tuple(stack), min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    endless: set[str] = set()
    while m := _TOKEN.search(page, last):
        if m.start() > last:
            if stack and stack[-1][0] == "head" and not page[last : m.start()].isspace():
                stack.pop()
            parts.append(page[last : m.start()])
            if links:
                linked += m.start() - last
        last = m.end()
        if not m["tag"]:
            continue
        tag, closing = m["tag"].lower(), bool(m["close"])
        if not closing and stack and stack[-1][0] == "head" and tag not in IN_HEAD:
            stack.pop()
        if tag in RAW and not closing and m["end"]:
            flush()
            if not _CLOSED.search(m["rest"]):
                ends = None if tag in endless else _ENDS[tag].search(page, last)
                if ends:
                    last = ends.end()
                elif tag in TO_END:
                    last = len(page)
                else:
                    endless.add(tag)
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        if closing:
            links = 0
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag not in VOID and not m["rest"].endswith("/"):
            if tag in ("li", "tr", "td", "th", "dt", "dd", "option", "p") or (stack and stack[-1][0] == "p"):
                ends = (tag, "p") if tag != "p" else ("p",)
                while stack and stack[-1][0] in ends:
                    stack.pop()
            stack.append(_element(tag, m["rest"]))
    parts.append(page[last:])
    flush()
    return out


class Vectors:
    """Blocks as rows of SIZE numbers; remembers paths and words, up to a limit."""

    def __init__(self):
        self.paths: dict = {}
        self.words: dict = {}

    def path(self, path) -> np.ndarray:
        if path not in self.paths:
            if len(self.paths) > 20_000:
                self.paths.clear()
            row = np.zeros(PATH, dtype=np.float32)
            for depth, element in enumerate(path):
                for token in element:
                    row[bucket(token, PATH)] = 1
                if depth == len(path) - 1:
                    row[bucket("leaf " + element[0], PATH)] = 1
            self.paths[path] = row
        return self.paths[path]

    def of(self, page) -> np.ndarray:
        out = np.zeros((len(page), SIZE), dtype=np.float32)
        if len(self.words) > 200_000:
            self.words.clear()
        known = self.words
        for i, (text, path, links) in enumerate(page):
            out[i, :PATH] = self.path(path)
            at = []
            for w in _WORD.findall(text.lower()):
                b = known.get(w)
                if b is None:
                    b = known[w] = bucket(w, WORDS)
                at.append(b)
            counts = np.bincount(at, minlength=WORDS) if at else np.zeros(WORDS)
            out[i, PATH : PATH + WORDS] = counts / max(1.0, float(np.sqrt(counts @ counts)))
            n = len(at)
            out[i, PATH + WORDS :] = (links, np.log1p(n) / 5, n < 4, n > 25, text.endswith((".", "!", "?", "…")), i / len(page), i == 0, "©" in text)
        return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(p: dict, side: str, x: np.ndarray, mask: np.ndarray):
    """Hidden states of a direction over (time, page, SIZE); padded steps keep the state. Also what backward() needs."""
    w, u, b = p["w" + side], p["u" + side], p["b" + side]
    steps, count, n = x.shape[0], x.shape[1], u.shape[0]
    z = (x.reshape(-1, x.shape[2]) @ w + b).reshape(steps, count, 4 * n)
    h, c, out, saved = np.zeros((count, n), x.dtype), np.zeros((count, n), x.dtype), np.zeros((steps, count, n), x.dtype), [None] * steps
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        g = z[t] + h @ u
        s, v = _sigmoid(g[:, : 3 * n]), np.tanh(g[:, 3 * n :])
        i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
        m = mask[t][:, None]
        new = f * c + i * v
        th = np.tanh(new)
        saved[t] = (i, f, o, v, c, th, h, m)
        c, h = m * new + (1 - m) * c, m * (o * th) + (1 - m) * h
        out[t] = h
    return out, saved


def backward(p: dict, side: str, x: np.ndarray, saved, dout: np.ndarray) -> dict:
    """Gradients of a direction's weights given those of its hidden states."""
    u, n = p["u" + side], p["u" + side].shape[0]
    steps = x.shape[0]
    dz, du = np.zeros((steps, x.shape[1], 4 * n), x.dtype), np.zeros_like(u)
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    for t in range(steps - 1, -1, -1) if side == "f" else range(steps):
        i, f, o, v, c, th, h, m = saved[t]
        dh = dh + dout[t]
        through = dh * m
        dnew = dc * m + through * o * (1 - th * th)
        g = np.concatenate([dnew * v * i * (1 - i), dnew * c * f * (1 - f), through * th * o * (1 - o), dnew * i * (1 - v * v)], axis=1)
        dz[t] = g
        du += h.T @ g
        dc, dh = dnew * f + dc * (1 - m), g @ u.T + dh * (1 - m)
    flat = dz.reshape(-1, 4 * n)
    return {"w" + side: x.reshape(-1, x.shape[2]).T @ flat, "u" + side: du, "b" + side: flat.sum(axis=0)}


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max((len(r) for r in rows), default=0)
    x, mask = np.zeros((steps, len(rows), SIZE), dtype=np.float32), np.zeros((steps, len(rows)), dtype=np.float32)
    for i, r in enumerate(rows):
        x[: len(r), i], mask[: len(r), i] = r, 1
    return x, mask


def probabilities(p: dict, rows: list[np.ndarray]) -> list[np.ndarray]:
    """Of each block of each page, with pages of like length read together."""
    out: list = [np.zeros(0, np.float32)] * len(rows)
    order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: len(rows[i]))
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and stop - start < 128 and len(rows[order[stop]]) <= 1.3 * len(rows[order[start]]) + 8 and len(rows[order[stop]]) * (stop - start + 1) <= 20_000:
            stop += 1
        some = order[start:stop]
        x, mask = padded([rows[i] for i in some])
        h = np.concatenate([lstm(p, side, x, mask)[0] for side in "fb"], axis=2)
        got = _sigmoid(h @ p["v"] + p["a"])
        for k, i in enumerate(some):
            out[i] = got[: len(rows[i]), k]
        start = stop
    return out


def sample_page(rnd: random.Random) -> tuple[str, list[str]]:
    """A composed page, and the texts of its article's blocks in order."""
    letters = rnd.choice(["abcdefghijklmnopqrstuvwxyz", "aeiourstnlmédç", "aeinrstdhuüößg", "aeosrnidlcñóí"])

    def word():
        return "".join(rnd.choices(letters, k=rnd.randint(1, 9)))

    def prose(low=1, high=60):
        words = [word() for _ in range(rnd.randint(low, high))]
        mark = rnd.choice(["", "", "", "%%%", "***", "!!", " |"])
        if rnd.random() < 0.1:
            words = [w.upper() for w in words]
        return " ".join(w + mark for w in words).capitalize() + rnd.choice([".", ".", ".", "", "!", "?"])

    def pick(*names):
        return rnd.choice(names)

    def links(n):
        items = "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(n))
        return pick(f"<ul>{items}</ul>", items.replace("<li>", "").replace("</li>", " "), f'<ul class="{pick("menu", "nav", "links")}">{items}</ul>')

    def boiler():
        kind = rnd.randrange(10)
        if kind == 0:
            return f"<nav{pick('', ' class=\"main-nav\"', ' id=\"menu\"')}>{links(rnd.randint(2, 9))}</nav>"
        if kind == 1:
            return f"<header{pick('', ' class=\"site-header\"')}><div>{prose(1, 6)}</div>{pick('', links(4))}</header>"
        if kind == 2:
            return f"<aside{pick('', ' class=\"sidebar\"', ' id=\"related\"')}><{pick('h2', 'h3', 'h4')}>{prose(1, 4)}</{'h3'}>{pick(links(5), f'<p>{prose(3, 30)}</p>')}</aside>"
        if kind == 3:
            box = pick("ad", "ads", "advert", "banner-ad", "sponsored", "promo", "advertisement")
            return f'<!-- ad --><div class="{box}">{pick(prose(2, 25), f"<p>{prose(2, 25)}</p>")}</div>'
        if kind == 4:
            box = pick("cookie-notice", "cookie-banner", "consent", "gdpr-notice", "notice", "alert", "popup", "modal", "newsletter")
            return f'<div class="{box}"{pick("", " role=\"dialog\"", " role=\"alert\"")}><p>{prose(3, 30)} cookies</p><button>{word()}</button></div>'
        if kind == 5:
            return f"<form action=\"/x\"{pick('', ' class=\"search\"', ' id=\"login\"')}><label>{prose(1, 3)}</label><input name=q><button>{word()}</button>{pick('', f'<p>{prose(3, 15)}</p>')}</form>"
        if kind == 6:
            box, one = pick("comments", "comment-list", "replies", "discussion", "responses"), pick("comment", "comment-body", "reply", "post-comment")
            tag = pick("div", "section", "ol")
            inner = "".join(f'<{pick("div", "li")} class="{one}"><span>{word()}</span><p>{prose(3, 40)}</p></div>' for _ in range(rnd.randint(1, 5)))
            return f'<{tag} {pick("class", "id")}="{box}"><h3>{prose(1, 3)}</h3>{inner}</{tag}>'
        if kind == 7:
            return f"<div class=\"{pick('breadcrumb', 'breadcrumbs', 'share', 'social', 'tags', 'pagination', 'related-posts', 'toolbar', 'menu', 'skip-link')}\">{links(rnd.randint(1, 6))}</div>"
        if kind == 8:
            return f"<{pick('div', 'section')} class=\"{pick('sidebar', 'widget', 'side-column', 'rail', 'secondary')}\">{pick('', '<h4>' + prose(1, 3) + '</h4>')}<p>{prose(3, 40)}</p>{links(3)}</div>"
        return f"<div role=\"{pick('navigation', 'banner', 'complementary', 'contentinfo', 'search')}\">{pick(links(4), f'<p>{prose(2, 20)}</p>')}</div>"

    kept: list[str] = []

    def told(text):
        kept.append(text)
        return text

    def paragraph():
        kind = rnd.random()
        if kind < 0.6:
            return f"<p>{told(prose(1, 90))}</p>"
        if kind < 0.7:
            return f"<p><b>{told(prose(3, 60))}<br>"
        if kind < 0.8:
            return f"<h{rnd.randint(2, 4)}>{told(prose(1, 9))}</h2>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{told(prose(1, 20))}</li>" for _ in range(rnd.randint(1, 5))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote><p>{told(prose(3, 40))}</p></blockquote>"
        if kind < 0.93:
            return "<table><tr>" + "".join(f"<td>{told(prose(1, 4))}</td>" for _ in range(3)) + "</tr></table>"
        if kind < 0.96:
            return f"<figure><img src=x><figcaption>{told(prose(2, 10))}</figcaption></figure>"
        return f"<div>{told(prose(4, 60))}</div>"

    inside = rnd.random() < 0.25
    body = f"<h1>{told(prose(1, 14))}</h1>" if rnd.random() < 0.85 else ""
    for _ in range(rnd.randint(1, 14)):
        body += paragraph() + (boiler() if inside and rnd.random() < 0.15 else "")
    box = pick("content", "post", "entry-content", "article-body", "main-content", "story", "post-body", "text")
    article = pick(*[f"<article>{body}</article>"] * 4, f"<main>{body}</main>", f'<main><article class="{box}">{body}</article></main>', f'<div class="{box}">{body}</div>', f'<div id="{box}">{body}</div>', body)
    before = "".join(boiler() for _ in range(rnd.choice([0, 1, 2, 2, 3, 4])))
    after = "".join(boiler() for _ in range(rnd.choice([0, 0, 1, 2, 3])))
    foot = pick("", *[f"<footer{pick('', ' class=\"site-footer\"')}>{pick('&copy; ', '')}{word()}.{word()} &middot; {prose(1, 12)}</footer>"] * 4, f'<div class="footer">{prose(2, 20)}{links(3)}</div>', f'<div id="footer"><p>&copy; {prose(2, 12)}</p></div>')
    middle = pick(*[before + article + after] * 3, f'<div class="{pick("wrapper", "container", "page", "row", "layout")}">{before}{article}{after}</div>')
    return f"<html><head><title>{prose(1, 8)}</title></head><body>{middle}{foot}{pick('', '</body></html>')}", kept


def train(pages: int = PAGES, rounds: int = ROUNDS, seed: int = SEED) -> dict:
    """Fit the labeller on composed pages, by Adam on cross entropy."""
    rnd, rng, vectors, made = random.Random(seed), np.random.default_rng(seed), Vectors(), []
    for _ in range(pages):
        page, kept = sample_page(rnd)
        found, at, y = blocks(page), 0, []
        kept = [" ".join(entities.unescape(k).split()) for k in kept]
        for text, _, _ in found:
            good = at < len(kept) and text == kept[at]
            at += good
            y.append(float(good))
        made.append((vectors.of(found), np.array(y, dtype=np.float32)))
    p = {"v": rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), "a": np.zeros((), np.float32)}
    for side in "fb":
        p |= {"w" + side: rng.normal(0, 0.15, (SIZE, 4 * HIDDEN)).astype(np.float32), "u" + side: rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32), "b" + side: np.zeros(4 * HIDDEN, np.float32)}
        p["b" + side][HIDDEN : 2 * HIDDEN] = 1
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(rounds):
        order = sorted(range(len(made)), key=lambda i: (len(made[i][0]) // 8, rnd.random()))
        batches = [order[i : i + 24] for i in range(0, len(order), 24)]
        rnd.shuffle(batches)
        for some in batches:
            x, mask = padded([made[i][0] for i in some])
            y = np.zeros_like(mask)
            for k, i in enumerate(some):
                y[: len(made[i][1]), k] = made[i][1]
            runs = {side: lstm(p, side, x, mask) for side in "fb"}
            h = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
            d = (_sigmoid(h @ p["v"] + p["a"]) - y) * mask / mask.sum()
            grads = {"v": np.tensordot(d, h, axes=([0, 1], [0, 1])), "a": d.sum()}
            for k, side in enumerate("fb"):
                grads |= backward(p, side, x, runs[side][1], d[:, :, None] * p["v"][k * HIDDEN : (k + 1) * HIDDEN])
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                p[k] = (p[k] - 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def main_texts(p: dict, vectors: Vectors, pages: list[str]) -> list[tuple[str, int, int]]:
    """(main text, number of blocks, number kept) of each page."""
    found = [blocks(page) for page in pages]
    keep = probabilities(p, [vectors.of(b) for b in found])
    return [("\n".join(t for (t, _, _), q in zip(b, k, strict=True) if q > 0.5), len(b), int((k > 0.5).sum())) for b, k in zip(found, keep, strict=True)]


_VECTORS: dict = {}


def extract(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """pages with text, n_chars, n_blocks and n_kept.

    Null and empty html, and pages without article blocks, give an empty text. Nothing is cut or capped; blocks are joined by
    a line feed. Repeated rows come out alike. A column of pages with one of these names is replaced.
    """
    added = {"text": (T.StringType(), pa.string()), "n_chars": (T.LongType(), pa.int64()), "n_blocks": (T.LongType(), pa.int64()), "n_kept": (T.LongType(), pa.int64())}
    pages = pages.drop(*added)
    sent, name, at = pages.sparkSession.sparkContext.broadcast(model or train()), uuid.uuid4().hex, pages.columns.index("html")

    def extracted(batches):
        if name not in _VECTORS:
            _VECTORS.clear()
            _VECTORS[name] = Vectors()
        for whole in batches:
            for a in range(0, max(whole.num_rows, 1), 256):
                batch = whole.slice(a, 256)
                got = main_texts(sent.value, _VECTORS[name], [h or "" for h in batch.column(at).to_pylist()])
                rows = [(t, len(t), n, k) for t, n, k in got]
                columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(added.values())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])

    return widened(pages, extracted, [T.StructField(c, kind) for c, (kind, _) in added.items()])
