"""The recurrent block labeller: a bidirectional LSTM in numpy and the pages it learns from."""

from __future__ import annotations

import random
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

from .blocks import DIM, parse, vector

HIDDEN = 20
TRAIN_PAGES = 2000
EPOCHS = 12
SEED = 5
#: Cells (pages times the longest page's blocks) that are labelled at once.
CELLS = 1 << 14
#: Before each piece of main text of a generated page, until its label is read; a private-use character.
MARK = "\ue000"


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction.  Inputs are (time, page, DIM); a mask keeps the state where a page has ended."""

    def __init__(self, rng: np.random.Generator):
        self.w = (rng.standard_normal((DIM + HIDDEN, 4 * HIDDEN)) / np.sqrt(DIM)).astype(np.float32)
        self.b = np.zeros(4 * HIDDEN, np.float32)
        self.b[HIDDEN : 2 * HIDDEN] = 1

    def forward(self, x, mask, keep: bool = False):
        steps, pages, _ = x.shape
        h, c = np.zeros((2, pages, HIDDEN), np.float32)
        out, saved = np.zeros((steps, pages, HIDDEN), np.float32), []
        # So many steps at once that their inputs are weighed in one product of bounded size.
        span = max(1, CELLS // pages)
        for t in range(steps):
            if t % span == 0:
                part = x[t : t + span]
                inner = (part.reshape(len(part) * pages, -1) @ self.w[:DIM] + self.b).reshape(len(part), pages, -1)
            z = inner[t % span] + h @ self.w[DIM:]
            i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            h2 = o * tc
            if keep:
                saved.append((h, c, i, f, o, g, tc, m))
            c, h = np.where(m, c2, c), np.where(m, h2, h)
            out[t] = h
        return (out, saved) if keep else out

    def backward(self, x, saved, grad):
        dw, db = np.zeros_like(self.w), np.zeros_like(self.b)
        dh, dc = np.zeros((2, x.shape[1], HIDDEN), np.float32)
        for t in range(len(saved) - 1, -1, -1):
            h, c, i, f, o, g, tc, m = saved[t]
            dh = dh + grad[t]
            dh_in, dc_in = np.where(m, dh, 0), np.where(m, dc, 0)
            dc2 = dc_in + dh_in * o * (1 - tc * tc)
            dz = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), dh_in * tc * o * (1 - o), dc2 * i * (1 - g * g)], 1)
            dw[:DIM] += x[t].T @ dz
            dw[DIM:] += h.T @ dz
            db += dz.sum(0)
            dh = np.where(m, dz @ self.w[DIM:].T, dh)
            dc = np.where(m, dc2 * f, dc)
        return dw, db


class Labeller:
    """Both directions and a logistic output on their states, so every block is judged in the whole page."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Lstm(rng), Lstm(rng)
        self.v = (rng.standard_normal(2 * HIDDEN) * 0.1).astype(np.float32)
        self.u = np.zeros(1, np.float32)

    def parameters(self):
        return [self.ahead.w, self.ahead.b, self.back.w, self.back.b, self.v, self.u]

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page, given as its blocks' vectors, the probability of each block to be main text."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b + 1 - a) * len(pages[order[b]]) <= CELLS:
                b += 1
            x, mask = stack([pages[k] for k in order[a:b]])
            h = np.concatenate([self.ahead.forward(x, mask), self.back.forward(x[::-1], mask[::-1])[::-1]], 2)
            p = _sigmoid(h @ self.v + self.u)
            for j, k in enumerate(order[a:b]):
                out[k] = p[: len(pages[k]), j]
            a = b
        return out

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01, seed: int = SEED) -> Labeller:
        """Adam on the cross entropy of all blocks."""
        rng = np.random.default_rng(seed)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        step = 0
        for epoch in range(epochs):
            # Pages of like length share a batch; lengths a little blurred, batches in random order.
            order = np.argsort([len(p) * rng.uniform(0.8, 1.25) for p, _ in pages])
            for a in rng.permutation(range(0, len(order), batch)):
                chosen = [pages[k] for k in order[a : a + batch]]
                x, mask = stack([p for p, _ in chosen])
                y = stack([y[:, None] for _, y in chosen])[0][:, :, 0]
                ha, sa = self.ahead.forward(x, mask, True)
                hb, sb = self.back.forward(x[::-1], mask[::-1], True)
                h = np.concatenate([ha, hb[::-1]], 2)
                d = np.where(mask, _sigmoid(h @ self.v + self.u) - y, 0) / mask.sum()
                dh = d[:, :, None] * self.v
                grads = [
                    *self.ahead.backward(x, sa, dh[:, :, :HIDDEN]), *self.back.backward(x[::-1], sb, dh[::-1, :, HIDDEN:]), (d[:, :, None] * h).sum((0, 1)), d.sum().reshape(1),
                ]
                step += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grads))
                for p, g, (m, s) in zip(self.parameters(), grads, moments, strict=True):
                    g = g / max(1.0, size)
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    p -= (rate * 0.5 ** (epoch / 6) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def stack(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pages side by side, (time, page, columns), and where they have blocks."""
    steps = max(1, max((len(p) for p in pages), default=1))
    if len(pages) == 1 and len(pages[0]):
        return pages[0][:, None, :], np.ones((steps, 1), bool)
    x = np.zeros((steps, len(pages), pages[0].shape[1] if pages else DIM), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j] = p
        mask[: len(p), j] = True
    return x, mask


def vectors(blocks) -> np.ndarray:
    out = np.zeros((len(blocks), DIM), np.float32)
    for i, b in enumerate(blocks):
        out[i] = vector(b)
    return out


class PageWriter:
    """Generated pages with known main text, for training: many layouts, no page of the corpus."""

    def __init__(self, seed: int = SEED):
        self.r = random.Random(seed)
        #: Whether the page has no class, id or role words, and few elements that tell what they are.
        self.plain = False

    def word(self) -> str:
        return "".join(self.r.choice("er th on la de ung re st ment os qu ei sch tion ing ca ra".split()) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        own = [self.word() + self.r.choice(["", "", "", "", "", ",", "."]) for _ in range(self.r.randint(low, high))]
        style = self.r.random()
        if style < 0.06:
            own = [w + self.r.choice(["&amp;&amp;", "%%", "***", "$$$"]) for w in own]
        elif style < 0.1:
            own = [w.upper() + "!!" for w in own]
        elif style < 0.14:
            own = " | ".join(own).split(" ")
        return " ".join(own).capitalize()

    def sentence_block(self, low: int = 1, high: int = 60) -> str:
        return self.words(low, self.r.choice([3, 12, high])) + self.r.choice([".", ".", ".", "?", "", ":"])

    def attribute(self, words: list[str]) -> str:
        r = self.r
        if self.plain:
            return ""
        w = r.choice(words)
        w = r.choice([w, w, f"{w} {self.word()}", f"site-{w}", f"{w}-box", f"{w}s", f"{self.word()} {w}"])
        return r.choice([f' class="{w}"', f' class="{w}"', f" class='{w}'", f' id="{w}"', f' role="{w}"'])

    def wrap(self, tags: list[str], words: list[str], inner: str) -> str:
        tag = "div" if self.plain and self.r.random() < 0.8 else self.r.choice(tags)
        if tag in ("div", "section"):
            return f"<{tag}{self.attribute(words)}>{inner}</{tag}>"
        return f"<{tag}{self.attribute(words) if self.r.random() < 0.4 else ''}>{inner}</{tag}>"

    def links(self, low: int = 2, high: int = 9) -> str:
        r = self.r
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(r.randint(low, high))]
        if r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return r.choice([" | ", " ", ""]).join(items) if r.random() < 0.5 else "".join(f"<div>{x}</div>" for x in items)

    def boilerplate(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            return self.wrap(["nav", "nav", "div", "ul"], ["menu", "nav", "navbar", "breadcrumb", "navigation", "topbar"], self.links())
        if kind == "header":
            return self.wrap(["header", "header", "div"], ["header", "masthead", "banner", "branding", "top"], f"<{(t := r.choice(['p', 'div', 'h1', 'span']))}>{self.words(1, 6)}</{t}>" + (self.links() if r.random() < 0.5 else ""))
        if kind == "ad":
            return f"<!-- ad {r.randint(0, 9)} -->" * r.randint(0, 1) + self.wrap(["div", "div", "div", "aside", "ins"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor"], self.sentence_block(2, 30))
        if kind == "side":
            return self.wrap(["aside", "aside", "div"], ["sidebar", "related", "widget", "recommended", "trending", "popular", "rail"], f"<h3>{self.words(1, 4)}</h3>" + (self.links() if r.random() < 0.6 else f"<p>{self.sentence_block(3, 40)}</p>"))
        if kind == "notice":
            if r.random() < 0.15:
                return f"<noscript>{r.choice(['<p>', '<div>', ''])}{r.choice(['Please enable JavaScript ', 'JavaScript '])}{self.words(1, 12)}.</noscript>"
            return self.wrap(["div", "div", "section", "dialog"], ["cookie", "consent", "notice", "banner", "alert", "gdpr", "popup", "modal"], f"<p>{r.choice(['We use cookies ', 'Cookies ', 'Privacy ', ''])}{self.sentence_block(3, 30)}</p><button>{r.choice(['Accept', 'OK', 'Close', self.words(1, 2)])}</button>")
        if kind == "form":
            return self.wrap(["form", "form", "div"], ["newsletter", "subscribe", "search", "login", "signup", "form"], f"<form><label>{self.words(1, 4)}</label><input type='text'><button>{r.choice(['Subscribe', 'Send', 'Search', self.words(1, 2)])}</button></form>" if r.random() < 0.5 else f"<label>{self.words(1, 5)}</label><select><option>{self.word()}</option><option>{self.word()}</option></select>")
        if kind == "share":
            return self.wrap(["div", "ul"], ["share", "social", "tags", "meta", "byline", "tools"], self.links(2, 5))
        if kind == "comments":
            one = lambda: self.wrap(["div", "li", "article"], ["comment", "reply", "response"], f"<p><b>{self.word()}</b> {self.sentence_block(2, 40)}</p>")
            return self.wrap(["section", "div"], ["comments", "discussion", "replies", "respond", "disqus"], f"<h2>{r.choice(['Comments', self.words(1, 3)])}</h2>" + "".join(one() for _ in range(r.randint(1, 5))))
        return self.wrap(["footer", "footer", "footer", "div"], ["footer", "colophon", "bottom", "legal", "copyright"], r.choice([f"&copy; {self.word()}.example &middot; {self.sentence_block(2, 12)}", f"<p>{self.sentence_block(2, 14)}</p>", self.links()]))

    def article(self) -> str:
        """Main text; every character of it lies inside marks that tell the labels."""
        r = self.r
        parts = [f"<h1>{self.mark(self.words(1, 14))}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice([1, 2, 5, 9, 16, 24])):
            k = r.random()
            if k < 0.68:
                text = self.mark(self.sentence_block())
                parts.append(r.choice([f"<p>{text}</p>"] * 5 + [f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>", f"<p class='lead'>{text}</p>"]))
            elif k < 0.76:
                parts.append(f"<h{(h := r.randint(2, 4))}>{self.mark(self.words(1, 8))}</h{h}>")
            elif k < 0.84:
                parts.append(f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{self.mark(self.sentence_block(1, 20))}</li>" for _ in range(r.randint(1, 5))) + f"</{t}>")
            elif k < 0.88:
                parts.append(f"<blockquote><p>{self.mark(self.sentence_block())}</p></blockquote>")
            elif k < 0.91:
                parts.append(f"<pre>{self.mark(self.sentence_block())}</pre>")
            elif k < 0.94:
                parts.append("<table>" + "".join(f"<tr><td>{self.mark(self.words(1, 4))}</td><td>{self.mark(self.words(1, 4))}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>")
            elif k < 0.95:
                parts.append("<dl>" + "".join(f"<dt>{self.mark(self.words(1, 5))}</dt><dd>{self.mark(self.sentence_block(2, 30))}</dd>" for _ in range(r.randint(1, 4))) + "</dl>")
            elif k < 0.955:
                parts.append(f"<noscript><p>{self.mark(self.sentence_block())}</p></noscript>")
            elif k < 0.965:
                parts.append(f"<video controls>{self.words(2, 9)}</video>")
            elif k < 0.975:
                parts.append(f"<figure><img src='x'><figcaption>{self.mark(self.sentence_block(2, 12))}</figcaption></figure>")
            elif not self.plain:
                parts.append(self.boilerplate(r.choice(["ad", "ad", "share", "side", "form", "notice"])))
        if r.random() < 0.12:
            parts.append(self.boilerplate("comments"))
        inner = "".join(parts)
        if self.plain:
            return r.choice([f"<div>{inner}</div>", f"<div>{inner}</div>", f"<table><tr><td>{inner}</td></tr></table>", inner])
        if r.random() < 0.3:
            inner = f"<div{self.attribute(['content', 'body', 'text', 'entry'])}>{inner}</div>"
        if r.random() < 0.65:
            return f"<article{self.attribute(['post', 'article', 'story']) if r.random() < 0.3 else ''}>{inner}</article>"
        return self.wrap(["main", "div", "section"], ["content", "main", "post", "entry", "article", "story", "text"], inner)

    @staticmethod
    def mark(text: str) -> str:
        return MARK + text

    def plain_page(self) -> str:
        """Site name, links, main text and an imprint in elements that say nothing."""
        r = self.r
        name = f"<{(t := r.choice(['div', 'div', 'p', 'td']))}>{self.words(1, 5)}</{t}>" if r.random() < 0.8 else ""
        links = self.wrap(["div", "nav"], [], self.links()) if r.random() < 0.75 else ""
        imprint = self.wrap(["div", "footer"], [], r.choice([f"&copy; {self.words(1, 5)}", f"Copyright {r.randint(1995, 2026)} {self.words(1, 5)}", f"{self.words(1, 3)} {r.randint(1995, 2026)} All rights reserved"])) if r.random() < 0.8 else ""
        more = "".join(self.boilerplate(k) for k in ("notice", "form", "comments") if r.random() < 0.12)
        k = r.random()
        if k < 0.15:
            return self.article() if r.random() < 0.7 else self.mark(self.sentence_block(3, 60))
        if k < 0.4:
            rows = [name, links, self.article() + more, imprint]
            return "<body><table>" + "".join(f"<tr><td>{x}</td></tr>" for x in rows if x) + "</table></body>"
        return f"<html><head><title>{self.words(1, 9)}</title></head><body>{name}{links}{self.article()}{more}{links if r.random() < 0.15 else ''}{imprint}</body></html>"

    def page(self) -> str:
        r = self.r
        self.plain = r.random() < 0.25
        if self.plain:
            return self.plain_page()
        some = lambda kinds, p: "".join(self.boilerplate(k) for k in kinds if r.random() < p)
        top = some(["notice", "header", "nav", "ad", "form", "share", "side"], 0.35)
        end = some(["share", "ad", "side", "comments", "form", "nav", "notice"], 0.25) + (self.boilerplate("footer") if r.random() < 0.85 else "")
        main = self.article()
        if r.random() < 0.2:
            main = f"<main>{some(['side', 'ad'], 0.3)}{main}</main>"
        if r.random() < 0.4:
            top += f"<div{self.attribute(['wrapper', 'container', 'page', 'layout', 'row'])}>"
        head = f"<head><meta charset='utf-8'><title>{self.words(1, 14)}</title><style>p{{}}</style><script>var t='</p>';</script></head>" if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html>{head}<body>{top}{main}{end}" + r.choice(["</body></html>", "</body></html>", ""])

    def example(self) -> tuple[np.ndarray, np.ndarray]:
        """A page's vectors and labels; the marks are gone from the vectors."""
        blocks = parse(self.page())
        labels = np.array([MARK in b.text for b in blocks], np.float32)
        for b in blocks:
            b.text = b.text.replace(MARK, "")
        return vectors(blocks), labels


@lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """The labeller, learnt once a process from ``pages`` generated pages; the same each time."""
    writer = PageWriter(seed)
    return Labeller(seed).train([writer.example() for _ in range(pages)], epochs)


def accuracy(model: Labeller, examples: Iterable[tuple[np.ndarray, np.ndarray]]) -> float:
    """The share of blocks labelled rightly."""
    examples = list(examples)
    found = model.probabilities([x for x, _ in examples])
    right = sum(int(((p > 0.5) == (y > 0.5)).sum()) for p, (_, y) in zip(found, examples, strict=True))
    return right / max(1, sum(len(y) for _, y in examples))
