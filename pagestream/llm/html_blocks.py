"""Main-text extraction from web pages by a recurrent block labeller.

A page is cut to leaf blocks (runs of text between block-level tags). Each block has a vector of its tag
path (hashed names and class words of its ancestors), its hashed words and a few measures; a numpy
bidirectional LSTM reads the blocks of the whole page in order and labels each main text or not. The network
is trained once a process, in a few seconds, on pages made here from templates with a fixed seed (TRAIN
pages), and sent to the workers as arrays of a fixed size.

Edge cases: null or empty html gives empty text; markup that is cut off or never closed is read as far as it
goes (an element whose content is skipped, but that is never ended, hides nothing unless it is a script or a
style); character references are decoded once; scripts, styles, comments and titles are never text; long pages
are read whole; repeated rows and null page_id are handled as rows; an empty table gives none. Other columns
are not read.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestream.llm.common import bounded_batches

PATH, WORDS, EXTRA, HIDDEN, TRAIN, EPOCHS, SEED = 96, 24, 7, 20, 480, 10, 7
# HTML element kinds.
BLOCK = frozenset("p div article section main nav header footer aside ul ol li dl dt dd table thead tbody tr td th h1 h2 h3 h4 h5 h6 blockquote pre form fieldset figure figcaption address body html hr details summary dialog menu label button option select legend center".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
STOPS = frozenset("ul ol dl table tbody thead div article section main nav header footer aside form blockquote body td th".split())
# Elements whose content is no text of the page; those of CODE hold the rest of a page that doesn't end them.
CODE, SKIPPED = frozenset(["script", "style"]), frozenset("script style title noscript template svg textarea iframe object".split())
_token = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ends = {name: re.compile(rf"</{name}\s*>", re.I) for name in SKIPPED}
_named = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_part = re.compile(r"[a-z]+", re.I)


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """(tag path, text, characters in links) of the leaf blocks in page order."""
    page = page or ""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[tuple[tuple[str, ...], str, int]] = []
    pieces: list[str] = []
    linked = in_link = at = 0

    def end() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(pieces)).split()) if pieces else ""
        if text:
            out.append((tuple(x for _, names in stack for x in names), text, linked))
        pieces.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal in_link
        for name, _ in stack[to:]:
            in_link -= name == "a"
        del stack[to:]

    unended: set[str] = set()
    while m := _token.search(page, at):
        if m.start() > at:
            pieces.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        name = m[2].lower() if m[2] else None
        if name is None or name == "head":
            continue
        closed = m[3].rstrip().endswith("/")
        if name in SKIPPED and not m[1] and not (closed and name in ("svg", "iframe", "object")) and name not in unended:
            over = _ends[name].search(page, at)
            if over or name in CODE:
                at = over.end() if over else len(page)
                continue
            unended.add(name)
        if m[1]:
            if name in BLOCK:
                end()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name in BLOCK or all(s not in BLOCK for s, _ in stack[k + 1 :]):
                        pop(k)
                    break
            continue
        if name in BLOCK:
            end()
            closing = CLOSES.get(name, {"p"} if name not in ("body", "html") else set())
            k = len(stack) - 1
            while k >= 0 and (stack[k][0] not in STOPS or stack[k][0] in closing):
                if stack[k][0] in closing:
                    pop(k)
                k -= 1
        elif name == "br":
            pieces.append(" ")
        if name not in VOID and not closed:
            attributes = " ".join(_named.findall(m[3])) if "=" in m[3] else ""
            stack.append((name, (name, *(f".{w.lower()}" for w in _part.findall(attributes)))))
            in_link += name == "a"
    if at < len(page):
        pieces.append(page[at:])
    end()
    return out


@cache
def _slot(word: str, size: int) -> int:
    return zlib.crc32(word.encode()) % size


def vectors(page: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray:
    """One row of features per block."""
    x = np.zeros((len(page), PATH + WORDS + EXTRA), np.float32)
    for i, (path, text, linked) in enumerate(page):
        for name in path:
            x[i, _slot(name, PATH)] = 1.0
        words = text.lower().encode().split(b" ")
        x[i, PATH : PATH + WORDS] = np.bincount([zlib.crc32(w) % WORDS for w in words], minlength=WORDS) / len(words)
        n = len(text)
        x[i, PATH + WORDS :] = (
            np.log1p(n) / 8,
            min(1.0, linked / n),
            text[-1] in ".!?…\"'",
            i / len(page),
            (len(page) - 1 - i) / len(page),
            min(1.0, text.count(",") / 10),
            1.0,
        )
    return x


class Labeller:
    """Bidirectional LSTM with one output per block."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        d = PATH + WORDS + EXTRA
        self.w = {f"{k}{s}": (r.normal(0, 0.1, shape)).astype(np.float32) for s in "fb" for k, shape in (("x", (d, 4 * HIDDEN)), ("h", (HIDDEN, 4 * HIDDEN)))}
        for s in "fb":
            self.w[f"c{s}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
        self.w["o"], self.w["p"] = r.normal(0, 0.1, (2 * HIDDEN, 1)).astype(np.float32), np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, batch, HIDDEN); masked steps hold the state."""
        t, b, _ = x.shape
        h = c = np.zeros((b, HIDDEN), np.float32)
        out = np.zeros((t, b, HIDDEN), np.float32)
        given = x @ self.w[f"x{side}"] + self.w[f"c{side}"]
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            z = given[k] + h @ self.w[f"h{side}"]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[k][:, None]
            c2 = f * c + i * g
            u = np.tanh(c2)
            if keep is not None:
                keep.append((k, h, c, i, f, o, g, u, m))
            c = np.where(m, c2, c)
            h = np.where(m, o * u, h)
            out[k] = h
        return out

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b")], axis=2)
        return 1 / (1 + np.exp(-np.clip((both @ self.w["o"])[:, :, 0] + self.w["p"], -30, 30)))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept = {"f": [], "b": []}
        both = np.concatenate([self._run(x, mask, s, kept[s]) for s in "fb"], axis=2)
        p = 1 / (1 + np.exp(-np.clip((both @ self.w["o"])[:, :, 0] + self.w["p"], -30, 30)))
        d = (((p - y) * mask) / mask.sum()).astype(np.float32)[:, :, None]
        grad = {"o": np.einsum("tbh,tbo->ho", both, d), "p": d.sum(axis=(0, 1))}
        back = d @ self.w["o"].T
        for n, s in enumerate("fb"):
            dx, dh_w = np.zeros_like(self.w[f"x{s}"]), np.zeros_like(self.w[f"h{s}"])
            db = np.zeros_like(self.w[f"c{s}"])
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for k, h, c, i, f, o, g, u, m in reversed(kept[s]):
                total = dh + back[k][:, n * HIDDEN : (n + 1) * HIDDEN]
                inner = np.where(m, total * o * (1 - u * u) + dc, 0)
                z = np.concatenate([inner * g * i * (1 - i), inner * c * f * (1 - f), np.where(m, total * u * o * (1 - o), 0), inner * i * (1 - g * g)], axis=1).astype(np.float32)
                dx += x[k].T @ z
                dh_w += h.T @ z
                db += z.sum(axis=0)
                dh = z @ self.w[f"h{s}"].T + np.where(m, 0, total)
                dc = np.where(m, inner * f, dc)
            grad |= {f"x{s}": dx, f"h{s}": dh_w, f"c{s}": db}
        return grad


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(x) for x in pages)
    x, mask = np.zeros((t, len(pages), PATH + WORDS + EXTRA), np.float32), np.zeros((t, len(pages)), bool)
    for i, p in enumerate(pages):
        x[: len(p), i], mask[: len(p), i] = p, True
    return x, mask


def made_page(r: np.random.Generator) -> tuple[str, list[bool]]:
    """A page from templates, and for each of its blocks whether it is main text."""
    pick = lambda options: options[int(r.integers(len(options)))]
    syllables = ["".join(pick("bcdfghjklmnprstvwäéñx") + pick("aeiouyöè") for _ in range(int(r.integers(1, 3)))) for _ in range(40)]
    word = lambda: "".join(pick(syllables) for _ in range(int(r.integers(1, 4))))

    def text(least: int, most: int) -> str:
        return " ".join(word() for _ in range(int(r.integers(least, most + 1)))).capitalize() + pick([".", ".", "!", "", ""])

    parts: list[str] = []
    truth: list[bool] = []

    def add(markup: str, *labels: bool) -> None:
        parts.append(markup)
        truth.extend(labels)

    def links(opening: str, closing: str) -> None:
        n = int(r.integers(2, 9))
        add(opening + "<ul>" + "".join(f'<li><a href="/{word()}">{text(1, 3)}</a>' + pick(["</li>", "</li>", ""]) for _ in range(n)) + "</ul>" + closing, *[False] * n)

    def aside(opening: str, closing: str, longest: int = 40) -> None:
        n = int(r.integers(1, 4))
        tag = pick(["p", "p", "div", "span"])
        if tag == "span":
            add(opening + text(3, longest) + closing, False)
        else:
            add(opening + "".join(f"<{tag}>{text(3, longest)}</{tag}>" for _ in range(n)) + closing, *[False] * n)

    def boilerplate(where: str) -> None:
        kind = pick(["nav", "ad", "side", "notice", "form", "related"] if where != "end" else ["comments", "related", "ad", "form", "share", "side", "notice"])
        if kind == "nav":
            links(*pick([("<nav>", "</nav>"), ('<div class="menu">', "</div>"), ('<div id="nav">', "</div>"), ('<nav class="breadcrumb">', "</nav>"), ('<div class="navbar">', "</div>"), ('<div class="topnav">', "</div>")]))
        elif kind == "related":
            links(pick(['<div class="related">', '<div class="recommended posts">', '<div class="more-stories">', '<div class="popular">', '<div class="tags">']), "</div>")
        elif kind == "share":
            links(pick(['<div class="share">', '<div class="social-links">', '<div class="pagination">']), "</div>")
        elif kind == "ad":
            aside(pick(['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div id="banner-ad">', '<div class="sponsored">', '<div class="promo">', '<aside class="ad">']), "</div>")
        elif kind == "side":
            aside(pick(["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<aside class="widget">', '<div class="widget">']), "</div>")
        elif kind == "notice":
            aside(pick(['<div class="cookie">', '<div class="cookie-notice">', '<div class="notice">', '<div id="consent">', '<div class="alert">', '<div role="alert">', '<div class="newsletter">', '<div class="popup">', '<div class="gdpr banner">', '<div class="subscribe">']), "</div>", 60)
        elif kind == "form":
            n = int(r.integers(1, 4))
            add(pick(["<form>", '<form class="search">', '<form id="login">']) + "".join(f"<label>{text(1, 6)}</label><input name=x>" for _ in range(n)) + f"<button>{text(1, 3)}</button></form>", *[False] * (n + 1))
        else:
            n = int(r.integers(1, 6))
            shape = pick([('<div class="comment"><p>', "</p></div>"), ("<p>", "</p>"), ('<li class="comment">', "</li>"), ('<div class="reply">', "</div>")])
            outer = pick([('<section class="comments">', "</section>"), ('<div id="comments">', "</div>"), ('<div class="comments">', "</div>"), ('<ol class="comment-list">', "</ol>"), ('<div class="discussion comments">', "</div>"), ('<section id="reader-comments">', "</section>")])
            title = [f"<h3>{text(1, 4)}</h3>"] if r.random() < 0.6 else []
            add(outer[0] + "".join(title) + "".join(shape[0] + text(4, 90) + shape[1] for _ in range(n)) + outer[1], *[False] * (n + len(title)))

    parts.append(pick(["<!DOCTYPE html>", ""]) + f'<html lang="{word()}"><head><title>{text(2, 8)}</title><style>p{{}}</style></head><body>')
    wrapped = r.random() < 0.4
    if wrapped:
        parts.append(pick(['<div class="page">', '<div id="wrapper">', '<div class="container">']))
    if r.random() < 0.4:
        opening, closing = pick([("<header>", "</header>"), ('<div class="header">', "</div>"), ('<div id="header">', "</div>"), ('<header class="site-header">', "</header>")])
        add(opening + f"<h1>{text(1, 4)}</h1><p>{text(1, 9)}</p>" + closing, False, False)
    if r.random() < 0.85:
        links(*pick([("<nav>", "</nav>"), ('<nav class="main">', "</nav>"), ('<div class="nav">', "</div>"), ('<div class="menu">', "</div>"), ('<div id="menu">', "</div>")]))
    for _ in range(int(r.integers(0, 3))):
        boilerplate("start")
    outer = pick([("<article>", "</article>")] * 5 + [("<main>", "</main>"), ('<main><article>', "</article></main>"), ('<div class="content">', "</div>"), ('<div id="content">', "</div>"), ('<div class="post-body">', "</div>"), ('<div class="article">', "</div>"), ('<section class="entry-content">', "</section>"), ('<div id="main"><div class="story">', "</div></div>"), ('<div itemprop="articleBody">', "</div>"), ('<article class="post">', "</article>"), ('<article><header>', "</article>")])
    parts.append(outer[0])
    in_header = outer[0].endswith("<header>")
    if r.random() < 0.9 or in_header:
        add(f"<h1>{text(2, 12)}</h1>" + ("</header>" if in_header else ""), True)
    for k in range(int(r.integers(1, 14))):
        kind = r.random()
        if kind < 0.75:
            body = text(2, 120)
            if r.random() < 0.25:
                body = pick(["<b>", "<em>", "<strong>", f'<a href="/{word()}">']) + body + pick(["", "<br>"])
                add(f"<p>{body}" + pick(["", "</p>"]), True)
            else:
                add(f"<p>{body}" + pick(["</p>", "</p>", "</p>", ""]), True)
        elif kind < 0.83:
            add(f"<h2>{text(1, 8)}</h2>", True)
        elif kind < 0.9:
            n = int(r.integers(1, 5))
            add("<ul>" + "".join(f"<li>{text(2, 25)}</li>" for _ in range(n)) + "</ul>", *[True] * n)
        elif kind < 0.95:
            add(f"<blockquote>{text(4, 50)}</blockquote>", True)
        elif kind < 0.97 and k:
            boilerplate("start")
        else:
            add(f"<div>{text(4, 60)}</div>", True)
    inside = r.random() < 0.2
    if inside:
        boilerplate("end")
    parts.append(outer[1])
    for _ in range(int(r.integers(0, 3))):
        boilerplate("end")
    if wrapped:
        parts.append("</div>")
    if r.random() < 0.85:
        add(pick(["<footer>", '<div class="footer">', '<div id="footer">', '<footer class="site-footer">']) + pick(["&copy; ", ""]) + text(2, 30) + pick(["</footer>", "</div>", ""]), False)
    return "".join(parts) + pick(["</body></html>", "</body></html>", ""]), truth


def train(pages: int = TRAIN, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights learned from made pages by Adam."""
    r = np.random.default_rng(seed)
    data = []
    while len(data) < pages:
        page, truth = made_page(r)
        found = blocks(page)
        if len(found) == len(truth):
            data.append((vectors(found), np.array(truth, np.float32)))
    net = Labeller(seed)
    m, v = ({k: np.zeros_like(x) for k, x in net.w.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = sorted(range(pages), key=lambda i: len(data[i][1]) + r.normal(0, 6))
        batches = [order[i : i + 24] for i in range(0, pages, 24)]
        r.shuffle(batches)
        for batch in batches:
            x, mask = padded([data[i][0] for i in batch])
            y = np.zeros(mask.shape, np.float32)
            for k, i in enumerate(batch):
                y[: len(data[i][1]), k] = data[i][1]
            step += 1
            rate = 0.02 * (0.8**epoch)
            for k, g in net.gradients(x, mask, y).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.w[k] = net.w[k] - (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net.w


@cache
def trained() -> dict[str, np.ndarray]:
    return train()


def main_texts(net: Labeller, pages: list[str | None]) -> list[str]:
    """The main text of each page."""
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if found[i]), key=lambda i: len(found[i]))
    at = 0
    while at < len(order):
        some = [order[at]]
        while at + len(some) < len(order) and len(some) < 128 and (len(some) + 1) * len(found[order[at + len(some)]]) <= 16_384:
            some.append(order[at + len(some)])
        at += len(some)
        x, mask = padded([vectors(found[i]) for i in some])
        p = net.probabilities(x, mask)
        for k, i in enumerate(some):
            out[i] = "\n\n".join(b[1] for b, q in zip(found[i], p[:, k]) if q >= 0.5)
    return out


def _extracted(weights: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Labeller()
        net.w = weights
        for batch in batches:
            texts = main_texts(net, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    bounded_batches(pages.sparkSession, 500)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extracted(trained()), "page_id long, url string, text string, n_chars long")
