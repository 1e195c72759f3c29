"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks. Each block is read as a vector of its tag
path (hashed names of the open elements and of the words of their class, id and
role), its hashed words, and a few measures (length, share of links, place). A
bidirectional LSTM in numpy passes over the whole page both ways, so that every
block is classified with the document around it; blocks labelled as article are
joined.

The labeller is trained from a fixed seed on generated pages that hold the kinds of blocks a page
has, so that it needs no labelled corpus. TRAIN_PAGES bounds it. Its weights are kept in WEIGHTS;
`python -m flowtide.llm.html_extraction` makes that file anew. Some of the generated pages have elements and
names that say nothing: there the shape and the place of the blocks have to do.

What counts as the article where templates differ: the title in an article's own header is part of it, the
byline and the date beside that title aren't; boxes of reader comments aren't, under whatever of the usual names.

Cases: null or empty html has no blocks and an empty text; broken markup is read
as far as it goes; pages of any number of blocks are read whole, a stretch at a time; repeated rows are
extracted each; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import random
import re
import zlib
from pathlib import Path as File

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session
from .html_blocks import Block, Path, blocks
from .words import U, batches, split

PATH, WORDS, MEASURES, HIDDEN = 96, 24, 8, 16
SIZE = PATH + WORDS + MEASURES
#: Generated pages, passes over them and pages of a step.
TRAIN_PAGES, EPOCHS, STEP = 3500, 14, 16
WEIGHTS = File(__file__).with_name("page_labeller.npz")
#: Blocks that are passed through the network at once.
CHUNK = 24_000


# -- features -----------------------------------------------------------------


@functools.lru_cache(100_000)
def _level(names: tuple[str, ...]) -> np.ndarray:
    """Hashed names of one element."""
    v = np.zeros(PATH, np.float32)
    for name in names:
        h = zlib.crc32(name.encode())
        v[h % PATH] += 1 if h >> 16 & 1 else -1
    return v


def _path_vector(path: Path) -> np.ndarray:
    """The sum over all levels, and the innermost element once more under a name of its own."""
    waiting, at = [], path
    while at is not None and at.vector is None:
        waiting.append(at)
        at = at.around
    for at in reversed(waiting):
        at.vector = _level(at.names) if at.around is None else at.around.vector + _level(at.names)
    return path.vector + _level(("last " + path.names[0],)) if path.names else path.vector


def features(pages: list[list[Block]], places: np.ndarray | None = None) -> np.ndarray:
    """A row for each block of all pages, in order; places: where in its page (0 to 1) each block stands, if the pages are parts of some."""
    every = [b for page in pages for b in page]
    out = np.zeros((len(every), SIZE), np.float32)
    if not every:
        return out
    out[:, :PATH] = [_path_vector(b.path) for b in every]
    words = split(pa.array([b.text for b in every], pa.large_string()), lower=True)
    hashes = words.hashes()
    n = words.counts()
    doc = words.doc()
    cell = doc * WORDS + (hashes % U(WORDS)).astype(np.int64)
    out[:, PATH : PATH + WORDS] = np.bincount(cell, np.where(hashes >> U(40) & U(1), 1.0, -1.0), len(every) * WORDS).reshape(-1, WORDS) / np.sqrt(np.maximum(n, 1))[:, None] / 2
    np.clip(out[:, PATH : PATH + WORDS], -1, 1, out=out[:, PATH : PATH + WORDS])
    size = np.array([len(b.text) for b in every], np.float32)
    m = PATH + WORDS
    out[:, m] = np.log1p(size) / 5
    out[:, m + 1] = [min(1, b.linked / max(1, len(b.text))) for b in every]
    out[:, m + 2] = [b.text[-1] in ".!?:" for b in every]
    out[:, m + 3] = ["©" in b.text for b in every]
    out[:, m + 4] = np.minimum(n, 12) / 12
    out[:, m + 5] = np.concatenate([np.linspace(0, 1, len(p)) for p in pages if p]) if places is None else places
    out[:, m + 6] = 1
    out[:, m + 7] = size > 120
    return out


# -- the network --------------------------------------------------------------


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _run(x: np.ndarray, mask: np.ndarray, w: np.ndarray, b: np.ndarray, keep: bool, state: list | None = None):
    """One direction of the LSTM over x (time, pages, size); mask stops the state at the end of a page.

    state: where the last call over the same pages ended (two arrays); it is moved on.
    """
    steps, pages, _ = x.shape
    wx, wh = w[: x.shape[2]], w[x.shape[2] :]
    drive = x.reshape(steps * pages, -1) @ wx + b
    drive = drive.reshape(steps, pages, -1)
    h, c = state or (np.zeros((pages, HIDDEN), x.dtype), np.zeros((pages, HIDDEN), x.dtype))
    out, trace = np.zeros((steps, pages, HIDDEN), x.dtype), []
    for t in range(steps):
        z = drive[t] + h @ wh
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        new = f * c + i * g
        on = mask[t][:, None]
        if keep:
            trace.append((h, c, i, f, o, g, new, on))
        c = np.where(on, new, c)
        h = np.where(on, o * np.tanh(new), h)
        out[t] = h
    if state is not None:
        state[:] = h, c
    return out, trace


def _back(x: np.ndarray, w: np.ndarray, trace: list, grad: np.ndarray):
    """Gradients of w and b for grad with respect to the outputs."""
    wh = w[x.shape[2] :]
    dw, db = np.zeros_like(w), np.zeros(w.shape[1], w.dtype)
    dh = np.zeros_like(grad[0])
    dc = np.zeros_like(dh)
    for t in range(len(trace) - 1, -1, -1):
        h, c, i, f, o, g, new, on = trace[t]
        dh = dh + grad[t]
        th = np.tanh(new)
        d_new = np.where(on, dc + dh * o * (1 - th * th), 0)
        z = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), np.where(on, dh * th, 0) * o * (1 - o), d_new * i * (1 - g * g)], axis=1)
        dw[: x.shape[2]] += x[t].T @ z
        dw[x.shape[2] :] += h.T @ z
        db += z.sum(axis=0)
        dh = np.where(on, 0, dh) + z @ wh.T
        dc = np.where(on, d_new * f, dc)
    return dw, db


def _padded(rows: np.ndarray, lengths: list[int]):
    """(time, pages, size) forwards and backwards, and the mask."""
    steps = max(lengths)
    there = np.zeros((steps, len(lengths), rows.shape[1]), rows.dtype)
    back = np.zeros_like(there)
    mask = np.arange(steps)[:, None] < np.array(lengths)[None]
    at = 0
    for p, n in enumerate(lengths):
        there[:n, p] = rows[at : at + n]
        back[:n, p] = rows[at : at + n][::-1]
        at += n
    return there, back, mask


class Labeller:
    def __init__(self, parts: list[np.ndarray]):
        self.parts = parts  # weights and biases of both directions, then of the output

    def logits(self, rows: np.ndarray, lengths: list[int]) -> np.ndarray:
        """Scores of the blocks of pages, in order."""
        wf, bf, wb, bb, wo, bo = self.parts
        there, back, mask = _padded(rows, lengths)
        a, _ = _run(there, mask, wf, bf, False)
        b, _ = _run(back, mask, wb, bb, False)
        return np.concatenate([np.concatenate([a[:n, p], b[:n, p][::-1]], axis=1) for p, n in enumerate(lengths)]) @ wo + bo

    def long_logits(self, page: list[Block], chunk: int) -> np.ndarray:
        """As logits, of one page, `chunk` blocks at a time: the state of each direction is carried on, a number a block is kept."""
        wf, bf, wb, bb, wo, bo = self.parts
        places = np.linspace(0, 1, len(page))
        out = np.full(len(page), bo[0])
        starts = range(0, len(page), chunk)
        for w, b, own, step in ((wf, bf, wo[:HIDDEN], 1), (wb, bb, wo[HIDDEN:], -1)):
            state = [np.zeros((1, HIDDEN), np.float32)] * 2
            for at in starts[::step]:
                rows = features([page[at : at + chunk]], places[at : at + chunk])[::step, None]
                got, _ = _run(rows, np.ones((len(rows), 1), bool), w, b, False, state)
                out[at : at + chunk] += (got[:, 0] @ own)[::step]
        return out

    def article(self, pages: list[list[Block]], chunk: int = CHUNK) -> list[list[bool]]:
        """For each page, which of its blocks belong to the article."""
        out: list[list[bool]] = [[] for _ in pages]
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            now = [order.pop()]
            if len(pages[now[0]]) > chunk:
                out[now[0]] = (self.long_logits(pages[now[0]], chunk) > 0).tolist()
                continue
            while order and (len(now) + 1) * len(pages[now[0]]) <= chunk:
                now.append(order.pop())
            lengths = [len(pages[i]) for i in now]
            scores = self.logits(features([pages[i] for i in now]), lengths)
            at = 0
            for i, n in zip(now, lengths, strict=True):
                out[i] = (scores[at : at + n] > 0).tolist()
                at += n
        return out


@functools.cache
def trained() -> Labeller:
    with np.load(WEIGHTS) as kept:
        return Labeller([kept[f"arr_{i}"] for i in range(6)])


def train(seed: int = 5, pages: int = TRAIN_PAGES, epochs: int = EPOCHS) -> Labeller:
    r = np.random.default_rng(seed)
    made = [generate(seed * 100_003 + i) for i in range(pages)]
    seqs, golds = [p for p, _ in made], [g for _, g in made]
    rows = features(seqs)
    at = np.append(0, np.cumsum([len(p) for p in seqs]))
    n = SIZE + HIDDEN
    parts = [r.normal(0, 1 / np.sqrt(n), (n, 4 * HIDDEN)), np.zeros(4 * HIDDEN), r.normal(0, 1 / np.sqrt(n), (n, 4 * HIDDEN)), np.zeros(4 * HIDDEN), r.normal(0, 0.2, 2 * HIDDEN), np.zeros(1)]
    parts = [p.astype(np.float32) for p in parts]
    for k in (1, 3):
        parts[k][HIDDEN : 2 * HIDDEN] = 1  # remember by default
    m, v, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for _ in range(epochs):
        order = r.permutation(pages)
        for s in range(0, pages, STEP):
            own = order[s : s + STEP]
            lengths = [len(seqs[i]) for i in own]
            x = np.concatenate([rows[at[i] : at[i + 1]] for i in own])
            x = x * (r.random(x.shape) > 0.1)  # names that are missing
            x[:, PATH : PATH + WORDS] *= r.random((len(x), 1)) > 0.3  # words are the lesser evidence
            there, back, mask = _padded(x.astype(np.float32), lengths)
            a, ta = _run(there, mask, parts[0], parts[1], True)
            b, tb = _run(back, mask, parts[2], parts[3], True)
            ga, gb, dwo, dbo = np.zeros_like(a), np.zeros_like(b), np.zeros_like(parts[4]), 0.0
            total = sum(lengths)
            for p, (i, k) in enumerate(zip(own, lengths, strict=True)):
                h = np.concatenate([a[:k, p], b[:k, p][::-1]], axis=1)
                g = (_sigmoid(h @ parts[4] + parts[5]) - golds[i]) / total
                dwo += h.T @ g
                dbo += g.sum()
                ga[:k, p] = np.outer(g, parts[4][:HIDDEN])
                gb[:k, p] = np.outer(g[::-1], parts[4][HIDDEN:])
            grads = [*_back(there, parts[0], ta, ga), *_back(back, parts[2], tb, gb), dwo, np.array([dbo], np.float32)]
            step += 1
            rate = 1e-2 * (1 + np.cos(np.pi * step / (epochs * -(-pages // STEP)))) / 2
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                parts[k] = (parts[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return Labeller(parts)


# -- pages to learn from ------------------------------------------------------


def generate(seed: int) -> tuple[list[Block], np.ndarray]:
    """A page's blocks, and 1 for those of its article."""
    r = random.Random(seed)
    sounds = ["".join(r.choice("bcdfghjklmnprstvwzéüñßaeiou") for _ in range(r.randint(1, 4))) for _ in range(60)]
    word = lambda: "".join(r.choice(sounds) for _ in range(r.randint(1, 3)))
    say = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    end = lambda a, b: say(a, b).capitalize() + r.choice("....!?")
    cls = lambda *names: r.choice([f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="{r.choice(names)} {word()}"'])
    link = lambda: f'<a href="/{word()}">{say(1, 3)}</a>'
    mark = "\x01"  # stands at the front of every block of the article
    plain = r.random() < 0.35  # a template whose elements and names say nothing, but for comments, adverts and notices, which nothing else tells from an article
    telling = re.compile("comment|repl|discuss|respon|disqus|thread|message|review|feedback|reader|^ad|spons|promo|banner|cookie|consent|gdpr|notice|alert|newsletter|subscribe|popup|modal|warning")

    def items(n, inner):
        return "<ul>" + "".join(f"<li>{inner()}" + r.choice(["</li>", "</li>", ""]) for _ in range(n)) + "</ul>"

    def menu():
        body = items(r.randint(3, 9), link)
        return r.choice([f"<nav>{body}</nav>", f"<div{cls('nav', 'menu', 'navbar', 'navigation', 'breadcrumb', 'breadcrumbs', 'pagination', 'toc')}>{body}</div>", f"<nav{cls('main', 'top')}>{' '.join(link() for _ in range(4))}</nav>"])

    def header():
        return r.choice([f"<header><h1>{say(1, 3)}</h1><p>{say(2, 7)}</p></header>", f"<header{cls('site', 'top')}>{link()} {say(1, 3)}</header>", f"<div{cls('header', 'masthead', 'topbar', 'site-header')}><p>{say(2, 8)}</p></div>"])

    def advert():
        body = r.choice([end(4, 25), f"<p>{end(4, 25)}</p>", f"<p>{end(3, 9)}</p><p>{link()}</p>"])
        return f"<{(t := r.choice(['div', 'div', 'section', 'aside']))}{cls('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner', 'adbox')}>{body}</{t}>"

    def notice():
        return f"<{(t := r.choice(['div', 'section']))}{cls('cookie', 'consent', 'notice', 'alert', 'gdpr', 'newsletter', 'subscribe', 'popup', 'modal', 'cookie-banner', 'warning')}><p>{end(5, 30)}</p>{r.choice(['', '<button>' + say(1, 2) + '</button>'])}</{t}>"

    def form():
        return f"<form{r.choice(['', cls('search', 'login', 'contact', 'signup')])}><label>{say(1, 3)}</label><input name=q>" + r.choice(["", f"<p>{end(3, 12)}</p>"]) + f"<select><option>{say(1, 2)}<option>{say(1, 2)}</select><button>{say(1, 2)}</button></form>"

    def sidebar():
        body = f"<h3>{say(1, 4)}</h3>" + items(r.randint(2, 6), link) if plain else r.choice([items(r.randint(2, 6), link), f"<p>{end(5, 30)}</p>", f"<p>{link()}</p><p>{end(4, 20)}</p>"])
        return r.choice([f"<aside>{body}</aside>", f"<div{cls('sidebar', 'related', 'widget', 'recommended', 'trending', 'share', 'social', 'more')}>{body}</div>"])

    def footer():
        body = r.choice([f"&copy; {r.randint(1990, 2030)} {say(1, 3)}", f"&copy; {word()}.example.com &middot; {end(3, 20)}", f"<p>&copy; {say(1, 3)}</p>{items(3, link)}", *([] if plain else [f"<p>{end(4, 20)}</p>", end(4, 20)])])
        return r.choice([f"<footer>{body}</footer>", f"<footer>{body}</footer>", f"<div{cls('footer', 'copyright', 'bottom', 'site-footer')}>{body}</div>"])

    def comments():
        one = lambda: r.choice([f"<p>{end(3, 40)}</p>", f"<b>{word()}</b><p>{end(3, 40)}</p><p>{end(2, 20)}</p>"])
        return r.choice([
            f"<section{cls('comments', 'comment-list', 'replies', 'discussion', 'responses')}><h2>{say(1, 3)}</h2>" + "".join(f"<div class=\"comment\">{one()}</div>" for _ in range(r.randint(1, 6))) + "</section>",
            f"<div{cls('comments', 'comment', 'reader-comments')}>{items(r.randint(1, 6), one)}</div>",
            f"<ol class=\"commentlist\">{''.join(f'<li>{one()}' for _ in range(r.randint(1, 5)))}</ol>",
            f"<div id=\"{r.choice(['disqus_thread', 'fb-comments', 'discussion', 'thread', 'user-reviews', 'feedback', 'respond'])}\">"
            + "".join(f"<div class=\"{each}\">{one()}</div>" for each in [r.choice(["post-message", "message", "reply", "response", "review", "media-body", "comment-body", "reader-post"])] * r.randint(1, 5))
            + "</div>",
        ])

    def paragraph():
        kind = r.random()
        junk = r.random()
        one = end  # junk is part of an article too: it is for later stages to judge
        if junk < 0.06:
            one = lambda a, b: " | ".join(word() for _ in range(r.randint(a, b)))
        elif junk < 0.10:
            one = lambda a, b: say(a, b).upper().replace(" ", r.choice(["!! ", " ", "*** ", "%%% "]))
        elif junk < 0.13:
            one = lambda a, b: " ".join([word()] * r.randint(a, b))
        elif junk < 0.16:
            one = lambda a, b: r.choice(["© ", "Copyright (c) ", "This work is licensed under ", "Contact: a@b.example.com "]) + say(2, 8) + "."
        p = lambda a, b: " ".join(one(3, 25) for _ in range(r.randint(a, b)))
        if kind < 0.62:
            return f"<p>{mark}{p(1, 7)}" + r.choice(["</p>", "</p>", ""])
        if kind < 0.74:
            return f"<p>{mark}{r.choice(['<b>', '<i>', '<em>'])}{p(1, 4)}{r.choice(['<br>', '<br>', ''])}" + r.choice(["</p>", ""])
        if kind < 0.80:
            return f"<p>{mark}{end(1, 3)}</p>"
        if kind < 0.86:
            return f"<h{(n := r.choice('234'))}>{mark}{say(1, 6)}</h{n}>"
        if kind < 0.90:
            return f"<blockquote><p>{mark}{p(1, 3)}</p></blockquote>"
        if kind < 0.94:
            return items(r.randint(2, 5), lambda: mark + r.choice([end(2, 15), say(1, 5)]))
        if kind < 0.96:
            return "<table>" + "".join(f"<tr><td>{mark}{say(1, 4)}</td><td>{mark}{say(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if kind < 0.98:
            return f"<pre>{mark}{say(3, 20)}</pre>"
        return f"<p>{mark}{p(1, 3)} {link()} {p(1, 2)}</p>"

    def article():
        title = f"<h1>{mark}{say(1, 9).capitalize()}{r.choice(['.', '', ''])}</h1>"
        headed = not plain and r.random() < 0.25  # the usual template of blogs
        if headed:
            by = lambda: r.choice([f"<p{cls('meta', 'byline', 'author', 'date', 'entry-meta')}>{say(1, 5)}</p>", f"<div{cls('meta', 'byline', 'date', 'posted')}>{say(1, 3)} {r.randint(1, 28)}, {r.randint(1990, 2030)}</div>", ""])
            title = f"<header{r.choice(['', cls('entry-header', 'post-header', 'article-header')])}>{title}{by()}</header>"
        inside = [title] * (headed or r.random() < 0.9) + [paragraph() for _ in range(r.choice([2, 2, 3, 3, 4, 5, 8, 14] if plain else [0, 1, 1, 2, 3, 5, 8, 14, 25, 40]))]
        if plain and r.random() < 0.35:  # a few short paragraphs and no more
            inside = [f"<h{(n := r.choice('123'))}>{mark}{say(1, 6).capitalize()}</h{n}>"] * (r.random() < 0.5) + [f"<p>{mark}{end(6, 22)}</p>" for _ in range(r.randint(2, 4))]
        if not inside or len(inside) == 1 and inside[0].startswith("<h1>"):
            inside.append(f"<p>{mark}{end(3, 30)}")
        for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2])):
            inside.insert(r.randint(1, len(inside)), r.choice([advert, notice, sidebar, form])())
        if r.random() < 0.1:
            inside.append(comments())
        body = "".join(inside)
        if headed:
            return r.choice([f"<article{r.choice(['', cls('post', 'entry', 'story')])}>{body}</article>", f"<main><article>{body}</article></main>", f"<main>{body}</main>"])
        return r.choice([f"<article>{body}</article>"] * 4 + [f"<main>{body}</main>", f"<main><article>{body}</article></main>", f"<div{cls('content', 'post', 'entry', 'article', 'story', 'main', 'post-content', 'article-body')}>{body}</div>", f"<div>{body}</div>", body])

    page = [r.choice([menu, header, advert, notice, form, sidebar])() for _ in range(r.randint(0, 4))] + [article()] + [r.choice([sidebar, advert, comments, notice, form, menu])() for _ in range(r.randint(0, 3))] + [footer()] * (r.random() < 0.9)
    if r.random() < 0.2:
        page = [f"<div{cls('wrapper', 'container', 'page')}>", *page, "</div>"]
    if r.random() < (0.12 if plain else 0.04):
        page = [article()]  # a page of nothing else
    body = "".join(page)
    if plain:
        names: dict[str, str] = {}
        body = re.sub("<(/?)(?:nav|header|footer|aside|section|article|main)(?=[ >])", r"<\1div", body)
        body = re.sub(' (class|id)="([^"]*)"', lambda m: m[0] if telling.search(m[2]) else f' {m[1]}="{names.setdefault(m[2], r.choice("xqzbk") + word() + str(r.randint(1, 9)))}"', body)
        if r.random() < 0.3:
            body = body.replace('<div class="', '<div data-x="')
    found = blocks(f"<html><head><title>{say(2, 6)}</title></head><body>{body}</body></html>")
    gold = np.array([mark in b.text for b in found], np.float32)
    return [Block(b.text.replace(mark, ""), b.path, b.linked) for b in found], gold


# -- the operator -------------------------------------------------------------


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks and n_kept of every row."""
    spark = session(pages)
    shared = spark.sparkContext.broadcast(labeller or trained())
    rows_in = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def rows(it):
        for batch in batches(it, "html", 4 << 20):
            found = [blocks(x) for x in batch["html"].to_pylist()]
            kept = [[b.text for b, y in zip(page, yes, strict=True) if y] for page, yes in zip(found, shared.value.article(found), strict=True)]
            text = ["\n\n".join(x) for x in kept]
            yield pa.record_batch({
                "page_id": batch["page_id"], "url": batch["url"].cast(pa.string()), "text": pa.array(text, pa.string()), "n_chars": pa.array([len(x) for x in text], pa.int64()),
                "n_blocks": pa.array([len(x) for x in found], pa.int64()), "n_kept": pa.array([len(x) for x in kept], pa.int64()),
            })

    return rows_in.mapInArrow(rows, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, *train().parts)
