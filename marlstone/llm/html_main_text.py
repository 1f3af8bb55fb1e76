"""Main text of HTML pages by a recurrent block labeller.

A bidirectional LSTM in numpy reads each page's leaf blocks in order. A block's input is a
hashed vector of its tag path (element names and the words of class, id and role), a
hashed vector of its words, and a few shape features; both directions see the whole
page before any block is judged. The network is trained here, on pages that a
generator with a fixed seed composes from labelled regions (TRAINING_PAGES of them, the
documented bound); it takes some seconds, once a driver process.

Defined cases: null or empty html gives the empty text; pages without main blocks give the
empty text; unclosed and stray tags are mended as browsers do in simple cases; repeated rows
give repeated results; pages are read whole: those of more than STRETCH blocks go through the network in stretches
of that length, and each direction carries its state from one to the next. An empty table gives
an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from .common import fresh
from .html_blocks import Leaf, leaf_blocks

PATH_DIMS, WORD_DIMS, SHAPE_DIMS, HIDDEN = 128, 48, 8, 24
INPUT = PATH_DIMS + WORD_DIMS + SHAPE_DIMS
STRETCH, BATCH_CELLS = 8192, 16_384
TRAINING_PAGES, EPOCHS = 2400, 8

_MARKS = re.compile(r"[.,;:!?]")
_DIGITS = re.compile(r"\d")
_PATHS: dict[tuple, np.ndarray] = {}
_BUCKETS: dict[str, int] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    if path not in _PATHS:
        if len(_PATHS) > 20_000:
            _PATHS.clear()
        v = np.zeros(PATH_DIMS, np.float32)
        for token in set(path):
            h = zlib.crc32(token.encode())
            v[h % PATH_DIMS] += 1.0
            v[(h >> 12) % PATH_DIMS] += 1.0  # two places a token make collisions tell less
        _PATHS[path] = np.minimum(v, 2.0)
    return _PATHS[path]


def block_vectors(leaves: list[Leaf], first: int = 0, blocks: int | None = None) -> np.ndarray:
    """One input row for each leaf of a page, or of a stretch of a page of so many blocks that begins at first."""
    n = len(leaves)
    blocks = blocks or n
    x = np.zeros((n, INPUT), np.float32)
    rows, buckets, known = [], [], _BUCKETS
    if len(known) > 200_000:
        known.clear()
    for k, leaf in enumerate(leaves):
        x[k, :PATH_DIMS] = _path_vector(leaf.path)
        words = leaf.text.lower().split()
        for w in words:
            if w not in known:
                known[w] = zlib.crc32(w.strip(".,;:!?()").encode()) % WORD_DIMS
        buckets += [known[w] for w in words]
        rows += [len(words)]
        size = len(leaf.text)
        x[k, PATH_DIMS + WORD_DIMS :] = (
            min(np.log1p(size) / 6, 1.5), min(np.log1p(len(words)) / 5, 1.5), min(leaf.link_chars / size, 1.0), min(10 * len(_MARKS.findall(leaf.text)) / size, 1.0),
            min(5 * len(_DIGITS.findall(leaf.text)) / size, 1.0), (first + k) / blocks, min(len(leaf.path) / 12, 1.5), float(leaf.text[-1] in ".!?\"'"),
        )
    if buckets:
        sizes = np.array(rows)
        flat = np.repeat(np.arange(n), sizes) * WORD_DIMS + np.array(buckets)
        counts = np.bincount(flat, minlength=n * WORD_DIMS).reshape(n, WORD_DIMS)
        x[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = counts / np.sqrt(np.maximum(sizes, 1))[:, None]
    return np.clip(x, -3, 3)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class BiLSTM:
    """Two LSTM directions and a logistic layer over their joined states."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        scaled = lambda a, b: (rng.standard_normal((a, b)) * np.sqrt(1 / a)).astype(np.float32)
        self.w = {f"{name}{d}": value for d in "fb" for name, value in (("x", scaled(INPUT, 4 * HIDDEN)), ("h", scaled(HIDDEN, 4 * HIDDEN)), ("c", np.zeros(4 * HIDDEN, np.float32)))}
        for d in "fb":
            self.w[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        self.w |= {"o": scaled(2 * HIDDEN, 1), "p": np.zeros(1, np.float32)}

    def _direction(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool, carried=None):
        """States of one direction over x (time, page, input) and its last state; finished pages hold their state."""
        steps, pages, _ = x.shape
        gates = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h, c = carried or (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
        states, trace = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = gates[t] + h @ self.w[f"h{d}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            fresh = f * c + i * g
            tanh_c = np.tanh(fresh)
            if keep:
                trace.append((t, h, c, i, f, o, g, tanh_c, m))
            c = m * fresh + (1 - m) * c
            h = m * o * tanh_c + (1 - m) * h
            states[t] = h
        return states, trace, (h, c)

    def predict(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probability of main text, (time, page)."""
        both = np.concatenate([self._direction(x, mask, d, False)[0] for d in "fb"], axis=2)
        return _sigmoid(both @ self.w["o"] + self.w["p"])[:, :, 0]

    def predict_long(self, leaves: list[Leaf]) -> np.ndarray:
        """Probability of main text for each block of one page of any length: two passes, by stretches."""
        n = len(leaves)
        starts = list(range(0, n, STRETCH))
        both = np.zeros((n, 2 * HIDDEN), np.float32)
        for k, d in enumerate("fb"):
            state = None
            for a in starts if d == "f" else reversed(starts):
                x = block_vectors(leaves[a : a + STRETCH], a, n)[:, None]
                states, _, state = self._direction(x, np.ones(x.shape[:2], np.float32), d, False, state)
                both[a : a + STRETCH, k * HIDDEN : (k + 1) * HIDDEN] = states[:, 0]
        return _sigmoid(both @ self.w["o"] + self.w["p"])[:, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        """Gradients of the mean cross entropy, by back-propagation through time."""
        runs = {d: self._direction(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        error = ((_sigmoid(both @ self.w["o"] + self.w["p"])[:, :, 0] - y) * mask / mask.sum())[:, :, None]
        out = {"o": (both.reshape(-1, 2 * HIDDEN).T @ error.reshape(-1, 1)), "p": error.sum((0, 1))}
        into = error @ self.w["o"].T
        for k, d in enumerate("fb"):
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            d_h = np.zeros_like(self.w[f"h{d}"])
            for t, h0, c0, i, f, o, g, tanh_c, m in reversed(runs[d][1]):
                dh = dh + into[t][:, k * HIDDEN : (k + 1) * HIDDEN]
                do = dh * m * tanh_c
                d_fresh = dh * m * o * (1 - tanh_c**2) + dc * m
                dz = np.concatenate([d_fresh * g * i * (1 - i), d_fresh * c0 * f * (1 - f), do * o * (1 - o), d_fresh * i * (1 - g**2)], axis=1)
                dz_all[t] = dz
                d_h += h0.T @ dz
                dh = dh * (1 - m) + dz @ self.w[f"h{d}"].T
                dc = d_fresh * f + dc * (1 - m)
            out |= {f"x{d}": x.reshape(-1, INPUT).T @ dz_all.reshape(-1, 4 * HIDDEN), f"h{d}": d_h, f"c{d}": dz_all.sum((0, 1))}
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), INPUT), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


# --- training pages ---------------------------------------------------------------------------------------

#: Words that name regions in class and id attributes, and words that such regions show.
_REGIONS = {
    "menu": (["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topnav", "site-nav", "main-menu", "toc"], ["Home", "About", "News", "Sports", "Contact", "Login", "Sign in", "Products", "Archive", "FAQ"]),
    "header": (["header", "masthead", "site-header", "top", "branding", "logo", "topbar"], ["Welcome", "Search", "The daily site", "Your account"]),
    "footer": (["footer", "site-footer", "copyright", "legal", "bottom", "colophon"], ["© 2024 All rights reserved", "Privacy policy", "Terms of use", "Imprint", "Powered by"]),
    "side": (["sidebar", "aside", "widget", "related", "recommended", "popular", "trending", "side", "more-stories", "tags", "share", "social"], ["Related articles", "Most read", "Popular posts", "Follow us", "Share this", "Read more", "Tags"]),
    "advert": (["ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "sponsor", "adsense", "promotion"], ["Advertisement", "Sponsored", "Buy now", "Special offer", "Save 50%", "Click here"]),
    "notice": (["cookie", "cookies", "consent", "notice", "alert", "banner", "gdpr", "modal", "popup", "newsletter", "subscribe", "paywall", "disclaimer"], ["We use cookies", "Accept all", "Subscribe to our newsletter", "This site uses cookies to improve your experience.", "Sign up for free"]),
    "form": (["form", "search", "login", "signup", "contact-form", "search-form", "poll"], ["Name", "E-mail", "Send", "Search", "Submit", "Password", "Message"]),
    "comments": (["comments", "comment", "comment-list", "commentlist", "respond", "replies", "discussion", "disqus", "reader-comments", "responses"], ["Reply", "Leave a comment", "3 comments", "says:", "Report", "Like", "Post comment"]),
}
_MAIN_NAMES = ["content", "article", "post", "entry", "entry-content", "post-body", "article-body", "story", "main", "main-content", "text", "body", "story-body", "page-content", "prose"]
_SOUNDS = "an ber ca do el fi gra ho in ka lo mer no or pe qui ra son ti tion th und ver wa ing ou é ch eau ment que ción ado ü sch keit ge".split()


def training_page(rng: random.Random) -> tuple[str, dict[str, int]]:
    """An invented page, and the label of each of its block texts."""
    labels: dict[str, int] = {}
    lexicon = ["".join(rng.choice(_SOUNDS) for _ in range(rng.randint(1, 4))) for _ in range(120)]

    def prose(low: int, high: int, ended: bool = True) -> str:
        words = [rng.choice(lexicon) + ("," if rng.random() < 0.06 else "." if rng.random() < 0.08 else "") for _ in range(rng.randint(low, max(low, high)))]
        return " ".join(words).capitalize() + ("." if ended and rng.random() < 0.9 else "")

    def block(tag: str, text: str, label: int, inner: str = "{}", attributes: str = "") -> str:
        labels[" ".join(text.split())] = label
        close = "" if tag in ("p", "li") and rng.random() < 0.15 else f"</{tag}>"
        return f"<{tag}{attributes}>{inner.format(text)}{close}"

    def named(names: list[str]) -> str:
        kind = rng.choice(["class", "class", "id", "both"])
        one = lambda: rng.choice(names)
        return f' class="{one()}" id="{one()}"' if kind == "both" else f' {kind}="{one()}"'

    def region(kind: str) -> str:
        names, shown = _REGIONS[kind]
        semantic = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind)
        tag = semantic if semantic and rng.random() < 0.7 else rng.choice(["div", "div", "section", "ul" if kind == "menu" else "div"])
        attributes = named(names) if tag in ("div", "section", "ul") or rng.random() < 0.3 else ""
        say = lambda: rng.choice(shown) if rng.random() < 0.35 else prose(1, 3, False)
        if kind == "menu" or kind == "side" and rng.random() < 0.6:
            items = "".join(block("li", say() + f" {rng.randint(0, 999)}" * (rng.random() < 0.3), 0, '<a href="/x">{}</a>') for _ in range(rng.randint(3, 9)))
            inner = items if tag == "ul" else f"<ul>{items}</ul>"
        elif kind == "form":
            inner = "".join(rng.choice(["<label>{}</label><input>", "<p>{}</p>", "<button>{}</button>"]).format(t) for t in [say() for _ in range(rng.randint(1, 4))])
            inner = f"<p>{inner}</p>" if "<p>" not in inner else inner
        elif kind == "comments":
            inner = block("h3", rng.choice(shown), 0)
            for _ in range(rng.randint(1, 6)):
                person = block("p", prose(1, 2, False), 0) if rng.random() < 0.5 else ""
                said = block("p", prose(4, 60), 0)
                inner += f"<{rng.choice(['li', 'div', 'article'])}{named(_REGIONS['comments'][0])}>{person}{said}</div>" if rng.random() < 0.7 else person + said
        elif kind in ("advert", "notice", "footer", "header"):
            texts = [(say() if rng.random() < 0.5 else prose(4, 25)) for _ in range(rng.randint(1, 3))]
            if rng.random() < 0.5:
                inner = texts[0]
                if kind == "footer" and rng.random() < 0.6:
                    inner = f"&copy; {rng.choice(lexicon)}.example &middot; {inner}"
                labels[" ".join(html.unescape(inner).split())] = 0
            else:
                inner = "".join(block("p", t, 0) for t in texts)
        else:
            inner = "".join(block("p", prose(2, 25), 0) for _ in range(rng.randint(1, 3)))
        return f"<{tag}{attributes}>{inner}</{tag}>"

    main = []
    if rng.random() < 0.9:
        main.append(block(rng.choice(["h1", "h1", "h2"]), prose(3, 12, rng.random() < 0.5), 1))
    for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 10, 16])):
        kind = rng.random()
        if kind < 0.78:
            main.append(block("p", prose(rng.choice([1, 2, 8]), rng.choice([4, 30, 90])), 1, rng.choice(["{}", "{}", "{}", "<b>{}", "<b>{}</b>", "<b>{}<br>", '<a href="/y">{}</a>', "{}<br>"])))
        elif kind < 0.84:
            main.append(block(rng.choice(["h2", "h3"]), prose(2, 7, False), 1))
        elif kind < 0.9:
            main.append("<ul>" + "".join(block("li", prose(2, 15, False), 1) for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind < 0.92:
            main.append(block("blockquote", prose(5, 40), 1))
        elif kind < 0.94:
            main.append("<table><tr>" + "".join(block("td", prose(1, 4, False), 1) for _ in range(rng.randint(2, 4))) + "</tr></table>")
        elif len(main) > 1:
            main.append(region(rng.choice(["advert", "side", "notice", "form"])))
    wrap = rng.random()
    tag = "article" if wrap < 0.5 else "main" if wrap < 0.65 else "div" if wrap < 0.92 else ""
    attributes = named(_MAIN_NAMES) if tag == "div" or rng.random() < 0.25 else ""
    body = f"<{tag}{attributes}>{''.join(main)}</{tag}>" if tag else "".join(main)
    if rng.random() < 0.25:
        body = f"<main>{body}</main>" if tag == "article" else f'<div class="wrapper">{body}</div>'
    before = [region(k) for k in ("notice", "header", "menu", "advert", "form") if rng.random() < 0.5]
    rng.shuffle(before)
    after = [region(k) for k in ("comments", "side", "advert", "form", "notice", "menu") if rng.random() < 0.4]
    rng.shuffle(after)
    if rng.random() < 0.75:
        after.append(region("footer"))
    tail = "</body></html>" if rng.random() < 0.8 else ""
    return f"<!DOCTYPE html><html><head><title>{prose(3, 8)}</title><style>p{{margin:0}}</style></head><body>{''.join(before)}{body}{''.join(after)}{tail}", labels


def training_set(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Block vectors and labels of n invented pages."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        page, labels = training_page(rng)
        leaves = leaf_blocks(page)
        if leaves:
            out.append((block_vectors(leaves), np.array([labels.get(x.text, 0) for x in leaves], np.float32)))
    return out


def train(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = 11, batch: int = 64, rate: float = 0.006) -> BiLSTM:
    """Fit the network by Adam on invented pages; the same seed gives the same network."""
    data, model, rng = training_set(pages, seed), BiLSTM(), random.Random(seed)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step, total = 0, epochs * ((pages + batch - 1) // batch)
    for _ in range(epochs):
        rng.shuffle(data)
        for k in range(0, len(data), batch):
            part = sorted(data[k : k + batch], key=lambda d: len(d[0]))
            x, mask = _padded([d[0] for d in part])
            y = np.zeros(mask.shape, np.float32)
            for j, d in enumerate(part):
                y[: len(d[1]), j] = d[1]
            step += 1
            pace = rate * (1 - 0.9 * step / total)
            for name, g in model.gradients(x, mask, y).items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                model.w[name] -= (pace * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


_TRAINED: list[BiLSTM] = []


def default_model() -> BiLSTM:
    """The network of the default parameters, trained once a process."""
    if not _TRAINED:
        _TRAINED.append(train())
    return _TRAINED[0]


# --- extraction -------------------------------------------------------------------------------------------


def label_pages(pages: list[list[Leaf]], model: BiLSTM) -> list[np.ndarray]:
    """Probability of main text for each block of each page, in bounded batches of pages alike in length."""
    out = [np.zeros(len(p), np.float32) for p in pages]
    order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
    while order and len(pages[order[-1]]) > STRETCH:
        k = order.pop()
        out[k] = model.predict_long(pages[k])
    at = 0
    while at < len(order):
        group = order[at : at + 1]
        while at + len(group) < len(order) and len(pages[order[at + len(group)]]) * (len(group) + 1) <= BATCH_CELLS:
            group.append(order[at + len(group)])
        at += len(group)
        found = model.predict(*_padded([block_vectors(pages[k]) for k in group]))
        for j, k in enumerate(group):
            out[k] = found[: len(pages[k]), j]
    return out


def main_texts(pages: list[str | None], model: BiLSTM, level: float = 0.5) -> list[str]:
    """Main text of each page: its main blocks in page order, one a line."""
    leaves = [leaf_blocks(p or "") for p in pages]
    chances = label_pages(leaves, model)
    return ["\n".join(x.text for x, c in zip(own, p, strict=True) if c >= level) for own, p in zip(leaves, chances, strict=True)]


def extract(pages: DataFrame, model: BiLSTM | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), level: float = 0.5) -> DataFrame:
    """keep and text (main text) of every page."""
    ship_package(pages.sparkSession)
    weights = (model or default_model()).w
    names, given = [*keep, "text"], fresh("page", pages.select(*keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = BiLSTM()
        net.w = weights
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = main_texts(part.column(given).to_pylist(), net, level)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], names=names)

    rows = pages.select(*keep, F.col(html_col).alias(given))
    schema = rows.select(*keep).schema.add("text", "string")
    return rows.mapInArrow(run, schema)
