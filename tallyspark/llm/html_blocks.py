"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: the text between two block-level tags, with
the path of open elements above it. A bidirectional LSTM in numpy reads for each block the
hashed elements of its path, its hashed words and a few counts, and says for every block
whether it belongs to the article, so a block is judged in the context of the whole page.

Training. There are no labelled pages, so the labels come from markup: on a bounded sample
(``TRAIN_PAGES``) blocks below article or main and not below nav, aside, form and the like count
as text. From the sentences of these pages other pages are laid out whose labels are known
and whose article often has no telling name, with menus, notices, adverts, forms and reader
comments around and inside it, so the model cannot lean on one element alone.

Defined results: null and empty pages, and pages without a block of text, give an empty text;
an unclosed element ends with its parent, and what follows an unclosed frame, image, list or other
element that is not read is read; repeated rows give repeated results; very long pages
are read whole, a page at a time; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_batches, remembered

#: Pages that the labels are taken from; pages are chosen by the hash of their id.
TRAIN_PAGES, LAID_OUT, EPOCHS = 200, 300, 6
#: Longest page to learn from, in bytes, and longest sentence of the pages laid out anew.
TRAIN_BYTES, SENTENCE_WORDS = 1 << 20, 40
PATHS, WORDS, DIM, HIDDEN, COUNTS = 1 << 10, 1 << 12, 12, 16, 6

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)
    |(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>
    |[!?][^>]*+>)""", re.S | re.X)
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark "
             "nobr q ruby s samp small span strike strong sub sup time tt u var wbr "
             "math mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext "
             "munder munderover semantics".split())
#: Text to its end tag, whatever stands in it; and elements that are left out if they have one.
RAW = set("script style title textarea".split())
UNREAD = set("noscript template iframe object svg select canvas audio video".split())
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of this name ends an open element of these names.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

KEEP = re.compile(r"^(article|main)$")
DROP = re.compile(r"^(nav|aside|footer|header|form|menu|dialog|button|label|fieldset)$")
DROP_NAMES = re.compile(r"(^|[-_])(ads?|advert\w*|banner|cookies?|consent|notice|alert|comments?|"
                        r"replies|sidebar|menu|nav|footer|header|share|social|related|promo|"
                        r"newsletter|subscribe|breadcrumbs?|sponsor\w*)($|[-_])", re.I)


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, path: tuple, text: str, linked: int) -> None:
        self.path, self.text, self.linked = path, text, linked


def names_of(tag: str, attrs: str) -> tuple[str, ...]:
    """The tag and its classes, id and role."""
    if "=" not in attrs:
        return (tag,)
    found = [tag]
    for kind, *values in ATTR.findall(attrs):
        mark = {"class": ".", "id": "#", "role": "@"}[kind.lower()]
        found += [mark + x.lower() for x in "".join(values).split()]
    return tuple(found)


def ends_of(page: str) -> dict[int, int]:
    """Where the elements that are not read end, by where their start tags end; those that are
    still open when their parent or the page ends are not here."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    opened: Counter = Counter()
    at = 0
    while m := TAG.search(page, at):
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name or name in INLINE or name in EMPTY:
            continue
        if m["end"] or m["end2"]:
            if opened[name]:
                while True:
                    last, start = stack.pop()
                    opened[last] -= 1
                    if last == name:
                        break
                if name in UNREAD:
                    out[start] = at
        elif not (m["attrs"] or m["attrs2"] or "").endswith("/"):
            if name in RAW:
                at = raw_end(page, name, at)
            else:
                stack.append((name, at))
                opened[name] += 1
    return out


def raw_end(page: str, name: str, at: int) -> int:
    end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
    return end.end() if end else len(page)


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks that have text, in page order."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, ...]] = []
    held: list[str] = []
    linked = at = 0
    in_link = False
    ends: dict[int, int] | None = None

    def close() -> None:
        nonlocal linked
        if held:
            raw = "".join(held)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(tuple(stack), text, linked))
            held.clear()
        linked = 0

    while True:
        m = TAG.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        if text:
            held.append(text)
            linked += len(text) * in_link
        if m is None:
            break
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        start = not (m["end"] or m["end2"])
        attrs = m["attrs"] or m["attrs2"] or ""
        if name in RAW:
            close()
            if start and not attrs.endswith("/"):
                at = raw_end(page, name, at)
        elif name in UNREAD or name == "head":
            # A head's end tag may be missing; what is not read in it are its elements.
            close()
            if start and name in UNREAD:
                ends = ends_of(page) if ends is None else ends
                at = ends.get(at, at)
        elif name in INLINE:
            if name == "a":
                in_link = start
            elif name in ("br", "img"):
                held.append(" ")
        else:
            close()
            if start:
                gone = ENDS.get(name, ()) if stack else ()
                while stack and (stack[-1][0] == "p" or stack[-1][0] in gone):
                    stack.pop()
                if name not in EMPTY:
                    stack.append(names_of(name, attrs))
            elif any(x[0] == name for x in stack):
                while stack.pop()[0] != name:
                    pass
    close()
    return out


class Buckets(dict):
    def __init__(self, size: int, limit: int = 250_000) -> None:
        super().__init__()
        self.size, self.limit = size, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = zlib.crc32(word.encode(errors="replace")) % self.size
        return value


#: Hashes met so far; a Python worker keeps them from task to task.
PATH_BUCKETS, WORD_BUCKETS = Buckets(PATHS), Buckets(WORDS)
remembered(__name__, WORD_BUCKETS.clear)


def features(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray,
                                            np.ndarray]:
    """Path buckets and their starts, word buckets and their starts, counts, over all blocks."""
    paths, path_at, words, word_at, counts = [], [], [], [], []
    known: dict[tuple, list[int]] = {}
    for b in blocks:
        path_at.append(len(paths))
        word_at.append(len(words))
        if b.path not in known:
            # Each name alone, and the innermost element's once more.
            known[b.path] = [PATH_BUCKETS[x] for e in b.path for x in e] + [
                PATH_BUCKETS["^" + x] for e in b.path[-1:] for x in e] or [0]
        paths += known[b.path]
        mine = b.text.split(" ")
        words += map(WORD_BUCKETS.__getitem__, mine)
        n = len(mine)
        counts.append((np.log1p(n) / 4, b.linked / max(1, len(b.text)),
                       float(b.text[-1] in ".!?…"), len(b.text) / n / 8, len(b.path) / 8, 1.0))
    return (np.array(paths), np.array(path_at), np.array(words), np.array(word_at),
            np.array(counts, np.float32).reshape(-1, COUNTS))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings, two LSTMs and a logistic unit; weights in ``w``, all float32."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        size = 2 * DIM + COUNTS

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.w = {"path": normal(PATHS, DIM, scale=0.3), "word": normal(WORDS, DIM, scale=0.3),
                  "out": normal(2 * HIDDEN, scale=0.2), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.w[side + "x"] = normal(size, 4 * HIDDEN, scale=size ** -0.5)
            self.w[side + "h"] = normal(HIDDEN, 4 * HIDDEN, scale=HIDDEN ** -0.5)
            self.w[side + "c"] = np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)

    def inputs(self, feats: tuple) -> np.ndarray:
        paths, path_at, words, word_at, counts = feats
        parts = []
        for name, ids, at in (("path", paths, path_at), ("word", words, word_at)):
            n = np.diff(np.append(at, len(ids)))[:, None].astype(np.float32)
            parts.append(np.add.reduceat(self.w[name][ids], at, axis=0) / n)
        return np.concatenate([*parts, counts], axis=1)

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray,
             learn: bool = True) -> tuple[np.ndarray, list]:
        """States of one direction over x (steps, pages, size), and what training needs of it."""
        steps, pages, _ = x.shape
        pre = x @ self.w[side + "x"] + self.w[side + "c"]
        h = np.zeros((pages, HIDDEN), np.float32)
        c = np.zeros_like(h)
        states, kept = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.w[side + "h"]
            i, f, o = (sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            new_c = f * c + i * g
            tanh_c = np.tanh(new_c)
            on = mask[t][:, None]
            if learn:
                kept.append((t, h, c, i, f, o, g, tanh_c))
            c = np.where(on, new_c, c)
            h = np.where(on, o * tanh_c, h)
            states[t] = h
        return states, kept

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        ends = [self._run(side, x, mask, learn=False)[0] for side in "fb"]
        return np.concatenate(ends, axis=2) @ self.w["out"] + self.w["bias"]

    def gradients(self, feats: tuple, rows: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        """Gradients of the mean log loss; ``rows`` places the blocks in (steps, pages)."""
        flat = self.inputs(feats)
        x = np.where(mask[:, :, None], flat[rows], 0).astype(np.float32)
        runs = {side: self._run(side, x, mask) for side in "fb"}
        both = np.concatenate([runs[s][0] for s in "fb"], axis=2)
        p = sigmoid(both @ self.w["out"] + self.w["bias"])
        d = np.where(mask, p - y, 0).astype(np.float32) / mask.sum()
        grads = {"out": np.tensordot(d, both, ((0, 1), (0, 1))),
                 "bias": np.array([d.sum()], np.float32)}
        dx = np.zeros_like(x)
        for k, side in enumerate("fb"):
            d_states = d[:, :, None] * self.w["out"][k * HIDDEN:(k + 1) * HIDDEN]
            wx, wh = self.w[side + "x"], self.w[side + "h"]
            gx, gh = np.zeros_like(wx), np.zeros_like(wh)
            gc = np.zeros(4 * HIDDEN, np.float32)
            dh, dc = np.zeros_like(d_states[0]), np.zeros_like(d_states[0])
            for t, h, c, i, f, o, g, tanh_c in reversed(runs[side][1]):
                on = mask[t][:, None]
                total = dh + d_states[t]
                d_c = np.where(on, dc + total * o * (1 - tanh_c ** 2), 0)
                z = np.concatenate([d_c * g * i * (1 - i), d_c * c * f * (1 - f),
                                    np.where(on, total * tanh_c, 0) * o * (1 - o),
                                    d_c * i * (1 - g ** 2)], axis=1)
                gx += x[t].T @ z
                gh += h.T @ z
                gc += z.sum(0)
                dx[t] += z @ wx.T
                dh = np.where(on, z @ wh.T, total)
                dc = np.where(on, d_c * f, dc)
            grads |= {side + "x": gx, side + "h": gh, side + "c": gc}
        d_flat = np.zeros_like(flat)
        d_flat[rows[mask]] = dx[mask]
        paths, path_at, words, word_at, _ = feats
        for name, ids, at, part in (("path", paths, path_at, d_flat[:, :DIM]),
                                    ("word", words, word_at, d_flat[:, DIM:2 * DIM])):
            n = np.diff(np.append(at, len(ids)))
            grads[name] = np.zeros_like(self.w[name])
            np.add.at(grads[name], ids, np.repeat(part / n[:, None], n, axis=0))
        return grads

    def fit(self, pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS,
            rate: float = 0.01, batch: int = 16, seed: int = 7) -> None:
        """Adam over batches of pages of like length."""
        order = random.Random(seed)
        ready = sorted((p for p in pages if p[0]), key=lambda p: len(p[0]))
        batches = []
        for k in range(0, len(ready), batch):
            some = ready[k:k + batch]
            rows, mask = layout([len(b) for b, _ in some])
            y = np.zeros(mask.shape, np.float32)
            y.T[mask.T] = [v for _, labels in some for v in labels]
            batches.append((features([x for b, _ in some for x in b]), rows, mask, y))
        m1 = {k: np.zeros_like(v) for k, v in self.w.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for _ in range(epochs):
            order.shuffle(batches)
            for one in batches:
                step += 1
                for k, g in self.gradients(*one).items():
                    m1[k] += 0.1 * (g - m1[k])
                    m2[k] += 0.001 * (g * g - m2[k])
                    self.w[k] -= (rate * (m1[k] / (1 - 0.9 ** step))
                                  / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)

    def keep(self, pages: list[list[Block]], most: int = 40_000) -> list[list[bool]]:
        """For every page, which of its blocks are main text. Pages of like length go together,
        ``most`` places at a time at most unless one page has more."""
        out: list[list[bool]] = [[] for _ in pages]
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        while order:
            n = max(1, most // len(pages[order[-1]]))
            some, order = order[-n:], order[:-n]
            rows, mask = layout([len(pages[k]) for k in some])
            flat = self.inputs(features([b for k in some for b in pages[k]]))
            good = self.scores(flat[rows], mask) > 0
            for j, k in enumerate(some):
                out[k] = good[:len(pages[k]), j].tolist()
        return out


def layout(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where in the flat list of blocks each (step, page) lies, and which of them exist."""
    starts = np.cumsum([0, *lengths[:-1]])
    steps = np.arange(max(lengths))[:, None]
    mask = steps < np.array(lengths)[None, :]
    return np.where(mask, starts[None, :] + steps, 0), mask


def label_by_markup(blocks: list[Block]) -> list[int]:
    """1 below article or main, unless something between says otherwise."""
    out = []
    for b in blocks:
        inside = False
        for e in b.path:
            if KEEP.match(e[0]) or "@main" in e:
                inside = True
            elif DROP.match(e[0]) or any(DROP_NAMES.search(x[1:]) for x in e[1:]):
                inside = False
        out.append(int(inside))
    return out


def laid_out(sentences: list[str], rng: random.Random) -> tuple[list[Block], list[int]]:
    """A page of given sentences in a random layout, with its labels (``keep`` marks text)."""
    def some(low: int, high: int) -> str:
        return html.escape(" ".join(rng.choice(sentences) for _ in range(rng.randint(low, high))))

    def few(n: int = 3) -> str:
        return html.escape(" ".join(some(1, 1).split()[:rng.randint(1, n)]))

    def links() -> str:
        return "<ul>" + "".join(f"<li><a href='/x'>{few()}</a></li>"
                                for _ in range(rng.randint(3, 9))) + "</ul>"

    def wrapped(tag: str, names: list[str], inner: str) -> str:
        kind = rng.choice(["class", "id"])
        name = rng.choice(names)
        return f"<{tag} {kind}='{name}'>{inner}</{tag}>"

    def extra(kind: str) -> str:
        if kind == "menu":
            return rng.choice([f"<nav>{links()}</nav>", wrapped("div", ["menu", "nav", "navbar"], links())])
        if kind == "header":
            inner = f"<h2>{few()}</h2><p>{few(6)}</p>"
            return rng.choice([f"<header>{inner}</header>", wrapped("div", ["header", "masthead"], inner)])
        if kind == "aside":
            inner = f"<h3>{few()}</h3><p>{some(1, 2)}</p>{links()}"
            return rng.choice([f"<aside>{inner}</aside>", wrapped("div", ["sidebar", "related"], inner)])
        if kind == "notice":
            return wrapped("div", ["notice", "cookie", "consent", "alert", "cookie-notice"],
                           f"<p>{some(1, 2)}</p><button>{few()}</button>")
        if kind == "ad":
            return wrapped("div", ["ad", "ads", "advert", "sponsored", "promo", "banner"], some(1, 2))
        if kind == "form":
            return f"<form><p>{some(1, 1)}</p><label>{few()}</label><input><button>{few()}</button></form>"
        if kind == "comments":
            inner = "".join(wrapped("div", ["comment", "reply"], f"<b>{few()}</b><p>{some(1, 3)}</p>")
                            for _ in range(rng.randint(1, 4)))
            return wrapped(rng.choice(["div", "section", "ol"]), ["comments", "replies", "comment-list"],
                           f"<h3>{few()}</h3>{inner}")
        inner = f"{some(1, 1)} {links() if rng.random() < .3 else ''}"
        return rng.choice([f"<footer>{inner}</footer>", wrapped("div", ["footer"], inner)])

    body = [f"<h1>{few(9)}</h1>"]
    for _ in range(rng.randint(1, 14)):
        tag = rng.choice(["p"] * 8 + ["h2", "blockquote", "li", "pre", "div"])
        body.append(f"<{tag}>{some(1, 6)}</{tag}>")
    for kind in ("ad", "aside", "comments", "form", "menu", "notice"):
        if rng.random() < 0.12:
            inner = re.sub(r"<(\w+)", r"<\1 role='drop'", extra(kind), count=1)
            body.insert(rng.randint(1, len(body)) if kind != "comments" else len(body), inner)
    tag = rng.choice(["article role='keep'"] * 4 + ["main role='keep'"] * 2 + [
        f"div class='{x}' role='keep'" for x in (
            "content", "post", "entry-content", "article-body", "story", "text")] + [
        "div role='keep'", "section role='keep'"])
    main = f"<{tag}>{''.join(body)}</{tag.split()[0]}>"
    before = [extra(k) for k in ("header", "menu", "notice", "ad", "aside") if rng.random() < 0.5]
    after = [extra(k) for k in ("comments", "aside", "ad", "form", "notice", "footer", "footer")
             if rng.random() < 0.45]
    blocks = blocks_of("<body>" + "".join(before) + main + "".join(after) + "</body>")
    labels = []
    for b in blocks:
        roles = [x for e in b.path for x in e if x in ("@keep", "@drop")]
        labels.append(int(bool(roles) and roles[-1] == "@keep"))
        b.path = tuple(tuple(x for x in e if x not in ("@keep", "@drop")) for e in b.path)
    return blocks, labels


def train(pages: list[str], laid: int = LAID_OUT, epochs: int = EPOCHS, seed: int = 7) -> Labeller:
    """A labeller from sampled pages: their own labels by markup, and pages laid out anew."""
    rng = random.Random(seed)
    parsed = [blocks_of(p) for p in pages]
    known = [(b, y) for b, y in ((b, label_by_markup(b)) for b in parsed) if any(y)]
    # A text without marks is no sentence: drawn again and again, it would be most of the work.
    sentences = [" ".join(words[k:k + SENTENCE_WORDS]) for b in parsed for x in b
                 for words in (s.split(" ") for s in re.split(r"(?<=[.!?]) ", x.text))
                 for k in range(0, len(words), SENTENCE_WORDS)][:20_000]
    sentences = sentences or ["Nothing to read."]
    model = Labeller(seed)
    model.fit(known + [laid_out(sentences, rng) for _ in range(laid)], epochs)
    return model


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", body: str = "html",
            model: Labeller | None = None, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """Per page: page_id, url, text and n_chars, its blocks of main text, one a line."""
    base = pages.select(column(pages, id, "long").alias("page_id"),
                        column(pages, url, "string").alias("url"),
                        column(pages, body, "string").alias("body"))
    if model is None:
        # Ids first, so that no task sends pages that are not chosen; then their pages, in the
        # same order. ``train_pages`` of both come to the driver, whatever the table's size.
        known = base.where("body is not null and page_id is not null").where(
            F.octet_length("body") <= TRAIN_BYTES)
        chosen = (known.select("page_id", F.xxhash64("page_id").alias("drawn")).distinct()
                  .orderBy("drawn", "page_id").limit(train_pages).collect())
        sample = known.where(F.col("page_id").isin([r["page_id"] for r in chosen])).select(
            "page_id", "body").orderBy("page_id", "body").limit(train_pages).collect()
        model = train([r["body"] for r in sample])

    def work(ids, urls, bodies):
        for k in range(0, len(ids), 512):
            parsed = [blocks_of(b) for b in bodies[k:k + 512]]
            texts = ["\n".join(b.text for b, good in zip(blocks, keep, strict=True) if good)
                     for blocks, keep in zip(parsed, model.keep(parsed), strict=True)]
            yield [ids[k:k + 512], urls[k:k + 512], texts, [len(t) for t in texts]]

    return map_batches(base, work, "page_id long, url string, text string, n_chars long")
