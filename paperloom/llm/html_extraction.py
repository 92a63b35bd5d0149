"""HTML extraction: a recurrent labeller decides for every block of a page whether it is main text.

A page becomes the sequence of its leaf blocks: texts between block-level tags, each with its tag path (tags,
classes, ids, roles). A block's vector holds its hashed path, its hashed words and a few shape values (length,
share of linked text, place). A bidirectional LSTM in numpy (as in Leonhardt and others 2020) reads the sequence both
ways, so each block is judged with the whole page around it.

The model is trained here, on at most ``TRAIN_PAGES`` pages of at most ``TRAIN_BYTES`` each (the smallest by the hash of
their id). Their labels come from the pages' own markup: blocks inside ``article`` or ``main`` that no element of
another role encloses are main text. Each page is seen as it is and in variants with other containers, names and
added side blocks, so that the model learns roles beyond one page layout. The weights are a few tens of kB
and are broadcast; pages are labelled in place, in batches, without any shuffle.

Defined cases: null or empty html has an empty text; broken markup is read as far as it goes; scripts, styles and other
raw content are never blocks; repeated rows are labelled each; an empty table gives an empty result; very long
pages are one sequence; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import CACHE_ENTRIES, slices, texts

TRAIN_PAGES = 192
TRAIN_BYTES = 100_000
VARIANTS = 3
EPOCHS = 6
HIDDEN = 24
PATH_SIZE, WORD_SIZE, SHAPE = 64, 32, 4
SIZE = PATH_SIZE + WORD_SIZE + SHAPE
# Blocks that are labelled together.
GROUP_BLOCKS = 8192
# A container goes on to the next inner one that keeps this share of its text.
MOST_TEXT = 0.8
# Where the labeller keeps nothing, text of so many characters in one container is taken for the article.
FALLBACK_CHARS = 200

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z!?][^>]*(?:>|\Z)", re.DOTALL
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg"}
# Lists of choices, whose texts are no blocks, and what may stand in one whose end tag is missing.
_CHOICES = {"select", "datalist"}
_IN_CHOICES = {"option", "optgroup", "hr", "label", *_CHOICES}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
    "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
_CLOSED_BY_BLOCK = {"p"}
_SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

Block = tuple[tuple[str, ...], str, float]  # path, text, share of linked characters


def _names(tag: str, attributes: str) -> str:
    """An element's name in a path: its tag and the words of its class, id and role."""
    if "=" not in attributes:
        return tag
    found = (v.strip("\"'").lower() for _, v in _ATTRIBUTE.findall(attributes))
    return " ".join([tag, *(w for v in found for w in re.split(r"[^a-z]+", v) if w)])


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[str] = []
    parts: list[str] = []
    linked, in_link, at, choices = 0, 0, 0, ""

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((tuple(stack), text, min(1.0, linked / len(text))))
        parts, linked = [], 0

    def drop(names: set[str], limit: int = 1) -> None:
        for k in range(len(stack) - 1, max(-1, len(stack) - 1 - limit), -1):
            if stack[k].split(" ", 1)[0] in names:
                del stack[k:]
                return

    for m in _TAG.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at and not choices:
            parts.append(html[at : m.start()])
            linked += (m.start() - at) if in_link else 0
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if choices:
            if m[1] and tag == choices:
                choices = ""
                continue
            inner = not any(n.split(" ", 1)[0] == tag for n in stack) if m[1] else tag in _INLINE | _IN_CHOICES
            if inner:
                continue
            if tag not in _RAW:
                choices = ""
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if m[1] else 1
            continue
        close()
        in_link = 0
        if m[1]:
            drop({tag}, len(stack))
        elif tag in _RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
        elif tag in _CHOICES and not m[3].endswith("/"):
            end = re.compile(rf"<(/?){tag}\b[^>]*>", re.IGNORECASE).search(html, at)
            if end and end[1]:
                at = end.end()
            else:
                choices = tag
        elif tag == "option":
            choices = tag
        elif tag not in _VOID:
            drop(_CLOSED_BY_BLOCK)
            drop(_SELF_CLOSING.get(tag, set()))
            stack.append(_names(tag, m[3]))
    if at < len(html) and not choices:
        parts.append(html[at:])
    close()
    return out


class Vectors(dict):
    """Hashed places of path names and words, computed once per distinct one."""

    def __missing__(self, token: str) -> int:
        value = self[token] = crc32(token.encode("utf-8", "replace")) & 0x7FFFFFFF
        return value

    def of(self, page: list[Block], first: int = 0, last: int | None = None) -> np.ndarray:
        """One row per block, of all blocks or of some."""
        if len(self) > CACHE_ENTRIES:
            self.clear()
        chosen = page[first:last]
        out = np.zeros((len(chosen), SIZE), np.float32)
        place = self.__getitem__
        for k, (path, text, linked) in enumerate(chosen):
            for token in {t for name in path for t in name.split(" ")}:
                h = place(token)
                out[k, h % PATH_SIZE] += 1.0 if h >> 16 & 1 else -1.0
            words = text.split(" ")
            hit = np.bincount(np.fromiter(map(place, words), np.int64, len(words)) % WORD_SIZE, minlength=WORD_SIZE)
            out[k, PATH_SIZE : PATH_SIZE + WORD_SIZE] = hit / len(words)
            out[k, -SHAPE:] = (np.log1p(len(text)) / 8, linked, (first + k) / len(page), len(path) / 8)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output per block."""

    def __init__(self, seed: int = 1, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        near = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.hidden = hidden
        self.weights = {f"{k}{d}": near(*s) for d in "fb" for k, s in (("x", (SIZE, 4 * hidden)), ("h", (hidden, 4 * hidden)))}
        for d in "fb":
            self.weights[f"c{d}"] = np.zeros(4 * hidden, np.float32)
            self.weights[f"c{d}"][hidden : 2 * hidden] = 1
        self.weights |= {"o": near(2 * hidden, 1), "p": np.zeros(1, np.float32)}

    def _read(self, x: np.ndarray, d: str, keep: bool = True, state: tuple | None = None) -> tuple[np.ndarray, list, tuple]:
        """Outputs of one direction over (time, page, value), what training needs of each step, and the state to go on from."""
        w, n = self.weights, self.hidden
        h, c = np.zeros((2, x.shape[1], n), np.float32) if state is None else state
        given = x @ w[f"x{d}"] + w[f"c{d}"]
        out, steps = np.zeros((*x.shape[:2], n), np.float32), []
        for t in range(len(x)):
            z = given[t] + h @ w[f"h{d}"]
            i, f, o = _sigmoid(z[:, :n]), _sigmoid(z[:, n : 2 * n]), _sigmoid(z[:, 2 * n : 3 * n])
            g = np.tanh(z[:, 3 * n :])
            before, old = h, c
            c = f * old + i * g
            s = np.tanh(c)
            h = out[t] = o * s
            if keep:
                steps.append((i, f, o, g, s, before, old))
        return out, steps, (h, c)

    def _learn(self, x: np.ndarray, d: str, steps: list, dout: np.ndarray, grad: dict) -> None:
        """Gradients of one direction, back through time."""
        w, n = self.weights, self.hidden
        dh, dc = np.zeros((2, x.shape[1], n), np.float32)
        dz = np.zeros((*x.shape[:2], 4 * n), np.float32)
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g, s, before, old = steps[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - s * s)
            dz[t] = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)], 1)
            grad[f"h{d}"] += before.T @ dz[t]
            dh, dc = dz[t] @ w[f"h{d}"].T, dc * f
        grad[f"x{d}"] += np.tensordot(x, dz, ((0, 1), (0, 1)))
        grad[f"c{d}"] += dz.sum((0, 1))

    @staticmethod
    def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pages side by side: (time, page, value) forward, each page reversed, and which cells are blocks."""
        size = np.array([len(p) for p in pages])
        x = np.zeros((2, size.max(), len(pages), pages[0].shape[1]), np.float32)
        for k, p in enumerate(pages):
            x[0, : len(p), k], x[1, : len(p), k] = p, p[::-1]
        return x[0], x[1], np.arange(size.max())[:, None] < size

    def _both(self, pages: list[np.ndarray], keep: bool = True) -> tuple:
        x, back, real = self._padded(pages)
        f, steps_f, _ = self._read(x, "f", keep)
        b, steps_b, _ = self._read(back, "b", keep)
        turned = np.zeros_like(b)
        for k, p in enumerate(pages):
            turned[: len(p), k] = b[: len(p), k][::-1]
        both = np.concatenate([f, turned], 2)
        score = _sigmoid((both @ self.weights["o"])[..., 0] + self.weights["p"])
        return x, back, real, steps_f, steps_b, both, score

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page, which blocks are main text."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            longest = len(pages[order[-1]])
            group = order[-max(1, GROUP_BLOCKS // longest) :]
            del order[-len(group) :]
            score = self._both([pages[k] for k in group], keep=False)[-1]
            for j, k in enumerate(group):
                out[k] = score[: len(pages[k]), j] > 0.5
        return out

    def label_long(self, n: int, rows: Callable[[int, int], np.ndarray]) -> np.ndarray:
        """As `label` for one page of ``n`` blocks whose vectors come in windows; the state is carried from one to the next."""
        edges = [(a, min(n, a + GROUP_BLOCKS)) for a in range(0, n, GROUP_BLOCKS)]
        ahead, out, state = np.zeros((n, self.hidden), np.float32), np.zeros(n, bool), None
        for a, b in edges:
            read, _, state = self._read(rows(a, b)[:, None], "f", False, state)
            ahead[a:b] = read[:, 0]
        state = None
        for a, b in reversed(edges):
            behind, _, state = self._read(rows(a, b)[::-1][:, None], "b", False, state)
            both = np.concatenate([ahead[a:b], behind[::-1, 0]], 1)
            out[a:b] = _sigmoid((both @ self.weights["o"])[:, 0] + self.weights["p"]) > 0.5
        return out

    def fit(self, pages: list[np.ndarray], truth: list[np.ndarray], epochs: int = EPOCHS, seed: int = 2) -> float:
        """Adam on mean log loss; gives the last epoch's share of right labels."""
        rng, rate = np.random.default_rng(seed), 0.01
        m, v = ({k: np.zeros_like(w) for k, w in self.weights.items()} for _ in range(2))
        step, right = 0, 0.0
        for _ in range(epochs):
            good = total = 0
            order = rng.permutation(len(pages))
            for at in range(0, len(order), 16):
                own = [k for k in order[at : at + 16] if len(pages[k])]
                if not own:
                    continue
                x, back, real, steps_f, steps_b, both, score = self._both([pages[k] for k in own])
                want = np.zeros(real.shape, np.float32)
                for j, k in enumerate(own):
                    want[: len(truth[k]), j] = truth[k]
                good += int((((score > 0.5) == want) & real).sum())
                total += int(real.sum())
                dscore = (score - want) * real / real.sum()
                grad = {k: np.zeros_like(w) for k, w in self.weights.items()}
                grad["o"] = np.tensordot(both, dscore, ((0, 1), (0, 1)))[:, None]
                grad["p"] = dscore.sum(keepdims=True).ravel()
                dboth = dscore[..., None] * self.weights["o"][:, 0]
                turned = np.zeros_like(dboth[..., self.hidden :])
                for j, k in enumerate(own):
                    turned[: len(pages[k]), j] = dboth[: len(pages[k]), j, self.hidden :][::-1]
                self._learn(x, "f", steps_f, dboth[..., : self.hidden], grad)
                self._learn(back, "b", steps_b, turned, grad)
                step += 1
                for k, g in grad.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.weights[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            right = good / max(1, total)
        return right


# Roles that markup may give an element by tag, class, id or role.
_MAIN = {"article", "main"}
_SIDE = {
    "nav", "aside", "footer", "header", "form", "menu", "sidebar", "ad", "ads", "advert", "banner", "promo", "sponsor",
    "notice", "cookie", "comment", "comments", "reply", "related", "share", "social", "newsletter", "breadcrumb", "head",
    "subscribe", "popup", "widget", "navigation", "search", "login", "button",
}
_OTHER_MAIN = (
    "div content", "div post", "section main", "div article body", "main", "div entry text", "section story", "article", "div",
    "section", "div c1", "td", "div page body",
)
_OTHER_SIDE = {
    "nav": ("div menu", "ul nav", "div navigation", "nav"),
    "footer": ("div footer", "section footer", "div bottom footer", "footer"),
    "ad": ("div advert", "div banner", "aside promo", "div sponsor", "div ad"),
}
_ADDED = (
    ("header", "div"), ("header site header", "h2"), ("aside", "p"), ("div sidebar", "ul", "li"), ("aside sidebar", "ul", "li"),
    ("form",), ("form newsletter", "p"), ("div cookie notice", "p"), ("div notice",), ("section comments", "div comment", "p"),
    ("div comments", "article comment", "p"), ("ol comments", "li comment", "p"), ("div related", "ul", "li"), ("div share",),
    ("div advert", "p"), ("div breadcrumb",), ("section comments", "h3"),
)


def marked(page: list[Block]) -> np.ndarray:
    """Main text by the markup itself: inside a main element, inside no side element."""
    out = np.zeros(len(page), bool)
    for k, (path, _, _) in enumerate(page):
        words = [set(n.split(" ")) for n in path]
        out[k] = any(w & _MAIN for w in words) and not any(w & _SIDE for w in words)
    return out


def _is_side(path: tuple[str, ...]) -> bool:
    return any(set(n.split(" ")) & _SIDE for n in path)


def densest(page: list[Block]) -> tuple[tuple[str, ...], np.ndarray]:
    """For pages without a main element: the innermost container that holds most of the text, and its blocks.

    Text counts that is no link and in no side element. A container is a beginning of paths; one level further in has
    to keep ``MOST_TEXT`` of what the level before holds.
    """
    weight = [0.0 if _is_side(path) else len(text) * (1 - linked) for path, text, linked in page]
    inside, inner = list(range(len(page))), ()
    while True:
        shares: dict[str, float] = {}
        for k in inside:
            if len(page[k][0]) > len(inner) + 1:
                name = page[k][0][len(inner)]
                shares[name] = shares.get(name, 0.0) + weight[k]
        best = max(shares, key=shares.get, default=None)
        if best is None or shares[best] < MOST_TEXT * sum(weight[k] for k in inside) or not shares[best]:
            break
        inner += (best,)
        inside = [k for k in inside if page[k][0][: len(inner)] == inner]
    out = np.zeros(len(page), bool)
    for k in inside:
        out[k] = weight[k] > 0 and page[k][2] < 0.5
    return inner, out


def truth_of(page: list[Block]) -> tuple[set[str], np.ndarray]:
    """What a training page is taken to say: the names of its main containers and its main blocks."""
    truth = marked(page)
    if any(set(n.split(" ")) & _MAIN for path, _, _ in page for n in path):
        return {n for path, _, _ in page for n in path if set(n.split(" ")) & _MAIN}, truth
    inner, truth = densest(page)
    return {inner[-1]} - {"html", "body"} if inner else set(), truth


def variant(
    page: list[Block], truth: np.ndarray, spare: list[str], rng: random.Random, own: set[str] | None = None
) -> tuple[list[Block], np.ndarray]:
    """The page in another layout: containers under other names, side blocks added before, inside and after.

    ``own`` are the names of its main containers, if they aren't elements that say so.
    """
    main = rng.choice(_OTHER_MAIN)
    names = {k: rng.choice(v) for k, v in _OTHER_SIDE.items()}
    wrap = rng.choice(((), ("div page",), ("div wrapper", "div inner")))
    out, label = [], []

    def add(times: int, inside: tuple[str, ...]) -> None:
        for _ in range(times if spare else 0):
            path = rng.choice(_ADDED)
            for _ in range(rng.randint(1, 4)):
                words = rng.choice(spare).split(" ")
                at = rng.randrange(len(words))
                out.append((inside + path, " ".join(words[at : at + rng.randint(1, 40)]), rng.choice((0.0, 0.0, 1.0))))
                label.append(False)

    add(rng.randint(0, 2), ("html", "body", *wrap))
    for k, (path, text, linked) in enumerate(page):
        if truth[k] and k and rng.random() < 0.03:
            add(1, ("html", "body", *wrap, main))
        new = []
        for name in path:
            words = set(name.split(" "))
            if words & _MAIN or name in (own or ()):
                name = main
            else:
                name = next((names[w] for w in names if w in words), name)
            new.append(name)
            if name == "body":
                new += wrap
        out.append((tuple(new), text, linked))
        label.append(bool(truth[k]))
    add(rng.randint(0, 3), ("html", "body", *wrap))
    return out, np.array(label, bool)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Labeller:
    """Fit a labeller on a bounded sample of the pages."""
    rank = F.xxhash64(id_col)
    own = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"), rank.alias("rank"))
    ranks = [r[0] for r in own.select("rank").distinct().orderBy("rank").limit(TRAIN_PAGES).collect()]
    usable = own.filter(F.col("rank").isin(ranks) & (F.octet_length("html") <= TRAIN_BYTES))
    sample = sorted({(r.rank, r.html) for r in usable.limit(2 * TRAIN_PAGES).collect()})
    rng = random.Random(7)
    seen = [blocks(html) for _, html in sample]
    spare = [b[1] for page in seen for b in page]
    made = []
    for page in filter(None, seen):
        own, truth = truth_of(page)
        made.append((page, truth))
        made += [variant(page, truth, spare, rng, own) for _ in range(VARIANTS)]
    vectors, labeller = Vectors(), Labeller()
    labeller.fit([vectors.of(p) for p, _ in made], [t for _, t in made])
    return labeller


def _labels(found: list[list[Block]], vectors: Vectors, labeller: Labeller) -> list[np.ndarray]:
    """The main blocks of every page; where the labeller keeps nothing of a page's text, those of its densest container."""
    usual = [k for k, p in enumerate(found) if len(p) <= GROUP_BLOCKS]
    out = dict(zip(usual, labeller.label([vectors.of(found[k]) for k in usual]), strict=True))
    for k, page in enumerate(found):
        if k not in out:
            out[k] = labeller.label_long(len(page), lambda a, b, page=page: vectors.of(page, a, b))
        if not out[k].any():
            inside = densest(page)[1]
            if sum(len(page[j][1]) for j in np.flatnonzero(inside)) >= FALLBACK_CHARS:
                out[k] = inside
    return [out[k] for k in range(len(found))]


def extract(
    pages: DataFrame, labeller: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Per page: page_id, url, its main text and the text's length in characters."""
    labeller = labeller or train(pages, id_col, html_col)
    shared = pages.sparkSession.sparkContext.broadcast(labeller)
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(stream):
        vectors = Vectors()
        for batch in slices(stream, 2):
            found = [blocks(t.decode()) for t in texts(batch.column(2))]
            labels = _labels(found, vectors, shared.value)
            main = [" ".join(b[1] for b, y in zip(p, own, strict=True) if y) for p, own in zip(found, labels, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(main, pa.string()), pa.array([len(x) for x in main], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
