"""HTML extraction by a recurrent block labeller in numpy.

A page is cut into leaf blocks: text between block-level tags, with the path of open tags (names, classes, ids, roles). A block's input is the
mean of learned vectors of all its hashed path parts, the mean of learned vectors of its hashed words, and a few measures (length, share in links,
sentence ends, place). A bidirectional LSTM reads the sequence of the whole page, and a logistic unit on both states says of every block whether
it is of the main text. Training (html_train.py) runs on pages generated from random templates, whose labels are known by construction.

Character references are decoded, white space in a block becomes one space, blocks are trimmed and joined in page order by one space. Scripts,
styles, comments and other invisible parts are no blocks; formulas and what stands in for an object are text. Null or empty html: empty text, n_chars 0. Pages of any length are read whole. Repeated
rows are rows of their own; extra columns do not take part; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import common

PATHS, WORDS, PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 1024, 1024, 16, 8, 7, 20
MODEL = os.path.join(os.path.dirname(__file__), "html_model.npz")
#: Tags that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mfrac mi mn mo mover mroot mrow ms msqrt mstyle msub msubsup msup mtext munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe textarea select title canvas annotation annotation-xml".split())
_RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
#: A new one of these ends an open one.
SELF_CLOSING = {"p": "p", "li": "li", "dt": "dt", "dd": "dd", "tr": "tr", "td": "td", "th": "th", "option": "option"}
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag; quotes count right after `=` alone. Possessive, so it is read once.
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))*+>""")
#: The end of a comment, and of one that ends as it begins.
_COMMENT_END, _NO_COMMENT = re.compile("--!?>"), re.compile("<!---?>")
_ATTR = re.compile(r"""\b(class|id|role|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[a-z]+")
_WORD = re.compile(r"\w+")
_SPACE = re.compile(r"\s+")


#: An element: the place of the one it stands in (-1: none), its name and the parts it adds to the path.
Element = tuple[int, str, tuple[str, ...]]


class Tags:
    """The tags of a page in one pass: start, end, whether it closes, name and attributes. A tag without `>` is text; where a quote is never
    closed, this and all later tags end at the next `>`, so no stretch of the page is read more than twice."""

    def __init__(self, page: str) -> None:
        self.page, self.plain, self.last = page, False, page.rfind(">")

    def after(self, pos: int) -> tuple[int, int, bool, str, str] | None:
        page = self.page
        while 0 <= (at := page.find("<", pos)) < self.last:
            if page.startswith("<!--", at):
                end = _NO_COMMENT.match(page, at) or _COMMENT_END.search(page, at + 4)
                return at, end.end() if end else len(page), False, "", ""
            if page[at + 1] in "!?":
                return at, page.find(">", at) + 1, False, "", ""
            m = _NAME.match(page, at + 1)
            if m:
                rest = None if self.plain else _REST.match(page, m.end())
                self.plain |= rest is None
                end = rest.end() if rest else page.find(">", m.end()) + 1
                return at, end, bool(m[1]), m[2].lower(), page[m.end() : end - 1]
            pos = at + 1
        if at >= 0 and page.startswith("<!--", at):
            return at, len(page), False, "", ""
        return None


def tree(page: str) -> tuple[list[Element], list[tuple[int, str, int]]]:
    """The elements of a page, and (element, text, characters in links) of each leaf block, both in page order."""
    elements: list[Element] = []
    out: list[tuple[int, str, int]] = []
    stack: list[int] = []
    open_: Counter[str] = Counter()
    text: list[str] = []
    links, in_link, pos, n = 0, 0, 0, len(page)
    endless: set[str] = set()
    tags = Tags(page)

    def flush() -> None:
        nonlocal links
        if text:
            t = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if t:
                out.append((stack[-1] if stack else -1, t, min(links, len(t))))
            text.clear()
        links = 0

    def close() -> str:
        name = elements[stack.pop()][1]
        open_[name] -= 1
        return name

    while pos < n:
        tag = tags.after(pos)
        piece = page[pos : tag[0]] if tag else page[pos:]
        if piece:
            text.append(piece)
            if in_link:
                links += len(piece.strip())
        if not tag:
            break
        _, pos, closes, name, attributes = tag
        if not name:
            continue
        if name in RAW:
            if closes or attributes.endswith("/") or name in endless:
                continue
            end = _RAW_END[name].search(page, pos)
            if not end:
                if name in ("script", "style", "template", "noscript"):
                    break
                endless.add(name)
                continue
            at = page.find(">", end.start())
            pos = n if at < 0 else at + 1
            continue
        if name in INLINE:
            if name == "a":
                in_link = max(0, in_link - 1) if closes else 1
            continue
        if name == "br":
            text.append(" ")
            continue
        flush()
        in_link = 0
        if closes:
            if open_[name]:
                while close() != name:
                    pass
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name in SELF_CLOSING and stack and elements[stack[-1]][1] == SELF_CLOSING[name]:
            close()
        parts = [name]
        for k, v in _ATTR.findall(attributes) if attributes else ():
            k = k.lower()
            if k == "hidden" or k == "style" and "display:none" in v.replace(" ", "").lower():
                parts.append("=hidden")
            elif k != "style":
                parts += [f".{x}" for x in _PART.findall(v.lower())]
        elements.append((stack[-1] if stack else -1, name, tuple(parts)))
        stack.append(len(elements) - 1)
        open_[name] += 1
    flush()
    return elements, out


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path parts, text, characters in links) of each leaf block in page order; for training, where pages are small."""
    elements, found = tree(page)
    paths: list[tuple[str, ...]] = []
    for parent, _, parts in elements:
        paths.append((paths[parent] if parent >= 0 else ()) + parts)
    return [(paths[e] if e >= 0 else (), t, links) for e, t, links in found]


_CRC: dict[str, int] = {}


def bucket(s: str, size: int) -> int:
    h = _CRC.get(s)
    if h is None:
        if len(_CRC) > 200_000:
            _CRC.clear()
        h = _CRC[s] = zlib.crc32(s.encode("utf-8", "replace"))
    return h % size


def measures_of(text: str, links: int, words: int, i: int, n: int) -> tuple[float, ...]:
    return (math.log1p(len(text)) / 6, links / len(text), min(1.0, sum(map(text.count, ".!?,")) / (words + 1)), i / n, (n - i) / n, words < 6, text[-1] in ".!?\"'”…")


def inputs(found: list[tuple[tuple[str, ...], str, int]]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Hashed path parts, hashed words and measures of a page's blocks."""
    paths, words, n = [], [], len(found)
    measures = np.zeros((n, MEASURES), np.float32)
    for i, (path, text, links) in enumerate(found):
        paths.append(np.array([bucket(p, PATHS) for p in path] or [0], np.int64))
        w = _WORD.findall(text.lower())
        words.append(np.array([bucket(x, WORDS) for x in w] or [0], np.int64))
        measures[i] = measures_of(text, links, len(w), i, n)
    return paths, words, measures


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool = False, start: tuple[np.ndarray, np.ndarray] | None = None):
    """States (time, batch, hidden) of an LSTM over x (time, batch, inputs); gates in the order input, forget, output, cell. keep: also what training
    needs; start: state and cell before the first step, and then the last ones are given out too."""
    t, n, _ = x.shape
    d = u.shape[0]
    h, c = start or (np.zeros((n, d), x.dtype), np.zeros((n, d), x.dtype))
    out, tape = np.zeros((t, n, d), x.dtype), []
    pre = x @ w + b
    for i in range(t):
        z = pre[i] + h @ u
        g, cand = sigmoid(z[:, : 3 * d]), np.tanh(z[:, 3 * d :])
        gi, gf, go = g[:, :d], g[:, d : 2 * d], g[:, 2 * d :]
        c_old, h_old = c, h
        c = gf * c_old + gi * cand
        tc = np.tanh(c)
        h = go * tc
        out[i] = h
        if keep:
            tape.append((gi, gf, go, cand, c_old, h_old, tc))
    if start:
        return out, h, c
    return (out, tape) if keep else out


def embed(pages: list[tuple], model: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The input vectors of the blocks of each page."""
    out = []
    for paths, words, measures in pages:
        cols = []
        for lists, table in ((paths, model["path"]), (words, model["word"])):
            lens = np.array([len(x) for x in lists])
            cols.append(np.add.reduceat(table[np.concatenate(lists)], np.cumsum(lens) - lens, axis=0) / lens[:, None])
        out.append(np.concatenate([*cols, measures], axis=1))
    return out


def reversed_each(x: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Each sequence of (time, batch, ...) backwards, padding left behind it."""
    t = x.shape[0]
    at = np.where(np.arange(t)[:, None] < lens[None, :], lens[None, :] - 1 - np.arange(t)[:, None], np.arange(t)[:, None])
    return x[at, np.arange(x.shape[1])[None, :]]


#: Blocks, padding included, that are labelled at once.
BATCH_BLOCKS = 1 << 14


def vectors(page: str, model: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """The texts of a page's blocks and their input vectors. The sum over an element's whole path is its parent's and its own parts'."""
    elements, found = tree(page)
    n = len(found)
    sums, counts = np.zeros((len(elements) + 1, PATH_DIM), np.float32), [0] * (len(elements) + 1)
    if elements:
        lens = np.array([len(parts) for *_, parts in elements])
        own = model["path"][[bucket(p, PATHS) for *_, parts in elements for p in parts]]
        sums[:-1] = np.add.reduceat(own, np.cumsum(lens) - lens, axis=0)
        for i, (parent, _, parts) in enumerate(elements):
            counts[i] = counts[parent] + len(parts)
            if parent >= 0:
                sums[i] += sums[parent]
    out = np.zeros((n, PATH_DIM + WORD_DIM + MEASURES), np.float32)
    for a in range(0, n, BATCH_BLOCKS):
        part = found[a : a + BATCH_BLOCKS]
        words = [_WORD.findall(text.lower()) for _, text, _ in part]
        lens, at = np.array([max(1, len(w)) for w in words]), np.array([e for e, _, _ in part])
        depth = np.array(counts)[at][:, None]
        to = slice(a, a + len(part))
        out[to, :PATH_DIM] = np.where(depth > 0, sums[at] / np.maximum(depth, 1), model["path"][0])
        flat = model["word"][[bucket(x, WORDS) for w in words for x in w] if all(words) else [bucket(x, WORDS) if x else 0 for w in words for x in w or [""]]]
        out[to, PATH_DIM : PATH_DIM + WORD_DIM] = np.add.reduceat(flat, np.cumsum(lens) - lens, axis=0) / lens[:, None]
        out[to, PATH_DIM + WORD_DIM :] = [measures_of(text, links, len(w), a + i, n) for i, ((_, text, links), w) in enumerate(zip(part, words, strict=True))]
    return [t for _, t, _ in found], out


def run_over(x: np.ndarray, model: dict[str, np.ndarray], way: str) -> np.ndarray:
    """States of one direction over (time, batch, inputs), in stretches, so that only inputs and states are as long as the page."""
    n, d = x.shape[1], model["u" + way].shape[0]
    h, c = np.zeros((n, d), x.dtype), np.zeros((n, d), x.dtype)
    out = np.zeros((x.shape[0], n, d), x.dtype)
    step = max(1, BATCH_BLOCKS // n)
    for a in range(0, x.shape[0], step):
        out[a : a + step], h, c = lstm(x[a : a + step], model["w" + way], model["u" + way], model["b" + way], start=(h, c))
    return out


def probabilities(xs: list[np.ndarray], model: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The probability of being main text of each block of each page; pages of like length are read together, BATCH_BLOCKS blocks at most or one page."""
    out: list[np.ndarray] = [np.zeros(0)] * len(xs)
    order = sorted((i for i in range(len(xs)) if len(xs[i])), key=lambda i: -len(xs[i]))
    a = 0
    while a < len(order):
        part = order[a : a + max(1, min(64, BATCH_BLOCKS // len(xs[order[a]])))]
        a += len(part)
        lens = np.array([len(xs[i]) for i in part])
        x = np.zeros((lens.max(), len(part), xs[part[0]].shape[1]), np.float32)
        for j, i in enumerate(part):
            x[: lens[j], j] = xs[i]
        fw = run_over(x, model, "f")
        bw = reversed_each(run_over(reversed_each(x, lens), model, "b"), lens)
        p = sigmoid(fw @ model["v"][: fw.shape[2]] + bw @ model["v"][fw.shape[2] :] + model["c"])
        for j, i in enumerate(part):
            out[i] = p[: lens[j], j]
    return out


def label(pages: list[tuple], model: dict[str, np.ndarray]) -> list[np.ndarray]:
    """probabilities() of pages as inputs() gives them."""
    return probabilities(embed(pages, model), model)


def load(path: str = MODEL) -> dict[str, np.ndarray]:
    with np.load(path) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


def main_texts(pages: list[str | None], model: dict[str, np.ndarray]) -> list[str]:
    found = [vectors(p or "", model) for p in pages]
    keep = probabilities([x for _, x in found], model)
    return [" ".join(t for t, p in zip(texts, ps, strict=True) if p >= 0.5) for (texts, _), ps in zip(found, keep, strict=True)]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    common.tune(spark)
    shared = spark.sparkContext.broadcast(load())
    kinds = dict(pages.dtypes)

    def run(batches):
        for b in batches:
            texts = main_texts(b.column(2).to_pylist(), shared.value) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op10_html(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(common.table(spark, sf_dir, "pages"))
