"""Trains the block labeller of html.py: python -m tessera.llm.html_train writes html_model.npz.

Pages are generated from random templates: nested containers around an article, with semantic, telling or meaningless names, and menus, headers,
footers, sidebars, notices, adverts, forms and reader comments around and inside it. Words are invented, but for the stock phrases of such parts.
The generator marks its main text with private-use characters, so labels are known by construction.
"""

from __future__ import annotations

import numpy as np

from tessera.llm import html as H

MARK = ""
#: Names of the parts of the templates, fixed values.
GOOD = "article main content post entry story post-content article-body entry-content text body-copy page-content".split()
BAD = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs top-menu main-nav pagination toc".split(),
    "header": "header masthead site-header top-bar branding topbar page-header".split(),
    "footer": "footer site-footer bottom copyright colophon page-footer".split(),
    "aside": "sidebar side aside widget related recommended more-stories trending popular tags rail".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner ad-slot adbox promoted".split(),
    "notice": "cookie cookie-banner consent notice alert gdpr newsletter subscribe modal popup paywall message disclaimer".split(),
    "form": "search search-form login signup contact-form form subscribe-form".split(),
    "comments": "comments comment comment-list comment-body discussion replies reply respond disqus user-comments".split(),
    "share": "share social social-links share-buttons follow byline-share toolbar".split(),
}
PHRASES = {
    "nav": "home about contact news sport products services blog faq archive".split(),
    "header": "welcome sign in register menu search".split(),
    "footer": "copyright all rights reserved privacy policy terms of use imprint sitemap".split(),
    "aside": "related articles most read popular latest trending you may also like tags".split(),
    "ad": "advertisement sponsored buy now save free shipping offer discount shop click here".split(),
    "notice": "we use cookies accept all reject settings subscribe to our newsletter your email consent".split(),
    "form": "email name password submit send login remember me search".split(),
    "comments": "reply report like posted by ago user said great thanks comment comments".split(),
    "share": "share tweet facebook print email follow us".split(),
}


class Pages:
    def __init__(self, seed: int) -> None:
        self.r = np.random.default_rng(seed)
        self.syllables = ["".join(self.r.choice(list("bcdfghlmnprstvz"), 1)) + "".join(self.r.choice(list("aeiouéèöüñ"), 1)) + "".join(self.r.choice(["", "n", "r", "s", "t", "sch", "tion"], 1)) for _ in range(90)]

    def one(self, xs):
        return xs[int(self.r.integers(len(xs)))]

    def word(self) -> str:
        return "".join(self.one(self.syllables) for _ in range(1 + int(self.r.integers(3))))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def prose(self, short: bool = False) -> str:
        if self.r.random() < 0.12:
            return self.word().capitalize() + "."
        if self.r.random() < 0.08:  # runs of one word or sentence, or words with signs: main text all the same
            unit = self.one([self.word(), self.words(3), self.words(4).capitalize() + "."])
            return " ".join([unit] * int(self.r.integers(2, 40)))
        if self.r.random() < 0.05:
            return " ".join(self.word() + self.one(["", "###", "%%%", "***", "|"]) for _ in range(int(self.r.integers(4, 40))))
        return " ".join(self.words(int(self.r.integers(1, 6 if short else 24))).capitalize() + self.one([".", ".", ".", "!", "?", ""]) for _ in range(1 + int(self.r.integers(2 if short else 7))))

    def attrs(self, names: list[str], plain: float) -> str:
        x = self.r.random()
        if x < plain:
            return ""
        if x < plain + 0.12:
            return f' class="{self.one(["box", "row", "col", "inner", "wrapper", "container", "css", "x", "block", self.word()])}"'
        return f' {self.one(["class", "class", "id"])}="{self.one(names)}{self.one(["", "", " wide", "-x", f" {self.word()}"])}"'

    def wrap(self, inner: str, tag: str, attrs: str = "") -> str:
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def part(self, kind: str) -> str:
        words, r = PHRASES[kind], self.r
        phrase = lambda: self.one([" ".join(self.one(words) for _ in range(1 + int(r.integers(4)))), self.words(1 + int(r.integers(4))), self.word()])
        sem = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        tag = sem if sem and r.random() < 0.6 else self.one(["div", "div", "section", "aside" if kind in ("ad", "aside") else "div"])
        n = 1 + int(r.integers(8))
        if kind == "nav" or kind in ("aside", "share", "footer") and r.random() < 0.5:
            link = [self.wrap(phrase(), "a", f' href="/{self.word()}"') for _ in range(n)]
            inner = self.wrap("".join(self.wrap(x, "li") for x in link), "ul") if r.random() < 0.7 else self.one([" | ", " ", " &middot; "]).join(link)
        elif kind == "form":
            inner = "".join(self.wrap(phrase(), self.one(["label", "p", "div", "button"])) + '<input name="q">' for _ in range(1 + n // 3))
            inner = inner if tag == "form" else self.wrap(inner, "form")
        elif kind == "comments":
            inner = self.wrap(phrase(), self.one(["h2", "h3", "h4"])) * (r.random() < 0.7) + "".join(self.wrap(self.wrap(phrase(), self.one(["b", "span", "div", "cite"])) + self.wrap(self.prose(r.random() < 0.5), self.one(["p", "p", "div"])), self.one(["li", "div", "article"]), self.attrs(BAD[kind], 0.4)) for _ in range(n))
        else:
            texts = [self.prose(r.random() < 0.6) if r.random() < 0.6 else phrase() for _ in range(1 + n // 3)]
            inner = "".join(self.wrap(t, self.one(["p", "div", "span", "h3"])) for t in texts) if r.random() < 0.6 else texts[0]
            if kind in ("footer",) and r.random() < 0.6:
                inner = f"&copy; {self.word()}.example.net &middot; {inner}"
        named = tag == sem or kind in ("aside", "form") and tag != "div"
        return self.wrap(inner, tag, self.attrs(BAD[kind], 0.6 if named else 0.0)) + self.one(["", "\n"])

    def article(self) -> str:
        r, out = self.r, []
        m = lambda t: MARK + t
        if r.random() < 0.8:
            out.append(self.wrap(m(self.words(2 + int(r.integers(9))).capitalize()), self.one(["h1", "h1", "h2"])))
        style = r.random()
        for _ in range(1 + int(r.integers(9))):
            x, t = r.random(), self.prose()
            if r.random() < 0.2:
                t = self.wrap(t, self.one(["b", "em", "span"])) if r.random() < 0.5 else t + " " + self.wrap(self.words(2), "a", ' href="/x"') + "."
            if x < 0.78:
                out.append(self.wrap(m(t), "p") if style < 0.7 else f"<p>{m(t)}" if style < 0.8 else self.wrap(m(t), "div") if style < 0.92 else f"{m(t)}<hr>")
            elif x < 0.84:
                out.append(self.wrap(m(self.words(1 + int(r.integers(6))).capitalize()), self.one(["h2", "h3"])))
            elif x < 0.90:
                tag = self.one(["ul", "ol"])
                out.append(self.wrap("".join(self.wrap(m(self.prose(True)), "li") for _ in range(1 + int(r.integers(5)))), tag))
            elif x < 0.93:
                out.append(self.wrap(self.wrap(m(t), "p"), "blockquote"))
            elif x < 0.96:
                out.append(self.wrap("".join(self.wrap("".join(self.wrap(m(self.words(1 + int(r.integers(3)))), "td") for _ in range(2)), "tr") for _ in range(2)), "table"))
            else:
                out.append(self.wrap(m(t), "pre"))
            if r.random() < 0.07:
                out.append(self.part(self.one(["ad", "aside", "share", "notice", "form"])))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        some = lambda kinds, p: "".join(self.part(k) for k in kinds if r.random() < p)
        tag = self.one(["article", "article", "main", "div", "div", "section"])
        body = self.wrap(self.article(), tag, self.attrs(GOOD, 0.55 if tag in ("article", "main") else 0.05))
        inside = body + some(["comments"], 0.35) + some(["share", "aside"], 0.15)
        if r.random() < 0.5:
            inside = self.wrap(some(["aside", "notice"], 0.2) + inside, self.one(["main", "div", "div"]), self.attrs(["wrapper", "page", "content", "container", "layout"], 0.3))
        before = [k for k in ("header", "nav", "notice", "ad", "form", "share") if r.random() < 0.45]
        after = [k for k in ("comments", "aside", "ad", "nav", "notice", "form") if r.random() < 0.3]
        out = "".join(self.part(k) for k in r.permutation(before)) + inside + "".join(self.part(k) for k in r.permutation(after)) + some(["footer"], 0.75)
        return f"<html><head><title>x</title></head><body>{out}</body></html>"


def example(page: str) -> tuple[tuple, np.ndarray]:
    found = H.blocks(page)
    y = np.array([MARK in t for _, t, _ in found], np.float32)
    return H.inputs([(p, t.replace(MARK, "").strip() or "x", n) for p, t, n in found]), y


def back(dh: np.ndarray, x: np.ndarray, tape: list, w: np.ndarray, u: np.ndarray):
    """Gradients of an LSTM's inputs and weights, by the chain rule backwards through time."""
    t, n, _ = x.shape
    d = u.shape[0]
    dw, du, db, dx = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * d, w.dtype), np.zeros_like(x)
    h_next, c_next = np.zeros((n, d), w.dtype), np.zeros((n, d), w.dtype)
    for i in range(t - 1, -1, -1):
        gi, gf, go, cand, c_old, h_old, tc = tape[i]
        h = dh[i] + h_next
        c = c_next + h * go * (1 - tc**2)
        z = np.concatenate([c * cand * gi * (1 - gi), c * c_old * gf * (1 - gf), h * tc * go * (1 - go), c * gi * (1 - cand**2)], axis=1)
        dw += x[i].T @ z
        du += h_old.T @ z
        db += z.sum(axis=0)
        dx[i] = z @ w.T
        h_next, c_next = z @ u.T, c * gf
    return dx, dw, du, db


def train(pages: int = 3500, epochs: int = 6, seed: int = 11, rate: float = 4e-3) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    make = Pages(seed)
    data = [e for e in (example(make.page()) for _ in range(pages)) if len(e[1]) and len(e[1]) <= 120]
    dims, d = H.PATH_DIM + H.WORD_DIM + H.MEASURES, H.HIDDEN
    init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    m = {"path": r.standard_normal((H.PATHS, H.PATH_DIM)).astype(np.float32) * 0.5, "word": r.standard_normal((H.WORDS, H.WORD_DIM)).astype(np.float32) * 0.1}
    for s in "fb":
        m |= {f"w{s}": init(dims, 4 * d), f"u{s}": init(d, 4 * d), f"b{s}": np.r_[np.zeros(d), np.ones(d), np.zeros(2 * d)].astype(np.float32)}
    m |= {"v": init(2 * d), "c": np.zeros((), np.float32)}
    first, second, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    for epoch in range(epochs):
        order = sorted(range(len(data)), key=lambda i: (len(data[i][1]) + r.integers(6), r.random()))
        batches = [order[a : a + 32] for a in range(0, len(order), 32)]
        loss_sum = wrong = blocks = 0.0
        for bi in r.permutation(len(batches)):
            part = [data[i] for i in batches[bi]]
            xs = H.embed([p for p, _ in part], m)
            lens = np.array([len(x) for x in xs])
            x, y, mask = np.zeros((lens.max(), len(xs), dims), np.float32), np.zeros((lens.max(), len(xs)), np.float32), np.zeros((lens.max(), len(xs)), np.float32)
            for j, v in enumerate(xs):
                x[: len(v), j], y[: len(v), j], mask[: len(v), j] = v, part[j][1], 1
            xr = H.reversed_each(x, lens)
            hf, tf = H.lstm(x, m["wf"], m["uf"], m["bf"], True)
            hb, tb = H.lstm(xr, m["wb"], m["ub"], m["bb"], True)
            both = np.concatenate([hf, H.reversed_each(hb, lens)], axis=2)
            p = H.sigmoid(both @ m["v"] + m["c"])
            dz = (p - y) * mask / mask.sum()
            loss_sum += float(-(np.log(np.where(y > 0, p, 1 - p) + 1e-7) * mask).sum())
            wrong += float((((p >= 0.5) != (y > 0)) * mask).sum())
            blocks += float(mask.sum())
            g = {"v": np.einsum("tn,tnd->d", dz, both), "c": dz.sum()}
            dh = dz[:, :, None] * m["v"]
            dxf, g["wf"], g["uf"], g["bf"] = back(dh[:, :, :d], x, tf, m["wf"], m["uf"])
            dxb, g["wb"], g["ub"], g["bb"] = back(H.reversed_each(dh[:, :, d:] * mask[:, :, None], lens), xr, tb, m["wb"], m["ub"])
            dx = dxf + H.reversed_each(dxb, lens)
            for name, col, at in (("path", slice(0, H.PATH_DIM), 0), ("word", slice(H.PATH_DIM, H.PATH_DIM + H.WORD_DIM), 1)):
                g[name] = np.zeros_like(m[name])
                for j, (f, _) in enumerate(part):
                    ls = np.array([len(q) for q in f[at]])
                    np.add.at(g[name], np.concatenate(f[at]), np.repeat(dx[: lens[j], j, col] / ls[:, None], ls, axis=0))
            step += 1
            lr = rate * (1 - 0.8 * step / (epochs * len(batches)))
            for k in m:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                m[k] = (m[k] - lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        print(f"epoch {epoch}: loss {loss_sum / blocks:.4f}, wrong {wrong / blocks:.4f} of {blocks:.0f} blocks", flush=True)
    return m


def accuracy(model: dict[str, np.ndarray], pages: int = 400, seed: int = 12) -> float:
    make = Pages(seed)
    data = [example(make.page()) for _ in range(pages)]
    got = H.label([p for p, _ in data], model)
    return float(np.mean(np.concatenate([(g >= 0.5) == (y > 0) for g, (_, y) in zip(got, data, strict=True)])))


if __name__ == "__main__":
    trained = train()
    print("held-out accuracy of blocks:", round(accuracy(trained), 4))
    np.savez_compressed(H.MODEL, **{k: v.astype(np.float16) for k, v in trained.items()})
