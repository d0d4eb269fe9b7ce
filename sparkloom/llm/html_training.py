"""Trains the block labeller of html_extraction.py on made-up pages: python -m sparkloom.llm.html_training.

Pages are drawn from a grammar of layouts (semantic tags, named boxes, plain) around invented words; each block knows
whether it belongs to the article. Training is deterministic.
"""

from __future__ import annotations

import html
import random

import numpy as np

from sparkloom.llm import html_extraction as hx

HIDDEN = 24
SYLLABLES = "ba be bi co da de di do el en er est fa fi ge ha he in is ka la le li lo ma me mi mo na ne no on or pa pe po ra re ri ro sa se si so ta te ti to un va ve vi à é ü ñ ß".split()
ALIKE = {
    "nav": ["nav", "navbar", "menu", "main-menu", "topnav", "navigation", "breadcrumbs", "site-nav", "links"],
    "header": ["header", "site-header", "masthead", "top", "banner", "page-header", "topbar", "logo"],
    "footer": ["footer", "site-footer", "page-footer", "bottom", "colophon", "copyright", "foot"],
    "aside": ["sidebar", "side", "widget", "related", "aside", "secondary", "recommended", "more-stories", "popular", "tags", "toc"],
    "notice": ["notice", "cookie", "cookie-banner", "consent", "alert", "gdpr", "warning", "popup", "modal", "message", "subscribe", "paywall"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "promo", "sponsored", "ad-slot", "banner-ad", "commercial"],
    "form": ["form", "search", "search-form", "login", "newsletter", "signup", "contact-form", "subscribe-form", "survey"],
    "comments": ["comments", "comment-list", "comment", "discussion", "replies", "responses", "disqus", "reader-comments", "respond", "feedback"],
    "share": ["share", "social", "sharing", "buttons", "follow-us"],
    "article": ["article", "content", "post", "entry", "entry-content", "post-body", "story", "main-text", "article-body", "text", "main", "page-content", "blog-post"],
}
SAID = {
    "nav": ["Home", "About", "Contact", "News", "Sport", "Login", "Menu", "Archive"],
    "footer": ["© 2024", "All rights reserved", "Privacy policy", "Terms", "Imprint", "Powered by"],
    "notice": ["We use cookies", "Accept all", "This site uses cookies to improve", "Please enable", "Notice:", "Subscribe now to read on"],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Special offer", "Anzeige", "Publicité"],
    "form": ["Search", "Submit", "E-mail", "Password", "Sign up", "Your name", "Send"],
    "comments": ["Comments", "Reply", "Leave a comment", "3 comments", "said:", "wrote on"],
    "aside": ["Related", "Read more", "Popular", "Tags", "Most read", "You may also like"],
    "share": ["Share", "Tweet", "Facebook", "E-mail this"],
    "header": ["Welcome", "Daily", "Blog", "The Times of"],
}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        ws = ["".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
        out, k = [], 0
        while k < len(ws):
            n = r.randint(2, 18)
            part = ws[k : k + n]
            out.append(" ".join([part[0].capitalize(), *part[1:]]) + r.choice([".", ".", ".", "?", "!", ""]))
            k += n
        text = " ".join(out)
        if r.random() < 0.08:
            text = " ".join(w + r.choice(["###", "%%%", "&&&", "***", "$$$"]) for w in text.split())
        return text

    def esc(self, text: str) -> str:
        return html.escape(text, quote=False).replace("'", self.r.choice(["'", "&#39;"]))

    def says(self, kind: str, lo: int, hi: int) -> str:
        text = self.words(lo, hi)
        return f"{self.r.choice(SAID[kind])} {text}" if kind in SAID and self.r.random() < 0.5 else text

    def box(self, kind: str, inside: str, tag: str = "") -> str:
        """A box that may or may not say what it is by its tag or its class."""
        r, style = self.r, self.style
        semantic = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "article": "article"}.get(kind)
        if style == "semantic" and semantic and r.random() < 0.95:
            tag, names = semantic, r.random() < 0.4
        else:
            tag, names = tag or r.choice(["div", "div", "div", "section"]), True
        attribute = ""
        if names:
            name = r.choice(ALIKE[kind])
            if r.random() < 0.3:
                name += r.choice(["-1", "_inner", " wrap", " col-8", "-box", " clearfix"])
            attribute = f" {r.choice(['class', 'class', 'class', 'id'])}={r.choice([chr(34), chr(34), chr(39)])}"
            attribute += name + attribute[-1]
        return f"<{tag}{attribute}>{inside}</{tag}>"

    def links(self, kind: str, n: int) -> str:
        r = self.r
        form = r.choice(["ul", "plain", "ul", "div"])
        items = [f'<a href="/{i}">{self.esc(self.says(kind, 1, 3))}</a>' for i in range(n)]
        if form == "ul":
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return "".join(f"<div>{x}</div>" for x in items) if form == "div" else r.choice([" | ", " ", " &middot; "]).join(items)

    def junk(self, kind: str) -> str:
        r = self.r
        if kind in ("nav", "share"):
            return self.box(kind, self.links(kind, r.randint(2, 9)))
        if kind == "aside":
            return self.box(kind, f"<h3>{self.esc(self.says(kind, 1, 3))}</h3>" + (self.links(kind, r.randint(2, 6)) if r.random() < 0.6 else f"<p>{self.esc(self.says(kind, 5, 60))}</p>"))
        if kind == "form":
            return self.box(kind, f"<label>{self.esc(self.says(kind, 1, 4))}</label><input type=text name=q>" + r.choice(["", "<select><option>" + self.words(1, 2) + "<option>" + self.words(1, 2) + "</select>"]) + f"<button>{self.esc(self.says(kind, 1, 2))}</button>", "form")
        if kind == "comments":
            one = lambda: self.box(kind, r.choice(["", f"<b>{self.words(1, 2)}</b> ", f"<h4>{self.words(1, 2)}</h4>"]) + f"<p>{self.esc(self.says(kind, 3, 80))}</p>")
            return self.box(kind, f"<h3>{self.esc(self.says(kind, 1, 2))}</h3>" + "".join(one() for _ in range(r.randint(1, 5))))
        text = self.esc(self.says(kind, 2, 40 if kind != "header" else 8))
        return self.box(kind, r.choice([text, f"<p>{text}</p>", f"<span>{text}</span>", f"{text} " + self.links(kind, 2)]))

    def article(self) -> str:
        r, parts = self.r, []
        title = self.esc(self.words(2, 12))
        if r.random() < 0.85:
            parts.append(r.choice([f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<h2>{title}</h2>"]))
        for _ in range(r.choice([1, 2, 4, 8, 16, 30]) if r.random() < 0.97 else 120):
            text = self.esc(self.words(*r.choice([(1, 4), (3, 30), (10, 80), (40, 160)])))
            kind = r.random()
            if kind < 0.7:
                parts.append(f"<p>{text}</p>")
            elif kind < 0.78:
                parts.append(f"<p><b>{text}<br><p>{self.esc(self.words(3, 40))}</p>")
            elif kind < 0.83:
                parts.append(f"<h{(k := r.randint(2, 4))}>{self.esc(self.words(1, 6))}</h{k}>")
            elif kind < 0.88:
                parts.append("<ul>" + "".join(f"<li>{self.esc(self.words(1, 20))}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.91:
                parts.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.94:
                parts.append(f'<p>{text} <a href="/x">{self.esc(self.words(1, 4))}</a> {self.esc(self.words(1, 20))}</p>')
            elif kind < 0.96:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.98:
                parts.append(f"<div>{text}</div>")
            else:
                parts.append(f"<pre>{text}</pre>")
        return parts

    def page(self) -> tuple[str, list[int]]:
        """A page and its blocks' labels; article blocks are told by a mark that is taken out again."""
        r = self.r
        self.style = r.choice(["semantic", "semantic", "named", "named", "mixed"])
        inner = [self.mark(x) for x in self.article()]
        for kind in r.choices(["ad", "share", "notice", "form", "aside"], k=r.choice([0, 0, 0, 1, 2])):
            inner.insert(r.randint(0, len(inner)), self.junk(kind))
        if r.random() < 0.12:
            inner.append(self.junk("comments"))
        if r.random() < 0.04:
            inner[0] = f"<header>{inner[0]}</header>"
        body = self.box("article", "".join(inner))
        if r.random() < 0.3:
            body = r.choice(["<main>{}</main>", "<div id=wrap>{}</div>", "<div class='container'><div class=row>{}</div></div>"]).format(body)
        before = [self.junk(k) for k in ["header", "nav", "notice", "ad", "form"] if r.random() < 0.55]
        after = [self.junk(k) for k in ["share", "aside", "ad", "comments", "form", "footer", "nav", "notice"] if r.random() < 0.4]
        if r.random() < 0.25:
            before.append(self.junk("aside"))
        if r.random() < 0.5:
            r.shuffle(before)
        if r.random() < 0.6:
            after.append(self.junk("footer"))
        head = f"<head><title>{self.esc(self.words(2, 9))}</title><style>p{{margin:0}}</style><script>var t='<p>x</p>';</script></head>" if r.random() < 0.9 else ""
        page = f"<!DOCTYPE html><html>{head}<body>{''.join(before)}<!-- {self.words(1, 4)} -->{body}{''.join(after)}" + r.choice(["</body></html>", "</body></html>", ""])
        cut = hx.blocks(page)
        return page, [int("" in t) for t, _, _ in cut]

    def mark(self, part: str) -> str:
        """Put the mark before every text of an article's part."""
        out, at = [], 0
        for m in hx.TOKEN.finditer(part):
            text = part[at : m.start()]
            out += ["" + text if text.strip() else text, m[0]]
            at = m.end()
        return "".join(out) + part[at:]


def samples(n: int, seed: int) -> tuple[list[list[hx.Block]], list[np.ndarray]]:
    maker, pages, labels = Maker(seed), [], []
    for _ in range(n):
        page, y = maker.page()
        pages.append(hx.blocks(page.replace("", "")))
        labels.append(np.array(y, np.float32))
    return pages, labels


def initial(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d, h = hx.PATH + hx.WORDS + hx.NUMBERS, HIDDEN
    m = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
    model = {"w_in": m(d, h) * 3, "b_in": np.zeros(h, np.float32), "w_out": m(3 * h, 1), "b_out": np.zeros(1, np.float32)}
    for k in "fb":
        model[f"w_{k}"], model[f"b_{k}"] = m(2 * h, 4 * h), np.zeros(4 * h, np.float32)
        model[f"b_{k}"][h : 2 * h] = 1
    return model


def _forward(x: np.ndarray, w: np.ndarray, b: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, list]:
    h_size = w.shape[1] // 4
    h = c = np.zeros((x.shape[1], h_size), np.float32)
    kept, out = [], []
    for t in range(len(x)):
        xh = np.concatenate([x[t], h], 1)
        g = xh @ w + b
        i, f, o = (1 / (1 + np.exp(-g[:, k * h_size : (k + 1) * h_size])) for k in range(3))
        a = np.tanh(g[:, 3 * h_size :])
        new = f * c + i * a
        tc = np.tanh(new)
        kept.append((xh, i, f, o, a, c, tc))
        on = live[t][:, None]
        c, h = np.where(on, new, c), np.where(on, o * tc, h)
        out.append(h)
    return np.stack(out), kept


def _backward(dout: np.ndarray, kept: list, w: np.ndarray, live: np.ndarray, n_in: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dw, db = np.zeros_like(w), np.zeros(w.shape[1], np.float32)
    dx = np.zeros((*dout.shape[:2], n_in), np.float32)
    dh = np.zeros(dout.shape[1:], np.float32)
    dc = np.zeros_like(dh)
    for t in range(len(kept) - 1, -1, -1):
        xh, i, f, o, a, c, tc = kept[t]
        on = live[t][:, None]
        full = dh + dout[t]
        d = np.where(on, full, 0)
        dcc = np.where(on, dc, 0) + d * o * (1 - tc * tc)
        g = np.concatenate([dcc * a * i * (1 - i), dcc * c * f * (1 - f), d * tc * o * (1 - o), dcc * i * (1 - a * a)], 1)
        dw += xh.T @ g
        db += g.sum(0)
        dxh = g @ w.T
        dx[t] = dxh[:, :n_in]
        dh = np.where(on, dxh[:, n_in:], full)
        dc = np.where(on, dcc * f, dc)
    return dx, dw, db


def train(n: int = 9000, epochs: int = 8, seed: int = 7, size: int = 64) -> dict[str, np.ndarray]:
    pages, labels = samples(n, seed)
    model = initial(seed)
    m1, m2 = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    rng, step = np.random.default_rng(seed), 0
    by_size = np.array(sorted(range(n), key=lambda i: len(pages[i])))
    groups = [by_size[k : k + size] for k in range(0, n, size)]
    for epoch in range(epochs):
        loss = total = 0.0
        for gi in rng.permutation(len(groups)):
            ids = [i for i in groups[gi] if pages[i]]
            group, sizes = [pages[i] for i in ids], np.array([len(pages[i]) for i in ids])
            y, raw = np.concatenate([labels[i] for i in ids])[:, None], hx.vectors(group)
            raw = raw * (rng.random((1, raw.shape[1])) > 0.05)  # no single bin decides
            x = np.tanh(raw @ model["w_in"] + model["b_in"])
            ahead, behind, live, index = hx.padded(x, sizes)
            h1, k1 = _forward(ahead, model["w_f"], model["b_f"], live)
            h2, k2 = _forward(behind, model["w_b"], model["b_b"], live)
            p, t = np.nonzero(live.T)
            back = sizes[p] - 1 - t
            both = np.concatenate([h1[t, p], h2[back, p], x], 1)
            out = 1 / (1 + np.exp(-(both @ model["w_out"] + model["b_out"])))
            loss += float(-(y * np.log(out + 1e-7) + (1 - y) * np.log(1 - out + 1e-7)).sum())
            total += len(y)
            d = (out - y) / len(y)
            grad = {"w_out": both.T @ d, "b_out": d.sum(0)}
            db = d @ model["w_out"].T
            d1, d2 = np.zeros_like(h1), np.zeros_like(h2)
            d1[t, p], d2[back, p] = db[:, :HIDDEN], db[:, HIDDEN : 2 * HIDDEN]
            dx1, grad["w_f"], grad["b_f"] = _backward(d1, k1, model["w_f"], live, HIDDEN)
            dx2, grad["w_b"], grad["b_b"] = _backward(d2, k2, model["w_b"], live, HIDDEN)
            dx = (db[:, 2 * HIDDEN :] + dx1[t, p] + dx2[back, p]) * (1 - x * x)
            grad["w_in"], grad["b_in"] = raw.T @ dx, dx.sum(0)
            step += 1
            rate = 0.01 * (1 - step / (epochs * len(groups) + 1))
            for k, g in grad.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                model[k] = (model[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        print(epoch, round(loss / total, 4), flush=True)
    return model


def main() -> None:
    model = train()
    pages, labels = samples(500, 99)
    hit = [((p >= 0.5) == (y > 0)) for p, y in zip(hx.label(pages, model), labels, strict=True)]
    print("blocks", np.concatenate(hit).mean(), "pages", np.mean([h.all() for h in hit]))
    np.savez_compressed(hx.WEIGHTS, **{k: v.astype(np.float16) for k, v in model.items()})


if __name__ == "__main__":
    main()
