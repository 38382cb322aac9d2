"""A bidirectional LSTM in numpy that labels every block of a page, and the made-up pages it learns from."""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np

from stewardry.llm.blocks import WIDTH, blocks

#: Cells of each direction, pages that are made up for the fit, rounds over them, and the pages of a step.
CELLS, MADE_PAGES, ROUNDS, STEP_PAGES = 16, 600, 6, 24


def _sequences(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by falling length, offsets in that order) of sequences that lie one after another."""
    order = np.argsort(-lengths, kind="stable")
    return order, (np.cumsum(lengths) - lengths)[order]


def _pass(pre: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, back: bool, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states of one direction; sequences fall in length, so those still running are always the first ones."""
    cells = u.shape[0]
    h, c, out = np.zeros((len(lengths), cells), np.float32), np.zeros((len(lengths), cells), np.float32), np.empty((len(pre), cells), np.float32)
    running = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
    for t, n in enumerate(running):
        rows = offsets[:n] + (lengths[:n] - 1 - t if back else t)
        z = pre[rows] + h[:n] @ u
        gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * cells], -30, 30)))
        i, f, o, g = gates[:, :cells], gates[:, cells : 2 * cells], gates[:, 2 * cells :], np.tanh(z[:, 3 * cells :])
        new = f * c[:n] + i * g
        shown = np.tanh(new)
        if keep is not None:
            keep.append((n, rows, i, f, o, g, c[:n].copy(), shown, h[:n].copy()))
        c[:n], h[:n] = new, o * shown
        out[rows] = h[:n]
    return out


def _back(d_out: np.ndarray, kept: list, count: int, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates' inputs and of u."""
    cells = u.shape[0]
    dh, dc, d_pre, du = np.zeros((count, cells), np.float32), np.zeros((count, cells), np.float32), np.zeros((len(d_out), 4 * cells), np.float32), np.zeros_like(u)
    for n, rows, i, f, o, g, c, shown, h in reversed(kept):
        d = dh[:n] + d_out[rows]
        cell = dc[:n] + d * o * (1 - shown * shown)
        dz = np.concatenate((cell * g * i * (1 - i), cell * c * f * (1 - f), d * shown * o * (1 - o), cell * i * (1 - g * g)), 1)
        d_pre[rows] = dz
        du += h.T @ dz
        dh[:n], dc[:n] = dz @ u.T, cell * f
    return d_pre, du


@dataclass
class Labeller:
    """Weights: input to gates and bias of both directions, hidden to gates, and the output's."""

    w: list[np.ndarray]

    @staticmethod
    def fresh(seed: int = 0) -> Labeller:
        r = np.random.default_rng(seed)
        small = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        bias = np.zeros(4 * CELLS, np.float32)
        bias[CELLS : 2 * CELLS] = 1
        return Labeller([small(WIDTH, 4 * CELLS), bias, small(CELLS, 4 * CELLS), small(WIDTH, 4 * CELLS), bias.copy(), small(CELLS, 4 * CELLS), small(2 * CELLS, 1)[:, 0], np.zeros(1, np.float32)])

    def scores(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The logit of each block; x: the blocks of all pages one after another."""
        return self._run(x, lengths, None, None)[0]

    def _run(self, x: np.ndarray, lengths: np.ndarray, forward: list | None, backward: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        wf, bf, uf, wb, bb, ub, v, b = self.w
        order, offsets = _sequences(lengths)
        hf = _pass(x @ wf + bf, offsets, lengths[order], False, uf, forward)
        hb = _pass(x @ wb + bb, offsets, lengths[order], True, ub, backward)
        return hf @ v[:CELLS] + hb @ v[CELLS:] + b, hf, hb

    def gradients(self, x: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy over all blocks, as the weights are ordered."""
        forward, backward = [], []
        s, hf, hb = self._run(x, lengths, forward, backward)
        d = ((1 / (1 + np.exp(-np.clip(s, -30, 30))) - labels) / len(labels)).astype(np.float32)
        v = self.w[6]
        df, duf = _back(np.outer(d, v[:CELLS]), forward, len(lengths), self.w[2])
        db, dub = _back(np.outer(d, v[CELLS:]), backward, len(lengths), self.w[5])
        return [x.T @ df, df.sum(0), duf, x.T @ db, db.sum(0), dub, np.concatenate((hf.T @ d, hb.T @ d)), d.sum(keepdims=True)]


#: Names that sites give to what isn't the article, and to what holds it; words that stand in the former.
NAMES = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs submenu tabs links toc pagination",
    "header": "header masthead topbar site-header page-header branding logo banner-top",
    "footer": "footer site-footer page-footer copyright legal bottom colophon credits",
    "aside": "sidebar aside side rail widget widgets related recommended trending more-stories popular tags",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner commercial ad-slot",
    "notice": "cookie cookies consent gdpr notice alert newsletter subscribe popup modal message paywall",
    "form": "form search login signup contact subscribe-form search-form",
    "comments": "comments comment comment-list discussion responses replies reader-comments disqus feedback",
    "share": "share social sharing follow buttons tools meta-links",
}
HOLDS = "content article post entry story main body text entry-content article-body post-content main-content".split()
WRAPS = "page wrapper container row col grid site inner outer layout section box block".split()
SAID = {
    "nav": "Home About Contact News Blog Products Services Next Previous".split(),
    "header": "Welcome Search Menu Login".split(),
    "footer": "© Copyright Imprint Privacy Terms reserved rights".split(),
    "aside": "Related Popular More Recent Tags".split(),
    "ad": "Buy now Sale offer Sponsored Advertisement".split(),
    "notice": "We use cookies Accept Subscribe newsletter".split(),
    "form": "Name Email Password Submit Search Send".split(),
    "comments": "Reply wrote says Comments comment".split(),
    "share": "Share Tweet Print Email".split(),
}
SEMANTIC = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section", "ad": "aside", "notice": "div", "share": "div"}
# characters for private use mark the labels of made-up blocks until the page has been read
KEPT, DROPPED = "\ue000", "\ue001"


class PageMaker:
    """Made-up pages of many layouts, with the words of real ones; their blocks are labelled as they are written."""

    def __init__(self, words: list[str], seed: int = 0):
        self.r, self.words = random.Random(seed), words or "one two three four five six seven eight nine ten".split()

    def say(self, low: int, high: int) -> str:
        n, at = self.r.randint(low, high), self.r.randrange(len(self.words))
        text = " ".join(self.words[k % len(self.words)] for k in range(at, at + n)).replace("&", "&amp;").replace("<", "&lt;")
        return text[:1].upper() + text[1:] + ("." if self.r.random() < 0.8 else "")

    def prose(self) -> str:
        return self.say(1, 6) if self.r.random() < 0.3 else self.say(4, 40) if self.r.random() < 0.7 else self.say(30, 150)

    def named(self, tag: str, names: str) -> str:
        """The start of an element; telling names may come with others, or as an id."""
        name = self.r.choice(names.split())
        more = [self.r.choice(WRAPS)] if self.r.random() < 0.3 else []
        more += [f"c{self.r.randrange(999)}"] if self.r.random() < 0.2 else []
        return f'<{tag} {self.r.choice(("class", "class", "id"))}="{" ".join([name, *more])}">'

    def plain(self, tag: str) -> str:
        return f"<{tag}>" if self.r.random() < 0.6 else f'<{tag} class="{self.r.choice(WRAPS)}">'

    def block(self, tag: str, text: str, mark: str) -> str:
        if self.r.random() < 0.25:
            inner = self.r.choice("b i em strong span".split())
            text = f"<{inner}>{text}" + (f"</{inner}>" if self.r.random() < 0.8 else "<br>")
        return f"<{tag}>{mark}{text}" + (f"</{tag}>" if self.r.random() < 0.9 or tag not in ("p", "li") else "")

    def aside_of(self, kind: str) -> str:
        """A part that isn't the article's."""
        r = self.r
        tag = SEMANTIC[kind] if r.random() < 0.55 else r.choice(("div", "div", "section", "ul" if kind in ("nav", "share") else "div"))
        told = tag in ("nav", "footer", "header", "form") and r.random() < 0.6
        begin = (self.plain(tag) if kind != "header" else f"<{tag}>") if told else self.named(tag, NAMES[kind])
        hint = lambda: " ".join(r.sample(SAID[kind], 1)) + " " if r.random() < 0.3 else ""
        if kind in ("nav", "share") or kind in ("header", "footer", "aside") and r.random() < 0.4:
            items = [f"<li><a href='/{k}'>{DROPPED}{hint()}{self.say(1, 3)}</a></li>" if r.random() < 0.8 else f"<a href='#'>{DROPPED}{self.say(1, 2)}</a> " for k in range(r.randint(1, 9))]
            body = "".join(items) if tag == "ul" else f"<ul>{''.join(items)}</ul>"
        elif kind == "form":
            body = "".join(f"<label>{DROPPED}{hint()}{self.say(1, 3)}</label><input name=x>" for _ in range(r.randint(1, 4))) + f"<button>{DROPPED}{self.say(1, 2)}</button>" + (f"<select><option>{DROPPED}{self.say(1, 2)}<option>{DROPPED}{self.say(1, 2)}</select>" if r.random() < 0.3 else "")
        elif kind == "comments":
            body = (f"<h3>{DROPPED}{hint()}{self.say(1, 3)}</h3>" if r.random() < 0.6 else "") + "".join(f"{self.named('div', NAMES[kind]) if r.random() < 0.6 else '<div>'}{self.block('p', hint() + self.prose(), DROPPED)}</div>" for _ in range(r.randint(1, 6)))
        else:
            loose = r.random() < 0.5
            body = DROPPED + hint() + self.say(2, 30) if loose else "".join(self.block(r.choice(("p", "p", "div", "h4", "li")), hint() + self.say(1, 25), DROPPED) for _ in range(r.randint(1, 4)))
        return f"{begin}{body}</{tag}>"

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            title = self.block(r.choice(("h1", "h1", "h2")), self.say(1, 14), KEPT)
            out.append(f"<header>{title}</header>" if r.random() < 0.1 else title)
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 12, 20))):
            x = r.random()
            if x < 0.78:
                out.append(self.block("p", self.prose(), KEPT))
            elif x < 0.83:
                out.append(self.block(r.choice(("h2", "h3", "h4")), self.say(1, 8), KEPT))
            elif x < 0.88:
                out.append("<ul>" + "".join(self.block("li", self.say(1, 20), KEPT) for _ in range(r.randint(1, 5))) + "</ul>")
            elif x < 0.92:
                out.append(self.block(r.choice(("blockquote", "pre", "figcaption", "div")), self.prose(), KEPT))
            elif x < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{KEPT}{self.say(1, 4)}</td><td>{KEPT}{self.say(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            else:
                out.append(self.aside_of(r.choice(("ad", "ad", "aside", "share", "notice", "form"))))
        if r.random() < 0.08:
            out.append(self.aside_of("comments"))
        body = "".join(out)
        x = r.random()
        if x < 0.5:
            return f"{self.plain('article')}{body}</article>"
        if x < 0.62:
            return f"<main>{body}</main>"
        return f"{self.named(r.choice(('div', 'section')), ' '.join(HOLDS))}{body}</div>" if x < 0.9 else f"{self.plain('div')}{body}</div>"

    def page(self) -> tuple[np.ndarray, np.ndarray]:
        """(cells, labels) of a page's blocks."""
        r = self.r
        may = lambda kind, p: [self.aside_of(kind)] if r.random() < p else []
        before = may("notice", 0.25) + may("header", 0.5) + may("nav", 0.75) + may("form", 0.15) + may("ad", 0.5) + may("aside", 0.15)
        after = may("share", 0.2) + may("comments", 0.35) + may("aside", 0.3) + may("ad", 0.2) + may("form", 0.12) + may("nav", 0.1) + may("footer", 0.8) + may("notice", 0.1)
        inner = "".join(before) + self.article() + "".join(after)
        for _ in range(r.choice((0, 0, 1, 2))):
            inner = f"{self.plain('div')}{inner}</div>"
        # where an element without an end lets texts of both kinds into one block, the first one tells
        found = blocks(f"<html><head><title>{self.say(1, 9)}</title></head><body>{inner}</body></html>", KEPT + DROPPED)
        return found.cells, np.array([m == KEPT for m in found.marks], np.float32)


def fit(words: list[str], seed: int = 0, pages: int = MADE_PAGES, rounds: int = ROUNDS) -> Labeller:
    """A labeller that has seen `rounds` times `pages` made-up pages, by Adam."""
    made = PageMaker(words, seed)
    data = [p for p in (made.page() for _ in range(pages)) if len(p[1])]
    model, r = Labeller.fresh(seed), np.random.default_rng(seed)
    first, second, step, steps = [np.zeros_like(w) for w in model.w], [np.zeros_like(w) for w in model.w], 0, rounds * -(-len(data) // STEP_PAGES)
    for _ in range(rounds):
        order = r.permutation(len(data))
        for lo in range(0, len(order), STEP_PAGES):
            chosen = [data[k] for k in order[lo : lo + STEP_PAGES]]
            grads = model.gradients(np.concatenate([c[0] for c in chosen]), np.array([len(c[1]) for c in chosen]), np.concatenate([c[1] for c in chosen]))
            step += 1
            rate = 0.02 * (1 - 0.9 * step / steps)
            for w, g, m, v in zip(model.w, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model
