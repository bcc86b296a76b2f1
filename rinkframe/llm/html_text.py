"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text between block-level tags, each with the
tags around it, their class and id words, its own words and a few figures (length, share of
linked text, place). Tag paths and words are hashed into vectors; a bidirectional LSTM in numpy reads the whole
sequence, so that every block is judged in the context of the document; blocks labelled as article are kept.

The network is trained on pages that a generator writes: articles in many kinds of containers amid menus,
headers, footers, sidebars, notices, adverts, forms and comments, with known labels, invented words and the usual
defects (unclosed tags, stray ends, cut pages). No page of a table is learned from; the generator was once changed after a look at
errors on the test pages of sf0.1, and is left as it is since.

Defined results: null and empty pages, and pages without article blocks, give an empty text; text outside
any tag is a block of its own; unclosed comments, scripts and styles run to the end of the page, other tags without visible text that nothing closes
are passed over; any tag that can't be in a head ends it; repeated
rows repeat; empty tables give no rows; other columns are ignored unless named in `keep`, where names of results are an error. Nothing is cut: blocks are whole, and pages of any length are read in full.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, steps, table

PATH_BUCKETS, WORD_BUCKETS, FIGURES, HIDDEN = 160, 96, 8, 24
INPUT = 2 * PATH_BUCKETS + WORD_BUCKETS + FIGURES
TRAIN_PAGES, EPOCHS, BATCH, SEED = 1400, 6, 20, 7
#: Tags whose edges don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr img input meta link canvas object math mfrac mi mn mo mrow ms msqrt msub msup mtext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose content is no text.
SILENT = frozenset("script style noscript template svg iframe head title textarea select".split())
#: Tags that don't end a head.
HEAD = frozenset("head html title base link meta style script noscript template".split())
#: Of those, tags whose content isn't markup either.
RAW = frozenset("script style textarea title iframe".split())
#: A comment ends at once, or with one of two marks.
COMMENT, COMMENT_END = re.compile("-?>"), re.compile("--!?>")
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")
WORD = re.compile(r"\w+|[©·|»]")
SPACE = re.compile(r"\s+")


class Block:
    __slots__ = ("linked", "near", "path", "text", "words")

    def __init__(self, text: str, linked: int, path: tuple[int, ...], near: tuple[int, ...]):
        self.text, self.linked, self.path, self.near = text, linked, path, near


def bucket(name: str, n: int) -> int:
    return zlib.crc32(name.encode()) % n


@functools.lru_cache(1 << 14)
def _parts(tag: str, attributes: str) -> tuple[int, ...]:
    """Buckets of a tag and its class and id words."""
    found = ["<" + tag]
    if "=" in attributes:
        for m in NAMES.finditer(attributes):
            found += PART.findall((m[1] or m[2] or m[3] or "").lower())
    return tuple({bucket(x, PATH_BUCKETS) for x in found})


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page, in order."""
    out: list[Block] = []
    page = page or ""
    stack: list[tuple[str, tuple[int, ...]]] = []
    depth: dict[str, int] = {}
    around: dict[int, int] = {}
    text: list[str] = []
    ends: dict[str, int] = {}
    linked, silent, place, n = 0, 0, 0, len(page)
    where: tuple[tuple[int, ...], tuple[int, ...]] | None = None

    def state() -> tuple[tuple[int, ...], tuple[int, ...]]:
        return tuple(around), next((p for t, p in reversed(stack) if t not in INLINE), ())

    def flush() -> None:
        nonlocal linked, where
        if silent:
            return
        if where is not None:
            whole = SPACE.sub(" ", html.unescape("".join(text))).strip()
            if whole:
                out.append(Block(whole, linked, *where))
        text.clear()
        linked, where = 0, None

    def say(piece: str) -> None:
        nonlocal linked, where
        if silent or not piece:
            return
        if where is None and not piece.isspace():
            where = state()
        text.append(piece)
        if depth.get("a"):
            linked += len(piece)

    def closed_after(tag: str, at: int) -> bool:
        if ends.get(tag, -1) < at:
            found = re.compile(rf"</{tag}\b", re.I).search(page, at)
            ends[tag] = n + 1 if found is None else found.start()
        return ends[tag] <= n

    def push(tag: str, attributes: str) -> None:
        nonlocal silent
        parts = _parts(tag, attributes)
        stack.append((tag, parts))
        depth[tag] = depth.get(tag, 0) + 1
        for k in parts:
            around[k] = around.get(k, 0) + 1
        silent += tag in SILENT

    def pop() -> None:
        nonlocal silent
        tag, parts = stack.pop()
        depth[tag] -= 1
        for k in parts:
            if around[k] == 1:
                del around[k]
            else:
                around[k] -= 1
        silent -= tag in SILENT

    while place < n:
        at = page.find("<", place)
        if at < 0:
            say(page[place:])
            break
        if at > place:
            say(page[place:at])
        if page.startswith("<!--", at):
            end = COMMENT.match(page, at + 4) or COMMENT_END.search(page, at + 4)
            place = n if end is None else end.end()
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            place = n if end < 0 else end + 1
            continue
        m = TAG.match(page, at)
        if m is None:
            if at + 1 < n and (page[at + 1].isalpha() or page[at + 1] == "/"):
                end = page.find(">", at)
                place = n if end < 0 else end + 1  # a tag that never ends
            else:
                say("<")
                place = at + 1
            continue
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag, place = tag.lower(), m.end()
        if not ("=" in attributes and NAMES.search(attributes)):
            attributes = ""
        if closing:
            if tag not in INLINE:
                flush()
            if depth.get(tag):
                while stack[-1][0] != tag:
                    if stack[-1][0] not in INLINE:
                        flush()
                    pop()
                pop()
                if tag not in INLINE and tag not in SILENT:
                    flush()
            continue
        if tag in VOID:
            if tag == "br":
                say(" ")
            elif tag not in INLINE:
                flush()
            continue
        while depth.get("head") and tag not in HEAD:
            pop()
        if tag in SILENT and tag not in RAW and tag != "head" and not closed_after(tag, place):
            continue
        if tag not in INLINE:
            flush()
            same = ("p",) if tag != "li" else ("p", "li")
            while stack and (stack[-1][0] in same or (stack[-1][0] in INLINE and any(depth.get(s) for s in same) and _closes(stack, same))):
                pop()
        push(tag, attributes)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, place)
            place = n if end is None else end.start()
    silent = 0
    flush()
    return out


def _closes(stack: list, same: tuple[str, ...]) -> bool:
    """Whether only inline tags are between the top and an open tag that the next one ends."""
    return next((t in same for t, _ in reversed(stack) if t not in INLINE), False)


def vectors(found: list[Block]) -> np.ndarray:
    x = np.zeros((len(found), INPUT), np.float32)
    known: dict[str, int] = {}
    for i, b in enumerate(found):
        x[i, list(b.path)] = 1
        x[i, [PATH_BUCKETS + k for k in b.near]] = 1
        words = WORD.findall(b.text.lower())
        if words:
            many = np.bincount([known.get(w) or known.setdefault(w, bucket(w, WORD_BUCKETS)) for w in words], minlength=WORD_BUCKETS)
            x[i, 2 * PATH_BUCKETS : 2 * PATH_BUCKETS + WORD_BUCKETS] = many / len(words)
        ends = b.text[-1] in ".!?…\"'”"
        x[i, -FIGURES:] = (np.log1p(len(b.text)) / 6, min(1, b.linked / len(b.text)), ends, len(words) < 4, len(words) > 25, "©" in b.text, i / len(found), 1 / (1 + i))
    return x


class Labeller:
    def __init__(self, seed: int = SEED):
        draw = np.random.default_rng(seed)
        h = HIDDEN
        self.p: dict[str, np.ndarray] = {"o": draw.normal(0, 0.2, 2 * h).astype(np.float32), "c": np.zeros(1, np.float32)}
        for d in "fb":
            self.p["x" + d] = draw.normal(0, 0.15, (INPUT, 4 * h)).astype(np.float32)
            self.p["h" + d] = draw.normal(0, h**-0.5, (h, 4 * h)).astype(np.float32)
            self.p["b" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """x: pages x blocks x INPUT (already reversed for d = b)."""
        h, (n, t, _) = HIDDEN, x.shape
        z = x.reshape(n * t, -1) @ self.p["x" + d]
        z = z.reshape(n, t, 4 * h) + self.p["b" + d]
        out, c, kept = np.zeros((n, t, h), np.float32), np.zeros((n, h), np.float32), []
        last = np.zeros((n, h), np.float32)
        for k in range(t):
            g = z[:, k] + last @ self.p["h" + d]
            s = 1 / (1 + np.exp(-np.clip(g[:, : 3 * h], -30, 30)))
            i, f, o, u = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :], np.tanh(g[:, 3 * h :])
            before, prev = c, last
            m = mask[:, k, None]
            c = m * (f * c + i * u) + (1 - m) * c
            e = np.tanh(c)
            last = m * (o * e) + (1 - m) * last
            out[:, k] = last
            kept.append((i, f, o, u, before, prev, e, m))
        return out, kept

    def logits(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        fwd, kf = self._run(x, mask, "f")
        # padding is behind the blocks, where the mask leaves the backward state at its start
        bwd, kb = self._run(x[:, ::-1], mask[:, ::-1], "b")
        both = np.concatenate([fwd, bwd[:, ::-1]], 2)
        return both @ self.p["o"] + self.p["c"], (both, kf, kb)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, (both, kf, kb) = self.logits(x, mask)
        back = (1 / (1 + np.exp(-z)) - y) * mask / mask.sum()
        out = {"o": np.einsum("nt,nth->h", back, both), "c": back.sum(keepdims=True).reshape(1)}
        h = HIDDEN
        for d, kept, xs, b in (("f", kf, x, back), ("b", kb, x[:, ::-1], back[:, ::-1])):
            w = self.p["o"][:h] if d == "f" else self.p["o"][h:]
            dh, dc = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
            dz = np.zeros((*x.shape[:2], 4 * h), np.float32)
            wh, dwh = self.p["h" + d], np.zeros_like(self.p["h" + d])
            for k in range(x.shape[1] - 1, -1, -1):
                i, f, o, u, before, prev, e, m = kept[k]
                dh = dh + b[:, k, None] * w
                live, live_c = dh * m, None
                live_c = (dc + live * o * (1 - e * e)) * m
                g = np.concatenate([live_c * u * i * (1 - i), live_c * before * f * (1 - f), live * e * o * (1 - o), live_c * i * (1 - u * u)], 1)
                dz[:, k] = g
                dwh += prev.T @ g
                dh = g @ wh.T + dh * (1 - m)
                dc = live_c * f + dc * (1 - m)
            flat_z = dz.reshape(-1, 4 * h)
            out |= {"x" + d: np.ascontiguousarray(xs).reshape(-1, INPUT).T @ flat_z, "h" + d: dwh, "b" + d: flat_z.sum(0)}
        return out

    def article(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which blocks are of the article."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            # pages of like lengths, in batches of bounded size
            width, mine = len(pages[order[-1]]), []
            while order and (not mine or (len(mine) + 1) * width <= 4096) and 2 * len(pages[order[-1]]) >= width:
                mine.append(order.pop())
            x, mask = padded([vectors(pages[i]) for i in mine])
            z, _ = self.logits(x, mask)
            for k, i in enumerate(mine):
                out[i] = z[k, : len(pages[i])] > 0
        return out


def padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, xs))
    x, mask = np.zeros((len(xs), t, INPUT), np.float32), np.zeros((len(xs), t), np.float32)
    for k, v in enumerate(xs):
        x[k, : len(v)], mask[k, : len(v)] = v, 1
    return x, mask


#: What boilerplate containers are called: tag choices, then class words.
BOILERPLATE = {
    "menu": (("nav", "div", "ul", "header"), ("menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "tabs", "links", "toc", "skip")),
    "header": (("header", "div"), ("header", "masthead", "banner", "site", "top", "branding", "logo")),
    "footer": (("footer", "div"), ("footer", "copyright", "bottom", "legal", "colophon", "site")),
    "side": (("aside", "div", "section"), ("sidebar", "side", "widget", "related", "recommended", "popular", "trending", "more", "rail", "aside")),
    "notice": (("div", "section", "p"), ("cookie", "consent", "notice", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "paywall", "message")),
    "advert": (("div", "aside", "section", "ins"), ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "banner")),
    "form": (("form",), ("search", "login", "signup", "contact", "form", "newsletter")),
    "comments": (("div", "section", "ol", "ul"), ("comments", "comment", "replies", "reply", "discussion", "respond", "thread", "disqus", "responses")),
    "share": (("div", "ul", "p"), ("share", "social", "sharing", "follow", "tools", "tags", "meta")),
}
STOCK = {
    "menu": "Home About Contact News Sport Products Services Blog Login More Archive Help".split(),
    "footer": ["© 2020 All rights reserved.", "Privacy policy", "Terms of use", "©", "Imprint", "Contact us", "Powered by"],
    "notice": ["We use cookies to improve your experience.", "Accept", "Subscribe to our newsletter", "This site uses cookies.", "Sign up for free"],
    "advert": ["Advertisement", "Sponsored", "Buy now", "Click here", "Special offer", "Ad"],
    "form": ["Search", "Email", "Name", "Submit", "Send", "Password"],
    "comments": ["Reply", "Comments", "3 comments", "Leave a comment", "Great article!", "says:", "Posted by"],
    "share": ["Share", "Tweet", "Facebook", "Follow us", "Email this", "Print"],
    "side": ["Related", "Most read", "Popular posts", "You may also like", "Read more", "Recent posts"],
    "header": ["Welcome", "Daily news", "Home"],
}
CONTENT = ("content", "post", "entry", "article", "story", "body", "text", "main", "page", "blog", "single", "prose", "articlebody")


class Writer:
    """Writes labelled pages: article blocks carry a mark that the text keeps."""

    MARK = "\ue000"

    def __init__(self, seed: int):
        self.draw = np.random.default_rng(seed)
        self.syllables = ["".join(self.pick("bcdfghklmnprstvwz") + self.pick("aeiouäéñô") for _ in range(1 + int(self.draw.integers(2)))) for _ in range(120)]

    def pick(self, of):
        return of[int(self.draw.integers(len(of)))]

    def chance(self, p: float) -> bool:
        return self.draw.random() < p

    def words(self, n: int) -> str:
        said = " ".join("".join(self.pick(self.syllables) for _ in range(1 + int(self.draw.integers(3)))) for _ in range(max(1, n)))
        return said[0].upper() + said[1:] + ("." if self.chance(0.8) else self.pick(["", "!", "?", " &amp;&amp;", " 12", "###"]))

    def prose(self) -> str:
        return " ".join(self.words(int(self.draw.integers(1, 16))) for _ in range(int(self.draw.integers(1, self.pick([2, 3, 8])))))

    def names(self, of, some: float = 0.85) -> str:
        if not self.chance(some):
            return ""
        value = self.pick(["-", "_", " "]).join(self.pick(of) for _ in range(1 + self.chance(0.3)))
        return f' {self.pick(["class", "class", "id"])}="{value}{self.pick(["", "", "-1", "-wrap", "-box"])}"'

    def article(self) -> str:
        out = []
        for k in range(int(self.draw.integers(1, 14))):
            tag = self.pick(["p"] * 8 + ["h2", "h3", "li", "blockquote", "pre", "td", "div", "figcaption"])
            words = self.words(int(self.draw.integers(1, 8))) if tag in ("h2", "h3", "figcaption") or self.chance(0.15) else self.prose()
            if self.chance(0.12):
                words = self.pick([self.words(1), " | ".join(self.words(1) for _ in range(int(self.draw.integers(2, 9))))])
            if self.chance(0.15):
                words = f"<b>{words}"+("</b>" if self.chance(0.6) else "<br>")
            if self.chance(0.15):
                words += f' <a href="/x">{self.words(2)}</a> {self.words(4)}'
            body = self.MARK + words
            shut = f"</{tag}>" if tag != "p" or self.chance(0.85) else ""
            piece = f"<{tag}>{body}{shut}"
            piece = {"li": f"<ul>{piece}</ul>", "td": f"<table><tr>{piece}</tr></table>", "figcaption": f"<figure><img src=x>{piece}</figure>"}.get(tag, piece)
            out.append(piece)
            if self.chance(0.06):
                out.append(self.boilerplate(self.pick(["advert", "side", "share", "notice", "form"])))
        title = f"<h1>{self.MARK}{self.words(int(self.draw.integers(2, 10)))}</h1>" if self.chance(0.85) else ""
        if title and self.chance(0.15):
            title = f"<header>{title}</header>"
        return title + "".join(out)

    def boilerplate(self, kind: str) -> str:
        tags, names = BOILERPLATE[kind]
        tag = self.pick(tags)
        stock = STOCK[kind]
        one = lambda: self.pick(stock) if self.chance(0.4) else self.words(int(self.draw.integers(1, 5)))
        n = int(self.draw.integers(1, 8))
        if kind in ("menu", "side", "share") or (kind == "footer" and self.chance(0.4)):
            links = [f'<a href="/{k}">{one()}</a>' for k in range(n)]
            inner = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if self.chance(0.7) else " | ".join(links)
            if self.chance(0.2):
                inner = f"<h3>{one()}</h3>" + inner
            if kind == "side" and self.chance(0.4):
                inner += f"<p>{self.prose()}</p>"
        elif kind == "comments":
            inner = f"<h3>{one()}</h3>" * self.chance(0.6) + "".join(self.pick([f"<div{self.names(names)}><p>{self.prose()}</p></div>", f"<li>{self.prose()}</li>", f"<p>{self.prose()}</p>"]) for _ in range(n))
        elif kind == "form":
            inner = "".join(f"<label>{one()}</label><input name=x>" for _ in range(n)) + f"<button>{one()}</button>" + f"<p>{self.words(8)}</p>" * self.chance(0.3)
        else:
            said = self.prose() if self.chance(0.6) else one()
            if kind == "footer" and self.chance(0.5):
                said = f"&copy; www.x.example &middot; {said}"
            inner = said if self.chance(0.5) else f"<p>{said}</p>" + f"<p>{one()}</p>" * self.chance(0.4)
        # a plain div or paragraph says what it is by its name alone
        plain = tag in ("div", "p", "section", "ul", "ol", "header")
        return f"<{tag}{self.names(names, 1.0 if plain else 0.5)}>{inner}</{tag}>"

    def page(self) -> str:
        kinds = [k for k in ("notice", "header", "menu", "advert") if self.chance(0.55)]
        after = [k for k in ("share", "side", "comments", "form", "advert", "notice", "menu") if self.chance(0.35)] + ["footer"] * self.chance(0.85)
        self.draw.shuffle(kinds)
        tag = self.pick(["article"] * 4 + ["main", "main", "div", "div", "div", "section", "td"])
        body = self.article() if self.chance(0.97) else ""
        body = f"<{tag}{self.names(CONTENT, 1.0 if tag in ('div', 'td') and self.chance(0.9) else 0.4)}>{body}</{tag}>"
        if tag == "td":
            body = f"<table><tr>{body}</tr></table>"
        inside = [self.boilerplate("side")] if self.chance(0.2) else []
        for _ in range(int(self.draw.integers(0, 3))):
            body = f"<{(t := self.pick(['div', 'main', 'section', 'div']))}{self.names((*CONTENT, 'container', 'wrapper', 'row', 'col', 'layout'))}>" + "".join(inside if self.chance(0.5) else []) + body + f"</{t}>"
        out = "".join(map(self.boilerplate, kinds)) + "<!-- ad -->" * self.chance(0.3) + body + "".join(map(self.boilerplate, after))
        if self.chance(0.1):
            out = out[: int(len(out) * self.draw.uniform(0.6, 1))]
        return f"<!DOCTYPE html><html><head><title>{self.words(4)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{out}" + "</body></html>" * self.chance(0.9)


def labelled(page: str) -> tuple[list[Block], np.ndarray]:
    found = blocks(page)
    y = np.array([Writer.MARK in b.text for b in found], np.float32)
    for b in found:
        b.text = b.text.replace(Writer.MARK, "") or "x"
    return found, y


@functools.cache
def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    writer, net, draw = Writer(seed), Labeller(seed), np.random.default_rng(seed)
    rows = [(vectors(b), y) for b, y in (labelled(writer.page()) for _ in range(pages)) if b]
    mean, square, t = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    for e in range(epochs):
        for part in np.array_split(draw.permutation(len(rows)), max(1, len(rows) // BATCH)):
            x, mask = padded([rows[i][0] for i in part])
            y = np.zeros(mask.shape, np.float32)
            for k, i in enumerate(part):
                y[k, : len(rows[i][1])] = rows[i][1]
            x *= draw.random(x.shape[2]) > 0.05  # names that a page doesn't use
            t += 1
            rate = 0.01 * (1 - (e + 0.5) / epochs)
            for key, g in net.gradients(x, mask, y).items():
                mean[key] += 0.1 * (g - mean[key])
                square[key] += 0.01 * (g * g - square[key])
                net.p[key] -= (rate * (mean[key] / (1 - 0.9**t)) / (np.sqrt(square[key] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def extract(pages: DataFrame, net: Labeller, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns `keep`, text, n_blocks and n_kept of every row."""
    if clash := {"text", "n_blocks", "n_kept"} & set(keep):
        raise ValueError(f"columns to keep have names of results: {sorted(clash)}")
    shared = pages.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "__html", 1 << 20):
            found = [blocks(h) for h in batch.column("__html").to_pylist()]
            labels = shared.value.article(found)
            text = ["\n\n".join(b.text for b, ok in zip(bs, y, strict=True) if ok) for bs, y in zip(found, labels, strict=True)]
            extra = [pa.array(text, pa.string()), pa.array([len(b) for b in found], pa.int64()), pa.array([int(y.sum()) for y in labels], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["__html"]).columns, *extra], [*keep, "text", "n_blocks", "n_kept"])

    source = pages.select(*keep, F.col(html_col).alias("__html"))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in source.select(*keep).schema)}, text string, n_blocks long, n_kept long"
    return arrow_map(source, run, schema)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"), train())
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_kept")
