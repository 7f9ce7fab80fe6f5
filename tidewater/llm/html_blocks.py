"""Main text of web pages: a recurrent labeller over the pages' blocks."""

from __future__ import annotations

import functools
import html
import io
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import LOWER, chunks, find_words, segment_hash, text_bytes
from .common import ship

# Elements without an end, elements whose text is not shown, elements that don't end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style title noscript template textarea iframe select datalist head annotation annotation-xml".split())
#: Elements that may stand in a head; any other start tag ends it, and so does text.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
RAW = frozenset("script style title noscript textarea iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
                   "math annotation annotation-xml maction menclose merror mfenced mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split())
#: A start tag of the key ends an open element of these names.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements beyond which an implied end doesn't look.
WALLS = frozenset("article aside body div footer form header main nav ol section table td th ul".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|<(?=[/a-zA-Z!?])[^>]*\Z", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

PATH, WORDS, DENSE = 256, 48, 32
WIDTH = PATH + WORDS + DENSE
HIDDEN_UNITS = 24
#: Labellers whose mean decides.
MODELS = 3
#: Of a block's ancestors, features are made from so many nearest and so many outermost ones: the cost of a page doesn't grow with its depth squared.
NEAREST, OUTERMOST = 20, 6
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 caption figcaption".split())
CELLS = frozenset("td th".split())


@dataclass
class Block:
    text: str
    path: list[str]  # names of ancestors and of their classes, identifiers and roles, the nearest last
    linked: int = 0  # characters inside links
    inside: tuple[int, ...] = ()  # the nearest ancestors, the nearest first, as numbers within the page
    tag: str = ""
    depth: int = 0


def blocks_of(page: str) -> list[Block]:
    """The page's leaf blocks in order: text between two boundaries of block elements, character references decoded in each piece of text, white space
    reduced; the tag path as names of elements and of their classes, identifiers and roles. Wrong nesting and cut-off pages are read leniently."""
    out: list[Block] = []
    stack: list[tuple[str, list[str], int]] = []
    hidden = links = made = 0
    pieces: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        nonlocal pieces, linked
        text = " ".join("".join(pieces).split())
        if text:
            near = stack[-NEAREST:]
            path = [n for _, names, _ in [*stack[: max(0, min(OUTERMOST, len(stack) - NEAREST))], *near] for n in names]
            tag = next((t for t, _, _ in reversed(near) if t not in INLINE), "")
            out.append(Block(text, path, len(" ".join("".join(linked).split())), tuple(k for _, _, k in reversed(near)), tag, len(stack)))
        pieces, linked = [], []

    def say(text: str) -> None:
        if text.strip():
            end_head()
        if not hidden:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if links:
                linked.append(text)

    def pop_to(k: int) -> None:
        nonlocal hidden, links
        for tag, _, _ in stack[k:]:
            hidden -= tag in HIDDEN
            links -= tag == "a"
        del stack[k:]

    def end_head() -> None:
        if stack and stack[-1][0] == "head":
            pop_to(len(stack) - 1)

    at = 0
    while found := TAG.search(page, at):
        if found.start() > at:
            say(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if not found[1] and tag not in IN_HEAD:
            end_head()
        if tag not in INLINE:
            flush()
        elif tag == "br":
            say(" ")
        if found[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
            continue
        if tag in VOID:
            continue
        closes = ENDS.get(tag, set()) | (set() if tag in INLINE else {"p"})
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in closes:
                pop_to(k)
                break
            if stack[k][0] in WALLS and stack[k][0] not in closes:
                break
        if found[3].rstrip().endswith("/") and tag in HIDDEN:
            continue
        names = [tag, *(p.lower() for m in NAMED.finditer(found[3]) for p in PART.findall(m[1] or m[2] or m[3] or ""))]
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        made += 1
        stack.append((tag, names, made))
        hidden += tag in HIDDEN
        links += tag == "a"
    rest = page[at:]
    if rest:
        say(rest)
    flush()
    return out


@functools.lru_cache(1 << 16)
def slot(name: str) -> tuple[int, float]:
    h = zlib.crc32(name.encode())
    return h % PATH, 1.0 if h >> 31 else -1.0


def vectors(pages: list[list[Block]]) -> np.ndarray:
    """One row per block of all pages: hashed tag path, hashed words, and numbers on the block and on the elements around it."""
    blocks = [b for p in pages for b in p]
    x = np.zeros((len(blocks), WIDTH), np.float32)
    if not blocks:
        return x
    for row, b in zip(x, blocks, strict=True):
        for name in set(b.path):
            i, sign = slot(name)
            row[i] += sign
        for depth, name in enumerate(b.path[-3:]):
            i, sign = slot(f"{depth - min(3, len(b.path))}:{name}")
            row[i] += sign
    data, offsets = text_bytes(pa.array([b.text for b in blocks]))
    starts, ends, first = find_words(data, offsets)
    words = segment_hash(LOWER[data], starts, ends)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(len(blocks)), n_words)
    sign = np.where(words >> np.uint64(63), 1.0, -1.0)
    counts = np.bincount(doc * WORDS + (words % np.uint64(WORDS)).astype(np.int64), sign, len(blocks) * WORDS).reshape(-1, WORDS)
    x[:, PATH : PATH + WORDS] = 2 * counts / np.maximum(np.sqrt((counts**2).sum(1)), 1)[:, None]
    chars = np.maximum(np.array([len(b.text) for b in blocks]), 1)
    share = np.array([b.linked for b in blocks]) / chars
    stops = np.array([b.text.count(".") + b.text.count(",") for b in blocks])
    digits = np.array([sum(map(b.text.count, "0123456789")) for b in blocks]) / chars
    place = np.concatenate([np.arange(len(p)) / max(1, len(p)) for p in pages if p])
    last = np.array([b.text[-1] in ".!?:" for b in blocks])
    dense = [
        np.log1p(n_words) / 3, share, stops / np.maximum(n_words, 1), place, np.minimum([b.depth for b in blocks], 20) / 10, n_words > 12, last, ["©" in b.text for b in blocks], digits,
        [b.tag in HEADINGS for b in blocks], [b.tag in CELLS for b in blocks], [b.tag == "p" for b in blocks], [b.tag in ("li", "dt", "dd") for b in blocks], [b.tag in ("", "body", "html") for b in blocks],
        share > 0.9, [b.text[0].isupper() for b in blocks], [b.text.isupper() for b in blocks], np.concatenate([np.full(len(p), np.log1p(len(p)) / 3) for p in pages if p]),
        *around(pages, n_words, share, last),
    ]
    x[:, PATH + WORDS : PATH + WORDS + len(dense)] = np.column_stack(dense)
    return x


def around(pages: list[list[Block]], n_words: np.ndarray, share: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Of the three nearest ancestors of each block: the share of the page's words in it, the share of its words in links, the share of
    them in blocks that end like sentences; and whether the block before and the one after have the same parent."""
    rows = []
    k = 0
    for p in pages:
        words: dict[int, float] = {}
        links: dict[int, float] = {}
        prose: dict[int, float] = {}
        total = 0.0
        for j, b in enumerate(p, k):
            n = float(n_words[j])
            total += n
            for e in b.inside:
                words[e] = words.get(e, 0.0) + n
                links[e] = links.get(e, 0.0) + n * share[j]
                prose[e] = prose.get(e, 0.0) + n * last[j]
        for j, b in enumerate(p):
            row = []
            for d in range(3):
                e = b.inside[d] if d < len(b.inside) else None
                row += [words[e] / total, links[e] / words[e], prose[e] / words[e]] if e is not None and words[e] else [1.0, 0.0, 0.0]
            up = b.inside[1] if len(b.inside) > 1 else -1
            row += [float(j > 0 and p[j - 1].inside[1:2] == (up,)), float(j + 1 < len(p) and p[j + 1].inside[1:2] == (up,))]
            rows.append(row)
        k += len(p)
    return list(np.array(rows).T)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Labeller:
    """A bidirectional LSTM with one logistic output per block."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        h = HIDDEN_UNITS
        made = {}
        for way in ("ahead", "back"):
            made[f"{way}_in"] = rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, 4 * h))
            made[f"{way}_own"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            made[f"{way}_bias"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        made["out"], made["out_bias"] = rng.normal(0, 0.3, 2 * h), np.zeros(1)
        return Labeller({k: v.astype(np.float32) for k, v in made.items()})

    def walk(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: (time, pages, WIDTH). States stand still where the mask is 0, so padding changes nothing."""
        h = HIDDEN_UNITS
        steps = range(len(x)) if way == "ahead" else range(len(x) - 1, -1, -1)
        put = x @ self.weights[f"{way}_in"] + self.weights[f"{way}_bias"]
        state, cell = np.zeros((x.shape[1], h), x.dtype), np.zeros((x.shape[1], h), x.dtype)
        out = np.zeros((*x.shape[:2], h), x.dtype)
        for t in steps:
            gates = put[t] + state @ self.weights[f"{way}_own"]
            i, f, o = sigmoid(gates[:, :h]), sigmoid(gates[:, h : 2 * h]), sigmoid(gates[:, 2 * h : 3 * h])
            g = np.tanh(gates[:, 3 * h :])
            m = mask[t][:, None]
            fresh = f * cell + i * g
            squashed = np.tanh(fresh)
            if keep is not None:
                keep.append((t, i, f, o, g, cell, state, squashed, m))
            cell = np.where(m, fresh, cell)
            state = np.where(m, o * squashed, state)
            out[t] = state
        return out

    def score(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.walk("ahead", x, mask), self.walk("back", x, mask)], axis=2)
        return sigmoid(both @ self.weights["out"] + self.weights["out_bias"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h = HIDDEN_UNITS
        kept: dict[str, list] = {"ahead": [], "back": []}
        both = np.concatenate([self.walk(way, x, mask, kept[way]) for way in kept], axis=2)
        off = (np.where(mask, sigmoid(both @ self.weights["out"] + self.weights["out_bias"]) - y, 0) / mask.sum()).astype(x.dtype)
        grads = {"out": np.einsum("tb,tbh->h", off, both), "out_bias": np.array([off.sum()])}
        for k, way in enumerate(kept):
            from_out = off[:, :, None] * self.weights["out"][k * h : (k + 1) * h]
            own = self.weights[f"{way}_own"]
            d_in, d_own = np.zeros((*x.shape[:2], 4 * h), x.dtype), np.zeros_like(own)
            d_state, d_cell = np.zeros((x.shape[1], h), x.dtype), np.zeros((x.shape[1], h), x.dtype)
            for t, i, f, o, g, cell, state, squashed, m in reversed(kept[way]):
                d_state = d_state + from_out[t]
                here, c = np.where(m, d_state, 0), np.where(m, d_cell, 0) + np.where(m, d_state, 0) * o * (1 - squashed**2)
                gates = np.concatenate([c * g * i * (1 - i), c * cell * f * (1 - f), here * squashed * o * (1 - o), c * i * (1 - g**2)], axis=1)
                d_in[t] = gates
                d_own += state.T @ gates
                d_state = np.where(m, gates @ own.T, d_state)
                d_cell = np.where(m, c * f, d_cell)
            grads[f"{way}_in"] = x.reshape(-1, x.shape[2]).T @ d_in.reshape(-1, 4 * h)
            grads[f"{way}_own"], grads[f"{way}_bias"] = d_own, d_in.sum((0, 1))
        return grads


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(r) for r in rows)
    x, mask = np.zeros((longest, len(rows), WIDTH), np.float32), np.zeros((longest, len(rows)), bool)
    for k, r in enumerate(rows):
        x[: len(r), k], mask[: len(r), k] = r, True
    return x, mask


def label(models: list[Labeller], pages: list[list[Block]], together: int = 4096) -> list[np.ndarray]:
    """The score of every block, the mean of the models'. Pages of like length run side by side."""
    x = vectors(pages)
    edges = np.concatenate(([0], np.cumsum([len(p) for p in pages])))
    out = [np.zeros(0)] * len(pages)
    order = [k for k in sorted(range(len(pages)), key=lambda k: len(pages[k])) if pages[k]]
    while order:
        n = max(1, min(len(order), together // len(pages[order[0]])))
        while n > 1 and len(pages[order[n - 1]]) * n > 2 * together:
            n //= 2
        group, order = order[:n], order[n:]
        data, mask = padded([x[edges[k] : edges[k + 1]] for k in group])
        score = np.mean([m.score(data, mask) for m in models], axis=0)
        for j, k in enumerate(group):
            out[k] = score[: len(pages[k]), j]
    return out


# The pages that the labeller learns from are made up: what they vary is the language, where the article stands, what it is called, what it is made of
# and what surrounds it. A mark stands before each text of the article; it is taken out once blocks are cut.
MARK = ""
COMMON = (
    "the of and to in is that for it as with on by this was are from at be have not or but",
    "der die und das in den von zu mit ist auf für nicht ein eine dem sich als auch es an bei",
    "de la le et les des en un une du est pour que qui dans sur pas au par plus avec ce",
    "de la que el en y los se del las un por con una para es no su al lo como más",
    "",
)
HOLDERS = (
    "article: article:post article: main: main:content div:content div:main-content div:post-body div:entry-content div:story-body section:article-body div:article div:text div:page td: div: div: div: section: "
    "div:body-copy section:main div:odd div:odd div:odd div:mw-content-text div:markdown-body div:document bare bare"
).split()
PLAIN = "div: div: div:wrapper div:container div:page div:layout div:row div:inner div:site main: section: div:odd center: form:".split()
KINDS: dict[str, tuple[str, str]] = {
    "menu": (
        "nav: nav: div:menu ul:navigation div:navbar div:breadcrumb nav:main-nav div:topnav div:tabs div:nav header:nav ol:breadcrumbs div:",
        "home|about us|contact|login|news|sport|sign up|products|blog|help|startseite|über uns|kontakt|anmelden|nachrichten|suche|accueil|à propos|connexion|actualités|inicio|contacto|noticias|entrar",
    ),
    "header": ("header: div:header div:masthead header:site-header div:site-title div:topbar header:top div:logo div:branding", "welcome to the site|your daily source|search this site|menu|skip to content|willkommen|bienvenue|bienvenidos"),
    "footer": (
        "footer: footer: div:footer div:site-footer footer:bottom div:copyright div:legal footer:page-footer div:foot p:copyright div: p:",
        "© 2024 all rights reserved|privacy policy|terms of use|imprint|contact|© example.org ·|powered by|alle rechte vorbehalten|datenschutz|impressum|tous droits réservés|mentions légales|todos los derechos reservados|aviso legal",
    ),
    "side": (
        "aside: aside: div:sidebar aside:widget div:related div:recommended section:more-stories div:widget div:trending div:tags div:share div:social div:popular ul:related-links div:author-box div:pagination div:toc",
        "most read|related articles|follow us|popular posts|share this|read more|next|previous|meistgelesen|mehr zum thema|teilen|à lire aussi|partager|más leídas|compartir|tags",
    ),
    "notice": (
        "div:cookie-notice div:consent div:notice div:banner div:newsletter div:gdpr div:alert div:popup div:paywall section:subscribe div:cookie-banner dialog: div:modal aside:newsletter",
        "we use cookies to improve this site|accept all|subscribe to our newsletter|by continuing you agree|wir verwenden cookies|alle akzeptieren|nous utilisons des cookies|tout accepter|usamos cookies|aceptar todo",
    ),
    "advert": ("div:ad div:ad div:ads div:advert div:sponsored div:promo ins:adsbygoogle aside:advertisement div:ad-slot div:advertisement section:sponsor aside:ad div:banner-ad", "advertisement|sponsored content|buy now|limited offer|anzeige|werbung|publicité|publicidad"),
    "form": ("form: form:search form:login form:comment-form form:subscribe form:contact", "your email|leave a comment|submit|enter your name|password|suchen|absenden|envoyer|enviar"),
    "comment": (
        "div:comments section:comments div:comment-list ol:commentlist div:discussion div:disqus div:replies div:user-comments section:reviews ul:comment-thread",
        "posted by|reply|says|report comment|3 comments|comments|kommentare|antworten|commentaires|répondre|comentarios|responder",
    ),
}


class Maker:
    """Writes one page."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.common = rng.choice(COMMON).split()
        letters = [c + v for c in "bcdfghklmnprstvwz" for v in "aeiou"] + ["an", "er", "ion", "ung", "é", "ción", "ß", "ö", "th", "st"]
        self.syllables = rng.sample(letters, 14)
        self.noise = rng.choice([[""]] * 10 + [["***"], [" |"], ["!!"], ["%%%"], ["&&&", "***", "$$$", "###", "", "%%%"], ["~", "", "//"]])
        self.shout = rng.random() < 0.04

    def words(self, low: int, high: int) -> list[str]:
        rng = self.rng
        return [rng.choice(self.common) if self.common and rng.random() < 0.35 else "".join(rng.choices(self.syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high))]

    def prose(self, low: int, high: int) -> str:
        rng, words = self.rng, self.words(low, high)
        at = 0
        while at < len(words):
            words[at] = words[at].capitalize()
            if at:
                words[at - 1] += rng.choice(".....,?!:")
            at += rng.randint(4, 14)
        if rng.random() < 0.85:
            words[-1] += "."
        if rng.random() < 0.02:
            words = rng.choices(words[:2], k=len(words))
        text = " ".join(w + rng.choice(self.noise) for w in words)
        return text.upper() if self.shout else text

    def label(self) -> str:
        return " ".join(self.words(1, 4)).capitalize()

    def number(self) -> str:
        return self.rng.choice([f"{self.rng.randint(1, 9999)}", f"{self.rng.random() * 100:.1f} %", f"{self.rng.randint(1, 31)}.{self.rng.randint(1, 12)}.20{self.rng.randint(10, 29)}", f"{self.rng.random():.2f}"])

    def odd(self) -> str:
        return "".join(self.rng.choices("abcdefghkmnpqrstuvwxyz", k=self.rng.randint(1, 6))) + self.rng.choice(["", "1", "-2", "_x", "07"])

    def wrap(self, kind: str, inner: str) -> str:
        if kind == "bare":
            return inner
        tag, _, name = kind.partition(":")
        name = self.odd() if name == "odd" else name
        if name and self.rng.random() < 0.2:
            name = self.rng.choice([f"{self.odd()} {name}", f"{name}-{self.odd()}", name.title().replace("-", "")])
        return f"<{tag}" + (f' {self.rng.choice(["class", "class", "id"])}="{name}"' if name else "") + f">{inner}</{tag}>"

    # what isn't the article
    def rubbish(self, kind: str) -> str:
        rng = self.rng
        holders, phrases = (x.split(by) for x, by in zip(KINDS[kind], (" ", "|"), strict=True))
        holder = rng.choice(holders)
        named = not holder.endswith(":") or holder.partition(":")[0] not in ("div", "p")
        wordy = kind in ("comment", "advert", "footer", "notice")
        items = [rng.choice(phrases).capitalize() if rng.random() < 0.4 else self.prose(3, 45) if wordy and named and rng.random() < 0.5 else self.label() for _ in range(rng.randint(1, 7))]
        shape = rng.random()
        if kind == "footer" and (not named or shape < 0.5):
            items = [f"{rng.choice(['©', '© 2023', 'Copyright ©', '(c)', '&copy;', '&copy; 2021'])} {self.label()}.example.{rng.choice(['org', 'com', 'net'])} {rng.choice(['·', '|', '-', '&middot;'])} {self.prose(2, 40) if named else rng.choice(phrases)}"]
            inner = rng.choice(["{}", "<p>{}</p>", "<div>{}</div>", "<small>{}</small>"]).format(items[0])
        elif kind == "comment":
            each = "".join(self.wrap(rng.choice(["div:comment", "li:comment", "article:comment", "li:", "div:reply"]), f"<b>{self.label()}</b> {rng.choice(phrases)}<p>{self.prose(2, 50)}</p>") for _ in range(rng.randint(1, 5)))
            level = rng.randint(2, 4)
            inner = rng.choice(["", f"<h{level}>{rng.choice(phrases).capitalize()}</h{level}>"]) + each
        elif kind == "form":
            inner = "".join(f"<label>{t}</label><input name=x>" if rng.random() < 0.6 else f"<p>{t}</p>" for t in items) + f"<select><option>{self.label()}</select><button>{rng.choice(phrases)}</button>"
        elif kind == "menu" or not named or (kind in ("side", "footer") and shape < 0.7):
            inner = "".join(f'<li><a href="/{rng.randint(1, 99)}">{t}</a></li>' for t in items) if shape < 0.8 else rng.choice([" ", " | ", " · "]).join(f"<a href=x>{t}</a>" for t in items)
            inner = f"<ul>{inner}</ul>" if shape < 0.8 and not holder.startswith(("ul", "ol")) else inner
            if kind == "side" and rng.random() < 0.6:
                inner = f"<h3>{rng.choice(phrases).capitalize()}</h3>{inner}"
        elif kind in ("advert", "notice", "header") and shape < 0.6:
            inner = self.prose(3, 60)
        elif shape < 0.75:
            inner = " ".join(items)
        else:
            inner = "".join(f"<p>{t}</p>" for t in items)
        if kind in ("notice", "advert") and rng.random() < 0.3:
            inner += f"<button>{rng.choice(phrases)}</button>"
        return self.wrap(holder, inner)

    # what is
    def inline(self, text: str) -> str:
        """Text of the article, parts of it in inline elements."""
        words = (text.replace("a", "&#97;", 1) if self.rng.random() < 0.05 else text).split(" ")
        if len(words) > 4 and self.rng.random() < 0.35:
            a = self.rng.randrange(len(words) - 1)
            b = self.rng.randint(a + 1, min(len(words), a + 5))
            tag = self.rng.choice(["a href=y", "b", "em", "strong", "i", "code", "span", "math"])
            words[a:b] = [f"<{tag}>{' '.join(words[a:b])}</{tag.split()[0]}>"]
        return MARK + " ".join(words)

    def part(self, depth: int = 0) -> str:
        rng = self.rng
        shape = rng.random()
        if shape < 0.45:
            return f"<p>{self.inline(self.prose(1, 6) if rng.random() < 0.2 else self.prose(6, 120))}</p>"
        if shape < 0.51:
            return f"<p><b>{self.inline(self.prose(5, 80))}<br>"
        if shape < 0.58:
            level = rng.randint(2, 4)
            return f"<h{level}>{MARK}{self.label()}</h{level}><p>{self.inline(self.prose(5, 80))}</p>"
        if shape < 0.66:
            tag = rng.choice(["ul", "ul", "ol"])
            item = rng.choice(["<li>{}</li>", "<li><p>{}</p></li>", "<li>{}"])
            return f"<{tag}>" + "".join(item.format(self.inline(self.prose(1, 25) if rng.random() < 0.5 else self.label())) for _ in range(rng.randint(1, 7))) + f"</{tag}>"
        if shape < 0.70:
            return "<dl>" + "".join(f"<dt>{MARK}{self.label()}</dt><dd>{self.inline(self.prose(2, 25))}</dd>" for _ in range(rng.randint(1, 5))) + "</dl>"
        if shape < 0.79:
            wide = rng.randint(1, 5)
            cell = lambda tag: f"<{tag}>{MARK}{rng.choice([self.number, self.label, self.label, lambda: self.prose(2, 15)])()}</{tag}>"
            head = f"<thead><tr>{''.join(cell('th') for _ in range(wide))}</tr></thead>" if rng.random() < 0.6 else ""
            caption = f"<caption>{MARK}{self.label()}</caption>" if rng.random() < 0.25 else ""
            return f"<table{rng.choice(['', '', ' class=wikitable', ' border=1', ' class=data'])}>{caption}{head}" + "".join(f"<tr>{''.join(cell('td') for _ in range(wide))}</tr>" for _ in range(rng.randint(1, 6))) + "</table>"
        if shape < 0.84:
            return f"<blockquote>{rng.choice(['{}', '<p>{}</p>']).format(self.inline(self.prose(5, 60)))}</blockquote>"
        if shape < 0.88:
            lines = "\n".join(" ".join(self.words(1, 5)) + rng.choice(["(x)", " = 1;", ":", "{", "()", ""]) for _ in range(rng.randint(1, 6)))
            return rng.choice([f"<pre>{MARK}{lines}</pre>", f"<pre><code>{MARK}{lines}</code></pre>", f'<div class="highlight"><pre>{MARK}{lines}</pre></div>'])
        if shape < 0.91:
            return f"<figure><img src=x><figcaption>{MARK}{self.prose(3, 20)}</figcaption></figure>"
        if shape < 0.94:
            return f"{self.inline(self.prose(5, 60))}<br><br>" if rng.random() < 0.5 else f"<object data=x><p>{MARK}{self.prose(3, 30)}</p></object>"
        if depth < 2:
            return self.wrap(rng.choice(["div:", "section:", "div:section", "div:odd", "div:text", "div:row", "div:chapter"]), "".join(self.part(depth + 1) for _ in range(rng.randint(1, 4))))
        return f"<div>{self.inline(self.prose(4, 50))}</div>"

    def article(self) -> str:
        rng, parts = self.rng, []
        if rng.random() < 0.85:
            level = rng.choice([1, 1, 1, 2])
            title = f"<h{level}>{MARK}{self.prose(2, 12)}</h{level}>"
            parts.append(f"<header>{title}</header>" if rng.random() < 0.08 else title)
        for _ in range(rng.choice([1, 2, 3, 4, 4, 5, 6, 8, 10, 14, 25])):
            parts.append(self.part())
            if rng.random() < 0.06:
                parts.append(self.rubbish(rng.choice(["advert", "advert", "side", "notice", "form"])))
        if rng.random() < 0.04:  # many short lines, often the same
            lines = [self.prose(1, 6) for _ in range(rng.randint(1, 3))]
            parts += [rng.choice(["<p>{}</p>", "<p>{}</p>", "<p><b>{}<br>"]).format(MARK + rng.choice(lines)) for _ in range(rng.randint(10, 120))]
        if rng.random() < 0.5 or len(parts) == 1:
            parts.append(f"<p>{self.inline(self.prose(1, 40))}</p>")
        return self.wrap(rng.choice(HOLDERS), "".join(parts))

    def page(self) -> str:
        rng = self.rng
        before = [self.rubbish(k) for k in ("header", "menu", "notice", "advert", "side", "form") if rng.random() < 0.45]
        after = [self.rubbish(k) for k in ("side", "advert", "comment", "form", "menu", "notice") if rng.random() < (0.45 if k == "comment" else 0.33)]
        foot = [self.rubbish("footer")] if rng.random() < 0.85 else []
        kind = rng.random()
        if kind < 0.07:  # nothing but its article
            before, after, foot = [], [], []
        rng.shuffle(before)
        rng.shuffle(after)
        middle = [] if kind > 0.98 else [self.article()]
        if 0.07 < kind < 0.13:  # columns by a table
            body = f"<table><tr><td>{''.join(before)}</td><td>{''.join(middle)}</td><td>{''.join(after)}</td></tr></table>{''.join(foot)}"
        elif kind < 0.25:  # columns by boxes
            body = "".join(self.wrap(rng.choice(PLAIN), "".join(x)) for x in (before, middle, after) if x) + "".join(foot)
        elif kind < 0.4:  # what follows the article stands in its box
            body = "".join(before) + self.wrap(rng.choice(PLAIN), "".join([*middle, *after])) + "".join(foot)
        else:
            body = "".join([*before, *middle, *after, *foot])
        for _ in range(rng.randint(0, 3)):
            body = self.wrap(rng.choice(PLAIN), body)
        head = f"<head><title>{self.label()}</title><style>p{{}}</style></head>" if rng.random() < 0.9 else ""
        return f"<html>{head}<body>{body}</body></html>" if rng.random() < 0.95 else body


def made_up_page(seed: str) -> tuple[list[Block], np.ndarray]:
    """A page's blocks, and 1 for those of its article."""
    found = blocks_of(Maker(random.Random(seed)).page())
    wanted = np.array([MARK in b.text for b in found], np.float32)
    for b in found:
        b.text = b.text.replace(MARK, "")
    return [b for b in found if b.text], np.array([w for w, b in zip(wanted, found, strict=True) if b.text], np.float32)


@functools.lru_cache(2)
def trained(seed: int = 7, n_pages: int = 1600, rounds: int = 6, rate: float = 0.01, together: int = 50) -> Labeller:
    """Trains on made-up pages; the same seed gives the same weights, but for the order in which a machine adds."""
    made = [made_up_page(f"{seed}:{k}") for k in range(n_pages)]
    made = [m for m in made if m[0]]
    x = vectors([m[0] for m in made])
    edges = np.concatenate(([0], np.cumsum([len(m[0]) for m in made])))
    rows = [x[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    model = Labeller.fresh(seed)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    rng = np.random.default_rng(seed)
    by_length = sorted(range(len(made)), key=lambda k: len(rows[k]))
    groups = [by_length[k : k + together] for k in range(0, len(made), together)]
    n_steps = rounds * len(groups)
    step = 0
    for _ in range(rounds):
        for g in rng.permutation(len(groups)):
            data, mask = padded([rows[k] for k in groups[g]])
            y = np.zeros(mask.shape, np.float32)
            for j, k in enumerate(groups[g]):
                y[: len(rows[k]), j] = made[k][1]
            step += 1
            pace = np.float32(rate * min(1.0, 2 * (1 - step / (n_steps + 1))))
            for k, grad in model.gradients(data, mask, y).items():
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.99 * second[k] + 0.01 * grad**2
                model.weights[k] = (model.weights[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


_labellers: dict[int, list[Labeller]] = {}


def labellers(spark: SparkSession, seed: int = 7, n: int = MODELS) -> list[Labeller]:
    """Labellers that have each seen other pages, trained by n tasks of the cluster, where numpy keeps to its core."""
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                to = io.BytesIO()
                np.savez(to, **trained(seed + k).weights)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([to.getvalue()], pa.binary())], names=["k", "weights"])

    if seed not in _labellers:
        rows = spark.range(n, numPartitions=n).mapInArrow(train, "k long, weights binary").collect()
        _labellers[seed] = []
        for row in sorted(rows, key=lambda r: r.k):
            with np.load(io.BytesIO(row.weights)) as found:
                _labellers[seed].append(Labeller({k: found[k] for k in found.files}))
    return _labellers[seed]


def main_text(pages: list[str | None], models: list[Labeller]) -> list[str]:
    found = [blocks_of(p or "") for p in pages]
    return ["\n".join(b.text for b, s in zip(blocks, scores, strict=True) if s >= 0.5) for blocks, scores in zip(found, label(models, found), strict=True)]


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", seed: int = 7) -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``.

    Pages are cut into leaf blocks; a bidirectional LSTM reads each page's sequence of blocks, as vectors of tag path, hashed words and
    numbers, and labels every block with the whole page in view; the means of MODELS such labellers decide. The article's blocks are joined by newlines. The labellers are trained on
    made-up pages by one task each, once a session, in a time that doesn't depend on the input, and broadcast. Nothing is shuffled.

    What is never shown isn't a block: heads, scripts, styles, templates, fallbacks for missing scripts, frames, and what selection lists and text areas hold.

    Nulls: null html is empty and gives an empty text; null identifiers and urls are passed through. Repeated rows give repeated results, an
    empty table none. Pages of any length and depth are read whole. Other columns are ignored.
    """
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(labellers(spark, seed))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html", 1 << 20):
            texts = main_text(batch.column(2).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(apply, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
