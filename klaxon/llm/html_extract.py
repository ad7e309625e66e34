"""HTML extraction by a recurrent block labeller: a bidirectional LSTM in numpy reads a page's blocks in order, each as a vector of its tag
path (tags, classes and ids, hashed), its words (hashed) and a few numbers, and classes every block as main text or not with both sides of
the page in view.

A block is the text between two block-level tags; inline tags and <br> don't end one. Comments and the content of script, style, textarea,
title, iframe and of closed noscript, template, select and svg elements are no blocks; all other text is, that of math and object too. The labeller is trained on pages that
`make_page` composes from a seed (TRAIN_PAGES of them, laid out as sites of named parts, bare divisions, tables, documentation and
threads), where each block's label is known: no page of the input takes part in training, so the model is the same for every input.

Defined results: a null html is empty and gives an empty text; null ids and URLs are kept; repeated rows are kept, and equal pages give equal texts; pages of one block or
thousands are labelled whole; an unclosed comment, script, style,
textarea, title or iframe runs to the page's end, other unclosed or self-closed elements hide nothing, a tag cut off there is dropped; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

PATH, WORDS, NUMBERS, HIDDEN = 512, 64, 8, 24
TRAIN_PAGES, EPOCHS, SEED = 2000, 10, 17

_inside = r"[^<]*+(?:<(?!/?NAME\b)[^<]*+)*+"
#: What an element holds, with elements of its own name up to one level deep, and its end.
_closed = r"[^<]*+(?:(?:<(?!/?NAME\b)|<NAME\b[^>]*>INSIDE</NAME\s*>)[^<]*+)*+</NAME\s*>".replace("INSIDE", _inside)
_markup = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(noscript|template|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>" + _closed.replace("NAME", r"\2") +
    r"|<svg\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?<!/)>" + _closed.replace("NAME", "svg") +
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^<>]*(?:>|(?=<)|\Z)",
    re.S | re.I,
)
_names = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_parts = re.compile(r"[a-z]+")
_camel = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Elements without content; those that stand inside a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr object svg "
    "math annotation mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
)
#: An opening tag ends an open element of these.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ends_p = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    for m in _names.finditer(attributes) if "=" in attributes else ():
        for x in _parts.findall(_camel.sub("-", m[2] or m[3] or m[4] or "").lower()):
            out.append("." + x)
    return tuple(out)


def blocks(page: str) -> list[tuple[tuple[int, int], str, int]]:
    """(path, text, characters in links) of the blocks that hold text. A path is the set of its tokens' places, as bits, and how many tokens it has: an
    element adds its own to its parent's, so nesting costs a page nothing however deep it is. No tag looks at more elements than it closes."""
    out: list[tuple[tuple[int, int], str, int]] = []
    # Of an open element: its name, its path, and the place of the innermost open element that is no inline one, itself included.
    stack: list[tuple[str, tuple[int, int], int]] = []
    open_: Counter[str] = Counter()
    text: list[str] = []
    root = path = (0, 0)
    links = at = 0

    def end_block() -> None:
        nonlocal links
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                out.append((path, whole, links))
            text.clear()
        links = 0

    def close_to(k: int) -> None:
        open_.subtract(entry[0] for entry in stack[k:])
        del stack[k:]

    for m in _markup.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            if not text or text == [" "]:
                path = stack[-1][1] if stack else root
            text.append(piece)
            if open_["a"]:
                links += len(piece)
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[0][1] == "/":
            if tag not in INLINE:
                end_block()
            if open_[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close_to(k)
            continue
        if tag not in INLINE:
            end_block()
            ends = CLOSES.get(tag, set()) | ({"p"} if tag in _ends_p else set())  # no inline ones
            k = stack[-1][2] if stack else -1
            if k >= 0 and stack[k][0] in ends:
                close_to(k)
        elif tag == "br":
            text.append(" ")
        if tag not in VOID and not m[4].endswith("/"):
            bits, n = stack[-1][1] if stack else root
            own = _tokens(tag, m[4])
            for token in own:
                bits |= 1 << _path_hash[token]
            stack.append((tag, (bits, n + len(own)), (stack[-1][2] if stack else -1) if tag in INLINE else len(stack)))
            open_[tag] += 1
    if at < len(page):
        path = path if text else stack[-1][1] if stack else root
        text.append(page[at:])
    end_block()
    return out


class _Hash(dict):
    def __init__(self, size: int):
        self.size = size

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode()) % self.size
        if len(self) < 200_000:
            self[word] = h
        return h


_path_hash, _word_hash = _Hash(PATH), _Hash(WORDS)


def vectorise(found: list[tuple[tuple[int, int], str, int]]) -> np.ndarray:
    x = np.zeros((len(found), PATH + WORDS + NUMBERS), np.float32)
    for k, ((bits, depth), text, links) in enumerate(found):
        x[k, :PATH] = np.unpackbits(np.frombuffer(bits.to_bytes(PATH // 8, "little"), np.uint8), bitorder="little")
        words = text.split(" ")
        tally = np.bincount([_word_hash[w] for w in words], minlength=WORDS)
        x[k, PATH : PATH + WORDS] = tally / np.sqrt(tally @ tally)
        n = len(text)
        x[k, PATH + WORDS :] = (
            np.log1p(len(words)) / 5, np.log1p(n) / 8, min(1.0, links / n), text[-1] in ".!?:\"'", text[0].isupper(), depth / 20, sum(map(text.count, ".,;")) / len(words), 1.0,
        )
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Bidirectional LSTM with one logistic output for each block."""

    def __init__(self, rng: np.random.Generator, size: int = PATH + WORDS + NUMBERS, hidden: int = HIDDEN):
        self.hidden = hidden
        self.p = {"o": rng.normal(0, 0.2, (2 * hidden, 1)).astype(np.float32), "ob": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"{d}x": rng.normal(0, 0.1, (size, 4 * hidden)).astype(np.float32), f"{d}h": rng.normal(0, 0.1, (hidden, 4 * hidden)).astype(np.float32), f"{d}c": np.zeros(4 * hidden, np.float32)}
            self.p[f"{d}c"][hidden : 2 * hidden] = 1

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        n, steps, _ = x.shape
        h = c = np.zeros((n, self.hidden), np.float32)
        pre, w, k = x @ self.p[f"{d}x"] + self.p[f"{d}c"], self.p[f"{d}h"], self.hidden
        out = np.empty((n, steps, k), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ w
            g = _sigmoid(z)
            g[:, 2 * k : 3 * k] = np.tanh(z[:, 2 * k : 3 * k])
            m = mask[:, t, None]
            h0, c0 = h, c
            c = (g[:, k : 2 * k] * c0 + g[:, :k] * g[:, 2 * k : 3 * k]) * m
            s = np.tanh(c)
            h = g[:, 3 * k :] * s * m
            out[:, t] = h
            if keep is not None:
                keep.append((t, g, h0, c0, s, m))
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return (np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b")], axis=2) @ self.p["o"])[..., 0] + self.p["ob"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self._run(x, mask, d, kept[d]) for d in "fb"], axis=2)
        p = _sigmoid((h @ self.p["o"])[..., 0] + self.p["ob"])
        total = max(1.0, float(mask.sum()))
        loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum()) / total
        dz = (mask * (p - y) / total)[..., None]
        g = {"o": np.tensordot(h, dz, ([0, 1], [0, 1])), "ob": dz.sum((0, 1))}
        dh_all, k = dz @ self.p["o"].T, self.hidden
        for d, part in (("f", dh_all[..., :k]), ("b", dh_all[..., k:])):
            dpre = np.zeros((*x.shape[:2], 4 * k), np.float32)
            dh = dc = np.zeros((len(x), k), np.float32)
            dw = np.zeros_like(self.p[f"{d}h"])
            for t, gate, h0, c0, s, m in reversed(kept[d]):
                a = (part[:, t] + dh) * m
                i, f, n, o = (gate[:, j * k : (j + 1) * k] for j in range(4))
                dc = (dc + a * o * (1 - s * s)) * m
                z = np.concatenate([dc * n * i * (1 - i), dc * c0 * f * (1 - f), dc * i * (1 - n * n), a * s * o * (1 - o)], axis=1)
                dpre[:, t] = z
                dw += h0.T @ z
                dh, dc = z @ self.p[f"{d}h"].T, dc * f
            g[f"{d}x"], g[f"{d}h"], g[f"{d}c"] = np.tensordot(x, dpre, ([0, 1], [0, 1])), dw, dpre.sum((0, 1))
        return loss, g


# Words that pages use to name their parts, and that stand in them: fixed values of the page maker.
NAMES = {
    "nav": "nav navbar navigation menu topnav mainmenu submenu breadcrumb breadcrumbs pagination pager tabs skip toc sitemap dropdown links tree".split(),
    "header": "header masthead banner top topbar branding logo site-header tagline site-title".split(),
    "footer": "footer bottom copyright site-footer legal colophon credits foot".split(),
    "aside": "sidebar side aside widget related popular trending recommended rail more-stories most-read tags tagcloud archive author-box bio teaser promo-list".split(),
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay banner-notice warning subscribe-wall paywall newsletter toast message disclaimer".split(),
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion ad-slot ad-container banner-ad google-ad commercial partner dfp adbox".split(),
    "form": "form search searchbox login signup subscribe contact-form comment-form register newsletter-form fields".split(),
    "comments": "comments comment comment-list commentlist respond replies reply discussion disqus thread user-comment responses feedback answers".split(),
    "share": "share social sharing follow share-buttons addthis likes".split(),
    "main": "article content post entry story main body text entry-content post-content article-body story-body blog-post page-content maintext post-body prose copy markdown-body document question".split(),
    "any": "wrapper container page row col inner outer wrap clearfix site box block grid group section layout region column large center left right".split(),
}
LABELS = "Home|About|About us|Contact|News|Products|Services|Blog|Login|Sign up|Sign in|Help|FAQ|Search|Next|Previous|More|Read more|Share|Tweet|Follow us|Subscribe|Privacy|Terms|Terms of use|Cookies|Accept|Reject all|Sitemap|Careers|Press|Reply|Like|Categories|Tags|Archive|Related|Popular|Comments|Index|Forum|Shop|Members|API|Guide|Download|Start|Kontakt|Impressum|Datenschutz|Suche|Accueil|Recherche|Mentions|Inicio|Contacto|Buscar|Aviso".split("|")
SHORT_TEXT = {
    "notice": "We use cookies on this site|By going on you accept our cookies|JavaScript is needed here|This site uses cookies. Learn more.|Subscribe to continue reading|You have {n} free articles left|{t}".split("|"),
    "footer": "© {y} {s}|(c) {y} {s} - {t}|All rights reserved|Copyright {y} {s}. All rights reserved.|Powered by {s}|{t}|{s}, {n} {w} Street".split("|"),
    "ad": "Advertisement|Sponsored: {t}|{t}|Buy {w} now! {t}|Ad|Save {n}% on {w}".split("|"),
    "form": "Your email|Name|Send|Submit|Password|Leave a comment|Search this site|{w}:".split("|"),
    "share": "Share on {w}|Tweet this|Share this|Email|Print|{n} shares".split("|"),
    "comments": "{n} comments|{s} says:|{t}|{t}|Reply|{t} {t}|Posted by {s}, {n} days ago|{t} {t} {t}|#{n} {s} wrote|{n} votes".split("|"),
    "aside": "Related articles|{s}|{t}|Most read|About the author|{t}|{w} ({n})|{t} {t}".split("|"),
    "header": "{s}|{t}|The {s} Times".split("|"),
    "nav": "{w}".split("|"),
}
COMMON = ["the of and to in is that for it with as on be this", "der die und in den von zu das mit sich ist", "de la le et les des en un du une que est", "de la que el en los del se las por un para"]


PARAGRAPHS = ["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<p class='t'>{}</p>"]


class _Page:
    """Pieces of a made page, and whether the text of each is main text."""

    def __init__(self, r: random.Random):
        self.r, self.pieces = r, []
        self.syllables = [r.choice("bcdfghjklmnpqrstvwxyzéüñç") + r.choice("aeiouäèó") + r.choice(["", "n", "r", "s", "t"]) for _ in range(60)]
        self.common = r.choice(COMMON).split()
        self.named = r.random() < 0.75  # whether this site names its parts
        self.paragraph = r.choice(PARAGRAPHS)
        self.noise = r.choice(["~~", "@@", "==", "^", "::", ">>"]) if r.random() < 0.15 else ""

    def put(self, piece: str, main: bool = False) -> None:
        self.pieces.append((piece, main))

    def word(self) -> str:
        r = self.r
        return r.choice(self.common) if r.random() < 0.4 else "".join(r.choices(self.syllables, k=r.choice([1, 2, 2, 3, 4])))

    def sentence(self, n: int | None = None) -> str:
        r = self.r
        words = [self.word() + (r.choice(["", "", ","]) if r.random() < 0.1 else "") for _ in range(n or r.randint(2, 22))]
        s = " ".join(words)
        return s[0].upper() + s[1:] + r.choice([".", ".", ".", "", "?", "!"])

    def prose(self) -> str:
        r = self.r
        s = " ".join(self.sentence() for _ in range(r.choice([1, 1, 2, 3, 5, 8])))
        if self.noise and r.random() < 0.6:
            s = " ".join(w + (self.noise if r.random() < 0.7 else "") for w in s.split()).replace(">", "&gt;")
        x = r.random()
        if x < 0.06:
            s = s.upper()
        elif x < 0.12:
            s = " ".join([r.choice([self.word(), self.sentence(3)])] * r.randint(3, 50))
        elif x < 0.3:
            tag = r.choice(["em", "strong", "span", "code", "i", "font"])
            s = s.replace(" ", f" <{tag}>{self.word()}</{tag}> ", 1)
        elif x < 0.45:
            s += f' <a href="/{self.word()}">{self.word()} {self.word()}</a> {self.sentence(3)}'
        elif x < 0.5:
            s = s.replace(". ", ".<br>", 2)
        elif x < 0.6:  # it begins with marked words
            tag = r.choice(["b", "strong", "em", "a", "span", "u"])
            s = f"<{tag}>{self.sentence(r.randint(1, 4))}</{tag}> {s}"
        return s

    def fill(self, kind: str) -> str:
        r = self.r
        s = r.choice(SHORT_TEXT[kind]).replace("{s}", r.choice([self.word().title(), f"{self.word()} {self.word()}".title(), f"{self.word()}.example"]))
        return s.replace("{t}", self.sentence()).replace("{w}", self.word()).replace("{n}", str(r.randint(1, 99))).replace("{y}", str(r.randint(1998, 2025)))

    def tag(self, kind: str, tags: list[str]) -> tuple[str, str]:
        """An element of one of these tags, named after its kind if the site names its parts and its tag doesn't say it."""
        r, tag = self.r, self.r.choice(tags)
        says = tag in ("nav", "header", "footer", "aside", "form", "article", "main")
        names = [r.choice(NAMES[kind]), *r.choices(NAMES["any"], k=r.choice([0, 0, 1]))] if self.named and not (says and r.random() < 0.6) else r.choices(NAMES["any"], k=r.choice([0, 0, 1]))
        return f"<{tag}" + (f' {r.choice(["class", "class", "id"])}="{" ".join(names)}"' if names else "") + ">", f"</{tag}>"

    def menu(self, tags: list[str]) -> None:
        r = self.r
        a, b = self.tag("nav", tags)
        form = r.choice(["<li>{}</li>", "<li>{}</li>", "{}", "<div>{}</div>", "{} | ", "{}<br>", "<p>{}</p>"])
        listed = form.startswith("<li")
        self.put(a + "<ul>" * listed)
        for _ in range(r.randint(2, 12)):
            label = r.choice(LABELS) if r.random() < 0.6 else " ".join(self.word() for _ in range(r.choice([1, 1, 2, 3])))
            self.put(form.replace("{}", f'<a href="/{self.word()}">{label}</a>' if r.random() < 0.93 else label))
        self.put("</ul>" * listed + b)

    def region(self, kind: str, tags: list[str] | None = None) -> None:
        r = self.r
        if kind == "nav":
            return self.menu(tags or ["nav", "nav", "div", "ul", "div"])
        usual = {"header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "aside": ["aside", "aside", "div", "section"], "form": ["form", "form", "div"], "comments": ["section", "div", "ol"], "share": ["div", "ul"]}
        a, b = self.tag(kind, tags or usual.get(kind, ["div", "div", "section"]))
        self.put(a)
        if kind == "aside" and r.random() < 0.4:
            self.put(f"<h3>{self.fill(kind)}</h3>")
        linked = kind in ("aside", "share", "footer") and r.random() < 0.5
        for _ in range({"footer": 2, "ad": 1, "notice": 1, "header": 2}.get(kind, r.randint(1, 6))):
            t = self.fill(kind)
            if kind == "comments" and r.random() < 0.4:
                t = self.prose()
            self.put(f"<li><a href='#'>{t}</a></li>" if linked else r.choice(["{}", "<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "<span>{}</span><br>"]).replace("{}", t))
        if kind == "form":
            self.put(f"<input><button>{self.fill(kind)}</button>")
        self.put(b)
        return None

    def body(self, inside: tuple[str, ...] = ("ad", "share", "aside", "notice", "form")) -> None:
        """Main text: a title, paragraphs, lists, tables, code; at times with other parts between."""
        r = self.r
        if r.random() < 0.75:
            t = self.sentence(r.randint(2, 9))
            self.put(r.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>", "<p><b>{}</b></p>"]).replace("{}", t), True)
        mixed = inside and r.random() < 0.25
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14, 30])):
            x = r.random()
            if x < 0.04:
                same = f"<p>{self.sentence(r.randint(1, 6))}</p>"  # some pages repeat a line
                for _ in range(r.randint(2, 12)):
                    self.put(same, True)
            elif x < 0.12:
                self.put(f"<p>{self.sentence(r.randint(1, 3))}</p>", True)
            elif x < 0.7:
                self.put((self.paragraph if r.random() < 0.9 else r.choice(PARAGRAPHS)).replace("{}", self.prose()), True)
            elif x < 0.78:
                self.put(f"<h{r.choice('234')}>{self.sentence(r.randint(1, 6))}</h{r.choice('234')}>", True)
            elif x < 0.85:
                tag = r.choice(["ul", "ul", "ol"])
                self.put(f"<{tag}>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(r.randint(2, 6))) + f"</{tag}>", True)
            elif x < 0.89:
                self.put(f"<blockquote>{self.prose()}</blockquote>", True)
            elif x < 0.93:
                self.put(f"<pre><code>{self.word()}({self.word()}) = {self.word()}</code></pre>", True)
            elif x < 0.97:
                self.put("<table>" + "".join(f"<tr><td>{self.word()}</td><td>{self.sentence(4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>", True)
            else:
                self.put(f"<dl><dt>{self.word()}</dt><dd>{self.sentence()}</dd></dl><figure><img><figcaption>{self.sentence(5)}</figcaption></figure>", True)
            if mixed and r.random() < 0.2:
                named, self.named = self.named, True  # nothing else tells such a part from the text around it
                self.region(r.choice(inside))
                self.named = named

    def some(self, *chances: tuple[str, float]) -> None:
        for kind, p in chances:
            if self.r.random() < p:
                self.region(kind)


def _site(p: _Page, main: list[str]) -> None:
    """Parts above, main text in an element or bare, parts below."""
    p.some(("notice", 0.2), ("header", 0.4), ("nav", 0.75), ("ad", 0.35), ("form", 0.15), ("share", 0.1), ("aside", 0.2))
    if p.r.random() < 0.9:
        a, b = p.tag("main", main)
        p.put(a)
        p.body()
        p.put(b)
    else:
        p.body(())
    p.some(("share", 0.2), ("ad", 0.25), ("comments", 0.4), ("form", 0.2), ("aside", 0.4), ("nav", 0.25), ("footer", 0.75), ("notice", 0.15))


def _table_site(p: _Page) -> None:
    """A layout of table cells: a bar above, a menu, the text, a column beside it, a line below."""
    r = p.r
    p.put(f'<center><table width="{r.choice(["100%", "760"])}" border="0"><tr><td colspan="3">')
    p.some(("header", 0.8), ("nav", 0.4), ("ad", 0.2))
    left, right = r.random() < 0.8, r.random() < 0.5
    p.put("</td></tr><tr>")
    if left:
        p.put('<td width="150" valign="top">')
        p.menu(["div", "p", "font", "table"])
        p.some(("form", 0.2), ("ad", 0.2))
        p.put("</td>")
    p.put('<td valign="top">')
    p.body(("ad",))
    p.put("</td>")
    if right:
        p.put("<td>")
        p.some(("aside", 0.8), ("ad", 0.4))
        p.put("</td>")
    p.put('</tr><tr><td colspan="3" align="center">')
    if r.random() < 0.5:
        p.put(p.fill("footer"))
    else:
        p.some(("footer", 0.8), ("nav", 0.3))
    p.put("</td></tr></table></center>")


def _docs_site(p: _Page) -> None:
    """A tree of pages at one side, breadcrumbs, the text with code and tables, contents of the page, links to its neighbours."""
    p.some(("header", 0.6), ("nav", 0.6), ("form", 0.3))
    a, b = p.tag("any", ["div", "div", "section"])
    p.put(a)
    p.menu(["nav", "aside", "div"])
    c, d = p.tag("main", ["main", "div", "article"])
    p.put(c)
    p.some(("nav", 0.3))
    p.body(())
    p.some(("nav", 0.4), ("form", 0.1))
    p.put(d)
    p.some(("nav", 0.3))
    p.put(b)
    p.some(("footer", 0.6))


def _thread_site(p: _Page) -> None:
    """A post with its readers' answers below."""
    p.some(("header", 0.5), ("nav", 0.8), ("form", 0.2))
    a, b = p.tag("main", ["div", "article", "section", "td"])
    p.put("<table><tr>" * (a[1:3] == "td") + a)
    p.body(())
    p.put(b + "</tr></table>" * (a[1:3] == "td"))
    p.some(("share", 0.2), ("ad", 0.2))
    for _ in range(p.r.choice([1, 1, 2, 3])):
        p.region("comments")
    p.some(("form", 0.4), ("aside", 0.3), ("footer", 0.7))


def make_page(r: random.Random) -> list[tuple[str, bool]]:
    """Pieces of a page and whether the text of each is main text."""
    p = _Page(r)
    p.put(f"<html><head><title>{p.sentence(4)}</title><script>if (a < b) {{ {p.word()}() }}</script></head><body>")
    outer = p.tag("any", ["div"]) if r.random() < 0.4 else ("", "")
    p.put(outer[0])
    x = r.random()
    if x < 0.35:
        _site(p, ["article", "article", "main", "div"])
    elif x < 0.65:
        p.named = p.named or r.random() < 0.6
        _site(p, ["div", "div", "section"])
    elif x < 0.78:
        _table_site(p)
    elif x < 0.89:
        _docs_site(p)
    else:
        _thread_site(p)
    p.put(outer[1] + r.choice(["</body></html>", "</body></html>", ""]))
    return p.pieces


def labelled(pieces: list[tuple[str, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of a made page, and their labels: each piece of main text stands between marks that no text holds."""
    # A mark goes behind each tag and word of a main piece's text, so every block that it forms holds one.
    page = "".join(re.sub(r">([^<]*[^<\s][^<]*)", ">\\1", s) if main else s for s, main in pieces)
    found = blocks(page)
    y = np.array(["" in t for _, t, _ in found], np.float32)
    return vectorise([(p, t.replace("", "") or ".", n) for p, t, n in found]), y


def _batch(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, xs))
    x, mask = np.zeros((len(xs), steps, xs[0].shape[1]), np.float32), np.zeros((len(xs), steps), np.float32)
    for k, own in enumerate(xs):
        x[k, : len(own)], mask[k, : len(own)] = own, 1
    return x, mask


@functools.lru_cache(maxsize=2)
def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    r, rng = random.Random(seed), np.random.default_rng(seed)
    data = [d for d in (labelled(make_page(r)) for _ in range(pages)) if len(d[0])]
    model = Labeller(rng)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step, size, total = 0, 32, epochs * -(-len(data) // 32)
    for _ in range(epochs):
        order = sorted(range(len(data)), key=lambda k: (len(data[k][0]) + rng.integers(0, 6)))
        runs = [order[k : k + size] for k in range(0, len(order), size)]
        for k in rng.permutation(len(runs)):
            x, mask = _batch([data[j][0] for j in runs[k]])
            y = np.zeros_like(mask)
            for row, j in enumerate(runs[k]):
                y[row, : len(data[j][1])] = data[j][1]
            x[..., :PATH] *= rng.random((len(x), 1, PATH)) > 0.1  # some names are unknown on other sites
            x[..., PATH : PATH + WORDS] *= rng.random((*x.shape[:2], 1)) > 0.5
            _, g = model.gradients(x, mask, y)
            step += 1
            rate = 0.01 * min(1, step / 20) * (1 - 0.95 * step / (total + 1))
            for name, grad in g.items():
                first[name] = 0.9 * first[name] + 0.1 * grad
                second[name] = 0.99 * second[name] + 0.01 * grad * grad
                model.p[name] -= (rate * first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def label(model: Labeller, pages: list[list]) -> list[np.ndarray]:
    """Of each page's blocks, which are main text. Pages of like length run together, about 4,000 blocks at a time."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order, at = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k])), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= 4_000:
            end += 1
        mine = order[at:end]
        x, mask = _batch([vectorise(pages[k]) for k in mine])
        found = model.logits(x, mask) > 0
        for row, k in enumerate(mine):
            out[k] = found[row, : len(pages[k])]
        at = end
    return out


def extract_text(pages: list[str], model: Labeller) -> list[str]:
    found = [blocks(p) for p in pages]
    return ["\n".join(t for (_, t, _), keep in zip(b, y.tolist(), strict=True) if keep) for b, y in zip(found, label(model, found), strict=True)]


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 2 << 20):
                texts = extract_text(part.column("html").to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
