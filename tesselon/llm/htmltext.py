"""Main-text extraction with a linear-chain conditional random field over DOM leaf blocks.

Method: a page becomes the sequence of its leaf blocks, the runs of text that no block element
divides, each with the elements around it.  A conditional random field with two states, article and
rest, sees which elements a block stands in, words of their class and id names, whether its cell holds
most of the text of a table that lays out the page, and features of its text.  It is trained by gradient ascent on the log-likelihood of labelled pages (``labelled_pages``
makes them from many layouts), and decoded by Viterbi.  The text of the blocks in state article, in
page order, is the result; nothing is capped.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tesselon.llm.store import by_slices

# Element kinds of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_DROPPED = frozenset("script style textarea title iframe noembed noframes noscript template svg canvas audio video object select button head annotation annotation-xml".split())
_FOREIGN = frozenset(("svg",))
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()) | frozenset("math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd menclose".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_TWINS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table td th body article section div main".split())

_MARK = re.compile(r"<(?:!--|(/?)[a-zA-Z]|[!?/])")
_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTES = re.compile(r"(?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*+>")
_COMMENT = re.compile(r">|->|.*?(?:--!?>|\Z)", re.S)
_EMPTY = re.compile(r"(?:(?<!\S)[^\s=\"']*|[\"'])/$")
_NAMES = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_CUES = re.compile(r"cookie|subscrib|newsletter|share|comment|advert|sponsor|sign in|log in|copyright|©|privacy|related|read more|repl[yi]", re.I)


class Element:
    """An element that is open: its tag, the words of class, id and role, and the element around it."""

    __slots__ = ("tag", "names", "above", "block")

    def __init__(self, tag: str, names: tuple[str, ...], above: Element | None):
        self.tag, self.names, self.above = tag, names, above
        #: The tag of the nearest element that is no inline one.
        self.block: str = tag if tag not in _INLINE else above.block if above else "none"


def around(element: Element | None) -> list[tuple[str, tuple[str, ...]]]:
    """(tag, names) of an element and those around it, the outermost first."""
    out = []
    while element is not None:
        out.append((element.tag, element.names))
        element = element.above
    return out[::-1]


class Page:
    """The tags of a page; every search that finds nothing is made once."""

    def __init__(self, text: str):
        self.text = text
        self.last = text.rfind(">")
        self.endless: set[str] = set()

    def tag(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether an end tag, name, attributes) of the next tag; comments have no name.

        A ``<`` that begins none is text, as is a tag that the page ends in.
        """
        text = self.text
        while (start := text.find("<", at)) >= 0:
            m = _MARK.match(text, start)
            if m and m.group() == "<!--":
                return start, _COMMENT.match(text, start + 4).end(), False, "", ""
            if not m or start > self.last:
                at = start + 1
            elif m[1] is None:
                return start, text.index(">", start) + 1, False, "", ""
            else:
                name = _NAME.match(text, m.end() - 1)
                rest = _ATTRIBUTES.match(text, name.end())
                end = rest.end() if rest else text.find(">", name.end()) + 1
                if end:
                    return start, end, bool(m[1]), name.group().lower(), text[name.end() : end - 1]
                at = start + 1
        return None

    def after(self, tag: str, at: int) -> int:
        """Where the text of a raw element ends, its end tag included; 0 if it has none."""
        if tag not in self.endless:
            m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(self.text, at)
            if m:
                return m.end()
            self.endless.add(tag)
        return 0


def leaf_blocks(html_text: str) -> list[tuple[str, Element | None, int]]:
    """(text, innermost element, characters inside links) of each leaf block with text.

    End tags that are left out are filled in where the standard says so.  A dropped element without an
    end tag ends with its parent or, unless it is a template, where the next block begins.
    """
    out: list[tuple[str, Element | None, int]] = []
    page = Page(html_text)
    stack: list[Element] = []
    count: dict[str, int] = {}  # open elements by tag
    parts: list[str] = []
    linked = 0
    hidden: list[int] = []  # places in the stack of dropped elements without an end tag
    foreign = 0  # of those, the foreign ones
    headed = False
    ends: dict[int, int] | None = None
    at, n = 0, len(html_text)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                place = hidden[0] if hidden else len(stack)
                out.append((text, stack[place - 1] if place else None, linked))
            linked = 0

    def text_to(end: int) -> None:
        nonlocal linked
        if end > at and not hidden:
            t = html_text[at:end]
            if "&" in t:
                t = html.unescape(t)
            parts.append(t)
            if count.get("a"):
                linked += len(t)

    def pop_to(k: int) -> None:
        nonlocal foreign
        if any(x.tag not in _INLINE and x.tag not in _DROPPED for x in stack[k:]):
            flush()
        while hidden and hidden[-1] >= k:
            foreign -= stack[hidden.pop()].tag in _FOREIGN
        for x in stack[k:]:
            count[x.tag] -= 1
        del stack[k:]

    def push(tag: str, names: tuple[str, ...] = ()) -> None:
        stack.append(Element(tag, names, stack[-1] if stack else None))
        count[tag] = count.get(tag, 0) + 1

    def close(tags: tuple[str, ...], scope: frozenset[str] | tuple[str, ...]) -> None:
        """End the innermost element of these tags, unless one of ``scope`` stands in it."""
        if any(count.get(t) for t in tags):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in tags:
                    pop_to(k)
                    return
                if stack[k].tag in scope:
                    return

    while at < n:
        found = page.tag(at)
        if not found:
            text_to(n)
            break
        start, end, closing, tag, attributes = found
        text_to(start)
        at = end
        if not tag:
            continue
        if closing:
            if count.get(tag):
                close((tag,), ())
            elif tag not in _INLINE:
                flush()
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br":
                parts.append("\n")
            continue
        if tag == "head":
            if not headed:
                headed, at = True, _skip_head(page, at)
            continue
        if tag in _DROPPED:
            parts.append(" ")
            if (foreign or tag in _FOREIGN) and _EMPTY.search(attributes):
                continue
            if tag in _RAW:
                at = page.after(tag, at) or (at if foreign else n)
                continue
            if ends is None:
                ends = _ends(page, start)
            if tag in _ALONE and count.get(tag):
                for k in hidden:
                    if stack[k].tag == tag:
                        pop_to(k)
                        break
            if at in ends:
                at = ends[at]
            else:
                hidden.append(len(stack))
                foreign += tag in _FOREIGN
                push(tag)
            continue
        if hidden and (tag in _CLOSES_P or tag in _TWINS and tag != "option") and stack[hidden[0]].tag != "template":
            pop_to(hidden[0])
        if tag in _CLOSES_P:
            close(("p",), _SCOPE)
        elif tag in _TWINS:
            close(_TWINS[tag], ("ul", "ol", "dl", "table"))
        if tag not in _INLINE:
            flush()
        if tag in _VOID or attributes.endswith("/") and tag not in _CLOSES_P:
            continue
        names: tuple[str, ...] = ()
        if "=" in attributes or "hidden" in attributes:
            words = [w for g in _NAMES.findall(attributes) for w in _WORD.findall("".join(g).lower())]
            if _HIDDEN.search(attributes):
                words.append("hidden")
            names = tuple(dict.fromkeys(words))
        push(tag, names)
    flush()
    return out


_HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])|display\s*:\s*none")
#: Elements that do not stand in one another: the next ends the one before.
_ALONE = frozenset(("button", "select"))


def _ends(page: Page, at: int) -> dict[int, int]:
    """Where each dropped element with an end tag of its own begins (after the start tag) and ends."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    count: dict[str, int] = {}

    def pop() -> int:
        tag, begin = stack.pop()
        count[tag] -= 1
        return begin

    while found := page.tag(at):
        _, at, closing, tag, attributes = found
        if not tag or tag in _INLINE or tag in _VOID:
            continue
        if closing:
            if count.get(tag):
                while stack[-1][0] != tag:
                    pop()
                begin = pop()
                if tag in _DROPPED:
                    ends[begin] = at
            continue
        foreign = any(count.get(t) for t in _FOREIGN)
        if (foreign or tag in _FOREIGN) and _EMPTY.search(attributes):
            continue
        if tag in _RAW:
            at = page.after(tag, at) or (at if foreign else len(page.text))
            continue
        if tag in _ALONE and count.get(tag):
            while stack[-1][0] != tag:
                pop()
            pop()
        stack.append((tag, at))
        count[tag] = count.get(tag, 0) + 1
    return ends


_HEAD_END = re.compile(r"</head[^>]*>|(?=<body[\s>])|(?=<(?:article|main|div|p|h1|nav|header|section|footer)[\s>])", re.I)
_HEAD_RAW = re.compile(r"<(script|style|title|noscript|template)\b", re.I)


def _skip_head(page: Page, at: int) -> int:
    """The end of the head: scripts and styles in it are passed over whole."""
    end, raw = _HEAD_END.search(page.text, at), _HEAD_RAW.search(page.text, at)
    while True:
        if end and end.start() < at:
            end = _HEAD_END.search(page.text, at)
        if raw and raw.start() < at:
            raw = _HEAD_RAW.search(page.text, at)
        if not raw or end and end.start() < raw.start():
            return end.end() if end else at
        tag = raw[1].lower()
        at = page.after(tag, raw.end()) or (raw.end() if tag == "template" else len(page.text))


_CELLS = frozenset(("td", "th"))
#: Elements that a table which lays out a page may stand in, as far as the text itself is concerned.
_TEXT = frozenset(("article", "main"))
#: Elements of a table; a cell with any other block in it lays out a page.
_OF_TABLES = frozenset("table thead tbody tfoot tr td th caption".split())


def layout_cells(blocks: list[tuple[str, Element | None, int]]) -> dict[Element, bool]:
    """Elements in the cells of tables that lay out the page: whether all cells around hold the most of theirs.

    A table does so if one of its cells holds a block other than bare text and it is not part of an
    article.  One pass from the innermost elements outwards and one back, however deep they stand.
    """
    depth: dict[Element, int] = {}
    size: dict[Element, int] = {}
    for text, element, _ in blocks:
        if element is not None:
            size[element] = size.get(element, 0) + len(text)
        way = []
        while element is not None and element not in depth:
            way.append(element)
            element = element.above
        k = depth[element] if element is not None else 0
        for x in reversed(way):
            k += 1
            depth[x] = k
    if not any(x.tag in _CELLS for x in depth):
        return {}
    inner = sorted(depth, key=depth.__getitem__, reverse=True)
    for x in inner:
        if x.above is not None:
            size[x.above] = size.get(x.above, 0) + size.get(x, 0)
    # (table, its cell, whether in an article) around each element, itself included
    place: dict[Element | None, tuple[Element | None, Element | None, bool]] = {None: (None, None, False)}
    most: dict[Element, int] = {}
    lays: set[Element] = set()
    for x in reversed(inner):
        table, cell, text = place[x.above]
        if cell is not None and table is not None and not text and (x.tag == "table" or x.tag not in _OF_TABLES and x.tag not in _INLINE):
            lays.add(table)
        if x.tag == "table":
            table, cell = x, None
        elif x.tag in _CELLS and table is not None and cell is None:
            cell = x
            most[table] = max(most.get(table, 0), size[x])
        place[x] = table, cell, text or x.tag in _TEXT
    out: dict[Element, bool] = {}
    for x in reversed(inner):
        table, cell, _ = place[x]
        above = out.get(x.above)
        if x is cell and table in lays:
            out[x] = above is not False and size[x] == most[table]
        elif above is not None:
            out[x] = above
    return out


def block_features(blocks: list[tuple[str, Element | None, int]], known: dict | None = None) -> list[list[str]]:
    """The features of each block; of the elements around it those in ``known``, if that is given."""
    out = []
    memo: dict[Element | None, tuple[str, ...]] = {None: ()}

    def inside(element: Element | None) -> tuple[str, ...]:
        way = []
        while element not in memo:
            way.append(element)
            element = element.above
        f = memo[element]
        for x in reversed(way):
            new = [g for g in (f"in:{x.tag}", *(f"name:{w}" for w in x.names)) if g not in f and (known is None or g in known)]
            memo[x] = f = (*f, *new) if new else f
        return f

    cells = layout_cells(blocks)
    for text, element, linked in blocks:
        f = ["bias", *inside(element), f"block:{element.block if element else 'none'}"]
        if not any(x.startswith("name:") for x in f):
            f.append("unnamed")
        if element in cells:
            f.append("cell:most" if cells[element] else "cell:less")
        words = text.count(" ") + 1
        f.append(f"words:{min(7, words.bit_length())}")
        f.append("end:stop" if text[-1] in ".!?…:;\"”»" else "end:open")
        f.append(f"links:{min(3, 4 * linked // max(1, len(text)))}")
        f += [f"cue:{c.lower()}" for c in set(_CUES.findall(text))] if words < 40 else []
        out.append(f)
    return out


class Field:
    """Weights of the field: (features x 2) emissions and (2 x 2) transitions."""

    def __init__(self, index: dict[str, int], emission: np.ndarray, transition: np.ndarray):
        self.transition = transition.tolist()
        self.weight = {f: tuple(emission[i].tolist()) for f, i in index.items()}

    def viterbi(self, sequence: list[list[str]]) -> list[int]:
        """The best states, 1 for article."""
        (t00, t01), (t10, t11) = self.transition
        get, none = self.weight.get, (0.0, 0.0)
        back = []
        a = b = 0.0
        for k, features in enumerate(sequence):
            e0 = e1 = 0.0
            for f in features:
                x, y = get(f, none)
                e0 += x
                e1 += y
            if k:
                s00, s10, s01, s11 = a + t00, b + t10, a + t01, b + t11
                back.append((s10 > s00, s11 > s01))
                a, b = max(s00, s10) + e0, max(s01, s11) + e1
            else:
                a, b = e0, e1
        if not sequence:
            return []
        state = int(b > a)
        states = [state]
        for way in reversed(back):
            state = int(way[state])
            states.append(state)
        return states[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Gradient ascent (Adagrad) on the conditional log-likelihood."""
    index: dict[str, int] = {}
    data = [([np.array([index.setdefault(f, len(index)) for f in block]) for block in seq], states) for seq, states in pages if seq]
    w, t = np.zeros((len(index), 2)), np.zeros((2, 2))
    gw, gt = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    order = list(range(len(data)))
    shuffle = random.Random(7)
    for _ in range(epochs):
        shuffle.shuffle(order)
        for i in order:
            seq, y = data[i]
            n = len(seq)
            e = np.stack([w[x].sum(0) for x in seq])
            forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
            forward[0] = e[0]
            for k in range(1, n):
                forward[k] = e[k] + np.logaddexp(forward[k - 1, 0] + t[0], forward[k - 1, 1] + t[1])
            for k in range(n - 2, -1, -1):
                x = e[k + 1] + backward[k + 1]
                backward[k] = np.logaddexp(t[:, 0] + x[0], t[:, 1] + x[1])
            z = np.logaddexp(*forward[-1])
            node = np.exp(forward + backward - z)
            for k, x in enumerate(seq):
                g = -node[k]
                g[y[k]] += 1
                g = g - decay * w[x]
                gw[x] += g * g
                w[x] += rate * g / np.sqrt(gw[x])
            if n > 1:
                pair = np.exp(forward[:-1, :, None] + t + (e[1:] + backward[1:])[:, None, :] - z).sum(0)
                seen = np.zeros((2, 2))
                np.add.at(seen, (y[:-1], y[1:]), 1)
                g = seen - pair
                gt += g * g
                t += rate * g / np.sqrt(gt)
    return Field(index, w, t)


# ---------------------------------------------------------------- labelled pages


_SYLLABLES = "ka lo mi ter an del sor vi ra ton el mar is pe qui nos ba re do lin".split()


def labelled_pages(count: int = 800, seed: int = 5) -> Iterator[tuple[str, list[tuple[str, int]]]]:
    """(html, [(text, 1 for article or 0)]) of pages in many layouts.

    Texts of both kinds are drawn alike, from one word to long paragraphs and from prose to shouting
    and lists of symbols, so that the field has to learn from the structure.
    """
    rng = random.Random(seed)

    def phrase(least: int, most: int) -> str:
        style = rng.random()
        words = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(least, most))]
        if style < 0.08:
            words = [w.upper() + "!!" for w in words]
        elif style < 0.16:
            words = [w + rng.choice(["###", "%%%", "$$$", "&amp;&amp;"]) for w in words]
        elif style < 0.24:
            return " | ".join(words)
        elif style < 0.3:
            words.insert(0, rng.choice(["Comment", "Share", "Cookie", "Read more:", "Related", "Copyright"]))
        return " ".join(words).capitalize() + rng.choice([".", ".", ".", "!", "?", "", ","])

    for _ in range(count):
        out: list[str] = []
        labels: list[tuple[str, int]] = []

        def put(before: str, text: str, after: str, label: int) -> None:
            out.append(before + text + after)
            labels.append((" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?(?:b|i|em|a|span|strong|label)\b[^>]*>", "", text))).split()), label))

        def inline(text: str) -> str:
            words = text.split(" ")
            if len(words) > 3 and rng.random() < 0.3:
                i = rng.randrange(len(words))
                tag = rng.choice(["b", "i", "em", "strong", "span", 'a href="/x"'])
                words[i] = f"<{tag}>{words[i]}</{tag.split()[0]}>"
            if len(words) > 3 and rng.random() < 0.1:
                words.insert(rng.randrange(len(words)), "<br>")
            return " ".join(words)

        def menu() -> None:
            tag = rng.choice(["nav", "nav", "div class=\"menu\"", "div id=\"navigation\"", "ul class=\"breadcrumbs\"", "div class=\"navbar\""])
            out.append(f"<{tag}><ul>")
            for _ in range(rng.randint(2, 8)):
                put('<li><a href="/y">', phrase(1, 3), "</a></li>", 0)
            out.append(f"</ul></{tag.split()[0]}>")

        def head() -> None:
            tag = rng.choice(["header", "div class=\"header\"", "div id=\"masthead\"", "header class=\"site-header\""])
            out.append(f"<{tag}>")
            put(rng.choice(["<div class=\"logo\">", "<p>", "<h2>"]), phrase(1, 6), "", 0)
            out.append(f"</{tag.split()[0]}>")

        def advert() -> None:
            name = rng.choice(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot"])
            tag = rng.choice(["div", "aside", "section", "p"])
            put(f'<{tag} {rng.choice(["class", "id"])}="{name}">', phrase(2, 25), f"</{tag}>", 0)

        def notice() -> None:
            name = rng.choice(["cookie-notice", "cookie", "notice", "gdpr", "consent", "alert", "modal", "popup", "newsletter", "subscribe"])
            tag = rng.choice(["div", "div", "div", "dialog", "dialog open"])
            out.append(f'<{tag} {rng.choice(["class", "id"])}="{name}">' if "dialog" not in tag or rng.random() < 0.3 else f"<{tag}>")
            put(rng.choice(["<p>", "<p>", "<p>", "<h2>", "<div>", ""]), phrase(3, 25), "", 0)
            if rng.random() < 0.3:
                put("<p>", phrase(2, 40), "</p>", 0)
            out.append(f"<button>OK</button></{tag.split()[0]}>")

        def side() -> None:
            tag = rng.choice(["aside", "div class=\"sidebar\"", "div id=\"sidebar\"", "aside class=\"related\"", "div class=\"widget\"", "section class=\"related\"", "div class=\"recommended\"", "div class=\"share\"", "div class=\"social\""])
            out.append(f"<{tag}>")
            put(f"<h{rng.randint(2, 4)}>", phrase(1, 5), "", 0)
            for _ in range(rng.randint(1, 4)):
                t = phrase(3, 30)
                put("<p>", t, "</p>", 0)
            out.append(f"</{tag.split()[0]}>")

        def unseen() -> None:
            put(rng.choice(["<div hidden>", "<p hidden>", '<div style="display:none">', '<section style="display: none">']), phrase(2, 40), "</div></section>", 0)

        def form() -> None:
            out.append(f'<form action="/s"{rng.choice(["", " class=search", " id=login"])}>')
            put("<p>", phrase(1, 8), "</p>", 0)
            put("<div>", "<label>" + phrase(1, 4) + "</label>", "<input name=q></div>", 0)
            out.append("<button>Go</button></form>")

        def comments() -> None:
            tag = rng.choice(["section", "div", "ol", "aside"])
            name = rng.choice(["comments", "comment-list", "comments-area", "replies", "discussion", "responses", "disqus"])
            inner = rng.choice(["div", "article", "li"])
            out.append(f'<{tag} {rng.choice(["class", "id"])}="{name}">')
            if rng.random() < 0.7:
                put("<h3>", phrase(1, 4), "</h3>", 0)
            for _ in range(rng.randint(1, 6)):
                out.append(f'<{inner} class="{rng.choice(["comment", "reply", "comment-body"])}">')
                put("<p>", inline(phrase(1, 60)), "</p>", 0)
                out.append(f"</{inner}>")
            out.append(f"</{tag}>")

        def foot() -> None:
            tag = rng.choice(["footer", "footer", "div class=\"footer\"", "div id=\"footer\""])
            out.append(f"<{tag}>")
            put(rng.choice(["", "<p>", "<div>"]), "&copy; " + phrase(2, 20), "", 0)
            out.append(f"</{tag.split()[0]}>")

        def article() -> None:
            plain = bare and rng.random() < 0.8  # nothing in it but text, in any element
            tag = rng.choice(["article", "article", "main", "div", "div", "section", "span"]) if plain else rng.choice(["article"] * 5 + ["main", "main", "div class=\"content\"", "div id=\"content\"", "div class=\"article-body\"", "div class=\"post\"", "div class=\"entry-content\"", "section class=\"story\"", "div class=\"main-content\"", "div class=\"text\""])
            wrap = "" if plain else rng.choice(["", "", "", "<main>", '<div id="page">', '<div class="wrapper">'])
            out.append(f"{wrap}<{tag}>")
            header = not plain and rng.random() < 0.15
            if header:
                out.append('<header class="entry-header">')
            if rng.random() < (0.3 if plain else 0.9):
                put("<h1>", inline(phrase(1, 12)), "</h1>", 1)
            if header:
                out.append("</header>")
            for _ in range(rng.choice([1, 1, 2, 2, 3, 6] if plain else [1, 2, 3, 5, 8, 14])):
                kind = rng.random() * (0.86 if plain else 1)
                if kind < 0.64:
                    put("<p>", inline(phrase(1, 90)), rng.choice(["</p>", "</p>", ""]), 1)
                elif kind < 0.70:
                    put("<p><b>", inline(phrase(1, 40)), "<br>", 1)
                elif kind < 0.76:
                    put(f"<h{rng.randint(2, 3)}>", phrase(1, 8), "", 1)
                    out.append(f"</h{2}>")
                elif kind < 0.80:
                    put("<blockquote>", phrase(2, 40), "</blockquote>", 1)
                elif kind < 0.84:
                    out.append("<ul>")
                    for _ in range(rng.randint(1, 4)):
                        put("<li>", inline(phrase(1, 15)), "</li>", 1)
                    out.append("</ul>")
                elif kind < 0.86:
                    put("<pre>", phrase(1, 20), "</pre>", 1)
                elif kind < 0.88:
                    out.append("<figure><img src=a>")
                    put("<figcaption>", phrase(1, 15), "</figcaption>", 1)
                    out.append("</figure>")
                elif kind < 0.99:
                    rng.choice([advert, advert, side, side, notice, form, unseen])()
                else:
                    out.append("<table>")
                    for _ in range(rng.randint(1, 3)):
                        put("<tr><td>", phrase(1, 6), "</td></tr>", 1)
                    out.append("</table>")
            if not plain and rng.random() < 0.25:
                rng.choice([comments, comments, side, form])()
            out.append(f"</{tag.split()[0]}>" + {"<main>": "</main>"}.get(wrap, "</div>" if wrap else ""))

        def bar(least: int, most: int) -> None:
            """A cell of links, or of small print, without any name."""
            kind = rng.random()
            if kind < 0.4:
                put("", "".join(f"<a href=/m>{phrase(1, 2)}</a>" + rng.choice(["", " ", "<br>", " | "]) for _ in range(rng.randint(2, 6))), "", 0)
            elif kind < 0.7:
                out.append("<ul>")
                for _ in range(rng.randint(2, 6)):
                    put("<li><a href=/m>", phrase(1, 2), "</a></li>", 0)
                out.append("</ul>")
            else:
                put(rng.choice(["", "<p>", "<font size=1>", "<center>"]), phrase(least, most), "", 0)

        def laid_out() -> None:
            """A page of table cells, by place and share of the text, hardly by name."""
            cell = rng.choice(["td", "td", "td valign=top", "td width=80%"])
            out.append(rng.choice(["", "<center>", "<div>"]) + rng.choice(["<table>", "<table width=100%>", "<table border=0><tbody>"]))
            deep = rng.random() < 0.25  # the columns are a table of their own
            if rng.random() < 0.5:
                out.append("<tr><td colspan=3>")
                put(rng.choice(["", "<h2>", "<b>", "<p>"]), phrase(1, 5), "</td></tr>", 0)
            out.append("<tr><td><table><tr>" if deep else "<tr>")
            if rng.random() < 0.75:
                out.append(rng.choice(["<td>", "<td width=20%>", "<td class=left>"]))
                bar(1, 5)
                out.append("</td>")
            out.append(f"<{cell}>")
            if rng.random() < 0.8:
                put("<h1>", inline(phrase(1, 10)), "</h1>", 1)
            for _ in range(rng.randint(2, 8)):
                put("<p>", inline(phrase(12, 80)), rng.choice(["</p>", ""]), 1)
                if rng.random() < 0.08:
                    out.append("<table>")
                    for _ in range(rng.randint(2, 4)):
                        put("<tr><td>", phrase(1, 3), "</td>", 1)
                        put("<td>", phrase(1, 3), "</td></tr>", 1)
                    out.append("</table>")
            out.append("</td>")
            if rng.random() < 0.4:
                out.append("<td>")
                bar(1, 8)
                out.append("</td>")
            out.append("</tr></table></td></tr>" if deep else "</tr>")
            if rng.random() < 0.6:
                out.append("<tr><td colspan=3>")
                put(rng.choice(["", "<p>", "<font size=1>"]), rng.choice(["&copy; ", ""]) + phrase(1, 8), "</td></tr>", 0)
            out.append("</table>")

        if rng.random() < 0.12:
            for part, share in ((notice, 0.2), (menu, 0.15), (advert, 0.1)):
                if rng.random() < share:
                    part()
            laid_out()
            if rng.random() < 0.3:
                rng.choice([foot, notice, comments])()
            yield f"<html><head><title>{phrase(1, 9)}</title></head><body>{''.join(out)}</body></html>", labels
            continue
        bare = rng.random() < 0.22  # nothing around the article
        for part, share in () if bare else ((notice, 0.25), (head, 0.4), (menu, 0.85), (advert, 0.5), (side, 0.2), (form, 0.15), (unseen, 0.1)):
            if rng.random() < share:
                part()
        article()
        for part, share in () if bare else ((comments, 0.35), (side, 0.35), (advert, 0.25), (form, 0.2), (notice, 0.15), (foot, 0.85)):
            if rng.random() < share:
                part()
        page = f'<!DOCTYPE html><html><head><title>{phrase(1, 9)}</title><style>p{{margin:0}}</style></head><body><script>var a="</p>";</script>{"".join(out)}'
        yield page + rng.choice(["</body></html>", ""]), labels


@functools.cache
def trained(count: int = 800, seed: int = 5) -> Field:
    """The field, trained on ``labelled_pages``; blocks take their labels by page order."""
    data = []
    for page, labels in labelled_pages(count, seed):
        blocks = leaf_blocks(page)
        states, k = [], 0
        for text, _, _ in blocks:  # a block may hold several labelled runs, which agree
            states.append(labels[k][1])
            left = len(text.replace(" ", ""))
            while left > 0 and k < len(labels):
                left -= len(labels[k][0].replace(" ", ""))
                k += 1
        data.append((block_features(blocks), states))
    return train(data)


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page)
    return " ".join(b[0] for b, s in zip(blocks, field.viterbi(block_features(blocks, field.weight)), strict=True) if s)


# ---------------------------------------------------------------- operator


def extract(pages: DataFrame, field: Field | None = None, key: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page; ``text`` is empty where there is no article.

    Null and empty markup give the empty text; pages of any length are read whole, in time that grows
    with their length alone; repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    field = field or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, field) if p else "" for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=list("abcd"))

    schema = T.StructType([T.StructField(key, pages.schema[key].dataType), T.StructField(url, pages.schema[url].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(F.col(key), F.col(url), F.col(markup)).mapInArrow(by_slices(run), schema)
