"""Main-text extraction from HTML by boosted trees over the nodes of the document tree.

Every block-level node gets features of its subtree (density of text, links and tags), of its attribute tokens, its depth
and its siblings; gradient-boosted trees turn them into the odds that it lies in the article. A decoding over the tree
then picks the most likely consistent choice: a node is outside the article, inside, or cut out of it; inside can only
begin below outside, and what is cut out stays out with all below. So no node contradicts its ancestors.

The trees are fitted on pages that ``synthetic_page`` composes from the parts that pages have, with known labels.
"""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinstrand.llm.arrow_text import bounded_batches, slices
from kinstrand.llm.boosting import BoostedTrees, fit

EXTRACTED = "page_id long, url string, text string, n_chars long"
#: Pages that the classifier is fitted on.
TRAIN_PAGES = 1500
#: Log odds that the decoding pays where the article begins and where something is cut out of it.
BEGIN_COST, CUT_COST = 1.0, 0.7

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

# Parts of class, id and role tokens, by what they tell.
TOKENS = {
    "main": "article content main post entry story body text prose hentry blog".split(),
    "menu": "nav menu breadcrumb toolbar tabs pagination pager header head masthead topbar logo brand".split(),
    "foot": "foot copyright legal bottom colophon".split(),
    "side": "side aside widget related recommend popular trending tags tagcloud archive more".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo banner dfp adsense teaser".split(),
    "notice": "notice cookie consent gdpr alert popup modal overlay disclaimer subscribe newsletter paywall".split(),
    "comment": "comment comments reply replies disqus discussion respond review".split(),
    "form": "form search login signup contact".split(),
    "share": "share social follow like meta author byline".split(),
}
_TOKEN_OF = {w: k for k, words in enumerate(TOKENS.values()) for w in words}

#: The name of an element and what follows it up to the end of its tag. A quote opens a value only after ``=`` and only if
#: it is closed somewhere. Possessive throughout, so a tag is read once.
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_REST = re.compile(r"(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+")
_ATTRIBUTE = re.compile(r"""(?:class|id|role|itemprop|data-role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VALUE = re.compile(r"""=\s*+(?:"[^"]*+"|'[^']*+')""")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s/=]|$)""", re.I)
_UNSEEN = re.compile(r"""display\s*+:\s*+none|aria-hidden\s*+=\s*+["']?true|class\s*+=\s*+(?:"(?:[^"]*\s)?hidden[\s"]|'(?:[^']*\s)?hidden[\s']|hidden\b)""", re.I)
#: Character references by a number: zeros in front of it, and numbers beyond all characters.
_ZEROS, _HUGE = re.compile(r"&#([xX]?)0++(?=[0-9a-fA-F])"), re.compile(r"&#(?:[0-9]{8,}+|[xX][0-9a-fA-F]{7,}+);?")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def decode_references(text: str) -> str:
    """Character references as the characters that they stand for; numbers of any length."""
    return entities.unescape(_HUGE.sub("\ufffd", _ZEROS.sub(r"&#\1", text))) if "&" in text else text


def tokens(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """The markup of a page in order: where it begins and ends, the element's name in lower case (empty for comments,
    declarations and instructions), whether it is an end tag, and its attributes as they are written.

    Every character is looked at a bounded number of times. What a page ends in before it is closed, a comment or a tag,
    reaches to its end. After an element of ``RAW`` the next markup is what follows its end tag.
    """
    at, size = 0, len(source)
    while True:
        at = source.find("<", at)
        if at < 0 or at + 1 >= size:
            return
        sign = source[at + 1]
        if sign in "!?":
            if source.startswith("<!--", at):
                end = at + 5 if source.startswith(">", at + 4) else at + 6 if source.startswith("->", at + 4) else source.find("-->", at + 4) + 3
                end = end if end > 2 else size
            elif source.startswith("<![CDATA[", at):
                end = source.find("]]>", at) + 3
                end = end if end > 2 else size
            else:
                end = source.find(">", at) + 1 or size
            yield at, end, "", False, ""
            at = end
            continue
        closing = sign == "/"
        name = _NAME.match(source, at + 1 + closing)
        if name is None:
            if closing and at + 2 < size:
                end = source.find(">", at) + 1 or size
                yield at, end, "", False, ""
                at = end
            else:
                at += 1
            continue
        rest = _REST.match(source, name.end())
        if rest.end() >= size:
            yield at, size, "", False, ""
            return
        tag, end = name[0].lower(), rest.end() + 1
        if tag in RAW and not closing and not (rest[0].endswith("/") and tag in ("svg", "math")):
            close = _raw_end(tag).search(source, end)
            end = source.find(">", close.start()) + 1 or size if close else size
        yield at, end, tag, closing, rest[0]
        at = end


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}[\s/>]", re.I)


class _Open:
    """The open block elements, where each kind of them stands, and the inline elements open in each."""

    def __init__(self, root: "Node"):
        self.nodes, self.inline, self.counts, self.places = [root], [[]], [{}], {root.tag: [0]}

    def push(self, node: "Node") -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)
        self.inline.append([])
        self.counts.append({})

    def begin(self, name: str) -> None:
        self.inline[-1].append(name)
        self.counts[-1][name] = self.counts[-1].get(name, 0) + 1

    def end(self, name: str) -> None:
        """Close the innermost inline element of this name and those in it, if the innermost block has one."""
        own, counts = self.inline[-1], self.counts[-1]
        while counts.get(name):
            last = own.pop()
            counts[last] -= 1
            if last == name:
                return

    def cut(self, depth: int) -> None:
        while len(self.nodes) > depth:
            self.places[self.nodes.pop().tag].pop()
            self.inline.pop()
            self.counts.pop()

    def last(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        """Close the outermost of ``tags`` inside the innermost of ``scope``, with all in it."""
        bound, found = self.last(scope), len(self.nodes)
        for t in tags:
            own = self.places.get(t, ())
            k = bisect_right(own, bound)
            if k < len(own):
                found = min(found, own[k])
        self.cut(found)


class Node:
    __slots__ = ("tag", "rest", "parent", "first", "depth", "pieces", "own", "links", "linked", "tags", "inputs", "items", "paragraphs", "kids", "place", "same", "hidden")

    def __init__(self, tag: str, rest: str, parent: "Node | None"):
        self.tag, self.rest, self.parent = tag, rest, parent
        self.depth = parent.depth + 1 if parent else 0
        self.own = self.links = self.linked = self.tags = self.inputs = self.items = self.paragraphs = self.kids = self.same = 0
        self.place = 0
        self.hidden = False


class Page:
    """Block-level nodes in page order, and blocks of text: (node, text)."""

    def __init__(self, source: str):
        self.nodes = [Node("#page", "", None)]
        self.blocks: list[tuple[int, str]] = []
        self._number = {id(self.nodes[0]): 0}
        self._parse(source)

    def _parse(self, source: str) -> None:
        opened = _Open(self.nodes[0])
        pending: list[str] = []
        anchors, at = 0, 0

        def flush() -> None:
            if pending:
                text = " ".join(decode_references("".join(pending)).split())
                pending.clear()
                if text:
                    node = opened.nodes[-1]
                    self.blocks.append((self._number[id(node)], text))
                    node.own += len(text)

        def text_until(end: int) -> None:
            if end > at:
                pending.append(source[at:end])
                if anchors:
                    opened.nodes[-1].linked += end - at

        for start, end, name, closing, rest in tokens(source):
            text_until(start)
            at = end
            if not name:
                continue
            node = opened.nodes[-1]
            if closing:
                if name in INLINE:
                    if name == "a":
                        anchors = max(0, anchors - 1)
                    opened.end(name)
                elif opened.places.get(name):
                    flush()
                    anchors = 0
                    opened.cut(opened.places[name][-1])
                elif name == "p":
                    flush()
                continue
            if name in RAW:
                if name in ("select", "textarea"):
                    node.inputs += 1
            elif name == "br":
                pending.append(" ")
            elif name in VOID:
                node.inputs += name == "input"
                if name == "hr":
                    flush()
            elif name in INLINE:
                if name == "a":
                    node.links += 1
                    anchors += 1
                node.tags += 1
                if not rest.endswith("/"):
                    opened.begin(name)
            else:
                flush()
                anchors = 0
                if name in CLOSES_P:
                    opened.close(("p",), ("article", "aside", "button", "div", "section", "td", "th", "li", "blockquote"))
                elif name in CLOSES:
                    opened.close(CLOSES[name], SCOPES[name])
                parent = opened.nodes[-1]
                parent.inputs += name == "button"
                own = Node(name, rest, parent)
                own.place = parent.kids
                parent.kids += 1
                own.hidden = bool(rest) and (_UNSEEN.search(rest) is not None or _HIDDEN.search(_VALUE.sub("", rest)) is not None)
                self._number[id(own)] = len(self.nodes)
                self.nodes.append(own)
                if not rest.endswith("/"):
                    opened.push(own)
        text_until(len(source))
        flush()

    def features(self) -> np.ndarray:
        """A row for each node."""
        nodes, number = self.nodes, self._number
        n = len(nodes)
        parent = [number[id(x.parent)] if x.parent else -1 for x in nodes]
        text, linked, links, inputs, tags = [x.own for x in nodes], [x.linked for x in nodes], [x.links for x in nodes], [x.inputs for x in nodes], [x.tags + 1 for x in nodes]
        blocks, items, paragraphs, stops = [0] * n, [0] * n, [0] * n, [0] * n
        below = [0] * n
        for k, t in self.blocks:
            blocks[k] += 1
            stops[k] += t.count(". ") + t.count(", ") + (t[-1] in ".!?")
        kinds: list[dict[str, int]] = [{} for _ in nodes]
        for k in range(n - 1, 0, -1):
            p = parent[k]
            tag = nodes[k].tag
            items[k] += tag == "li"
            paragraphs[k] += tag == "p"
            for total in (text, linked, links, inputs, tags, blocks, items, paragraphs, stops):
                total[p] += total[k]
            below[p] = max(below[p], below[k] + 1)
            kinds[p][tag] = kinds[p].get(tag, 0) + 1
        tokens, above = [], []
        for k, x in enumerate(nodes):
            own = 0
            if x.rest:
                for m in _ATTRIBUTE.finditer(x.rest):
                    for w in _WORD.findall(_CAMEL.sub(" ", m[1] or m[2] or m[3] or "").lower()):
                        if w in _TOKEN_OF:
                            own |= 1 << _TOKEN_OF[w]
            tag = x.tag
            own |= (1 << 9) * (tag in ("nav", "header", "menu")) | (1 << 10) * (tag == "footer") | (1 << 11) * (tag == "aside") | (1 << 12) * (tag == "form")
            own |= (1 << 13) * (tag in ("article", "main")) | (1 << 14) * x.hidden
            tokens.append(own)
            above.append(above[parent[k]] | tokens[parent[k]] if k else 0)
        total = max(1, text[0])
        rows = []
        for k, x in enumerate(nodes):
            p = parent[k]
            size = text[k]
            own, up = tokens[k], above[k]
            tag = x.tag
            row = [
                x.depth, below[k], size, size / total, text[p] / total if k else 1.0, size / max(1, text[p]) if k else 1.0, size / tags[k], linked[k] / max(1, size), links[k], inputs[k],
                blocks[k], size / max(1, blocks[k]), stops[k] / max(1, blocks[k]), items[k] / max(1, tags[k]), paragraphs[k], x.kids, x.place, nodes[p].kids - x.place if k else 0,
                kinds[p].get(tag, 1) if k else 1, kinds[k].get("p", 0), kinds[k].get("h1", 0) + kinds[k].get("h2", 0), x.own,
                tag == "p", tag in ("h1", "h2", "h3", "h4", "h5", "h6"), tag == "h1", tag in ("div", "section"), tag in ("li", "ul", "ol"), tag in ("table", "tr", "td", "tbody"), tag in ("body", "html", "#page"),
                tag in ("blockquote", "pre", "figure", "figcaption", "dl", "dd"),
            ]
            row += [own >> b & 1 for b in range(15)]
            row += [up >> b & 1 for b in range(15)]
            rows.append(row)
        return np.array(rows, np.float64)

    def parents(self) -> list[int]:
        return [self._number[id(x.parent)] if x.parent else -1 for x in self.nodes]

    def main_blocks(self, log_odds: np.ndarray) -> list[str]:
        """The blocks inside the article by the best consistent choice for all nodes."""
        parent, odds = self.parents(), log_odds.tolist()
        n = len(odds)
        outside, inside, cut = [0.0] * n, list(odds), [0.0] * n  # best sums of log odds of the subtree in each state
        for k in range(n - 1, 0, -1):
            p = parent[k]
            outside[p] += max(outside[k], inside[k] - BEGIN_COST)
            inside[p] += max(inside[k], cut[k] - CUT_COST)
        state = [inside[0] - BEGIN_COST > outside[0]] + [False] * (n - 1)
        was_cut = [False] * n
        for k in range(1, n):
            p = parent[k]
            if state[p]:
                state[k] = inside[k] >= cut[k] - CUT_COST
                was_cut[k] = not state[k]
            elif was_cut[p]:
                was_cut[k] = True
            else:
                state[k] = inside[k] - BEGIN_COST > outside[k]
        return [t for k, t in self.blocks if state[k]]


# ---- pages to learn from ------------------------------------------------------------------------------------------

_SYLLABLES = "the an re in ti on es ed en or le de la ch ou que ne st ver sch ung ein ie os ra ci do ta me lu".split()


class _Composer:
    """Pages of random words. Marks stand around the article (1, 2) and around what interrupts it (3, 4)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.plain = self.r.random() < 0.25  # no telling attribute tokens
        self.semantic = self.r.random() < 0.6

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3))) + r.choice(["", "", "", "", "", ",", "."]) for _ in range(r.randint(low, high))]
        out[0] = out[0].capitalize()
        return " ".join(out)

    def attr(self, *choices: str) -> str:
        r = self.r
        if self.plain:
            return "" if r.random() < 0.7 else f' class="{r.choice("abcxyz")}{r.randint(1, 99)}"'
        word = r.choice(choices) + r.choice(["", "", "-wrap", " box", "-1", "_inner"])
        return f' {r.choice(["class", "id", "class"])}="{word}"'

    def box(self, tags: tuple[str, ...], inner: str, *tokens: str) -> str:
        tag = self.r.choice(tags) if self.semantic else "div"
        bare = tag not in ("div", "section") and self.r.random() < 0.5
        return f"<{tag}{'' if bare or not tokens else self.attr(*tokens)}>{inner}</{tag}>"

    def links(self, low: int, high: int, words: int = 2) -> str:
        r = self.r
        own = [f'<a href="/{k}">{self.words(1, words)}</a>' for k in range(r.randint(low, high))]
        style = r.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in own) + "</ul>"
        return (" | " if style < 0.8 else " ").join(own) if style < 0.9 else "".join(f"<p>{x}</p>" for x in own)

    def paragraph(self, low: int = 8, high: int = 90) -> str:
        r, text = self.r, self.words(low, high)
        if r.random() < 0.3:
            text = f'{text} <a href="#">{self.words(1, 3)}</a> {self.words(3, 12)}'
        if r.random() < 0.2:
            text = f"<b>{text}" + r.choice(["</b>", "<br>", "</b>"])
        if r.random() < 0.1:
            text = text.replace(" ", "<br>", 1)
        return f"<p>{text}" + r.choice(["</p>", "</p>", "</p>\n", ""])

    def article(self) -> str:
        r = self.r
        parts = [f"<h1>{self.words(3, 12)}</h1>"] if r.random() < 0.85 else []
        if parts and r.random() < 0.15:
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(r.choice([1, 2, 3, 4, 5, 6, 8, 12, 20])):
            kind = r.random()
            if kind < 0.78:
                parts.append(self.paragraph(*r.choice([(1, 4), (8, 40), (20, 120), (60, 200)])))
            elif kind < 0.86:
                parts.append(f"<h2>{self.words(2, 7)}</h2>" if r.random() < 0.6 else f"<h3>{self.words(2, 7)}</h3>")
            elif kind < 0.91:
                parts.append("<ul>" + "".join(f"<li>{self.words(2, 20)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.94:
                parts.append(f"<blockquote>{self.paragraph(5, 40)}</blockquote>")
            elif kind < 0.96:
                parts.append(f"<pre>{self.words(5, 40)}</pre>")
            elif kind < 0.98:
                parts.append(f"<figure><img src=x><figcaption>{self.words(3, 12)}</figcaption></figure>")
            else:
                parts.append("<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 6)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
            if r.random() < 0.06:
                parts.append("\x03" + r.choice([self.advert, self.share, self.related])() + "\x04")
        return "".join(parts)

    def advert(self) -> str:
        body = self.r.choice([self.words(3, 20), self.paragraph(3, 20), f'<a href="/x">{self.words(2, 8)}</a>'])
        return f"<div{self.attr('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner')}>{body}</div>"

    def share(self) -> str:
        return f"<div{self.attr('share', 'social', 'follow')}>{self.links(2, 5, 1)}</div>"

    def related(self) -> str:
        return self.box(("aside", "section", "div"), f"<h3>{self.words(1, 3)}</h3>" + self.links(3, 8, 7), "related", "sidebar", "widget", "popular", "tags")

    def notice(self) -> str:
        return f"<div{self.attr('cookie', 'notice', 'consent', 'alert', 'gdpr')}>{self.paragraph(6, 30)}" + self.r.choice(["<button>Ok</button>", "", '<a href="/p">More</a>']) + "</div>"

    def form(self) -> str:
        return f"<form{self.attr('search', 'newsletter', 'subscribe', 'login', 'contact')}>{self.r.choice(['<label>' + self.words(1, 4) + '</label>', self.paragraph(3, 18)])}<input name=q><button>{self.words(1, 2)}</button></form>"

    def comments(self) -> str:
        r = self.r
        each, tag = r.choice(["div", "li", "article"]), r.choice(["section", "div", "ol"])
        one = lambda: f"<{each}{self.attr('comment', 'reply')}><b>{self.words(1, 2)}</b>{self.paragraph(4, 60)}</{each}>"
        inner = f"<h3>{self.words(1, 3)}</h3>" + "".join(one() for _ in range(r.randint(1, 6))) + (self.form() if r.random() < 0.5 else "")
        return f"<{tag}{self.attr('comments', 'discussion', 'replies', 'respond')}>{inner}</{tag}>"

    def page(self) -> str:
        r = self.r
        article = self.article()
        shape = r.random()
        if shape < 0.05:
            return f"\x01{article}\x02"
        if shape < 0.08:
            return f"<html><body>\x01{article}\x02</body></html>"
        if shape < 0.1:
            return "\x01" + self.words(5, 80) + "\x02"
        if shape < 0.18:
            few = self.words(1, 8) if r.random() < 0.5 else self.words(5, 30)
            article = r.choice(["", f"<h1>{few[:60]}</h1>"]) + f"<p>{few}</p>"
        tag = r.choice(("article", "article", "main", "section", "div")) if self.semantic else "div"
        own = self.attr("article", "content", "post", "entry", "story", "main", "text") if tag == "div" or r.random() < 0.5 else ""
        tail = f"\x03{r.choice([self.share, self.advert, self.comments])()}\x04" if r.random() < 0.2 else ""
        main = f"\x01<{tag}{own}>{article}{tail}</{tag}>\x02"
        nav = self.box(("nav", "nav", "header", "div"), r.choice([f"<h2>{self.words(1, 3)}</h2>", "", ""]) + self.links(3, 12), "nav", "menu", "header", "topbar")
        top = [nav] if r.random() < 0.85 else []
        if r.random() < 0.3:
            top.insert(0, self.box(("header", "div"), f"<h1>{self.words(1, 4)}</h1>" + r.choice(["", f"<p>{self.words(3, 9)}</p>", self.form()]), "header", "masthead", "logo"))
        extra = [(self.advert, 0.5), (self.notice, 0.25), (self.form, 0.2), (self.share, 0.2), (self.related, 0.3)]
        before, after = [f() for f, p in extra if r.random() < p / 2], [f() for f, p in extra if r.random() < p / 2]
        if r.random() < 0.35:
            after.insert(0, self.comments())
        if r.random() < 0.9:
            after.append(self.box(("footer", "footer", "div"), r.choice([f"&copy; {self.words(1, 4)} &middot; {self.words(2, 14)}", f"<p>{self.words(3, 14)}</p>", self.links(2, 8)]), "footer", "copyright", "legal"))
        r.shuffle(before)
        middle = "".join(before) + main
        if r.random() < 0.35:
            side = self.box(("aside", "div"), self.related() + (self.advert() if r.random() < 0.4 else "") + (self.paragraph(5, 40) if r.random() < 0.4 else ""), "sidebar", "side", "widget")
            middle = middle + side if r.random() < 0.7 else side + middle
        if r.random() < 0.4:
            middle = f"<div{self.attr('wrapper', 'container', 'page', 'content')}>{middle}</div>"
        if r.random() < 0.06:
            middle = f"<table><tr><td>{self.links(3, 8)}</td><td>{middle}</td></tr></table>"
        head = f'<head><meta charset="utf-8"><title>{self.words(2, 8)}</title><style>p{{}}</style><script>var t="</p>";</script></head>'
        return f"<!DOCTYPE html><html>{head}<body>{''.join(top)}{middle}{''.join(after)}" + r.choice(["</body></html>", ""])


_MARK = re.compile("[\x01-\x04]")


def synthetic_page(seed: int) -> tuple[str, list[bool]]:
    """A page, and whether each of its nodes (as ``Page`` numbers them) belongs to the article."""
    marked = _Composer(seed).page()
    plain = _MARK.sub("", marked)
    inside, open_at = np.zeros(len(plain) + 1, bool), None
    for k, m in enumerate(_MARK.finditer(marked)):
        where = m.start() - k
        if m[0] in "\x01\x04":
            open_at = where
        elif open_at is not None:
            inside[open_at:where] = True
            open_at = None
    page, at, labels = Page(plain), 0, [bool(inside[0])]
    for x in page.nodes[1:]:
        found = re.compile(rf"<{re.escape(x.tag)}{re.escape(x.rest)}>", re.I).search(plain, at)
        at = found.end()
        labels.append(bool(inside[found.start()]))
    return plain, labels


@lru_cache(maxsize=2)
def classifier(pages: int = TRAIN_PAGES) -> BoostedTrees:
    """Boosted trees over the nodes of ``pages`` synthetic pages; always the same."""
    x, y = [], []
    for seed in range(pages):
        source, labels = synthetic_page(seed)
        x.append(Page(source).features())
        y += labels
    return fit(np.concatenate(x), np.array(y, float))


def extract(sources: list[str | None], model: BoostedTrees) -> list[str]:
    """The main text of each page, its blocks joined by a line break."""
    pages = [Page(s) if s else None for s in sources]
    features = [p.features() for p in pages if p is not None]
    if not features:
        return [""] * len(pages)
    odds = model.log_odds(np.concatenate(features))
    out, at = [], 0
    for p in pages:
        if p is None:
            out.append("")
            continue
        plain = len(p.nodes) == 1
        out.append("\n".join([t for _, t in p.blocks] if plain else p.main_blocks(odds[at : at + len(p.nodes)])))
        at += len(p.nodes)
    return out


def extract_main_text(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """The main text of every row of ``pages`` (page_id, url, html): ``EXTRACTED``.

    White space inside a block becomes one space, blocks are joined by a line break in page order, character references
    are decoded, and nothing is cut off. A null or empty page has an empty text, as has one without an article; a text
    without any element is its own main text. Null ids and urls and repeated rows are kept; further columns are ignored; an empty table
    gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(classifier(train_pages))  # some hundred kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 1 << 20):
                text = extract(part.column("html").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    bounded_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, EXTRACTED)
