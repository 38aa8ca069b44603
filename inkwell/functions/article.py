"""The main article of a page: elements scored by the text that they hold, scores handed up, links held against them.

The rules are the public ones of reader views. A paragraph of 25 characters or more gives its ancestors a point, one for
each comma and one for each hundred characters (three at most); the parent gets all of it, the grandparent half, those
above a third of their distance. Names of classes and ids, and the tag itself, count for or against an element. The
share of text that stands in links is taken off. The best element and those of its siblings that look alike are the
article. Where that leaves little text the search is made again, each time with a rule less.
"""

from __future__ import annotations

import re
from itertools import islice

from inkwell.functions.dom import BLOCK, Node

# Words in names of classes and ids.
UNLIKELY = re.compile(
    r"-ad-|ai2html|banner|breadcrumbs|combx|comment|community|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|related|remark|replies|rss|"
    r"shoutbox|sidebar|skyscraper|social|sponsor|supplemental|ad-break|agegate|pagination|pager|popup|yom-remote",
    re.I,
)
MAYBE = re.compile(r"and|article|body|column|content|main|mathjax|shadow", re.I)
POSITIVE = re.compile(r"article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story", re.I)
NEGATIVE = re.compile(
    r"-ad-|hidden|^hid$| hid$| hid |^hid |banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|"
    r"shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget",
    re.I,
)
ROLES = {"menu", "menubar", "complementary", "navigation", "alert", "alertdialog", "dialog"}
TAG_SCORES = {"div": 5, "pre": 3, "td": 3, "blockquote": 3} | dict.fromkeys("address ol ul dl dd dt li form".split(), -3) | dict.fromkeys("h1 h2 h3 h4 h5 h6 th".split(), -5)
SCORED = {"section", "h2", "h3", "h4", "h5", "h6", "p", "td", "pre"}
#: Elements that an article never keeps, and those that go with the odd parts.
DROPPED, TIDIED = {"object", "embed", "footer", "link", "aside", "input", "textarea", "select", "button", "nav"}, {"form", "fieldset"}
#: An article of fewer characters is looked for again with fewer rules; and the first levels of a page that get points.
ENOUGH, LEVELS = 500, 5


class Sums:
    """What lies below an element: letters, those in links, in headings and in lists, commas, and elements of some kinds."""

    __slots__ = ("chars", "links", "heads", "listed", "commas", "p", "img", "li", "inputs", "blocks", "code", "marks")

    def __init__(self):
        for name in self.__slots__:
            setattr(self, name, 0)

    def add(self, child: Node, below: Sums) -> None:
        for name in self.__slots__:
            setattr(self, name, getattr(self, name) + getattr(below, name))
        tag = child.tag
        if tag == "a":
            self.links += below.chars * (0.3 if child.get("href").startswith("#") else 1.0) - below.links
        elif tag in ("ul", "ol"):
            self.listed += below.chars - below.listed
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.heads += below.chars - below.heads
        self.p += tag == "p"
        self.img += tag == "img"
        self.li += tag == "li"
        self.inputs += tag == "input"
        self.blocks += tag in BLOCK
        self.code += tag in ("pre", "code")
        self.marks += tag in ("th", "caption", "thead", "tfoot", "col")


class Article:
    """One search in a page, with or without each of the rules: unlikely elements go, names count, odd parts go."""

    def __init__(self, root: Node, strip: bool, names: bool, tidy: bool):
        self.names, self.gone, self.scores = names, set(), {}
        self.texts: dict[int, str] = {}
        self.sums: dict[int, Sums] = {}
        self.body = next((n for n in root.nodes() if n.tag == "body"), root)
        self._strip(strip)
        self._measure(self.body)
        self.parts = self._parts()
        for part in self.parts:
            self.gone |= {id(n) for n in (part, *self.below(part)) if n.tag in DROPPED or tidy and n.tag in TIDIED}
            self.texts.clear()
            if tidy:
                self._tidy(part)

    def text(self, node: Node) -> str:
        """Text below a node with blanks run together, without what is gone."""
        if id(node) not in self.texts:
            out, stack = [], [node]
            while stack:
                x = stack.pop()
                if isinstance(x, str):
                    out.append(x)
                elif id(x) not in self.gone:
                    stack += reversed(x.children)
            self.texts[id(node)] = " ".join("".join(out).split())
        return self.texts[id(node)]

    def live(self, node: Node) -> list[Node]:
        return [c for c in node.children if isinstance(c, Node) and id(c) not in self.gone]

    def below(self, node: Node) -> list[Node]:
        out, stack = [], self.live(node)[::-1]
        while stack:
            x = stack.pop()
            out.append(x)
            stack += self.live(x)[::-1]
        return out

    def _strip(self, strip: bool) -> None:
        for node in self.body.nodes():
            name = f"{node.get('class')} {node.get('id')}"
            hidden = "hidden" in node.attrs or re.search(r"display:\s*none|visibility:\s*hidden", node.get("style")) or node.get("aria-hidden") == "true" and "fallback-image" not in name
            unlikely = strip and node.tag != "a" and UNLIKELY.search(name) and not MAYBE.search(name) and not any(a.tag in ("table", "code") for a in node.ancestors())
            if hidden or unlikely or strip and node.get("role") in ROLES:
                self.gone.add(id(node))

    def _measure(self, root: Node) -> None:
        """Sums over what lies below each element: see Sums. One pass, from the leaves up."""
        for node in reversed([root, *self.below(root)]):
            self._resum(node)

    def link_share(self, node: Node) -> float:
        """The share of a node's letters that stand in links; links within the page count for less."""
        sums = self.sums[id(node)]
        return sums.links / sums.chars if sums.chars else 0.0

    def weight(self, node: Node) -> int:
        if not self.names:
            return 0
        return sum(25 * (bool(POSITIVE.search(n)) - bool(NEGATIVE.search(n))) for n in (node.get("class"), node.get("id")) if n)

    def _is_paragraph(self, node: Node) -> bool:
        """What is scored: given tags, and a div that holds no block but text."""
        return node.tag in SCORED or node.tag == "div" and not self.sums[id(node)].blocks

    def _parts(self) -> list[Node]:
        """The best element among its like siblings; the body where nothing scores."""
        for node in self.below(self.body):
            if not self._is_paragraph(node) or len(text := self.text(node)) < 25:
                continue
            points = 1 + len(re.split("[,،﹐︐⹁⸴⸲，]", text)) + min(len(text) // 100, 3)
            for level, above in enumerate(a for a in islice(node.ancestors(), LEVELS) if id(a) in self.sums and a.parent is not None):
                if id(above) not in self.scores:
                    self.scores[id(above)] = (above, float(TAG_SCORES.get(above.tag, 0) + self.weight(above)))
                kept, score = self.scores[id(above)]
                self.scores[id(above)] = (kept, score + points / (1 if level == 0 else 2 if level == 1 else 3 * level))
        final = {k: (n, s * (1 - self.link_share(n))) for k, (n, s) in self.scores.items()}
        self.scores = final
        best = sorted(final.values(), key=lambda x: -x[1])[:5]
        if not best or best[0][0].tag in ("body", "html"):
            return [self.body]
        top, score = best[0]
        # An element that holds three more of nearly the same score is better.
        near = [set(map(id, n.ancestors())) for n, s in best[1:] if score > 0 and s / score >= 0.75]
        if len(near) >= 3:
            top = next((a for a in top.ancestors() if a.tag not in ("body", "html", "#root") and sum(id(a) in x for x in near) >= 3), top)
        last = least = final.get(id(top), (top, score))[1]
        for above in top.ancestors():
            if above.tag in ("body", "html", "#root") or id(above) in final and final[id(above)][1] < least / 3:
                break
            if id(above) in final:
                if final[id(above)][1] > last:
                    top = above
                    break
                last = final[id(above)][1]
        while top.parent is not None and top.parent.tag not in ("body", "html", "#root") and len(self.live(top.parent)) == 1:
            top = top.parent
        return [s for s in self.live(top.parent) if s is top or self._belongs(s, top, final.get(id(top), (top, score))[1])] if top.parent is not None else [top]

    def _belongs(self, node: Node, top: Node, score: float) -> bool:
        bonus = score * 0.2 if node.get("class") and node.get("class") == top.get("class") else 0.0
        if id(node) in self.scores and self.scores[id(node)][1] + bonus >= max(10.0, score * 0.2):
            return True
        text, share = self.text(node), self.link_share(node)
        return node.tag == "p" and (len(text) > 80 and share < 0.25 or 0 < len(text) <= 80 and share == 0 and bool(re.search(r"\.( |$)", text)))

    def _tidy(self, part: Node) -> None:
        """Drops what is for sharing, and tables, lists and divs that are mostly links or not of text."""
        for node in self.below(part):
            if node.tag in ("div", "section") and re.search(r"(\b|_)(share|sharedaddy)(\b|_)", f"{node.get('class')} {node.get('id')}", re.I) and len(self.text(node)) < ENOUGH:
                self.gone.add(id(node))
        self.texts.clear()
        self._measure(part)
        # What lies in code, figures and tables of data stays, and so does what holds code.
        order, kept = [part, *self.below(part)], set()
        for node in order:
            sums = self.sums[id(node)]
            if node.tag in ("code", "figure") or node.tag == "table" and sums.marks or node.parent is not None and ("inner", id(node.parent)) in kept:
                kept |= {("inner", id(node)), id(node)}
            elif sums.code:
                kept.add(id(node))
        for node in reversed(order[1:]):
            if node.tag in ("table", "ul", "ol", "div") and id(node) not in kept and (self.weight(node) < 0 or self._is_odd(node)):
                self.gone.add(id(node))
                for above in node.ancestors():
                    self._resum(above)
                    if above is part:
                        break
        self.texts.clear()

    def _resum(self, node: Node) -> None:
        total = Sums()
        for child in node.children:
            if isinstance(child, str):
                total.chars += len("".join(child.split()))
                total.commas += child.count(",")
            elif id(child) not in self.gone:
                total.add(child, self.sums[id(child)])
        self.sums[id(node)] = total

    def _is_odd(self, node: Node) -> bool:
        n = self.sums[id(node)]
        if n.commas >= 10:
            return False
        listing = node.tag in ("ul", "ol") or n.listed > 0.9 * n.chars
        share, weight, li = self.link_share(node), self.weight(node), n.li - 100
        odd = n.img > 1 and n.p / n.img < 0.5 or not listing and li > n.p or n.inputs > n.p // 3
        odd = odd or not listing and n.heads < 0.9 * n.chars and n.chars < 25 and n.img != 1 and share > 0
        odd = odd or not listing and weight < 25 and share > 0.2 or weight >= 25 and share > 0.5
        return odd and not (listing and n.img and n.img == n.li)

    def length(self) -> int:
        self.texts.clear()
        return len(" ".join(self.text(p) for p in self.parts).strip())


def find_article(root: Node) -> Article | None:
    """The first search that gives enough text, else the one that gives most; None where a page has no text."""
    tried = []
    for rules in ((True, True, True), (False, True, True), (False, False, True), (False, False, False)):
        tried.append(Article(root, *rules))
        if tried[-1].length() >= ENOUGH:
            return tried[-1]
    best = max(tried, key=Article.length)
    return best if best.length() else None


def title_of(root: Node) -> str:
    """The page's title: of its metadata, else of its title without the site's name, else its only first heading."""
    nodes = list(root.nodes())
    meta = {(n.get("property") or n.get("name")).strip().lower(): n.get("content").strip() for n in nodes if n.tag == "meta"}
    for name in ("dc:title", "dcterm:title", "og:title", "weibo:article:title", "weibo:webpage:title", "title", "twitter:title"):
        if meta.get(name):
            return meta[name]
    whole = title = " ".join(next((n.text() for n in nodes if n.tag == "title"), "").split())
    heads = [" ".join(n.text().split()) for n in nodes if n.tag == "h1"]
    parted = bool(re.search(r" [\|\-–—\\/>»] ", title))
    if parted:
        title = re.sub(r"(.*)[\|\-–—\\/>»] .*", r"\1", title).strip()
        if len(title.split()) < 3:
            title = re.sub(r"^[^\|\-–—\\/>»]*[\|\-–—\\/>»]", "", whole).strip()
    elif ": " in title and title not in heads and title not in [n.text().strip() for n in nodes if n.tag == "h2"]:
        title = whole[whole.rfind(":") + 1 :].strip()
        if len(title.split()) < 3:
            title = whole[whole.find(":") + 1 :].strip()
        elif len(whole[: whole.find(":")].split()) > 5:
            title = whole
    elif (len(title) > 150 or len(title) < 15) and len(heads) == 1:
        title = heads[0]
    words, stepped = len(title.split()), bool(re.search(r" [\\/>»] ", whole))
    if words <= 4 and (not stepped or words != len(re.sub(r"[\|\-–—\\/>»]+", "", whole).split()) - 1):
        title = whole if len(heads) != 1 or whole else heads[0]
    return title
