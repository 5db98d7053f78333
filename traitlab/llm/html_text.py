"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text blocks, each with its root-to-leaf tag
path (tag names with their class and id tokens, inline tags left out).  Paths
are numbered nodes of a tree, so a page is read in time linear in its length,
however deep its tags nest.  Per tag path the text length, punctuation and
link text of its blocks are summed; a path's ratio is text per block times
punctuation per block, both on a log scale, times the share of text outside
links.  Ratios are smoothed along the page with the neighbouring blocks that
share the parent path, so a short paragraph among long ones keeps its place.

The threshold follows the page's mass: a share of the mean ratio weighted by
text length, and at least the ratio of a block of prose (or, on pages without
prose, most of the largest ratio).  Where one subtree holds most of the mass,
paths outside it need the ratio of a longer passage.  Paths that reach the
threshold are content; all of their blocks are returned, in page order.
Blocks of a lower ratio (headings, short paragraphs, lists) come with them
below the parent of a content path, below a common ancestor of several (the
page's own body counts for its direct children only), and as headings right
before content.  On a page with content in <article> or <main>, those are
taken as the region of lower ratios instead.

HTML's own elements for menus, footers, asides, forms' parts, scripts and so
on, and hidden ones, are never read.  A class, id or role token that as a
whole names such a part (``sidebar``, not ``has-sidebar``) is a prior only:
its subtree is left out unless it is a long passage with most of the page's
text and no <article> or <main> stands outside, in which case the name is
ignored.  Reader comments may be longer than the article: what a token names
as comments is read only where nothing else is.
"""

from __future__ import annotations

import html as html_lib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: Element names, as HTML defines them (fixed values).
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong",
          "sub", "sup", "time", "tt", "u", "var"}
#: Elements that close an open <p>.
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure",
            "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p",
            "pre", "section", "table", "ul"}
#: Start tag -> open tags it ends, up to a tag of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"})}
NEVER = {"script", "style", "noscript", "template", "head", "title", "iframe", "svg", "math", "canvas", "object", "video",
         "audio", "nav", "footer", "aside", "button", "select", "option", "textarea", "dialog", "menu", "header",
         "noembed", "noframes", "xmp", "datalist", "map"}
#: Tokens in class, id or role that name what is not the article.
BOILER = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo",
          "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "side", "aside",
          "footer", "foot", "header", "masthead", "topbar", "cookie", "cookies", "consent", "gdpr", "notice", "popup",
          "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social",
          "related", "recommended", "recommendations", "widget", "widgets", "pagination", "pager", "toolbar",
          "complementary", "contentinfo", "search", "copyright", "legal", "disclaimer", "alert"}
#: Tokens that name reader comments.
COMMENTS = {"comment", "comments", "commentlist", "comment-list", "reply", "replies", "disqus", "disqus_thread", "respond"}
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
#: In a tag, a quote opens only right after an equals sign.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=\s*[^\s\"'>][^\s>]*|=)*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]*)))?""")
SPACES = re.compile(r"\s+")
SHARE = 0.25      # of the mean ratio
PLAIN = 0.1       # added to the punctuation's part, for texts without any
PROSE = math.log1p(100) * (math.log1p(2) + PLAIN)    # ratio of a block of 100 characters with two marks
PASSAGE = math.log1p(200) * (math.log1p(6) + PLAIN)  # needed outside the subtree that holds most of the page
MOST = 0.8        # of the page's mass
LONG = 200        # characters of a passage whose name is ignored
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class Block:
    """A run of text: its path, the element around it that a token names as
    boilerplate, whether it is in <article> or <main>, and its parts."""

    __slots__ = ("path", "mark", "article", "parts", "links")

    def __init__(self, top):
        self.path, self.mark, self.article, self.parts, self.links = top.path, top.mark, top.article, [], 0

    def text(self) -> str:
        return SPACES.sub(" ", html_lib.unescape("".join(self.parts))).strip()


class Paths:
    """Tag paths as a tree of numbered nodes; a parent's number is smaller
    than its children's.  Node 0 is the page."""

    def __init__(self):
        self.parent, self.tag, self.number = [0], [""], {}

    def below(self, node: int, tag: str, name: str) -> int:
        got = self.number.get((node, name))
        if got is None:
            got = self.number[node, name] = len(self.parent)
            self.parent.append(node)
            self.tag.append(tag)
        return got


def _named(attributes: str) -> tuple[list, bool]:
    """Class, id and role tokens of a tag, and whether it is hidden."""
    tokens, hidden = [], False
    if attributes and not attributes.isspace():
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name in ("class", "id", "role"):
                tokens += (a or b or c).lower().split()
            elif name == "hidden" or name == "aria-hidden" and (a or b or c).lower() == "true":
                hidden = True
            elif name == "style":
                hidden |= "display:none" in (a or b or c).lower().replace(" ", "")
    return tokens, hidden


class Open:
    """An open element, with what it inherits from those around it."""

    __slots__ = ("tag", "path", "skip", "mark", "article", "link", "p", "ends")

    def __init__(self, tag, path, skip, mark, article, link, p, ends):
        self.tag, self.path, self.skip, self.mark, self.article, self.link, self.p, self.ends = tag, path, skip, mark, article, link, p, ends


#: The sets of ENDS, and for each tag the place of its set.
RULES = list({id(v): v for v in ENDS.values()}.values())
RULE_OF = {tag: RULES.index(v) for tag, v in ENDS.items()}
RULED = {t for ends, limit in RULES for t in ends | limit}


def blocks(page: str) -> tuple[list[Block], Paths, list]:
    """Text blocks in page order, the tree of their paths, and the marked
    elements: ``marks[i]`` is (marked element around it or -1, whether it
    holds comments)."""
    out: list[Block] = []
    paths, marks = Paths(), []
    stack = [Open("", 0, False, -1, False, False, -1, (-1,) * len(RULES))]
    count: dict[str, int] = {}  # open elements by tag
    current: Block | None = None
    at, n = 0, len(page)

    def text(s: str):
        nonlocal current
        top = stack[-1]
        if not s or top.skip:
            if s and not s.isspace() and current is None:
                current = Block(top)  # unread text also parts blocks
                out.append(current)
            return
        if current is None:
            if s.isspace():
                return
            current = Block(top)
            out.append(current)
        current.parts.append(s)
        if top.link:
            current.links += len(s)

    def close(k: int):
        nonlocal current
        for t in stack[k:]:
            count[t.tag] -= 1
            if t.tag not in INLINE:
                current = None
        del stack[k:]

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if count.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag in VOID:
            if tag == "br":
                text(" ")
            elif tag == "hr":
                current = None
            continue
        if tag in CLOSES_P and stack[-1].p >= 0:
            close(stack[-1].p)
        if tag in RULE_OF and (k := stack[-1].ends[RULE_OF[tag]]) >= 0:
            close(k)
        if tag in RAW:
            if tag not in INLINE:
                current = None
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        top, here = stack[-1], len(stack)
        tokens, hidden = _named(m[3])
        skip = top.skip or hidden or tag in NEVER and not (tag == "header" and top.article)
        mark = top.mark
        if not skip and tag not in ("body", "html", "article", "main"):
            talk = not COMMENTS.isdisjoint(tokens)
            if talk or tag == "form" or any(w in BOILER and not (top.article and w == "header") for w in tokens):
                marks.append((mark, talk))
                mark = len(marks) - 1
        if tag in INLINE:
            path, p = top.path, top.p
        else:
            current = None
            path, p = paths.below(top.path, tag, " ".join([tag, *tokens])), -1
        ends = top.ends
        if tag in RULED:
            ends = tuple(-1 if tag in limit else here if tag in rule else e for e, (rule, limit) in zip(ends, RULES))
        stack.append(Open(tag, path, skip, mark, top.article or tag in ("article", "main"), top.link or tag == "a", here if tag == "p" else p, ends))
        count[tag] = count.get(tag, 0) + 1
    return out, paths, marks


def content(page: str | None) -> str:
    """The main text of a page, blocks joined by a newline."""
    all_blocks, paths, marks = blocks(page or "")
    found = [(b, t) for b in all_blocks if (t := b.text())]
    found = _without_marked(found, marks)
    if not found:
        return ""
    # per tag path: blocks, text, punctuation, text in links
    sums: dict[int, list] = {}
    for b, t in found:
        s = sums.setdefault(b.path, [0, 0, 0, 0])
        for i, x in enumerate((1, len(t), len(PUNCTUATION.findall(t)), min(b.links, len(t)))):
            s[i] += x
    ratio = {p: math.log1p(c / k) * (math.log1p(q / k) + PLAIN) * (1 - a / c) for p, (k, c, q, a) in sums.items()}
    parent = [paths.parent[b.path] for b, _ in found]
    raw = [ratio[b.path] for b, _ in found]
    smooth = []
    for i in range(len(raw)):  # a block with its neighbours of the same parent
        near = [raw[j] for j in range(max(0, i - 2), min(len(raw), i + 3)) if parent[j] == parent[i]]
        smooth.append(sum(near) / len(near))
    chars = [len(t) for _, t in found]
    mean = sum(x * c for x, c in zip(smooth, chars)) / sum(chars)
    bar = max(SHARE * mean, min(PROSE, MOST * max(smooth)))
    inside = _core([(b.path, x * c) for (b, _), x, c in zip(found, smooth, chars)], paths)
    passed = [x >= bar and (x >= PASSAGE or inside[b.path]) for (b, _), x in zip(found, smooth)]
    whole, direct = _regions({b.path for (b, _), x in zip(found, passed) if x}, paths)
    keep = [x or whole[b.path] or q in direct for (b, _), x, q in zip(found, passed, parent)]
    for i in range(len(keep) - 2, -1, -1):  # a heading goes with what follows it
        keep[i] = keep[i] or keep[i + 1] and paths.tag[found[i][0].path] in HEADINGS
    return "\n".join(t for (_, t), x in zip(found, keep) if x)


def _without_marked(found: list, marks: list) -> list:
    """The blocks outside marked elements; a mark that covers ``LONG``
    characters and ``MOST`` of the page's text outside comments is ignored
    unless text in <article> or <main> is not marked, and all marks of
    comments where there is no other text."""
    if not marks:
        return found
    mass, total = [0] * len(marks), 0
    sure = any(b.mark < 0 and b.article for b, _ in found)
    talk = []
    for around, own in marks:
        talk.append(own or around >= 0 and talk[around])
    for b, t in found:
        size = len(t) - min(b.links, len(t))
        if b.mark < 0 or not talk[b.mark]:
            total += size
            if b.mark >= 0:
                mass[b.mark] += size
    for i in range(len(marks) - 1, -1, -1):  # a mark's mass holds that of the marks inside it
        if marks[i][0] >= 0:
            mass[marks[i][0]] += mass[i]
    drop = []
    for i, (around, own) in enumerate(marks):
        mine = total > 0 if talk[i] else sure or mass[i] < max(LONG, MOST * total)
        drop.append(mine or around >= 0 and drop[around])
    return [x for x in found if x[0].mark < 0 or not drop[x[0].mark]]


def _core(weights: list, paths: Paths) -> list:
    """Whether each path is in the smallest subtree that holds ``MOST`` of the
    page's mass (the page itself, where no part does)."""
    n = len(paths.parent)
    mass, best = [0.0] * n, [0] * n
    for p, x in weights:
        mass[p] += x
    for p in range(n - 1, 0, -1):
        mass[paths.parent[p]] += mass[p]
    for p in range(n - 1, 0, -1):
        if mass[p] > mass[best[paths.parent[p]]] or best[paths.parent[p]] == 0:
            best[paths.parent[p]] = p
    core = 0
    while best[core] and mass[best[core]] >= MOST * mass[0]:
        core = best[core]
    if any(p == core for p, _ in weights) and core:
        core = paths.parent[core]  # blocks beside the densest path belong to it
    inside = [False] * n
    for p in range(n):
        inside[p] = p == core or p > 0 and inside[paths.parent[p]]
    return inside


def _regions(content_paths: set[int], paths: Paths) -> tuple[list, set[int]]:
    """Where blocks of a lower ratio stay: whether each path is below one of
    the regions, and the nodes whose direct children stay."""
    above: dict[int, set] = {}  # node: its children on the way to content
    for p in content_paths:
        while p:
            up = paths.parent[p]
            if p in above.setdefault(up, set()):
                break
            above[up].add(p)
            p = up
    marked = {p for p in above.keys() | content_paths if paths.tag[p] in ("article", "main")}
    page: set[int] = set()
    if not marked:
        found = {paths.parent[p] for p in content_paths} | {p for p, c in above.items() if len(c) > 1}
        page = {p for p in found if paths.tag[p] in ("", "html", "body")}
        marked = found - page
    whole = [False] * len(paths.parent)
    for p in range(1, len(whole)):
        whole[p] = p in marked or whole[paths.parent[p]]
    return whole, page


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row: ``page_id, url, text, n_chars`` (long, code points).

    A null, empty or textless page has an empty text.  Unclosed tags, stray
    end tags and cut pages are read as far as they go; null ids, null urls
    and repeated rows are carried; an empty table gives none.
    """
    small_batches(pages.sparkSession)
    out = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                        T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for b in batches:
            texts = [content(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=out.names)

    return pages.select(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col)).mapInArrow(run, out)
