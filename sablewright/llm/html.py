"""Main text of web pages by tree scoring.

A page is parsed into a tree that tolerates missing end tags. Elements that are never article text (menus, scripts,
forms, adverts, comments and the like) are pruned by tag, role and class words. Each paragraph then passes points for
its length and commas to its parent, half of them to the grandparent and a third to the next one; an element's points
are discounted by the share of its text in links. The best element, and siblings that look like it, are kept.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablewright.llm.common import by_batch, field_of, small_batches, table

_MARKUP = re.compile(r"""<(?:!--(?:(?!-->)[\s\S])*+(?:-->|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-][a-zA-Z0-9_:.-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that an open paragraph does not reach out of.
SCOPE = frozenset("html body main article section aside div td th table li dd blockquote figure form fieldset details header footer nav button".split())
#: An element with this tag ends an open one of these, unless one of the fences stands between.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")), "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "thead": (("tbody", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)),
}
NEVER = frozenset("head script style noscript template iframe object embed applet svg math canvas audio video map nav footer aside button select textarea input label fieldset datalist dialog menu title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar form alert status".split())
#: Words of classes and ids. Elements with one of them, and forms, go unless they wrap the article: those that hold article or
#: main, are one, or hold most of the paragraphs' points stay. Elements with a weak word go only if they hold a small part of
#: the page's text.
EXACT = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense adslot adslots sponsor sponsors sponsored promo promos promotion promotions promoted
    nav navs navbar navigation menu menus menubar topbar rss cta toc login signup modal popup gdpr notice notices alert pager pagination toolbar masthead breadcrumb breadcrumbs
    sidebar sidebars footer comment comments commentlist commentform reply replies respond disqus cookie cookies consent newsletter newsletters subscribe subscription subscriptions
    sharing recommend recommended recommendations trending outbrain taboola paywall skiplink skiplinks""".split()
)
WEAK = frozenset("top tags meta share legal lang hidden tools related byline widget banner popular dialog social copyright".split())
WEAK_SHARE, WRAPS = 0.3, 0.5
#: A class that begins or ends with one of these speaks of the state of something else (``has-sidebar``, ``menu-open``).
BEFORE, AFTER = frozenset("has have no with without hide show".split()), frozenset("open opened closed enabled disabled active visible on off".split())
HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
GOOD = re.compile(r"article|content|entry|main|post|story|text|body")


#: Stands between the pieces of text of two blocks.
BORDER = (-1, "")


class Tree:
    """Elements in page order as parallel lists; ``runs`` holds (element, text) for each piece of text, and borders."""

    def __init__(self, page: str):
        self.tag, self.parent, self.attr, self.runs = ["#root"], [-1], [""], []
        self._parse(page)

    def _parse(self, page: str) -> None:
        tag, parent, attr, runs = self.tag, self.parent, self.attr, self.runs
        stack, opened, at, size = [0], {}, 0, len(page)

        def close(depth: int) -> None:
            while len(stack) > depth:
                opened[tag[stack.pop()]] -= 1

        def find(names, fences) -> int:
            """The depth of the innermost open element of these names; 0 if none or a fence comes first."""
            if not any(opened.get(x) for x in names):
                return 0
            for d in range(len(stack) - 1, 0, -1):
                x = tag[stack[d]]
                if x in names:
                    return d
                if x in fences:
                    return 0
            return 0

        while at < size:
            m = _MARKUP.search(page, at)
            if m is None:
                runs.append((stack[-1], page[at:]))
                break
            if m.start() > at:
                runs.append((stack[-1], page[at : m.start()]))
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, rest = name.lower(), m[3] if m[2] else m[6]
            if m[1] or m[4]:
                if name == "p" and not opened.get("p"):
                    runs.append(BORDER)
                    continue
                if d := find((name,), SCOPE - {name} if name not in BLOCK else ("html",) if name != "p" else SCOPE):
                    close(d)
                if name in BLOCK:
                    runs.append(BORDER)
                continue
            if name in BLOCK and opened.get("p") and (d := find(("p",), SCOPE)):
                close(d)
            if name in IMPLIED:
                names, fences = IMPLIED[name]
                while d := find(names, fences):
                    close(d)
            if name in HEADING and (d := find(HEADING, SCOPE)):
                close(d)
            if name == "html" and opened.get("html") or name == "body" and opened.get("body"):
                continue
            if name in BLOCK:
                runs.append(BORDER)
            elif name == "br":
                runs.append((stack[-1], "\n"))
            tag.append(name)
            parent.append(stack[-1])
            attr.append(rest)
            if name in VOID or rest.endswith("/") and name in ("svg", "path", "circle"):
                continue
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
                continue
            stack.append(len(tag) - 1)
            opened[name] = opened.get(name, 0) + 1


def attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)}


KEEP, HEADER, WEAKLY, NAMED, GONE = range(5)


def unwanted(tag: str, rest: str) -> int:
    """Whether an element is pruned for its tag, role, visibility or class words, and how surely."""
    if tag in NEVER:
        return GONE
    if tag == "header":
        return HEADER
    out = NAMED if tag == "form" else KEEP
    if not rest or tag in ("html", "body", "main"):
        return out
    a = attributes(rest)
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return GONE
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{a.get('class', '')} {a.get('id', '')}").lower().split():
        words = _WORD.findall(name)
        if len(words) > 1 and (words[0] in BEFORE or words[-1] in AFTER):
            continue
        for w in words:
            out = max(out, NAMED if w in EXACT else WEAKLY if w in WEAK else HEADER if w == "header" else KEEP)
    return out


def _wraps(t: Tree, kind: list[int]) -> list[bool]:
    """Elements that are or hold the page's main or its largest article, or that hold more than ``WRAPS`` of the points of the
    page's paragraphs (those outside of the largest article, as long threads of comments, do not)."""
    tag, parent, n = t.tag, t.parent, len(t.tag)
    if NAMED not in kind:
        return [False] * n
    never = [k == GONE for k in kind]
    points, texts, commas = [0.0] * n, [0] * n, [0] * n
    for i in range(1, n):
        never[i] = never[i] or never[parent[i]]
    for i, text in t.runs:
        # inline elements speak for the paragraph that they stand in
        while i > 0 and tag[i] not in BLOCK and tag[i] != "a":
            i = parent[i]
        if i >= 0 and not never[i] and tag[i] not in HEADING and tag[i] != "a":
            texts[i] += len(text.strip())
            commas[i] += text.count(",") + text.count("，")
    for i in range(n - 1, 0, -1):
        if texts[i]:
            points[i] += min(texts[i] / 25, 1) + commas[i] + min(texts[i] / 100, 3)
        points[parent[i]] += points[i]
    holds, largest = [False] * n, {}
    for name in ("article", "main"):
        # a comment may be an article too
        found = [i for i in range(1, n) if tag[i] == name and points[i] and (kind[i] != NAMED or points[i] > WEAK_SHARE * points[0])]
        if found:
            up = largest[name] = max(found, key=lambda i: (points[i], -i))
            while up >= 0:
                holds[up], up = True, parent[up]
    inside = [False] * n
    for i in range(1, n):
        inside[i] = inside[parent[i]] or largest.get("article", i) == i or "article" not in largest
    return [holds[i] or inside[i] and points[i] > WRAPS * points[0] for i in range(n)]


def main_text(page: str) -> str:
    """The article's blocks in page order, joined by one line feed; empty if the page has no text."""
    t = Tree(page)
    tag, parent, n = t.tag, t.parent, len(t.tag)
    kind = [unwanted(tag[i], t.attr[i]) for i in range(n)]
    gone = [k == GONE for k in kind]
    wraps = _wraps(t, kind)
    for i in range(1, n):
        gone[i] = gone[i] or kind[i] == NAMED and not wraps[i]
        gone[i] = gone[i] or gone[parent[i]]
    size = [0] * n
    for i, text in t.runs:
        if i >= 0 and not gone[i]:
            size[i] += len(text.strip())
    for i in range(n - 1, 0, -1):
        size[parent[i]] += size[i]
    cut = [False] * n
    inside = [False] * n  # within article or main
    bare = [False] * n  # a header of the article: of it only headings are kept
    for i in range(1, n):
        up = parent[i]
        inside[i] = inside[up] or tag[i] in ("article", "main")
        bare[i] = (bare[up] or kind[i] == HEADER) and tag[i] not in HEADING
        small = tag[i] == "header" or size[i] <= WEAK_SHARE * size[0]
        cut[i] = cut[up] or gone[i] or kind[i] == WEAKLY and small or kind[i] == HEADER and not inside[up] and small
        if kind[i] == HEADER and not small:
            bare[i] = bare[up]
    # blocks: runs of text between the borders of block elements
    home = [0] * n  # the block element that an element belongs to
    linked = [False] * n
    for i in range(1, n):
        home[i] = i if tag[i] in BLOCK else home[parent[i]]
        linked[i] = tag[i] == "a" or linked[parent[i]]
    blocks: list[tuple[int, list[tuple[int, str]]]] = []  # block element, its pieces
    fresh = True
    for i, text in t.runs:
        if i < 0:
            fresh = True
        elif not cut[i] and not bare[i]:
            if fresh or blocks[-1][0] != home[i]:
                blocks.append((home[i], []))
            blocks[-1][1].append((i, text))
            fresh = False
    out = []  # block element, text, characters, characters in links
    for e, pieces in blocks:
        joined = _SPACE.sub(" ", html.unescape("".join(x for _, x in pieces))).strip()
        if joined:
            links = sum(len(html.unescape(s).strip()) for i, s in pieces if linked[i])
            out.append((e, joined, len(joined), min(links, len(joined))))
    if not out:
        return ""
    points, own, own_links = [0.0] * n, [0] * n, [0] * n
    for e, text, size, links in out:
        own[e] += size
        own_links[e] += links
        if tag[e] in HEADING or links > size / 2:
            continue
        # text straight in a container counts for the container as for a paragraph's parent
        up = parent[e] if tag[e] in ("p", "pre", "li", "td", "th", "dd", "dt", "blockquote", "figcaption", "summary") else e
        gain, share = 1 + text.count(",") + text.count("，") + min(size / 100, 3), 1.0
        for level in range(3):
            if up < 0:
                break
            points[up] += gain * share
            up, share = parent[up], 1 / (level + 2)
    for i in range(n - 1, 0, -1):
        own[parent[i]] += own[i]
        own_links[parent[i]] += own_links[i]
    for i in range(n):
        if points[i]:
            if tag[i] in ("article", "main") or GOOD.search(t.attr[i].lower()):
                points[i] = points[i] * 1.25 + 5
            points[i] *= 1 - own_links[i] / max(own[i], 1)
    best = max(range(n), key=lambda i: (points[i], -i))
    if points[best] <= 0:
        return "\n".join(x[1] for x in out)
    # lists, quotes and tables stand in a container; so does a section of an article
    while parent[best] > 0 and (tag[best] in ("ul", "ol", "dl", "blockquote", "table", "tbody", "tr", "td", "li", "details") or inside[parent[best]] and tag[best] not in ("article", "main")):
        best = parent[best]
    kept = [False] * n
    kept[best] = True
    if tag[best] not in ("body", "html", "#root"):
        paragraph = {e: (size, links) for e, _, size, links in out}
        for i in range(1, n):
            if parent[i] == parent[best] and i != best and not cut[i]:
                size, links = paragraph.get(i, (0, 0))
                kept[i] = points[i] >= max(10, points[best] * 0.2) or tag[i] == "p" and size > 80 and links < size / 4
    for i in range(1, n):
        kept[i] = kept[i] or kept[parent[i]]
    return "\n".join(x[1] for x in out if kept[x[0]])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per row of ``pages``: the id, the kept columns, ``text`` and ``n_chars``.

    A null page counts as empty and gives the empty text. Whole pages are read. Repeated rows give repeated results;
    columns that are neither the id nor in ``keep`` are not carried. One narrow pass; no shuffle.
    """
    small_batches(pages.sparkSession)
    source = pages.select(F.col(id_col).alias("__id"), F.col(html_col).alias("__html"), *(F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)))
    carried = [c for c in source.columns if c != "__html"]
    fields = [field_of(source, c, c) for c in carried]
    ddl = ", ".join(x for _, x in fields) + ", text string, n_chars bigint"
    schema = pa.schema([*(f for f, _ in fields), pa.field("text", pa.string()), pa.field("n_chars", pa.int64())])

    def make():
        def run(cols):
            texts = [main_text(p or "") for p in cols["__html"]]
            return {c: cols[c] for c in carried} | {"text": texts, "n_chars": list(map(len, texts))}

        return run

    out = source.mapInArrow(by_batch(make, schema), ddl)
    return out.select(F.col("__id").alias(id_col), *(F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)), "text", "n_chars")


def op9_tree_scored_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
