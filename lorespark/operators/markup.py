"""Extraction from pages' markup: metadata, assets, tables, code, lists, Markdown, cleaned markup.

One parse of each page in one Arrow call gives a struct; every extraction after it is a
native projection of that struct.  Nothing is kept between pages.
"""

from __future__ import annotations

import functools
import html
import html.parser
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import ship
from ..sources.tables import dealt, table

# Languages whose code blocks stay, prefixes that name a language, attributes that stay, schemes of unsafe links.
CODE_LANGUAGES = ("python", "javascript", "html", "css", "java", "c", "cpp")
PREFIXES = ("language-", "lang-", "brush:", "syntax-")
KEPT_ATTRIBUTES = ("href", "src", "alt", "title", "class")
UNSAFE = ("javascript:", "data:", "vbscript:")
_DROPPED = frozenset(("script", "style", "noscript", "iframe"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
#: A new one of these ends an open one.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPES = {"p": {"div", "td", "li", "body", "main", "article"}, "li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}}
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_BLOCKS = frozenset(("p", "div", "section", "article", "main", "ul", "ol", "table", "pre", "blockquote", "dl", "header", "footer", "nav", "body", "html", "h1", "h2", "h3", "h4", "h5", "h6", "li"))


#: The attributes of what has none: attributes are never changed.
_BARE: dict[str, str] = {}


class Node:
    """An element (or, with ``tag`` None, a text, which has no nodes)."""

    __slots__ = ("tag", "attrs", "nodes", "text")

    def __init__(self, tag: str | None, attrs: dict[str, str] = _BARE, text: str = ""):
        self.tag = tag
        self.attrs = attrs
        self.nodes = () if tag is None else []
        self.text = text

    def walk(self, *tags: str):
        """Elements below, in order of the document, of the tags given if any."""
        stack = list(reversed(self.nodes))
        while stack:
            n = stack.pop()
            if n.tag is not None:
                if not tags or n.tag in tags:
                    yield n
                stack += reversed(n.nodes)

    def content(self, skip: frozenset = frozenset()) -> str:
        """All text below."""
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if n.tag is None:
                out.append(n.text)
            elif n.tag not in skip:
                stack += reversed(n.nodes)
        return "".join(out)

    def clean(self) -> str:
        return " ".join(self.content(_DROPPED).split())


class Root(Node):
    """A page's root, with its elements as they came, so that looking for some takes no walk through the tree."""

    __slots__ = ("elements",)

    def __init__(self):
        super().__init__("")
        self.elements: list[Node] = []

    def walk(self, *tags: str, having: str = ""):
        """Elements in order of the document, of the tags and with the attribute given if any."""
        return iter([n for n in self.elements if (not tags or n.tag in tags) and (not having or having in n.attrs)])


class _Tree:
    """Elements and texts as they come, put into one another."""

    def __init__(self):
        self.root = Root()
        self.elements = self.root.elements
        self.open = [self.root]
        #: Open elements by tag, so that a tag that closes nothing needs no look at all of them.
        self.n_open: dict[str, int] = {}

    def _close(self, k: int) -> None:
        for n in self.open[k:]:
            self.n_open[n.tag] -= 1
        del self.open[k:]

    def start(self, tag: str, names: dict[str, str]) -> None:
        n_open, open_ = self.n_open, self.open
        if tag in _CLOSES and any([n_open.get(t) for t in _CLOSES[tag]]):
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag in _SCOPES.get(tag, ()):
                    break
                if open_[k].tag in _CLOSES[tag]:
                    self._close(k)
                    break
        node = Node(tag, names)
        self.elements.append(node)
        open_[-1].nodes.append(node)
        if tag not in _VOID:
            open_.append(node)
            n_open[tag] = n_open.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        n_open, open_ = self.n_open, self.open
        if n_open.get(tag):
            if open_[-1].tag == tag:
                n_open[tag] -= 1
                open_.pop()
                return
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    self._close(k)
                    return

    def data(self, text: str) -> None:
        self.open[-1].nodes.append(Node(None, _BARE, text))


class _Builder(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tree = _Tree()
        self.handle_endtag, self.handle_data = self.tree.end, self.tree.data

    def updatepos(self, i: int, j: int) -> int:
        return j  # lines are not counted: nobody asks for them

    def handle_starttag(self, tag, attrs):
        names: dict[str, str] = {}
        for name, value in attrs:
            names.setdefault(name, value or "")
        self.tree.start(tag, names)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.tree.end(tag)


_SPACE = r"[ \t\n\r\f]"
_ATTRIBUTE = rf"""([a-zA-Z][-a-zA-Z0-9:_.]*)(?:=(?:"([^"]*)"|'([^']*)'|([^\s"'`<>/=&]+)(?=[ \t\n\r\f>])))?"""
_ATTRIBUTES = "((?:" + _SPACE + "+" + re.sub(r"\((?=[^?])", "(?:", _ATTRIBUTE) + ")*)"
#: What follows the < of plain markup, that every parser reads alike: closing tags, tags with plain attributes, the tags of scripts and styles, declarations and plain comments.
_CLOSED = rf"/([a-zA-Z][-.a-zA-Z0-9:_]*){_SPACE}*>"
_OPENED = rf"(?!(?ai:script|style)[ \t\n\r\f/>])([a-zA-Z][a-zA-Z0-9]*){_ATTRIBUTES}{_SPACE}*(/?)>"
_RAW = rf"((?ai:script|style)){_ATTRIBUTES}{_SPACE}*>"
_DECLARED = r"(?:!(?i:doctype)[^>]*>|!--[^->](?:[^-]|-(?!-))*-->)"
#: Plain markup as a whole: texts, the above, scripts and styles with their content; a < that begins none of these is the last group.
_PLAIN = re.compile(rf"([^<]+)|<{_CLOSED}|<{_OPENED}|<{_RAW}([^<]*(?:<(?!!--|/\s*(?ai:script|style))[^<]*)*)</((?ai:script|style))>|(<{_DECLARED})|(<)")
_MARK = re.compile(f"{_CLOSED}|{_OPENED}|{_RAW}|{_DECLARED}")
_NAMED = re.compile(_ATTRIBUTE)


def _names(attributes: str) -> dict[str, str]:
    names: dict[str, str] = {}
    for name, double, single, bare in _NAMED.findall(attributes):
        value = double or single or bare
        names.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return names


def _mark(inside: str) -> tuple[str, str, dict[str, str]] | None:
    """What stands between a < and the next >: its kind, tag and attributes (shared, never changed); None if it is not plain."""
    m = _MARK.fullmatch(inside + ">")
    if m is None:
        return None
    closed, tag, attributes, slash, raw, raw_attributes = m.groups()
    if closed:
        return "end", closed.lower(), _BARE
    if tag:
        tag = tag.lower()
        return "both" if slash and tag not in _VOID else "start", tag, _names(attributes)
    return ("raw", raw.lower(), _names(raw_attributes)) if raw else ("none", "", _BARE)


#: Marks that come again and again (most do) are read once: the last few thousand short ones are kept, whatever the number of pages.
SHORT = 120
_known_mark = functools.lru_cache(maxsize=4096)(_mark)


class Pieces(Node):
    """The root of a page split at its marks. Elements that are looked for are read from their own marks alone; the whole tree is made when somebody asks for it."""

    __slots__ = ("marks", "texts", "whole")

    def __init__(self, marks: list[tuple], texts: list[str]):
        self.tag, self.attrs, self.text = "", _BARE, ""
        #: A mark and the text after it have the same place; the text before all marks is the last.
        self.marks, self.texts = marks, texts
        self.whole: Root | None = None

    @property
    def nodes(self) -> list[Node]:
        return self.tree().nodes

    def tree(self) -> Root:
        if self.whole is None:
            tree = _Tree()
            start, end, data = tree.start, tree.end, tree.data
            if self.texts[-1]:
                data(_unescaped(self.texts[-1]))
            for (kind, tag, names), text in zip(self.marks, self.texts):
                if kind == "end":
                    end(tag)
                elif kind != "none":
                    start(tag, names)
                    if kind == "both":
                        end(tag)
                if text:
                    data(text if kind == "raw" else _unescaped(text))
            self.whole = tree.root
        return self.whole

    def alone(self, at: int) -> tuple[list[Node], int] | None:
        """The element that mark ``at`` begins and those inside it, and the place of the first mark after them; None if its end hangs on what is around it."""
        marks, texts = self.marks, self.texts
        kind, tag, names = marks[at]
        node = Node(tag, names)
        if kind == "both" or tag in _VOID:
            return [node], at + 1
        if at + 1 < len(marks) and marks[at + 1][0] == "end" and marks[at + 1][1] == tag:
            if texts[at]:
                node.nodes.append(Node(None, _BARE, texts[at] if kind == "raw" else _unescaped(texts[at])))
            return [node], at + 2
        tree = _Tree()
        tree.start(tag, names)
        elements, open_, n_open = tree.elements, tree.open, tree.n_open
        if texts[at]:
            tree.data(_unescaped(texts[at]))
        for k in range(at + 1, len(marks)):
            kind, tag, names = marks[k]
            if kind == "end":
                if not n_open.get(tag):
                    return None
                tree.end(tag)
                if len(open_) == 1:
                    return elements, k + 1
            elif kind != "none":
                if tag in _CLOSES and not any([n_open.get(t) for t in (*_CLOSES[tag], *_SCOPES[tag])]):
                    return None
                tree.start(tag, names)
                if open_[1] is not elements[0]:  # ended by this one
                    return elements[:-1], k
                if kind == "both":
                    tree.end(tag)
            if texts[k]:
                tree.data(texts[k] if kind == "raw" else _unescaped(texts[k]))
        return elements, len(marks)

    def walk(self, *tags: str, having: str = ""):
        """As the whole tree's; what is inside a found element is read with it, so that no mark is read twice."""
        if self.whole is None and (tags or having):
            places = [k for k, mark in enumerate(self.marks) if mark[1] in tags] if tags else [k for k, mark in enumerate(self.marks) if having in mark[2]]
            found, after = [], 0
            for at in places:
                kind, _, names = self.marks[at]
                if at < after or kind == "end" or (having and having not in names):
                    continue
                got = self.alone(at)
                if got is None:
                    break
                elements, after = got
                found += [n for n in elements if (not tags or n.tag in tags) and (not having or having in n.attrs)]
            else:
                return iter(found)
        return self.tree().walk(*tags, having=having)


def _unescaped(text: str) -> str:
    return html.unescape(text) if "&" in text else text


def _split(page: str) -> Pieces | None:
    """A page split at each < and then at the next >; None if that does not part it into plain markup."""
    first, *pieces = page.split("<")
    marks, texts = [], []
    raw = ""
    for piece in pieces:
        inside, closing, text = piece.partition(">")
        mark = (_known_mark(inside) if len(inside) <= SHORT else _mark(inside)) if closing else None
        if mark is None:
            return None
        if raw:
            if mark[0] != "end" or mark[1] != raw or len(inside) != len(raw) + 1:
                return None
            raw = ""
        elif mark[0] == "raw":
            raw = mark[1]
        marks.append(mark)
        texts.append(text)
    texts.append(first)
    return None if raw else Pieces(marks, texts)


def _matched(page: str) -> Node | None:
    """A page's tree in one pass of one pattern; None if it holds anything but plain markup."""
    tree = _Tree()
    for text, closed, tag, attributes, slash, raw, raw_attributes, content, raw_closed, _, odd in _PLAIN.findall(page):
        if text:
            tree.data(html.unescape(text) if "&" in text else text)
        elif tag:
            tag = tag.lower()
            tree.start(tag, _names(attributes) if attributes else _BARE)
            if slash and tag not in _VOID:
                tree.end(tag)
        elif closed:
            tree.end(closed.lower())
        elif raw:
            raw = raw.lower()
            if raw != raw_closed.lower():
                return None
            tree.start(raw, _names(raw_attributes))
            if content:
                tree.data(content)
            tree.end(raw)
        elif odd:
            return None
    return tree.root


def _plain(page: str) -> Node | None:
    """A page's tree if it is plain markup: split where no < or > stands inside scripts, comments or values, else by the pattern."""
    root = _split(page)
    return _matched(page) if root is None else root


def parse(page: str | None) -> Node:
    """A page's tree: plain markup by ``_plain``, everything else by the standard library's parser, many times as slow."""
    root = _plain(page or "")
    if root is None:
        builder = _Builder()
        builder.feed(page or "")
        builder.close()
        root = builder.tree.root
    return root


def safe(url: str) -> bool:
    low = url.strip().lower()
    return low.startswith("data:image/") or not low.startswith(UNSAFE)


def _flatten(value, prefix: str, out: dict[str, str]) -> None:
    """Leaves by their path, the first of a path winning; on a stack of its own, since data may be nested at will."""
    open_: list = [(prefix, value)]
    while open_:
        name, v = open_.pop()
        if isinstance(v, dict):
            open_.extend((f"{name}_{k.lower()}" if name else k.lower(), x) for k, x in reversed(v.items()) if not k.startswith("@"))
        elif isinstance(v, list):
            open_.extend((name, x) for x in reversed(v))
        elif name:
            out.setdefault(name, v if isinstance(v, str) else json.dumps(v))


def metadata(root: Node) -> dict[str, str]:
    """JSON-LD, meta tags (the first of a name wins), redirects, microdata, and the title: its tag, else the first heading, else a default."""
    out: dict[str, str] = {}
    redirects = []
    heads: dict[str, list[Node]] = {"script": [], "meta": [], "title": [], "h1": []}
    for n in root.walk(*heads):
        heads[n.tag].append(n)
    for script in heads["script"]:
        if script.attrs.get("type", "").lower() == "application/ld+json":
            try:
                _flatten(json.loads(script.content()), "", out)
            except (ValueError, RecursionError):  # broken, or nested deeper than the parser goes
                continue
    for meta in heads["meta"]:
        content = (meta.attrs.get("content", meta.attrs.get("value", "")) or "").strip()
        if meta.attrs.get("http-equiv", "").lower() == "refresh" and (m := re.search(r"(?i)url=['\"]*([^'\"]+)", content)):
            redirects.append(m[1])
        name = (meta.attrs.get("name") or meta.attrs.get("property") or "").lower()
        if name:
            out.setdefault(name, content)
        elif "property" in meta.attrs and content:
            out[content.lower()] = ""
    if redirects:
        out["meta_redirects"] = " ".join(redirects)
    for item in root.walk(having="itemprop"):
        out.setdefault(item.attrs["itemprop"].lower(), (item.attrs.get("content") or item.clean()).strip())
    titles = [t.clean() for t in heads["title"][:1] + heads["h1"][:1]]
    out["title"] = next((t for t in titles if t), "Untitled Document")
    return out


def _language(node: Node) -> str | None:
    for name in node.attrs.get("class", "").lower().split():
        if name in ("python", "javascript"):
            return name
        for prefix in PREFIXES:
            if name.startswith(prefix) and name[len(prefix) :] in CODE_LANGUAGES:
                return name[len(prefix) :]
    return None


def _own(node: Node, *tags: str) -> list[Node]:
    """Elements of these tags that are not inside one another, nor inside a table below."""
    out, stack = [], list(reversed(node.nodes))
    while stack:
        n = stack.pop()
        if n.tag in tags:
            out.append(n)
        elif n.tag is not None and n.tag != "table":
            stack += reversed(n.nodes)
    return out


def _cells(row: Node, *tags: str) -> list[Node]:
    return _own(row, *tags)


def _rows(node: Node) -> list[Node]:
    """A table's own rows; those of tables inside it are theirs."""
    return _own(node, "tr")


def table_content(node: Node) -> dict:
    """Headers are the first row's; the others are rows."""
    rows = _rows(node)
    if not rows:
        return {"headers": [], "rows": []}
    head = _cells(rows[0], "th") or _cells(rows[0], "td")
    return {"headers": [c.clean() for c in head], "rows": [[c.clean() for c in _cells(r, "td", "th")] for r in rows[1:]]}


#: Columns that a cell spans at most, as in browsers.
SPAN = 1000


def table_markdown(node: Node) -> str:
    out = []
    for k, row in enumerate(_rows(node)):
        cells = (_cells(row, "th") or _cells(row, "td")) if k == 0 else _cells(row, "td", "th")
        texts = []
        for c in cells:
            span = c.attrs.get("colspan") or "1"
            texts += [c.clean() or " "] * (min(int(span[:6]), SPAN) if span.isascii() and span.isdigit() else 1)
        if texts:
            out.append(f"| {' | '.join(texts)} |")
            if k == 0:
                out.append(f"| {' | '.join(['---'] * len(texts))} |")
    return "\n".join(out)


def _footnotes(root: Node) -> list[dict]:
    numbers: dict[str, int] = {}
    for ref in root.walk("sup", having="id"):
        if ref.attrs.get("id", "").startswith("fnref"):
            for a in ref.walk("a"):
                if a.attrs.get("href", "").startswith("#fn"):
                    numbers.setdefault(a.attrs["href"][1:], len(numbers) + 1)
                break
    return [{"number": numbers[i.attrs["id"]], "text": i.clean()} for i in root.walk("li", having="id") if i.attrs["id"] in numbers]


def _definitions(root: Node) -> list[dict]:
    out = []
    for dl in root.walk("dl"):
        term = None
        for n in dl.walk("dt", "dd"):
            if n.tag == "dt":
                if term is not None:
                    out.append({"term": term, "text": ""})
                term = n.clean()
            elif term is not None:
                out.append({"term": term, "text": n.clean()})
                term = None
        if term is not None:
            out.append({"term": term, "text": ""})
    return out


def _assets(root: Node) -> list[dict]:
    """Style sheets, images, scripts and media, each once."""
    out: dict[tuple, dict] = {}

    def add(kind: str, src: str | None, alt: str = "") -> None:
        src = (src or "").strip()
        if src and safe(src):
            out.setdefault((kind, src), {"kind": kind, "src": src, "alt": alt.strip()})

    for n in root.walk("link", "img", "script", "audio", "video", "source"):
        if n.tag == "link":
            if "stylesheet" in n.attrs.get("rel", "").lower().split():
                add("stylesheet", n.attrs.get("href"))
        elif n.tag == "img":
            add("image", n.attrs.get("src"), n.attrs.get("alt", ""))
        else:
            add("script" if n.tag == "script" else "media", n.attrs.get("src"))
    return list(out.values())


def _marked(n: Node, inner: str) -> str:
    """A node as Markdown, for what its nodes came to."""
    if n.tag in ("b", "strong"):
        return f"**{inner.strip()}**" if inner.strip() else ""
    if n.tag in ("i", "em"):
        return f"*{inner.strip()}*" if inner.strip() else ""
    if n.tag == "code":
        return f"`{n.content()}`"
    if n.tag == "a":
        href = n.attrs.get("href", "")
        return f"[{inner.strip()}]({href})" if href and safe(href) else inner
    if n.tag == "img":
        return f"![{n.attrs.get('alt', '')}]({n.attrs.get('src', '')})" if safe(n.attrs.get("src", "")) else ""
    if n.tag == "abbr":
        return f"{inner} ({n.attrs['title']})" if n.attrs.get("title") else inner
    if n.tag == "iframe":
        src = n.attrs.get("src", "")
        return f"[iframe]({src})" if src and safe(src) else ""
    return "\n" if n.tag == "br" else inner


def _inline(node: Node) -> str:
    """A node's text with emphasis, code, links and images as Markdown."""
    open_ = [(node, iter(node.nodes), [])]
    while True:
        top, nodes, out = open_[-1]
        for n in nodes:
            if n.tag is None:
                out.append(n.text)
            elif n.tag not in _DROPPED or n.tag == "iframe":
                open_.append((n, iter(n.nodes), []))
                break
        else:
            open_.pop()
            text = "".join(out)
            if not open_:
                return text
            open_[-1][2].append(_marked(top, text))


def _block_holders(root: Node) -> set[int]:
    """Identities of nodes that are blocks or have one below them."""
    order, found = [(root, root)], set()
    for n, _ in order:
        order += [(x, n) for x in n.nodes if x.tag is not None]
    for n, above in reversed(order):
        if id(n) in found or n.tag in _BLOCKS:
            found.add(id(n))
            found.add(id(above))
    return found


def _squeeze(text: str) -> str:
    return "\n".join(" ".join(line.split()) for line in text.split("\n")).strip()


def markdown(root: Node) -> str:
    """Headings, paragraphs, lists, tables, code, definitions, emphasis and links of the body."""
    body = next(root.walk("body"), root)
    holders = _block_holders(body)
    out: list[str] = []
    open_: list[tuple] = [(iter(body.nodes), [])]

    def flush(loose: list[Node]) -> None:
        if loose:
            holder = Node("p")
            holder.nodes = list(loose)
            loose.clear()
            text = _squeeze(_inline(holder))
            if text:
                out.append(text)

    while open_:
        nodes, loose = open_[-1]
        n = next(nodes, None)
        if n is None:
            flush(loose)
            open_.pop()
            continue
        if n.tag is None or id(n) not in holders:
            loose.append(n)
            continue
        flush(loose)
        if n.tag in _DROPPED or n.tag == "head":
            continue
        if n.tag in _HEADINGS:
            text = _squeeze(_inline(n))
            if text:
                out.append(f"{'#' * int(n.tag[1])} {text}")
        elif n.tag == "pre":
            code = next(n.walk("code"), n)
            language = _language(code) or _language(n)
            if language or "class" not in code.attrs:
                out.append(f"```{language or ''}\n{n.content().strip(chr(10))}\n```")
        elif n.tag == "table":
            text = table_markdown(n)
            if text:
                out.append(text)
        elif n.tag in ("ul", "ol"):
            items = [_squeeze(_inline(i)) for i in n.nodes if i.tag == "li"]
            out.append("\n".join(f"{k}. {t}" if n.tag == "ol" else f"- {t}" for k, t in enumerate(items, 1)))
        elif n.tag == "dl":
            holder = Node("")
            holder.nodes = [n]
            out.append("\n".join(f"**{d['term']}**: {d['text']}" for d in _definitions(holder)))
        elif n.tag == "blockquote":
            out.append("\n".join(f"> {line}" for line in _squeeze(_inline(n)).split("\n")))
        else:
            open_.append((iter(n.nodes), []))
    return "\n\n".join(x for x in out if x)


def cleaned(root: Node) -> str:
    """The markup without scripts, styles and embedded frames, its elements with a few attributes only."""
    out: list[str] = []
    left: list = list(reversed(root.nodes))
    while left:
        n = left.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag is None:
            out.append(html.escape(n.text, quote=False))
        elif n.tag not in _DROPPED:
            kept = "".join(f' {k}="{html.escape(v)}"' for k, v in n.attrs.items() if k in KEPT_ATTRIBUTES and safe(v))
            out.append(f"<{n.tag}{kept}>")
            if n.tag not in _VOID:
                left.append(f"</{n.tag}>")
                left.extend(reversed(n.nodes))
    return "".join(out)


_PAIR = [("name", pa.string()), ("value", pa.string())]
_FIELDS = {
    "metadata": (pa.list_(pa.struct(_PAIR)), "array<struct<name:string,value:string>>"),
    "headings": (pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string())])), "array<struct<level:int,text:string>>"),
    "links": (pa.list_(pa.struct([("text", pa.string()), ("href", pa.string()), ("title", pa.string())])), "array<struct<text:string,href:string,title:string>>"),
    "images": (pa.list_(pa.struct([("src", pa.string()), ("alt", pa.string()), ("title", pa.string())])), "array<struct<src:string,alt:string,title:string>>"),
    "assets": (pa.list_(pa.struct([("kind", pa.string()), ("src", pa.string()), ("alt", pa.string())])), "array<struct<kind:string,src:string,alt:string>>"),
    "tables": (pa.list_(pa.struct([("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))])), "array<struct<headers:array<string>,rows:array<array<string>>>>"),
    "code": (pa.list_(pa.struct([("language", pa.string()), ("code", pa.string())])), "array<struct<language:string,code:string>>"),
    "definitions": (pa.list_(pa.struct([("term", pa.string()), ("text", pa.string())])), "array<struct<term:string,text:string>>"),
    "abbreviations": (pa.list_(pa.struct([("term", pa.string()), ("title", pa.string())])), "array<struct<term:string,title:string>>"),
    "footnotes": (pa.list_(pa.struct([("number", pa.int32()), ("text", pa.string())])), "array<struct<number:int,text:string>>"),
    "frames": (pa.list_(pa.string()), "array<string>"),
    "text": (pa.string(), "string"),
    "markdown": (pa.string(), "string"),
    "cleaned": (pa.string(), "string"),
}


def _headings(root: Node) -> list[dict]:
    heads = ((int(h.tag[1]), h.clean()) for h in root.walk(*_HEADINGS))
    return [{"level": k, "text": t} for k, t in sorted((h for h in heads if h[1]), key=lambda h: h[0])]


#: How each field is taken from a parsed page.
_TAKEN = {
    "metadata": lambda root: [{"name": k, "value": v} for k, v in metadata(root).items()],
    "headings": _headings,
    "links": lambda root: [{"text": a.clean(), "href": a.attrs["href"], "title": a.attrs.get("title", "")} for a in root.walk("a") if "href" in a.attrs],
    "images": lambda root: [{"src": i.attrs.get("src", ""), "alt": i.attrs.get("alt", ""), "title": i.attrs.get("title", "")} for i in root.walk("img")],
    "assets": _assets,
    "tables": lambda root: [table_content(t) for t in root.walk("table")],
    "code": lambda root: [{"language": _language(next(p.walk("code"), p)) or _language(p), "code": p.content().strip("\n")} for p in root.walk("pre")],
    "definitions": _definitions,
    "abbreviations": lambda root: [{"term": a.clean(), "title": a.attrs.get("title", "")} for a in root.walk("abbr")],
    "footnotes": _footnotes,
    "frames": lambda root: [f.attrs["src"] for f in root.walk("iframe") if f.attrs.get("src") and safe(f.attrs["src"])],
    "text": lambda root: " ".join(next(root.walk("body"), root).content(_DROPPED).split()),
    "markdown": markdown,
    "cleaned": cleaned,
}

#: Fields that need a page's whole tree.
_WHOLE = frozenset(("text", "markdown", "cleaned"))


def extract_page(page: str | None, wanted: list[str] | None = None) -> dict:
    """The fields ``wanted`` (all if not given) of a page, of any depth; only these are made."""
    root = parse(page)
    names = wanted or list(_TAKEN)
    if isinstance(root, Pieces) and not _WHOLE.isdisjoint(names):
        root = root.tree()
    return {name: _TAKEN[name](root) for name in names}


def extract(pages: DataFrame, wanted: list[str] | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, and the fields ``wanted``, all if not given) of each page; a null page is an empty one."""
    ship(pages.sparkSession)
    names = list(wanted or _FIELDS)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            got = [extract_page(p.as_py(), names) for p in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([g[n] for g in got], _FIELDS[n][0]) for n in names]], [id_col, *names])

    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{n} {_FIELDS[n][1]}" for n in names))


def rows_of(pages: DataFrame, field: str) -> DataFrame:
    """A field's entries as rows (page_id, pos, and the entry's own columns)."""
    each = extract(pages, [field]).select("page_id", F.posexplode(field).alias("pos", "e"))
    return each.select("page_id", "pos", "e.*")


def table_cells(pages: DataFrame) -> DataFrame:
    """(page_id, n, row, cells): headers are row 0; cells joined by a bar."""
    each = extract(pages, ["tables"]).select("page_id", F.posexplode("tables").alias("n", "t"))
    rows = each.select("page_id", "n", F.posexplode(F.concat(F.array("t.headers"), "t.rows")).alias("row", "cells"))
    return rows.select("page_id", "n", "row", F.array_join("cells", "|").alias("cells"))


#: A page for each part: everything that is extracted, whole, odd and unsafe.
TEMPLATE = """<!doctype html><html><head><title> {name} </title><meta name="description" content="{type} {size}"><meta property="og:title" content="{brand}"><meta name="Description" content="second">
<script type="application/ld+json">{"@type":"Thing","Name":"{name}","offers":{"price":{size},"@id":"x"}}</script><script type="application/ld+json">{broken</script><link rel="stylesheet" href="/style.css"><link rel="stylesheet" href="/style.css"><script src="/app.js"></script></head>
<body><main><h2>{brand}</h2><h1>{name}</h1><p>All <b>about</b> {name} &amp; more. <a href="/p/{size}" title="t">the part</a> and <a href='javascript:alert(1)'>bad</a></p>
<table><tr><th>key</th><th>value</th></tr><tr><td>size</td><td>{size}</td></tr><tr><td></td><td colspan="1">{brand}</td></tr></table><pre><code class="language-python">print({size})</code></pre><pre><code class="lang-cobol">STOP RUN</code></pre>
<img src="/img/{size}.png" alt="{name}" title="{brand}"><img src="/img/{size}.png" alt="again"><dl><dt>{brand}</dt><dd>a brand</dd><dt>lone</dt></dl><p><abbr title="{type}">{size}</abbr> stands</p>
<iframe src="https://video.example.org/{size}"></iframe><iframe src="javascript:x"></iframe><ul><li>one<li>{size}</ul><p>noted<sup id="fnref1"><a href="#fn1">1</a></sup></p><div class="footnotes"><ol><li id="fn1">note {size}</li><li>other</li></ol></div>
<p itemtype="x"><span itemprop="SKU" content="{size}"></span></p><video src="/v.mp4"></video></main><style>p{}</style></body></html>"""


def part_pages(parts: DataFrame) -> DataFrame:
    """(page_id, html): the template with a part's values in their places, put together in one go."""
    values = {"name": F.col("p_name"), "type": F.col("p_type"), "brand": F.col("p_brand"), "size": F.col("p_size").cast("string")}
    pieces = re.split(rf"{{({'|'.join(values)})}}", TEMPLATE)
    return parts.select(F.col("p_partkey").alias("page_id"), F.concat(*[values[x] if k % 2 else F.lit(x) for k, x in enumerate(pieces)]).alias("html"))


def _values(columns: str, *rows: str) -> str:
    """SQL: for each part, these rows, whose values may name its columns."""
    return " UNION ALL ".join(f"SELECT p_partkey AS page_id, {', '.join(f'{v} AS {c}' for c, v in zip(columns.split(), row.split(' ; '), strict=True))} FROM part" for row in rows)


_MARKDOWN = ["'## ' || p_brand", "'# ' || p_name", "'All **about** ' || p_name || ' & more. [the part](/p/' || p_size || ') and bad'", "'| key | value |'", "'| --- | --- |'", "'| size | ' || p_size || ' |'", "'|   | ' || p_brand || ' |'", "'```python'", "'print(' || p_size || ')'", "'```'", "'![' || p_name || '](/img/' || p_size || '.png)![again](/img/' || p_size || '.png)'", "'**' || p_brand || '**: a brand'", "'**lone**: '", "p_size || ' (' || p_type || ') stands'", "'[iframe](https://video.example.org/' || p_size || ')'", "'- one'", "'- ' || p_size", "'noted[1](#fn1)'", "'1. note ' || p_size", "'2. other'"]
_JOINTS = ["", "\n\n", "\n\n", "\n\n", "\n", "\n", "\n", "\n\n", "\n", "\n", "\n\n", "\n\n", "\n", "\n\n", "\n\n", "\n\n", "\n", "\n\n", "\n\n", "\n"]
_MARKDOWN_SQL = " || ".join("chr(10) || " * len(j) + f"({m})" for j, m in zip(_JOINTS, _MARKDOWN, strict=True))


def _parts(s, d: str) -> DataFrame:
    return part_pages(dealt(table(s, d, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")))


def _counts(pages: DataFrame) -> DataFrame:
    """What each crawled page holds, by the parser."""
    got = extract(pages, ["headings", "links", "images", "assets", "tables", "text", "markdown", "cleaned"])
    return got.select("page_id", *[F.size(n).alias(f"n_{n}") for n in ("headings", "links", "images", "assets", "tables")], "text", "markdown", "cleaned")


QUERIES = {
    "hx_metadata": lambda s, d: rows_of(_parts(s, d), "metadata").drop("pos"),
    "hx_parsed_headings": lambda s, d: rows_of(_parts(s, d), "headings"),
    "hx_parsed_links": lambda s, d: rows_of(_parts(s, d), "links"),
    "hx_images": lambda s, d: rows_of(_parts(s, d), "images"),
    "hx_assets": lambda s, d: rows_of(_parts(s, d), "assets").drop("pos"),
    "hx_tables": lambda s, d: table_cells(_parts(s, d)),
    "hx_code_blocks": lambda s, d: rows_of(_parts(s, d), "code"),
    "hx_definitions": lambda s, d: rows_of(_parts(s, d), "definitions"),
    "hx_abbreviations": lambda s, d: rows_of(_parts(s, d), "abbreviations"),
    "hx_footnotes": lambda s, d: rows_of(_parts(s, d), "footnotes"),
    "hx_frames": lambda s, d: extract(_parts(s, d), ["frames"]).select("page_id", F.explode("frames").alias("src")),
    "hx_markdown": lambda s, d: extract(_parts(s, d), ["markdown"]),
    "hx_extracted_pages": lambda s, d: _counts(table(s, d, "pages")),
}
ORACLE = {
    "hx_metadata": _values("name value", "'name' ; p_name", "'offers_price' ; p_size::VARCHAR", "'description' ; p_type || ' ' || p_size", "'og:title' ; p_brand", "'sku' ; p_size::VARCHAR", "'title' ; p_name"),
    "hx_parsed_headings": _values("pos level text", "0 ; 1 ; p_name", "1 ; 2 ; p_brand"),
    "hx_parsed_links": _values("pos text href title", "0 ; 'the part' ; '/p/' || p_size ; 't'", "1 ; 'bad' ; 'javascript:alert(1)' ; ''", "2 ; '1' ; '#fn1' ; ''"),
    "hx_images": _values("pos src alt title", "0 ; '/img/' || p_size || '.png' ; p_name ; p_brand", "1 ; '/img/' || p_size || '.png' ; 'again' ; ''"),
    "hx_assets": _values("kind src alt", "'stylesheet' ; '/style.css' ; ''", "'script' ; '/app.js' ; ''", "'image' ; '/img/' || p_size || '.png' ; p_name", "'media' ; '/v.mp4' ; ''"),
    "hx_tables": _values("n row cells", "0 ; 0 ; 'key|value'", "0 ; 1 ; 'size|' || p_size", "0 ; 2 ; '|' || p_brand"),
    "hx_code_blocks": _values("pos language code", "0 ; 'python' ; 'print(' || p_size || ')'", "1 ; NULL ; 'STOP RUN'"),
    "hx_definitions": _values("pos term text", "0 ; p_brand ; 'a brand'", "1 ; 'lone' ; ''"),
    "hx_abbreviations": _values("pos term title", "0 ; p_size::VARCHAR ; p_type"),
    "hx_footnotes": _values("pos number text", "0 ; 1 ; 'note ' || p_size"),
    "hx_frames": _values("src", "'https://video.example.org/' || p_size"),
    "hx_markdown": f"SELECT p_partkey AS page_id, {_MARKDOWN_SQL} AS markdown FROM part",
}
