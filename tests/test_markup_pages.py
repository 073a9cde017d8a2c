"""Pages that are deep, huge or broken, and random pages against a plain recursive reading."""

import html
import random

import pytest

from lorespark.operators import markup


def nested(tag, depth, text="x"):
    return f"<{tag}>" * depth + text + f"</{tag}>" * depth


@pytest.mark.parametrize("page", [nested("div", 5000), nested("b", 3000), nested("ul><li", 2000), nested("blockquote", 3000), nested("table><tr><td", 1500), "<p>" * 5000, "</div>" * 5000, "<b>" * 20_000, "<a" * 5000, "<!--" * 3000])
def test_deep_pages(page):
    got = markup.extract_page(page)
    assert set(got) == set(markup._FIELDS)
    if page.endswith(">") and "x" in page:
        assert "x" in got["text"] and "x" in got["cleaned"] and "x" in got["markdown"]


def test_deep_and_broken_json():
    deep = '{"a":' * 5000 + "1" + "}" * 5000
    some = '{"a":' * 300 + "1" + "}" * 300
    page = "".join(f'<script type="application/ld+json">{j}</script>' for j in (deep, "{", some, '{"name": ["n", {"x": 1}], "@id": 2, "list": [[3]]}', "[" * 100_000))
    got = {m["name"]: m["value"] for m in markup.extract_page(page, ["metadata"])["metadata"]}
    assert got["name"] == "n" and got["name_x"] == "1" and got["list"] == "3" and got["_".join("a" * 300)] == "1" and "id" not in got


@pytest.mark.parametrize(("span", "columns"), [("9" * 5000, 1000), ("1000000000", 1000), ("²", 1), ("", 1), ("-1", 1), ("3", 3), ("x", 1)])
def test_wide_cells(span, columns):
    head = markup.extract_page(f'<table><tr><th colspan="{span}">h</th></tr></table>', ["markdown"])["markdown"].split("\n")[0]
    assert head.count("h") == columns


def test_only_what_is_wanted(monkeypatch):
    monkeypatch.setitem(markup._TAKEN, "markdown", lambda root: 1 / 0)
    assert markup.extract_page("<p>a</p>", ["text", "links"]) == {"text": "a", "links": []}


def plain_markdown(node):
    """Inline Markdown, by recursion."""
    out = ""
    for n in node.nodes:
        if n.tag is None:
            out += n.text
        elif n.tag not in markup._DROPPED:
            out += markup._marked(n, plain_markdown(n))
    return out


def plain_cleaned(node):
    out = ""
    for n in node.nodes:
        if n.tag is None:
            out += html.escape(n.text, quote=False)
        elif n.tag not in markup._DROPPED:
            inner = plain_cleaned(n)
            out += f"<{n.tag}>" + ("" if n.tag in markup._VOID else f"{inner}</{n.tag}>")
    return out


def test_random_pages_read_the_same_by_recursion():
    r = random.Random(4)
    for _ in range(200):
        page = "".join(r.choice(["<b>", "</b>", "<i>", "</i>", "<p>", "</p>", "<div>", "</div>", "<li>", "<br>", "<script>", "</script>", "<code>", "</code>", " a&amp;b ", "word", "<"]) for _ in range(r.randrange(60)))
        root = markup.parse(page)
        assert markup._inline(root) == plain_markdown(root)
        assert markup.cleaned(root) == plain_cleaned(root)
        holders = markup._block_holders(root)
        for n in root.walk():
            assert (id(n) in holders) == (n.tag in markup._BLOCKS or any(x.tag in markup._BLOCKS for x in n.walk()))


def test_pages_on_spark(spark):
    rows = [(1, nested("div", 5000, "deep")), (2, None), (3, ""), (4, "<title>t</title>" + nested("b", 2000, "bold"))]
    got = {r["page_id"]: r for r in markup.extract(spark.createDataFrame(rows, "page_id long, html string"), ["text", "markdown", "metadata"]).collect()}
    assert got[1]["text"] == "deep" and got[1]["markdown"] == "deep" and got[2]["text"] == "" and "bold" in got[4]["markdown"] and got[4]["metadata"][0]["value"] == "t"


def test_rendered_parts_are_dealt_over_all_cores(spark):
    # One small file: without dealing, one task would parse every page.
    pages = markup._parts(spark, "/root/testdata/sf0.01")
    held = [n for n in pages.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()]
    assert len(held) >= 4 * spark.sparkContext.defaultParallelism and max(held) <= 2 * sum(held) / len(held)


def test_plain_markup_is_read_as_by_the_standard_parser(monkeypatch):
    pieces = ["<", ">", "/", '"', "'", "=", " ", "\n", "\x0b", "\xa0", "<p", "<p>", "</p>", '<a href="x">', "<a href=x/>", "<A HREF='y&amp;' b>", "<br/>", "<br />", "<input disabled/>", "<script>", "</script>", '<script src="q">a&b</script>', "<STYLE>p{}</style >", "<style>x</script>", "<title>", "<!-- c -->", "<!--", "-->", "<!doctype html>", "&amp;", "&lt", "&", "text", "<td>", "<tr>", "<table>", "</table>", "<li>", "</ul>", "</ p>", "</>", "<?x?>", "<!x>", "<script/>", "<scripts>", '<a b="1" b="2" C>', "`", "<dl><dt>", "<dd>", "</a\n>"]
    r = random.Random(3)
    pages = ["".join(r.choice(pieces) for _ in range(r.randint(1, 9))) for _ in range(20_000)]
    pages += ["<script>a < b; '</p>' && '<b>'</script>x", "<script><!-- x </script> --></script>", markup.TEMPLATE]

    def flat(n, depth=0):
        return [(depth, n.tag, n.attrs, n.text), *(y for x in n.nodes for y in flat(x, depth + 1))]

    got = [flat(markup.parse(p)) for p in pages]
    assert markup._plain(markup.TEMPLATE) is not None and sum(markup._plain(p) is not None for p in pages) > 4_000
    monkeypatch.setattr(markup, "_plain", lambda page: None)
    for page, tree in zip(pages, got, strict=True):
        assert tree == flat(markup.parse(page)), page


def _flat(n, depth=0):
    return [(depth, n.tag, n.attrs, n.text), *(y for x in n.nodes for y in _flat(x, depth + 1))]


def test_plain_pages_are_split_and_read_as_by_the_pattern():
    # The pattern alone took over three times as long; pages of plain markup must not come to it.
    assert markup._split(markup.TEMPLATE) is not None
    pieces = ["<", ">", "a > b", "<p>", "</p>", "<P >", '<a href="x>y">', "<a href='&lt;' b>", "<br/>", "<i/>", "<script>", "</script>", "</SCRIPT>", "</script >", "a&amp;b", "<style x=1>", "</style>", "<!-- c -->", "<!-- <b> -->", "<!-- a > b -->", "<!---->", "<!doctype html>", "<!x>", "<ſcript>", "</ſcript>", f'<img alt="{"long " * 50}">', "<td>", "<tr>", "<li>", "</ul>", "<dt>", "<dd>"]
    r = random.Random(5)
    split = 0
    for page in ("".join(r.choice(pieces) for _ in range(r.randint(0, 9))) for _ in range(20_000)):
        got, want = markup._split(page), markup._matched(page)
        split += got is not None
        assert got is None or (want is not None and _flat(got) == _flat(want)), page
    assert split > 4_000


def test_marks_kept_are_few_and_short():
    for k in range(2 * markup._known_mark.cache_info().maxsize):
        markup.parse(f'<p id="{k}"><img alt="{k}{"x" * markup.SHORT}">')
    info = markup._known_mark.cache_info()
    assert info.currsize <= info.maxsize <= 4096 and markup._known_mark("/p") == ("end", "p", {})
    assert not any(len(markup.parse(f"<p {'x' * n}>").nodes) != 1 for n in (markup.SHORT - 2, markup.SHORT, 10_000))


def test_elements_are_found_in_the_order_of_a_walk():
    r = random.Random(6)
    for _ in range(300):
        page = "".join(r.choice(["<b>", "</b>", "<p>", "</p>", "<div>", "</div>", "<li>", "<br>", "<td>", "<tr>", "<table>", "</table>", "<dt>", "<dd>", "x", "<"]) for _ in range(r.randrange(60)))
        root = markup.parse(page)
        for tags in ((), ("b",), ("li", "p"), ("td", "tr", "table"), ("i",)):
            assert [id(n) for n in root.walk(*tags)] == [id(n) for n in markup.Node.walk(root, *tags)]


def test_looking_for_elements_takes_no_walk(monkeypatch):
    monkeypatch.setattr(markup.Node, "walk", None)
    got = markup.extract_page('<h2>a</h2><img src="s"><abbr title="t">b</abbr><pre>c</pre><h1>d</h1>', ["headings", "images", "abbreviations"])
    assert [h["text"] for h in got["headings"]] == ["d", "a"] and got["images"][0]["src"] == "s" and got["abbreviations"] == [{"term": "b", "title": "t"}]


def test_part_pages_hold_values_as_they_are(spark):
    # A value that names another place of the template was filled in again.
    rows = [(1, "{size} <&", "{brand}", "$1 {name}", 7), (2, None, "t", "b", 1)]
    got = {r["page_id"]: r["html"] for r in markup.part_pages(spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string, p_size int")).collect()}
    assert got[1].startswith('<!doctype html><html><head><title> {size} <& </title><meta name="description" content="{brand} 7"><meta property="og:title" content="$1 {name}">') and got[2] is None
    assert "{broken" in got[1] and '"price":7,' in got[1]


@pytest.mark.parametrize("field", ["metadata", "code", "abbreviations", "tables", "images"])
def test_fields_of_plain_pages_are_those_of_the_standard_parser(monkeypatch, field):
    pieces = ['<meta name="a" content="b&amp;c">', '<meta property="og:x" content="1">', '<p itemprop="k">v</p>', "<title> t </title>", '<script type="application/ld+json">{"q": [1]}</script>', '<pre><code class="language-python">a\n</code></pre>', "<pre>b</pre>", '<abbr title="t">x</abbr>', "<abbr>y</abbr>", "<table><tr><th>h<th>i<tr><td>1<td>2</table>", "<table><tr><td><table><tr><td>in</table></table>", '<img src="s" alt="&lt;">', "<img src=u title='w'/>", "<h1>z</h1>", "text"]
    r = random.Random(7)
    pages = ["".join(r.choices(pieces, k=r.randint(1, 9))) for _ in range(300)] + [markup.TEMPLATE]
    assert all(markup._split(p) is not None for p in pages)
    got = [markup.extract_page(p, [field]) for p in pages]
    monkeypatch.setattr(markup, "_plain", lambda page: None)
    assert got == [markup.extract_page(p, [field]) for p in pages] and any(g[field] for g in got)


def test_elements_read_alone_are_those_of_the_whole_tree():
    pieces = ["<b>", "</b>", "<p>", "<p id=a>", "</p>", "<div id='b'>", "</div>", "<li id=c>", "<li>", "</li>", "<ul>", "</ul>", "<br>", "<br id=d/>", "</br>", "<i/>", "<td>", "</td>", "<tr>", "<table>", "</table>", "<dl>", "<dt>", "<dd id=e>", "<script id=f>", "</script>", "<!-- c -->", "a &amp; b", "x > y"]
    r = random.Random(8)
    alone = 0
    for page in ("".join(r.choices(pieces, k=r.randint(1, 14))) for _ in range(20_000)):
        if markup._split(page) is None:
            continue
        want = markup._split(page).tree()
        for tags, having in ((("b",), ""), (("p", "li"), ""), (("table", "td"), ""), (("script", "br"), ""), (("dl", "dd"), "id"), ((), "id")):
            root = markup._split(page)
            assert [_flat(n) for n in root.walk(*tags, having=having)] == [_flat(n) for n in want.walk(*tags, having=having)], page
            alone += root.whole is None
    assert alone > 20_000


@pytest.mark.parametrize("field", ["metadata", "code", "abbreviations", "tables", "images"])
def test_fields_of_single_elements_need_no_whole_tree(monkeypatch, field):
    # The whole tree of every page was made for each of these, which took most of the time.
    want = markup.extract_page(markup.TEMPLATE, [field])
    monkeypatch.setattr(markup.Pieces, "tree", lambda self: 1 / 0)
    assert markup.extract_page(markup.TEMPLATE, [field]) == want and want[field]


def test_marks_inside_a_found_element_are_read_once(monkeypatch):
    # Each of 1,500 tables inside one another, read by itself, would be a million marks.
    read = []
    alone = markup.Pieces.alone
    monkeypatch.setattr(markup.Pieces, "alone", lambda self, at: read.append(at) or alone(self, at))
    root = markup._split("<table><tr><td>" * 1500 + "</td></tr></table>" * 1500 + "<table></table>")
    assert sum(1 for _ in root.walk("table")) == 1501 and read == [0, 9000] and root.whole is None
