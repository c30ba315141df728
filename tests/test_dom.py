from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lotweave.operators.dom import _Rows, node_rows, text_rows, with_dom


def tree(html):
    rows = _Rows()
    rows.add_page(html)
    nodes, texts = rows.arrays()
    return nodes.to_pylist()[0], texts.to_pylist()[0]


def test_void_and_self_closed_tags_have_no_children():
    nodes, _ = tree('<p>a<br>b<img src="x">c</p><i/>d')
    assert [(n["tag"], n["parent"], n["last"]) for n in nodes] == [("p", 0, 3), ("br", 1, 2), ("img", 1, 3), ("i", 0, 4)]


def test_end_tag_closes_to_nearest_open_tag_and_strays_are_ignored():
    nodes, texts = tree("<div><p><b>x</p>y</div></span>z")
    assert [(n["tag"], n["parent"]) for n in nodes] == [("div", 0), ("p", 1), ("b", 2)]
    assert [(t["owner"], t["text"]) for t in texts] == [(3, "x"), (1, "y"), (0, "z")]


def test_kinds_of_strings_and_entities():
    _, texts = tree("<!DOCTYPE html><!-- c --><script>var a='</p>';</script><p>&amp;&copy;</p><style>s</style>")
    assert [(t["kind"], t["text"]) for t in texts] == [
        ("doctype", "DOCTYPE html"), ("comment", " c "), ("hidden", "var a='</p>';"), ("text", "&©"), ("hidden", "s")]


def test_duplicate_attributes_keep_the_last_and_missing_values_are_empty():
    nodes, _ = tree('<a href="1" href="2" class=" x  y " hidden>')
    assert dict(nodes[0]["attrs"]) == {"href": "2", "class": " x  y ", "hidden": ""}
    assert nodes[0]["classes"] == ["x", "y"]


_parts = st.lists(
    st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<br>", "<div>", "</div>", "t", " ", "<!--c-->", "<script>", "</script>", "<li>", "</ul>"]),
    max_size=40,
)


@settings(max_examples=150, deadline=None)
@given(_parts)
def test_intervals_agree_with_parents(parts):
    nodes, texts = tree("".join(parts))
    for n in nodes:
        assert n["parent"] < n["id"] <= n["last"] <= len(nodes) and 0 <= n["t0"] <= n["t1"] <= len(texts)
        below = set()
        for m in nodes:  # brute force over parent links
            up = m["parent"]
            while up:
                if up == n["id"]:
                    below.add(m["id"])
                up = nodes[up - 1]["parent"]
        assert below == set(range(n["id"] + 1, n["last"] + 1))
        own = {i for i, t in enumerate(texts) if n["id"] <= t["owner"] <= n["last"]}
        assert own == set(range(n["t0"], n["t1"]))


def test_columns_pass_through_and_html_leaves(spark, pages):
    dom = with_dom(pages("<p>a</p>", None, ""))
    assert dom.columns == ["page_id", "url", "nodes", "texts", "parse_errors"]
    assert {r.page_id: r.n for r in dom.select("page_id", F.size("nodes").alias("n")).collect()} == {0: 1, 1: 0, 2: 0}
    assert with_dom(pages("<p>a</p>"), keep_html=True).columns == ["page_id", "url", "html", "nodes", "texts", "parse_errors"]


def test_long_tables(spark, pages):
    dom = with_dom(pages("<ul><li>a</li><li>b</li></ul>"))
    assert [(r.node_id, r.parent_id, r.tag, r.hi) for r in node_rows(dom).orderBy("node_id").collect()] == [
        (1, 0, "ul", 3), (2, 1, "li", 2), (3, 1, "li", 3)]
    assert [(r.pos, r.node_id, r.text) for r in text_rows(dom).orderBy("pos").collect()] == [(1, 2, "a"), (2, 3, "b")]


def test_deep_unclosed_markup_stays_linear():
    nodes, _ = tree("<p>x" * 5000)
    assert len(nodes) == 5000 and nodes[0]["last"] == 5000 and nodes[-1]["depth"] == 5000
    assert issubclass(_Rows, HTMLParser)


def test_rejected_declarations_lose_nothing_else(spark, pages):
    rows = with_dom(pages("<p>a</p><![foo bar]><p>b</p>", "<p>c</p>", "<p>d</p><![foo")).orderBy("page_id").collect()
    shown = [[t["text"] for t in r.texts if t["kind"] == "text"] for r in rows]
    assert shown[0] == ["a", "b"] and shown[1] == ["c"] and shown[2][0] == "d"
    assert [r.parse_errors for r in rows][:2] == [1, 0]


def test_plain_tags_are_read_as_the_tokenizer_reads_them(monkeypatch):
    plain = '<div id="a" class=""><p class="x y" title="1 > 2">t &amp; u<br></p><li class="a" class="b">v</li></div>'
    odd = [
        "<P>a</P >", '<b a="1"b="2">', "<td a=1 b>x", '<a href="x&amp;y">z</a x>', "<br/><i/>", '<p a="<b>">q</p>', "a < b", "</>x", "<p a='1'>", '<p a="',
        '<script>a<b c="d">e</p></script>f', "<title>a<b>c</b></title>", "<textarea><p>x</textarea>", "<style>p</div></style>", "<svg><title>x</title></svg>", "<é>x", "<p\x00>",
    ]
    pages = [plain, *odd, *[plain + o + plain for o in odd], *[plain[:n] for n in range(len(plain))]]

    def rows(reader):
        made = reader()
        for page in pages:
            made.add_page(page)
        return [a.to_pylist() for a in made.arrays()], made.errors

    class Tokenizer(_Rows):
        parse_starttag, parse_endtag, updatepos = HTMLParser.parse_starttag, HTMLParser.parse_endtag, HTMLParser.updatepos

    assert rows(_Rows) == rows(Tokenizer)
    monkeypatch.setattr(HTMLParser, "parse_starttag", None)
    monkeypatch.setattr(HTMLParser, "parse_endtag", None)
    _Rows().add_page(plain)  # reads no tag of these itself
