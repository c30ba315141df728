"""page_lines and model_input over all four layouts, against the standard library's parser and against the SQL."""

from html.parser import HTMLParser

import pytest

from lotweave.registry import ORACLES, QUERIES, corpus
from tests.check import connect

SF = "/root/testdata/sf0.001"


class Pieces(HTMLParser):
    """Visible text pieces, without those inside the tags to leave out."""

    def __init__(self, without):
        super().__init__()
        self.without, self.deep, self.out = without, 0, []

    def handle_starttag(self, tag, attrs):
        self.deep += tag in self.without

    def handle_endtag(self, tag):
        self.deep -= tag in self.without

    def handle_data(self, data):
        if not self.deep and data.strip():
            self.out.append(data.strip())


def brute(html, name):
    reader = Pieces(("style", "script") if name == "page_lines" else ("style", "script", "nav", "footer", "aside", "header", "form", "button", "input"))
    reader.feed(html)
    reader.close()
    return "\n".join(x for x in reader.out if name == "page_lines" or (len(x) > 5 and not x.isdigit()))


@pytest.mark.parametrize("name", ["page_lines", "model_input"])
def test_every_page_and_layout(spark, name):
    html = {r["page_id"]: r["html"] for r in corpus.listing_pages(spark, SF).collect()}
    got = {r["page_id"]: r["lines"] for r in QUERIES[name](spark, SF).collect()}
    assert {i % 4 for i in got} == {0, 1, 2, 3}
    assert got == {i: brute(h, name) for i, h in html.items()}
    assert got == dict(connect(SF).sql(ORACLES[name]).fetchall())
