"""HTML to node and text rows (one Arrow pass), kept as array columns of the page row.

``nodes`` is in document order, ``id`` is the 1-based position, so ``nodes[id - 1]`` is a node and
``(id, last]`` are its descendants.  ``t0``/``t1`` bound its slice of ``texts`` the same way.
Ancestor tests and element text are therefore interval tests and slices: no join, no shuffle.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors get this module with the task, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODE_TYPE = (
    "struct<id:int,parent:int,last:int,depth:int,tag:string,attrs:map<string,string>,"
    "classes:array<string>,t0:int,t1:int>"
)
TEXT_TYPE = "struct<owner:int,kind:string,text:string>"

# Elements without content, and elements whose strings are not page text.
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
HIDDEN_TAGS = frozenset("script style template rt rp".split())

_CHUNK_BYTES = 8 << 20

# Tags in their plainest form, which most are, are read by one match each; the tokenizer reads all others,
# and those that may change how it reads on.
_START = re.compile(r'<([a-z][a-z0-9]*)((?: [a-z][a-z0-9-]*="[^"&]*")*)>')
_ATTR = re.compile(r' ([a-z0-9-]+)="([^"]*)"')
_END = re.compile(r"</([a-z][a-z0-9]*)>")
_MODE_TAGS = HIDDEN_TAGS | frozenset("iframe math noembed noframes noscript plaintext svg textarea title xmp".split())


class _Rows(HTMLParser):
    """Appends one page's nodes and texts to flat column lists."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent: list[int] = []
        self.last: list[int] = []
        self.depth: list[int] = []
        self.tag: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.t0: list[int] = []
        self.t1: list[int] = []
        self.owner: list[int] = []
        self.kind: list[str] = []
        self.text: list[str] = []
        self.node_offsets = [0]
        self.text_offsets = [0]
        self.errors: list[int] = []
        self._bad = 0
        self._open: list[int] = []
        self._open_tags: Counter[str] = Counter()
        self._hidden = 0

    def add_page(self, html: str | None) -> None:
        self.reset()
        self._open.clear()
        self._open_tags.clear()
        self._bad = 0
        if html:
            try:
                self.feed(html)
                self.close()
            except AssertionError:  # markup that the tokeniser rejects in a way not known of
                self._bad += 1
        while self._open:
            self._end()
        self.node_offsets.append(len(self.tag))
        self.text_offsets.append(len(self.text))
        self.errors.append(self._bad)

    def parse_html_declaration(self, i: int) -> int:
        """A declaration that the tokeniser rejects is skipped as a comment is, and counted."""
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            end = self.rawdata.find(">", i)
            if end < 0:
                return -1
            self._bad += 1
            self.handle_comment(self.rawdata[i + 2 : end])
            return end + 1

    def parse_starttag(self, i: int) -> int:
        plain = _START.match(self.rawdata, i)
        if not plain or plain[1] in _MODE_TAGS:
            return super().parse_starttag(i)
        self._start(plain[1], dict(_ATTR.findall(plain[2])) if plain[2] else {})
        return plain.end()

    def parse_endtag(self, i: int) -> int:
        plain = None if self.cdata_elem else _END.match(self.rawdata, i)
        if not plain:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1])
        return plain.end()

    def updatepos(self, i: int, j: int) -> int:
        return j  # lines are not counted: nobody asks where a tag stood

    def _end(self) -> None:
        at = self._open.pop()
        self._open_tags[self.tag[at]] -= 1
        self._hidden -= self.tag[at] in HIDDEN_TAGS
        self.last[at] = len(self.tag) - self.node_offsets[-1]
        self.t1[at] = len(self.text) - self.text_offsets[-1]

    def _local(self, at: int) -> int:
        return at - self.node_offsets[-1] + 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._start(tag, {k: v or "" for k, v in attrs})

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        at = len(self.tag)
        self.parent.append(self._local(self._open[-1]) if self._open else 0)
        self.depth.append(len(self._open) + 1)
        self.tag.append(tag)
        self.attrs.append(attrs)
        texts = len(self.text) - self.text_offsets[-1]
        self.last.append(self._local(at))
        self.t0.append(texts)
        self.t1.append(texts)
        if tag not in VOID_TAGS:
            self._open.append(at)
            self._open_tags[tag] += 1
            self._hidden += tag in HIDDEN_TAGS

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self._end()

    def handle_endtag(self, tag: str) -> None:
        if self._open_tags[tag]:  # an end tag closes up to its nearest open tag, or nothing
            while self.tag[self._open[-1]] != tag:
                self._end()
            self._end()

    def _string(self, kind: str, text: str) -> None:
        self.owner.append(self._local(self._open[-1]) if self._open else 0)
        self.kind.append(kind)
        self.text.append(text)

    def handle_data(self, data: str) -> None:
        self._string("hidden" if self._hidden else "text", data)

    def handle_comment(self, data: str) -> None:
        self._string("comment", data)

    def handle_decl(self, decl: str) -> None:
        self._string("doctype", decl)

    def unknown_decl(self, data: str) -> None:
        if data.upper().startswith("CDATA["):
            self._string("text", data[6:])
        else:
            self._string("doctype", data)

    def handle_pi(self, data: str) -> None:
        self._string("doctype", data)

    def arrays(self) -> tuple[pa.Array, pa.Array]:
        i32 = pa.int32()
        ids = [
            i
            for lo, hi in zip(self.node_offsets, self.node_offsets[1:])
            for i in range(1, hi - lo + 1)
        ]
        keys, values, attr_offsets, classes, class_offsets = [], [], [0], [], [0]
        for attrs in self.attrs:
            keys.extend(attrs)
            values.extend(attrs.values())
            attr_offsets.append(len(keys))
            classes.extend(attrs.get("class", "").split())
            class_offsets.append(len(classes))
        node = pa.StructArray.from_arrays(
            [
                pa.array(ids, i32),
                pa.array(self.parent, i32),
                pa.array(self.last, i32),
                pa.array(self.depth, i32),
                pa.array(self.tag, pa.string()),
                pa.MapArray.from_arrays(
                    pa.array(attr_offsets, i32), pa.array(keys, pa.string()), pa.array(values, pa.string())
                ),
                pa.ListArray.from_arrays(pa.array(class_offsets, i32), pa.array(classes, pa.string())),
                pa.array(self.t0, i32),
                pa.array(self.t1, i32),
            ],
            names=["id", "parent", "last", "depth", "tag", "attrs", "classes", "t0", "t1"],
        )
        text = pa.StructArray.from_arrays(
            [pa.array(self.owner, i32), pa.array(self.kind, pa.string()), pa.array(self.text, pa.string())],
            names=["owner", "kind", "text"],
        )
        return (
            pa.ListArray.from_arrays(pa.array(self.node_offsets, i32), node),
            pa.ListArray.from_arrays(pa.array(self.text_offsets, i32), text),
        )


def _chunks(batch: pa.RecordBatch, sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > _CHUNK_BYTES:
            yield start, i - start
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes) - start


def _to_dom(html_at: int, keep_html: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(html_at)), 0).to_pylist()
            for start, count in _chunks(batch, sizes):
                part = batch.slice(start, count)
                rows = _Rows()
                for html in part.column(html_at):
                    rows.add_page(html.as_py())
                nodes, texts = rows.arrays()
                names, columns = list(part.schema.names), list(part.columns)
                if not keep_html:
                    del names[html_at], columns[html_at]
                errors = pa.array(rows.errors, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*columns, nodes, texts, errors], names=[*names, "nodes", "texts", "parse_errors"]
                )

    return run


def with_dom(pages: DataFrame, keep_html: bool = False) -> DataFrame:
    """Replace ``html`` by ``nodes``, ``texts`` and ``parse_errors``; all other columns pass through.

    ``parse_errors`` counts declarations that no tokenizer rule fits; they are kept as comments.

    The body leaves the row here, so nothing after this step can shuffle it by accident.
    """
    fields = [f for f in pages.schema.fields if keep_html or f.name != "html"]
    nodes = T.StructField("nodes", T.DataType.fromDDL(f"array<{NODE_TYPE}>"))
    texts = T.StructField("texts", T.DataType.fromDDL(f"array<{TEXT_TYPE}>"))
    return pages.mapInArrow(
        _to_dom(pages.columns.index("html"), keep_html), T.StructType([*fields, nodes, texts, T.StructField("parse_errors", T.IntegerType())])
    )


def node_rows(dom: DataFrame, *keys: str) -> DataFrame:
    """One row per element, for work that wants the tree as a table."""
    return dom.select(*(keys or ("page_id",)), F.explode("nodes").alias("n")).select(
        *(keys or ("page_id",)),
        F.col("n.id").alias("node_id"),
        F.col("n.parent").alias("parent_id"),
        F.col("n.tag").alias("tag"),
        F.col("n.attrs").alias("attrs"),
        F.col("n.classes").alias("classes"),
        F.col("n.id").alias("lo"),
        F.col("n.last").alias("hi"),
    )


def text_rows(dom: DataFrame, *keys: str) -> DataFrame:
    """One row per string of the page, in document order (``pos`` from 1)."""
    return dom.select(*(keys or ("page_id",)), F.posexplode("texts").alias("p", "t")).select(
        *(keys or ("page_id",)),
        F.col("t.owner").alias("node_id"),
        (F.col("p") + 1).alias("pos"),
        F.col("t.kind").alias("kind"),
        F.col("t.text").alias("text"),
    )
