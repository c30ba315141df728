"""Many selectors of a page in one sweep over its elements.

Elements are in document order and an element's descendants follow it up to ``last``, so candidates
of one step and elements of the next are two sorted lists: walking both with the largest ``last`` seen
so far tells for each element whether some candidate holds it.  No element is tested against each
candidate, and nested candidates cost nothing more.

All pages of a batch are swept together.  Their elements stand in one numbering, with postings by tag,
class and attribute; a step looks up its rarest posting and tests the rest of its conditions on those
elements only.  A selector that many pages ask for is evaluated once for all of them, and a condition
that many selectors share is looked up once.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Executors get this module with the task, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SWEPT_TYPE = "array<struct<spans:array<struct<id:int,last:int>>,strings:array<int>>>"
STEPS_TYPE = (
    "array<array<struct<child:boolean,tag:string,id:string,classes:array<string>,"
    "attrs:array<struct<name:string,op:string,value:string>>>>>"
)

_TESTS: dict[str, Callable[[str, str], bool]] = {
    "exists": lambda got, want: True,
    "=": lambda got, want: got == want,
    "*=": lambda got, want: want != "" and want in got,
    "^=": lambda got, want: want != "" and got.startswith(want),
    "$=": lambda got, want: want != "" and got.endswith(want),
    "~=": lambda got, want: want in got.split(),
}


class Postings:
    """Places by value of a string column, each list sorted."""

    def __init__(self, values: pa.Array, places: np.ndarray) -> None:
        coded = values.dictionary_encode()
        codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        self.places, self.rows = places[order], order
        self.bounds = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
        self.code = {v: k for k, v in enumerate(coded.dictionary.to_pylist())}

    def _slice(self, value: str) -> slice:
        k = self.code.get(value)
        return slice(0, 0) if k is None else slice(self.bounds[k], self.bounds[k + 1])

    def of(self, value: str) -> np.ndarray:
        return self.places[self._slice(value)]

    def rows_of(self, value: str) -> np.ndarray:
        """Rows of the column that hold the value."""
        return self.rows[self._slice(value)]


class Pages:
    """Elements and strings of a batch of pages in one numbering, from 0."""

    def __init__(self, parent: pa.ListArray, last: pa.ListArray, tag: pa.ListArray, attrs: pa.ListArray, classes: pa.ListArray) -> None:
        self.first = _offsets(parent)
        n = int(self.first[-1])
        self.page = np.repeat(np.arange(len(parent)), np.diff(self.first))
        base = self.first[self.page]
        own = parent.flatten().to_numpy(zero_copy_only=False)
        #: -1 for elements without a parent
        self.parent = np.where(own > 0, base + own - 1, -1)
        self.last = base + last.flatten().to_numpy(zero_copy_only=False) - 1
        self.every = np.arange(n)
        self.tags = Postings(tag.flatten(), self.every)
        lists = classes.flatten()
        self.class_owner = np.repeat(self.every, np.diff(_offsets(lists)))
        self.class_names = lists.flatten()
        self.classes = Postings(self.class_names, self.class_owner)
        maps = attrs.flatten()
        limits = _offsets(maps)
        start, stop = int(maps.offsets[0].as_py()) if len(maps) else 0, int(maps.offsets[len(maps)].as_py()) if len(maps) else 0
        self.attr_values = maps.items.slice(start, stop - start) if len(maps) else pa.array([], pa.string())
        keys = maps.keys.slice(start, stop - start) if len(maps) else pa.array([], pa.string())
        self.attr_owner = np.repeat(self.every, np.diff(limits))
        self.attrs = Postings(keys, self.attr_owner)
        self.memo: dict[tuple, np.ndarray] = {}

    # -- conditions ---------------------------------------------------------------------------------

    def _values(self, name: str) -> tuple[np.ndarray, list[str]]:
        """Elements that have an attribute, and its value; classes are joined by one space each."""
        key = ("values", name)
        if key not in self.memo:
            rows = self.attrs.rows_of(name)
            places = self.attr_owner[rows]
            if name == "class":
                names = self.class_names.to_pylist()
                bounds = np.searchsorted(self.class_owner, [places, places + 1])
                values = [" ".join(names[a:b]) for a, b in bounds.T.tolist()]
            else:
                values = self.attr_values.take(pa.array(rows)).to_pylist()
            self.memo[key] = places, values
        return self.memo[key]

    def _attr(self, name: str, op: str, value: str) -> np.ndarray:
        places, values = self._values(name)
        test = _TESTS[op]
        hit = np.fromiter((v is not None and test(v, value) for v in values), bool, len(values))
        return np.unique(places[hit])

    def named(self, step: tuple) -> np.ndarray:
        """Elements that meet all conditions of a step, wherever they stand."""
        if step not in self.memo:
            tag, id_, classes, attrs = step
            lists = [np.unique(self.classes.of(c)) for c in classes]
            if id_ is not None:
                lists.append(self._attr("id", "=", id_))
            lists += [self._attr(*a) for a in attrs]
            if tag is not None:
                lists.append(self.tags.of(tag))
            found = self.every
            for places in sorted(lists, key=len):  # the rarest first
                found = places if found is self.every else found[_among(found, places)]
            self.memo[step] = found
        return self.memo[step]

    # -- the sweep ----------------------------------------------------------------------------------

    def select(self, steps: tuple) -> np.ndarray:
        """Elements that a selector finds, in order; steps are (child, conditions)."""
        found = None
        for child, conditions in steps:
            here = self.named(conditions)
            if found is None:
                found = here[self.parent[here] < 0] if child else here
            elif child:
                found = here[_among(self.parent[here], found)]
            else:
                found = here[self.inside(found, here, below=True)]
        return found

    def inside(self, found: np.ndarray, places: np.ndarray, below: bool) -> np.ndarray:
        """Which of the places, in order, stand in a found element's span; `below`: the element itself does not."""
        if not len(found):
            return np.zeros(len(places), bool)
        reach = np.maximum.accumulate(self.last[found])
        before = np.searchsorted(found, places, "left" if below else "right") - 1
        return (before >= 0) & (reach[np.maximum(before, 0)] >= places)


def _offsets(lists: pa.Array) -> np.ndarray:
    """Offsets from 0 of a list or map column; a null list is empty."""
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) if not isinstance(lists, pa.MapArray) else np.diff(lists.offsets.to_numpy())
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def _among(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which values are among the sorted places."""
    if not len(places):
        return np.zeros(len(values), bool)
    at = np.searchsorted(places, values)
    return (at < len(places)) & (places[np.minimum(at, len(places) - 1)] == values)


def _step(s: dict) -> tuple:
    attrs = tuple((a["name"], a["op"], a["value"] or "") for a in s["attrs"] or ())
    return bool(s["child"]), (s["tag"], s["id"], tuple(s["classes"] or ()), attrs)


def _joined(*codes: np.ndarray) -> np.ndarray:
    """One number per row, equal where all its codes are; codes and numbers count from 0."""
    out = codes[0]
    for more in codes[1:]:
        out = np.unique(out * (more.max(initial=0) + 1) + more, return_inverse=True)[1]
    return out


def _coded(values: pa.Array) -> np.ndarray:
    """One number per value, equal where values are equal: strings, flags, lists and structs of them, and nulls."""
    if pa.types.is_struct(values.type):
        inner = _joined(*[_coded(c) for c in values.flatten()]) if values.type.num_fields else np.zeros(len(values), np.int64)
    elif pa.types.is_list(values.type):
        first, items = _offsets(values), _coded(values.flatten()) + 1
        size = np.diff(first)
        inner = np.zeros(len(values), np.int64)
        for j in range(int(size.max(initial=0))):  # the next item of every list that has one, else 0
            item = np.zeros(len(values), np.int64)
            there = size > j
            item[there] = items[first[:-1][there] + j]
            inner = _joined(inner, item)
    else:
        return values.dictionary_encode().indices.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False) + 1
    null = values.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
    return _joined(np.where(null, 0, inner), null)


def _selectors(asked: pa.ListArray, ends: pa.ListArray) -> tuple[list[tuple | None], np.ndarray]:
    """The distinct (steps, end) of a batch, and the number of each asked one among them.

    Selectors are told apart by numbers made column by column; only the distinct ones become Python values.
    """
    lists, last = asked.flatten(), ends.flatten()
    _, places, numbers = np.unique(_joined(_coded(lists), _coded(last)), return_index=True, return_inverse=True)
    out: list[tuple | None] = []
    for at in places.tolist():
        plain = lists[at].as_py()
        out.append((tuple(_step(s) for s in plain), last[at].as_py()) if plain else None)
    return out, numbers


def sweep_pages(pages: Pages, owner: np.ndarray, owner_first: np.ndarray, asked: pa.ListArray, ends: pa.ListArray) -> pa.ListArray:
    """Spans of every asked selector of every page, and places of the strings that its end asks for.

    `owner` is the element of each string (-1: the page, or a string of no element's text), by page.
    """
    selectors, numbers = _selectors(asked, ends)
    first = _offsets(asked)
    page_of = np.repeat(np.arange(len(asked)), np.diff(first))
    n_asked = len(numbers)
    span_count, text_count = np.zeros(n_asked, np.int64), np.zeros(n_asked, np.int64)
    spans: list[np.ndarray] = [np.zeros(0, np.int64)] * n_asked
    texts: list[np.ndarray] = [np.zeros(0, np.int64)] * n_asked
    missing = np.zeros(n_asked, bool)
    order = np.argsort(numbers, kind="stable")
    bounds = np.searchsorted(numbers[order], np.arange(len(selectors) + 1))
    shown = np.flatnonzero(owner >= 0)
    by_owner = np.argsort(owner[shown], kind="stable")
    for k, selector in enumerate(selectors):
        mine = order[bounds[k] : bounds[k + 1]]
        if selector is None:
            missing[mine] = True
            continue
        steps, end = selector
        found = pages.select(steps)
        cut = np.searchsorted(found, pages.first)
        strings, string_cut = None, None
        if end in ("text()", "//text()"):
            rows = shown[by_owner]
            hit = _among(owner[rows], found) if end == "text()" else pages.inside(found, owner[rows], below=False)
            strings = np.sort(rows[hit])
            string_cut = np.searchsorted(strings, owner_first)
        for i in mine.tolist():
            page = page_of[i]
            spans[i] = found[cut[page] : cut[page + 1]]
            if strings is not None:
                texts[i] = strings[string_cut[page] : string_cut[page + 1]]
    span_count[:], text_count[:] = [len(s) for s in spans], [len(t) for t in texts]
    flat = np.concatenate(spans) if n_asked else np.zeros(0, np.int64)
    base = pages.first[np.repeat(page_of, span_count)]
    string_base = owner_first[np.repeat(page_of, text_count)]
    flat_texts = (np.concatenate(texts) if n_asked else np.zeros(0, np.int64)) - string_base
    i32 = pa.int32()
    span = pa.StructArray.from_arrays([pa.array(flat - base + 1, i32), pa.array(pages.last[flat] - base + 1, i32)], ["id", "last"])
    found_spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(span_count)]), i32), span, mask=pa.array(missing))
    found_texts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(text_count)]), i32), pa.array(flat_texts, i32))
    result = pa.StructArray.from_arrays([found_spans, found_texts], ["spans", "strings"])
    return pa.ListArray.from_arrays(pa.array(first, i32), result, mask=asked.is_null())


def _swept(
    parent: pa.Array, last: pa.Array, tag: pa.Array, attrs: pa.Array, classes: pa.Array, owner: pa.Array, kind: pa.Array, steps: pa.Array, ends: pa.Array
) -> pa.Array:
    pages = Pages(parent, last, tag, attrs, classes)
    string_first = _offsets(owner)
    holder = owner.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    page = np.repeat(np.arange(len(owner)), np.diff(string_first))
    shown = np.isin(kind.flatten().to_numpy(zero_copy_only=False).astype(str), ["text", "hidden"]) & (holder > 0)
    place = np.where(shown, pages.first[page] + holder - 1, -1)
    return sweep_pages(pages, place, string_first, steps, ends)


def sweep(steps: Column, ends: Column) -> Column:
    """Results of a page's selectors, in order: struct of spans (id, last) and places in ``texts``.

    ``steps`` is an array of compiled selectors, ``ends`` what each ends in (``selectors.terminal``);
    strings are given for ends in text.  A null selector has null spans, a null array a null result.
    """
    swept = F.arrow_udf(_swept, SWEPT_TYPE)
    part = [F.col(f"nodes.{c}") for c in ("parent", "last", "tag", "attrs", "classes")]
    return swept(*part, F.col("texts.owner"), F.col("texts.kind"), steps.cast(STEPS_TYPE), ends)


def found_values(found: Column, end: Column) -> Column:
    """Raw string results of a swept XPath."""
    name = F.regexp_replace(end, "^@", "")
    attr = F.filter(F.transform(found["spans"], lambda s: F.get(F.col("nodes"), s.id - 1).attrs[name]), lambda v: v.isNotNull())
    return (
        F.when(end.isin("text()", "//text()"), F.transform(found["strings"], lambda p: F.get(F.col("texts"), p).text))
        .when(F.startswith(end, F.lit("@")), attr)
        .otherwise(F.transform(found["spans"], lambda s: F.lit("")))
    )
