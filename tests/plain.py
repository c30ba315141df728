"""Plain Python counterparts of page work, for brute-force checks: a tree, selectors, suggestions."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from lotweave.constants import FIELD_DICTIONARY
from lotweave.operators.dom import HIDDEN_TAGS, VOID_TAGS


class Node:
    def __init__(self, tag, attrs, parent, id_):
        self.tag, self.attrs, self.parent, self.id = tag, attrs, parent, id_
        self.classes = attrs.get("class", "").split()
        self.inside = []  # strings of this element and of those below, in order

    def above(self):
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


class Tree(HTMLParser):
    """Elements and strings (owner, kind, text) of a page, an end tag closing to its nearest open tag."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.nodes, self.strings, self.open = [], [], []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open[-1] if self.open else None, len(self.nodes) + 1)
        self.nodes.append(node)
        if tag not in VOID_TAGS:
            self.open.append(node)

    def handle_endtag(self, tag):
        if any(n.tag == tag for n in self.open):
            while self.open.pop().tag != tag:
                pass

    def _string(self, kind, text):
        owner = self.open[-1] if self.open else None
        string = (owner, kind, text)
        self.strings.append(string)
        for n in self.open:
            n.inside.append(string)

    def handle_data(self, data):
        self._string("hidden" if any(n.tag in HIDDEN_TAGS for n in self.open) else "text", data)

    def handle_comment(self, data):
        self._string("comment", data)

    def handle_decl(self, decl):
        self._string("doctype", decl)


def element_text(node):
    return "".join(t.strip() for o, kind, t in node.inside if kind == "text" or (kind == "hidden" and o is node))


def node_selector(node):
    if node is None:
        return "[document]"
    if node.attrs.get("id"):
        return "#" + node.attrs["id"]
    if node.classes:
        return "." + ".".join(node.classes)
    path, at = [], node
    while at is not None and len(path) < 4:
        path.insert(0, ".".join([at.tag, *at.classes]))
        at = at.parent
    return " > ".join(path if len(path) == 4 else ["[document]", *path])


def css(tree, selector):
    """Elements that a selector of tag, .class, #id, [attr] steps finds, by testing every element's ancestors."""
    tokens = re.findall(r">|[^\s>]+", selector)

    def fits(node, token):
        tag, rest = re.fullmatch(r"([\w-]*)(.*)", token).groups()
        return (not tag or node.tag == tag) and all(
            (part[1:] in node.classes) if part[0] == "." else (node.attrs.get("id") == part[1:]) if part[0] == "#" else part[1:-1] in node.attrs
            for part in re.findall(r"[.#][\w-]+|\[[\w-]+\]", rest)
        )

    def holds(node, at):
        if not fits(node, tokens[at]):
            return False
        if at == 0:
            return True
        if tokens[at - 1] == ">":
            return node.parent is not None and holds(node.parent, at - 2)
        return any(holds(a, at - 1) for a in node.above())

    return [n for n in tree.nodes if holds(n, len(tokens) - 1)]


def suggestions(html, answers):
    """(field, rank, selector, confidence, value, matches, first text) of a page; answers: field to value."""
    tree = Tree(html)
    out = []
    for field, _, _, pattern, words in FIELD_DICTIONARY:
        found = []  # (selector, confidence, value) in order of strategies
        if pattern:
            found += [(node_selector(o), 0.8, t.strip()) for o, _, t in tree.strings if re.search(pattern, t, re.I)]
        if answers and answers.get(field):
            value = answers[field]
            found += [(node_selector(o), 0.9, value) for o, _, t in tree.strings if t.strip() and value.lower() in t.lower()]
        for word in words:
            named = [n for n in tree.nodes if word in " ".join(n.classes).lower()]
            found += [(node_selector(n), 0.6, element_text(n) or None) for n in named]
            found += [("#" + n.attrs["id"], 0.7, element_text(n) or None) for n in tree.nodes if word in n.attrs.get("id", "").lower()]
            found += [(node_selector(n), 0.8, element_text(n) or None) for n in tree.nodes if any(re.search(f"data.*{word}", k.lower()) for k in n.attrs)]
        once = {}
        for selector, confidence, value in found:
            once.setdefault(selector, (confidence, value))
        for rank, (selector, (confidence, value)) in enumerate(sorted(once.items(), key=lambda x: -x[1][0]), 1):
            hits = css(tree, selector)
            out.append((field, rank, selector, confidence, value, len(hits), element_text(hits[0]) if hits else None))
    return sorted(out)
