"""Page trees and CSS selectors.

tree() parses each page once, in Arrow batches: a node knows its parent, its last descendant and its run of text pieces, so a
tree is linear in its page. Selectors, texts, prices and tables are Column expressions over it. An end tag closes the nearest
open element of its name and all within it; an end tag without one, and missing end tags, change nothing else.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let

NODE = "struct<at:int,parent:int,last:int,tag:string,attrs:map<string,string>,piece:int,pieces:int>"
TREE = f"struct<nodes:array<{NODE}>,texts:array<struct<text:string,code:boolean>>>"
# Elements without content, and elements whose text is code.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CODE = ("script", "style", "template")


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.texts: list[tuple[str, bool]] = []
        self.open: list[int] = []
        self.names: defaultdict[str, int] = defaultdict(int)
        self.code = 0

    def handle_starttag(self, tag, attrs):
        at = len(self.nodes)
        self.nodes.append([self.open[-1] if self.open else -1, at, tag, {k: v or "" for k, v in attrs}, len(self.texts), 0])
        if tag not in VOID:
            self.open.append(at)
            self.names[tag] += 1
            self.code += tag in CODE

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        while self.names[tag]:
            if self._close() == tag:
                return

    def _close(self) -> str:
        node = self.nodes[self.open.pop()]
        tag = node[2]
        self.names[tag] -= 1
        self.code -= tag in CODE
        node[1], node[5] = len(self.nodes) - 1, len(self.texts) - node[4]
        return tag

    def handle_data(self, data):
        self.texts.append((data, self.code > 0))

    def finished(self):
        self.close()
        while self.open:
            self._close()
        return self.nodes, self.texts


# A plain tag, a text, or what only the parser can tell; which elements hold raw text differs between versions of the parser.
_PLAIN = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9]*)((?:[ \t\n\r\f]+[A-Za-z][\w-]*(?:=(?:"[^"&]*"|'[^'&]*'|[\w.-]+))?)*)[ \t\n\r\f]*>|([^<]+)|(<)""")
_PLAIN_ATTR = re.compile(r"""([A-Za-z][\w-]*)(?:=("[^"]*"|'[^']*'|[\w.-]+))?""")
_RAW = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())


def _plainly(html: str) -> _Tree | None:
    """The tree of a page that has plain tags and texts alone, as the parser makes it; else None."""
    t = _Tree()
    for end, name, attrs, data, other in _PLAIN.findall(html):
        if data:
            t.handle_data(unescape(data) if "&" in data else data)
        elif other or end and attrs or (tag := name.lower()) in _RAW:
            return None
        elif end:
            t.handle_endtag(tag)
        else:
            t.handle_starttag(tag, [(k.lower(), v[1:-1] if v[:1] in ("'", '"') else v) for k, v in _PLAIN_ATTR.findall(attrs)] if attrs else ())
    return t


def parsed(html: str) -> tuple[list[list], list[tuple[str, bool]]]:
    """(nodes, texts): a node is [parent, last, tag, attrs, piece, pieces]."""
    t = _plainly(html)
    if t is None:
        t = _Tree()
        t.feed(html)
    return t.finished()


_NODE = pa.struct([("at", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("piece", pa.int32()), ("pieces", pa.int32())])
_TEXT = pa.struct([("text", pa.string()), ("code", pa.bool_())])


def _lists(kind: pa.DataType, sizes: list[int], *values: pa.Array) -> pa.Array:
    offsets = pa.array(accumulate(sizes, initial=0), pa.int32())
    return (pa.MapArray if pa.types.is_map(kind) else pa.ListArray).from_arrays(offsets, *values)


def _trees(html: pa.Array) -> pa.Array:
    """Column by column: nodes kept as rows of Python would take longer than their parsing."""
    sizes, pieces, missing = [], [], []
    places, tags, n_attrs, keys, values, words, code = [], [], [], [], [], [], []
    parents, lasts, firsts, counts = ints = [], [], [], []
    for page in html:
        text = page.as_py()
        missing.append(text is None)
        own, texts = parsed(text) if text is not None else ([], [])
        sizes.append(len(own))
        pieces.append(len(texts))
        places += range(len(own))
        for parent, last, tag, attrs, first, count in own:
            parents.append(parent)
            lasts.append(last)
            tags.append(tag)
            n_attrs.append(len(attrs))
            keys += attrs
            values += attrs.values()
            firsts.append(first)
            counts.append(count)
        words += [t for t, _ in texts]
        code += [c for _, c in texts]
    parents, lasts, firsts, counts = (pa.array(x, pa.int32()) for x in ints)
    maps = _lists(_NODE.field("attrs").type, n_attrs, pa.array(keys, pa.string()), pa.array(values, pa.string()))
    nodes = pa.StructArray.from_arrays([pa.array(places, pa.int32()), parents, lasts, pa.array(tags, pa.string()), maps, firsts, counts], fields=list(_NODE))
    held = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(code, pa.bool_())], fields=list(_TEXT))
    arrays = [_lists(pa.list_(_NODE), sizes, nodes), _lists(pa.list_(_TEXT), pieces, held)]
    return pa.StructArray.from_arrays(arrays, ["nodes", "texts"], mask=pa.array(missing, pa.bool_()))


def tree(html: Column | str) -> Column:
    """The tree of each page; null has none."""
    return F.arrow_udf(_trees, TREE)(html)


def as_written(html: Column | str) -> Column:
    """The page with its character references escaped, so that its tree has them as they stand; those in code stay escaped."""
    return F.replace(html, F.lit("&"), F.lit("&amp;"))


def nodes(t: Column) -> Column:
    return t["nodes"]


def attr(node: Column, name: str) -> Column:
    return node["attrs"][name]


def has_class(node: Column, name: str) -> Column:
    return F.coalesce(attr(node, "class"), F.lit("")).rlike(rf"(?:^|\s){re.escape(name)}(?:\s|\z)")


_SIMPLE = re.compile(r"""\s*(?:(?P<tag>[A-Za-z][\w-]*)|(?P<any>\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<name>[\w-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?P<quote>["']?)(?P<value>.*?)(?P=quote)\s*)?\])""")
_JOINER = re.compile(r"\s*([>,])\s*|\s+")


def _compiled(css: str) -> list[list[tuple[str, list]]]:
    """Alternatives of steps (joiner, conditions on a node)."""
    out, at, css = [[]], 0, css.strip()
    joiner, tests = " ", []
    while at < len(css):
        m = _SIMPLE.match(css, at) if not css[at].isspace() else None
        if m and m.end() > at:
            g = m.groupdict()
            if g["tag"]:
                tests.append(lambda n, v=g["tag"].lower(): n["tag"] == v)
            elif g["id"]:
                tests.append(lambda n, v=g["id"]: attr(n, "id") == v)
            elif g["cls"]:
                tests.append(lambda n, v=g["cls"]: has_class(n, v))
            elif g["name"]:
                tests.append(_attribute(g["name"].lower(), g["op"], g["value"]))
            else:
                tests.append(lambda n: F.lit(True))
            at = m.end()
            continue
        m = _JOINER.match(css, at)
        if not m or not tests:
            raise ValueError(f"selector not understood: {css!r}")
        out[-1].append((joiner, tests))
        joiner, tests, at = m.group(1) or " ", [], m.end()
        if joiner == ",":
            out.append([])
            joiner = " "
    if not tests:
        raise ValueError(f"selector not understood: {css!r}")
    out[-1].append((joiner, tests))
    return out


def _attribute(name: str, op: str | None, value: str | None):
    def holds(n: Column) -> Column:
        a = attr(n, name)
        if op is None:
            return a.isNotNull()
        v = F.lit(value)
        kinds = {"=": a == v, "~=": F.array_contains(F.split(a, r"\s+"), v), "^=": F.startswith(a, v), "$=": F.endswith(a, v), "*=": F.contains(a, v), "|=": (a == v) | F.startswith(a, F.lit(f"{value}-"))}
        return F.lit(False) if value == "" and op in ("^=", "$=", "*=", "~=") else kinds[op]

    return holds


def select(t: Column, css: str, within: Column | None = None) -> Column:
    """The nodes that match, in page order; within: only those inside that node.

    Understood: tags, *, #id, .class, attributes with =, ~=, ^=, $=, *= and |=, descendants, children and alternatives.
    """

    def inside(n: Column, a: Column) -> Column:
        return (n["at"] > a["at"]) & (n["at"] <= a["last"])

    def matching(joiner: str, tests: list, before: Column | None):
        def holds(n: Column) -> Column:
            own = F.lit(True)
            for test in tests:
                own = own & F.coalesce(test(n), F.lit(False))
            if before is None:
                return own
            return own & F.exists(before, (lambda a: a["at"] == n["parent"]) if joiner == ">" else lambda a: inside(n, a))

        return holds

    def step(found: Column | None, joiner: str, tests: list, among: Column) -> Column:
        if found is None:
            return F.filter(among, matching(joiner, tests, None))
        return let(found, lambda before: F.filter(among, matching(joiner, tests, before)))

    def steps(alternative: list[tuple[str, list]], among: Column) -> Column:
        found = None
        for joiner, tests in alternative[:-1]:
            found = step(found, joiner, tests, nodes(t))
        return step(found, *alternative[-1], among)

    def among(w: Column) -> Column:
        """The nodes inside a node, which follow it; none for no node."""
        return F.slice(nodes(t), F.coalesce(w["at"], F.lit(0)) + 2, F.coalesce(w["last"] - w["at"], F.lit(0)))

    found = lambda of: _merged([steps(a, of) for a in _compiled(css)])
    return found(nodes(t)) if within is None else let(within, lambda w: found(among(w)))


def _merged(found: list[Column]) -> Column:
    """Nodes of several lists in page order, each once; maps can't be compared, so places stand for nodes."""
    if len(found) == 1:
        return found[0]
    all_of = F.concat(*found)
    places = F.array_sort(F.array_distinct(F.transform(all_of, lambda n: n["at"])))
    return F.transform(places, lambda p: F.get(F.filter(all_of, lambda n: n["at"] == p), F.lit(0)))


def select_one(t: Column, css: str, within: Column | None = None) -> Column:
    """The first match, null if none."""
    return F.get(select(t, css, within), F.lit(0))


def _pieces(t: Column, node: Column) -> Column:
    own = F.slice(t["texts"], node["piece"] + 1, node["pieces"])
    code = node["tag"].isin(*CODE)
    return F.transform(F.filter(own, lambda x: x["code"] == code), lambda x: x["text"])


def text(t: Column, node: Column) -> Column:
    """The text of a node with each run of white space as one space; null for no node. Code counts only in a node of code."""
    return let(node, lambda n: F.when(n.isNotNull(), F.trim(F.regexp_replace(F.array_join(_pieces(t, n), ""), r"\s+", " "))))


def spaced_text(t: Column, node: Column) -> Column:
    """As text, but white space within it stays as it stands."""
    return let(node, lambda n: F.when(n.isNotNull(), F.regexp_replace(F.array_join(_pieces(t, n), ""), r"^\s+|\s+$", "")))


def tight_text(t: Column, node: Column) -> Column:
    """As text, but pieces lose their outer white space and meet without one, as prices split over elements need."""
    bare = F.transform(_pieces(t, node), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.when(node.isNotNull(), F.trim(F.regexp_replace(F.array_join(bare, ""), r"\s+", " ")))


def price(c: Column) -> Column:
    """The first amount with cents, else the first whole number; null if there is neither."""
    cents, whole = (F.regexp_extract(c, p, 0) for p in (r"\d[\d,]*\.\d{2}", r"\d[\d,]*"))
    return F.round(F.replace(F.coalesce(F.nullif(cents, F.lit("")), F.nullif(whole, F.lit(""))), F.lit(",")).try_cast("double"), 2)


def page_price(t: Column, css: str) -> Column:
    """(price, raw_price_text, error) of the first node that matches; error says why there is no price."""
    node = select_one(t, css)
    raw = tight_text(t, node)
    unread = F.when(node.isNull(), F.lit("no match")).when(price(raw).isNull(), "no price")
    return F.struct(price(raw).alias("price"), raw.alias("raw_price_text"), unread.alias("error"))


def rows(t: Column, table: Column, deep: bool = True) -> Column:
    """Rows of cell texts of a table node; deep: with the rows and cells of tables within it, else only its own."""

    def own(n: Column, name: str, of: Column, every: Column) -> Column:
        if deep:
            return F.lit(True)
        return ~F.exists(every, lambda x: (x["at"] > of["at"]) & (x["at"] < n["at"]) & (n["at"] <= x["last"]))

    tables = select(t, "table")
    trs = F.filter(select(t, "tr"), lambda n: (n["at"] > table["at"]) & (n["at"] <= table["last"]) & own(n, "table", table, tables))

    def cells(tr: Column) -> Column:
        inside = F.filter(select(t, "th, td"), lambda n: (n["at"] > tr["at"]) & (n["at"] <= tr["last"]) & own(n, "table", tr, tables))
        return F.transform(inside, lambda n: text(t, n))

    return F.transform(trs, cells)


def tables(t: Column, css: str = "table", deep: bool = True) -> Column:
    """Rows of cell texts of each table that matches, in page order; tables within tables are tables of their own too."""
    return F.coalesce(F.transform(select(t, css), lambda n: rows(t, n, deep)), F.array().cast("array<array<array<string>>>"))


def labelled(t: Column, item: str, label: str, value: str) -> Column:
    """Array of maps, one for each item: lower-cased texts of its labels to texts of its values, in pairs; the last of equal labels counts."""

    def inside(found: Column, n: Column, read) -> Column:
        return F.transform(F.filter(found, lambda x: (x["at"] > n["at"]) & (x["at"] <= n["last"])), read)

    def last_of_each(pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
        return let(keys, lambda ks: F.map_from_arrays(ks, F.transform(ks, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])))

    def maps(labels: Column, values: Column) -> Column:
        def one(n: Column) -> Column:
            both = F.arrays_zip(inside(labels, n, lambda x: F.lower(text(t, x))).alias("k"), inside(values, n, lambda x: text(t, x)).alias("v"))
            return let(F.filter(both, lambda p: p["k"].isNotNull() & p["v"].isNotNull()), last_of_each)

        return F.transform(select(t, item), one)

    return let(select(t, label), lambda labels: let(select(t, value), lambda values: maps(labels, values)))
