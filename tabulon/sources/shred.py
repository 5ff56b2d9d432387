"""HTML documents as a relation of nodes, the only step that isn't relational.

A document's nodes are numbered in document order; an element's descendants are those with
``pos`` up to its ``end_pos``. Elements carry what later steps would otherwise have to walk the
tree for: the nearest table, row and reporting context above them, and how many inline tags
they hold. Text that is shown comes as its own rows, with rows where blocks begin and end, so
that rendered text is a running sum and a grouped concatenation.

kinds: ``element``; ``text`` (shown text); ``space`` (a cell begins); ``break`` (a block begins
or ends, its ``tag`` is what stands before the block that it ends).
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tabulon import schemas as S

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
BLOCKS = frozenset("p div li ul ol tr table section article header footer blockquote br hr".split()) | HEADINGS
#: Elements before which an open paragraph ends.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hr main menu nav ol p pre section table ul li dd dt".split()) | HEADINGS
#: Elements that a stray end tag of another kind doesn't close.
SPECIAL = ENDS_P | frozenset("body html td th tr tbody thead tfoot caption button select object applet marquee template".split())
SCOPE = frozenset("html table td th caption object applet marquee template".split())
#: Subtrees that aren't shown.
UNSEEN = frozenset(("ix:header", "ix:hidden", "script", "style"))
SECTIONS = ("tbody", "thead", "tfoot")
KINDS = frozenset(("element", "text", "space", "break"))
#: Tags that count only within a table.
TABLE_PARTS = frozenset(("caption", "col", "colgroup", "td", "th", "tr", *SECTIONS))
_SPACES = re.compile(r"\s+")
#: Text and the plain tag after it, as most tags are written: what isn't read so HTMLParser reads.
_NEXT = re.compile(r"""([^<]*)<(?:/([a-zA-Z][-.\w:]*)>|([a-zA-Z][-.\w:]*)((?: [a-zA-Z_:][-.\w:]*="[^"&]*")*) ?/?>)""", re.ASCII)
_ATTRIBUTE = re.compile(r' ([^=]+)="([^"]*)"')
_UNPARSED = re.compile(r"([^<]*)</(script|style)>", re.ASCII | re.IGNORECASE)
#: Elements whose contents HTMLParser may not read as tags.
_OWN_RULES = frozenset("script style title textarea iframe noembed noframes noscript xmp plaintext".split())
#: A link within the document may be there, however it is written.
_LINK = re.compile(r"""href[\s/]*=+\s*['"]?[#&]""", re.IGNORECASE)
_PIECE = 1 << 20
#: How many rows, or characters of inner text, are handed on at once, about.
ROWS, CHARACTERS = 20_000, 1 << 24


def is_bold_style(style: str) -> bool:
    s = style.lower().replace(" ", "")
    return "font-weight:bold" in s or "font-weight:700" in s


def _attributes(text: str) -> dict[str, str]:
    """Of attributes with one name the first counts."""
    out: dict[str, str] = {}
    for k, v in _ATTRIBUTE.findall(text):
        out.setdefault(k.lower(), v)
    return out


class _Open:
    """An element that is still open, and the nearest table, row, reporting context and table
    part at or above it."""

    __slots__ = ("at", "bold", "context", "n_figures", "n_ix", "notes", "part", "row", "shown_at", "table", "tag", "text_at", "tr", "unseen", "wanted")

    def __init__(self):
        self.at = self.table = self.tr = self.context = self.part = self.tag = None
        self.unseen = False


_ROOT = _Open()
_PARTS = frozenset(("table", "tr", "td", "th", *SECTIONS))
#: Elements whose inner text later steps read; targets of links within the document as well.
_WITH_TEXT = HEADINGS | frozenset("td th tr a b strong sup title".split())


class Shredder(HTMLParser):
    """Builds a document's rows. Tags close as HTML5 parsers close them: void elements have no
    end, paragraphs, items, cells and rows end where the next begins, tables get a body, and an
    unknown tag written as if it closed itself stays open.

    ``rows`` has what is complete and wasn't taken away yet: an element comes when it closes. Text
    is held only while an element is open whose text is wanted, so of a long document no more is
    held than its open elements and that text. ``targets`` are the ids that its links name.
    """

    def __init__(self, targets: frozenset[str] | set[str] = frozenset(), kinds: frozenset[str] = KINDS):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.stack: list[_Open] = []
        self.text: list[str] = []  # text in wanted elements that are open
        self.shown: list[str] = []  # the same without superscripts
        self.n_ix = self.n_figures = self.at = self.n_wanted = self.n_cells = self.n_p = self.size = 0
        self.targets = targets
        self.marks, self.elements = kinds - {"element"}, "element" in kinds

    # rows: kind, tag, attrs, parent_pos, end_pos, depth, table, row, context, hidden, bold, n_ix, n_figures, text, shown, notes, pos

    def parse(self, doc: str) -> Iterator[None]:
        """Reads a whole document. Stops now and then, so that ``rows`` may be taken."""
        i, size, match = 0, len(doc), _NEXT.match
        self.rawdata = doc
        while i < size:
            if m := match(doc, i):
                text, end, tag, attrs = m.groups()
                if text:
                    self.handle_data(unescape(text) if "&" in text else text)
                if end:
                    self.handle_endtag(end.lower())
                elif (tag := tag.lower()) not in _OWN_RULES:
                    self._start(tag, _attributes(attrs) if attrs else {})
                else:
                    i, plain = self._odd(doc, m.start(3) - 1)
                    if not plain:
                        yield from self._rest(doc[i:])
                        return
                    continue
                i = m.end()
            else:
                j = doc.find("<", i)
                if j != i:
                    self.handle_data(unescape(doc[i : j if j >= 0 else size]))
                if j < 0:
                    break
                i, plain = self._odd(doc, j)
                if not plain:
                    yield from self._rest(doc[i:])
                    return
            if len(self.rows) >= ROWS or self.size >= CHARACTERS:
                yield
        self.rawdata = ""
        while self.stack:
            self._close()
        yield

    def _odd(self, doc: str, i: int) -> tuple[int, bool]:
        """Reads what begins at i by HTMLParser's rules. Where it ends, and whether reading can go
        on there: not if it has no end, or is text that isn't HTML and holds what looks like it."""
        second = doc[i + 1 : i + 2]
        if "a" <= second.lower() <= "z":
            k = self.parse_starttag(i)
        elif second == "/":
            k = self.parse_endtag(i)
        elif doc.startswith("<!--", i):
            k = self.parse_comment(i)
        elif second == "?":
            k = self.parse_pi(i)
        elif second == "!":
            k = self.parse_html_declaration(i)
        elif second:
            self.handle_data("<")
            k = i + 1
        else:
            k = -1
        if k < 0:
            return i, False
        if (tag := self.cdata_elem) is None:
            return k, True
        m = _UNPARSED.match(doc, k)
        if m is None or m[2].lower() != tag:
            return k, False
        self.clear_cdata_mode()
        if m[1]:
            self.handle_data(m[1])
        self.handle_endtag(tag)
        return m.end(), True

    def _rest(self, rest: str) -> Iterator[None]:
        """The rest of a document by HTMLParser alone, in pieces that end before a tag."""
        self.rawdata = ""
        i = 0
        while i < len(rest):
            j = rest.find("<", i + _PIECE)
            j = j if j >= 0 else len(rest)
            self.feed(rest[i:j])
            i = j
            yield
        self.close()
        while self.stack:
            self._close()
        yield

    def _mark(self, kind: str, tag: str | None = None, text: str | None = None) -> None:
        if kind in self.marks:
            self.rows.append([kind, tag, None, None, self.at, None, None, None, None, False, None, None, None, text, None, None, self.at])
        self.at += 1

    def _open(self, tag: str, attrs: dict) -> None:
        stack = self.stack
        top = stack[-1] if stack else _ROOT
        seen = not top.unseen and tag not in UNSEEN
        if seen and tag in BLOCKS:
            self._mark("break", "")
        styled = "style" in attrs and is_bold_style(attrs["style"])
        bold = styled or tag == "b" or tag == "strong"
        at = self.at
        row = ["element", tag, attrs, top.at, at, len(stack), top.table, top.tr, top.context, not seen, bold, 0, 0, None, None, None, at]
        self.at = at + 1
        cell = tag == "td" or tag == "th"
        if cell and seen:
            self._mark("space")
        if tag.startswith("ix:"):
            self.n_ix += 1
            self.n_figures += tag == "ix:nonfraction"
        if tag in VOID:
            if self.elements:
                self.rows.append(row)
            self._left(tag, seen)
            return
        o = _Open.__new__(_Open)
        o.tag, o.at, o.row, o.bold, o.notes, o.unseen = tag, at, row, styled, [], not seen
        o.table = at if tag == "table" else top.table
        o.tr = at if tag == "tr" else top.tr
        o.context = at if tag == "xbrli:context" else top.context
        o.part = tag if tag in _PARTS else top.part
        o.text_at, o.shown_at = len(self.text), len(self.shown)
        o.n_ix, o.n_figures = self.n_ix, self.n_figures
        o.wanted = tag in _WITH_TEXT or bold or tag.startswith(("ix:non", "xbrl")) or bool(self.targets) and (attrs.get("id") in self.targets or attrs.get("name") in self.targets)
        self.n_wanted += o.wanted
        self.n_cells += cell
        self.n_p += tag == "p"
        stack.append(o)

    def _left(self, tag: str, seen: bool) -> None:
        if seen and tag in BLOCKS:
            self._mark("break", "- " if tag == "li" else "")

    def _close(self) -> None:
        o = self.stack.pop()
        tag, row = o.tag, o.row
        row[4] = self.at - 1
        row[11], row[12] = self.n_ix - o.n_ix, self.n_figures - o.n_figures
        if o.wanted:
            row[13] = text = "".join(self.text[o.text_at :])
            self.size += len(text)
            if tag == "td" or tag == "th":
                self.n_cells -= 1
                row[10], row[14] = o.bold, "".join(self.shown[o.shown_at :])
                row[15] = o.notes
                self.size += len(row[14])
            elif tag == "sup":
                del self.shown[o.shown_at :]
                o.notes.append(text)
            elif (tag == "b" or tag == "strong") and text.strip():
                o.bold = True
            self.n_wanted -= 1
            if not self.n_wanted:
                self.text, self.shown = [], []
        self.n_p -= tag == "p"
        if self.n_cells:  # a cell's marks include those of what it holds
            up = self.stack[-1]
            up.bold |= o.bold
            if o.notes:
                up.notes.extend(o.notes)
        if self.elements:
            self.rows.append(row)
        self._left(tag, not row[9])

    def _pop_to(self, *tags: str) -> None:
        while self.stack:
            tag = self.stack[-1].tag
            self._close()
            if tag in tags:
                return

    def _in_scope(self, tag: str, *more: str) -> bool:
        for o in reversed(self.stack):
            if o.tag == tag:
                return True
            if o.tag in SCOPE or o.tag in more:
                return False
        return False

    def _table_tag(self) -> str | None:
        """The tag of the part of a table that is open: table, its sections, tr, td or th."""
        return self.stack[-1].part if self.stack else None

    def _back_to(self, *tags: str) -> None:
        while self.stack and self.stack[-1].tag not in tags:
            self._close()

    def taken(self) -> list[list]:
        """What is complete, which is the caller's from now on."""
        rows, self.rows, self.size = self.rows, [], 0
        return rows

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a: dict[str, str] = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        self._start(tag, a)

    def _start(self, tag: str, attrs: dict) -> None:
        part = self._table_tag()
        if tag in TABLE_PARTS:
            if part is None:
                return  # outside a table its parts' tags don't count
            if tag in SECTIONS:
                self._back_to("table")
            elif tag == "tr":
                self._back_to("table", *SECTIONS)
                if self.stack[-1].tag == "table":
                    self._open("tbody", {})
            elif tag in ("td", "th"):
                if part in ("td", "th"):
                    self._pop_to("td", "th")
                if self._table_tag() == "table":
                    self._back_to("table")
                    self._open("tbody", {})
                if self._table_tag() in SECTIONS:
                    self._back_to(*SECTIONS)
                    self._open("tr", {})
                self._back_to("tr")
        elif tag == "li":
            self._end_item("li", ("ul", "ol"))
        elif tag in ("dd", "dt"):
            self._end_item(("dd", "dt"), ("dl",))
        elif tag == "option" and self.stack and self.stack[-1].tag == "option":
            self._close()
        elif tag in HEADINGS and self.stack and self.stack[-1].tag in HEADINGS:
            self._close()
        elif tag == "a" and self._in_scope("a"):
            self._pop_to("a")
        if self.n_p and tag in ENDS_P and self._in_scope("p", "button"):
            self._pop_to("p")
        self._open(tag, attrs)

    def _end_item(self, tags, stop: tuple) -> None:
        for o in reversed(self.stack):
            if o.tag in tags if isinstance(tags, tuple) else o.tag == tags:
                self._pop_to(o.tag)
                return
            if o.tag in stop or o.tag in SPECIAL and o.tag not in ("address", "div", "p"):
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in HEADINGS:
            if any(self._in_scope(h) for h in HEADINGS):
                self._pop_to(*HEADINGS)
            return
        if tag == "p" and not self._in_scope("p", "button"):
            self._open("p", {})
            self._close()
            return
        if tag == "br":
            self._open("br", {})
            return
        if tag in VOID or tag in ("html", "body"):
            return
        if tag in ("table", "tr", "td", "th", *SECTIONS):
            for o in reversed(self.stack):
                if o.tag == tag:
                    self._pop_to(tag)
                    return
                if o.tag == "table":
                    return
            return
        if tag in SPECIAL:
            if self._in_scope(tag):
                self._pop_to(tag)
            return
        for o in reversed(self.stack):
            if o.tag == tag:
                self._pop_to(tag)
                return
            if o.tag in SPECIAL:
                return

    def handle_data(self, data: str) -> None:
        if self.n_wanted:
            self.text.append(data)
            self.shown.append(data)
        if not (self.stack and self.stack[-1].unseen):
            self._mark("text", None, data)


class _Links(HTMLParser):
    """Ids that a document's links name."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.targets: set[str] = set()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a" and (href := next((v for k, v in attrs if k == "href"), None)) and href.startswith("#"):
            self.targets.add(href[1:])


def _targets(doc: str) -> set[str] | frozenset[str]:
    if not _LINK.search(doc):
        return frozenset()
    links = _Links()
    links.feed(doc)
    links.close()
    return links.targets


def _shredder(content: bytes | str, kinds: frozenset[str] = KINDS) -> tuple[Shredder, Iterator[None]]:
    """A document's rows to come. Bytes are UTF-8; what isn't becomes replacement characters."""
    doc = content.decode("utf-8", "replace") if isinstance(content, bytes) else content
    parser = Shredder(_targets(doc), kinds)
    return parser, parser.parse(doc)


def shred_document(content: bytes | str) -> list[list]:
    """The rows of one document in document order."""
    parser, steps = _shredder(content)
    for _ in steps:
        pass
    return sorted(parser.rows, key=lambda r: r[-1])


def _maps(values: tuple, kind: pa.MapType) -> pa.Array:
    """Dictionaries as an Arrow map; null where there is none."""
    offsets, keys, items, n = [], [], [], 0
    for a in values:
        offsets.append(None if a is None else n)
        if a:
            keys.extend(a)
            items.extend(a.values())
            n = len(keys)
    return pa.MapArray.from_arrays(pa.array([*offsets, n], pa.int32()), pa.array(keys, pa.string()), pa.array(items, pa.string()), kind)


def shred(raw: DataFrame, key: str = "accession", content: str = "content", kinds: Iterable[str] = KINDS, rows_at_once: int = ROWS) -> DataFrame:
    """The nodes of every document of ``raw``; its key column becomes ``accession``. Of other
    kinds than ``kinds`` there are no rows, and places are the same.

    Documents are dealt to all tasks first, as one small file may hold a great many. Rows leave in
    batches of about ``rows_at_once``, those of many short documents together, those of a long one
    as its elements close, so they aren't in order. Null and empty documents have no nodes; rows
    with one key give the nodes of each.
    """
    schema = StructType.fromDDL(S.NODES)
    arrow = to_arrow_schema(schema)
    kinds = frozenset(kinds)

    def batch(names: list[tuple[str | None, int]], rows: list[list]) -> pa.RecordBatch:
        kind, tag, attrs, parent, end, depth, tab, row, ctx, hidden, bold, n_ix, n_fig, text, shown, notes, pos = zip(*rows, strict=True)
        accession = [name for name, n in names for _ in range(n)]
        values = [accession, pos, kind, tag, attrs, parent, end, depth, tab, row, ctx, hidden, bold, n_ix, n_fig, text, shown, notes]
        return pa.RecordBatch.from_arrays([_maps(v, f.type) if v is attrs else pa.array(v, f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[tuple[str | None, int]] = []
        rows: list[list] = []
        size = 0
        gc.disable()  # rows hold no cycles, and there are a great many
        try:
            for got in batches:
                for name, data in zip(got.column(0), got.column(1), strict=True):
                    if not (doc := data.as_py()):
                        continue
                    name = name.as_py()
                    parser, steps = _shredder(doc, kinds)
                    del doc
                    for _ in steps:
                        size += parser.size
                        part = parser.taken()
                        names.append((name, len(part)))
                        rows += part
                        if len(rows) >= rows_at_once or size >= CHARACTERS:
                            yield batch(names, rows)
                            names, rows, size = [], [], 0
            if rows:
                yield batch(names, rows)
        finally:
            gc.enable()

    spark = raw.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(32, 3 * spark.sparkContext.defaultParallelism))
    return raw.select(F.col(key).cast("string").alias("accession"), content).repartition(n).mapInArrow(run, schema)


def element_text(content: bytes | str) -> str:
    """Rendered text of one document: the same blocks that ``sections.render_text`` makes."""
    blocks: list[str] = []
    now: list[str] = []
    for r in shred_document(content):
        if r[0] == "text":
            now.append(r[13])
        elif r[0] == "space":
            now.append(" ")
        elif r[0] == "break":
            if body := _SPACES.sub(" ", "".join(now)).strip():
                blocks.append(r[1] + body)
            now = []
    if body := _SPACES.sub(" ", "".join(now)).strip():
        blocks.append(body)
    return "\n\n".join(blocks)
