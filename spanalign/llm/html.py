"""Layout-aware rendering of web pages to text.

A tolerant tree builder supplies the end tags that pages leave out, visibility rules drop what a
browser doesn't show, and the renderer writes all visible text: blocks on lines of their own with
their spacing, lists with marks and indents, tables with aligned cells, preformatted text as it is.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanalign.llm.common import table

# Element names of HTML by what they do to the tree and the layout.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe noembed noframes xmp template".split())
HIDDEN = set("head script style title noscript iframe noembed noframes template datalist object audio video canvas map area annotation annotation-xml".split())
# Parts of a drawing that hold text, and those that describe it.
DRAWN, DESCRIBED = set("text foreignobject".split()), set("title desc metadata defs symbol".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li legend main menu nav ol p pre section summary table ul tr td th thead tbody tfoot caption option optgroup select search textarea".split())
MARGIN = set("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr fieldset menu dir".split())
ENDS_P = BLOCKS - set("body html option optgroup select td th tr thead tbody tfoot caption legend textarea".split())
# new element -> (open elements that it ends, elements that shield those outside of them)
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
SCOPE = set("table td th caption html".split())

# Attributes by the states of HTML: a quote opens a value directly after '=' only; elsewhere it is part of
# a name or of an unquoted value. A quote that is never closed counts as unquoted, so that text stays.
_VALUE = r"""[ \t\n\r\f]*+=[ \t\n\r\f]*+("[^"]*+"|'[^']*+'|[^ \t\n\r\f>]*+)"""
_NAME = r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+"
_ATTRS = rf"(?:[ \t\n\r\f/]++|{_NAME}(?:{_VALUE.replace('("', '(?:"')})?+)*+"
_TOKEN = re.compile(rf"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^ \t\n\r\f/>]*+){_ATTRS}>?|<([a-zA-Z][^ \t\n\r\f/>]*+)({_ATTRS})>", re.S)
# For the rest of a page once a tag has run to its end inside of its quotes: a tag ends at its first '>'.
_PLAIN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^ \t\n\r\f/>]*+)[^>]*+>?|<([a-zA-Z][^ \t\n\r\f/>]*+)([^>]*+)(?:>|\Z)", re.S)
_START = re.compile(r"<(?=[a-zA-Z/!?])")
_ATTR = re.compile(rf"({_NAME})(?:{_VALUE})?+")
_NONE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
BREAK, KEEP = "\x00", "\x01"  # a line break and a space that stay as they are


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.children = tag, []
        # of repeated names the first counts
        self.attrs = {k.lower(): v[1:-1] if len(v) > 1 and v[0] in "\"'" and v[0] == v[-1] else v for k, v in reversed(_ATTR.findall(attrs))} if attrs else {}


def tree(page: str) -> Element:
    """The element tree; never fails, whatever the page."""
    root = Element("html")
    open_ = [root]
    places: dict[str, list[int]] = {}  # where in open_ the elements of a tag are
    at, token = 0, _TOKEN

    def opened(e: Element) -> None:
        places.setdefault(e.tag, []).append(len(open_))
        open_.append(e)

    def ended() -> None:
        places[open_.pop().tag].pop()

    def last(tags: set) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags: set, shields: set) -> None:
        k = last(tags)
        if k and k >= last(shields):
            while len(open_) > k:
                ended()

    def next_tag():
        """The next tag: one that has no end costs one look at the rest of the page, not one for each tag behind it."""
        nonlocal token
        begin = _START.search(page, at)
        while begin is not None:
            m = token.match(page, begin.start())
            if m is None and token is _TOKEN:
                token = _PLAIN
                m = token.match(page, begin.start())
            if m is not None:
                return m
            begin = _START.search(page, begin.end())
        return None

    while at < len(page):
        m = next_tag()
        if m is None:
            open_[-1].children.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            open_[-1].children.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                open_[-1].children.append(Element("br"))
            else:
                close({tag}, SCOPE - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else {"table"} - {tag})
        elif m[2]:
            tag = m[2].lower()
            if tag == "html":
                continue
            if tag in ENDS_P:
                close({"p"}, SCOPE | {"li", "dd", "dt"} if tag != "p" else SCOPE)
            if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", open_[-1].tag):
                ended()
            if tag in ENDS:
                ends, shields = ENDS[tag]
                close(ends, shields)
                if tag == "tr":
                    close({"tr"}, {"table"})
                if tag in ("thead", "tbody", "tfoot"):
                    close(ends, shields)
                if tag in ("td", "th") and open_[-1].tag in ("table", "tbody", "thead", "tfoot"):
                    row = Element("tr")
                    open_[-1].children.append(row)
                    opened(row)
            new = Element(tag, m[3])
            open_[-1].children.append(new)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
                body = page[at : end.start() if end else len(page)]
                at = end.end() if end else len(page)
                if tag == "textarea":
                    new.children.append(entities.unescape(body))
            elif tag not in VOID and not (m[3].endswith("/") and tag not in BLOCKS and tag not in ("a", "b", "i", "span", "em", "strong")):
                opened(new)
    return root


def visible(e: Element) -> bool:
    """Whether a browser that runs no style sheet would show the element."""
    if e.tag in HIDDEN or "hidden" in e.attrs or e.tag == "dialog" and "open" not in e.attrs or e.tag == "input" and e.attrs.get("type", "").lower() == "hidden":
        return False
    return not ("style" in e.attrs and _NONE.search(entities.unescape(e.attrs["style"])))


class _Lines:
    """The lines of one block container."""

    def __init__(self):
        self.lines: list[str] = []
        self.text: list[str] = []
        self.gap = False

    def flush(self) -> None:
        if self.text:
            joined = _SPACE.sub(" ", "".join(self.text))
            self.text = []
            if joined.strip(" "):
                parts = joined.split(BREAK)
                if not parts[-1].strip(" ") and len(parts) > 1:
                    parts.pop()
                self.put([p.strip(" ").replace(KEEP, " ").rstrip() for p in parts], False)

    def put(self, lines: list[str], margin: bool) -> None:
        if not lines:
            return
        if (self.gap or margin) and self.lines:
            self.lines.append("")
        self.lines += lines
        self.gap = margin


def _trimmed(lines: list[str]) -> list[str]:
    lo, hi = 0, len(lines)
    while lo < hi and not lines[lo]:
        lo += 1
    while hi > lo and not lines[hi - 1]:
        hi -= 1
    return lines[lo:hi]


def _run(step):
    """What a generator returns that yields the generators it waits for: calls without Python's stack."""
    waiting, value = [step], None
    while waiting:
        try:
            inner = waiting[-1].send(value)
        except StopIteration as done:
            waiting.pop()
            value = done.value
        else:
            waiting.append(inner)
            value = None
    return value


def _block(e: Element, pre: bool = False):
    out = _Lines()
    yield _into(e, out, pre, [0])
    out.flush()
    return _trimmed(out.lines)


def _into(e: Element, out: _Lines, pre: bool, number: list[int]):
    for c in e.children:
        if isinstance(c, str):
            c = c.replace(BREAK, "").replace(KEEP, "")
            out.text.append(c.replace("\r\n", "\n").replace("\n", BREAK).replace("\t", "    ").replace(" ", KEEP) if pre else c)
        elif c.tag == "br":
            out.text.append(BREAK)
        elif not visible(c):
            continue
        elif c.tag == "input":
            out.text.append(entities.unescape(c.attrs.get("value", "")))
        elif c.tag == "hr":
            out.flush()
            out.gap = True
        elif c.tag == "table":
            out.flush()
            out.put((yield _table(c)), True)
        elif c.tag == "svg":
            for drawn in _drawn(c):
                out.text.append(" ")
                yield _into(drawn, out, pre, number)
                out.text.append(" ")
        elif c.tag in ("ul", "ol", "menu", "dir"):
            out.flush()
            count = _counter(c) if c.tag == "ol" else [None]
            inner = _Lines()
            yield _into(c, inner, pre, count)
            inner.flush()
            out.put(_trimmed(inner.lines), e.tag != "li")
        elif c.tag == "li":
            out.flush()
            mark = "* "
            if number[0] is not None and e.tag == "ol":
                step = number[1] if len(number) > 1 else 1
                number[0] = int(c.attrs["value"]) if _NUMBER.fullmatch(c.attrs.get("value", "")) else number[0] + step
                mark = f"{number[0]}. "
            lines = yield _block(c, pre)
            out.put([(mark if k == 0 else " " * len(mark)) + x if x or k == 0 else "" for k, x in enumerate(lines)], False)
        elif c.tag in ("dd", "blockquote"):
            out.flush()
            out.put(["    " + x if x else "" for x in (yield _block(c, pre))], c.tag in MARGIN)
        elif c.tag in BLOCKS:
            # margins of a block and of its first and last child meet in the same gap
            out.flush()
            out.gap |= c.tag in MARGIN
            yield _into(c, out, pre or c.tag in ("pre", "textarea"), number)
            out.flush()
            out.gap |= c.tag in MARGIN
        else:
            yield _into(c, out, pre, number)


_NUMBER = re.compile(r"-?\d{1,9}")


def _counter(e: Element) -> list[int]:
    """The number before an ordered list's first, and the step."""
    items = sum(isinstance(c, Element) and c.tag == "li" and visible(c) for c in e.children)
    step = -1 if "reversed" in e.attrs else 1
    start = e.attrs.get("start", "")
    return [(int(start) if _NUMBER.fullmatch(start) else items if step < 0 else 1) - step, step]


def _drawn(e: Element):
    """The elements of a drawing that show text."""
    waiting = [iter(e.children)]
    while waiting:
        for c in waiting[-1]:
            if isinstance(c, str) or not visible(c) or c.tag in DESCRIBED:
                continue
            if c.tag in DRAWN:
                yield c
            else:
                waiting.append(iter(c.children))
                break
        else:
            waiting.pop()


def _rows(e: Element, outside: list):
    inside = [iter(e.children)]
    while inside:
        for c in inside[-1]:
            if isinstance(c, str):
                if c.strip():
                    outside.append(c)
            elif not visible(c):
                continue
            elif c.tag == "tr":
                yield [x for x in c.children if isinstance(x, str) and x.strip() or isinstance(x, Element) and visible(x)]
            elif c.tag in ("thead", "tbody", "tfoot"):
                inside.append(iter(c.children))
                break
            elif c.tag not in ("col", "colgroup"):
                outside.append(c)
        else:
            inside.pop()


def _table(e: Element):
    outside: list = []
    rows = list(_rows(e, outside))
    out: list[str] = []
    if outside:
        holder = Element("div")
        holder.children = outside
        out = yield _block(holder)
    grid, widths = [], {}
    taken: dict[int, int] = {}  # column -> rows that a cell from above still stands in
    for row in rows:
        cells, col = [], 0
        held = {c for c, n in taken.items() if n > 0}
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        for cell in row:
            if isinstance(cell, str) or cell.tag not in ("td", "th"):
                holder = Element("td")
                holder.children = [cell]
                cell = holder
            span = cell.attrs.get("colspan", "1")
            span = min(int(span), 1000) if re.fullmatch(r"[1-9]\d{0,3}", span) else 1
            down = cell.attrs.get("rowspan", "1")
            down = min(int(down) or len(rows), len(rows)) if re.fullmatch(r"\d{1,5}", down) else 1
            while col in held:
                col += 1
            lines = yield _block(cell)
            cells.append((col, span, lines))
            if down > 1:
                taken |= {c: max(down - 1, taken.get(c, 0)) for c in range(col, col + span)}
            if span == 1:
                widths[col] = max([widths.get(col, 0), *map(len, lines)])
            col += span
        grid.append(cells)
    begins = [0]  # where each column begins
    for c in range(max((col + span for cells in grid for col, span, _ in cells), default=0)):
        begins.append(begins[-1] + widths.get(c, 0) + 2)
    for cells in grid:
        for k in range(max((len(x) for _, _, x in cells), default=0)):
            line, at = "", 0
            for col, span, lines in cells:
                line += " " * (max(at, begins[col]) - len(line)) + (lines[k] if k < len(lines) else "")
                at = max(len(line) + 2 if line.strip() else 0, begins[col + span])
            out.append(line.rstrip())
    return out


def extract(page: str | None) -> str:
    """All visible text of a page; null and empty pages give an empty text."""
    return "\n".join(_run(_block(tree(page)))) if page else ""


def texts(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, text and n_chars of every row, repeated rows and null keys each; other columns are left
    out. No rows: no rows. A page is rendered by itself: tasks hold a page at a time."""
    src = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                made = [extract(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())], names=["key", "text", "n_chars"])

    kind = src.schema["key"].dataType.simpleString()
    return src.mapInArrow(run, f"key {kind}, text string, n_chars bigint").withColumnRenamed("key", key)


def op10_html(spark, sf_dir: str) -> DataFrame:
    return texts(table(spark, sf_dir, "pages"))
