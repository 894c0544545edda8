"""Pages to node arrays: the one step that leaves the JVM, once per page, as an Arrow job.

``_NodeBatch`` is a small tree builder over a regular-expression tokenizer. It knows void
elements, implied end tags (``p``, ``li``, ``dt``/``dd``, table parts, ``option``) and raw-text
elements, and it ignores end tags that match nothing. It is not a full HTML5 tree builder. All
selection and extraction work on its output in native expressions.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shopcat.schemas import NODES

# The parser travels with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A quote counts only directly after "=": in `alt=Men's` it is part of the value.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*>"
    r"|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+)>"
    r"|<(?P<broken>[a-zA-Z][^\s/>]*+)(?P<rest>[^>]*)>"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
# Tags that read the same whatever follows: a start tag whose quotes all stand in pairs after "=" and hold no ">", or an
# end tag. The first ">" ends them.
_PLAIN = re.compile(
    r"<([a-zA-Z][^\s/>=\"']*+)(?=[\s/>])((?:[^>=\"']++|=\s*+\"[^\">]*\"|=(?!\s*[\"']))*+)>"
    r"|</([a-zA-Z][^\s/>]*+)[^>]*>")
_SHORT_TAG = 400  # characters of a tag that is looked up
_START = re.compile(r"<([a-zA-Z][^\s/>]*+)")
_STOP = re.compile("[>=]")
_QUOTED = {quote: re.compile(rf"=\s*+{quote}[^{quote}]*{quote}") for quote in "\"'"}
_OPENING = re.compile(r"=\s*+([\"'])")
_MARKUP = re.compile(r"<[a-zA-Z/!?]")
_ATTR = re.compile(r"([^\s=\"'/>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_SPACE = re.compile("[ \t\n\f\r\xa0]+")
_INVISIBLE = re.compile("[\u200b\u00ad]")
_UNEVEN = re.compile("[\t\n\f\r\xa0\u200b\u00ad]|  ")

# Element names by behaviour in the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_HEAD = frozenset("title meta link base script style noscript template".split())
_DROPPED = frozenset("script style noscript".split())
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I) for name in _RAW | _DROPPED}
_BLOCK = frozenset(
    "html head body title script style noscript meta link section nav aside hgroup header footer "
    "p h1 h2 h3 h4 h5 h6 ul ol pre div blockquote hr address figure figcaption form fieldset ins "
    "del dl dt dd li table caption thead tfoot tbody colgroup col tr th td video audio canvas "
    "details summary menu template article main svg math center dir br".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center details dir div dl fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre section table ul".split()
)
_P_SCOPE = frozenset("table td th caption button object html".split())
# tag -> (open elements its start tag ends, elements that stop the search)
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, {"html"}),
}


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTR.findall(source):
        value = double or single or bare
        found.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return found


def _tag_end(html: str, at: int, hopeless: set[int], last: dict[str, int]) -> int:
    """End of the attributes that begin at ``at``: the next ``>`` outside quotes, or -1.

    Used once a start tag of the page has none. ``hopeless`` holds every ``=`` outside quotes from which a scan
    has come to the end of the page, so no part of the page is scanned twice in vain.
    """
    seen: list[int] = []
    while stop := _STOP.search(html, at):
        k = stop.start()
        if html[k] == ">":
            return k
        if k in hopeless:
            break
        seen.append(k)
        opening = _OPENING.match(html, k)
        quoted = opening and opening.end() <= last[opening[1]] and _QUOTED[opening[1]].match(html, k)
        at = quoted.end() if quoted else k + 1
    hopeless.update(seen)
    return -1


def _visible(data: str) -> str:
    """Text with its entities read and white space collapsed."""
    if "&" in data:
        data = unescape(data)
    return _SPACE.sub(" ", _INVISIBLE.sub("", data)) if _UNEVEN.search(data) else data


class _Tag:
    """What a start tag says, and where the batch keeps it; an end tag has a name only."""

    __slots__ = ("name", "place", "foreign", "special", "closes_p", "implied", "block", "void", "headless")

    def __init__(self, name: str, place: int, source: str, sanitize: bool):
        self.name, self.place, self.foreign = name, place, source.endswith("/")
        self.special = name in _RAW or (sanitize and name in _DROPPED)
        self.closes_p, self.implied, self.block = name in _CLOSES_P, _IMPLIED.get(name), name in _BLOCK
        self.void, self.headless = name in _VOID, name not in _HEAD


class _NodeBatch:
    """Node columns of a slice of pages, in document order.

    Start tags and short texts that come again in the slice are read once. A node holds the place of its tag in a
    table of the slice's distinct tags, from which the columns are taken at the end.
    """

    def __init__(self, sanitize: bool):
        self.sanitize = sanitize
        self.node_offsets, self.texts, self.errors = [0], [], []
        self.parent, self.last, self.place = [], [], []
        self.tag, self.id, self.cls = [], [], []  # of the distinct tags
        self.attr_offsets, self.attr_keys, self.attr_values = [0], [], []
        self.own, self.start, self.end = [], [], []
        self.empty_page: list[bool] = []
        self.starts: dict[str, _Tag] = {}  # plain start tags
        self.ends: dict[str, str] = {}  # names of end tags
        self.short: dict[str, str] = {}  # visible text of short texts

    def add(self, html: str | None) -> None:
        base = len(self.place)
        self.empty_page.append(html is None)
        if html is None:
            self.texts.append(None)
            self.errors.append(None)
        else:
            text, error = self._parse(html, base)
            self.texts.append(text)
            self.errors.append(error)
        self.node_offsets.append(len(self.place))

    def _read(self, name: str, source: str) -> _Tag:
        """A start tag and its attributes, put into the table."""
        name = name.lower()
        attrs = _attributes(source) if source else {}
        self.tag.append(name)
        self.id.append(attrs.get("id", ""))
        self.cls.append(attrs.get("class", ""))
        self.attr_keys.extend(attrs)
        self.attr_values.extend(attrs.values())
        self.attr_offsets.append(len(self.attr_keys))
        return _Tag(name, len(self.tag) - 1, source, self.sanitize)

    def _parse(self, html: str, base: int) -> tuple[str, str | None]:
        stack: list[int] = []  # positions of the open elements
        tags: list[str] = []  # their names
        depths: dict[str, list[int]] = {}  # by name: the depths at which it is open
        own_space: list[bool] = []  # a space is due before more own text
        own_parts: dict[int, list[str]] = {}  # own text by position
        pieces: list[str] = []
        length, space, error = 0, False, None
        parents, lasts, places = self.parent, self.last, self.place
        starts, ends, own_texts = self.start, self.end, self.own
        known, known_ends, short = self.starts, self.ends, self.short

        def close_to(depth: int) -> None:
            last = len(parents) - base - 1
            while len(stack) > depth:
                pos = stack.pop()
                depths[tags.pop()].pop()
                own_space.pop()
                lasts[base + pos] = last
                ends[base + pos] = length

        def depth_of(names, stops) -> int:
            """Depth of the outermost open element in ``names`` above the nearest of ``stops``."""
            if not any(map(depths.get, names)):
                return -1
            floor = max((depths[s][-1] for s in stops if depths.get(s)), default=-1)
            found = []
            for name in names:
                open_at = depths.get(name, ())
                k = bisect_right(open_at, floor)
                if k < len(open_at):
                    found.append(open_at[k])
            return min(found, default=-1)

        def add_text(data: str) -> None:
            nonlocal length, space
            if len(data) <= 40:
                seen = short.get(data)
                if seen is None:
                    seen = short[data] = _visible(data)
                data = seen
            else:
                data = _visible(data)
            core = data.strip(" ")
            if stack and data:
                if core:
                    parts = own_parts.setdefault(stack[-1], [])
                    if parts and (own_space[-1] or data[0] == " "):
                        parts.append(" ")
                    parts.append(core)
                own_space[-1] = data[-1] == " " or (own_space[-1] and not core)
            if data and data[0] == " ":
                space = True
            if core:
                if space and length:
                    pieces.append(" ")
                    length += 1
                pieces.append(core)
                length += len(core)
                space = data[-1] == " "

        at, size, last_end = 0, len(html), html.rfind(">")
        hopeless: set[int] | None = None
        last_quote = {quote: html.rfind(quote) for quote in "\"'"}
        while at < size:
            if at > last_end:  # no tag ends here any more: text, up to what begins like one
                tail = _MARKUP.search(html, at)
                add_text(html[at: tail.start() if tail else size])
                if tail and not html.startswith("<!--", tail.start()):
                    error = "unterminated tag"
                break
            if html[at] != "<":
                begun, at = at, html.find("<", at)
                at = at if at >= 0 else size
                add_text(html[begun:at])
                continue
            start = name = None
            stop = html.find(">", at, at + _SHORT_TAG) + 1 if hopeless is None else 0
            token = html[at:stop] if stop else ""
            if token in known:
                start, at = known[token], stop
            elif token in known_ends:
                name, at = known_ends[token], stop
            elif m := _PLAIN.fullmatch(token):
                if m[3]:
                    name = known_ends[token] = m[3].lower()
                else:
                    start = known[token] = self._read(m[1], m[2])
                at = stop
            else:
                # After a tag without end, starts are looked at one by one.
                m = _START.match(html, at) if hopeless is not None else None
                if m:
                    end = _tag_end(html, m.end(), hopeless, last_quote)
                    stop = end if end >= 0 else html.index(">", m.end())
                    start, at = self._read(m[1], html[m.end():stop]), stop + 1
                else:
                    m = _TOKEN.match(html, at)
                    at = m.end()
                    kind = m.lastgroup
                    if kind in ("attrs", "rest"):
                        start = self._read(m["start"] or m["broken"], m[kind])
                        hopeless = set() if kind == "rest" else hopeless
                    elif kind == "text":
                        add_text(m.group())
                    elif kind == "end":
                        name = m.group("end").lower()
            if name is not None:
                if depths.get(name):
                    close_to(depths[name][-1])
                    if name in _BLOCK:
                        space = True
            elif start is not None:
                name = start.name
                inner = None
                if start.special:
                    end = _RAW_END[name].search(html, at)
                    inner, at = (html[at:end.start()], end.end()) if end else (html[at:], size)
                    if self.sanitize and name in _DROPPED:
                        continue
                if start.headless and tags and tags[-1] == "head":
                    close_to(len(tags) - 1)
                if start.closes_p and depths.get("p"):
                    depth = depth_of({"p"}, _P_SCOPE)
                    if depth >= 0:
                        close_to(depth)
                if start.implied:
                    depth = depth_of(*start.implied)
                    if depth >= 0:
                        close_to(depth)
                if start.block:
                    space = True
                if name == "br" and own_space:
                    own_space[-1] = True
                pos = len(parents) - base
                parents.append(stack[-1] if stack else -1)
                lasts.append(pos)
                places.append(start.place)
                own_texts.append("")
                starts.append(length)
                ends.append(length)
                if not start.void and not (start.foreign and (depths.get("svg") or depths.get("math"))):
                    depths.setdefault(name, []).append(len(stack))
                    stack.append(pos)
                    tags.append(name)
                    own_space.append(False)
                    if inner is not None:
                        if name in ("title", "textarea"):
                            add_text(inner)
                        close_to(len(tags) - 1)
                        space = True
        close_to(0)
        for pos, parts in own_parts.items():
            own_texts[base + pos] = "".join(parts)
        return "".join(pieces), error

    def arrays(self) -> list[pa.Array]:
        n = len(self.place)
        offsets = np.array(self.node_offsets)
        pos = pa.array(np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets)), pa.int32())
        place = pa.array(self.place, pa.int32())
        attrs = pa.MapArray.from_arrays(
            pa.array(self.attr_offsets, pa.int32()),
            pa.array(self.attr_keys, pa.string()),
            pa.array(self.attr_values, pa.string()),
        )
        fields = {
            "pos": pos,
            "parent": pa.array(self.parent, pa.int32()),
            "last": pa.array(self.last, pa.int32()),
            "tag": pa.array(self.tag, pa.string()).take(place),
            "id": pa.array(self.id, pa.string()).take(place),
            "class": pa.array(self.cls, pa.string()).take(place),
            "attrs": attrs.take(place),
            "own_text": pa.array(self.own, pa.string()),
            "text_start": pa.array(self.start, pa.int32()),
            "text_end": pa.array(self.end, pa.int32()),
        }
        assert len(pos) == n
        nodes = pa.StructArray.from_arrays(list(fields.values()), list(fields))
        offsets = pa.array(
            [None if empty else o for o, empty in zip(self.node_offsets, self.empty_page)]
            + [self.node_offsets[-1]],
            pa.int32(),
        )
        return [
            pa.ListArray.from_arrays(offsets, nodes),
            pa.array(self.texts, pa.string()),
            pa.array(self.errors, pa.string()),
        ]


def with_nodes(pages: DataFrame, sanitize: bool = True, slice_chars: int = 500_000) -> DataFrame:
    """Replace ``html`` by ``nodes``, ``page_text`` and ``parse_error``; other columns pass through.

    One row in, one row out, no shuffle. ``nodes`` is in document order; a node's text is the
    range ``text_start..text_end`` of ``page_text`` (so text is stored once, whatever the depth),
    and ``pos..last`` is its subtree. Whitespace is collapsed; block elements and ``br`` separate
    words, inline elements do not. ``sanitize`` drops script, style, noscript and comments.
    A null ``html`` gives null ``nodes``. Output batches are cut by ``slice_chars`` of html, so
    the memory of a task does not depend on the number of pages in an Arrow batch.
    """
    kept = [f for f in pages.schema.fields if f.name != "html"]
    schema = T.StructType(list(kept))
    for name, ddl in (("nodes", NODES), ("page_text", "string"), ("parse_error", "string")):
        schema = schema.add(name, T.DataType.fromDDL(ddl))
    names = [f.name for f in kept]
    out_names = [f.name for f in schema.fields]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column("html")
            begin = 0
            while begin < batch.num_rows:
                block, chars, end = _NodeBatch(sanitize), 0, begin
                while end < batch.num_rows and chars < slice_chars:
                    page = html[end].as_py()
                    block.add(page)
                    chars += len(page or "") + 1
                    end += 1
                rest = [batch.column(c).slice(begin, end - begin) for c in names]
                yield pa.RecordBatch.from_arrays(rest + block.arrays(), names=out_names)
                begin = end

    return pages.mapInArrow(parse, schema)
