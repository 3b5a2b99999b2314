"""HTML pages as events and as text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .entities import decode_entities, named

#: All that is no text, in one pattern: what is left out (comments, declarations, scripts and styles with their bodies),
#: tags, and a < that opens nothing. What isn't closed goes on to the end.
_MARK = re.compile(
    r"""<!--.*?(?:-->|\Z) | <[!?].*?(?:>|\Z) | <(?P<raw>script|style)(?![a-z0-9])[^>]*>.*?(?:</(?P=raw)[^>]*>|\Z)
      | <(?P<close>/?)(?P<name>[a-z][a-z0-9]*)(?P<rest>[^>]*)> | (?P<bare><)""",
    re.S | re.X | re.I,
)
#: Longest tag; a < that is not closed within it is text.
TAG = 4096
_ATTRIBUTE = re.compile(r"""(?P<name>[^\s=/>]+)(?:\s*=\s*(?P<value>"[^"]*"|'[^']*'|[^\s>]+))?""")
_REFERENCE = re.compile(r"&(?:#(?P<ten>\d+)|#x(?P<hex>[0-9a-f]+)|(?P<name>[a-z][a-z0-9]*));?", re.I | re.A)
EVENTS = "page_id long, pos int, kind string, tag string, attrs map<string,string>, text string"


def _character(m: re.Match) -> str:
    if m["name"]:
        for name in (m["name"], m["name"].lower()):
            if name == "nbsp":
                return named(name)
            c = html.unescape(f"&{name};")
            if c != f"&{name};" and not c.endswith(";"):
                return c
        return m[0]
    code = int(m["ten"]) if m["ten"] else int(m["hex"], 16)
    if code > 0x10FFFF:
        return m[0]
    try:  # numbers of the second control block are meant as code page 1252
        return bytes([code]).decode("cp1252") if 0x80 <= code < 0xA0 else chr(code)
    except UnicodeDecodeError:
        return chr(code)


def decode(text: str) -> str:
    """All character references; numbers of 128 to 159 by code page 1252, unknown names as they stand."""
    return _REFERENCE.sub(_character, text) if "&" in text else text


def attributes(rest: str) -> dict[str, str]:
    """Attributes of a tag by their names in lower case; of a repeated name the last, and empty without a value."""
    out = {}
    for m in _ATTRIBUTE.finditer(rest):
        value = m["value"] or ""
        if len(value) > 1 and value[0] in "\"'" and value[-1] == value[0]:
            value = value[1:-1]
        out[m["name"].lower()] = decode(value)
    return out


def events(source: str) -> Iterator[tuple[str, str | None, dict | None, str | None]]:
    """(kind, tag, attributes, text) in order. Comments, declarations and the bodies of script and style are left out; a bare < is text."""
    text = lambda a, b: [("text", None, None, decode(source[a:b]))] if a < b else []
    done = at = 0
    while m := _MARK.search(source, at):
        yield from text(done, m.start())
        done = at = m.end()
        if m["bare"] or (m["name"] and len(m[0]) > TAG):
            yield "text", None, None, "<"
            done = at = m.start() + 1
        elif m["name"] and m["close"]:
            yield "end", m["name"].lower(), None, None
        elif m["name"]:
            tag = m["name"].lower()
            yield "start", tag, attributes(m["rest"]), None
            if m["rest"].rstrip().endswith("/"):
                yield "end", tag, None, None
    yield from text(done, len(source))


def html_events(pages: DataFrame, ident: str = "page_id", source: str = "html") -> DataFrame:
    """A row for each event of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, pos, *e) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for pos, e in enumerate(events(text or ""))]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string())
            cols[4] = [list(a.items()) if a is not None else None for a in cols[4]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "pos", "kind", "tag", "attrs", "text"])

    return pages.select(ident, source).mapInArrow(run, EVENTS)


def without_hidden(t: Column) -> Column:
    """Comments, declarations, scripts and styles taken out."""
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<script\b[^>]*>.*?</script[^>]*>", r"(?is)<style\b[^>]*>.*?</style[^>]*>", r"<[!?][^>]*>"):
        t = F.regexp_replace(t, pattern, "")
    return t


def visible_text(t: Column) -> Column:
    """Text of a page: tags become spaces, references characters, runs of white characters one space."""
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(without_hidden(t), "<[^>]+>", " ")), "[ \t\n\r\f\x0b]+", " "))
