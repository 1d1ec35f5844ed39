"""Visible text of HTML as Spark columns: pieces by one regular expression, visibility by one fold over them.

A page becomes an array of pieces (text, tags, comments and raw script or style blocks), cut into blocks of some hundred.
The fold carries the open elements, equal neighbours as one entry with a count, and what the visible pieces leave in the text: single
strings inside a block, one joined string for each block before it.  So a page costs its pieces times the length of a
block, plus the square of its number of blocks.  Malformed pages follow the usual reading: an end tag closes
everything above the nearest open element of its name, one without such an element does nothing.

Character references follow the HTML5 rules: names by the standard table, its legacy names also without a semicolon and as the
beginning of a longer word; numbers by code point, 128 to 159 by the Windows table, impossible ones as U+FFFD.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.columns import clean_lines

# --- fixed values: element classes -------------------------------------------------
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
LINE_ELEMENTS = ["p", "div", "br", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "li", "table"]
CELL_ELEMENTS = ["td", "th"]
HIDDEN_ELEMENTS = ["head", "script", "style", "noscript", "template", "ix:header", "ix:hidden"]
HIDDEN_STYLES = r"(^|;)\s*(display\s*:\s*none|visibility\s*:\s*(hidden|collapse))\s*(!\s*important\s*)?(;|$)"

_RAW = r"<(script|style)\b[^>]*>[\s\S]*?(?:</\1\s*>|\z)"
_NOTE = r"<!--[\s\S]*?(?:-->|\z)|<[!?][^>]*>?"
_TAG = r"""</?[A-Za-z][^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>"""
PIECE = f"(?i){_RAW}|{_NOTE}|{_TAG}|[^<]+|<"
TEXT, OPEN, CLOSE, SINGLE, SILENT = 0, 1, 2, 3, 4


BLOCK = 256

_LEGACY = sorted((name for name in html5 if not name.endswith(";")), key=len, reverse=True)
# what the bytes 128 to 159 are in the Windows code page; five of them are free and stay control characters
_WINDOWS = [bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)]


def _names() -> Column:
    """The table of names ending in a semicolon, in two levels, as a map is searched entry by entry."""
    table: dict[str, dict[str, str]] = {}
    for name, value in html5.items():
        if name.endswith(";"):
            table.setdefault(name[:2], {})[name] = value
    return F.from_json(F.lit(json.dumps(table)), "map<string,map<string,string>>")


def _numbered(code: Column) -> Column:
    """The text of a numeric reference."""
    none = code.between(0x1, 0x8) | (code == 0xB) | code.between(0xE, 0x1F) | (code == 0x7F) | code.between(0xFDD0, 0xFDEF) | ((code % 0x10000) >= 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    windows = F.array(*[F.lit(c) for c in _WINDOWS])
    return (
        F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd")
        .when(code.between(128, 159), F.try_element_at(windows, (code - 127).cast("int")))
        .when(none, "")
        .otherwise(char)
    )


def unescaped(text: Column) -> Column:
    """Character references replaced."""
    names = _names()
    legacy = F.from_json(F.lit(json.dumps({n: html5[n] for n in _LEGACY})), "map<string,string>")

    def solved(part: Column) -> Column:
        number = F.regexp_extract(part, "^&#([0-9]+|[xX][0-9A-Fa-f]+);?", 0)
        digits = F.regexp_extract(number, "^&#0*([0-9]*);?$", 1)
        hexed = F.regexp_extract(number, "^&#[xX]0*([0-9A-Fa-f]*);?$", 1)
        code = F.when(F.lower(F.substr(number, F.lit(3), F.lit(1))) == "x", F.conv(F.concat(F.lit("0"), F.left(hexed, F.lit(8))), 16, 10)).otherwise(F.concat(F.lit("0"), F.left(digits, F.lit(9))))
        name = F.regexp_extract(part, "^&([A-Za-z][A-Za-z0-9]{0,31};)", 1)
        named = F.try_element_at(F.try_element_at(names, F.left(name, F.lit(2))), name)
        short = F.regexp_extract(part, f"^&({'|'.join(_LEGACY)})", 1)
        rest = lambda size: F.substr(part, size + 1)
        return (
            F.when(number != "", F.concat(_numbered(code.cast("long")), rest(F.length(number))))
            .when(named.isNotNull(), F.concat(named, rest(F.length(name) + 1)))
            .when(short != "", F.concat(F.try_element_at(legacy, short), rest(F.length(short) + 1)))
            .otherwise(part)
        )

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "(?=&)"), solved), "")).otherwise(text)


def _piece(p: Column) -> Column:
    """(kind, tag, hides, gap) of one piece; ``gap`` is what a shown tag leaves in the text."""
    tag = F.lower(F.regexp_extract(p, r"^</?([A-Za-z][^\s/>]*)", 1))
    silent = F.rlike(p, F.lit(r"(?i)^<([!?]|(script|style)\b)"))
    bare = F.regexp_replace(p, r"""("[^"]*"|'[^']*')""", '""')
    style = F.regexp_extract(p, r"""(?i)[\s"']style\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    style = F.regexp_replace(F.regexp_replace(style, r"""^["']|["']$""", ""), r"/\*[\s\S]*?\*/", "")
    hides = tag.isin(HIDDEN_ELEMENTS) | F.rlike(bare, F.lit(r"""(?i)[\s"]hidden(?=[\s=/>])""")) | F.rlike(style, F.lit("(?i)" + HIDDEN_STYLES))
    kind = (
        F.when(silent, SILENT).when(tag == "", TEXT).when(F.startswith(p, F.lit("</")), CLOSE).when(tag.isin(VOID) | F.endswith(p, F.lit("/>")), SINGLE).otherwise(OPEN)
    )
    gap = F.when(tag.isin(LINE_ELEMENTS), "\n").when(tag.isin(CELL_ELEMENTS), " ").otherwise("")
    return F.struct(kind.alias("kind"), tag.alias("tag"), hides.alias("hides"), F.when(kind == TEXT, unescaped(p)).when(kind != SILENT, gap).otherwise("").alias("shown"))


def _step(s: Column, p: Column) -> Column:
    """One piece more: the open elements after it and what it leaves."""
    last = F.try_element_at(s["open"], F.lit(-1))
    inner = F.coalesce(last["hid"], F.lit(False))
    hid = inner | p["hides"]
    entry = lambda tag, hides, n: F.array(F.struct(tag.alias("tag"), hides.alias("hid"), n.alias("n")))
    head = lambda size: F.slice(s["open"], F.lit(1), F.greatest(size, F.lit(0)))
    again = F.coalesce((last["tag"] == p["tag"]) & (last["hid"] == hid), F.lit(False))
    opened = F.when(again, F.concat(head(F.size(s["open"]) - 1), entry(p["tag"], hid, last["n"] + 1))).otherwise(F.concat(s["open"], entry(p["tag"], hid, F.lit(1))))
    back = F.array_position(F.transform(F.reverse(s["open"]), lambda e: e["tag"]), p["tag"]).cast("int")
    at = F.when(back > 0, F.size(s["open"]) - back + 1)  # the entry that an end tag closes
    met = F.try_element_at(s["open"], at)
    shut = F.when(met["n"] > 1, F.concat(head(at - 1), entry(met["tag"], met["hid"], met["n"] - 1))).otherwise(head(at - 1))
    after = F.when(p["kind"] == OPEN, opened).when((p["kind"] == CLOSE) & at.isNotNull(), shut).otherwise(s["open"])
    hidden = F.when(p["kind"] == CLOSE, F.coalesce(met["hid"], F.lit(True))).when(p["kind"] == TEXT, inner).otherwise(hid)
    kept = F.when((p["shown"] != "") & ~hidden, F.concat(s["kept"], F.array(p["shown"]))).otherwise(s["kept"])
    return F.struct(after.alias("open"), s["done"].alias("done"), kept.alias("kept"))


def _shown(pieces: Column) -> Column:
    """What the visible pieces leave, in order."""
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<struct<tag:string,hid:boolean,n:int>>").alias("open"), none.alias("done"), none.alias("kept"))

    def block(s: Column, pieces: Column) -> Column:
        done = lambda x: F.struct(x["open"].alias("open"), F.concat(x["done"], F.array(F.array_join(x["kept"], ""))).alias("done"), none.alias("kept"))
        return F.aggregate(pieces, s, _step, done)

    def whole(pieces: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int")), lambda i: F.slice(pieces, i * BLOCK + 1, F.lit(BLOCK)))
        return F.aggregate(blocks, start, block, lambda s: F.array_join(s["done"], ""))

    # through a lambda, so that the pieces are made once and not for every block
    return F.element_at(F.transform(F.array(pieces), whole), 1)


def with_visible_text(pages: DataFrame, html: str, text: str) -> DataFrame:
    """Adds ``text``; a value without markup or character references is kept as it is, null stays null."""
    marked = F.col(html).rlike(r"<|&[A-Za-z#]")
    pieces = F.transform(F.regexp_extract_all(html, F.lit(PIECE), F.lit(0)), _piece)
    return pages.withColumn(text, F.when(marked, clean_lines(_shown(pieces))).otherwise(F.col(html)))
