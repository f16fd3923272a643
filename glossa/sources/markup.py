"""Verses of modules and dictionary definitions: markup read once, in order, with what a white list allows.

A reader keeps the open elements and the buffers that a note or a title opens on stacks, so nesting of any depth takes time in
proportion to the text, and plain text, display text and notes come out of one pass.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlencode

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.tables import map_slices

PIECE = re.compile(r"<!--.*?-->|<(/?)([A-Za-z][A-Za-z0-9]*)([^<>]*)>|<[^<>A-Za-z/][^<>]*>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
# Elements that stay and what they become; marks of words of Jesus and of added words; paragraphs and poetry.
KEPT = {"em": "em", "i": "i", "b": "b", "strong": "b", "sup": "sup", "sub": "sub"}
SPANS = {"tl": ("i", '<i class="tl">'), "jesus": ("span", '<span class="jesus">')}
MARKS = {"FR": '<span class="jesus">', "FI": "<i>", "Fr": "</span>", "Fi": "</i>"}
LABEL = 16
LINK = re.compile(r"b(\d+)\.(\d+)\.(\d+)(?:-(?:b\d+\.)?(\d+)(?:\.(\d+))?)?")


def module_link(href: str, names: list[str]) -> str:
    """``b19.51.12`` as ``Ps 51,12``, ranges likewise, by the ``names`` of the module's books from 1 on; empty if it is no such link."""
    m = LINK.fullmatch(href.strip())
    if not m or not 1 <= int(m[1]) <= len(names):
        return ""
    to = [str(int(x)) for x in m.groups()[3:] if x]
    return f"{names[int(m[1]) - 1]} {int(m[2])},{int(m[3])}" + ("-" + ",".join(to) if to else "")


class Part:
    """What is written of one stretch of markup: display text, plain text, and the elements still open."""

    def __init__(self, label: str = "", kind: str = "") -> None:
        self.label, self.kind, self.shown, self.said, self.open = label, kind, [], [], []

    def text(self, data: str) -> None:
        plain = html.unescape(data)
        self.shown.append(html.escape(plain, quote=False))
        self.said.append(plain)

    def close(self) -> None:
        if self.open and (name := self.open.pop()):
            self.shown.append(f"</{name}>")

    def start(self, tag: str, rest: str, names: list[str], url: str) -> None:
        held = {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(rest)}
        classes = (held.get("class") or "").split()
        name, shown = KEPT.get(tag, ""), ""
        if name:
            shown = f"<{name}>"
        elif tag == "br":
            self.shown.append("<br>")
            self.said.append(" ")
            return
        elif tag == "span" and (known := [c for c in SPANS if c in classes]):
            name, shown = SPANS[known[0]]
        elif tag == "a" and (place := module_link(held.get("href", ""), names)):
            name, shown = "a", f'<a class="ref" href="{html.escape(url + "?" + urlencode({"q": place}))}" title="{html.escape(place)}">'
        if not rest.rstrip().endswith("/"):
            self.open.append(name)
        elif shown:
            shown += f"</{name}>"
        self.shown.append(shown)

    def end(self) -> tuple[str, str]:
        while self.open:
            self.close()
        return "".join(self.shown).strip(), re.sub(r"\s+", " ", "".join(self.said)).strip()

    def back_into(self, outer: Part) -> None:
        outer.shown += self.shown
        outer.said += self.said
        outer.open += self.open


def sanitize(fragment: str | None, names: list[str] = (), url: str = "") -> tuple[str, str]:
    """``fragment`` as display text with allowed elements only, all closed, and as plain text; other elements leave their text."""
    part = Part()
    for m in PIECE.finditer(fragment or ""):
        if m[2]:
            if m[1]:
                if m[2].lower() != "br":
                    part.close()
            else:
                part.start(m[2].lower(), m[3], names, url)
        elif not m[0].startswith("<") or m[0] == "<":
            part.text(m[0])
    return part.end()


def read_verse(raw: str | None, names: list[str] = (), url: str = "") -> tuple[str, str, list[tuple[str, str, str, str]]]:
    """Plain text, display text and notes (kind, label, display text, plain text) of a verse's markup.

    Notes (kind note where their label is in brackets or missing, else xref) leave a raised label, titles go before the verse, and a new line
    of poetry is a line break unless the verse begins with it. A note or title that does not end is text.
    """
    stack, notes, titles = [Part()], [], []
    poetry = begun = False
    for m in PIECE.finditer(raw or ""):
        part, tag, closing = stack[-1], m[2] or "", m[1] == "/"
        if re.fullmatch(r"P[IF]\d", tag) and not closing and part.kind == "":
            poetry = True
            continue
        if poetry and part.kind == "" and (tag or m[0].strip()):
            if begun:
                part.start("br", "", names, url)
            poetry = False
        if tag == "RF" and not closing and part.kind != "note":
            label = (re.sub(r"^\s*q=", "", m[3]) if "q=" in m[3] else "").strip().strip("'\"")
            stack.append(Part(label, "note"))
            continue
        if tag == "Rf" and not closing:
            if part.kind == "note":
                stack.pop()
                label = part.label.strip("[]") or str(len(notes) + 1)
                kind = "note" if part.label.startswith("[") or not part.label else "xref"
                notes.append((kind, label[:LABEL], *part.end()))
                outer = stack[-1]
                outer.shown.append(f'<sup class="{"fn" if kind == "note" else "xr"}">{html.escape(label[:LABEL])}</sup>')
                begun |= outer.kind == ""
            continue
        if tag == "TS" and not closing or tag.lower() == "h" and not closing:
            stack.append(Part(tag, "title"))
            continue
        if part.kind == "title" and (tag == "Ts" and not closing and part.label == "TS" or tag.lower() == "h" and closing and part.label.lower() == "h"):
            titles.append(stack.pop().end()[1])
            continue
        if tag in ("CM", "cm") and not closing:
            part.text(" ")
        elif tag in MARKS and not closing:
            if tag in ("FR", "FI"):
                part.shown.append(MARKS[tag])
                part.open.append(MARKS[tag][1:].split()[0].rstrip(">"))
            else:
                part.close()
        elif tag:
            if closing:
                if tag.lower() != "br":
                    part.close()
            else:
                part.start(tag.lower(), m[3], names, url)
        elif not m[0].startswith("<") or m[0] == "<":
            part.text(m[0])
            begun |= part.kind == "" and bool(m[0].strip())
    while len(stack) > 1:
        stack.pop().back_into(stack[-1])
    shown, said = stack[0].end()
    heads = "".join(f'<span class="pericope">{html.escape(t)}</span>' for t in titles if t)
    return said, heads + re.sub(r"\s+", " ", shown).strip(), notes


def module_verses(rows: DataFrame, names: list[str], url: str = "") -> DataFrame:
    """book, chapter, verse, text, markup, notes of ``rows`` (book, chapter, verse, scripture); verses without text are left out."""
    keys = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("book", "chapter", "verse"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            read = [read_verse(raw, names, url) for raw in pdf["scripture"]]
            out = pdf[["book", "chapter", "verse"]].assign(text=[r[0] for r in read], markup=[r[1] for r in read])
            out["notes"] = [[dict(zip(("kind", "label", "markup", "text"), n, strict=True)) for n in r[2]] for r in read]
            yield out[out["text"] != ""]

    return map_slices(rows.select("book", "chapter", "verse", "scripture"), scan, f"{keys}, text string, markup string, notes array<struct<kind:string,label:string,markup:string,text:string>>")


def read_definition(raw: str | None) -> str:
    """A definition with line breaks, bold and italic letters, and references as ``[[target|label]]``; all else is its text."""
    out, link = [], None
    for m in PIECE.finditer(raw or ""):
        tag, rest = (m[2] or "").lower(), m[3] or ""
        if tag == "br":
            out.append("\n")
        elif tag == "ref" and not m[1] and link is None and (target := re.match(r"\s*=\s*'([^']*)'\s*$", rest)):
            link = (len(out), target[1].strip())
        elif tag == "ref" and m[1] and link:
            label = "".join(x for x in out[link[0] :] if not re.fullmatch(r"</?[bi]>", x)).strip()
            out[link[0] :] = [f"[[{link[1]}|{label}]]"]
            link = None
        elif tag in ("b", "i") and not rest.strip(" /"):
            out.append(f"<{m[1]}{tag}>")
        elif m[0].startswith("<") and m[0] != "<":
            out.append("" if link else " ")
        else:
            out.append(html.unescape(m[0]))
    text = re.sub(r"[ \t\r\f\v]+", " ", "".join(out).replace("__", ""))
    return re.sub(r"\n{2,}", "\n", re.sub(r" *\n *", "\n", text)).strip(" ;:\n")


def read_meaning(raw: str | None, limit: int | None = 600) -> str:
    """A definition in one line, breaks as ``;``, without elements, up to ``limit`` characters."""
    out = ["; " if (m[2] or "").lower() == "br" else " " if m[0].startswith("<") and m[0] != "<" else m[0] for m in PIECE.finditer(raw or "")]
    return re.sub(r"\s+", " ", html.unescape("".join(out))).strip(" ;")[:limit]


def _over(text: Column, read) -> Column:
    @F.pandas_udf("string")
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else read(t))

    return each(text)


def sanitized(text: Column) -> Column:
    return _over(text, lambda t: sanitize(t)[0])


def plain(text: Column) -> Column:
    return _over(text, lambda t: sanitize(t)[1])


def definition(text: Column) -> Column:
    return _over(text, read_definition)


def meaning(text: Column) -> Column:
    return _over(text, read_meaning)
