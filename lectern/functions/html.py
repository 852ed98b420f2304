"""HTML as a tree of elements, and its sanitised form: one pass with a stack of what is open.

An end tag closes the nearest open element of its name, and what is open inside it; one that fits nothing is ignored; elements
without content never open; what is still open at the end closes there. Scripts and styles hold text only. Comments and
declarations are no elements. What is removed is cut out of the source, so what stays keeps its spelling.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ELEMENT = "node int, parent int, depth int, tag string, start int, stop int, closed boolean"
#: A comment, declaration or tag. Attributes are runs without quotes or angle brackets, or quoted.
MARKUP = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*>?|</([A-Za-z][^\s/>]*)[^>]*>|<([A-Za-z][^\s/<>"']*)((?:[^<>"']++|"[^"]*"|'[^']*')*+)>""", re.S)
ATTRIBUTE = re.compile(r"""\s+([^\s=/<>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+))?""")
#: Elements without content, elements of text, and what is removed: elements, attributes, targets of links.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style"}
DANGEROUS = {"script", "object", "embed", "applet", "form", "input", "button"}
PARANOID = {"iframe", "frame", "frameset", "meta"}
HANDLERS = {"onclick", "onload", "onerror", "onmouseover", "onfocus", "onblur"}
EXTERNAL = ("http://", "https://", "ftp://")


def elements(html: str) -> tuple[list[list], list[tuple[str, int, str]]]:
    """Rows of ELEMENT in document order, and (tag, place of the attributes, attributes) of each of them."""
    rows, heads, stack, waiting = [], [], [], Counter()
    at = 0

    def pop(stop: int, closed: bool) -> None:
        row = rows[stack.pop()]
        waiting[row[3]] -= 1
        row[5], row[6] = stop, closed

    while m := MARKUP.search(html, at):
        at = m.end()
        if m.group(1):
            tag = m.group(1).lower()
            if waiting[tag]:
                while rows[stack[-1]][3] != tag:
                    pop(m.start(), False)
                pop(at, True)
        elif m.group(2):
            tag = m.group(2).lower()
            rows.append([len(rows), stack[-1] if stack else -1, len(stack), tag, m.start(), at, True])
            heads.append((tag, m.start(3), m.group(3)))
            if tag in VOID or m.group(3).endswith("/"):
                continue
            stack.append(len(rows) - 1)
            waiting[tag] += 1
            if tag in RAW:
                end = re.compile(rf"</{tag}\b", re.I).search(html, at)
                at = end.start() if end else len(html)
    while stack:
        pop(len(html), False)
    return rows, heads


def sanitised(html: str, paranoid: bool = False, keep_links: bool = False) -> tuple[str, int, int, int]:
    """The source without dangerous elements, handlers and external links, and how many of each there were."""
    rows, heads = elements(html)
    bad = DANGEROUS | PARANOID if paranoid else DANGEROUS
    out, at, n = [], 0, [0, 0, 0]
    for (_, _, _, tag, start, stop, _), (_, place, attributes) in zip(rows, heads, strict=True):
        if start < at:  # within one that is gone
            continue
        if tag in bad:
            out.append(html[at:start])
            at, n[0] = stop, n[0] + 1
            continue
        for a in ATTRIBUTE.finditer(attributes):
            name, value = a.group(1).lower(), (a.group(2) or "")
            if name in HANDLERS:
                out.append(html[at : place + a.start()])
                at, n[1] = place + a.end(), n[1] + 1
            elif tag == "a" and name == "href" and not keep_links and value.strip("\"'").startswith(EXTERNAL):
                out.append(html[at : place + a.start(2)] + '"#"')
                at, n[2] = place + a.end(2), n[2] + 1
    return "".join(out) + html[at:], *n


def trees(pages: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, ELEMENT): a row for each element of each page; a null page is empty."""
    names = [x.split()[0] for x in ELEMENT.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, html in enumerate(batch.column("html").to_pylist()):
                rows, _ = elements(html or "")
                if rows:
                    ids = batch.column("id").take(pa.array([at] * len(rows)))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["id", *names])

    return pages.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("html")).mapInArrow(run, f"id long, {ELEMENT}")


def sanitise(pages: DataFrame, id_column: str, column: str, paranoid: bool = False) -> DataFrame:
    """(id, html, elements, handlers, links): each page's sanitised source, and what was removed; a null page stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, 0, 0, 0) if x is None else sanitised(x, paranoid) for x in batch.column("html").to_pylist()]
            cols = list(zip(*done, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cols[0], pa.string()), *(pa.array(c, pa.int32()) for c in cols[1:])], ["id", "html", "elements", "handlers", "links"])

    return pages.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("html")).mapInArrow(run, "id long, html string, elements int, handlers int, links int")
