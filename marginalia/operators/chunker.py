"""Markdown texts to passages with byte ranges.

Where a passage begins and ends depends on all lines before it, so the boundaries
of a document come from one pass over its lines, on whichever task holds it. That
pass returns ranges only. Bodies, link ratios, kinds and ordinals are built-in
expressions over the ranges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import blake2
from marginalia.session import bounded_batches

#: Fixed values.
MAX_DOCUMENT, TARGET, MAX, MIN, LINK_LIST = 64 << 20, 1024, 1536, 64, 6000
KINDS = ("prose", "code", "table", "front-matter", "link-list", "list", "quote")
SPACE = b" \t\r\n\v\f"
LINE = re.compile(rb"[^\n]*\n|[^\n]+")
INDENT = re.compile(rb"[ \t]*")
HEADING = re.compile(rb"(#{1,6})(?![^ \t])")
FENCE = re.compile(rb"(`{3,})[^`]*$|(~{3,})")
ITEM = re.compile(rb"(?:[-*+]|[0-9]{1,9}[.)])[ \t]")
RULE = re.compile(rb"([-*_+])(?:[ \t]*\1){2,}[ \t]*$")
UNDERLINE = re.compile(rb"(?:=[= \t]*|-[- \t]*)$")
DELIMITER = re.compile(rb"\|[-|: \t]*$")
LINK = r"\[\[[\s\S]*?\]\]|\[[^\]\n]*\]\([^)\n]*\)"
RANGES = "start int, end int, kind string, heading_path string, header_start int, header_end int"


class Line:
    """One line: its bytes without the ending, where they start, where the next line starts, and what it looks like."""

    __slots__ = ("start", "next", "text", "body", "indent", "blank")

    def __init__(self, start: int, raw: bytes):
        self.start, self.next = start, start + len(raw)
        text = raw[:-1] if raw.endswith(b"\n") else raw
        self.text = text[:-1] if text.endswith(b"\r") else text
        lead = INDENT.match(self.text).group()
        self.body = self.text[len(lead) :]
        self.indent = len(lead) + 3 * lead.count(b"\t")
        self.blank = not self.text.strip(SPACE)

    def heading(self) -> int:
        m = HEADING.match(self.body) if self.indent < 4 else None
        return len(m.group(1)) if m else 0

    def title(self) -> bytes:
        rest = self.body.lstrip(b"#").strip(b" \t")
        return re.sub(rb"(^|[ \t])#+$", b"", rest).rstrip(b" \t")

    def fence(self, anywhere: bool = False) -> bytes | None:
        m = FENCE.match(self.body) if anywhere or self.indent < 4 else None
        return (m.group(1) or m.group(2)) if m else None

    def closes(self, fence: bytes, anywhere: bool = False) -> bool:
        rest = self.body.rstrip(b" \t")
        return (anywhere or self.indent < 4) and len(rest) >= len(fence) and not rest.strip(fence[:1])

    def rule(self) -> bool:
        m = RULE.match(self.body) if self.indent < 4 else None
        return bool(m) and m.group(1) != b"+"

    def item(self) -> bool:
        return self.indent < 4 and bool(ITEM.match(self.body)) and not RULE.match(self.body)

    def quote(self) -> bool:
        return self.indent < 4 and self.body.startswith(b">")

    def row(self) -> bool:
        return self.body.startswith(b"|")

    def delimiter(self) -> bool:
        return bool(DELIMITER.match(self.body)) and b"-" in self.body

    def underline(self) -> int:
        m = UNDERLINE.match(self.body) if self.indent < 4 and self.body else None
        return 0 if not m else 1 if self.body[:1] == b"=" else 2


def lines_of(text: bytes) -> list[Line]:
    return [Line(m.start(), m.group()) for m in LINE.finditer(text)]


def _list_end(lines: list[Line], i: int) -> int:
    j = i
    while j < len(lines):
        line, after = lines[j], lines[j + 1] if j + 1 < len(lines) else None
        if line.blank:
            if after is None or after.blank or not (after.item() or after.indent >= 2):
                break
        elif j > i and not line.item() and line.indent < 2 and line.heading():
            break
        j += 1
    return j


def _run(lines: list[Line], i: int, going) -> int:
    while i < len(lines) and going(lines[i]):
        i += 1
    return i


def blocks(lines: list[Line]) -> Iterator[tuple[str, int, int, object]]:
    """``kind, first line, line after, extra``; kinds of structure in the order of their precedence."""
    i, n = 0, len(lines)
    if lines and lines[0].text in (b"---", b"+++"):
        close = next((k for k in range(1, n) if lines[k].text == lines[0].text), None)
        if close is not None:
            yield "front-matter", 0, close + 1, None
            i = close + 1
    while i < n:
        line = lines[i]
        if line.blank:
            kind, j, extra = "blank", i + 1, None
        elif fence := line.fence():
            kind, extra = "code", None
            j = min(_run(lines, i + 1, lambda x: not x.closes(fence)) + 1, n)
        elif level := line.heading():
            kind, j, extra = "heading", i + 1, (level, line.title())
        elif line.rule():
            kind, j, extra = "blank", i + 1, None
        elif line.row() and i + 1 < n and lines[i + 1].delimiter():
            kind, j, extra = "table", _run(lines, i + 2, Line.row), None
        elif line.quote():
            kind, j, extra = "quote", _run(lines, i + 1, lambda x: not x.blank and x.quote()), None
        elif line.item():
            kind, j, extra = "list", _list_end(lines, i), None
        elif i + 1 < n and not lines[i + 1].blank and (level := lines[i + 1].underline()):
            kind, j, extra = "heading", i + 2, (level, line.text)
        else:
            kind, extra = "prose", None
            j = _run(lines, i + 1, lambda x: not (x.blank or x.heading() or x.fence() or x.rule() or x.item()))
        yield kind, i, j, extra
        i = j


class Assembler:
    """Joins blocks into passages; ``out`` collects ``start, end, kind, path, header_start, header_end``."""

    def __init__(self, text: bytes, lines: list[Line]):
        self.text, self.lines, self.out = text, lines, []
        self.titles: list[tuple[int, bytes]] = []
        self.open: list | None = None  # start, end, kind, path

    def path(self) -> str:
        return b" > ".join(t for _, t in self.titles).decode("utf-8")

    def emit(self, start: int, end: int, kind: str, path: str, header: tuple[int, int] = (0, 0)) -> None:
        if end > start:
            self.out.append((start, end, kind, path, *header))

    def flush(self) -> None:
        if self.open:
            self.emit(*self.open)
        self.open = None

    def take(self, kind: str, i: int, j: int, extra) -> None:
        start, end = self.lines[i].start, self.lines[j - 1].next
        held = self.open[1] - self.open[0] if self.open else 0
        if kind == "blank":
            if self.open:
                self.open[1] = end
        elif kind == "front-matter":
            self.flush()
            self.emit(start, end, kind, "")
        elif kind == "heading":
            self.flush()
            self.titles = [t for t in self.titles if t[0] < extra[0]] + [extra]
            self.open = [start, end, "prose", self.path()]
        elif kind in ("code", "table"):
            if self.open and held + end - start <= MAX:
                self.open[1] = end
                return
            self.flush()
            if kind == "code" or end - start <= MAX:
                self.emit(start, end, kind, self.path())
            else:
                self.split_table(i, j)
        else:
            if self.open:
                whole = end - self.open[0]
                if whole <= TARGET or (whole <= MAX and held < MIN):
                    self.open[1] = end
                    self.open[2] = kind if self.open[2] == "prose" else self.open[2]
                    return
                self.flush()
            if end - start <= MAX:
                self.open = [start, end, kind, self.path()]
            else:
                self.split_lines(kind, i, j)

    def split_table(self, i: int, j: int) -> None:
        header = (self.lines[i].start, self.lines[i + 1].next)
        start = at = header[1]
        for line in self.lines[i + 2 : j]:
            if line.next - start > MAX and at > start:
                self.emit(start, at, "table", self.path(), header)
                start = at
            at = line.next
        self.emit(start, at, "table", self.path(), header)

    def split_lines(self, kind: str, i: int, j: int) -> None:
        """Between lines and never inside a fence; a line that is too long, between code points."""
        start = at = self.lines[i].start
        fence: bytes | None = None
        for line in self.lines[i:j]:
            free = fence is None
            if fence is None:
                fence = line.fence(anywhere=True)
            elif line.closes(fence, anywhere=True):
                fence = None
            while free and at == start and line.next - start > MAX:
                cut = start + MAX
                while cut > start + MAX - 4 and self.text[cut] & 0xC0 == 0x80:
                    cut -= 1
                self.emit(start, cut, kind, self.path())
                start = at = cut
            if free and at > start and line.next - start > MAX:
                self.emit(start, at, kind, self.path())
                start = at
            at = line.next
        if at > start:
            self.open = [start, at, kind, self.path()]


def ranges(text: bytes) -> list[tuple]:
    lines = lines_of(text)
    a = Assembler(text, lines)
    for block in blocks(lines):
        a.take(*block)
    a.flush()
    return a.out


def link_ratio(body: Column) -> Column:
    """Bytes inside links per 10,000 bytes that are not space."""
    linked = F.aggregate(F.regexp_extract_all(body, F.lit(LINK), 0), F.lit(0), lambda n, m: n + F.octet_length(m))
    solid = F.octet_length(F.regexp_replace(body, r"[ \t\n\r\f\x0b]", ""))
    ratio = F.floor(linked.cast("long") * 10000 / F.greatest(solid, F.lit(1)))
    return F.when(solid == 0, F.lit(0)).otherwise(F.least(ratio, F.lit(10000))).cast("int")


def chunk_status(text: Column) -> Column:
    """``text`` is binary or a string."""
    return F.when(F.octet_length(text) > MAX_DOCUMENT, "too-large").when(~F.is_valid_utf8(text.cast("string")), "not-utf8").otherwise("ok")


def chunks(documents: DataFrame) -> DataFrame:
    """``documents(object, text)`` to passages; documents that are too large or not UTF-8 give none.

    ``object, ordinal, start, end, kind, link_ratio, heading_path, text``; ends are
    exclusive and count bytes.
    """
    bounded_batches(documents.sparkSession)
    usable = documents.where((chunk_status(F.col("text")) == "ok") & (F.octet_length("text") > 0))
    kind = usable.schema["object"].dataType.simpleString()

    def boundaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["object", "bytes", "n", "start", "end", "kind", "heading_path", "header_start", "header_end"]
        for batch in batches:
            rows = [(o, t, k, *r) for o, t in zip(batch["object"], batch["bytes"]) for k, r in enumerate(ranges(t))]
            cut = [(o, t[s:e], n, s, e, *rest, t[rest[-2] : rest[-1]]) for o, t, n, s, e, *rest in rows]
            yield pd.DataFrame(cut, columns=[*names, "header"])[["object", "n", "start", "end", "kind", "heading_path", "bytes", "header"]]

    schema = f"object {kind}, ordinal int, start int, end int, kind string, heading_path string, body binary, header binary"
    cut = usable.select("object", F.encode(F.col("text").cast("string"), "UTF-8").alias("bytes")).mapInPandas(
        lambda it: (p.set_axis(["object", "ordinal", "start", "end", "kind", "heading_path", "body", "header"], axis=1) for p in boundaries(it)), schema
    )
    body = F.decode("body", "UTF-8")
    rows = cut.withColumn("_body", body).withColumn("link_ratio", link_ratio(F.col("_body")))
    kind_now = F.when((F.col("kind") == "list") & (F.col("link_ratio") >= LINK_LIST), "link-list").otherwise(F.col("kind"))
    path = F.when(F.col("heading_path") != "", F.concat("heading_path", F.lit("\n\n"))).otherwise(F.lit(""))
    return rows.select(
        "object", "ordinal", "start", "end", kind_now.alias("kind"), "link_ratio", "heading_path",
        F.concat(path, F.decode("header", "UTF-8"), "_body").alias("text"),
    )


def digests(passages: DataFrame) -> DataFrame:
    """``object, digest``: BLAKE2b-256 over each document's kinds and ranges in order.

    A passage is a record of 13 bytes, the number of its kind and three numbers of
    four bytes, written by built-in functions; only the digest itself needs Python.
    """
    number = lambda c, digits: F.lpad(F.hex(c.cast("long")), digits, "0")
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")) - 1
    record = F.concat(number(kind, 2), *[number(F.col(c), 8) for c in ("start", "end", "ordinal")])
    listed = F.array_sort(F.collect_list(F.struct("ordinal", record.alias("r"))))
    each = passages.groupBy("object").agg(F.unhex(F.array_join(listed.getField("r"), "")).alias("records"))
    return each.select("object", blake2(32)("records").alias("digest"))


def line_offsets(documents: DataFrame) -> DataFrame:
    """``object, line, start, end``: every line with its byte range, without Python.

    The end leaves out the line break and a carriage return before it.
    """
    each = documents.select("object", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
    order = Window.partitionBy("object").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("raw") + 1).over(order), F.lit(0))
    rows = each.withColumn("start", start).withColumn("end", F.col("start") + F.octet_length(F.regexp_replace("raw", "\r$", "")))
    return rows.select("object", "line", "start", "end")
