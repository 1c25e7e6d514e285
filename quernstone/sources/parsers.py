"""Parsers of single files into content units; plain functions that run beside the data, one file at a time."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 4000, 400
#: Pieces of texts that go out at a time.
PIECES = 500
# Bounds of archives.
MAX_ENTRIES, MAX_BYTES, MAX_RATIO = 100_000, 2 * 1024**3, 200


class Unreadable(Exception):
    pass


def decoded(raw: bytes) -> tuple[str, str]:
    """Text and how it was read: UTF-16 with a mark, UTF-8, CP949, or UTF-8 with replacements."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        try:
            return raw.decode("utf-16"), "utf-16"
        except UnicodeDecodeError:
            pass
    for name in ("utf-8-sig", "cp949"):
        try:
            return raw.decode(name), name
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace"), "replaced"


def looks_binary(raw: bytes) -> bool:
    head = raw[:4096]
    return b"\x00" in head and head[:2] not in (b"\xff\xfe", b"\xfe\xff")


def chunks(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, str]]:
    """(start, piece) of at most ``size`` characters, cut at the last line break past the middle, overlapping the one before."""
    start = 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            cut = text.rfind("\n", start + size // 2, end)
            end = cut + 1 if cut >= 0 else end
        yield start, text[start:end]
        if end >= len(text):
            return
        start = max(end - overlap, start + 1)


def chunked(texts: DataFrame, key: str) -> DataFrame:
    """key, ordinal, start, body of the chunks of ``texts`` (key, text). Pieces go out PIECES or so at a time: neither texts nor pieces of a batch lie in Python at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "ordinal", "start", "body"]

        def made(keys: pa.Array, rows: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
            at, ordinals, starts, bodies = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(ordinals, pa.int32()), pa.array(starts, pa.int32()), pa.array(bodies, pa.string())], names=names)

        for b in batches:
            rows: list[tuple[int, int, int, str]] = []
            for i, text in enumerate(b.column(1)):
                for n, (start, piece) in enumerate(chunks(text.as_py() or "")):
                    rows.append((i, n, start, piece))
                    if len(rows) == PIECES:
                        yield made(b.column(0), rows)
                        rows = []
            if rows:
                yield made(b.column(0), rows)

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, F.col("text").cast("string")).mapInArrow(run, f"{key} {kind}, ordinal int, start int, body string")


def gathered(paragraphs: list[str], size: int = CHUNK) -> Iterator[tuple[int, int, str]]:
    """(first, last, text): paragraphs put together up to ``size`` characters, none divided."""
    own: list[str] = []
    first = length = 0
    for n, p in enumerate(paragraphs):
        if own and length + len(p) + 1 > size:
            yield first, n - 1, "\n".join(own)
            own, first, length = [], n, 0
        own.append(p)
        length += len(p) + 1
    if own:
        yield first, len(paragraphs) - 1, "\n".join(own)


def archive(raw: bytes) -> zipfile.ZipFile:
    """An archive that is safe to unpack."""
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        raise Unreadable("not an archive") from e
    infos = z.infolist()
    total, packed = sum(i.file_size for i in infos), sum(i.compress_size for i in infos)
    if len(infos) > MAX_ENTRIES or total > MAX_BYTES or total > MAX_RATIO * max(1, packed):
        raise Unreadable("archive exceeds its bounds")
    return z


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element:
    data = z.read(name)
    if b"<!DOCTYPE" in data[:2048] or b"<!ENTITY" in data:
        raise Unreadable("document type declarations aren't read")
    return ET.fromstring(data)


Unit = tuple[str, str | None, str, dict]


def text_units(raw: bytes) -> Iterator[Unit]:
    if looks_binary(raw):
        raise Unreadable("binary content")
    text, how = decoded(raw)
    yield "text", None, text, {"type": "text_line_range", "start": 1, "end": text.count("\n") + 1, "encoding": how}


def _line(row: list[str], sep: str) -> str:
    out = io.StringIO()
    csv.writer(out, delimiter=sep, lineterminator="").writerow(row)
    return out.getvalue()


def csv_units(raw: bytes) -> Iterator[Unit]:
    """Rows in chunks that repeat the header. Lines that begin with # are left out of the sample that tells the separator, but are rows."""
    text, _ = decoded(raw)
    sample = [x for x in text.splitlines() if x.strip() and not x.startswith("#")][:20]
    sep = max(",;\t", key=lambda s: min((x.count(s) for x in sample), default=0) * 1000 + sum(x.count(s) for x in sample))
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r]
    if not rows:
        return
    header, width = rows[0], len(rows[0])
    ragged = sum(len(r) != width for r in rows[1:])
    top = _line(header, sep)
    pieces: list[tuple[int, int, list[str]]] = []
    own: list[str] = []
    first, length = 1, len(top)
    for n, r in enumerate(rows[1:], start=1):
        line = _line(r, sep)
        if own and length + len(line) + 1 > CHUNK:
            pieces.append((first, n - 1, own))
            own, first, length = [], n, len(top)
        own.append(line)
        length += len(line) + 1
    pieces.append((first, len(rows) - 1, own))
    for first, last, lines in pieces:
        yield "table", None, "\n".join([top, *lines]), {"type": "csv_rows", "start": first, "end": last, "ragged": ragged, "partial": len(pieces) > 1}


def _words(node: ET.Element) -> str:
    out = []
    for x in node.iter():
        t = _local(x.tag)
        if t == "t":
            out.append(x.text or "")
        elif t in ("tab", "br", "cr"):
            out.append("\t" if t == "tab" else "\n")
    return "".join(out)


def _child(node: ET.Element, *path: str) -> ET.Element | None:
    for name in path:
        node = next((x for x in node if _local(x.tag) == name), None)
        if node is None:
            return None
    return node


def _attr(node: ET.Element | None, name: str, default: str = "") -> str:
    """An attribute in whatever namespace."""
    return default if node is None else next((v for k, v in node.attrib.items() if _local(k) == name), default)


def _rendered(grid: list[list[str]]) -> str:
    width = max(map(len, grid), default=0)
    return "\n".join(" | ".join([*row, *[""] * (width - len(row))]) for row in grid)


def docx_grid(table: ET.Element) -> tuple[list[list[str]], int]:
    """Cells by row and column of the grid, and how many tables lie within. What spans several places stands at its first, the others are blank.

    A table in a cell is rendered in its cell, in brackets, its rows apart by semicolons.
    """
    grid, inner = [], 0

    def words(node: ET.Element) -> str:
        nonlocal inner
        parts = []
        for x in node:
            if _local(x.tag) == "tbl":
                own, more = docx_grid(x)
                inner += 1 + more
                parts.append("[" + "; ".join(" | ".join(r) for r in own) + "]")
            elif _local(x.tag) in ("p", "sdt", "sdtContent"):
                parts.append(" ".join((_words(x) if _local(x.tag) == "p" else words(x)).split()))
        return " ".join(t for t in parts if t)

    for row in (x for x in table if _local(x.tag) == "tr"):
        before = int(_attr(_child(row, "trPr", "gridBefore"), "val", "0") or 0)
        cells = [""] * before
        for c in (x for x in row if _local(x.tag) == "tc"):
            span = max(1, int(_attr(_child(c, "tcPr", "gridSpan"), "val", "1") or 1))
            merge = _child(c, "tcPr", "vMerge")
            goes_on = merge is not None and _attr(merge, "val", "continue") == "continue"
            cells += ["" if goes_on else words(c), *[""] * (span - 1)]
        grid.append(cells)
    return grid, inner


def docx_units(raw: bytes) -> Iterator[Unit]:
    z = archive(raw)
    names = set(z.namelist())
    if "word/document.xml" not in names:
        raise Unreadable("no document")
    body = next((x for x in _xml(z, "word/document.xml") if _local(x.tag) == "body"), None)
    blocks = [] if body is None else list(body)
    paragraphs = [t for x in blocks if _local(x.tag) == "p" and (t := _words(x).strip())]
    for first, last, text in gathered(paragraphs):
        yield "paragraphs", None, text, {"type": "docx_paragraphs", "start": first + 1, "end": last + 1}
    for n, table in enumerate((x for x in blocks if _local(x.tag) == "tbl"), start=1):
        grid, inner = docx_grid(table)
        yield "table", None, _rendered(grid), {"type": "docx_table", "table": n, "rows": len(grid), "columns": max(map(len, grid), default=0), "nested": inner}
    for name in sorted(names):
        m = re.fullmatch(r"word/(header|footer|footnotes|endnotes)\d*\.xml", name)
        if m and (text := _words(_xml(z, name)).strip()):
            kind = "docx_notes" if m[1].endswith("notes") else "docx_header_footer"
            yield m[1], None, text, {"type": kind, "part": name}


def pptx_grid(table: ET.Element) -> list[list[str]]:
    """Cells by row and column; those that another one covers are blank."""
    rows = [[c for c in row if _local(c.tag) == "tc"] for row in table if _local(row.tag) == "tr"]
    return [["" if c.get("hMerge") in ("1", "true") or c.get("vMerge") in ("1", "true") else " ".join(_words(c).split()) for c in row] for row in rows]


def chart_lines(root: ET.Element) -> list[str]:
    """Title, and for each series its points by category, as the chart's cache has them."""
    title = next((x for x in root.iter() if _local(x.tag) == "title"), None)
    out = [t] if title is not None and (t := " ".join(_words(title).split()) or " ".join(v.text or "" for v in title.iter() if _local(v.tag) == "v")) else []

    def points(node: ET.Element | None) -> dict[int, str]:
        found = (x for x in node.iter() if _local(x.tag) == "pt") if node is not None else ()
        return {int(p.get("idx", "0")): next((v.text or "" for v in p if _local(v.tag) == "v"), "") for p in found}

    for s in (x for x in root.iter() if _local(x.tag) == "ser"):
        kids = {_local(x.tag): x for x in s}
        name, names = points(kids.get("tx")), points(kids.get("cat") if "cat" in kids else kids.get("xVal"))
        values = points(kids.get("val") if "val" in kids else kids.get("yVal"))
        # a category without a value is kept, and a value without a category
        cells = [f"{names.get(i, i + 1)}={values.get(i, '')}" for i in sorted(names.keys() | values.keys())]
        out.append(f"{name.get(0, 'series')}: " + ", ".join(cells))
    return out


def _related(z: zipfile.ZipFile, slide: str) -> list[tuple[str, str]]:
    """(kind, part) of what a slide refers to."""
    folder, _, name = slide.rpartition("/")
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return []
    out = []
    for r in _xml(z, rels):
        steps: list[str] = []
        target = r.get("Target", "")
        for part in (target.lstrip("/") if target.startswith("/") else f"{folder}/{target}").split("/"):
            steps = steps[:-1] if part == ".." else [*steps, part]
        out.append((r.get("Type", "").rpartition("/")[2], "/".join(steps)))
    return out


def _slide_parts(z: zipfile.ZipFile, n: int, name: str, root: ET.Element) -> Iterator[Unit]:
    """Tables, charts, diagrams and comments of a slide."""
    for k, table in enumerate((x for x in root.iter() if _local(x.tag) == "tbl"), start=1):
        grid = pptx_grid(table)
        yield "table", None, _rendered(grid), {"type": "pptx_table", "slide": n, "table": k, "rows": len(grid), "columns": max(map(len, grid), default=0)}
    for kind, part in _related(z, name):
        if part not in z.namelist():
            continue
        if kind == "chart" and (lines := chart_lines(_xml(z, part))):
            yield "chart", None, "\n".join(lines), {"type": "pptx_chart", "slide": n, "part": part}
        elif kind == "diagramData" and (lines := [t for p in _xml(z, part).iter() if _local(p.tag) == "p" and (t := _words(p).strip())]):
            yield "diagram", None, "\n".join(lines), {"type": "pptx_diagram", "slide": n, "part": part}
        elif kind == "comments":
            said = (x for x in _xml(z, part).iter() if _local(x.tag) == "text" or _local(x.tag) == "txBody")
            if lines := [t for x in said if (t := ((x.text or "") or _words(x)).strip())]:
                yield "comment", None, "\n".join(lines), {"type": "pptx_comments", "slide": n, "part": part}


def pptx_units(raw: bytes) -> Iterator[Unit]:
    z = archive(raw)
    for kind, pattern in (("slide", r"ppt/slides/slide(\d+)\.xml"), ("notes", r"ppt/notesSlides/notesSlide(\d+)\.xml")):
        for n, name in sorted((int(m[1]), x) for x in z.namelist() if (m := re.fullmatch(pattern, x))):
            root = _xml(z, name)
            in_tables = {p for t in root.iter() if _local(t.tag) == "tbl" for p in t.iter()}
            lines = [t for p in root.iter() if _local(p.tag) == "p" and p not in in_tables and (t := _words(p).strip())]
            if lines:
                yield kind, lines[0] if kind == "slide" else None, "\n".join(lines), {"type": "pptx_shape" if kind == "slide" else "pptx_notes", "slide": n, "hidden": root.get("show") == "0"}
            if kind == "slide":
                yield from _slide_parts(z, n, name, root)


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str, bool]]:
    """(name, part, hidden) of each sheet."""
    rels = {r.get("Id"): r.get("Target", "") for r in _xml(z, "xl/_rels/workbook.xml.rels")}
    out = []
    for s in (x for x in _xml(z, "xl/workbook.xml").iter() if _local(x.tag) == "sheet"):
        rid = next((v for k, v in s.attrib.items() if _local(k) == "id"), "")
        target = rels.get(rid, "").lstrip("/")
        out.append((s.get("name", ""), target if target.startswith("xl/") else f"xl/{target}", s.get("state", "visible") != "visible"))
    return out


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return [_words(x) for x in _xml(z, "xl/sharedStrings.xml") if _local(x.tag) == "si"]


def corners(ref: str) -> tuple[int, int, int, int]:
    """First row and column, last row and column of a range."""
    a, _, b = ref.partition(":")
    return *position(a), *position(b or a)


def _cells(z: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[tuple]:
    """(row, col, value, type, formula, merged, hidden, filtered): merged is the range that a cell is part of, filtered a row that a filter hides."""
    root = _xml(z, part)
    merged = [(corners(x.get("ref", "A1")), x.get("ref")) for x in root.iter() if _local(x.tag) == "mergeCell"]
    filters = [corners(x.get("ref", "A1")) for x in root.iter() if _local(x.tag) == "autoFilter"]
    rows_off = {int(x.get("r", "0")) for x in root.iter() if _local(x.tag) == "row" and x.get("hidden") in ("1", "true")}
    cols_off = [(int(x.get("min", "0")), int(x.get("max", "0"))) for x in root.iter() if _local(x.tag) == "col" and x.get("hidden") in ("1", "true")]
    for row, col, *rest in _values(root, shared):
        within = next((ref for (r0, c0, r1, c1), ref in merged if r0 <= row <= r1 and c0 <= col <= c1), None)
        # the filter's first row holds its names
        filtered = row in rows_off and any(r0 < row <= r1 for r0, _, r1, _ in filters)
        yield row, col, *rest, within, row in rows_off or any(a <= col <= b for a, b in cols_off), filtered


def _values(root: ET.Element, shared: list[str]) -> Iterator[tuple[int, int, str | None, str, str | None]]:
    for c in (x for x in root.iter() if _local(x.tag) == "c"):
        row, col = position(c.get("r", "A1"))
        kind = c.get("t", "n")
        kids = {_local(x.tag): x for x in c}
        value = kids["v"].text if "v" in kids else None
        if kind == "s" and value is not None:
            value = shared[int(value)] if int(value) < len(shared) else None
        elif kind == "inlineStr":
            value = _words(c)
        name = {"s": "string", "inlineStr": "string", "str": "string", "b": "boolean", "e": "error"}.get(kind, "number")
        yield row, col, value, name if value is not None else "empty", kids["f"].text if "f" in kids else None


def position(ref: str) -> tuple[int, int]:
    m = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?([0-9]+)", ref)
    if not m:
        raise Unreadable(f"no cell: {ref}")
    col = 0
    for ch in m[1].upper():
        col = col * 26 + ord(ch) - 64
    return int(m[2]), col


def xlsx_units(raw: bytes, most: int = 240_000) -> Iterator[Unit]:
    """The distinct strings of each sheet, no numbers."""
    z = archive(raw)
    shared = _shared(z)
    for name, part, hidden in _sheets(z):
        words = dict.fromkeys(v.strip() for _, _, v, kind, _ in _values(_xml(z, part), shared) if kind == "string" and v and v.strip())
        body = "\n".join(words)
        if body:
            yield "sheet", name, body[:most], {"type": "xlsx_sheet", "sheet": name, "hidden": hidden, "truncated": len(body) > most}


def xlsx_cells(raw: bytes, sheet: str, cells: str) -> Iterator[tuple]:
    r0, c0, r1, c1 = corners(cells)
    z = archive(raw)
    for name, part, _ in _sheets(z):
        if name == sheet:
            yield from (x for x in _cells(z, part, _shared(z)) if r0 <= x[0] <= r1 and c0 <= x[1] <= c1)


PARSERS = {"txt": text_units, "md": text_units, "log": text_units, "json": text_units, "csv": csv_units, "tsv": csv_units, "docx": docx_units, "pptx": pptx_units, "xlsx": xlsx_units}


def units(path: str, raw: bytes, extension: str) -> list[tuple]:
    """(path, ordinal, parser, unit_type, title, body, locator, status, warning) rows; one row that says why if there are none."""
    parser = PARSERS.get(extension)
    if parser is None:
        return [(path, 0, None, None, None, None, None, "unsupported", extension)]
    name = parser.__name__.removesuffix("_units")
    try:
        rows = [(path, n, name, kind, title, body, json.dumps(where, sort_keys=True), "parsed", None) for n, (kind, title, body, where) in enumerate(parser(raw))]
    except (Unreadable, ET.ParseError, KeyError, ValueError, zipfile.BadZipFile, csv.Error) as e:
        return [(path, 0, name, None, None, None, None, "failed", f"{type(e).__name__}: {e}"[:300])]
    return rows or [(path, 0, name, None, None, None, None, "empty", None)]
