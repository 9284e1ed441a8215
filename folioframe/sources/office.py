"""Office files (DOCX, XLSX, PPTX) from their bytes, with the standard library: paragraphs, tables, cells, slides.

Each reader is a plain function from bytes, wrapped row by row over ``walk``; a file that can't be read gives no row, and
``office_errors`` reports it.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Namespaces of the public formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
#: Most bytes a part may have when unpacked, against archives made to burst.
MOST_PART = 512 * 1024 * 1024


def _part(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    try:
        info = z.getinfo(name)
    except KeyError:
        return None
    if info.file_size > MOST_PART:
        raise ValueError(f"{name} is too large")
    data = z.read(name)
    if b"<!DOCTYPE" in data[:1024] or b"<!ENTITY" in data:
        raise ValueError("document types aren't read")
    return ET.fromstring(data)


def sniff(data: bytes) -> str | None:
    """docx, xlsx, pptx, xlsm or None, by the content types of the archive, then by its folders."""
    if data[:4] != b"PK\x03\x04":
        return None
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        names = z.namelist()
        types = z.read("[Content_Types].xml").decode("utf-8", "replace") if "[Content_Types].xml" in names else ""
    except (zipfile.BadZipFile, KeyError):
        return None
    for kind, mark, folder in (("docx", "wordprocessingml.document", "word/"), ("xlsm", "sheet.macroEnabled", "\0"), ("xlsx", "spreadsheetml.sheet", "xl/"), ("pptx", "presentationml.presentation", "ppt/")):
        if mark in types:
            return kind
    return next((k for k, f in (("docx", "word/"), ("xlsx", "xl/"), ("pptx", "ppt/")) if any(n.startswith(f) for n in names)), None)


def relationships(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, _, name = part.rpartition("/")
    root = _part(z, f"{folder}/_rels/{name}.rels")
    if root is None:
        return {}
    out = {}
    for r in root.iter(f"{REL}Relationship"):
        target = r.get("Target", "")
        out[r.get("Id", "")] = target.lstrip("/") if target.startswith("/") else re.sub(r"[^/]+/\.\./", "", f"{folder}/{target}") if r.get("TargetMode") != "External" else target
    return out


def metadata(data: bytes) -> dict[str, str]:
    """Title, creator, keywords and dates of a file's core properties."""
    z = zipfile.ZipFile(io.BytesIO(data))
    root = _part(z, "docProps/core.xml")
    return {} if root is None else {e.tag.rpartition("}")[2]: (e.text or "") for e in root if e.text}


# -- spreadsheets -----------------------------------------------------------------------------------------------------
def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    root = _part(z, "xl/sharedStrings.xml")
    return [] if root is None else ["".join(t.text or "" for t in si.iter(f"{S}t") if True) for si in root.iter(f"{S}si")]


def date_styles(z: zipfile.ZipFile) -> set[int]:
    """Indexes of the cell formats that show dates."""
    root = _part(z, "xl/styles.xml")
    if root is None:
        return set()
    own = {int(f.get("numFmtId", 0)) for f in root.iter(f"{S}numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower()))}
    cells = root.find(f"{S}cellXfs")
    built_in = {*range(14, 23), *range(45, 48)}  # fixed values of the format
    return set() if cells is None else {i for i, x in enumerate(cells) if int(x.get("numFmtId", 0)) in built_in | own}


def excel_date_text(serial: float) -> str | None:
    import datetime as dt

    if serial < 1:
        return None
    day = int(serial)
    seconds = round((serial - day) * 86400)
    date = dt.datetime(1899, 12, 30) + dt.timedelta(days=day + (1 if day <= 59 else 0), seconds=seconds)
    return date.strftime("%Y-%m-%d %H:%M:%S" if serial - day > 1e-4 else "%Y-%m-%d")


def _number(text: str) -> str:
    try:
        x = float(text)
    except ValueError:
        return text
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else f"{x:.6f}".rstrip("0").rstrip(".")


def read_cells(data: bytes) -> list[tuple[str, int, int, str, str]]:
    """(sheet, row, col, kind, text) of the filled cells of a workbook, merged cells filled, sheets in order."""
    z = zipfile.ZipFile(io.BytesIO(data))
    book = _part(z, "xl/workbook.xml")
    if book is None:
        return []
    rel, strings, dates, out = relationships(z, "xl/workbook.xml"), shared_strings(z), date_styles(z), []
    for sheet in book.iter(f"{S}sheet"):
        root = _part(z, rel.get(sheet.get(f"{R}id", ""), ""))
        if root is None:
            continue
        grid: dict[tuple[int, int], tuple[str, str]] = {}
        for i, row in enumerate(root.iter(f"{S}row")):
            r = int(row.get("r", i + 1)) - 1
            for j, c in enumerate(row.iter(f"{S}c")):
                col = _column(c.get("r")) if c.get("r") else j
                kind, v = c.get("t", "n"), c.find(f"{S}v")
                text = (v.text or "") if v is not None else ""
                if kind == "s":
                    text = strings[int(text)] if text.isdigit() and int(text) < len(strings) else ""
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{S}t"))
                elif kind == "b":
                    text = "true" if text == "1" else "false"
                elif kind == "n" and text:
                    dated = int(c.get("s", 0)) in dates
                    text = (excel_date_text(float(text)) if dated else None) or _number(text)
                    kind = "d" if dated else "n"
                if text:
                    grid[r, col] = (kind, text)
        for m in root.iter(f"{S}mergeCell"):
            a, _, b = m.get("ref", "").partition(":")
            if b and (top := (int(re.search(r"\d+", a)[0]) - 1, _column(a))) in grid:
                for r in range(top[0], int(re.search(r"\d+", b)[0])):
                    for col in range(top[1], _column(b) + 1):
                        grid.setdefault((r, col), grid[top])
        out += [(sheet.get("name", ""), r, c, k, t) for (r, c), (k, t) in sorted(grid.items())]
    return out


# -- documents and slides ---------------------------------------------------------------------------------------------
def style_levels(z: zipfile.ZipFile) -> dict[str, int]:
    root = _part(z, "word/styles.xml")
    out = {}
    for s in [] if root is None else root.iter(f"{W}style"):
        name = s.find(f"{W}name")
        hit = re.fullmatch(r"(?:heading|标题) ?(\d)", (name.get(f"{W}val", "") if name is not None else "").lower())
        level = s.find(f"{W}pPr/{W}outlineLvl")
        if hit:
            out[s.get(f"{W}styleId", "")] = int(hit[1])
        elif level is not None and level.get(f"{W}val", "9").isdigit() and int(level.get(f"{W}val")) < 6:
            out[s.get(f"{W}styleId", "")] = int(level.get(f"{W}val")) + 1
    return out


def numbered_lists(z: zipfile.ZipFile) -> set[str]:
    """Ids of the lists that count rather than use bullets."""
    root = _part(z, "word/numbering.xml")
    if root is None:
        return set()
    bullets = {a.get(f"{W}abstractNumId") for a in root.iter(f"{W}abstractNum") if (f := a.find(f"{W}lvl/{W}numFmt")) is not None and f.get(f"{W}val") == "bullet"}
    return {n.get(f"{W}numId", "") for n in root.iter(f"{W}num") if (x := n.find(f"{W}abstractNumId")) is not None and x.get(f"{W}val") not in bullets}


def merge_runs(runs: list[tuple[str, tuple]]) -> list[tuple[str, tuple]]:
    """Neighbouring runs of the same style and link become one."""
    out: list[tuple[str, tuple]] = []
    for text, style in runs:
        if out and out[-1][1] == style:
            out[-1] = (out[-1][0] + text, style)
        elif text:
            out.append((text, style))
    return out


def _runs(p: ET.Element, rel: dict[str, str]) -> list[tuple[str, tuple]]:
    out = []
    for node in p:
        link = rel.get(node.get(f"{R}id", ""), "") if node.tag == f"{W}hyperlink" else ""
        for r in [node] if node.tag == f"{W}r" else node.iter(f"{W}r") if node.tag in (f"{W}hyperlink", f"{W}ins", f"{W}smartTag") else []:
            pr = r.find(f"{W}rPr")
            on = lambda t: pr is not None and (e := pr.find(f"{W}{t}")) is not None and e.get(f"{W}val", "1") not in ("0", "false")  # noqa: B023, E731
            text = "".join("\t" if e.tag == f"{W}tab" else "\n" if e.tag in (f"{W}br", f"{W}cr") else e.text or "" for e in r if e.tag in (f"{W}t", f"{W}tab", f"{W}br", f"{W}cr"))
            out.append((text, (on("b"), on("i"), link)))
    return merge_runs(out)


def _styled(runs: list[tuple[str, tuple]]) -> str:
    out = ""
    for text, (bold, italic, link) in runs:
        core = text.strip()
        if core:
            mark = "**" * bold + "*" * italic
            core = f"{mark}{core}{mark}"
            core = f"[{core}]({link})" if link else core
            text = text[: len(text) - len(text.lstrip())] + core + text[len(text.rstrip()) :]
        out += text
    return out


def _table(t: ET.Element, rel: dict[str, str]) -> str:
    """A table as Markdown, or as HTML if it has merged cells."""
    rows, merged = [], False
    for tr in t.findall(f"{W}tr"):
        row = []
        for tc in tr.findall(f"{W}tc"):
            span = tc.find(f"{W}tcPr/{W}gridSpan")
            down = tc.find(f"{W}tcPr/{W}vMerge")
            wide = int(span.get(f"{W}val", 1)) if span is not None else 1
            merged = merged or wide > 1 or down is not None
            row.append((" ".join(_styled(_runs(p, rel)) for p in tc.iter(f"{W}p")).strip(), wide, down is not None and down.get(f"{W}val") != "restart"))
        rows.append(row)
    if merged:
        cell = lambda x: f"<td colspan=\"{x[1]}\">{x[0]}</td>" if x[1] > 1 else f"<td>{x[0]}</td>"
        return "<table>" + "".join("<tr>" + "".join(cell(x) for x in r if not x[2]) + "</tr>" for r in rows) + "</table>"
    text = ["| " + " | ".join(x[0].replace("|", "\\|") for x in r) + " |" for r in rows]
    return "\n".join([*text[:1], "|" + "---|" * len(rows[0]), *text[1:]]) if rows else ""


def read_docx(data: bytes) -> str:
    """A document as Markdown: headings, lists, tables, links, emphasis; two and more entries of a table of contents become a
    table."""
    z = zipfile.ZipFile(io.BytesIO(data))
    root = _part(z, "word/document.xml")
    body = None if root is None else root.find(f"{W}body")
    if body is None:
        return ""
    levels, counted, rel, out, toc = style_levels(z), numbered_lists(z), relationships(z, "word/document.xml"), [], []

    def flush() -> None:
        if len(toc) > 1:
            out.append("\n".join(["| Section | Page |", "|---|---|", *(f"| {a} | {b} |" for a, b in toc)]))
        else:
            out.extend(f"{a} {b}".strip() for a, b in toc)
        toc.clear()

    for node in body:
        if node.tag == f"{W}tbl":
            flush()
            out.append(_table(node, rel))
        if node.tag != f"{W}p":
            continue
        style = node.find(f"{W}pPr/{W}pStyle")
        name = style.get(f"{W}val", "") if style is not None else ""
        text = _styled(_runs(node, rel)).strip()
        if not text:
            continue
        if name.lower().startswith("toc"):
            head, _, number = text.rpartition("\t")
            toc.append((head.strip(". \t") or text, number if head else ""))
            continue
        flush()
        number = node.find(f"{W}pPr/{W}numPr/{W}numId")
        if name in levels:
            out.append("#" * min(6, levels[name]) + " " + re.sub(r"\*\*", "", text))
        elif number is not None:
            depth = node.find(f"{W}pPr/{W}numPr/{W}ilvl")
            out.append("  " * int(depth.get(f"{W}val", 0) if depth is not None else 0) + ("1. " if number.get(f"{W}val") in counted else "- ") + text)
        else:
            out.append(text)
    flush()
    return re.sub(r"(?m)^((?:\s*(?:-|1\.) .*\n)+)\n(?=\s*(?:-|1\.) )", r"\1", "\n\n".join(out))


def read_pptx(data: bytes) -> str:
    """Slides as Markdown: a heading per slide (its title), texts, tables, and notes as quotes."""
    z = zipfile.ZipFile(io.BytesIO(data))
    deck = _part(z, "ppt/presentation.xml")
    if deck is None:
        return ""
    rel, out = relationships(z, "ppt/presentation.xml"), []
    for n, slide in enumerate(deck.iter(f"{P}sldId"), 1):
        part = rel.get(slide.get(f"{R}id", ""), "")
        root = _part(z, part)
        if root is None:
            continue
        title, texts = "", []
        for shape in root.iter(f"{P}sp"):
            place = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
            lines = ["".join(t.text or "" for t in p.iter(f"{A}t")).strip() for p in shape.iter(f"{A}p")]
            lines = [x for x in lines if x]
            if place is not None and place.get("type") in ("title", "ctrTitle") and not title:
                title = " ".join(lines)
            else:
                texts += lines
        for table in root.iter(f"{A}tbl"):
            rows = [["".join(t.text or "" for t in c.iter(f"{A}t")) for c in r.iter(f"{A}tc")] for r in table.iter(f"{A}tr")]
            if rows:
                text = ["| " + " | ".join(r) + " |" for r in rows]
                texts.append("\n".join([text[0], "|" + "---|" * len(rows[0]), *text[1:]]))
        notes = next((t for t in relationships(z, part).values() if "notesSlide" in t), "")
        said = _part(z, notes) if notes else None
        quote = [] if said is None else ["> " + x for p in said.iter(f"{A}p") if (x := "".join(t.text or "" for t in p.iter(f"{A}t")).strip()) and not x.isdigit()]
        out.append("\n\n".join([f"## {title or f'Slide {n}'}", *texts, *quote]))
    return "\n\n".join(out)


# -- over files -------------------------------------------------------------------------------------------------------
def office_texts(files: DataFrame) -> DataFrame:
    """file_path and Markdown text of the documents and presentations of ``walk``, by what their bytes are."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, data in zip(part["file_path"], part["content"]):
                try:
                    kind = sniff(bytes(data))
                    if kind in ("docx", "pptx"):
                        rows.append((path, read_docx(bytes(data)) if kind == "docx" else read_pptx(bytes(data)), None))
                except Exception as error:
                    rows.append((path, None, str(error)[:500]))
            yield pd.DataFrame(rows, columns=["file_path", "text", "error"])

    return files.select("file_path", "content").mapInPandas(run, "file_path string, text string, error string")


def sheet_cells(files: DataFrame) -> DataFrame:
    """Cells of the workbooks of ``walk``: file, sheet, row, col, kind, raw; an unreadable file gives one row with its error
    as kind ``error``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, data in zip(part["file_path"], part["content"]):
                try:
                    if sniff(bytes(data)) in ("xlsx", "xlsm"):
                        rows += [(path, *c) for c in read_cells(bytes(data))]
                except Exception as error:
                    rows.append((path, "", None, None, "error", str(error)[:500]))
            yield pd.DataFrame(rows, columns=["file", "sheet", "row", "col", "kind", "raw"]).astype({"row": "Int32", "col": "Int32"})

    return files.select("file_path", "content").mapInPandas(run, "file string, sheet string, row int, col int, kind string, raw string")


def office_errors(texts: DataFrame) -> DataFrame:
    return texts.where("error is not null").select("file_path", "error")


def plain_text(markdown: str) -> str:
    """Markdown without marks, for plain-text output."""
    out = re.sub(r"(?m)^#{1,6} ", "", markdown)
    out = re.sub(r"(\*\*|\*)(\S.*?)\1", r"\2", out)
    return re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", out)


def document_json(texts: DataFrame) -> DataFrame:
    return texts.select("file_path", F.to_json(F.struct("file_path", "text")).alias("json"))
