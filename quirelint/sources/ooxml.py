"""Presentations and word-processor files (ECMA-376) as the document model, by zip and XML only.

Formatting is what a run itself says; styles and themes aren't resolved. Elements are given in a pre-order walk, with
groups kept and their children's own coordinates.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

A, P, R = "{http://schemas.openxmlformats.org/drawingml/2006/main}", "{http://schemas.openxmlformats.org/presentationml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
W, C = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
CORE = {"title": "{http://purl.org/dc/elements/1.1/}title", "author": "{http://purl.org/dc/elements/1.1/}creator", "created": "{http://purl.org/dc/terms/}created", "modified": "{http://purl.org/dc/terms/}modified"}
EMU, PAGE_ELEMENTS = 12700, 40
# fixed values: names of alignments, and which placeholders are titles and bodies
SLIDE_ALIGNMENT = {"l": "left", "ctr": "center", "r": "right", "just": "justify"}
WORD_ALIGNMENT = {"left": "left", "start": "left", "center": "center", "right": "right", "end": "right", "both": "justify"}
TITLES, BODIES = {"title", "ctrTitle"}, {"body", "subTitle"}


class Package:
    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ET.Element | None:
        return ET.fromstring(self.zip.read(name)) if name in self.names else None

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """id -> (kind, target part)."""
        folder, name = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{name}.rels".lstrip("/"))
        found = {}
        for r in [] if root is None else root:
            target = r.get("Target", "")
            found[r.get("Id")] = (r.get("Type", "").rsplit("/", 1)[-1], posixpath.normpath(target[1:] if target.startswith("/") else posixpath.join(folder, target)))
        return found

    def start(self) -> str:
        return next(t for kind, t in self.relations("").values() if kind == "officeDocument")

    def core(self) -> dict:
        found = [t for kind, t in self.relations("").values() if kind == "core-properties"]
        root = self.xml(found[0]) if found else None
        out = {k: None if root is None else root.findtext(tag) for k, tag in CORE.items()}
        for k in ("created", "modified"):
            out[k] = re.sub(r"^(\d{4}-\d\d-\d\d)T(\d\d:\d\d:\d\d).*$", r"\1 \2+00:00", out[k]) if out[k] else None
        return out


def points(emu: str | int | None) -> float | None:
    return None if emu is None else round(int(emu) / EMU, 2)


def flag(value: str | None) -> bool | None:
    return None if value is None else value not in ("0", "false", "off", "none")


# --- presentations


def _colour(rpr: ET.Element | None) -> str | None:
    found = None if rpr is None else rpr.find(f"{A}solidFill/{A}srgbClr")
    return None if found is None else found.get("val", "").upper()


def _slide_run(i: int, r: ET.Element) -> dict:
    rpr = r.find(f"{A}rPr")
    get = (lambda k: None) if rpr is None else rpr.get
    face = lambda tag: None if rpr is None or rpr.find(A + tag) is None else rpr.find(A + tag).get("typeface")
    return {
        "run_idx": i, "text": r.findtext(f"{A}t") or "", "font_name": face("latin"), "font_name_east_asia": face("ea"), "font_size": int(get("sz")) / 100 if get("sz") else None, "bold": flag(get("b")), "italic": flag(get("i")),
        "underline": flag(get("u")), "strikethrough": None if get("strike") is None else get("strike") != "noStrike", "color": _colour(rpr),
    }


def _spacing(ppr: ET.Element | None, tag: str, lines: bool = False) -> float | None:
    found = None if ppr is None else ppr.find(A + tag)
    if found is None:
        return None
    exact, share = found.find(f"{A}spcPts"), found.find(f"{A}spcPct")
    if exact is not None:
        return int(exact.get("val")) / 100
    return int(share.get("val")) / 100_000 if lines and share is not None else None


def _slide_paragraph(i: int, p: ET.Element) -> dict:
    ppr = p.find(f"{A}pPr")
    text = "".join("\v" if x.tag == f"{A}br" else x.findtext(f"{A}t") or "" for x in p if x.tag in (f"{A}r", f"{A}br", f"{A}fld"))
    get = (lambda k: None) if ppr is None else ppr.get
    return {
        "para_idx": i, "text": text, "level": int(get("lvl") or 0), "alignment": SLIDE_ALIGNMENT.get(get("algn")), "space_before": _spacing(ppr, "spcBef") or None, "space_after": _spacing(ppr, "spcAft") or None,
        "line_spacing": _spacing(ppr, "lnSpc", True) or None, "runs": [_slide_run(k, r) for k, r in enumerate(p.findall(f"{A}r"))],
    }


def _place(shape: ET.Element, path: str) -> dict:
    off, ext = shape.find(f"{path}/{A}off"), shape.find(f"{path}/{A}ext")
    at = lambda e, k: None if e is None else points(e.get(k))
    return {"left": at(off, "x"), "top": at(off, "y"), "width": at(ext, "cx"), "height": at(ext, "cy")}


def _slide_table(table: ET.Element) -> list[dict]:
    cells = []
    for i, row in enumerate(table.findall(f"{A}tr")):
        for j, cell in enumerate(row.findall(f"{A}tc")):
            paragraphs = [_slide_paragraph(0, p) for p in cell.findall(f"{A}txBody/{A}p")]
            first = (paragraphs[0]["runs"] or [{}])[0] if paragraphs else {}
            cells.append({
                "row": i, "col": j, "rowspan": int(cell.get("rowSpan", 1)), "colspan": int(cell.get("gridSpan", 1)), "text": "\n".join(p["text"] for p in paragraphs).strip(), "font_name": first.get("font_name"),
                "font_size": first.get("font_size"), "font_color": first.get("color"), "fill_color": _colour(cell.find(f"{A}tcPr")),
            })
    return cells


def _shape(shape: ET.Element, relations: dict, package: Package) -> dict | None:
    """One element without its children; None for what isn't modelled."""
    tag = shape.tag.removeprefix(P)
    named = shape.find(f".//{P}cNvPr")
    out = {"shape_name": None if named is None else named.get("name"), "is_title": False, "is_body": False, "is_placeholder": False, "paragraphs": [], "cells": []}
    if tag == "grpSp":
        return out | {"type": "group"} | _place(shape, f"{P}grpSpPr/{A}xfrm")
    if tag == "graphicFrame":
        out |= _place(shape, f"{P}xfrm")
        table, chart = shape.find(f".//{A}tbl"), shape.find(f".//{C}chart")
        if table is not None:
            cells = _slide_table(table)
            return out | {"type": "table", "cells": cells} if table.find(f"{A}tr") is not None else None
        if chart is not None:
            root = package.xml(relations.get(chart.get(f"{R}id"), ("", ""))[1])
            kinds = [] if root is None else [x.tag.removeprefix(C) for x in root.findall(f".//{C}plotArea/*") if x.tag.endswith("Chart")]
            return out | {"type": "chart", "chart_type": kinds[0] if kinds else None}
        return None
    out |= _place(shape, f"{P}spPr/{A}xfrm")
    if tag == "pic":
        blip = shape.find(f".//{A}blip")
        target = relations.get(blip.get(f"{R}embed"), ("", ""))[1] if blip is not None else ""
        ext = target.rsplit(".", 1)[-1].lower() if "." in target else "unknown"
        return out | {"type": "image", "image_ext": {"jpg": "jpeg"}.get(ext, ext)}
    if tag == "sp":
        mark = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
        kind = None if mark is None else mark.get("type", "obj")
        paragraphs = [_slide_paragraph(i, p) for i, p in enumerate(shape.findall(f"{P}txBody/{A}p"))]
        return out | {"type": "text_frame", "paragraphs": paragraphs, "is_placeholder": mark is not None, "is_title": kind in TITLES, "is_body": kind in BODIES}
    return None


def _walk(shapes: ET.Element, relations: dict, package: Package, out: list[dict], warnings: list[str], parent: int | None = None, depth: int = 0) -> None:
    for shape in shapes:
        if not shape.tag.startswith(P) or shape.tag in (f"{P}nvGrpSpPr", f"{P}grpSpPr"):
            continue
        try:
            element = _shape(shape, relations, package)
        except (ValueError, TypeError, AttributeError, KeyError, IndexError) as e:
            warnings.append(f"shape skipped: {e}")
            continue
        if element is None:
            continue
        at = len(out)
        out.append(element | {"flat_idx": at, "parent_idx": parent, "depth": depth})
        if element["type"] == "group":
            _walk(shape, relations, package, out, warnings, at, depth + 1)


def parse_pptx(source: str, data: bytes) -> dict:
    package, warnings = Package(data), []
    start = package.start()
    root, relations = package.xml(start), package.relations(start)
    size = root.find(f"{P}sldSz")
    pages = []
    for i, entry in enumerate(root.findall(f"{P}sldIdLst/{P}sldId")):
        part = relations[entry.get(f"{R}id")][1]
        slide, own = package.xml(part), package.relations(part)
        target = lambda kind, own=own: next((t for k, t in own.values() if k == kind), "")
        layout, notes = package.xml(target("slideLayout")), package.xml(target("notesSlide"))
        name = None if layout is None or layout.find(f"{P}cSld") is None else layout.find(f"{P}cSld").get("name", "")
        said = ""
        for shape in [] if notes is None else notes.iter(f"{P}sp"):
            mark = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
            if mark is not None and mark.get("type") == "body":
                said = "\n".join(_slide_paragraph(0, p)["text"] for p in shape.findall(f"{P}txBody/{A}p")).strip()
                break
        elements: list[dict] = []
        _walk(slide.find(f"{P}cSld/{P}spTree"), own, package, elements, warnings)
        pages.append({"page_index": i, "slide_number": i + 1, "layout_name": name, "notes": said or None, "elements": elements})
    sizes = {} if size is None else {"slide_width": points(size.get("cx")), "slide_height": points(size.get("cy"))}
    return {"doc_id": source, "source_path": source, "format": "pptx", **package.core(), "slide_count": len(pages), "page_count": len(pages), "custom_properties": sizes, "warnings": warnings, "pages": pages}


# --- word-processor files


def _val(parent: ET.Element | None, path: str, key: str = "val") -> str | None:
    found = None if parent is None else parent.find(path)
    return None if found is None else found.get(W + key)


def _on(rpr: ET.Element | None, tag: str) -> bool | None:
    return None if rpr is None or rpr.find(W + tag) is None else flag(_val(rpr, W + tag) or "1")


def _text(r: ET.Element) -> str:
    out = []
    for x in r:
        if x.tag == f"{W}t":
            out.append(x.text or "")
        elif x.tag in (f"{W}tab", f"{W}ptab"):
            out.append("\t")
        elif x.tag == f"{W}cr" or x.tag == f"{W}br" and x.get(f"{W}type", "textWrapping") == "textWrapping":
            out.append("\n")
        elif x.tag == f"{W}noBreakHyphen":
            out.append("-")
    return "".join(out)


def _word_run(i: int, r: ET.Element) -> dict:
    rpr = r.find(f"{W}rPr")
    size, colour, underline = _val(rpr, f"{W}sz"), _val(rpr, f"{W}color"), _val(rpr, f"{W}u")
    return {
        "run_idx": i, "text": _text(r), "font_name": _val(rpr, f"{W}rFonts", "ascii"), "font_name_east_asia": _val(rpr, f"{W}rFonts", "eastAsia"), "font_size": float(size) / 2 if size else None, "bold": _on(rpr, "b"), "italic": _on(rpr, "i"),
        "underline": flag(underline), "strikethrough": _on(rpr, "strike"), "color": colour.upper() if colour and re.fullmatch("[0-9a-fA-F]{6}", colour) else None,
    }


def _plain(p: ET.Element) -> str:
    return "".join(_text(r) for x in p for r in ([x] if x.tag == f"{W}r" else x.findall(f"{W}r") if x.tag == f"{W}hyperlink" else []))


def _twips(value: str | None) -> float | None:
    return None if value is None else int(value) / 20


def _word_paragraph(p: ET.Element, styles: dict[str, tuple[str, int | None]]) -> dict | None:
    ppr = p.find(f"{W}pPr")
    runs, text = [_word_run(i, r) for i, r in enumerate(p.findall(f"{W}r"))], _plain(p)
    if not text.strip() and not runs:
        return None
    style, of_style = styles.get(_val(ppr, f"{W}pStyle") or "", styles.get("", ("Normal", None)))
    level = _val(ppr, f"{W}outlineLvl")
    level = int(level) if level is not None else None
    heading = "heading" in (style or "").lower()
    if heading and level is None:
        m = re.match(r"^Heading\s+(\d+)$", style, re.I)
        level = of_style if of_style is not None else int(m[1]) - 1 if m else None
    line, rule = _val(ppr, f"{W}spacing", "line"), _val(ppr, f"{W}spacing", "lineRule")
    spacing = None if line is None else int(line) / 240 if rule in (None, "auto") else int(line) / 20
    paragraph = {
        "para_idx": 0, "text": text, "level": level, "alignment": WORD_ALIGNMENT.get(_val(ppr, f"{W}jc")), "space_before": _twips(_val(ppr, f"{W}spacing", "before")), "space_after": _twips(_val(ppr, f"{W}spacing", "after")),
        "line_spacing": spacing, "runs": runs,
    }
    return {"type": "text_frame", "style_name": style, "is_title": heading and level is not None and level <= 1, "is_body": not heading, "paragraphs": [paragraph], "cells": []}


def _word_table(table: ET.Element) -> dict | None:
    cells = []
    for i, row in enumerate(table.findall(f"{W}tr")):
        col = 0
        for cell in row.findall(f"{W}tc"):
            tcpr = cell.find(f"{W}tcPr")
            paragraphs = cell.findall(f"{W}p")
            runs = paragraphs[0].findall(f"{W}r") if paragraphs else []
            first = _word_run(0, runs[0]) if runs else {}
            fill = _val(tcpr, f"{W}shd", "fill")
            span = int(_val(tcpr, f"{W}gridSpan") or 1)
            for _ in range(span):  # a cell that spans columns stands in each
                cells.append({
                    "row": i, "col": col, "rowspan": 1, "colspan": 1, "text": "\n".join(map(_plain, paragraphs)).strip(), "font_name": first.get("font_name"), "font_size": first.get("font_size"), "font_color": first.get("color"),
                    "fill_color": fill.upper() if fill and fill.lower() != "auto" else None,
                })
                col += 1
    return {"type": "table", "is_title": False, "is_body": False, "paragraphs": [], "cells": cells} if table.find(f"{W}tr") is not None else None


def _styles(root: ET.Element | None) -> dict[str, tuple[str, int | None]]:
    out: dict[str, tuple[str, int | None]] = {}
    for s in [] if root is None else root.findall(f"{W}style"):
        level = _val(s, f"{W}pPr/{W}outlineLvl")
        name = _val(s, f"{W}name") or s.get(f"{W}styleId", "")
        name = re.sub(r"^heading (\d)$", r"Heading \1", name)
        out[s.get(f"{W}styleId", "")] = entry = (name, None if level is None else int(level))
        if s.get(f"{W}type") == "paragraph" and s.get(f"{W}default") in ("1", "true"):
            out[""] = entry
    return out


def _pages(elements: list[dict]) -> list[list[dict]]:
    """A page before each heading of the first two levels, and after 40 elements."""
    pages: list[list[dict]] = [[]]
    for e in elements:
        level = e["paragraphs"][0]["level"] if e["paragraphs"] else None
        if pages[-1] and (level is not None and level <= 1 or len(pages[-1]) == PAGE_ELEMENTS):
            pages.append([])
        pages[-1].append(e | {"flat_idx": len(pages[-1]), "depth": 0, "is_placeholder": False})
    return pages


def parse_docx(source: str, data: bytes) -> dict:
    package, warnings = Package(data), []
    start = package.start()
    relations = package.relations(start)
    body = package.xml(start).find(f"{W}body")
    part = lambda kind: next((t for k, t in relations.values() if k == kind), "")
    styles = _styles(package.xml(part("styles")))
    blocks = [y for x in body for y in (x.find(f"{W}sdtContent") or [] if x.tag == f"{W}sdt" else [x])]
    found = [_word_paragraph(x, styles) if x.tag == f"{W}p" else _word_table(x) if x.tag == f"{W}tbl" else None for x in blocks]
    if body.find(f".//{W}txbxContent") is not None:
        warnings.append("text boxes are not read")
    for kind, target in relations.values():
        root = package.xml(target) if kind in ("header", "footer") else None
        if kind == "footnotes":
            warnings.append("footnotes are not read")
        elif root is not None and any(_plain(p).strip() for p in root.iter(f"{W}p")):
            warnings.append("headers and footers are not read")
    pages = _pages([e for e in found if e is not None])
    count = sum(len(_plain(p).split()) for p in body.findall(f"{W}p"))
    return {
        "doc_id": source, "source_path": source, "format": "docx", **package.core(), "word_count": count, "page_count": len(pages), "custom_properties": {}, "warnings": warnings,
        "pages": [{"page_index": i, "slide_number": i + 1, "elements": e} for i, e in enumerate(pages)],
    }
