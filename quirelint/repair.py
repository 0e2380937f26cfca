"""Repairs: what a run, shape or title would be changed to, as column expressions, and the same written back into files.

The plan (``run_fixes``, ``moves``) is a DataFrame over the tables; ``patch`` applies it to the file's XML on the executors,
leaving every other part of the package as it is. Only top-level shapes and body paragraphs are touched.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelint.functions.text import TRAILING_PUNCTUATION, space_mixed
from quirelint.model import Tables
from quirelint.plans.rules import Config
from quirelint.sources.ooxml import TITLES, A, P, Package, W

# fixed values: least size in points, the bullet that others become
LEAST_SIZE, BULLET = 12, "•"
KINDS = ("font", "spacing", "overflow", "punct", "bullet")


def fixed_font(font: Column, c: Config) -> Column:
    return F.when(font.isNotNull() & (font != "") & ~font.isin(list(c.allowed_fonts)), F.lit(c.allowed_fonts[0])).otherwise(font)


def fixed_size(size: Column) -> Column:
    return F.when((size > 0) & (size < LEAST_SIZE), F.lit(float(LEAST_SIZE))).otherwise(size)


def without_end_marks(text: Column) -> Column:
    return F.regexp_replace(text, TRAILING_PUNCTUATION, "")


def one_bullet(text: Column, bullet: str = BULLET) -> Column:
    return F.regexp_replace(text, r"(?U)^(\s*)[-*](?=\s)", f"$1{bullet}")


def run_fixes(t: Tables, c: Config, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Runs that a repair changes, with new font_name, font_name_east_asia, font_size and text, in the order of ``KINDS``."""
    top = t.elements.where("depth = 0 and type = 'text_frame'").select("doc_id", "page_index", "flat_idx", "is_title", "shape_name")
    rows = t.runs.where("format in ('pptx', 'docx')").join(top, ["doc_id", "page_index", "flat_idx"])
    text, new = F.coalesce("text", F.lit("")), {}
    if "font" in kinds:
        latin = fixed_font(F.col("font_name"), c)
        replaced = ~latin.eqNullSafe(F.col("font_name"))
        east = F.when(F.coalesce("font_name_east_asia", F.lit("")) == "", F.when(replaced, F.lit(c.allowed_fonts[0])).otherwise(F.col("font_name_east_asia"))).otherwise(fixed_font(F.col("font_name_east_asia"), c))
        new = {"new_font": latin, "new_east": east, "new_size": fixed_size(F.col("font_size"))}
    if "spacing" in kinds:
        text = space_mixed(text)
    slides = F.col("format") == "pptx"
    if "punct" in kinds:
        title = F.col("is_title") | F.coalesce(F.lower("shape_name").contains("title"), F.lit(False))
        text = F.when(slides & title, without_end_marks(text)).otherwise(text)
    if "bullet" in kinds:
        text = F.when(slides, one_bullet(text)).otherwise(text)
    rows = rows.withColumns({"new_font": F.col("font_name"), "new_east": F.col("font_name_east_asia"), "new_size": F.col("font_size"), **new, "new_text": text})
    pairs = (("font_name", "new_font"), ("font_name_east_asia", "new_east"), ("font_size", "new_size"))
    changes = [(~F.col(a).eqNullSafe(F.col(b))).cast("int") for a, b in pairs] + [(F.coalesce("text", F.lit("")) != F.col("new_text")).cast("int")]
    return rows.withColumn("fixes", sum(changes[1:], changes[0])).where("fixes > 0")


def moves(t: Tables) -> DataFrame:
    """Top-level shapes of slides moved inside: first from the left and top, then from the right and bottom, never beyond 0."""
    size = t.documents.where("format = 'pptx'").select("doc_id", F.expr("custom_properties['slide_width']").alias("sw"), F.expr("custom_properties['slide_height']").alias("sh"))
    rows = t.elements.where("depth = 0 and left is not null and width is not null").join(size, "doc_id")

    def inside(at: str, extent: str, whole: str) -> Column:
        start = F.greatest(F.col(at), F.lit(0.0))
        return F.when(start + F.col(extent) > F.col(whole), F.greatest(F.lit(0.0), F.col(whole) - F.col(extent))).otherwise(start)

    rows = rows.withColumn("new_left", inside("left", "width", "sw")).withColumn("new_top", inside("top", "height", "sh"))
    return rows.where("left <> new_left or top <> new_top")


def fix_count(fixes: DataFrame) -> int:
    return fixes.agg(F.coalesce(F.sum("fixes"), F.lit(0))).first()[0]


class _Patch:
    def __init__(self, c: Config, kinds: tuple[str, ...]) -> None:
        self.fonts, self.kinds, self.count = list(c.allowed_fonts), kinds, 0

    def set(self, e: ET.Element, key: str, value: str) -> None:
        e.set(key, value)
        self.count += 1

    def text(self, e: ET.Element | None, title: bool, slides: bool) -> None:
        if e is None or not e.text:
            return
        new = e.text
        if "spacing" in self.kinds:
            cjk = "[一-鿿㐀-䶿豈-﫿]"
            new = re.sub(rf"([a-zA-Z0-9])({cjk})", r"\1 \2", re.sub(rf"({cjk})([a-zA-Z0-9])", r"\1 \2", new))
        if "punct" in self.kinds and slides and title:
            new = re.sub(TRAILING_PUNCTUATION, "", new)
        if "bullet" in self.kinds and slides:
            new = re.sub(r"^(\s*)[-*](?=\s)", rf"\1{BULLET}", new)
        if new != e.text:
            e.text = new
            if new != new.strip() and e.tag == f"{W}t":
                e.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
            self.count += 1

    def slide(self, root: ET.Element, width: int, height: int) -> None:
        for shape in root.find(f"{P}cSld/{P}spTree"):
            off, ext = shape.find(f".//{A}xfrm/{A}off"), shape.find(f".//{A}xfrm/{A}ext")
            if shape.tag == f"{P}graphicFrame":
                off, ext = shape.find(f"{P}xfrm/{A}off"), shape.find(f"{P}xfrm/{A}ext")
            if "overflow" in self.kinds and off is not None and ext is not None:
                for at, extent, whole in (("x", "cx", width), ("y", "cy", height)):
                    start, size = int(off.get(at)), int(ext.get(extent))
                    new = max(0, start)
                    new = max(0, whole - size) if new + size > whole else new
                    if new != start:
                        self.set(off, at, str(new))
            if shape.tag != f"{P}sp":
                continue
            mark, named = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph"), shape.find(f"{P}nvSpPr/{P}cNvPr")
            title = mark is not None and mark.get("type") in TITLES or named is not None and "title" in named.get("name", "").lower()
            for r in shape.iterfind(f"{P}txBody/{A}p/{A}r"):
                if "font" in self.kinds:
                    self.slide_font(r.find(f"{A}rPr"))
                self.text(r.find(f"{A}t"), title, True)

    def slide_font(self, rpr: ET.Element | None) -> None:
        if rpr is None:
            return
        latin, east = rpr.find(f"{A}latin"), rpr.find(f"{A}ea")
        off_list = lambda e: e is not None and e.get("typeface") and e.get("typeface") not in self.fonts
        if replaced := off_list(latin):
            self.set(latin, "typeface", self.fonts[0])
        if off_list(east):
            self.set(east, "typeface", self.fonts[0])
        elif east is None and replaced:
            east = ET.Element(f"{A}ea")
            rpr.insert(list(rpr).index(latin) + 1, east)
            self.set(east, "typeface", self.fonts[0])
        if rpr.get("sz") and int(rpr.get("sz")) < LEAST_SIZE * 100:
            self.set(rpr, "sz", str(LEAST_SIZE * 100))

    def body(self, root: ET.Element) -> None:
        for r in root.iterfind(f"{W}body/{W}p/{W}r"):
            rpr = r.find(f"{W}rPr")
            if "font" in self.kinds and rpr is not None:
                fonts, size = rpr.find(f"{W}rFonts"), rpr.find(f"{W}sz")
                if fonts is not None:
                    replaced = fonts.get(f"{W}ascii") not in (None, "", *self.fonts)
                    if replaced:
                        self.set(fonts, f"{W}ascii", self.fonts[0])
                        fonts.set(f"{W}hAnsi", self.fonts[0])
                    east = fonts.get(f"{W}eastAsia")
                    if east not in self.fonts and (east or replaced):
                        self.set(fonts, f"{W}eastAsia", self.fonts[0])
                if size is not None and float(size.get(f"{W}val")) < 2 * LEAST_SIZE:
                    self.set(size, f"{W}val", str(2 * LEAST_SIZE))
            self.text(r.find(f"{W}t"), False, False)


def patch_file(path: str, data: bytes, c: Config, kinds: tuple[str, ...] = KINDS) -> tuple[bytes, int]:
    """The repaired package and the number of repairs; parts without any are copied byte for byte."""
    slides = path.lower().endswith(".pptx")
    if not slides and not path.lower().endswith(".docx"):
        raise ValueError(f"only .pptx and .docx are repaired: {path}")
    package, patch, out = Package(data), _Patch(c, kinds), io.BytesIO()
    start = package.start()
    parts = {t for k, t in package.relations(start).values() if k == "slide"} if slides else {start}
    size = package.xml(start).find(f"{P}sldSz") if slides else None
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for info in package.zip.infolist():
            raw = package.zip.read(info.filename)
            if info.filename in parts:
                for _, (prefix, uri) in ET.iterparse(io.BytesIO(raw), events=["start-ns"]):
                    if not re.fullmatch(r"ns\d+", prefix):
                        ET.register_namespace(prefix, uri)
                root, before = ET.fromstring(raw), patch.count
                patch.slide(root, int(size.get("cx")), int(size.get("cy"))) if slides else patch.body(root)
                if patch.count > before:
                    raw = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
            target.writestr(info, raw)
    return out.getvalue(), patch.count


def patch(files: DataFrame, c: Config, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(path, content, fixes, error) of (path, content) rows; a file that fails keeps its content."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows.append((path, *patch_file(path, content, c, kinds), None))
                except Exception as e:  # reported with the file
                    rows.append((path, content, 0, f"{type(e).__name__}: {e}"))
            cols = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.binary(), pa.int32(), pa.string()), strict=True)], ["path", "content", "fixes", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary, fixes int, error string")


