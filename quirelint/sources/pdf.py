"""PDF files as the document model, by the layout analysis of docling where it is installed.

An analysis gives items with the pages that they lie on: texts with labels or levels, and tables. Each becomes
(page, place, element) for every page it touches, items without a page going to the first, and
pages are put together from these. Older analyses list items by page; both kinds are read as the same stream.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from pathlib import PurePosixPath
from typing import Any

# fixed values: heading levels of labels
LEVELS = {"title": 1, "section_header": 2}


def analyse(source: str, data: bytes) -> Any:
    try:
        from docling.datamodel.base_models import DocumentStream
        from docling.document_converter import DocumentConverter
    except ImportError as e:
        raise ImportError("PDF files need the package docling") from e
    return DocumentConverter().convert(DocumentStream(name=PurePosixPath(source).name, stream=io.BytesIO(data))).document


def text_frame(item: Any, plain: bool = False) -> dict | None:
    text = str(getattr(item, "text", "" if plain else item) or "").strip()
    if not text:
        return None
    label = getattr(item, "label", None)
    level = None if plain else getattr(item, "heading_level", None)
    if level is None and not plain:
        level = LEVELS.get(str(getattr(label, "value", label)))
    return {"type": "text_frame", "is_title": level == 1, "paragraphs": [{"para_idx": 0, "text": text, "level": level, "runs": []}], "cells": []}


def table(item: Any) -> dict | None:
    if hasattr(item, "export_to_dataframe"):
        frame = item.export_to_dataframe()
        rows = [] if frame is None else [[(j, "" if v is None else str(v)) for j, v in enumerate(r)] for r in frame.itertuples(index=False)]
    else:
        by_row: dict[int, list] = {}
        for c in getattr(item, "cells", None) or []:
            by_row.setdefault(getattr(c, "row", 0), []).append((getattr(c, "col", 0), str(getattr(c, "text", "")).strip()))
        rows = [by_row[r] for r in sorted(by_row)]
    cells = [{"row": i, "col": j, "rowspan": 1, "colspan": 1, "text": x} for i, row in enumerate(rows) for j, x in row]
    return {"type": "table", "is_title": False, "paragraphs": [], "cells": cells} if cells else None


def _safely(make, item) -> dict | None:
    try:
        return make(item)
    except Exception:  # an item that can't be read must not stop its page
        return None


def placed(doc: Any) -> Iterator[tuple[Any, dict]]:
    """(page key or None, element) of each item, texts before tables."""
    for key, page in sorted((doc.pages or {}).items()):
        if hasattr(page, "cells"):
            yield from ((key, e) for x in page.cells if (e := _safely(lambda c: text_frame(c, plain=True), x)))
            continue
        yield from ((key, e) for x in getattr(page, "items", None) or [] if (e := _safely(text_frame, x)))
        yield from ((key, e) for x in getattr(page, "tables", None) or [] if (e := _safely(table, x)))
    for items, make in ((getattr(doc, "texts", None), text_frame), (getattr(doc, "tables", None), table)):
        for x in items or []:
            element = _safely(make, x)
            if element:
                on = [p.page_no for p in getattr(x, "prov", None) or [] if getattr(p, "page_no", None) is not None]
                yield from ((key, element) for key in on or [None])


def pages_of(doc: Any) -> list[list[dict]]:
    keys = sorted(doc.pages or {})
    if not keys:
        parts = [x.strip() for x in doc.export_to_markdown().split("\n\n---\n\n")]
        return [[text_frame(x)] for x in parts if x] or [[]]
    by_key: dict[Any, list[dict]] = {k: [] for k in keys}
    for key, element in sorted(placed(doc), key=lambda x: x[1]["type"] == "table"):
        by_key.get(keys[0] if key is None else key, []).append(element)
    return list(by_key.values())


def parse(source: str, data: bytes) -> dict:
    """A row of ``model.NESTED``, keys left out being null."""
    pages = pages_of(analyse(source, data))
    rows = [[e | {"flat_idx": i, "depth": 0, "is_body": False, "is_placeholder": False} for i, e in enumerate(page)] for page in pages]
    return {
        "doc_id": source, "source_path": source, "format": "pdf", "title": PurePosixPath(source).stem, "page_count": len(rows), "custom_properties": {}, "warnings": [],
        "pages": [{"page_index": i, "slide_number": i + 1, "elements": e} for i, e in enumerate(rows)],
    }
