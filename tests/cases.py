"""Small documents as table rows."""

from __future__ import annotations

from quirelint.model import Tables, tables


def frame(*texts, **element) -> dict:
    runs = element.pop("runs", {})
    levels = element.pop("levels", [None] * len(texts))
    return {"type": "text_frame", "is_title": False, "is_body": False, "is_placeholder": False, **element, "paragraphs": [{"text": t, "level": v, "runs": runs.get(i, [])} for i, (t, v) in enumerate(zip(texts, levels, strict=True))]}


def title(text: str) -> dict:
    return frame(text, is_title=True)


def table(*cells: dict) -> dict:
    return {"type": "table", "is_title": False, "cells": [{"row": 0, "col": i, **c} for i, c in enumerate(cells)]}


def page(*elements, **page_fields) -> dict:
    return {"elements": [frame(e) if isinstance(e, str) else e for e in elements], **page_fields}


def corpus(spark, docs: dict[str, tuple]) -> Tables:
    """docs: id -> (format, page, page, ...)."""
    rows: dict[str, list] = {k: [] for k in ("documents", "pages", "elements", "paragraphs", "runs", "cells")}
    for doc_id, (kind, *pages) in docs.items():
        base = {"doc_id": doc_id, "format": kind}
        rows["documents"].append(base | {"source_path": f"{doc_id}.{kind}", "custom_properties": {}, "page_count": len(pages)})
        for i, p in enumerate(pages):
            at = base | {"page_index": i}
            rows["pages"].append(at | {"slide_number": i + 1} | {k: v for k, v in p.items() if k != "elements"})
            for f, e in enumerate(p["elements"]):
                rows["elements"].append(at | {"flat_idx": f, "depth": 0} | {k: v for k, v in e.items() if k not in ("paragraphs", "cells")})
                for j, x in enumerate(e.get("paragraphs", [])):
                    rows["paragraphs"].append(at | {"flat_idx": f, "para_idx": j, "text": x["text"], "level": x["level"]})
                    rows["runs"] += [at | {"flat_idx": f, "para_idx": j, "run_idx": k, **r} for k, r in enumerate(x["runs"])]
                rows["cells"] += [at | {"flat_idx": f, **c} for c in e.get("cells", [])]
    return tables(spark, **rows)
