"""An optional grammar service on this machine: page segments are posted in chunks, its matches become findings.

``choose`` picks the tier: a service that answers, else one started from a jar, else None for the checks in
``operators.language``. Requests run on the executors, one task a partition, so the service must run beside each of them.
"""

from __future__ import annotations

import atexit
import json
import shutil
import subprocess
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelint.model import Tables
from quirelint.operators.findings import findings, page_label
from quirelint.operators.language import segments
from quirelint.plans.rules import Config

# fixed values: hosts allowed, request size and time limit, severities of issue types, categories left out
DEFAULT_URL = "http://localhost:8010/v2"
HOSTS = {"localhost", "127.0.0.1", "::1"}
CHUNK, TIMEOUT = 15_000, 30
SEVERITY = {"misspelling": "error", "grammar": "error", "duplication": "warning", "style": "warning", "hint": "info", "typographical": "info"}
LEFT_OUT = {"TYPOGRAPHY"}
LANGUAGES = {"zh": "zh-CN", "en": "en-US"}
SCHEMA = "doc_id string, page_index int, page_number int, seg int, lang string, start int, rule string, message string, category string, severity string, context string, suggestion string"

Post = Callable[[str, str], list[dict]]


def checked_url(url: str) -> str:
    """The URL, if it is of this machine."""
    if urllib.parse.urlsplit(url).hostname not in HOSTS:
        raise ValueError(f"the grammar service must be on this machine: {url}")
    return url.rstrip("/")


def available(url: str) -> bool:
    """Whether a service answers there."""
    try:
        with urllib.request.urlopen(f"{checked_url(url)}/languages", timeout=3) as answer:
            return answer.status == 200
    except OSError:
        return False


def start(jar: str, port: int = 8081, wait: int = 30) -> subprocess.Popen | None:
    """Starts the service of a jar on this machine; None if it doesn't answer in time."""
    process = subprocess.Popen(["java", "-Xmx1g", "-cp", jar, "org.languagetool.server.HTTPServer", "--port", str(port)], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    for _ in range(wait):
        if available(f"http://localhost:{port}/v2"):
            return process
        if process.poll() is not None:
            break
        time.sleep(1)
    process.kill()
    return None


def choose(url: str | None, jar: str | None = None, port: int = 8081) -> Post | None:
    """What asks the service, by tier; None: no service."""
    if available(url or DEFAULT_URL):
        return http_post(url or DEFAULT_URL)
    if jar and shutil.which("java") and (process := start(jar, port)):
        atexit.register(process.kill)
        return http_post(f"http://localhost:{port}/v2")
    return None


def http_post(url: str) -> Post:
    base = checked_url(url)

    def post(text: str, language: str) -> list[dict]:
        body = urllib.parse.urlencode({"text": text, "language": language}).encode()
        with urllib.request.urlopen(f"{base}/check", body, timeout=TIMEOUT) as answer:
            return json.load(answer).get("matches", [])

    return post


def matches(text: str, language: str, post: Post) -> Iterator[dict]:
    """Matches with offsets in the whole text; the first chunk that fails is the last."""
    for at in range(0, len(text), CHUNK):
        try:
            found = post(text[at : at + CHUNK], language)
        except (OSError, ValueError):
            return
        yield from ({**m, "offset": m.get("offset", 0) + at} for m in found)


def _row(m: dict, accepted: frozenset[str]) -> dict | None:
    rule, context = m.get("rule") or {}, m.get("context") if isinstance(m.get("context"), dict) else {}
    category = (rule.get("category") or {}).get("id", "")
    said, at, size = context.get("text", ""), context.get("offset", 0), context.get("length", 0)
    if category in LEFT_OUT or size > 0 and said[at : at + size].lower() in accepted:
        return None
    better = [r.get("value", "") for r in m.get("replacements", [])[:3]]
    return {
        "start": m["offset"], "rule": rule.get("id", ""), "message": m.get("message", "语法问题"), "category": category, "severity": SEVERITY.get(rule.get("issueType", ""), "warning"), "context": said[:120] or None,
        "suggestion": "建议改为: " + " / ".join(better) if better else None,
    }


def service_findings(t: Tables, c: Config, post: Post | None = None) -> DataFrame:
    """Findings of the service named in the configuration (or of ``post``), less words that the vocabulary accepts."""
    ask, accepted = post or http_post(c.service_url or DEFAULT_URL), frozenset(c.accepted)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                found = (_row(m, accepted) for m in matches(r.text, LANGUAGES[r.lang], ask))
                rows += [{"doc_id": r.doc_id, "page_index": r.page_index, "page_number": r.page_number, "seg": r.seg, "lang": r.lang, **x} for x in found if x]
            yield pd.DataFrame(rows, columns=names)

    rows = segments(t).mapInPandas(run, SCHEMA)
    details = F.to_json(F.struct(F.col("lang").alias("language"), "category"))
    out = findings(rows.withColumn("message", F.concat(F.lit(""), "message")), "language", "", None, F.col("message"), page=F.col("page_index"), context=F.col("context"), suggestion=F.col("suggestion"), location=page_label(), metadata=F.to_json(F.struct("rule", "severity", details.alias("d"))), seq=["page_index", "seg", "start"])
    said = lambda k: F.get_json_object("metadata", f"$.{k}")
    return out.withColumns({"rule_id": said("rule"), "severity": said("severity"), "metadata": said("d")})
