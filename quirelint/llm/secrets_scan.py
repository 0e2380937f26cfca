"""Secret scan with structural confirmation.

Base patterns give candidate spans; the method then decodes base64 and hex runs and reports those whose bytes
are a private key: DER whose nested lengths fill their parents and whose parts are those of PKCS #1 (version and
eight integers), DSA (version and five), SEC 1 (version 1 and octets), PKCS #8 (version, algorithm identifier,
octets that hold such a key again) or encrypted PKCS #8 (a password scheme and octets); OpenSSH private keys
whose length-prefixed fields follow the magic; PEM blocks around such bytes, or around encrypted ones that their headers
name; and signed tokens whose header is JSON with an algorithm and whose claims are JSON. Signatures, certificates and
public keys are no secrets and are left alone. Runs may be wrapped over lines of 16 letters or more, in JSON
strings too (a backslash and n); a key may start anywhere in a run and ends with one of its lines.

Positions are code points of the whole text, ends exclusive. Null texts count as empty;
repeated rows give equal rows; other columns are not read; an empty table gives an empty one; the time for a
very long text grows with its length.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table, type_of

#: kinds, in the order in which equal starts are listed
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "openssh")

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones may be passed over by the pattern
#: three parts in base64url; a header begins with { or white space, so with one of these letters
JWT = re.compile(r"(?<![A-Za-z0-9_-])[CDIe][A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+")
GAP = r"(?:\s|\\[nrt])"
PEM = re.compile(rf"-----BEGIN ([A-Z0-9 ]++)-----((?>{GAP}*+[A-Za-z][A-Za-z0-9-]*+:(?:[^\r\n\\]|\\[^nr])*+)*+)((?:[A-Za-z0-9+/=\s]|\\[nrt/])++)-----END \1-----")
ENCRYPTED = re.compile(r"Proc-Type:\s*4,\s*ENCRYPTED(?s:.)*DEK-Info:")
#: lines of 16 letters at least, but for the last; in JSON strings / may be escaped too
BREAK = r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*"
BASE64 = re.compile(rf"(?:[A-Za-z0-9+_-]|\\?/){{16,}}+(?:{BREAK}(?:[A-Za-z0-9+_-]|\\?/){{16,}}+)*+(?:{BREAK}(?:[A-Za-z0-9+_-]|\\?/)++)?={{0,2}}")
LETTERS = re.compile(rf"{BREAK}|(?:[A-Za-z0-9+/_-]|\\(?=/))+")
#: what 0x30 and a length of 22 or more, or the magic, begin with
KEY_START = re.compile(r"(?=M[B-I])|(?=b3BlbnNzaC1rZXktdjEA)")
ANY_HEX = re.compile(r"[0-9a-fA-F]{48,}")
HEX_START = re.compile(r"(?i:(?=30[1-7][0-9a-f]|308[1-4])|(?=6f70656e7373682d6b65792d763100))")
OPENSSH = b"openssh-key-v1\0"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def der_node(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start and end of the contents) of the element at ``at``, if it fits before ``end``."""
    if at + 2 > end:
        return None
    tag, size, pos = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or pos + n > end or data[pos] == 0:
            return None
        size, pos = int.from_bytes(data[pos : pos + n], "big"), pos + n
        if size < 0x80:
            return None
    return (tag, pos, pos + size) if tag & 0x1F != 0x1F and pos + size <= end else None


def der_parts(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start and end of the contents) of the elements that fill data[at:end] exactly, if some do."""
    out = []
    while at < end:
        node = der_node(data, at, end)
        if node is None:
            return None
        out.append(node)
        at = node[2]
    return out


INTEGER, OCTETS, OBJECT, SEQUENCE = 0x02, 0x04, 0x06, 0x30
# fixed values: object identifiers (their contents) of algorithms, and what those of password schemes begin with
RSA, EC = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201")
EDWARDS = bytes.fromhex("2b65")
PASSWORD_SCHEMES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def algorithm(data: bytes, start: int, end: int) -> bytes | None:
    """The object identifier of an algorithm identifier's contents."""
    parts = der_parts(data, start, end)
    return data[parts[0][1] : parts[0][2]] if parts and parts[0][0] == OBJECT and len(parts) <= 2 else None


def is_private_key(data: bytes, start: int = 0, end: int | None = None) -> bool:
    """Whether data[start:end] is one sequence with the parts of a private key."""
    end = len(data) if end is None else end
    top = der_node(data, start, end)
    if top is None or top[0] != SEQUENCE or top[2] != end:
        return False
    parts = der_parts(data, top[1], end) or []
    tags = [t for t, *_ in parts]
    value = [data[a:b] for _, a, b in parts]
    if tags[:2] == [SEQUENCE, OCTETS] and len(parts) == 2:
        return (algorithm(data, *parts[0][1:]) or b"").startswith(PASSWORD_SCHEMES) and len(value[1]) >= 8
    if not parts or tags[0] != INTEGER or value[0] not in (b"\0", b"\1"):
        return False
    if all(t == INTEGER for t in tags):
        # the modulus, or a prime, comes second; positive numbers
        return len(parts) in (6, 9) and value[0] == b"\0" and all(v and not v[0] & 0x80 for v in value) and len(value[1]) >= 16
    if tags[:10] == [INTEGER] * 9 + [SEQUENCE] and len(parts) == 10:  # more than two primes
        return value[0] == b"\1"
    if tags[1] == OCTETS:
        return value[0] == b"\1" and len(value[1]) >= 16 and tags[2:] in ([], [0xA0], [0xA1], [0xA0, 0xA1])
    if tags[1:3] != [SEQUENCE, OCTETS] or not set(tags[3:]) <= {0xA0, 0x81, 0xA1}:
        return False
    kind, inner = algorithm(data, *parts[1][1:]), parts[2][1:]
    if kind in (RSA, EC):
        return is_private_key(data, *inner)
    if kind and kind.startswith(EDWARDS) and len(kind) == 3:
        inside = der_parts(data, *inner)
        return bool(inside) and [t for t, *_ in inside] == [OCTETS] and inside[0][2] - inside[0][1] >= 32
    return bool(kind) and bool(der_parts(data, *inner))


def key_kind(data: bytes) -> str | None:
    """der: a private key; openssh: magic and length-prefixed fields."""
    if data.startswith(OPENSSH):
        at, fields = len(OPENSSH), []
        for k in range(6):  # cipher, kdf, kdf options, number of keys, public key, private part
            if at + 4 > len(data):
                return None
            (size,) = struct.unpack_from(">I", data, at)
            at += 4
            if k == 3:
                if not 1 <= size <= 16:
                    return None
                continue
            if at + size > len(data):
                return None
            fields.append(data[at : at + size])
            at += size
        return "openssh" if fields[0].isascii() and fields[0] and fields[3][:4] == struct.pack(">I", len(fields[3][4 : 4 + int.from_bytes(fields[3][:4], "big")])) else None
    return "der" if data[:1] == b"\x30" and is_private_key(data) else None


def is_pem_key(m: re.Match) -> bool:
    body = unbase64(m[3]) or b""
    if m[2] and m[1].endswith("PRIVATE KEY") and ENCRYPTED.search(m[2]):
        return len(body) >= 24 and len(body) % 8 == 0
    return key_kind(body) is not None


def unbase64(text: str) -> bytes | None:
    """Either alphabet, padded or not; None if it can't be base64."""
    text = re.sub(r"\s+|\\[nrt]|\\(?=/)", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def _json(part: str):
    data = unbase64(part)
    try:
        return json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None


def is_signed_token(text: str) -> bool:
    head, claims, signature = text.split(".")
    head = _json(head)
    if not isinstance(head, dict) or not isinstance(head.get("alg"), str) or not isinstance(_json(claims), dict):
        return False
    return not signature if head["alg"].lower() == "none" else bool(unbase64(signature))


def _size(head: bytes) -> int:
    """Bytes of the DER key that starts so, 0 if none does."""
    if len(head) < 7 or head[0] != SEQUENCE:
        return 0
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if n > 4 or head[1] == 0x80 or head[2 + n] not in (INTEGER, SEQUENCE):  # a version or an algorithm comes first
        return 0
    return 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])


def _openssh_size(part, limit: int) -> int:
    """Bytes of the OpenSSH key of which ``part(n)`` gives the first n, 0 if none of up to ``limit`` bytes is there."""
    at = len(OPENSSH)
    for k in range(6):
        head = part(at + 4)[at : at + 4]
        at += 4 + (int.from_bytes(head, "big") if k != 3 else 0)
        if len(head) < 4 or at > limit:
            return 0
    return at


def _keys(letters: str, ends: list[int], starts: re.Pattern, decoded, width: tuple[int, int]):
    """(kind, start, end) of keys in a run, each up to one of ``ends``; ``width``: so many letters hold so many bytes."""
    per, of = width
    done = 0
    for m in starts.finditer(letters):
        at = m.start()
        if at < done:
            continue
        if letters[at] in "M3":
            size = _size(decoded(letters[at : at + 8 * per]) or b"")
        else:
            size = _openssh_size(lambda n, at=at: decoded(letters[at : at + -(-n // of) * per]) or b"", (len(letters) - at) * of // per)
        k = bisect.bisect_left(ends, at - (-size * per // of))
        if size < 24 or k == len(ends) or letters[at] in "M3" and ends[k] - at >= -(-(size + 1) * per // of):
            continue
        if kind := key_kind(decoded(letters[at : ends[k]]) or b""):
            yield kind, at, ends[k]
            done = ends[k]


def _unhex(text: str) -> bytes:
    return bytes.fromhex(text[: len(text) // 2 * 2])


def _base64_keys(text: str, start: int, end: int):
    places, ends = [], []
    for m in LETTERS.finditer(text, start, end):
        if text[m.start()] in " \t\r\n" or text[m.start()] == "\\" and text[m.start() + 1 : m.start() + 2] != "/":
            ends.append(len(places))
        else:
            places += [i for i in range(*m.span()) if text[i] != "\\"]
    ends.append(len(places))
    letters = "".join([text[i] for i in places])
    for kind, a, b in _keys(letters, ends, KEY_START, unbase64, (4, 3)):
        to = places[b - 1] + 1
        while to < len(text) and text[to] == "=" and to < places[b - 1] + 3:
            to += 1
        yield kind, places[a], to


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("jwt", *m.span()) for m in JWT.finditer(text) if is_signed_token(m[0])]
    pems = [m.span() for m in PEM.finditer(text) if is_pem_key(m)] if "-----BEGIN " in text else []
    found = [k for m in BASE64.finditer(text) if KEY_START.search(m[0]) for k in _base64_keys(text, *m.span())]
    for m in ANY_HEX.finditer(text):
        found += [(kind, m.start() + a, m.start() + b) for kind, a, b in _keys(m[0], [len(m[0])], HEX_START, _unhex, (2, 1))]
    starts = [a for a, _ in pems]

    def in_pem(at: int) -> bool:
        k = bisect.bisect_right(starts, at) - 1
        return k >= 0 and at < pems[k][1]

    return out + [("pem", a, b) for a, b in pems] + [k for k in found if not in_pem(k[1])]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def _scanner(id_col: str):
    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                kinds = [s[0] for s in base]
                rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + confirmed_spans(text or ""))))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, [pa.int64()] * 3 + [pa.string()] * 2, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *cols], [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans)."""
    return arrow_map(docs.select(id_col, F.col(text_col).alias("text")), _scanner(id_col), f"{id_col} {type_of(docs, id_col)}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with each run of overlapping spans replaced by ``mark``; null texts stay null."""

    def clean(text: str) -> str:
        merged: list[list[int]] = []
        for _, a, b in sorted(base_spans(text) + confirmed_spans(text), key=lambda s: s[1:]):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        out, at = [], 0
        for a, b in merged:
            out += [text[at:a], mark]
            at = b
        return "".join(out) + text[at:] if out else text

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            texts = pa.array([x if x is None else clean(x) for x in batch.column(k).to_pylist()], batch.schema.field(k).type)
            yield batch.set_column(k, batch.schema.field(k), texts)

    return arrow_map(docs, run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))


def op8_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
