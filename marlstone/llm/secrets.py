"""Operator 10: secret scans. Candidates are decoded, and reported only where their structure holds."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame

from marlstone.llm.common import map_rows

# Fixed patterns of the base kinds; letters of the keywords match in either case (ASCII only).
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# Candidates that the method decodes.
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----((?:\s*[A-Za-z0-9-]+: [^\r\n]*)*)([A-Za-z0-9+/=\s]{16,}?)-----END \1-----")
TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*")
BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
HEXES = re.compile(r"[0-9a-f]{48,}|[0-9A-F]{48,}")

KINDS = ("assign", "access", "hex", "pem", "jwt", "b64key", "hexkey")


def private_der(data: bytes) -> bool:
    """True if ``data`` is one DER SEQUENCE, its nested lengths adding up exactly, with the fields of a private key.

    Those are a version of 0 or 1 before the numbers of a PKCS#1 or DSA key, the algorithm of a
    PKCS#8 one or the octets of a SEC1 one; or an algorithm before the octets of an encrypted
    PKCS#8 key. Public keys and certificates have others.
    """
    if data[:1] != b"\x30" or _der(data, 0, len(data), 0) != len(data):
        return False
    at, fields = _body(data, 0), []
    while at < len(data):
        end = _der(data, at, len(data), 1)
        fields.append((data[at], data[_body(data, at) : end]))
        at = end
    if len(fields) < 2:
        return False
    (tag, value), (following, _) = fields[:2]
    if tag == 0x02 and value in (b"\0", b"\1"):
        return following in (0x04, 0x30) or following == 0x02 and len(fields) >= 5
    return tag == 0x30 and following == 0x04 and len(fields) == 2


def _body(data: bytes, at: int) -> int:
    """Where the contents of the element at ``at`` begin."""
    size = data[at + 1]
    return at + 2 + (size & 127 if size & 128 else 0)


def _der(data: bytes, at: int, end: int, depth: int) -> int:
    """The offset behind the element at ``at``; -1 if it isn't well formed."""
    if at + 2 > end or depth > 16:
        return -1
    tag, size, at = data[at], data[at + 1], at + 2
    if tag & 31 == 31:
        return -1
    if size & 128:
        n = size & 127
        if not 0 < n <= 4 or at + n > end:
            return -1
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 128:
            return -1
    if at + size > end or tag == 0x02 and size == 0:
        return -1
    if tag & 32:
        inner = at
        while inner < at + size:
            inner = _der(data, inner, at + size, depth + 1)
            if inner < 0:
                return -1
    return at + size


def private_ssh(data: bytes) -> bool:
    """True for an OpenSSH private key whose length-prefixed head fields add up; public ones lack its mark."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):  # cipher, key derivation, its options
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at + 4 <= len(data) and 0 < int.from_bytes(data[at : at + 4], "big") < 16


def private_key(data: bytes) -> bool:
    return len(data) >= 24 and (private_der(data) or private_ssh(data))


def private_pem(label: str, head: str, body: str) -> bool:
    """True if a PEM block holds a private key; one with the head of an encrypted key holds whole cipher blocks instead."""
    data = _base64(body)
    if "ENCRYPTED" in head and "DEK-Info:" in head:
        return label.endswith("PRIVATE KEY") and len(data) >= 24 and len(data) % 8 == 0
    return private_key(data)


def _base64(text: str) -> bytes:
    text = re.sub(r"\s+", "", text).rstrip("=")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def signed_token(text: str) -> bool:
    """True if the first part decodes to a JSON object that names an algorithm and the second to JSON."""
    parts = text.split(".")
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(p + "=" * (-len(p) % 4))) for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """All spans of a text, one for a key (none for what stands in a PEM block), as (start, index of kind, end), sorted; offsets are code points, end exclusive."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    blocks = [(m.start(), 3, m.end()) for m in PEM.finditer(text) if private_pem(m[1], m[2], m[3])] if "-----BEGIN " in text else []
    if "eyJ" in text:
        found += [(m.start(), 4, m.end()) for m in TOKEN.finditer(text) if signed_token(m[0])]
    keys = [(m.start(), 5, m.end()) for m in BASE64.finditer(text) if private_key(_base64(m[0]))]
    keys += [(m.start(), 6, m.end()) for m in HEXES.finditer(text) if not len(m[0]) % 2 and private_key(bytes.fromhex(m[0]))]
    found += blocks + [k for k in keys if not any(s < k[0] and k[2] < e for s, _, e in blocks)]
    return sorted(found)


def scan_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its spans: ``doc_id, found array<struct<kind, start, end, value>>``.

    Null and empty texts have an empty array. Rows are independent: null ids, repeated rows and
    empty tables pass through; other columns are not read. Texts are scanned whole.
    """

    def run(ids: list, texts: list) -> list:
        rows = [[{"kind": KINDS[k], "start": s, "end": e, "value": t[s:e]} for s, k, e in scan(t)] for t in texts]
        return [ids, rows]

    return map_rows(df, [id_col, text_col], run, f"doc_id {df.schema[id_col].dataType.simpleString()}, found array<struct<kind:string,start:long,end:long,value:string>>")


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def base_digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(joined([x for x in spans if x[1] < 3]).encode()).hexdigest()
