"""Secret scans with structural confirmation.

Three base patterns find assignments, access keys and long hex runs. The method
then decodes every base64 or hex candidate and reports it only if the bytes
have the structure of a key: nested ASN.1 lengths that close exactly, SSH
length-prefixed fields, or a signed token whose header is JSON with an `alg`.

Cases: a null or empty text has no spans; very long texts are scanned whole, and
only texts in which a vectorised byte scan sees a possible start are given to
the regular expressions; repeated rows each give a row; extra columns are not
read; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyspark.llm import textkernel as tk

#: The kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "jwt", "der", "ssh", "pem")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Fixed patterns of the base scan (letters of the keyword in either case, ASCII only).
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}|[0-9A-Fa-f]{24,}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
SSH_NAME = re.compile(rb"(ssh|ecdsa|sk-ssh|sk-ecdsa)-[a-z0-9@.-]+")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

_not_hex = np.ones(256, dtype=bool)
_not_hex[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = False
_not_run = np.ones(256, dtype=bool)
_not_run[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_-"]] = False


def decode64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(b: bytes, at: int, end: int, depth: int = 0) -> list[tuple[int, int]] | None:
    """(tag, items inside) of the ASN.1 values that fill b[at:end] exactly."""
    out: list[tuple[int, int]] = []
    while at < end:
        if at + 2 > end or depth > 12:
            return None
        tag, n = b[at], b[at + 1]
        at += 2
        if n & 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > end:
                return None
            n = int.from_bytes(b[at : at + size], "big")
            at += size
            if n < 0x80:
                return None
        if at + n > end:
            return None
        inner = 0
        if tag & 0x20:
            found = der_items(b, at, at + n, depth + 1)
            if found is None:
                return None
            inner = len(found)
        out.append((tag, inner))
        at += n
    return out


def is_der_key(b: bytes) -> bool:
    """One sequence, closed exactly, of at least two values such as keys hold."""
    if len(b) < 16 or b[0] != 0x30:
        return False
    outer = der_items(b, 0, len(b))
    if outer is None or len(outer) != 1 or outer[0][1] < 2:
        return False
    head = 2 + (b[1] & 0x7F if b[1] & 0x80 else 0)
    inside = der_items(b, head, len(b)) or []
    return all(tag in (0x02, 0x03, 0x04, 0x05, 0x06, 0x30, 0x31, 0xA0, 0xA1, 0xA3) for tag, _ in inside)


def is_ssh_key(b: bytes) -> bool:
    if b.startswith(b"openssh-key-v1\0"):
        return True
    at, fields = 0, []
    while at + 4 <= len(b):
        n = int.from_bytes(b[at : at + 4], "big")
        if at + 4 + n > len(b):
            return False
        fields.append(b[at + 4 : at + 4 + n])
        at += 4 + n
    return at == len(b) and len(fields) >= 2 and bool(SSH_NAME.fullmatch(fields[0]))


def is_signed_token(s: str) -> bool:
    parts = s.split(".")
    if len(parts) != 3:
        return False
    try:
        head, body = (json.loads(decode64(p) or b"") for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict) and bool(decode64(parts[2]))


def structure(s: str) -> str | None:
    """The kind of key that a base64 or hex candidate decodes to."""
    forms = [decode64(s)]
    if HEXADECIMAL.fullmatch(s) and len(s) % 2 == 0:
        forms.append(bytes.fromhex(s))
    for b in forms:
        if b:
            if is_der_key(b):
                return "der"
            if is_ssh_key(b):
                return "ssh"
    return None


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, added spans), each as (start, kind's index, end), sorted."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    more = [(m.start(), 6, m.end()) for m in PEM.finditer(text) if structure(re.sub(r"\s+", "", m[2]))]
    taken = [(a, b) for a, _, b in more]
    for m in TOKEN.finditer(text):
        if is_signed_token(m[0]):
            more.append((m.start(), 3, m.end()))
            taken.append(m.span())
    for m in RUN.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b in taken) and (kind := structure(m[0])):
            more.append((m.start(), KINDS.index(kind), m.end()))
    return sorted(base), sorted(more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def suspects(texts: pa.Array) -> np.ndarray:
    """Which texts may hold any span: every pattern needs one of these bytes."""
    out = np.zeros(len(texts), dtype=bool)
    for first, _, data, offsets in tk.chunks(texts):
        hits = []
        for apart in (_not_hex, _not_run):
            starts, ends, _ = tk.words(data, offsets, apart)
            hits.append(starts[ends - starts >= 24])
        for whole, words in ((data, ("AKIA", "-----BEGIN")), (tk.LOWER[data], KEYWORDS)):
            whole = whole.tobytes()
            for word in words:
                at, found = whole.find(word.encode()), []
                while at >= 0:
                    found.append(at)
                    at = whole.find(word.encode(), at + 1)
                hits.append(np.array(found, dtype=np.int64))
        # a signed token has two dots between runs, each shorter than the runs above
        dots = np.flatnonzero(data == 0x2E)
        inner = dots[(dots > 7) & (dots < len(data) - 8)]
        inner = inner[~_not_run[data[inner - 1]] & ~_not_run[data[inner + 1]] & ~_not_run[data[inner - 8]] & ~_not_run[data[inner + 8]]]
        hits.append(inner)
        at = np.concatenate(hits)
        out[first + np.searchsorted(offsets, at, side="right") - 1] = True
    return out


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document with its spans; only a scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            texts = batch.column(1)
            n = batch.num_rows
            counts = np.zeros((3, n), dtype=np.int64)
            digests, spans = [none] * n, [""] * n
            for i in np.flatnonzero(suspects(texts)):
                base, more = scan(texts[int(i)].as_py() or "")
                for _, k, _ in base:
                    counts[k, i] += 1
                digests[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[i] = joined(sorted(base + more))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)
