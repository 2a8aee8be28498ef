"""Secret scans with structural confirmation.

Three base patterns are reported as they match. Beyond them, runs of base64 or
hex characters are decoded, and reported only if what comes out has the
structure of a secret: a signed token whose first part is a JSON header with an
algorithm (``jwt``), a PEM block whose body decodes to a key or, behind the
headers of the older encrypted form, to whole cipher blocks (``pem``), or a bare key: DER with lengths nested exactly, or an OpenSSH private key
(``key``). Patterns run over UTF-8 bytes, as all of their characters are ASCII;
offsets are turned into code points for the matches only.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import slices, texts

#: Order of kinds among spans with one start.
KINDS = ("assign", "access", "hex", "jwt", "pem", "key")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")
_URL_RUN = re.compile(rb"[A-Za-z0-9_-]*+")
_BREAK = rb"(?:\s|\\r|\\n)"
_PEM = re.compile(
    rb"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----"
    rb"(?:" + _BREAK + rb"*Proc-Type: ?4,ENCRYPTED" + _BREAK + rb"+DEK-Info: ?[A-Z0-9-]+,([0-9A-F]{16}(?:[0-9A-F]{16})?)(?=" + _BREAK + rb"))?"
    rb"([A-Za-z0-9+/=\s\\rn]+?)-----END \1-----"
)
_RUN = re.compile(rb"[A-Za-z0-9+/_-]{40,}={0,2}")
_HEX_RUN = re.compile(rb"[0-9A-Fa-f]{64,}")
_SSH = b"openssh-key-v1\x00"
#: Values side by side in any of the key encodings, with room to spare.
MOST_ITEMS = 32


def decode64(run: bytes) -> bytes | None:
    """The bytes of a base64 run of either alphabet, padded or not; None if it can't be one."""
    run = run.rstrip(b"=")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run.replace(b"-", b"+").replace(b"_", b"/") + b"=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[start:end] exactly; None if lengths don't nest, or for more values than a key has."""
    items: list[tuple[int, int, int]] = []
    while start < end:
        if len(items) == MOST_ITEMS:
            return None
        if start + 2 > end:
            return None
        tag, length, at = data[start], data[start + 1], start + 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            length, at = int.from_bytes(data[at : at + n], "big"), at + n
            if length < 0x80:
                return None
        if at + length > end:
            return None
        items.append((tag, at, at + length))
        start = at + length
    return items


def is_der_key(data: bytes) -> bool:
    """Whether the bytes are one private key in DER: PKCS#1, SEC1, PKCS#8 or encrypted PKCS#8."""
    outer = der_items(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_items(data, *outer[0][1:])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _, _ in inner]
    if tags[0] == 0x02 and inner[0][2] - inner[0][1] == 1:
        if len(inner) >= 9 and set(tags[:9]) == {0x02}:
            return True
        if tags[1] == 0x04 and inner[1][2] - inner[1][1] >= 16:
            return True
        if len(inner) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:
            algorithm = der_items(data, *inner[1][1:])
            return bool(algorithm) and algorithm[0][0] == 0x06
    if tags[:2] == [0x30, 0x04] and len(inner) == 2:
        algorithm = der_items(data, *inner[0][1:])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return False


def is_ssh_key(data: bytes) -> bool:
    """Whether the bytes are an OpenSSH private key: its magic, then length-prefixed fields that stay inside."""
    if not data.startswith(_SSH):
        return False
    at = len(_SSH)
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at + 4 <= len(data)


def is_key(data: bytes | None) -> bool:
    return bool(data) and (data[:1] == b"\x30" and is_der_key(data) or is_ssh_key(data))


def is_jwt(token: bytes) -> bool:
    """Whether a token's header decodes to a JSON object with an algorithm, and its payload to a JSON object.

    JSON nested too deeply to be parsed is no signed token's.
    """
    head, body, signature = token.split(b".")
    try:
        header, payload = (json.loads(decode64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    if not (isinstance(header, dict) and isinstance(payload, dict) and isinstance(header.get("alg"), str)):
        return False
    return header["alg"].lower() == "none" or len(decode64(signature) or b"") >= 16


def jwt_spans(text: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of signed tokens: the first ``eyJ`` of a run up to a dot, a second run, a dot and what follows.

    Each run is read a bounded number of times, however many ``eyJ`` it holds.
    """

    def run(at: int) -> int:
        return _URL_RUN.match(text, at).end()

    at = text.find(b"eyJ")
    while at >= 0:
        head = run(at)
        body = run(head + 1) if text[head : head + 1] == b"." else head
        end = head
        if body > head + 1 and text[body : body + 1] == b"." and is_jwt(text[at : run(body + 1)]):
            end = run(body + 1)
            yield at, end
        at = text.find(b"eyJ", end)


def is_encrypted_body(data: bytes | None, vector: bytes) -> bool:
    """Whether the bytes are whole blocks of the cipher that takes ``vector`` (in hex), as a key's would be."""
    return bool(data) and len(data) >= 32 and len(data) % (len(vector) // 2) == 0


def find_secrets(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, by start, then kind. Base kinds first come from their patterns alone."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    found += [("jwt", *x) for x in jwt_spans(text)]
    pem: list[tuple[int, int]] = []
    if b"PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            body = decode64(re.sub(rb"\\r|\\n|\s", b"", m[3]))
            if is_key(body) or m[2] and is_encrypted_body(body, m[2]):
                found.append(("pem", m.start(), m.end()))
                pem.append(m.span())
    passed = 0
    for m in _RUN.finditer(text):
        while passed < len(pem) and pem[passed][1] <= m.start():
            passed += 1
        if passed < len(pem) and pem[passed][0] <= m.start():
            continue
        if is_key(decode64(m[0])):
            found.append(("key", m.start(), m.end()))
    for m in _HEX_RUN.finditer(text):
        if len(m[0]) % 2 == 0 and is_key(bytes.fromhex(m[0].decode())):
            found.append(("key", m.start(), m.end()))
    return sorted(set(found), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def to_code_points(text: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    if not spans or text.isascii():
        return spans
    at = {}
    points = last = 0
    for offset in sorted({x for _, s, e in spans for x in (s, e)}):
        points += len(text[last:offset].decode("utf-8", "surrogatepass"))
        at[offset], last = points, offset
    return [(k, at[s], at[e]) for k, s, e in spans]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts of base matches, their digest, and all spans.

    Spans are ``kind:start:end`` in code points, end exclusive. A null text
    counts as empty; a null doc_id stays null; repeated rows give repeated rows;
    other columns are ignored; an empty table gives no rows. Time is linear in
    the text, whatever it holds. Map-only: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text in texts(batch, "text"):
                spans = to_code_points(text, find_secrets(text))
                said = [f"{k}:{s}:{e}" for k, s, e in spans]
                base = ",".join(x for x, (k, _, _) in zip(said, spans) if k in KINDS[:3])
                kinds = [k for k, _, _ in spans]
                out.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(base.encode()).hexdigest(), ",".join(said)))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*out), types))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
