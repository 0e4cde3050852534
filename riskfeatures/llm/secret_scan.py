"""Secret scans with structural confirmation.

Base patterns (assignments, access-key ids, long hex runs) are reported as
found.  Beyond them, base64 and hex candidates are decoded and reported only
when the bytes parse as what they claim to be: ASN.1 key encodings whose nested
lengths add up, length-prefixed private-key containers, and signed tokens whose
header is a JSON object that names an algorithm.

Base64 may be wrapped: lines that follow each other, also by escaped line ends, are
joined (the first of at least 40 characters), and a DER key ends where its length
says.  A key may start behind '/', '_' or '-' of its run.  PEM may have header
lines; an encrypted PEM body counts if its headers name a cipher and it decodes to
whole cipher blocks.

Runs inside ``mapInArrow`` over whole texts: no shuffle, one pass, memory bound
by one Arrow batch.  Defined results: a null text counts as empty (no spans,
digest of the empty string); null ids are carried; repeated rows each get a
row; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import itertools
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# The base patterns; of a match, what must reach the least length.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
# Order of kinds in a listing of spans.
KINDS = ("assign", "access", "hex", "signed_token", "der_key", "key_container", "pem")

_KEYWORDS = ("passw", "secret", "token", "api")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{8,})(?![A-Za-z0-9_-])")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}")
_NEXT = re.compile(r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*([A-Za-z0-9+/_-]+)")
_PAD = re.compile(r"={0,2}")
_INNER = re.compile(r"(?<=[/_-])(?:M[A-P]|b3BlbnNzaC1rZXktdjEA)")
_LONG_HEX = re.compile(r"(?:[0-9a-fA-F]{2}){32,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:\s|\\[nr])*+(?:[A-Za-z0-9-]+:[^\n\\]*(?:\r?\n|(?:\\r)?\\n)(?:\s|\\[nr])*+)*)([A-Za-z0-9+/=][A-Za-z0-9+/=\s\\]*+)-----END \1-----")
# Object identifiers (DER bytes) of key algorithms: RSA, EC, Ed25519, X25519, DSA.
_KEY_OIDS = (bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201"), bytes.fromhex("2b6570"),
             bytes.fromhex("2b656e"), bytes.fromhex("2a8648ce380401"))
_CONTAINER = b"openssh-key-v1\x00"
_CONTAINER_B64 = "b3BlbnNzaC1rZXktdjEA"


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, content start and content end of the DER element at ``at``, if it fits."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(data[at:at + k], "big"), at + k
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def _children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill ``start:end`` exactly."""
    out = []
    while start < end:
        el = _tlv(data, start, end)
        if el is None:
            return None
        out.append(el)
        start = el[2]
    return out


def is_der_key(data: bytes) -> bool:
    """A DER sequence, filled exactly, shaped as a private or public key."""
    top = _tlv(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data) or len(data) < 32:
        return False
    kids = _children(data, top[1], top[2])
    if not kids:
        return False
    tags = [k[0] for k in kids]
    body = [data[k[1]:k[2]] for k in kids]
    if tags[0] == 0x02 and len(tags) >= 9 and set(tags[:9]) == {0x02}:          # integers of an RSA key
        return body[0] in (b"\x00", b"\x01") and len(body[1]) >= 32
    if tags[0] == 0x02 and len(tags) == 6 and set(tags) == {0x02}:              # integers of a DSA key
        return body[0] == b"\x00" and len(body[1]) >= 32
    if tags[:2] == [0x02, 0x04] and body[0] == b"\x01" and len(body[1]) >= 16:  # elliptic-curve key
        return all(t in (0xA0, 0xA1) for t in tags[2:])
    alg = 1 if tags[0] == 0x02 else 0                                           # algorithm, then the key itself
    if len(tags) > alg + 1 and tags[alg] == 0x30 and tags[alg + 1] in (0x03, 0x04):
        inner = _children(data, kids[alg][1], kids[alg][2])
        return bool(inner) and inner[0][0] == 0x06 and data[inner[0][1]:inner[0][2]] in _KEY_OIDS
    return False


def is_key_container(data: bytes) -> bool:
    """A private-key container: marker, then length-prefixed fields that fit."""
    if not data.startswith(_CONTAINER):
        return False
    at = len(_CONTAINER)
    for _ in range(3):  # cipher, key derivation and its options
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at:at + 4], "big")
    return at + 8 <= len(data) and 1 <= int.from_bytes(data[at:at + 4], "big") <= 16


def _container(body: str, p: int) -> tuple[bool, int | None]:
    """Whether a private-key container starts at ``p`` of base64 text (marker, then
    length-prefixed fields that fit), and the bytes up to the end of its last field, if that
    fits.  Decodes the lengths only, so it takes a few steps wherever it starts."""
    size = (len(body) - p) // 4 * 3

    def number(at: int) -> int | None:
        if at + 4 > size:
            return None
        got = _b64(body[p + at // 3 * 4:p + at // 3 * 4 + 8])
        return None if got is None else int.from_bytes(got[at % 3:at % 3 + 4].ljust(4, b"\0"), "big")

    at = len(_CONTAINER)
    for _ in range(3):  # cipher, key derivation and its options
        if (n := number(at)) is None:
            return False, None
        at += 4 + n
    keys = number(at)
    if keys is None or at + 8 > size or not 1 <= keys <= 16:
        return False, None
    at += 4
    for _ in range(keys + 1):  # public keys and the private part
        if (n := number(at)) is None:
            return True, None
        at += 4 + n
    return True, at if at <= size else None


def _base64_spans(text: str) -> list[tuple[int, int, str]]:
    out, pos = [], 0
    while m := _RUN.search(text, pos):
        lines, pos = [m.span()], m.end()
        while n := _NEXT.match(text, pos):
            lines.append(n.span(1))
            pos = n.end()
        joined = "".join(text[s:e] for s, e in lines)
        ends = list(itertools.accumulate(e - s for s, e in lines))
        done = 0
        for i, (s, e) in enumerate(lines):
            if e - s < 40:
                continue
            head = ends[i] - (e - s)
            for p in [head, *(x.start() for x in _INNER.finditer(joined, head, ends[i]) if x.start() > head)]:
                if p < done:
                    continue
                if "M" == joined[p] and "A" <= joined[p + 1:p + 2] <= "P":
                    size, kind = _der_size(_b64(joined[p:p + 8])), "der_key"
                elif joined.startswith(_CONTAINER_B64, p):
                    kind = "key_container"
                    fits, size = _container(joined, p)
                    if not fits:
                        continue
                else:
                    continue
                stop = p + -(-4 * size // 3) if size else 0
                last = bisect.bisect_left(ends, stop)
                if not size or last == len(ends) or ends[last] != stop:
                    if kind == "der_key":
                        continue
                    stop, last = ends[i], i  # the rest of the line, as it is
                data = _b64(joined[p:stop])
                if data is not None and (is_der_key(data) if kind == "der_key" else _container(joined[:stop], p)[0]):
                    out.append((s + p - head, _PAD.match(text, lines[last][1]).end(), kind))
                    done = stop
    return out


def _der_size(head: bytes | None) -> int | None:
    """Bytes of the DER sequence that starts with ``head``."""
    if head is None or len(head) < 6 or head[0] != 0x30:
        return None
    k = head[1] & 0x7F
    if not head[1] & 0x80:
        return 2 + head[1]
    return 2 + k + int.from_bytes(head[2:2 + k], "big") if 1 <= k <= 4 else None


def _b64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(head: str, claims: str, signature: str) -> bool:
    """Header is a JSON object that names an algorithm; the rest decodes."""
    raw = _b64(head)
    if raw is None or raw[:1] not in (b"{", b" ", b"\n", b"\t") or _b64(claims) is None or _b64(signature) is None:
        return False
    try:
        got = json.loads(raw)
    except (ValueError, RecursionError):
        return False
    return isinstance(got, dict) and isinstance(got.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out



def structural_spans(text: str) -> list[tuple[int, int, str]]:
    """Candidates that decode to a key or a signed token; each kind leftmost, non-overlapping."""
    out = []
    if "." in text:
        out += [(m.start(), m.end(), "signed_token") for m in _TOKEN.finditer(text) if is_signed_token(m[1], m[2], m[3])]
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            data = _b64(re.sub(r"\\[nr]|\s", "", m[3]))
            if data and (is_der_key(data) or "DEK-Info:" in m[2] and len(data) >= 32 and len(data) % 8 == 0 or is_key_container(data) or m[1].startswith("ENCRYPTED") and _tlv(data, 0, len(data))):
                out.append((m.start(), m.end(), "pem"))
    out += _base64_spans(text)
    for m in _LONG_HEX.finditer(text):
        data = bytes.fromhex(m[0])
        if is_der_key(data):
            out.append((m.start(), m.end(), "der_key"))
        elif is_key_container(data):
            out.append((m.start(), m.end(), "key_container"))
    return out


def listing(spans: list[tuple[int, int, str]]) -> str:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(set(spans), key=lambda x: (x[0], order[x[2]], x[1])))


def _scan(batches):
    for b in batches:
        base, every, counts = [], [], {k: [] for k in KINDS[:3]}
        for t in b.column(1):
            text = t.as_py() or ""
            found = base_spans(text)
            for k in counts:
                counts[k].append(sum(x[2] == k for x in found))
            base.append(hashlib.sha256(listing(found).encode()).hexdigest())
            every.append(listing(found + structural_spans(text)))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS[:3]), pa.array(base, pa.string()), pa.array(every, pa.string())],
            names=[b.schema.names[0], "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of base findings, their digest, and all spans
    (code points, end exclusive)."""
    src = docs.select(F.col(id_col), F.col(text_col))
    kind = src.schema[0].dataType.simpleString()
    return map_arrow(src, _scan, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
