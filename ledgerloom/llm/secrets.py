"""Secret scans: structural confirmation.

Base kinds are patterns alone (assign, access, hex). The method adds kinds that are reported only
after a candidate has been decoded and its structure holds:

jwt   three base64url parts; the first is a JSON object (spaced as it likes) with a string "alg", the second a
      JSON object or empty (a detached one)
pem   a BEGIN/END PRIVATE KEY block whose body decodes to DER or an OpenSSH key
ssh   base64 of an OpenSSH private key (names of cipher and derivation, options, the counted public keys and the
      private part fill it exactly), or of a public key whose length-prefixed fields do
der   base64 or hex of a DER SEQUENCE whose nested lengths fill it exactly and that begins as a
      private key does (a version INTEGER), an encrypted one (an algorithm SEQUENCE with an OID and
      parameters, an OCTET STRING) or a public key (an algorithm SEQUENCE with an OID, a BIT STRING)

Hex of der is of either case. Base64 may stand right after any sign, also one of its own alphabet, as in
key=..., path/... and name_...: each place of a run that can begin a key is tried. It may be wrapped over lines (of 32
signs or more but for the last), without any armour.

Spans are of code points, end exclusive; kinds are ordered assign, access, hex, jwt, pem, ssh,
der. Rows are read one by one: no shuffle, memory for one batch of texts and the longest one.

Cases: a null or empty text has no spans; repeated rows each get a row; null ids are passed on; an
empty table gives an empty result; other columns are ignored. A match may lie within another
kind's; both are reported.
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
from pyspark.sql import functions as F

from ledgerloom.llm.words import slices

OPENSSH = b"openssh-key-v1\0"
KINDS = ("assign", "access", "hex", "jwt", "pem", "ssh", "der")
BASE = KINDS[:3]

# The base patterns (letters of the first group in either ASCII case).
ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
KEYWORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")

# a run that may end with a signed token's header, and what must follow it
JWT_RUN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}+(?=\.)")
JWT_REST = re.compile(r"\.([A-Za-z0-9_-]*)\.[A-Za-z0-9_-]+")
# "{" or white space begins the header's JSON
JWT_START = re.compile(r"(?:^|(?<=[_-]))[eICD]")
JSON_START = re.compile(rb'[ \t\r\n]*(?:\{[ \t\r\n]*(?:"|$)|$)')
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?=M|AAAA|b3Bl)(?:[A-Za-z0-9+/]{32,}+\r?\n[ \t]*)+[A-Za-z0-9+/]++={0,2}")
PEM = re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")
B64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
# DER begins with 0x30 (M), an SSH field with three zero bytes, OpenSSH with its name
KEY_START = re.compile(r"(?:^|(?<=[+/_-]))(?=M|AAAA|b3Bl)")
HEX_DER = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{14,}")


def unbase64(text: str) -> bytes | None:
    """Decoded plain or URL-safe base64, with or without padding; None if it is neither."""
    text = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start of content, end of content) of the item at `at`, if its length is minimal and
    stays within `end`."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n = int.from_bytes(data[at : at + k], "big")
        if n < 0x80 or data[at] == 0:
            return None
        at += k
    return (tag, at, at + n) if at + n <= end else None


def der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """Items that fill [at, end) exactly; constructed ones are checked all the way down."""
    out = []
    stack = [(at, end, out)]
    while stack:
        at, end, into = stack.pop()
        while at < end:
            item = der_item(data, at, end)
            if item is None:
                return None
            if into is not None:
                into.append(item)
            if item[0] & 0x20:
                stack.append((item[1], item[2], None))
            at = item[2]
    return out


def is_der_key(data: bytes) -> bool:
    top = der_item(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    items = der_items(data, top[1], top[2])
    if not items or len(items) < 2:
        return False
    tag, a, b = items[0]
    if tag == 0x02:  # a version, then a number, an algorithm or the key itself
        return b - a == 1 and data[a] <= 3 and items[1][0] in (0x02, 0x04, 0x30)
    if tag == 0x30:
        inner = der_items(data, a, b)
        if not inner or inner[0][0] != 0x06:
            return False
        if items[1][0] == 0x03:  # an algorithm, then the key as bits
            return True
        # an encryption, always with parameters (a digest's are null), then the encrypted key
        return len(items) == 2 and items[1][0] == 0x04 and len(inner) == 2 and inner[1][0] == 0x30
    return False


def ssh_fields(data: bytes, at: int, n: int | None = None) -> tuple[list[bytes], int] | None:
    """(n length-prefixed fields, or all up to the end, and where they end); None if a length goes beyond the end."""
    fields = []
    while at < len(data) if n is None else len(fields) < n:
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return fields, at


def is_ssh_public(data: bytes) -> bool:
    got = ssh_fields(data, 0)
    return got is not None and len(got[0]) >= 2 and got[0][0].startswith((b"ssh-", b"ecdsa-sha2-", b"sk-"))


def is_ssh_key(data: bytes) -> bool:
    if not data.startswith(OPENSSH):
        return is_ssh_public(data)
    head = ssh_fields(data, len(OPENSSH), 3)  # cipher, key derivation, its options
    if head is None or not (head[0][0].isascii() and head[0][0] and head[0][1].isascii() and head[0][1]):
        return False
    count = int.from_bytes(data[head[1] : head[1] + 4], "big")
    if not 1 <= count <= 64:
        return False
    keys = ssh_fields(data, head[1] + 4, count + 1)
    return keys is not None and keys[1] == len(data) and all(map(is_ssh_public, keys[0][:-1])) and len(keys[0][-1]) >= 8


def key_kind(run: str) -> int | None:
    """Place of ssh or der in KINDS if this base64 is such a key. A few bytes turn away most."""
    head, size = unbase64(run[:64].rstrip("=")[: len(run[:64].rstrip("=")) // 4 * 4]), len(run.rstrip("=")) * 3 // 4
    if not head:
        return None
    if head[0] == 0x30:
        k = head[1] & 0x7F if head[1] >= 0x80 else 0
        if 2 + k + (int.from_bytes(head[2 : 2 + k], "big") if k else head[1]) != size:
            return None
    elif not head.startswith(OPENSSH) and not head[4:].startswith((b"ssh-", b"ecdsa-sha2-", b"sk-")):
        return None
    raw = unbase64(run)
    if raw and is_ssh_key(raw):
        return 5
    return 6 if raw and is_der_key(raw) else None


def _json_object(part: str) -> dict | None:
    raw = unbase64(part)
    try:
        got = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def signed_tokens(text: str) -> list[tuple[int, int]]:
    out = []
    for run in JWT_RUN.finditer(text):
        head = run.group()
        for start in JWT_START.finditer(head):
            begins = unbase64(head[start.start() : start.start() + 16][: (len(head) - start.start()) // 4 * 4])
            if not begins or not JSON_START.match(begins):
                continue
            rest = JWT_REST.match(text, run.end())
            if rest is None:
                break
            fields = _json_object(head[start.start() :])
            if fields and isinstance(fields.get("alg"), str) and (not rest[1] or _json_object(rest[1]) is not None):
                out.append((run.start() + start.start(), rest.end()))
                break
    return out


def wrapped_keys(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of keys over two lines or more; words may follow on the next line."""
    out = []
    for m in WRAPPED.finditer(text):
        whole = m.group()
        less = whole[: whole.rindex("\n")].rstrip()
        for body in (whole, less) if "\n" in less else (whole,):
            kind = key_kind("".join(body.split()))
            if kind is not None:
                out.append((m.start(), kind, m.start() + len(body)))
                break
    return out


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), sorted."""
    if not text:
        return []
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    for m in HEX.finditer(text):
        out.append((m.start(), 2, m.end()))
        run = m.group()
        if run.startswith("30") and len(run) % 2 == 0 and is_der_key(bytes.fromhex(run)):
            out.append((m.start(), 6, m.end()))
    for m in HEX_DER.finditer(text):
        run = m.group()
        if len(run) % 2 == 0 and is_der_key(bytes.fromhex(run)):
            out.append((m.start(), 6, m.end()))
    if text.count(".") >= 2:
        out += [(a, 3, z) for a, z in signed_tokens(text)]
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            raw = unbase64(m[2])
            if raw and (is_der_key(raw) or is_ssh_key(raw)):
                out.append((m.start(), 4, m.end()))
    for m in B64.finditer(text):
        run = m.group()
        for start in KEY_START.finditer(run):
            kind = key_kind(run[start.start() :])
            if kind is not None:
                out.append((m.start() + start.start(), kind, m.end()))
                break
    if "\n" in text:
        out += wrapped_keys(text)
    return sorted(set(out))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans array<struct<kind, start, end>> for every row of docs."""
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = [
                [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_spans(t)]
                for t in b.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(found, pa.list_(span))], ["doc_id", "spans"]
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, their digest and all spans as a string."""

    def text(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
            ",",
        )

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


def base_digest(text: str | None) -> str:
    """What `digests` gives as base_sha256, for one text."""
    spans = [s for s in find_spans(text) if s[1] < len(BASE)]
    return hashlib.sha256(joined(spans).encode()).hexdigest()
