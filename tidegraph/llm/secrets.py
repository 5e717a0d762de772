"""Secret scans: plain patterns, and candidates confirmed by their structure.

Base kinds are patterns (assign, access, hex). The structural kinds report a candidate only if it decodes and parses:

- pem: a private-key block whose body is base64 of a key encoding, or of whole cipher blocks if its header lines say
  that it is encrypted; line breaks may be written as backslash-n;
- jwt: a signed token: two base64url JSON objects, the first with an ``alg``, and a signature;
- der: base64 or hex, on one line or wrapped over several, that decodes to one DER sequence of a private key whose
  nested lengths all add up; of wrapped lines as much is taken as the sequence's own length says;
- ssh: base64 of an OpenSSH private key whose length-prefixed fields all fit.

Spans are kind:start:end in code points, end exclusive, ordered by start and then kind in the order of KINDS. A match
that fails its length is dropped after matching, so it still uses up its text. Kinds may overlap each other.

Defined results: a null text is empty and has no spans; rows with null or repeated doc_ids are kept; an empty table
gives no rows; other columns are ignored by scan and kept by redact.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work

KINDS = ["assign", "access", "hex", "pem", "jwt", "der", "ssh"]
# The base patterns and the least lengths of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the same as runs of any length with the short ones dropped
ASSIGN_CHARS, ACCESS_CHARS = 12, 18
# Candidates for structure.
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:\s|\\[rnt])*(?:[A-Za-z-]+:[^\n\\]*(?:\s|\\[rnt])+){0,8})([A-Za-z0-9+/=\s\\]*)-----END \1-----")
BREAK = re.compile(r"\\[rnt]|\s")
WRAPPED_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{40,}(?:(?:(?:\\r)?\\n|\r?\n[\x20\t]*)[A-Za-z0-9+/]+)+={0,2}")
WRAPPED_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{32,}(?:(?:(?:\\r)?\\n|\r?\n[\x20\t]*)[0-9A-Fa-f]+)+")
JWT = re.compile(r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?![A-Za-z0-9_.-])")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
LEAST_CANDIDATE = 40


def from_base64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not; None if it isn't any."""
    bare = text.rstrip("=").translate({45: 43, 95: 47})
    if len(bare) % 4 == 1:
        return None
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start of the value, its end) of the DER element at a place, if it fits before end."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill a range exactly, or None."""
    out = []
    while at < end:
        found = tlv(data, at, end)
        if not found:
            return None
        out.append(found)
        at = found[2]
    return out


def is_private_key(data: bytes) -> bool:
    """PKCS#1, PKCS#8, encrypted PKCS#8, DSA or SEC1: one sequence that fills the data, with the parts of a key."""
    outer = tlv(data, 0, len(data))
    if not outer or outer[0] != 0x30 or outer[2] != len(data):
        return False
    parts = elements(data, outer[1], outer[2])
    if not parts:
        return False
    tags = [t for t, _, _ in parts]
    version = data[parts[0][1] : parts[0][2]] if tags[0] == 0x02 else None
    if version in (b"\x00", b"\x01") and len(tags) >= 6 and all(t == 0x02 for t in tags[:6]):
        return True  # PKCS#1, DSA
    if version == b"\x01" and len(tags) >= 2 and tags[1] == 0x04:
        return True  # SEC1
    if len(tags) >= 3 and version in (b"\x00", b"\x01") and tags[1:3] == [0x30, 0x04] or len(tags) == 2 and tags == [0x30, 0x04]:
        inner = elements(data, *parts[tags.index(0x30)][1:])
        return bool(inner) and inner[0][0] == 0x06  # PKCS#8: an algorithm's object id
    return False


def is_ssh_key(data: bytes) -> bool:
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for k in range(5):  # cipher, kdf, kdf options, then (after a count) public and private part
        if k == 3:
            at += 4
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at > len(data):
            return False
    return True


def key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if is_private_key(data) else "ssh" if is_ssh_key(data) else None


def is_signed_token(text: str) -> bool:
    head, body, signature = text.split(".")
    try:
        first, second = (json.loads(from_base64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(first, dict) and isinstance(first.get("alg"), str) and isinstance(second, dict) and bool(from_base64(signature))


def pem_holds_key(headers: str, body: str) -> bool:
    """Whether a private-key block's body is a key encoding, or encrypted as its header lines say."""
    data = from_base64(BREAK.sub("", body))
    if "ENCRYPTED" in headers and "DEK-Info:" in headers:
        return bool(data) and len(data) >= 32 and len(data) % 8 == 0
    return key_kind(data) is not None


def wrapped_spans(text: str) -> list[tuple[str, int, int]]:
    """Keys in base64 or hex that is wrapped over lines; what follows the key's own length is not part of it."""
    out = []
    for pattern, bits, decode in ((WRAPPED_BASE64, 6, from_base64), (WRAPPED_HEX, 4, bytes.fromhex)):
        for m in pattern.finditer(text):
            digits = BREAK.sub("", m[0]).rstrip("=")
            head = decode(digits[:16])
            outer = tlv(head, 0, 1 << 40) if head and head[0] == 0x30 else None
            if not outer:
                continue
            need = -(-outer[2] * 8 // bits)
            if need <= len(digits) and (data := decode(digits[:need])) and is_private_key(data):
                at, left = m.start(), need
                for piece in re.finditer(r"\\[rnt]|\s|[A-Za-z0-9+/]+", m[0]):
                    if piece[0][0] != "\\" and not piece[0].isspace():
                        if len(piece[0]) >= left:
                            at = m.start() + piece.start() + left
                            break
                        left -= len(piece[0])
                while at < m.end() and text[at] == "=":
                    at += 1
                out.append(("der", m.start(), at))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def structural_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "-----BEGIN " in text:
        out += [("pem", m.start(), m.end()) for m in PEM.finditer(text) if pem_holds_key(m[2], m[3])]
    if "eyJ" in text:
        out += [("jwt", m.start(), m.end()) for m in JWT.finditer(text) if is_signed_token(m[0])]
    if max(map(len, text.split()), default=0) >= LEAST_CANDIDATE:
        for m in BASE64.finditer(text):
            if kind := key_kind(from_base64(m[0])):
                out.append((kind, m.start(), m.end()))
        for m in LONG_HEX.finditer(text):
            if kind := key_kind(bytes.fromhex(m[0])):
                out.append((kind, m.start(), m.end()))
        out += wrapped_spans(text)
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def _scan(batches):
    for batch in batches:
        rows = []
        for text in batch["text"]:
            base = base_spans(text)
            kinds = [k for k, _, _ in base]
            rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + structural_spans(text))))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield batch[["k", "m"]].assign(n_assign=cols[0], n_access=cols[1], n_hex=cols[2], base_sha256=cols[3], spans=cols[4])


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the digest of their spans and all spans."""
    work.prepare(spark)
    key = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(key, F.lit(0)).alias("k"), key.isNull().alias("m"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInPandas(work.tidy(_scan), "k long, m boolean, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return out.select(F.when(~F.col("m"), F.col("k")).alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def redacted(text: str) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    spans = sorted(base_spans(text) + structural_spans(text), key=lambda s: (s[1], KINDS.index(s[0])))
    k = 0
    while k < len(spans):
        kind, start, end = spans[k]
        while k + 1 < len(spans) and spans[k + 1][1] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [text[at:start], f"[{kind}]"]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with secrets in text replaced; all rows and columns stay, n_chars (if there is one) counts the new text."""
    work.prepare(spark)

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else redacted(t))

    out = docs.withColumn("text", clean(F.col("text")))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars").cast("long"))) if "n_chars" in docs.columns else out
