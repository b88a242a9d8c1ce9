"""Secret scans: patterns, and structures that are decoded and parsed before they are reported."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns, the least length of what each must hold, and the order of the kinds.
PATTERNS = [
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]
#: Structures follow the patterns in that order.
STRUCTURES = ["rsa", "dsa", "ec", "pkcs8", "pkcs8_encrypted", "pem_encrypted", "openssh", "jwt", "jwe"]
KINDS = [name for name, *_ in PATTERNS] + STRUCTURES
#: Bytes of a signature by algorithm of a signed token; RSA signatures have a multiple of 64 from 128 on.
SIGNATURES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": 64, "none": 0}
RSA_SIGNATURES = ["RS256", "RS384", "RS512", "PS256", "PS384", "PS512"]
# Fixed values end.

SPAN = "array<struct<kind:string,start:int,end:int>>"
#: A key takes at least so many characters of base64 or hex.
LEAST_BASE64, LEAST_HEX = 56, 96
#: Base64 within base64: a key file in an encoded secret takes two levels.
DEPTH = 3

_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST_BASE64)
_HEX = re.compile(r"[0-9A-Fa-f]{%d,}" % LEAST_HEX)
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,4}")
_BODY = re.compile(r"(?:\s|\\[rn])+")
_URL = str.maketrans("-_", "+/")


def from_base64(s: str) -> bytes | None:
    """Standard or URL-safe base64, padded or not; None if it is neither."""
    s = s.rstrip("=").translate(_URL)
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def elements(b: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, stop) of the DER elements that fill b[at:end] exactly; None if lengths don't nest or aren't in the shortest form."""
    out = []
    while at < end:
        if end - at < 2:
            return None
        tag, size, at = b[at], b[at + 1], at + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end or b[at] == 0:
                return None
            size, at = int.from_bytes(b[at : at + n], "big"), at + n
            if size < 0x80:
                return None
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def der_key(b: bytes, depth: int = 0) -> str | None:
    """The kind of private key that these bytes are, by the shape of their nested DER lengths."""
    top = elements(b, 0, len(b)) if b[:1] == b"\x30" else None
    if not top or len(top) != 1:
        return None
    parts = elements(b, top[0][1], top[0][2])
    if not parts:
        return None
    tags, value = [t for t, _, _ in parts], lambda i: b[parts[i][1] : parts[i][2]]
    if tags[0] == 2 and len(value(0)) == 1:
        version = value(0)[0]
        if set(tags) == {2} and all(x < y for _, x, y in parts):
            if len(parts) == 9 and version == 0 and len(value(1)) >= 32:
                return "rsa"
            if len(parts) == 6 and version == 0 and len(value(1)) >= 32:
                return "dsa"
        if version == 1 and tags[1:2] == [4] and 16 <= len(value(1)) <= 72 and set(tags[2:]) <= {0xA0, 0xA1}:
            return "ec"
        if version in (0, 1) and tags[1:3] == [0x30, 4] and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:
            method = elements(b, *parts[1][1:])
            inner = value(2)
            if method and method[0][0] == 6 and (depth >= DEPTH or der_key(inner, depth + 1) or (inner[:1] == b"\x04" and elements(inner, 0, len(inner))) or (inner[:1] == b"\x02" and elements(inner, 0, len(inner)))):
                return "pkcs8"
    if tags == [0x30, 4]:
        method = elements(b, *parts[0][1:])
        # 1.2.840.113549.1.5 and .12.1: password-based encryption
        if method and method[0][0] == 6 and b[method[0][1] : method[0][2]].startswith((b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c\x01")):
            return "pkcs8_encrypted"
    return None


def openssh_key(b: bytes) -> str | None:
    """A private key of OpenSSH's own form, whose counted fields fill the bytes exactly."""
    magic = b"openssh-key-v1\0"
    if not b.startswith(magic):
        return None
    at, left, count = len(magic), 3, None  # cipher, derivation, its options
    while at < len(b):
        if left == 0 and count is None:
            count = int.from_bytes(b[at : at + 4], "big")
            at, left = at + 4, count + 1  # public keys, then the private part
            if not 1 <= count <= len(b) or at > len(b):
                return None
            continue
        if left == 0:
            return None
        size = int.from_bytes(b[at : at + 4], "big")
        at, left = at + 4 + size, left - 1
    return "openssh" if count and left == 0 and at == len(b) else None


def _object(part: str) -> dict | None:
    raw = from_base64(part)
    try:
        got = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def signed_token(s: str) -> tuple[str, int] | None:
    """(kind, length) of a signed or encrypted token at the start of s: its header must name an algorithm, its claims be an object, its signature have the algorithm's length."""
    parts = s.split(".")
    head = _object(parts[0])
    name = head.get("alg") if head else None
    if not isinstance(name, str):
        return None
    if len(parts) >= 5 and isinstance(head.get("enc"), str) and all(from_base64(p) for p in parts[2:5]):
        return "jwe", sum(map(len, parts[:5])) + 4
    signature = from_base64(parts[2])
    if signature is None or _object(parts[1]) is None:
        return None
    size = len(signature)
    fits = size == SIGNATURES[name] if name in SIGNATURES else size >= 128 and size % 64 == 0 if name in RSA_SIGNATURES else size > 0
    return ("jwt", sum(map(len, parts[:3])) + 2) if fits else None


def decoded_kind(b: bytes | None, depth: int = 1) -> str | None:
    """What decoded bytes are: a key, or text that holds a structure."""
    if not b:
        return None
    kind = der_key(b) or openssh_key(b)
    if kind or depth >= DEPTH:
        return kind
    if b[:5] == b"-----" or (b[:1] == b"e" and b.count(b".") in (2, 4)) or b[:2] == b"MI" or b[:4] == b"LS0t":
        try:
            inner = structures(b.decode("ascii"), depth + 1)
        except UnicodeDecodeError:
            return None
        return inner[0][0] if inner else None
    return None


def structures(text: str, depth: int = 0) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what decodes and parses, by start; a candidate inside one that was found is passed over."""
    out, done = [], 0
    for m in _PEM.finditer(text):
        if m.start() < done:
            continue
        foot = f"-----END {m[1]}PRIVATE KEY-----"
        following = text.find("-----BEGIN ", m.end())  # a block ends before the next one: no text is searched twice
        end = text.find(foot, m.end(), following if following >= 0 else len(text))
        if end < 0:
            continue
        body = _BODY.split(text[m.end() : end].strip())
        headers = [i for i, x in enumerate(body) if x.endswith(":")]
        sealed = "ENCRYPTED" in "".join(body[: headers[-1]]) if headers else False
        raw = from_base64("".join(x for x in (body[headers[-1] + 2 :] if headers else body)))
        kind = ("pem_encrypted" if raw and len(raw) % 8 == 0 else None) if sealed else der_key(raw) or openssh_key(raw) if raw else None
        if kind:
            out.append((kind, m.start(), end + len(foot)))
            done = end + len(foot)
    blocks = list(out)
    inside = lambda a: any(x <= a < y for _, x, y in blocks)
    for m in _TOKEN.finditer(text):
        got = signed_token(m[0])
        if got and not inside(m.start()):
            out.append((got[0], m.start(), m.start() + got[1]))
    for m in _BASE64.finditer(text):
        # what these bytes can begin with: a sequence, OpenSSH's mark, a PEM line, a token, base64 again
        if m[0].startswith(("M", "b3BlbnNzaC", "LS0t", "ZX", "TU", "TF")) and not inside(m.start()):
            kind = decoded_kind(from_base64(m[0]), depth)
            if kind:
                out.append((kind, m.start(), m.end()))
    for m in _HEX.finditer(text):
        if m[0].lower().startswith(("30", "6f70656e737368", "2d2d2d2d2d", "657", "4d49")) and len(m[0]) % 2 == 0 and not inside(m.start()):
            kind = decoded_kind(bytes.fromhex(m[0]), depth)
            if kind:
                out.append((kind, m.start(), m.end()))
    return sorted(set(out), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans of a text, in code points, by start, then kind in the order of KINDS."""
    out = []
    for kind, pattern, group, least in PATTERNS:
        out += [(kind, *m.span()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out + structures(text), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(df: DataFrame, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """The input with ``out_col`` added (replaced if there): all spans of each whole text, as structs (kind, start, end) by start.

    Patterns count as they are; keys and signed tokens (in PEM blocks, base64 or hex, also one within the other) are reported only
    if they decode and their lengths, tags and headers fit. The span of a pattern is its whole match. Null text counts as
    empty and has an empty array; repeated rows, null ids and other columns pass through. One pass, no shuffle, a row at a time.
    """
    from pyspark.sql import types as T

    kept = [c for c in df.columns if c != out_col]
    names, at = [*kept, out_col], kept.index(text_col)
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in secrets(str(t))] if t is not None else [] for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(item))], names)

    plain = df.select(*[F.col(f"`{c}`") for c in kept])
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(out_col, T.ArrayType(span))]))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """The input with every span of ``text_col`` replaced by ``mask``; spans that overlap go as one. Null text stays null."""
    found = find_secrets(df, text_col, "__secrets")
    # end of what is covered, and the text so far
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    step = lambda s, x: F.when(x["end"] <= s["at"], s).otherwise(F.struct(x["end"].alias("at"), F.when((x["start"] < s["at"]), s["done"]).otherwise(F.concat(s["done"], F.substring(F.col(text_col), s["at"] + 1, x["start"] - s["at"]), F.lit(mask))).alias("done")))
    clean = F.aggregate("__secrets", start, step, lambda s: F.concat(s["done"], F.substring(F.col(text_col), s["at"] + 1, F.length(text_col))))
    return found.withColumn(text_col, F.when(F.size("__secrets") > 0, clean).otherwise(F.col(text_col))).drop("__secrets")


def secret_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256 (of the patterns' spans), spans (all, joined), n_confirmed (structures)."""
    found = find_secrets(df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")), "__text", "__spans")
    names = [name for name, *_ in PATTERNS]
    count = lambda kind: F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("__spans", lambda s: s["kind"].isin(names))
    return found.select(id_col, *[count(n).alias(f"n_{n}") for n in names], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("__spans")).alias("spans"), (F.size("__spans") - F.size(base)).cast("long").alias("n_confirmed"))
