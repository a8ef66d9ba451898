"""Operator 2: secret scans with structural confirmation.

A pattern only proposes a candidate. It is reported when its decoded bytes have the structure of the
claimed kind: DER with nested lengths that add up, the OpenSSH container, signed-token headers, a token's
own checksum, or, for plain hex and base64 values, a secret-like assignment and bytes that look random.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.shared import apart, map_rows

#: A necessary condition for any report; it runs in the JVM, so that Python sees few texts.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}|-----BEGIN"

_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*")
_ACCESS_ID = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z2-7]{16}(?![A-Za-z0-9])")
_CHECKED = re.compile(r"(?<![A-Za-z0-9])gh[opsur]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
#: Names of secrets, anywhere in an identifier of any length.
_NAME = re.compile(r"(?i:token(?!i[sz])|secret|passwd|password|passphrase|api[_-]?key|(?:access|auth|private|signing|encryption|master|session|client|account)[_-]?key|credential)")
_LAST = re.compile(r"(?i:token|secret|passwd|password|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credential)$")
#: What may stand between a name and its value; and words that may: prefixes of strings, types, schemes.
_GAP = frozenset(" \t\r\n\x0b\f\"'`\\:=,>([{|])}?&")
_IDENTIFIER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-.$")
_BETWEEN = re.compile(r"(?i:[bruf]{1,2}|str|string|bytes|char|text|bearer|basic|token|new|is|optional|final)")
#: Maximal runs, of any length and case.
_HEX_RUN = re.compile(r"(?<![0-9A-Za-z])(?:0[xX])?((?:[0-9a-fA-F]{2}){16,}+)(?![0-9A-Za-z])")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{22,}+={0,2}+(?![A-Za-z0-9+/_=-])")
#: Words joined by marks: names of files, settings and the like, which decode as base64 by chance.
_WORDS = re.compile(r"(?:[a-z]++|[A-Z][a-z]++|[A-Z]++|[0-9]{1,4})(?:[/_+-]+(?:[a-z]++|[A-Z][a-z]++|[A-Z]++|[0-9]{1,4}))*[/_-]*=?")
_DEK = re.compile(r"^DEK-Info:\s*([A-Za-z0-9-]+),([0-9A-Fa-f]+)\s*$", re.M)
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_ALGORITHMS = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}
_KINDS = ("pem_private_key", "der_private_key", "signed_token", "access_key_id", "checksummed_token", "hex_secret", "base64_secret")

Finding = tuple[int, int, str, str]


def der_items(data: bytes, start: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[start:end] exactly; None if lengths don't add up."""
    end = len(data) if end is None else end
    items, at = [], start
    while at < end:
        if end - at < 2:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or end - at < width:
                return None
            size = int.from_bytes(data[at : at + width], "big")
            if size < 128:  # DER has the shortest form only
                return None
            at += width
        if size > end - at:
            return None
        items.append((tag, at, at + size))
        at += size
    return items


def key_encoding(data: bytes) -> str | None:
    """Name of the private-key structure that data holds from first byte to last, or None."""
    if data.startswith(b"openssh-key-v1\0"):
        return "openssh" if _openssh(data) else None
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return None
    inner = der_items(data, outer[0][1], outer[0][2])
    if not inner:
        return None
    tags = [t for t, _, _ in inner]
    value = lambda k: data[inner[k][1] : inner[k][2]]
    if len(tags) >= 9 and set(tags[:9]) == {0x02} and value(0) in (b"\0", b"\1"):
        return f"pkcs1-rsa-{len(value(1).lstrip(bytes(1))) * 8}"
    if tags == [0x02] * 6 and value(0) == b"\0":
        return "dsa"
    if tags[:2] == [0x02, 0x04] and value(0) == b"\1" and len(value(1)) in range(20, 67):
        return "sec1-ec"
    if tags[:3] == [0x02, 0x30, 0x04] and value(0) in (b"\0", b"\1"):
        algorithm = der_items(data, inner[1][1], inner[1][2])
        return "pkcs8" if algorithm and algorithm[0][0] == 0x06 and der_items(value(2)) else None
    if tags == [0x30, 0x04]:
        algorithm = der_items(data, inner[0][1], inner[0][2])
        return "pkcs8-encrypted" if algorithm and algorithm[0][0] == 0x06 else None
    return None


def _openssh(data: bytes) -> bool:
    """The container's length-prefixed strings: cipher, kdf, its options, keys, private part."""
    at = 15

    def string() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    if any(string() is None for _ in range(3)):
        return False
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= count <= 64 and all(string() is not None for _ in range(count + 1)) and at == len(data)


def _decoded(text: str) -> bytes | None:
    text = text.replace("-", "+").replace("_", "/").rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def signed_token(text: str) -> str | None:
    """Algorithm of a signed token whose header, claims and signature size fit together, or None."""
    head, claims, signature = text.split(".")
    try:
        header, body = (json.loads(_decoded(x) or b"") for x in (head, claims))
    except (ValueError, RecursionError):
        return None
    if not isinstance(header, dict) or not isinstance(body, dict) or not isinstance(header.get("alg"), str):
        return None
    name, size = header["alg"], len(_decoded(signature) or b"")
    fits = size == 0 if name == "none" else size == _ALGORITHMS[name] if name in _ALGORITHMS else name[:2] in ("RS", "PS") and size >= 128
    return name if fits else None


def random_bytes(data: bytes) -> bool:
    """Whether bytes look drawn at random: many different ones, not a text."""
    n = len(data)
    return n >= 16 and len(set(data)) >= min(0.6 * n, 48) and not all(32 <= b < 127 or b in (9, 10, 13) for b in data)


def checksum_fits(text: str) -> bool:
    """The last six characters are the CRC-32 of the rest, in base 62."""
    crc, digits = zlib.crc32(text[4:-6].encode()), ""
    for _ in range(6):
        crc, d = divmod(crc, 62)
        digits = _BASE62[d] + digits
    return digits == text[-6:]


def access_account(text: str) -> int | None:
    """The account of an access key id, from the 40 bits below the first one of its decoded part; None if they are no account.

    Accounts have twelve digits, and drawn characters differ from one another: fewer than eight of the
    sixteen, or a number beyond twelve digits, is no id.
    """
    raw = base64.b32decode(text[4:])
    account = (int.from_bytes(raw[:6], "big") & 0x7FFFFFFFFF80) >> 7
    return account if len(set(text[4:])) >= 8 and 0 < account < 10**12 else None


def _pem_body(body: str) -> tuple[str, str]:
    """(headers, the rest) of a PEM body: RFC 1421 headers end with an empty line."""
    lines = [x.strip() for x in body.splitlines()]
    tops = [k for k, x in enumerate(lines) if ":" in x]
    if not tops:
        return "", body
    empty = next((k for k in range(tops[0], len(lines)) if not lines[k]), None)
    if empty is None:
        return "\n".join(lines[k] for k in tops), "\n".join(x for x in lines if ":" not in x)
    return "\n".join(lines[:empty]), "\n".join(lines[empty:])


def pem_encoding(body: str) -> str | None:
    """Name of the private-key structure between the marks of a PEM text, or None.

    The text may stand in a string with escapes, in quoted pieces, or behind the marks of a comment.
    """
    body = re.sub(r"\\+[nrt]", "\n", body).replace("\\/", "/")
    forms = [body, re.sub(r"(?m)^[ \t]*(?:#|//|\*|>|;|--)+", "", body)]
    if quoted := re.findall(r"""["']([^"']*)["']""", f'"{body}"'):
        forms.append("\n".join(quoted))
    for form in forms:
        header, rest = _pem_body(form)
        data = _decoded("".join(x for x in re.split(r"[\s\\]+", rest)))
        if not data:
            continue
        if kind := key_encoding(data):
            return kind
        if dek := _DEK.search(header):  # enciphered as a whole: blocks of the size of the initial vector
            block = len(dek[2]) // 2
            if block in (8, 16) and len(dek[2]) % 2 == 0 and len(data) % block == 0:
                return f"encrypted-{dek[1].lower()}"
    return None


def _named(text: str, start: int) -> str | None:
    """The identifier with a secret's name to which the value at start is assigned, or None."""
    at, bare = start, True
    for _ in range(2):
        end = at
        while at and text[at - 1] in _GAP:
            at -= 1
        if at == end:
            return None
        gap = text[at:end]
        bare = bare and not any(c in gap for c in ":=,>")
        if bare and "\n" in gap:
            return None
        end = at
        while at and text[at - 1] in _IDENTIFIER:
            at -= 1
        name = text[at:end]
        if _NAME.search(name):
            return name
        if not _BETWEEN.fullmatch(name):
            return None
    return None


def find_secrets(text: str | None) -> list[Finding]:
    """(start, end, kind, detail) of confirmed secrets in order; overlapping finds keep the first kind of _KINDS."""
    if not text:
        return []
    found: list[Finding] = []
    begins = list(_PEM.finditer(text))
    for k, m in enumerate(begins):
        mark = f"-----END {m[1]}-----"
        end = text.find(mark, m.end(), begins[k + 1].start() if k + 1 < len(begins) else len(text))
        if end >= 0 and (kind := pem_encoding(text[m.end() : end])):
            found.append((m.start(), end + len(mark), _KINDS[0], kind))
    for m in _RUN.finditer(text):
        data = _decoded(m[0])
        if data is None:
            continue
        if kind := key_encoding(data):
            found.append((m.start(), m.end(), _KINDS[1], kind))
        elif random_bytes(data) and not re.fullmatch("[0-9a-fA-F]+", m[0]) and (name := _named(text, m.start())):
            if _LAST.search(name) or not _WORDS.fullmatch(m[0]):
                found.append((m.start(), m.end(), _KINDS[6], f"{8 * len(data)} bits"))
    for m in _HEX_RUN.finditer(text):
        data = bytes.fromhex(m[1])
        if kind := key_encoding(data):
            found.append((m.start(1), m.end(1), _KINDS[1], kind))
        elif random_bytes(data) and _named(text, m.start()):
            found.append((m.start(1), m.end(1), _KINDS[5], f"{8 * len(data)} bits"))
    for m in _JWT.finditer(text):
        if kind := signed_token(m[0]):
            found.append((m.start(), m.end(), _KINDS[2], kind))
    for m in _ACCESS_ID.finditer(text):
        if (account := access_account(m[0])) is not None:
            found.append((m.start(), m.end(), _KINDS[3], f"{account:012d}"))
    for m in _CHECKED.finditer(text):
        if checksum_fits(m[0]):
            found.append((m.start(), m.end(), _KINDS[4], m[0][:3]))
    kept: list[Finding] = []  # in order, and apart: only the two at x's place can overlap it
    for x in sorted(found, key=lambda x: (_KINDS.index(x[2]), x[0])):
        at = bisect_left(kept, x[:2])
        if (at == 0 or kept[at - 1][1] <= x[0]) and (at == len(kept) or x[1] <= kept[at][0]):
            kept.insert(at, x)
    return kept


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each confirmed secret: id, start_char, end_char, kind, detail, sha256 of the value.

    Whole texts are scanned; the value itself isn't repeated. Null and empty texts have no secrets; a
    null id is carried along; repeated rows are reported as often as they occur; other columns are unused.
    A result column whose name the id has ends in _.
    """
    names = apart([id_col, "start_char", "end_char", "kind", "detail", "value_sha256"], [])
    kinds = [docs.schema[id_col].dataType, T.LongType(), T.LongType(), *[T.StringType()] * 3]
    schema = T.StructType([T.StructField(f"c{i}", k) for i, k in enumerate(kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                rows += [(i, *x, hashlib.sha256(text[x[0] : x[1]].encode()).hexdigest()) for x in find_secrets(text)]
            if rows:
                at, *rest = (list(x) for x in zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))],
                    names=schema.names,
                )

    rows = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))
    return rows.where(F.col("t").rlike(CANDIDATE)).mapInArrow(run, schema).toDF(*names)


def redact(text: str | None) -> str | None:
    """text with each confirmed secret replaced by a mark of its kind."""
    found = find_secrets(text)
    if not found:
        return text
    out, at = [], 0
    for start, end, kind, _ in found:
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with confirmed secrets masked in the text, and length_col, if there and of whole numbers, set to the new length.

    Every row stays, in the same columns; texts without secrets, null and empty ones are unchanged.
    """
    candidate = re.compile(CANDIDATE)
    columns = docs.columns
    has_length = length_col in columns and isinstance(docs.schema[length_col].dataType, T.IntegralType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = columns.index(text_col)
            texts = batch.column(at).to_pylist()
            changed = {}
            for i, text in enumerate(texts):
                if text and candidate.search(text) and (new := redact(text)) != text:
                    changed[i] = new
            if changed:
                arrays = list(batch.columns)
                arrays[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], batch.column(at).type)
                if has_length:
                    k = columns.index(length_col)
                    old = batch.column(k).to_pylist()
                    arrays[k] = pa.array([len(changed[i]) if i in changed else x for i, x in enumerate(old)], batch.column(k).type)
                batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
            yield batch

    return map_rows(docs, run)
