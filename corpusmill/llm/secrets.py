"""Operator 10: secret scan with structural confirmation.

Candidates (key blocks, dotted tokens, long runs of base64 or hexadecimal) are decoded, and only what has the structure
of a secret inside is reported: DER whose nested lengths add up and whose fields are those of a private key, the length-
prefixed fields of an OpenSSH key, the JSON header and payload of a signed token, a checksum or account in an access
token, or, next to a name such as token or password, raw bytes of a key's usual size.

At scale: one pass without a shuffle; a regular expression in the scan keeps most documents from Python.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

PREFILTER = r"-----BEGIN|eyJ[A-Za-z0-9_-]{8}|[A-Za-z0-9+/_=-]{20}"
_PEM = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,64}KEY(?: BLOCK)?)-----")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_ACCESS = re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z2-7]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_HEX = re.compile(r"(?:[0-9a-f]{2}){16,}|(?:[0-9A-F]{2}){16,}")
_NAMED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|passphrase|credential|api[_ -]?key|access[_ -]?key|private[_ -]?key|signing[_ -]?key|auth)[a-z_-]*[\"']?\s*(?:=|:|=>|:=)\s*[\"']?$")
#: Bytes of the largest number of an RSA key, 131,072 bits: larger ones aren't multiplied.
LARGEST = 1 << 14
_KEY_BYTES = (16, 20, 24, 32, 48, 64)
_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def der(data: bytes, deepest: int = 32) -> list[tuple[int, bytes, list]] | None:
    """The (tag, content, children) of DER that fills the data exactly; None if a length doesn't fit or isn't the shortest form.

    No key has structures nested to more than deepest levels: data that does isn't read further and gives None.
    """
    out: list[tuple[int, bytes, list]] = []
    todo = [(0, len(data), out)]
    while todo:
        at, end, found = todo.pop()
        while at < end:
            if at + 2 > end:
                return None
            tag, n = data[at], data[at + 1]
            at += 2
            if n >= 0x80:
                size = n & 0x7F
                if not 1 <= size <= 4 or at + size > end:
                    return None
                n = int.from_bytes(data[at : at + size], "big")
                if n < 0x80 or n >> 8 * (size - 1) == 0:
                    return None
                at += size
            if at + n > end:
                return None
            children: list = []
            found.append((tag, data[at : at + n], children))
            if tag & 0x20:
                if len(todo) >= deepest:
                    return None
                # the rest of this level waits until the children are read
                todo.append((at + n, end, found))
                at, end, found = at, at + n, children
                continue
            at += n
    return out


def private_der(data: bytes) -> str | None:
    """Which private key the bytes are: PKCS#1, PKCS#8, plain or encrypted, SEC 1 or DSA."""
    if len(data) < 16 or data[0] != 0x30:
        return None
    top = der(data)
    if not top or len(top) != 1:
        return None
    fields = top[0][2]
    tags = [t for t, _, _ in fields]
    if len(tags) >= 9 and set(tags[:9]) == {2} and fields[0][1] in (b"\0", b"\1"):
        if max(len(f[1]) for f in fields[:6]) > LARGEST:
            return None
        n, e, d, p, q = (int.from_bytes(fields[i][1], "big") for i in range(1, 6))
        return "rsa-private-key" if p * q == n and e % 2 and 1 < d < n else None
    if len(tags) == 6 and set(tags) == {2} and fields[0][1] == b"\0":
        return "dsa-private-key"
    if tags[:3] == [2, 0x30, 4] and fields[0][1] in (b"\0", b"\1") and fields[1][2] and fields[1][2][0][0] == 6:
        return "pkcs8-private-key"
    if tags[:2] == [2, 4] and fields[0][1] == b"\1" and len(fields[1][1]) in (20, 24, 28, 32, 48, 66):
        return "ec-private-key"
    if tags == [0x30, 4] and fields[0][2] and fields[0][2][0][0] == 6 and len(fields[1][1]) >= 16:
        return "encrypted-private-key"
    return None


def openssh(data: bytes) -> str | None:
    """An OpenSSH private key: its magic, then length-prefixed fields that end with the data."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return None
    at, fields = len(magic), []
    for i in range(3):
        if at + 4 > len(data):
            return None
        (n,) = struct.unpack_from(">I", data, at)
        if at + 4 + n > len(data):
            return None
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
        if i == 2:
            if at + 4 > len(data):
                return None
            (keys,) = struct.unpack_from(">I", data, at)
            at += 4
    for _ in range(keys + 1):
        if at + 4 > len(data):
            return None
        (n,) = struct.unpack_from(">I", data, at)
        at += 4 + n
    return "openssh-private-key" if at == len(data) and 1 <= keys <= 16 and fields[0] else None


def pgp(data: bytes) -> str | None:
    """An OpenPGP private key: packets that fill the data, the first a secret key of version 3 to 6."""
    at, first = 0, None
    while at < len(data):
        parts: list[bytes] = []
        head = data[at]
        at += 1
        if not head & 0x80 or at >= len(data):
            return None
        if head & 0x40:  # the newer form, maybe in parts
            tag, more = head & 0x3F, True
            while more:
                if at >= len(data):
                    return None
                n, more = data[at], False
                at += 1
                if 192 <= n < 224:
                    if at >= len(data):
                        return None
                    n, at = (n - 192 << 8) + data[at] + 192, at + 1
                elif n == 255:
                    n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
                elif n >= 224:
                    n, more = 1 << (n & 0x1F), True
                if at + n > len(data):
                    return None
                parts.append(data[at : at + n])
                at += n
        else:
            tag, size = head >> 2 & 0xF, 1 << (head & 3)
            n = int.from_bytes(data[at : at + size], "big") if size < 8 else len(data) - at
            at += size if size < 8 else 0
            if at + n > len(data):
                return None
            parts.append(data[at : at + n])
            at += n
        if first is None:
            first = tag, b"".join(parts)
    return "pgp-private-key" if first and first[0] == 5 and len(first[1]) > 6 and 3 <= first[1][0] <= 6 else None


def un64(text: str) -> bytes | None:
    """base64, standard or for URLs, padded or not."""
    text = text.replace("-", "+").replace("_", "/").rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(data: bytes | None) -> dict | None:
    try:
        out = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return out if isinstance(out, dict) else None


def signed_token(header: str, payload: str, signature: str) -> str | None:
    """A JSON web token: a header that names its algorithm, an object for payload, a signature of the algorithm's length."""
    head, body, sig = _object(un64(header)), _object(un64(payload)), un64(signature) if signature else b""
    if head is None or body is None or sig is None or not isinstance(head.get("alg"), str):
        return None
    alg = head["alg"]
    fixed = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}
    if alg in fixed:
        return "signed-token" if len(sig) == fixed[alg] else None
    if alg[:2] in ("RS", "PS"):
        return "signed-token" if len(sig) >= 128 else None
    return None


def access_token(text: str) -> str | None:
    """An access key with an account in it, or a token whose last six characters are its checksum."""
    if text[:2] == "gh":
        crc, digits = zlib.crc32(text[4:34].encode()), ""
        for _ in range(6):
            crc, r = divmod(crc, 62)
            digits = _B62[r] + digits
        return "access-token" if digits == text[34:] else None
    data = base64.b32decode(text[4:].encode() + b"=" * (-len(text[4:]) % 8))
    account = (int.from_bytes(data[:6], "big") & 0x7FFFFFFFFF80) >> 7
    return "access-key" if 0 < account < 10**12 else None


def random_bytes(data: bytes) -> bool:
    """Whether few bytes repeat, as in keys: text, counters and padding don't pass."""
    steps = {(b - a) % 256 for a, b in zip(data, data[1:], strict=False)}
    return len(set(data)) >= 0.6 * len(data) and len(steps) >= 0.5 * len(data) and not all(32 <= b < 127 for b in data)


def blocks(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(label, start, end, body) of each key block: from a BEGIN to the next END with its label, in time linear in the text."""
    marks = list(_PEM.finditer(text))
    ends: dict[str, list[re.Match]] = {}
    for m in reversed(marks):
        if m[1] == "END":
            ends.setdefault(m[2], []).append(m)
    done = 0
    for m in marks:
        if m[1] == "BEGIN" and m.start() >= done:
            after = ends.get(m[2], [])
            while after and after[-1].start() < m.end():
                after.pop()
            if after:
                done = after[-1].end()
                yield m[2], m.start(), done, text[m.end() : after[-1].start()]


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each secret, in order, in characters."""
    out: list[tuple[str, int, int]] = []
    begun: list[int] = []  # of what is reported, in order; no two overlap
    ended: list[int] = []

    def report(kind: str | None, start: int, end: int) -> None:
        if kind:
            i = bisect_left(begun, start)
            if (i == 0 or ended[i - 1] <= start) and (i == len(begun) or end <= begun[i]):
                begun.insert(i, start)
                ended.insert(i, end)
                out.append((kind, start, end))

    for label, start, end, body in blocks(text):
        # in JSON and in programs line feeds are written as \\n
        lines = [x.strip() for x in re.sub(r"(?:(?<!\\)\\+[rn])+", "\n", body).replace("\\/", "/").splitlines()]
        sealed = any(x.startswith("Proc-Type:") and "ENCRYPTED" in x for x in lines)
        # the last line of OpenPGP armour is a checksum
        data = un64("".join(x for x in lines if ":" not in x and not re.fullmatch("=[A-Za-z0-9+/]{4}", x)))
        if data and "PUBLIC" not in label:
            report("encrypted-private-key" if sealed and len(data) % 8 == 0 else private_der(data) or openssh(data) or pgp(data), start, end)
    for m in _JWT.finditer(text):
        report(signed_token(*m.groups()), m.start(), m.end())
    for m in _ACCESS.finditer(text):
        report(access_token(m[1]), m.start(1), m.end(1))
    for m in _RUN.finditer(text):
        run = m[0]
        named = _NAMED.search(text, max(0, m.start() - 64), m.start())
        if _HEX.fullmatch(run):
            data, label = bytes.fromhex(run), "hex-key"
        else:
            data, label = un64(run), "base64-key"
            if data is None or (run.islower() or run.isupper() or run.isalpha()) and not named:
                continue
        kind = private_der(data) or openssh(data)
        if not kind and named and len(data) in _KEY_BYTES and random_bytes(data):
            kind = label
        report(kind, m.start(), m.end())
    return sorted(out, key=lambda x: x[1])


def secrets(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, kind, start_char, end_char), one for each secret.

    Null cases: null and empty texts hold none; a null id is reported as null; of repeated rows each is reported; an
    empty table gives an empty one. Whole texts are scanned, whatever their length, in time that grows with it; of
    candidates that overlap the first kind in the order above is reported, of one kind the earliest. Nothing in a text
    makes the scan fail: what is nested too deep or cut short is no secret. Other columns are not read.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [(i, *found) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) for found in scan(t)]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "kind", "start_char", "end_char"])

    some = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.col("text").rlike(PREFILTER))
    return some.mapInArrow(apply, "doc_id bigint, kind string, start_char bigint, end_char bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir))
