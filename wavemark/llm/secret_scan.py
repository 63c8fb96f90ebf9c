"""Secrets in texts, by patterns and by structure.

Patterns find assignments, access keys and long hex numbers. Beside them, runs of base64 and hex
that could begin a key or a signed token are decoded and parsed, and reported only if their structure
holds to the last byte:

* ``private_key``: DER, a sequence whose nested lengths fill it exactly and whose members are those
  of a PKCS#1, PKCS#8 (plain or encrypted) or SEC1 key; or an OpenSSH key, whose magic and
  length-prefixed fields fill the bytes;
* ``signed_token``: three base64url parts of which the first is a JSON object that names a signing
  algorithm, the second a JSON object, and the third a signature of a length that this algorithm has.

Base64 may be broken over lines, as in PEM files. Most texts hold no candidate at all: a linear
matcher over the whole batch says which do.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import as_struct, unpacked
from .tokens import text_slices

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "private_key", "signed_token")


class Span(NamedTuple):
    """Code points from ``start`` up to, but not including, ``end``."""

    kind: str
    start: int
    end: int


# The patterns of the three base kinds, and their least lengths.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LEAST_VALUE = 6

# How the encodings begin. 0x30 (a DER sequence) is M in base64, and "{" e followed by w to z,
# a digit or one of the last two signs; "openssh-key-v1\0" is b3BlbnNzaC1rZXktdjEA.
_BEGINS = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-Za-z0-9+/_-]{15}|b3BlbnNzaC1rZXktdjEA)")
_SIGNS, _BREAK, _PADDING = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"\r?\n[\x20\t]*(?!-----)"), re.compile("={0,2}")
_HEXED = re.compile(r"(?<![0-9A-Fa-f])(?:30|6f70656e7373682d6b65792d763100|6F70656E7373682D6B65792D763100)[0-9A-Fa-f]{28,}(?![0-9A-Fa-f])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])e[w-z0-9_-][A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]{16,}(?![A-Za-z0-9_-])")

_CANDIDATE = (
    r"[0-9a-f]{24}|AKIA[A-Z0-9]{16}|(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
    r"|M[A-Za-z0-9+/_-]{15}|b3BlbnNzaC1rZXktdjEA|(?:30|6f|6F)[0-9A-Fa-f]{28}|e[w-z0-9_-][A-Za-z0-9_-]{8}[A-Za-z0-9_-]*\.[A-Za-z0-9_-]{2}"
)

_OPENSSH = b"openssh-key-v1\0"
#: Bytes of a signature by algorithm (JSON Web Algorithms); RSA's is as long as its modulus.
_SIGNATURES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EDDSA": 64}
_RSA = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512")

#: Keys in one OpenSSH file.
_MOST_KEYS = 1024
_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30


def base_spans(text: str) -> list[Span]:
    """Assignments with a value of six characters or more, access keys and hex numbers: of each
    kind the leftmost ones that do not overlap."""
    found = [Span("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= _LEAST_VALUE]
    found += [Span("access", *m.span()) for m in _ACCESS.finditer(text)]
    return found + [Span("hex", *m.span()) for m in _HEX.finditer(text)]


def der_members(data: bytes, first: int = 0, stop: int | None = None) -> list[tuple[int, int, int]] | None:
    """The (tag, first byte, stop) of the elements that fill these bytes of DER exactly; None if they
    do not. Lengths must be definite and in their shortest form, tags of one byte."""
    out, at, stop = [], first, len(data) if stop is None else stop
    while at < stop:
        if at + 2 > stop or data[at] & 0x1F == 0x1F:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > stop or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + width], "big"), at + width
            if size < 0x80:
                return None
        if at + size > stop:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def _whole_integer(data: bytes, member: tuple[int, int, int]) -> bool:
    """A DER integer above zero in its shortest form."""
    _, a, b = member
    return b > a and data[a] < 0x80 and not (b - a > 1 and data[a] == 0 and data[a + 1] < 0x80)


def _algorithm(data: bytes, member: tuple[int, int, int]) -> bool:
    """A sequence that begins with an object identifier."""
    inner = der_members(data, *member[1:]) if member[0] == _SEQUENCE else None
    return bool(inner) and inner[0][0] == _OID and inner[0][2] > inner[0][1] and data[inner[0][2] - 1] < 0x80


def is_der_key(data: bytes) -> bool:
    outer = der_members(data)
    if not outer or len(outer) != 1 or outer[0][0] != _SEQUENCE:
        return False
    members = der_members(data, *outer[0][1:])
    if not members or len(members) < 2:
        return False
    tags = [tag for tag, _, _ in members]
    if tags == [_SEQUENCE, _OCTETS]:  # encrypted PKCS#8
        return _algorithm(data, members[0]) and members[1][2] - members[1][1] >= 8
    version = data[members[0][1] : members[0][2]]
    if tags[0] != _INTEGER or version not in (b"\0", b"\1"):
        return False
    if tags[1:3] == [_SEQUENCE, _OCTETS]:  # PKCS#8
        return _algorithm(data, members[1]) and all(tag & 0xC0 == 0x80 for tag in tags[3:]) and members[2][2] > members[2][1]
    if tags[1] == _OCTETS:  # SEC1
        return version == b"\1" and members[1][2] - members[1][1] >= 16 and all(tag & 0xC0 == 0x80 for tag in tags[2:])
    if set(tags[:9]) == {_INTEGER} and len(tags) == 9 + (version == b"\1"):  # PKCS#1
        return all(_whole_integer(data, m) for m in members[1:9])
    return False


def _fields(data: bytes, at: int, count: int) -> int | None:
    """Where ``count`` length-prefixed fields from ``at`` on end; None if they leave the bytes."""
    for _ in range(count):
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at > len(data):
            return None
    return at


def is_openssh_key(data: bytes) -> bool:
    """The magic; names of cipher and key derivation, its options; the number of keys, each public
    key, and one private part that ends the bytes."""
    if not data.startswith(_OPENSSH):
        return False
    at = _fields(data, len(_OPENSSH), 3)
    if at is None or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    return 1 <= keys <= _MOST_KEYS and _fields(data, at + 4, keys + 1) == len(data)


def _decoded(signs: str) -> bytes | None:
    """The bytes of standard or URL-safe base64 without white space, padded or not."""
    signs = signs.replace("-", "+").replace("_", "/").rstrip("=")
    try:
        return base64.b64decode(signs + "=" * (-len(signs) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _signs(text: str, at: int, most: int) -> tuple[str, int, bool]:
    """Up to ``most`` signs of base64 from ``at`` on, over line ends; where they end, and whether
    the line goes on with more of them."""
    parts, more = [], False
    while most:
        line = _SIGNS.match(text, at, at + most + 1)
        if line is None:
            break
        more = line.end() - at > most
        parts.append(line.group()[:most])
        most, at = most - len(parts[-1]), at + len(parts[-1])
        skip = _BREAK.match(text, at)
        if not most or skip is None or not _SIGNS.match(text, skip.end(), skip.end() + 1):
            break
        at = skip.end()
    return "".join(parts), at, more


def _der_extent(head: bytes) -> int:
    """Bytes of the element that ``head``, six bytes or more of it, begins."""
    width = head[1] & 0x7F if head[1] & 0x80 else 0
    return 2 + width + (int.from_bytes(head[2 : 2 + width], "big") if width else head[1]) if width <= 4 else 0


def _openssh_extent(data: bytes) -> int | None:
    at = _fields(data, len(_OPENSSH), 3)
    keys = int.from_bytes(data[at : at + 4], "big") if at is not None else 0
    return _fields(data, at + 4, keys + 1) if 1 <= keys <= _MOST_KEYS else None


def _is_key(data: bytes) -> bool:
    return is_der_key(data) or is_openssh_key(data)


def _base64_key(text: str, start: int) -> int | None:
    """Where the key ends whose base64 begins at ``start``. A key says how long it is, so that no
    more is read, and what follows on further lines is no part of it; the line on which it ends must
    hold nothing else."""
    if text[start] == "M":
        size = _der_extent(_decoded(text[start : start + 16]))
    else:
        size, most = None, 1 << 12
        while size is None:  # its length is the sum of its fields'
            signs, _, _ = _signs(text, start, most)
            size = _openssh_extent(_decoded(signs[: len(signs) - (len(signs) % 4 == 1)]) or b"")
            if size is None and len(signs) < most:
                return None
            most *= 4
    want = -(-(size or 0) * 4 // 3)
    signs, stop, more = _signs(text, start, want)
    data = _decoded(signs) if want and len(signs) == want and not more else None
    return _PADDING.match(text, stop).end() if data and _is_key(data) else None


def _object(part: str) -> dict | None:
    data = _decoded(part)
    try:
        value = json.loads(data.decode("utf-8")) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(run: str) -> bool:
    head, body, signature = run.split(".")
    header = _object(head)
    if header is None or not isinstance(header.get("alg"), str) or _object(body) is None:
        return False
    name, size = header["alg"].upper(), len(_decoded(signature) or b"")
    return size == _SIGNATURES[name] if name in _SIGNATURES else name in _RSA and size >= 128 and size % 8 == 0


def confirmed_spans(text: str) -> list[Span]:
    """Keys and signed tokens whose structure holds."""
    found, at = [], 0
    while m := _BEGINS.search(text, at):
        stop = _base64_key(text, m.start())
        if stop is not None:
            found.append(Span("private_key", m.start(), stop))
        at = stop or m.end()
    for m in _HEXED.finditer(text):
        if len(m.group()) % 2 == 0 and _is_key(bytes.fromhex(m.group())):
            found.append(Span("private_key", *m.span()))
    return found + [Span("signed_token", *m.span()) for m in _TOKEN.finditer(text) if is_signed_token(m.group())]


def find_secrets(text: str) -> list[Span]:
    """All spans by start, then by kind as listed in KINDS."""
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def scan_batch(texts: pa.Array) -> list[list[Span]]:
    """The spans of each text of a batch. Only texts that a linear matcher finds to hold a candidate
    become Python strings, a slice of the batch at a time."""
    maybe = pc.fill_null(pc.match_substring_regex(texts, _CANDIDATE), False)
    found = (find_secrets(t) for _, _, part in text_slices(texts.filter(maybe)) for t in part)
    return [next(found) if flag else [] for flag in maybe.to_pylist()]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan_secrets(df: DataFrame, *, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep``, unchanged, with ``secrets``: an array of (kind, start, end), in code
    points, end exclusive, by start, then kind; where a kept column has that name, the added one gets
    an underscore behind it. Spans of different kinds may overlap.

    Every row gives one row, also repeated rows and null ids. Null and empty texts have no spans;
    texts are searched whole, however long. An empty table gives no rows."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[s._asdict() for s in spans] for spans in scan_batch(batch)], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = F.arrow_udf(run, SPANS)(F.col(f"`{text_col}`").cast("string"))
    return unpacked(df.select(as_struct(keep).alias("row"), found.alias("secrets")), "row", ["secrets"])
