"""Secret scan with structural confirmation.

Three plain patterns give the base spans. The method adds spans of encoded material, reported only where decoding proves
the structure of something secret:

- DER (base64 of either alphabet, or hex): one SEQUENCE of the shape of a private key (PKCS#8, its encrypted form, PKCS#1,
  SEC 1, DSA) whose elements' nested lengths fill it exactly; public keys and certificates have other shapes;
- an OpenSSH private key: magic, length-prefixed fields, public keys with a type, equal check numbers where unencrypted;
- an armour around one of these, around a legacy encrypted body, or around an OpenPGP secret-key packet;
- base64 of a text that holds such an armour;
- a signed token: a JSON header that names an algorithm and a JSON payload.

Encoded keys are found wrapped in lines (also escaped or indented), beside other letters of the alphabet, padded or not.
Candidates are checked by hopping over element lengths, so a text costs time in proportion to its length.

Spans are code-point offsets, end exclusive. Null and empty texts have no spans. The scan is one pass over each whole
text, without a shuffle. Null ids stay null, repeated rows give repeated results and an empty table gives none. `scan`
reads the id and text columns alone; `redact_documents` keeps all columns, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import ship_package

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ of 24 characters or more: a run begins where it first can
#: Kinds in the order in which equal starts are listed: the base, then what the method adds.
KINDS = ("assign", "access", "hex", "private_key", "der", "ssh_key", "signed_token", "hex_der", "hex_ssh_key", "nested_key")

MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?)-----")
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
#: Base64 or hex over one line or more, of either base64 alphabet, and what parts the lines (also escaped).
BREAK = re.compile(r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*")
BASE64_LINES = re.compile(rf"[A-Za-z0-9+/_-]{{16,}}(?:{BREAK.pattern}[A-Za-z0-9+/_-]+)*")
HEX_LINES = re.compile(rf"[0-9a-fA-F]{{16,}}(?:{BREAK.pattern}[0-9a-fA-F]+)*")
#: Where a SEQUENCE, the OpenSSH magic or "-----BEGIN" can begin.
BASE64_KEY = re.compile(r"M(?=[A-P])|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi")
HEX_KEY = re.compile(r"30(?=[1-8])|6f70656e7373682d6b65792d763100")
_PLAIN = str.maketrans("-_", "+/")
MAGIC = b"openssh-key-v1\0"
#: Beginnings of the object identifiers of password-based encryption (PKCS#5 and PKCS#12). Fixed values.
ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
#: First bytes of an OpenPGP packet that holds a secret key, in the old and the new format. Fixed values.
PGP_SECRET = (0x94, 0x95, 0x96, 0xC5)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three base kinds, leftmost and non-overlapping in each kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def decode_base64(text: str) -> bytes | None:
    """Bytes of a base64 or base64url text, padded or not; None where it is neither."""
    body = re.sub(r"\s", "", text).rstrip("=").translate(_PLAIN)
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


# ------------------------------------------------------------------------------------------------- encoded runs


class Encoded:
    """Bytes that a run of encoded characters stands for from one place on, decoded only where they are looked at."""

    def __init__(self, run: str, at: int, hexadecimal: bool) -> None:
        self.run, self.at, self.hexadecimal = run, at, hexadecimal
        left = len(run) - at
        self.size = left // 2 if hexadecimal else left * 3 // 4

    def chars(self, size: int) -> int:
        """Characters that encode so many bytes."""
        return 2 * size if self.hexadecimal else -(-size * 4 // 3)

    def read(self, begin: int, end: int) -> bytes:
        end = min(end, self.size)
        if begin >= end:
            return b""
        if self.hexadecimal:
            return bytes.fromhex(self.run[self.at + 2 * begin : self.at + 2 * end])
        first = begin // 3
        chunk = self.run[self.at + 4 * first : self.at + self.chars(end)]
        return base64.b64decode(chunk + "=" * (-len(chunk) % 4))[begin - 3 * first : end - 3 * first]


class Plain(Encoded):
    """The same over bytes."""

    def __init__(self, data: bytes) -> None:
        self.data, self.size = data, len(data)

    def read(self, begin: int, end: int) -> bytes:
        return self.data[begin:end]


def der_element(source: Encoded, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start of value, end of value) of the element at a place, within `end`."""
    head = source.read(at, min(at + 6, end))
    if len(head) < 2:
        return None
    length, begin = head[1], at + 2
    if length & 0x80:
        n = length & 0x7F
        if not 1 <= n <= 4 or len(head) < 2 + n or head[2] == 0:
            return None
        length, begin = int.from_bytes(head[2 : 2 + n], "big"), begin + n
        if length < 0x80:
            return None
    return (head[0], begin, begin + length) if begin + length <= end else None


def der_children(source: Encoded, at: int, end: int, most: int = 16) -> list[tuple[int, int, int]] | None:
    """The elements that fill a value, at most so many; None where they don't fill it."""
    found = []
    while at < end and len(found) < most:
        element = der_element(source, at, end)
        if element is None:
            return None
        found.append(element)
        at = element[2]
    return found if at == end else None


def der_key_end(source: Encoded) -> int | None:
    """Where the private key that begins here ends; None where none begins."""
    top = der_element(source, 0, source.size)
    if top is None or top[0] != 0x30:
        return None
    parts = der_children(source, top[1], top[2])
    if not parts or any(tag == 2 and begin == end for tag, begin, end in parts):
        return None
    tags = [p[0] for p in parts]
    version = source.read(parts[0][1], parts[0][2])[:2] if tags[0] == 2 and parts[0][2] - parts[0][1] == 1 else None
    known = version in (b"\0", b"\1")
    inner = next((der_children(source, b, e) for tag, b, e in parts if tag == 0x30), None)
    named = bool(inner) and inner[0][0] == 6 and inner[0][2] > inner[0][1]
    pkcs8 = known and tags[1:3] == [0x30, 4] and named and set(tags[3:]) <= {0xA0, 0xA1, 0x81}
    rsa = known and tags[:9] == [2] * 9 and tags[9:] in ([], [0x30])
    dsa = version == b"\0" and tags == [2] * 6
    sec1 = version == b"\1" and tags[1:2] == [4] and len(tags) <= 4 and set(tags[2:]) <= {0xA0, 0xA1}
    locked = tags == [0x30, 4] and named and len(inner) == 2 and source.read(inner[0][1], inner[0][2]).startswith(ENCRYPTION)
    return top[2] if pkcs8 or rsa or dsa or sec1 or locked else None


def ssh_field(source: Encoded, at: int) -> tuple[int, int] | None:
    """(start, end) of the length-prefixed field at a place."""
    head = source.read(at, at + 4)
    end = at + 4 + int.from_bytes(head, "big")
    return (at + 4, end) if len(head) == 4 and end <= source.size else None


def ssh_key_end(source: Encoded) -> int | None:
    """Where the OpenSSH private key that begins here ends; None where its fields don't parse to the end."""
    at = len(MAGIC)
    if source.read(0, at) != MAGIC:
        return None
    cipher = b""
    for k in range(3):  # cipher, key derivation, its options
        field = ssh_field(source, at)
        if field is None:
            return None
        if k < 2:
            name = source.read(*field)
            if not name or len(name) > 64 or not name.isascii() or not name.decode().isprintable():
                return None
            cipher = cipher or name
        at = field[1]
    count = int.from_bytes(source.read(at, at + 4), "big")
    at += 4
    if not 1 <= count <= 64:
        return None
    for _ in range(count):  # public keys, each beginning with its type
        field = ssh_field(source, at)
        kind = ssh_field(source, field[0]) if field else None
        if kind is None or kind[1] > field[1] or not source.read(*kind).startswith((b"ssh-", b"ecdsa-sha2-", b"sk-")):
            return None
        at = field[1]
    field = ssh_field(source, at)
    if field is None or field[1] - field[0] < 8:
        return None
    check = source.read(field[0], field[0] + 8)
    return field[1] if cipher != b"none" or check[:4] == check[4:] else None


def private_key_end(source: Encoded) -> int | None:
    """Where the private key that begins here ends, of either kind."""
    return ssh_key_end(source) if source.read(0, 4) == MAGIC[:4] else der_key_end(source)


# ------------------------------------------------------------------------------------------------- armours


def armours(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, label, body) of each END mark with the nearest BEGIN mark before it, if that has the same label."""
    begun = None
    for m in MARK.finditer(text):
        if m[1] == "BEGIN":
            begun = m
        elif begun is not None:
            if begun[2] == m[2]:
                yield begun.start(), m.end(), m[2], text[begun.end() : m.start()]
            begun = None


def is_armoured_key(label: str, body: str) -> bool:
    """Whether what an armour holds decodes to a private key."""
    lines = [x.strip() for x in body.replace("\\r", "").replace("\\n", "\n").split("\n")]
    headers = dict(x.split(":", 1) for x in lines if ":" in x)
    raw = decode_base64("".join(x for x in lines if ":" not in x and not x.startswith("=")))
    if not raw:
        return False
    if label.endswith("BLOCK"):
        return raw[0] in PGP_SECRET
    if "ENCRYPTED" in headers.get("Proc-Type", ""):  # the legacy form: whole cipher blocks and their initial vector
        vector = headers.get("DEK-Info", "").partition(",")[2].strip()
        return re.fullmatch(r"[0-9A-Fa-f]{16}|[0-9A-Fa-f]{32}", vector) is not None and len(raw) % (len(vector) // 2) == 0
    return private_key_end(Plain(raw)) == len(raw)


#: No text has these, but bytes decoded beyond the end of what was encoded together do.
NO_TEXT = re.compile(rb"[\x00-\x08\x0e-\x1a\x1c-\x1f\x7f]")


def nested_key_end(source: Encoded) -> tuple[int | None, int]:
    """(where the first armoured private key in the text that begins here ends or None, bytes that were looked at): decoded
    in growing stretches, so that a key costs its own length."""
    size = 4_096
    while True:
        data = source.read(0, size)
        stop = NO_TEXT.search(data)
        data = data[: stop.start()] if stop else data
        found = next((end for _, end, label, body in armours(data.decode("latin-1")) if is_armoured_key(label, body)), None)
        if found is not None or stop or size >= source.size:
            return found, len(data)
        size *= 4


# ------------------------------------------------------------------------------------------------- candidates


def joined(text: str, lines: re.Pattern) -> Iterator[tuple[str, list[int], list[int]]]:
    """(characters without line breaks, where each line begins in them, and in the text) of encoded runs."""
    for m in lines.finditer(text):
        parts, inner, outer, at, size = [], [], [], 0, 0
        for part in [*BREAK.finditer(m[0]), None]:
            stop = part.start() if part else len(m[0])
            inner.append(size)
            outer.append(m.start() + at)
            parts.append(m[0][at:stop])
            size += stop - at
            at = part.end() if part else at
        yield "".join(parts), inner, outer


def encoded_spans(text: str) -> Iterator[tuple[int, int, str]]:
    """Private keys in base64 or hex."""
    ways = ((BASE64_LINES, BASE64_KEY, False, ("der", "ssh_key", "nested_key")), (HEX_LINES, HEX_KEY, True, ("hex_der", "hex_ssh_key", "")))
    for lines, begins, hexadecimal, kinds in ways:
        for run, inner, outer in joined(text, lines):
            if len(run) < 40:
                continue
            run = run.lower() if hexadecimal else run.translate(_PLAIN)
            done, searched = 0, [0] * 4  # what ends a nested key, by the place of its first character among four
            for m in begins.finditer(run):
                if m.start() < done:
                    continue
                source = Encoded(run, m.start(), hexadecimal)
                which = 0 if len(m[0]) <= 2 else 1 if len(m[0]) > 14 else 2
                if which == 2:
                    if m.start() < searched[m.start() % 4]:
                        continue
                    size, seen = nested_key_end(source)
                    if not size:
                        searched[m.start() % 4] = m.start() + source.chars(seen)
                else:
                    size = ssh_key_end(source) if which else der_key_end(source)
                if not size:
                    continue
                done = min(len(run), m.start() + source.chars(size))
                a, b = bisect_right(inner, m.start()) - 1, bisect_right(inner, done - 1) - 1
                stop = outer[b] + done - inner[b]
                if not hexadecimal:
                    stop += len(re.match("={0,2}", text[stop : stop + 2])[0])
                yield outer[a] + m.start() - inner[a], stop, kinds[which]


def is_signed_token(text: str) -> bool:
    """Header and payload are JSON objects and the header names its algorithm."""
    head, body, signature = text.split(".", 2)
    parts = []
    for part in (head, body):
        raw = decode_base64(part)
        try:
            parts.append(json.loads(raw) if raw is not None else None)
        except (ValueError, RecursionError):
            return False
    return isinstance(parts[0], dict) and isinstance(parts[0].get("alg"), str) and isinstance(parts[1], dict) and (signature != "" or parts[0]["alg"] == "none")


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """What the structure of decoded candidates confirms; what lies inside an armour or a token counts there."""
    found = [(start, end, "private_key") for start, end, label, body in armours(text) if is_armoured_key(label, body)] if "PRIVATE KEY" in text else []
    if ("ey" in text or "ew" in text) and "." in text:
        found += [(m.start(), m.end(), "signed_token") for m in SIGNED.finditer(text) if is_signed_token(m[0])]
    found.sort()
    begins = [s for s, _, _ in found]

    def inside(start: int, end: int) -> bool:
        k = bisect_right(begins, end - 1) - 1  # armours and tokens don't overlap: only the last that begins before can
        return k >= 0 and found[k][1] > start

    return found + [x for x in encoded_spans(text) if not inside(x[0], x[1])]


def listed(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def scan_text(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, added spans) of one text."""
    return (base_spans(text), confirmed_spans(text)) if text else ([], [])


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones merged, replaced by a mark."""
    parts, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


SPAN = "struct<kind:string,start:long,end:long>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_assign, n_access, n_hex, n_confirmed, base_sha256, spans and found (the spans as structs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for text in batch.column(1):
                base, added = scan_text(text.as_py())
                kinds = [x[2] for x in base]
                every = base + added
                row = (*(kinds.count(k) for k in KINDS[:3]), len(added), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), [{"kind": k, "start": s, "end": e} for s, e, k in sorted(every)])
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), span)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "n_confirmed", "base_sha256", "spans", "found"])

    ship_package(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id long, n_assign long, n_access long, n_hex long, n_confirmed long, base_sha256 string, spans string, found array<{SPAN}>")


def redact_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """All rows and columns with the secrets of `text_col` replaced by a mark and `chars_col`, if there, counted anew."""
    names, schema = docs.columns, docs.schema
    place = names.index(text_col)
    counted = names.index(chars_col) if chars_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            changed = {}
            for k, text in enumerate(texts):
                base, added = scan_text(text)
                if base or added:
                    changed[k] = redact(text, base + added)
            if not changed:
                yield batch
                continue
            columns = list(batch.columns)
            columns[place] = pa.array([changed.get(k, t) for k, t in enumerate(texts)], batch.column(place).type)
            if counted is not None:
                old = batch.column(counted).to_pylist()
                columns[counted] = pa.array([len(changed[k]) if k in changed else n for k, n in enumerate(old)], batch.column(counted).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    ship_package(docs.sparkSession)
    return docs.mapInArrow(run, schema)
