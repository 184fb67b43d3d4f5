"""Secret scans: pattern candidates, and encoded keys reported only after their structure is confirmed.

Three base kinds are found by pattern. Further candidates, runs of base64 or hex, are decoded and
reported only if what they hold parses: a DER key whose nested lengths fit, an OpenSSH key blob whose
length-prefixed fields fit, or a signed token whose header is a JSON object with an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import batches_of, ship

ship(__name__)

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "der", "ssh", "token")

ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS = 12

#: First characters of whatever ``confirmed`` accepts: a sequence, a key name after its length, ``openssh-key-v1``.
#: They stand at the start of a run, after a slash, or after a line break that is written as a backslash and a letter.
KEY_START = re.compile(
    r"(?:(?<![A-Za-z0-9+])|(?<=\\[nrt]))(?:M[A-I]|A[A-Za-z0-9+/]{5}(?:N[rz]|Vj)|b3BlbnNzaC1rZXktdjEA)"
)
KEY_LINE = re.compile(r"[A-Za-z0-9+/]+")
PADDING = re.compile(r"={0,2}")
LINE_BREAK = re.compile(r"[\x20\t]*(?:\\+r)?(?:\r?\n|\\+n)[\x20\t]*")
#: No key is shorter, in bytes, or has more elements at one level.
LEAST_KEY, MOST_PARTS = 30, 10
HEX_RUN = re.compile(r"[0-9A-Fa-f]{64,}")
#: Words joined by dots, three or more; and the places in a word where a header can start besides its first character.
TOKEN_CHAIN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){2,}")
TOKEN_START = re.compile(r"\A|e(?:y[A-DI-L]|w[k-r0-3])")
TOKEN_HEADER = 12


Read = Callable[[int, int], bytes]  # bytes from a place on, so many or as many as there are


def der_element(read: Read, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the element at ``at``; None unless it fits in ``end``."""
    if at + 2 > end:
        return None
    head = read(at, 6)
    tag, size, at = head[0], head[1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size, at = int.from_bytes(head[2 : 2 + n], "big"), at + n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def der_children(read: Read, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """All elements of a constructed content; None unless they fill it exactly, ``MOST_PARTS`` at most."""
    out = []
    while at < end:
        e = der_element(read, at, end)
        if e is None or len(out) == MOST_PARTS:
            return None
        out.append(e)
        at = e[2]
    return out


def is_der_key(read: Read, size: int) -> bool:
    """A sequence over all bytes that is shaped as one of the usual key encodings.

    PKCS#1 (nine integers, or two for a public key), SEC 1 (integer 1, octets), PKCS#8 (integer,
    sequence with an object identifier, octets), subject public key (sequence, bit string). Only
    heads of elements are read, ten at most at one level, however much the key claims to hold.
    """
    top = der_element(read, 0, size)
    if top is None or top[0] != 0x30 or top[2] != size:
        return False
    parts = der_children(read, top[1], top[2])
    if not parts:
        return False
    tags = [p[0] for p in parts]
    if tags in ([2] * 9, [2] * 2):
        return all(b > a for _, a, b in parts) and max(b - a for _, a, b in parts) >= 32
    if tags[:2] == [2, 4] and parts[0][2] - parts[0][1] == 1 and read(parts[0][1], 1) == b"\x01":
        return parts[1][2] - parts[1][1] >= 16
    algorithm = parts[1] if tags[:3] == [2, 0x30, 4] else parts[0] if tags == [0x30, 3] else None
    if algorithm is None:
        return False
    inner = der_children(read, algorithm[1], algorithm[2])
    return bool(inner) and inner[0][0] == 6


#: No name of the protocol has more characters.
SSH_NAME, MOST_NAME = re.compile(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+"), 64


def ssh_fields(read: Read, size: int, at: int, most: int) -> list[tuple[int, int]]:
    """Bounds of length-prefixed fields from ``at`` on; a second key name starts the next key."""
    out: list[tuple[int, int]] = []
    while len(out) < most and at + 4 <= size:
        n = int.from_bytes(read(at, 4), "big")
        if at + 4 + n > size or len(out) > 1 and n <= MOST_NAME and SSH_NAME.fullmatch(read(at + 4, n)):
            break
        out.append((at + 4, at + 4 + n))
        at += 4 + n
    return out


def ssh_sizes(read: Read, size: int) -> Iterator[int]:
    """How many bytes a key blob that starts here may have, most likely first.

    ``openssh-key-v1`` with three names and then one public and one private part, or a public blob: a name and further fields.
    """
    if read(0, 15) == b"openssh-key-v1\0":
        names = ssh_fields(read, size, 15, 3)
        if len(names) < 3 or not 0 < names[0][1] - names[0][0] <= MOST_NAME or not read(names[0][0], names[0][1] - names[0][0]).isascii():
            return
        parts = ssh_fields(read, size, names[2][1] + 4, 2)
        if len(parts) == 2:
            yield parts[1][1]
        yield size
        return
    parts = ssh_fields(read, size, 0, 16)
    if len(parts) < 2 or parts[0][1] - 4 > MOST_NAME or not SSH_NAME.fullmatch(read(4, parts[0][1] - 4)):
        return
    yield from (end for _, end in reversed(parts[1:]))
    if len(parts) == 16:
        yield size


def confirmed(data: bytes) -> str | None:
    def read(at: int, n: int) -> bytes:
        return data[at : at + n]

    return "der" if is_der_key(read, len(data)) else "ssh" if len(data) in ssh_sizes(read, len(data)) else None


class Run:
    """Base64 lines that follow each other from one place of a text on, read once for all keys that may start in them."""

    def __init__(self, text: str, at: int):
        parts, self.starts, self.places, n = [], [], [], 0
        self.ends: dict[int, int] = {}  # after so many characters a line ends at this place of the text
        while m := KEY_LINE.match(text, at):
            self.starts.append(at)
            self.places.append(n)
            parts.append(m[0])
            n += len(m[0])
            end = self.ends[n] = PADDING.match(text, m.end()).end()
            gap = LINE_BREAK.match(text, m.end()) if end == m.end() else None
            self.stop = m.end()
            if not gap:
                break
            at = gap.end()
        self.chars = "".join(parts).encode()

    def place(self, at: int) -> int:
        """Which of the characters stands at a place of the text."""
        line = bisect_right(self.starts, at) - 1
        return self.places[line] + at - self.starts[line]

    def reader(self, first: int) -> Read:
        """Decoded bytes from a character on."""

        def read(at: int, n: int) -> bytes:
            low = at // 3
            held = self.chars[first + 4 * low : first + 4 * -(-(at + n) // 3)]
            if len(held) % 4 == 1:
                held = held[:-1]
            return binascii.a2b_base64(held + b"=" * (-len(held) % 4))[at - 3 * low : at - 3 * low + n]

        return read

    def key(self, first: int) -> tuple[str, int] | None:
        """Kind and end, in the text, of the key that starts at a character; it closes with a line."""
        size = (len(self.chars) - first) * 3 // 4
        if size < LEAST_KEY:
            return None
        head = binascii.a2b_base64(self.chars[first : first + 8])
        if head[0] == 0x30:
            long = head[1] & 0x7F if head[1] >= 0x80 else 0
            n = 2 + long + int.from_bytes(head[2 : 2 + long], "big") if long else 2 + head[1]
            end = self.ends.get(first + (4 * n + 2) // 3)
            if long > 4 or not LEAST_KEY <= n <= size or end is None:
                return None
            return ("der", end) if is_der_key(self.reader(first), n) else None
        for n in ssh_sizes(self.reader(first), size):
            end = self.ends.get(first + (4 * n + 2) // 3)
            if n >= LEAST_KEY and end is not None:
                return "ssh", end
        return None


def find_keys(text: str) -> Iterator[tuple[int, str, int]]:
    """Encoded keys of the text. What a key says of its own size decides at which line it ends."""
    at, run = 0, None
    while m := KEY_START.search(text, at):
        if run is None or m.start() >= run.stop:
            run = Run(text, m.start())
        if key := run.key(run.place(m.start())):
            yield m.start(), *key
            at = key[1]
        else:
            at = m.start() + 1


def decoded(word: str) -> bytes | None:
    try:
        return base64.urlsafe_b64decode(word + "=" * (-len(word) % 4))
    except (ValueError, binascii.Error):
        return None


def json_object(data: bytes | None) -> dict | None:
    try:
        found = json.loads(data) if data is not None else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def header_starts(word: str) -> Iterator[int]:
    """Places of a word from which it decodes to a JSON object with an algorithm."""
    plain: dict[int, str] = {}  # by where groups of four characters begin; decoded once, however many starts there are
    for s in TOKEN_START.finditer(word):
        at = s.start()
        if len(word) - at < TOKEN_HEADER or (len(word) - at) % 4 == 1:
            continue
        if at:
            if at % 4 not in plain:
                plain[at % 4] = (decoded(word[at % 4 :]) or b"").decode("latin-1")
            text = plain[at % 4]
            try:
                if not text.endswith("}") or json.JSONDecoder().raw_decode(text, (at - at % 4) // 4 * 3)[1] != len(text):
                    continue
            except (ValueError, RecursionError):
                continue
        head = json_object(decoded(word[at:]))
        if head is not None and isinstance(head.get("alg"), str):
            yield at


def find_tokens(text: str) -> Iterator[tuple[int, str, int]]:
    """Signed tokens: each word of a chain may be the header, from any place where an object can start."""
    for m in TOKEN_CHAIN.finditer(text):
        words = m[0].split(".")
        at, k = m.start(), 0
        while k + 2 < len(words):
            end = at + len(words[k]) + len(words[k + 1]) + len(words[k + 2]) + 2
            signed = len(words[k]) >= TOKEN_HEADER and len(words[k + 2]) % 4 != 1 and json_object(decoded(words[k + 1])) is not None
            start = next(header_starts(words[k]), None) if signed else None
            if start is None:
                at, k = at + len(words[k]) + 1, k + 1
            else:
                yield at + start, "token", end
                at, k = end + 1, k + 3


def find_secrets(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all spans of one text, in order."""
    out = []
    if "=" in text or ":" in text:
        out += [
            (m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_CHARS
        ]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    out += find_keys(text)
    for m in HEX_RUN.finditer(text):
        if kind := confirmed(bytes.fromhex(m[0][: len(m[0]) // 2 * 2])):
            out.append((m.start(), kind, m.end()))
    if "." in text:
        out += find_tokens(text)
    return sorted(set(out), key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ``spans``, an array of (kind, start, end) in code points.

    The whole text is read; null and empty texts have no span. Spans of different kinds may overlap,
    those of one kind don't. Repeated rows are scanned one by one, an empty table gives none, and
    other columns take no part. Nothing is shuffled.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole):
                found = [
                    [{"kind": k, "start": s, "end": e} for s, k, e in find_secrets(t or "")]
                    for t in batch.column(1).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(found, pa.list_(SPAN))], [id_col, "spans"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        scan, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    )


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in find_secrets(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the secrets of its texts replaced; null stays null, all columns stay."""
    place = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole):
                texts = [None if t is None else redact(t) for t in batch.column(place).to_pylist()]
                yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(clean, docs.schema)
