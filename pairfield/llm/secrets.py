"""Secret scans: keywords by Aho-Corasick, expressions near their hits only, checksums inside the finds.

One automaton over the text (A-Z lower-cased) finds the keywords of all kinds. At
a hit the kind's expression is matched where the keyword stands and nowhere else,
and a find that carries a checksum or a length of its own must agree with it.

Kinds, in the order in which finds of one start are listed:

- assign: a keyword, = or :, and a value of LEAST_VALUE characters or more;
- access: AKIA and capitals or digits, LEAST_ACCESS characters or more;
- hex: LEAST_HEX lower-case hexadecimal digits or more. No keyword is part of it;
  a run that long holds PROBES places in a row of every STEP-th byte, and only
  where all of those are digits the run is looked at;
- github, npm: a token whose last six characters are the CRC-32 of the others in base 62;
- xprv: an extended private key in base 58 whose last four bytes agree with SHA-256 of SHA-256;
- jwt: three parts, the first a JSON object that names its algorithm;
- pem: a private key's block whose DER length is the block's, or with OpenSSH's magic.

Finds of one kind don't overlap: from left to right each takes its characters,
also one that then fails its length or checksum. Letters of assign's keywords are
ASCII. Places are code points, ends exclusive.

Null and empty texts hold nothing. Each row is scanned by itself: repeated rows
and null ids change nothing, an empty table gives an empty result. Other columns
pass through; one named `secrets` is replaced. Texts are taken whole, of any length.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_buffers, without

LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
BASE = ("assign", "access", "hex")
STEP = 4
PROBES = LEAST_HEX // STEP
# The digits of base 62 and base 58, and the magic of OpenSSH's keys.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
OPENSSH = b"openssh-key-v1\0"


def _ends_in_crc(m: re.Match) -> bool:
    body, said = m[1][:-6], m[1][-6:]
    value = 0
    for c in said:
        value = value * 62 + BASE62.index(c)
    return value == crc32(body.encode())


def _base58_checked(m: re.Match) -> bool:
    value = 0
    for c in m[0]:
        value = value * 58 + BASE58.index(c)
    if value >= 1 << (82 * 8):
        return False
    raw = value.to_bytes(82, "big")
    return sha256(sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _names_algorithm(m: re.Match) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def _is_key(m: re.Match) -> bool:
    try:
        raw = base64.b64decode("".join(m[2].split()), validate=True)
    except ValueError:
        return False
    if raw.startswith(OPENSSH):
        return True
    if len(raw) < 2 or raw[0] != 0x30:
        return False
    wide = raw[1] & 0x7F if raw[1] & 0x80 else 0
    size = int.from_bytes(raw[2 : 2 + wide], "big") if wide else raw[1]
    return len(raw) == 2 + wide + size


class Kind:
    """name; keywords (lower case); the expression that starts where a keyword does; check: what a match must pass; letter: what may not stand before it."""

    def __init__(self, name: str, keywords: tuple[str, ...], pattern: str, check: Callable[[re.Match], bool], flags: int = 0, letter: str = ""):
        self.name, self.keywords, self.match, self.check = name, keywords, re.compile(pattern, re.ASCII | flags).match, check
        self.before = re.compile(letter, re.ASCII).match if letter else None


KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= LEAST_VALUE, re.IGNORECASE),
    Kind("access", ("akia",), "AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= LEAST_ACCESS),
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])", _ends_in_crc, letter="[0-9A-Za-z_]"),
    Kind("npm", ("npm_",), "npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])", _ends_in_crc, letter="[0-9A-Za-z_]"),
    Kind("xprv", ("xprv",), f"xprv[{BASE58}]{{107}}(?![0-9A-Za-z])", _base58_checked, letter="[0-9A-Za-z]"),
    Kind("jwt", ("eyj",), r"(eyJ[A-Za-z0-9_-]+)\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", _names_algorithm, letter=r"[A-Za-z0-9_.-]"),
    Kind("pem", ("-----begin ",), r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----", _is_key),
)
#: Kinds in the order in which they are listed.
ORDER = ("assign", "access", "hex", "github", "npm", "xprv", "jwt", "pem")


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    made = ahocorasick.Automaton()
    for kind in KINDS:
        for word in kind.keywords:
            made.add_word(word, (len(word), kind))
    made.make_automaton()
    return made


def near_keywords(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, place in ORDER, end) of finds that have a keyword; low: text with A-Z in lower case."""
    found, taken = [], {}
    for last, (size, kind) in automaton().iter(low):
        start = last + 1 - size
        if start < taken.get(kind.name, 0) or kind.before and start and kind.before(text, start - 1):
            continue
        if m := kind.match(text, start):
            taken[kind.name] = m.end()
            if kind.check(m):
                found.append((start, ORDER.index(kind.name), m.end()))
    return found


_HEX = np.zeros(256, bool)
_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True


def hex_runs(data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Runs of LEAST_HEX digits or more in each text (code points); data: UTF-8 bytes of texts with these offsets."""
    probes = _HEX[data[::STEP]]
    full = probes.copy()
    for i in range(1, PROBES):
        full[:-i] &= probes[i:]
        full[len(full) - i :] = False
    out: dict[int, list[tuple[int, int]]] = {}
    whole, done = memoryview(data).cast("B"), {}
    for at in (np.flatnonzero(full) * STEP).tolist():
        # texts meet without a gap: a run ends with its text
        doc = int(np.searchsorted(offsets, at, "right")) - 1
        begin, end = int(offsets[doc]), int(offsets[doc + 1])
        byte, point = done.get(doc, (begin, 0))
        if at < byte:
            continue
        start = at
        while start > byte and _HEX[data[start - 1]]:
            start -= 1
        stop = re.compile(rb"[0-9a-f]+").match(whole, start, end).end()
        point += int(np.count_nonzero((data[byte:start] & 0xC0) != 0x80))
        done[doc] = (stop, point + stop - start)
        if stop - start >= LEAST_HEX:
            out.setdefault(doc, []).append((point, point + stop - start))
    return out


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `secrets`: an array of (kind, start, end), by start, then kind."""
    docs = without(docs, "secrets")
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in sliced(batches, text):
            texts = batch.column(batch.schema.get_field_index(text))
            runs = hex_runs(*text_buffers(texts))
            low = pc.ascii_lower(texts).to_pylist()
            made = []
            for i, t in enumerate(texts.to_pylist()):
                found = near_keywords(t, low[i]) if t else []
                found += [(a, ORDER.index("hex"), b) for a, b in runs.get(i, ())]
                made.append([{"kind": ORDER[k], "start": a, "end": b} for a, k, b in sorted(found)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(span))], [*batch.schema.names, "secrets"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", secrets array<struct<kind: string, start: bigint, end: bigint>>"
    return docs.mapInArrow(run, schema)


def shown(secrets: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number(secrets: Column, kind: str) -> Column:
    return F.size(F.filter(secrets, lambda s: s["kind"] == kind)).cast("long")
