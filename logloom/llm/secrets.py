"""Secret scan: Aho-Corasick keyword prefilter, anchored expressions at hits only, checksums where the format has one.

Kinds, in the order used for ties: assign, access, hex (the base), then github, npm (each ends in a base-62 CRC-32 of
its body, which must agree), jwt (its first part must decode to a JSON object), pem (a private key block with both
ends). For each base kind matches are leftmost and do not overlap, and those too short are dropped afterwards. Spans
count code points, the end exclusive.

A text is scanned in time in proportion to its length, whatever it repeats: where a format fails for want of what must
follow a run of characters, no later start within that run is tried, and the ends of key blocks are found once.

Cases: null counts as empty; a document without spans has empty strings of spans; a part that holds JSON nested too
deeply to be decoded is no jwt; repeated rows come out each; very long texts are scanned whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
#: Keywords that start an assignment (any case), and prefixes of tokens with their formats.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
PREFIXES = {"AKIA": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyJ": "jwt", "-----BEGIN": "pem"}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("password|passwd|secret|token|api_?key", "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else f"{c}?" for c in w) for w in ("password", "passwd", "secret", "token", "api_key"))))
_HEX = re.compile(r"[0-9a-f]{32,}")
_FORMS = {
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "npm": re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
}
_JWT_RUN = re.compile(r"[A-Za-z0-9_-]*")
_PEM_HEAD, _PEM_TAIL, _PEM_BODY = re.compile(r"-----BEGIN ([A-Z ]{0,40})PRIVATE KEY-----"), re.compile(r"(?=(-----END ([A-Z ]{0,40})PRIVATE KEY-----))"), re.compile(r"[A-Za-z0-9+/=\s:,-]*")
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes of hexadecimal digits become h, all others a space: a run of 32 is then a keyword too.
_HEXED = bytes(ord("h") if chr(b) in "0123456789abcdef" else 32 for b in range(256))

_built: list = []


def _automata():
    if not _built:
        import ahocorasick

        a = ahocorasick.Automaton()
        for w in ASSIGN_WORDS:
            a.add_word(w, ("assign", len(w)))
        for w, kind in PREFIXES.items():  # in folded text; the expression looks at the text itself
            a.add_word(w.lower(), (kind, len(w)))
        a.make_automaton()
        _built.append(a)
    return _built[0]


def checksum62(body: str) -> str:
    """CRC-32 of the body in six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def _valid(kind: str, m: re.Match) -> bool:
    if kind in ("github", "npm"):
        return checksum62(m[1]) == m[2]
    if kind == "jwt":
        try:
            return isinstance(json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4))), dict)
        except (ValueError, RecursionError):
            return False
    return True


class KeyBlocks:
    """Ends of private key blocks of one text: the terminators are listed once, a body's characters are read once."""

    def __init__(self, text: str):
        self.text, self.run = text, (0, -1)
        self.ends: dict[str, list[int]] = {}
        for m in _PEM_TAIL.finditer(text):
            self.ends.setdefault(m[2], []).append(m.start())

    def end(self, at: int) -> int | None:
        """End of the block whose header begins at `at`; None if there is no header, or its body or end is not there."""
        head = _PEM_HEAD.match(self.text, at)
        if not head or head[1] not in self.ends:
            return None
        ends, body = self.ends[head[1]], head.end()
        i = bisect_left(ends, body)
        if i == len(ends):
            return None
        if not self.run[0] <= body <= self.run[1]:
            self.run = (body, _PEM_BODY.match(self.text, body).end())
        return ends[i] + len(f"-----END {head[1]}PRIVATE KEY-----") if ends[i] <= self.run[1] else None


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of all secrets, sorted."""
    if not text:
        return []
    out = []
    raw = text.encode()
    if raw.translate(_HEXED).find(b"h" * 32) >= 0:
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    folded = text.lower() if len(raw) == len(text) else raw.translate(_FOLD).decode()
    last, blocks = dict.fromkeys(KINDS, 0), None
    for end, (kind, n) in _automata().iter(folded):
        at = end - n + 1
        if at < last[kind]:
            continue
        if kind == "pem":
            blocks = blocks or KeyBlocks(text)
            if (stop := blocks.end(at)) is not None:
                last[kind] = stop
                out.append((at, KINDS.index(kind), stop))
            continue
        m = (_ASSIGN if kind == "assign" else _FORMS[kind]).match(text, at)
        if not m:
            if kind == "jwt" and text.startswith("eyJ", at):  # what must follow its first run is not there for any start in that run
                last[kind] = _JWT_RUN.match(text, at).end()
            continue
        last[kind] = m.end()
        if kind == "assign" and len(m[2]) < 8 or kind == "access" and len(m[0]) < 16 or not _valid(kind, m):
            continue
        out.append((at, KINDS.index(kind), m.end()))
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_documents(docs: DataFrame) -> DataFrame:
    schema = C.arrow_schema(_OUT)

    def run(it):
        for b in C.batches_of(it):
            found = [scan(t) for t in b.column(1).to_pylist()]
            n = [pa.array([sum(s[1] == k for s in x) for x in found], pa.int64()) for k in range(3)]
            base = [hashlib.sha256(joined(s for s in x if s[1] < 3).encode()).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), *n, pa.array(base, pa.string()), pa.array([joined(x) for x in found], pa.string())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _OUT)
