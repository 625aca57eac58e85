"""Frames, identifiers, directories and checksums as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Outcome codes by what a caller may do after them.
TRANSIENT = ("ResourceExhausted", "Unavailable", "DeadlineExceeded", "Internal")
FENCING = ("FailedPrecondition", "Aborted")
#: Fixed value: the reflected Castagnoli polynomial.
CRC32C_POLYNOMIAL = 0x82F63B78


def encoded_len(payload: Column) -> Column:
    return (F.octet_length(payload) + 4).cast("long")


def frame(payload: Column) -> Column:
    """Four bytes of total length, big-endian, then the payload."""
    return F.unhex(F.concat(F.lpad(F.hex(encoded_len(payload)), 8, "0"), F.hex(payload.cast("binary"))))


def majority(n: Column) -> Column:
    return (F.floor(n / 2) + 1).cast("long")


def segment_id(epoch: Column, seq: Column) -> Column:
    return F.lower(F.concat_ws("-", F.lpad(F.hex(epoch), 16, "0"), F.lpad(F.hex(seq), 8, "0")))


def id_epoch(ident: Column) -> Column:
    """The epoch in an identifier; null unless sixteen hexadecimal digits come before the first dash."""
    return F.when(F.regexp_like(ident, F.lit("^[0-9a-fA-F]{16}-")), F.conv(F.substring(ident, 1, 16), 16, 10).cast("long"))


def record_value(framed: Column) -> Column:
    """The first eight bytes of the SHA-256 as an unsigned number, as text."""
    return F.conv(F.substring(F.sha2(framed, 256), 1, 16), 16, 10)


def retry_delay(base: Column, attempt: Column) -> Column:
    return base * F.pow(F.lit(2), F.least(attempt, F.lit(16))).cast("long")


def clamp_us(us: Column) -> Column:
    return F.least(F.greatest(us, F.lit(1)), F.lit(599_000_000))


def has_room(length: Column, entries: Column, budget: Column) -> Column:
    return length + entries * 64 <= budget


def segment_object(prefix: Column, ident: Column) -> Column:
    return F.concat(prefix, F.lit("/segments/"), ident)


def next_seqno(record_index: Column) -> Column:
    """The boundary behind a record."""
    return record_index + 1


def expected_fault(code: Column, fault_observed: Column) -> Column:
    """Whether an error is to be expected: what ends a writer always, what a fault explains only if one was seen."""
    return F.when(code.isin("Poisoned", "Fenced", "Closed"), True).when(code.isin("NoReadQuorum", *TRANSIENT, *FENCING), fault_observed).otherwise(False)


def flipped(data: Column, at: Column) -> Column:
    """A binary with all bits of the byte at position `at` (from 0) turned."""
    other = F.unhex(F.lpad(F.hex(F.lit(255) - F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("int")), 2, "0"))
    return F.overlay(data, other, at + 1)


def valid_buckets(names: Column) -> Column:
    return F.size(names).isin(1, 3, 5) & (F.size(F.array_distinct(names)) == F.size(names)) & F.forall(names, lambda b: (b != "") & ~F.contains(b, F.lit(",")))


def crc32c_table() -> list[int]:
    table = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (CRC32C_POLYNOMIAL if i & 1 else 0)
        table.append(i)
    return table


def crc32c(data: Column) -> Column:
    """CRC-32C of a binary column, a batch at a time: the bytes at each position of all rows at once."""
    @F.pandas_udf("long")
    def run(col: pd.Series) -> pd.Series:
        import numpy as np

        table = np.array(crc32c_table(), np.uint32)
        rows = [np.frombuffer(x or b"", np.uint8) for x in col]
        order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        sizes = np.array([len(rows[i]) for i in order])
        flat = np.concatenate([rows[i] for i in order]) if rows else np.zeros(0, np.uint8)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if rows else np.zeros(0, np.int64)
        live = len(rows)
        for p in range(int(sizes[0]) if len(sizes) else 0):
            while live and sizes[live - 1] <= p:
                live -= 1
            c = crc[:live]
            crc[:live] = table[(c ^ flat[starts[:live] + p]) & 255] ^ (c >> np.uint32(8))
        out = np.empty(len(rows), np.int64)
        out[order] = crc ^ np.uint32(0xFFFFFFFF)
        return pd.Series(out)

    return run(data)


def decode_frames():
    """A table function over a binary: ordinal, start, end, payload of each whole frame; `strict` refuses a bad tail."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="ordinal long, start long, end long, payload binary")
    class Decode:
        def eval(self, content: bytes, strict: bool):
            at, k = 0, 0
            while at < len(content or b""):
                size = int.from_bytes(content[at : at + 4], "big") if at + 4 <= len(content) else 0
                if size < 4 or at + size > len(content):
                    if strict:
                        raise ValueError(f"bad frame at byte {at}")
                    return
                yield k, at, at + size, content[at + 4 : at + size]
                at, k = at + size, k + 1

    return Decode
