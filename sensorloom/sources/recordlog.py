"""The devices' record format: a 12-byte header (marker, type, length, sequence, CRC-32) and a payload.

The CRC covers the header between marker and itself, and the payload. Little-endian throughout.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from ..errors import CorruptError, SchemaError
from ..types import ColumnDef, shortest

# Fixed values of the format.
MARKER, PUT, DEL, ROW = 0xA5, 1, 2, 3
HEADER = struct.Struct("<BBHII")
MAX_KEY = 200
#: Series are defined by PUTs of keys that begin so; their value is the series' number and schema text.
SERIES_KEY = b"\x01S"
_PACK = {"time": "<q", "int": "<i", "long": "<q", "float": "<f", "real": "<d"}


@dataclass(frozen=True)
class Record:
    seq: int
    kind: int
    key: bytes = b""
    value: bytes = b""
    series: int = 0

    @property
    def reserved(self) -> bool:
        return self.key[:1] == b"\x01"


def encode(record: Record) -> bytes:
    payload = {
        PUT: lambda: bytes([len(record.key)]) + record.key + record.value,
        DEL: lambda: bytes([len(record.key)]) + record.key,
        ROW: lambda: struct.pack("<H", record.series) + record.value,
    }[record.kind]()
    middle = struct.pack("<BHI", record.kind, len(payload), record.seq)
    return bytes([MARKER]) + middle + struct.pack("<I", zlib.crc32(middle + payload)) + payload


def decode(batch: bytes) -> Iterator[Record]:
    """The records of a batch; CorruptError at the first damaged one, after those before it."""
    at = 0
    while at < len(batch):
        if len(batch) - at < HEADER.size or batch[at] != MARKER:
            raise CorruptError("a record is cut short or its checksum is wrong")
        _, kind, n, seq, crc = HEADER.unpack_from(batch, at)
        payload = batch[at + HEADER.size : at + HEADER.size + n]
        if len(payload) < n or zlib.crc32(batch[at + 1 : at + 8] + payload) != crc or not _sound(kind, payload):
            raise CorruptError("a record is cut short or its checksum is wrong")
        if kind == ROW:
            yield Record(seq, kind, value=payload[2:], series=struct.unpack_from("<H", payload)[0])
        else:
            yield Record(seq, kind, key=payload[1 : 1 + payload[0]], value=payload[1 + payload[0] :])
        at += HEADER.size + n


def _sound(kind: int, payload: bytes) -> bool:
    if kind == ROW:
        return len(payload) >= 10
    if kind not in (PUT, DEL) or not payload or not 1 <= payload[0] <= MAX_KEY or payload[0] + 1 > len(payload):
        return False
    return kind == PUT or len(payload) == payload[0] + 1


def pack_row(columns: list[ColumnDef], values) -> bytes:
    out = b""
    for c, v in zip(columns, values, strict=True):
        out += bytes([len(raw := v.encode())]) + raw if c.type == "text" else struct.pack(_PACK[c.type], v)
    return out


def unpack_row(columns: list[ColumnDef], data: bytes) -> tuple:
    out, at = [], 0
    try:
        for c in columns:
            if c.type == "text":
                n = data[at]
                out.append(data[at + 1 : at + 1 + n].decode())
                at += 1 + n
            else:
                v = struct.unpack_from(_PACK[c.type], data, at)[0]
                out.append(shortest(v) if c.type == "float" else v)
                at += struct.calcsize(_PACK[c.type])
    except (IndexError, struct.error, UnicodeDecodeError) as e:
        raise SchemaError("a row's bytes are not those of its series' columns") from e
    if at != len(data):
        raise SchemaError("a row's bytes are not those of its series' columns")
    return tuple(out)


def series_record(seq: int, number: int, name: str, schema: str) -> Record:
    return Record(seq, PUT, SERIES_KEY + name.encode(), struct.pack("<H", number) + schema.encode())
