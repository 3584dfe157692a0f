"""The recovery archive: a checksummed header and the original bytes."""

from __future__ import annotations

import hashlib

# Fixed values of the format: magic, version, then encoder u8, tokenizer u16, flags u16 (all zero), length as ULEB128, SHA-256.
MAGIC = b"TKFD"
VERSION = 1
ENCODER_AT, TOKENIZER_AT, FLAGS_AT, LENGTH_AT = 5, 6, 8, 10
FLAG_BITS = 0b111


class Damaged(Exception):
    """Why an archive is refused: bad_magic, unsupported_version, reserved_bits_set, corrupt or checksum_mismatch."""

    def __init__(self, code: str, byte_offset: int | None = None):
        super().__init__(code if byte_offset is None else f"{code} at byte {byte_offset}")
        self.code, self.byte_offset = code, byte_offset


def uleb128(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_uleb128(data: bytes, at: int) -> tuple[int, int]:
    """The number and the place behind it; refuses overlong, unfinished and too large ones."""
    value = 0
    for i in range(10):
        if at + i >= len(data):
            raise Damaged("corrupt", at + i)
        byte = data[at + i]
        if i == 9 and byte & 127 > 1:
            raise Damaged("corrupt", at + i)
        value |= (byte & 127) << (7 * i)
        if byte < 128:
            if i and not byte:
                raise Damaged("corrupt", at + i)
            return value, at + i + 1
    raise Damaged("corrupt", at + 10)


def pack(original: bytes) -> bytes:
    return MAGIC + bytes([VERSION, 0, 0, 0, 0, 0]) + uleb128(len(original)) + hashlib.sha256(original).digest() + original


def unpack(archive: bytes) -> bytes:
    """The original bytes, or Damaged: nothing is returned that is not verified."""
    if archive[:4] != MAGIC:
        raise Damaged("bad_magic")
    if len(archive) < 5:
        raise Damaged("corrupt", 4)
    if archive[4] > VERSION:
        raise Damaged("unsupported_version")
    if archive[4] < VERSION:
        raise Damaged("corrupt", 4)
    for at, width in ((ENCODER_AT, 1), (TOKENIZER_AT, 2), (FLAGS_AT, 2)):
        if len(archive) < at + width:
            raise Damaged("corrupt", at)
    flags = int.from_bytes(archive[FLAGS_AT:LENGTH_AT], "little")
    if flags & ~FLAG_BITS:
        raise Damaged("reserved_bits_set")
    size, at = read_uleb128(archive, LENGTH_AT)
    if len(archive) < at + 32:
        raise Damaged("corrupt", at)
    # fields that this version always writes as zero
    for place, value in ((ENCODER_AT, archive[ENCODER_AT]), (TOKENIZER_AT, int.from_bytes(archive[TOKENIZER_AT:FLAGS_AT], "little")), (FLAGS_AT, flags)):
        if value:
            raise Damaged("corrupt", place)
    payload = archive[at + 32 :]
    if len(payload) != size:
        raise Damaged("corrupt", LENGTH_AT)
    if hashlib.sha256(payload).digest() != archive[at : at + 32]:
        raise Damaged("checksum_mismatch")
    return payload
