"""Length-delimited records with masked checksums: framing, CRC-32C of many records at once, and the serialized sequences.

A record is its length (8 bytes), the masked CRC-32C of these, the data, and their masked CRC-32C, all little-endian: the
TFRecord framing. Data are ``tf.train.Example`` messages with the integer lists ``doc_id`` and ``input_ids``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Castagnoli's polynomial, reflected, and the mask that the format adds to checksums.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
#: Bytes that the first levels of a checksum take together.
_BLOCK = 64
FRAME = 16


class Damaged(ValueError):
    """A record whose length, checksum or message is not right."""


def _shifted(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Registers ``c`` after the zero bytes that ``table`` (4 x 256) stands for."""
    return table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]


@lru_cache(1)
def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """The register after two bytes from zero, by their value; shifts by 1, 2, 4, ... zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> 1) ^ np.where(one & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    corner = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    shifts = [(corner >> 8) ^ one[corner & 255]]
    for _ in range(40):
        shifts.append(_shifted(shifts[-1], shifts[-1]))
    pair = np.arange(65536, dtype=np.uint32)
    return _shifted(shifts[0], one[pair & 255]) ^ one[pair >> 8], shifts


def crc32c(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32C of the runs ``[starts, ends)`` of bytes.

    The checksum is linear: runs are filled up with zeros in front, which change nothing while the register is zero, neighbours
    are joined level by level, and what the register starts with is added at the end.
    """
    pair, shifts = _tables()
    lengths = (ends - starts).astype(np.int64)
    blocks = -(-lengths // _BLOCK)
    ends_at = np.cumsum(blocks) * _BLOCK
    padded = np.zeros(int(blocks.sum()) * _BLOCK, np.uint8)
    if padded.size:
        at = np.repeat(starts - (ends_at - lengths), lengths) + (slots := np.repeat(ends_at - np.cumsum(lengths), lengths) + np.arange(int(lengths.sum())))
        padded[slots] = data[at]
    c = pair[padded.view("<u2")]
    level = 1
    while 1 << level < _BLOCK:
        c = _shifted(shifts[level], c[0::2]) ^ c[1::2]
        level += 1
    count = blocks
    while count.size and count.max() > 1:
        even = -(-count // 2) * 2
        wide = np.zeros(int(even.sum()), np.uint32)
        wide[np.repeat(np.cumsum(even) - np.cumsum(count), count) + np.arange(len(c))] = c
        c = _shifted(shifts[level], wide[0::2]) ^ wide[1::2]
        count, level = even // 2, level + 1
    out = np.zeros(len(lengths), np.uint32)
    out[count > 0] = c
    first = np.full(len(lengths), 0xFFFFFFFF, np.uint32)
    for bit, shift in enumerate(shifts):
        if (has := (lengths >> bit & 1).astype(bool)).any():
            first[has] = _shifted(shift, first[has])
    return out ^ first ^ np.uint32(0xFFFFFFFF)


def masked(c: np.ndarray) -> np.ndarray:
    """Checksums rotated by 15 bits, plus a constant: data that hold checksums keep checksums of their own."""
    with np.errstate(over="ignore"):
        return ((c >> np.uint32(15)) | (c << np.uint32(17))) + np.uint32(MASK)


def frame(messages: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The framed records of ``messages`` as bytes, and where each begins (with the end as last)."""
    sizes = np.array([len(m) for m in messages], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + FRAME)])
    out = np.empty(int(begins[-1]), np.uint8)
    body = np.frombuffer(b"".join(messages), np.uint8)
    inner = np.concatenate([[0], np.cumsum(sizes)])
    out[np.repeat(begins[:-1] + 12 - inner[:-1], sizes) + np.arange(len(body))] = body
    heads = sizes.astype("<u8").view(np.uint8)
    eight = np.arange(len(sizes), dtype=np.int64) * 8
    out[begins[:-1, None] + np.arange(8)] = heads.reshape(-1, 8)
    out[begins[:-1, None] + np.arange(8, 12)] = masked(crc32c(heads, eight, eight + 8)).astype("<u4").view(np.uint8).reshape(-1, 4)
    out[begins[1:, None] + np.arange(-4, 0)] = masked(crc32c(body, inner[:-1], inner[1:])).astype("<u4").view(np.uint8).reshape(-1, 4)
    return out, begins


def unframe(data: np.ndarray, begins: np.ndarray) -> list[bytes]:
    """The messages of framed records that begin (and, the last, end) at ``begins``; checks lengths and both checksums."""
    if begins.size < 2:
        return []
    sizes = np.diff(begins) - FRAME
    if sizes.min() < 0 or begins[-1] > len(data):
        raise Damaged("the index does not fit the records")
    heads = np.ascontiguousarray(data[begins[:-1, None] + np.arange(8)])
    eight = np.arange(len(sizes), dtype=np.int64) * 8
    stated = np.ascontiguousarray(data[begins[:-1, None] + np.arange(8, 12)]).view("<u4").ravel()
    if (heads.view("<u8").ravel() != sizes.astype(np.uint64)).any() or (stated != masked(crc32c(heads.ravel(), eight, eight + 8))).any():
        raise Damaged("a record's length is damaged")
    stated = np.ascontiguousarray(data[begins[1:, None] + np.arange(-4, 0)]).view("<u4").ravel()
    if (stated != masked(crc32c(data, begins[:-1] + 12, begins[1:] - 4))).any():
        raise Damaged("a record's data are damaged")
    return [data[a:b].tobytes() for a, b in zip(begins[:-1] + 12, begins[1:] - 4)]


def _varint(n: int) -> bytes:
    n &= 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def varints(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers as packed varints, and where the numbers up to each of ``ends`` end."""
    size = np.ones(len(ids), np.int64)
    for bits in (7, 14, 21, 28):
        size += ids >= 1 << bits
    after = np.cumsum(size)
    out = np.empty(int(after[-1]) if len(ids) else 0, np.uint8)
    at = after - size
    for j in range(5):
        here = size > j
        if not here.any():
            break
        out[at[here] + j] = (ids[here] >> np.uint32(7 * j) & np.uint32(127)) | np.where(size[here] > j + 1, 128, 0).astype(np.uint32)
    return out, np.concatenate([[0], after])[ends]


def numbers(data: np.ndarray) -> np.ndarray:
    """The unsigned numbers (below 2**35) of packed varints."""
    last = np.flatnonzero(data < 128)
    if len(data) and (not len(last) or last[-1] != len(data) - 1):
        raise Damaged("a number has no end")
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    size = last - first + 1
    out = np.zeros(len(last), np.int64)
    for j in range(int(size.max(initial=0))):
        here = size > j
        out[here] |= (data[first[here] + j].astype(np.int64) & 127) << (7 * j)
    return out


def example(doc_id: int | None, packed: bytes) -> bytes:
    """An Example with ``doc_id`` (an empty list for null) and ``input_ids``."""

    def entry(name: bytes, values: bytes) -> bytes:
        return _field(1, _field(1, name) + _field(2, _field(3, _field(1, values) if values else b"")))

    return _field(1, entry(b"doc_id", b"" if doc_id is None else _varint(doc_id)) + entry(b"input_ids", packed))


def _fields(data: bytes):
    """Number and bytes of each length-delimited field."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            if at >= len(data):
                raise Damaged("a message ends within a number")
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = number()
        if tag & 7 != 2:
            raise Damaged("a message has an unknown field")
        size = number()
        if at + size > len(data):
            raise Damaged("a field is longer than its message")
        yield tag >> 3, data[at : at + size]
        at += size


def int_lists(message: bytes) -> dict[str, bytes]:
    """The packed integers of each feature of an Example."""
    out = {}
    for _, features in _fields(message):
        for _, entry in _fields(features):
            parts = dict(_fields(entry))
            out[parts[1].decode()] = b"".join(v for _, kind in _fields(parts.get(2, b"")) for _, v in _fields(kind))
    return out


def signed(packed: bytes) -> int | None:
    """The first of packed 64-bit integers, None of none."""
    value = shift = 0
    for b in packed:
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value - (1 << 64) if value >> 63 else value
    return None
