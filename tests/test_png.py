from __future__ import annotations

import struct
import zlib

import pytest

from scriptorium.sources import png


def chunks(data: bytes):
    at = len(png.SIGNATURE)
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        assert struct.unpack_from(">I", data, at + 8 + size)[0] == zlib.crc32(kind + body)
        yield kind, body
        at += 12 + size


def test_strips_come_back():
    rows = [bytes((x * y + c) % 256 for x in range(5) for c in range(3)) for y in range(7)]
    data = b"".join(png.png_parts(5, 7, [b"".join(rows[:3]), b"", b"".join(rows[3:])]))
    found = list(chunks(data))
    assert [found[0][0], found[-1]] == [b"IHDR", (b"IEND", b"")] and {k for k, _ in found[1:-1]} == {b"IDAT"}
    assert struct.unpack(">II", found[0][1][:8]) == (5, 7)
    raw = zlib.decompress(b"".join(b for k, b in found if k == b"IDAT"))
    assert raw == b"".join(b"\0" + r for r in rows)


@pytest.mark.parametrize(("size", "strips", "message"), [((2, 1), [b"12345"], "whole rows"), ((2, 1), [b"x" * 12], "more rows"), ((2, 1), [], "1 of 1"), ((0, 1), [], "at least one")])
def test_wrong_strips(size, strips, message):
    with pytest.raises(ValueError, match=message):
        list(png.png_parts(*size, strips))
