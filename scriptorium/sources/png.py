"""A PNG file as a stream of bytes: eight-bit colour, no filter, never more than one strip in memory."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

# The format's signature and the fields after the size: depth, colour type, and three methods.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
RGB_FIELDS = bytes((8, 2, 0, 0, 0))


def _part(name: bytes, body: bytes) -> bytes:
    tagged = name + body
    return len(body).to_bytes(4, "big") + tagged + zlib.crc32(tagged).to_bytes(4, "big")


def png_parts(width: int, height: int, strips: Iterable[bytes], level: int = 6) -> Iterator[bytes]:
    """The parts of a picture of RGB rows, top to bottom; each strip has whole rows of ``3 * width`` bytes.

    Rendering the strips is up to the caller: the engine itself draws nothing. Too few or too many rows are an error.
    """
    if min(width, height) < 1:
        raise ValueError("a picture has at least one pixel")
    yield SIGNATURE + _part(b"IHDR", width.to_bytes(4, "big") + height.to_bytes(4, "big") + RGB_FIELDS)
    packer, row, left = zlib.compressobj(level), 3 * width, height
    for strip in strips:
        if len(strip) % row:
            raise ValueError("a strip holds whole rows")
        left -= len(strip) // row
        if left < 0:
            raise ValueError("more rows than the picture has")
        packed = packer.compress(b"".join(b"\0" + strip[at : at + row] for at in range(0, len(strip), row)))
        if packed:
            yield _part(b"IDAT", packed)
    if left:
        raise ValueError(f"{left} of {height} rows are missing")
    yield _part(b"IDAT", packer.flush())
    yield _part(b"IEND", b"")
