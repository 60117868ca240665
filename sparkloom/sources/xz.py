"""The xz container: streams and blocks found by their indexes, blocks unpacked one by one, and a writer of several blocks.

A file is a series of streams, each with a header, blocks, an index of the
blocks' sizes and a footer that says how long the index is. So a task finds all
blocks from a file's end by a few short reads, and unpacks only its own.
"""

from __future__ import annotations

import lzma
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

from sparkloom.sources.files import read_exactly

# Fixed by the public format.
HEADER, FOOTER = b"\xfd7zXZ\x00", b"YZ"
CHUNK = 1 << 20


class Block(NamedTuple):
    """Place in the file, bytes there without padding, bytes unpacked, and the flags of its stream."""

    offset: int
    packed: int
    size: int
    flags: bytes

    @property
    def stored(self) -> int:
        return -(-self.packed // 4) * 4


def number(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, lowest first, and the place after it."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 56:
            raise ValueError("broken index")
        value |= (data[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 0x80:
            return value, at


def numbered(value: int) -> bytes:
    out = b""
    while value > 0x7F:
        out += bytes([value & 0x7F | 0x80])
        value >>= 7
    return out + bytes([value])


def header(flags: bytes) -> bytes:
    return HEADER + flags + struct.pack("<I", zlib.crc32(flags))


def ending(flags: bytes, records: list[tuple[int, int]]) -> bytes:
    """Index and footer of a stream with blocks of (packed, size)."""
    index = b"\0" + numbered(len(records)) + b"".join(numbered(a) + numbered(b) for a, b in records)
    index += b"\0" * (-len(index) % 4)
    index += struct.pack("<I", zlib.crc32(index))
    tail = struct.pack("<I", len(index) // 4 - 1) + flags
    return index + struct.pack("<I", zlib.crc32(tail)) + tail + FOOTER


def blocks_of(f, length: int) -> list[Block]:
    """All blocks of a file of ``length`` bytes, in order. A file that is empty, cut off or not xz raises ``ValueError``."""
    streams, end = [], length
    while end > 0:
        tail = read_exactly(f, max(0, end - 12), min(12, end))
        if tail[-4:] == b"\0\0\0\0" and end > 12:  # padding after a stream
            end -= 4
            continue
        if len(tail) < 12 or tail[-2:] != FOOTER or struct.unpack("<I", tail[:4])[0] != zlib.crc32(tail[4:10]):
            raise ValueError(f"no footer of an xz stream before byte {end}: the file is cut off or no xz file")
        flags, size = tail[8:10], 4 * (struct.unpack("<I", tail[4:8])[0] + 1)
        index = read_exactly(f, max(0, end - 12 - size), size)
        if len(index) < size or index[0] or struct.unpack("<I", index[-4:])[0] != zlib.crc32(index[:-4]):
            raise ValueError(f"broken index before byte {end}")
        n, at = number(index, 1)
        records = []
        for _ in range(n):
            packed, at = number(index, at)
            plain, at = number(index, at)
            records.append((packed, plain))
        start = end - 12 - size - sum(-(-packed // 4) * 4 for packed, _ in records)
        if start < 12 or read_exactly(f, start - 12, 12) != header(flags):
            raise ValueError(f"no header of an xz stream at byte {start - 12}")
        own = []
        for packed, plain in records:
            own.append(Block(start, packed, plain, flags))
            start += own[-1].stored
        streams.append(own)
        end = end - 12 - size - sum(b.stored for b in own) - 12
    if not streams:
        raise ValueError("an empty file holds no xz stream")
    return [b for own in reversed(streams) for b in own]


def unpacked(f, block: Block, chunk: int = CHUNK) -> Iterator[bytes]:
    """The bytes of one block, at most ``chunk`` at a time, as a stream of its own; its sizes and check sum must hold."""
    machine, total, at = lzma.LZMADecompressor(lzma.FORMAT_XZ), 0, 0
    stored = block.stored

    def sources():
        nonlocal at
        yield header(block.flags)
        while at < stored:
            data = read_exactly(f, block.offset + at, min(chunk, stored - at))
            if not data:
                raise ValueError(f"the file ends inside the block at byte {block.offset}")
            at += len(data)
            yield data
        yield ending(block.flags, [(block.packed, block.size)])

    for data in sources():
        while True:
            out = machine.decompress(data, chunk)
            if out:
                total += len(out)
                yield out
            data = b""
            if machine.needs_input or machine.eof:
                break
    if not machine.eof or machine.unused_data or total != block.size:
        raise ValueError(f"the block at byte {block.offset} isn't as the index says")


def lines_between(f, length: int, low: int, high: int, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """Lists of the lines that belong to the blocks that begin at low <= byte < high.

    A line belongs to the blocks in which it begins; one that begins at the
    very edge belongs to those before. So each line of a file belongs to one
    range, however the ranges are cut.
    """
    blocks = blocks_of(f, length)
    own = [k for k, b in enumerate(blocks) if low <= b.offset < high]
    if not own:
        return
    skip, tail = own[0] > 0, []
    for block in blocks[own[0] :]:
        after = block.offset >= high
        for data in unpacked(f, block, chunk):
            if skip:  # the line that the blocks before began
                at = data.find(b"\n") + 1
                if not at:
                    if after:
                        return
                    continue
                skip, data = False, data[at:]
                if after:  # no line begins in the own blocks
                    return
            if after:
                at = data.find(b"\n")
                if at >= 0:
                    yield [b"".join(tail) + data[:at]]
                    return
            *whole, last = data.split(b"\n")
            if whole:
                whole[0] = b"".join(tail) + whole[0]
                tail = []
                yield whole
            tail.append(last)
    if not skip and any(tail):
        yield [b"".join(tail)]


class Writer:
    """Writes bytes to ``out`` as one stream of blocks of ``block`` bytes each."""

    def __init__(self, out, block: int = 8 << 20, preset: int = 6):
        self.out, self.block, self.preset = out, block, preset
        self.flags, self.held, self.size, self.records = b"\0\x04", [], 0, []  # check sums of 64 bits
        out.write(header(self.flags))

    def write(self, data: bytes) -> None:
        self.held.append(data)
        self.size += len(data)
        if self.size >= self.block:
            whole = b"".join(self.held)
            cut = len(whole) // self.block * self.block
            for at in range(0, cut, self.block):
                self.put(whole[at : at + self.block])
            self.held, self.size = [whole[cut:]], len(whole) - cut

    def put(self, data: bytes) -> None:
        alone = lzma.compress(data, lzma.FORMAT_XZ, lzma.CHECK_CRC64, self.preset)
        index = 4 * (struct.unpack("<I", alone[-8:-4])[0] + 1)
        packed, _ = number(alone[-12 - index :], 2)  # after the mark and the count of one record
        self.out.write(alone[12 : -12 - index])
        self.records.append((packed, len(data)))

    def close(self) -> None:
        if self.size:
            self.put(b"".join(self.held))
        self.out.write(ending(self.flags, self.records))
