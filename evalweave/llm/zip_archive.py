"""ZIP archives with stored members: a writer for streams that can't seek, and a reader that opens no member as a whole.

Both know ZIP64: sizes and places of 4 GiB and more, 65,535 members and more.
"""

from __future__ import annotations

import struct
import zlib

_LOCAL, _CENTRAL, _END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
_END64, _LOCATOR = b"PK\x06\x06", b"PK\x06\x07"
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF
_DATE = 0x21  # 1980-01-01: the same bytes whenever it is written


class ArchiveError(ValueError):
    """The bytes are no archive, or not of the kind that is read here."""


class StoredZipWriter:
    """force64: ZIP64 fields everywhere, as beyond the limits."""

    def __init__(self, out, force64: bool = False):
        self.out, self.at, self.entries, self.force64 = out, 0, [], force64

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, size = name.encode(), zlib.crc32(data), len(data)
        big = self.force64 or size >= _MAX32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        shown = _MAX32 if big else size
        self.entries.append((raw, crc, size, self.at))
        self._write(_LOCAL + struct.pack("<HHHHHIIIHH", 45 if big else 20, 0x800, 0, 0, _DATE, crc, shown, shown, len(raw), len(extra)) + raw + extra)
        self._write(data)

    def close(self) -> None:
        first = self.at
        for raw, crc, size, at in self.entries:
            big_size, big_at = self.force64 or size >= _MAX32, self.force64 or at >= _MAX32
            extra = (struct.pack("<QQ", size, size) if big_size else b"") + (struct.pack("<Q", at) if big_at else b"")
            extra = struct.pack("<HH", 1, len(extra)) + extra if extra else b""
            shown = _MAX32 if big_size else size
            version = 45 if extra else 20
            self._write(_CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", version, version, 0x800, 0, 0, _DATE, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, _MAX32 if big_at else at) + raw + extra)
        size, n = self.at - first, len(self.entries)
        if self.force64 or n >= _MAX16 or size >= _MAX32 or first >= _MAX32:
            at = self.at
            self._write(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, first))
            self._write(_LOCATOR + struct.pack("<IQI", 0, at, 1))
            n, size, first = _MAX16, _MAX32, _MAX32
        self._write(_END + struct.pack("<HHHHIIH", 0, 0, n, n, size, first, 0))


class StoredZipReader:
    """read_at(offset, length) -> bytes, and the archive's size."""

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        # name -> (place of its local header, size, crc32)
        self.members: dict[str, tuple[int, int, int]] = {}
        tail_at = max(0, size - 22 - _MAX16)
        tail = read_at(tail_at, size - tail_at)
        k = tail.rfind(_END)
        if k < 0 or len(tail) - k < 22:
            raise ArchiveError("no end of central directory")
        n, _, length, first = struct.unpack_from("<HHII", tail, k + 8)
        if n == _MAX16 or length == _MAX32 or first == _MAX32:
            end_at = tail_at + k
            if end_at < 20 or (locator := read_at(end_at - 20, 20))[:4] != _LOCATOR:
                raise ArchiveError("no ZIP64 locator")
            record = read_at(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != _END64:
                raise ArchiveError("no ZIP64 end of central directory")
            n, _, length, first = struct.unpack_from("<QQQQ", record, 24)
        directory, at = read_at(first, length), 0
        for _ in range(n):
            if directory[at : at + 4] != _CENTRAL:
                raise ArchiveError("the central directory is damaged")
            method, crc, packed, whole, n_name, n_extra, n_note, where = (*struct.unpack_from("<H", directory, at + 10), *struct.unpack_from("<III", directory, at + 16), *struct.unpack_from("<HHH", directory, at + 28), *struct.unpack_from("<I", directory, at + 42))
            name = directory[at + 46 : at + 46 + n_name].decode()
            extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
            at += 46 + n_name + n_extra + n_note
            if method:
                raise ArchiveError(f"{name} is compressed; only stored members can be read by range")
            k = 0
            while k + 4 <= len(extra):
                tag, own = struct.unpack_from("<HH", extra, k)
                if tag == 1:
                    values = iter(struct.unpack_from(f"<{own // 8}Q", extra, k + 4))
                    whole = next(values) if whole == _MAX32 else whole
                    packed = next(values) if packed == _MAX32 else packed
                    where = next(values) if where == _MAX32 else where
                k += 4 + own
            self.members[name] = (where, whole, crc)

    def data_at(self, name: str) -> int:
        """Where a member's bytes begin: behind its local header, whose fields may be longer than the directory's."""
        where = self.members[name][0]
        head = self.read_at(where, 30)
        if head[:4] != _LOCAL:
            raise ArchiveError(f"{name} has no local header")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return where + 30 + n_name + n_extra

    def read(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        size = self.members[name][1]
        length = size - start if length is None else length
        if start < 0 or start + length > size:
            raise ArchiveError(f"{name} has no such range")
        data = self.read_at(self.data_at(name) + start, length)
        if length == size and zlib.crc32(data) != self.members[name][2]:
            raise ArchiveError(f"{name} isn't what was stored: its checksum is wrong")
        return data
