"""The part of the HDF5 format that annotated matrices are stored in, read and written with numpy.

Read: superblocks 0 to 3; groups with symbol tables or compact links; contiguous, compact and
chunked data sets with a version 1 chunk index or a single chunk; numbers, flags, fixed and
variable strings; gzip, shuffle and checksums. Anything else is an error that names it.
Written: superblock 0, symbol tables, chunked data with gzip and shuffle. Names and numbers
below are fixed values of the published format, version 3.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property
from pathlib import Path

import numpy as np

SIGNATURE = b"\x89HDF\r\n\x1a\n"
NOWHERE = (1 << 64) - 1
SPACE, LINKS, TYPE, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, MORE, TABLE = 0x01, 0x02, 0x03, 0x05, 0x06, 0x08, 0x0B, 0x0C, 0x10, 0x11
GZIP, SHUFFLE, CHECKSUM = 1, 2, 3


class FormatError(ValueError):
    """A file that is damaged or uses a part of the format that is not read here."""


def _name(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")


def _up(n: int, to: int = 8) -> int:
    return -(-n // to) * to


class _Type:
    """An element type: ``dtype`` as stored, and how elements become values."""

    def __init__(self, raw: bytes):
        self.kind, bits, size = raw[0] & 15, int.from_bytes(raw[1:4], "little"), int.from_bytes(raw[4:8], "little")
        self.flag = False
        if self.kind in (0, 1):
            self.dtype = np.dtype(f"{'>' if bits & 1 else '<'}{'f' if self.kind else 'i' if bits & 8 else 'u'}{size}")
        elif self.kind == 3:
            self.dtype = np.dtype(f"S{size}")
        elif self.kind == 8:
            self.dtype, names = _Type(raw[8:]).dtype, raw[8:].upper()
            self.flag = b"FALSE" in names and b"TRUE" in names and bits & 0xFFFF == 2
        elif self.kind == 9 and bits & 15 == 1:
            self.dtype = np.dtype([("n", "<u4"), ("at", "<u8"), ("k", "<u4")])
        else:
            raise FormatError(f"elements of class {self.kind} are not read")

    @property
    def text(self) -> bool:
        return self.kind in (3, 9)


class Node:
    """A group or data set."""

    def __init__(self, file: File, at: int):
        self.file, self.at = file, at
        self.messages = list(file._messages(at))

    def _all(self, kind: int) -> list[bytes]:
        return [raw for k, raw in self.messages if k == kind]

    @property
    def is_group(self) -> bool:
        return not self._all(LAYOUT)

    @cached_property
    def attrs(self) -> dict:
        return dict(self.file._attribute(raw) for raw in self._all(ATTRIBUTE))

    @cached_property
    def _children(self) -> dict[str, int]:
        found = {}
        for raw in self._all(TABLE):
            tree, heap = struct.unpack_from("<QQ", raw)
            found |= self.file._symbols(tree, heap)
        for raw in self._all(LINK):
            flags, at = raw[1], 2
            soft = flags & 8 and raw[at]
            at += (flags >> 3 & 1) + 8 * (flags >> 2 & 1) + (flags >> 4 & 1)
            width = 1 << (flags & 3)
            size = int.from_bytes(raw[at : at + width], "little")
            at += width
            if not soft:
                found[raw[at : at + size].decode()] = int.from_bytes(raw[at + size : at + size + 8], "little")
        for raw in self._all(LINKS):
            if struct.unpack_from("<Q", raw, 2 + 8 * (raw[1] & 1))[0] != NOWHERE:
                raise FormatError("groups with densely stored links are not read")
        return found

    def keys(self) -> list[str]:
        return list(self._children)

    def __contains__(self, name: str) -> bool:
        return name in self._children

    def __getitem__(self, path: str) -> Node:
        node = self
        for part in path.strip("/").split("/"):
            if part not in node._children:
                raise KeyError(f"no {path!r} in the file")
            node = Node(self.file, node._children[part])
        return node

    @cached_property
    def shape(self) -> tuple[int, ...]:
        return self.file._shape(self._all(SPACE)[0])

    @cached_property
    def type(self) -> _Type:
        return _Type(self._all(TYPE)[0])

    @cached_property
    def _filters(self) -> list[int]:
        found = []
        for raw in self._all(FILTERS):
            at = 8 if raw[0] == 1 else 2
            for _ in range(raw[1]):
                kind = int.from_bytes(raw[at : at + 2], "little")
                named = raw[0] == 1 or kind >= 256
                size = int.from_bytes(raw[at + 2 : at + 4], "little") if named else 0
                at += 4 if named else 2
                values = int.from_bytes(raw[at + 2 : at + 4], "little")
                at += 4 + (_up(size) if raw[0] == 1 else size) + 4 * values + (4 * (values % 2) if raw[0] == 1 else 0)
                found.append(kind)
        if unknown := set(found) - {GZIP, SHUFFLE, CHECKSUM}:
            raise FormatError(f"data filtered by {sorted(unknown)} is not read")
        return found

    def _undone(self, raw: bytes, skipped: int = 0) -> bytes:
        """A chunk without its filters, the last first; ``skipped`` marks those it never had."""
        for k, kind in reversed(list(enumerate(self._filters))):
            if skipped >> k & 1:
                continue
            if kind == GZIP:
                raw = zlib.decompress(raw)
            elif kind == CHECKSUM:
                raw = raw[:-4]
            else:
                size = self.type.dtype.itemsize
                whole = len(raw) // size * size
                raw = np.frombuffer(raw, np.uint8, whole).reshape(size, -1).T.tobytes() + raw[whole:]
        return raw

    def read(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Elements ``start`` to ``stop`` along the first axis, or the one value of a scalar; only chunks that hold some are read."""
        if not self.shape:
            return self.file._values(self._stored(0, 1, (1,)), self.type)[0]
        stop = self.shape[0] if stop is None else min(stop, self.shape[0])
        return self.file._values(self._stored(start, max(start, stop), self.shape), self.type)

    def _stored(self, start: int, stop: int, shape: tuple[int, ...]) -> np.ndarray:
        raw, dtype = self._all(LAYOUT)[0], self.type.dtype
        row = int(np.prod(shape[1:], dtype=np.int64)) * dtype.itemsize
        out = np.zeros((stop - start, *shape[1:]), dtype)
        if raw[0] in (1, 2):
            rank, kind, at = raw[1], raw[2], 8
            place = int.from_bytes(raw[8:16], "little") if kind else NOWHERE
            chunk = struct.unpack_from(f"<{rank}I", raw, at + 8 * (kind > 0))
            compact = raw[at + 4 * rank + 4 :]
        elif raw[0] == 3:
            kind = raw[1]
            compact = raw[4:]
            place = int.from_bytes(raw[2 + (kind == 2) : 10 + (kind == 2)], "little")
            chunk = struct.unpack_from(f"<{raw[2]}I", raw, 11)[:-1] if kind == 2 else ()
        elif raw[0] == 4 and raw[1] == 2 and raw[5 + raw[3] * raw[4]] == 1:  # a single chunk
            at = 5 + raw[3] * raw[4]
            chunk = tuple(int.from_bytes(raw[5 + k * raw[4] : 5 + (k + 1) * raw[4]], "little") for k in range(raw[3] - 1))
            size, skipped = struct.unpack_from("<QI", raw, at + 1) if raw[2] & 2 else (int(np.prod(chunk)) * dtype.itemsize, 0)
            place = int.from_bytes(raw[at + 1 + 12 * bool(raw[2] & 2) :][:8], "little")
            if place != NOWHERE:
                whole = np.frombuffer(self._undone(self.file._bytes(place, size), skipped), dtype).reshape(chunk)
                out[:] = whole[tuple(slice(0, n) for n in shape)][start:stop]
            return out
        elif raw[0] == 4 and raw[1] in (0, 1):
            kind, compact, place = raw[1], raw[4:], int.from_bytes(raw[2:10], "little")
        else:
            raise FormatError("this index of chunks is not read")
        if kind == 0:
            return np.frombuffer(compact, dtype, int(np.prod(shape))).reshape(shape)[start:stop]
        if place == NOWHERE or not out.size:
            return out
        if kind == 1:
            return np.frombuffer(self.file._bytes(place + start * row, (stop - start) * row), dtype).reshape(out.shape)
        for first, size, skipped, at in self.file._chunks(place, len(shape), start, stop, chunk[0]):
            part = np.frombuffer(self.file._part(at, lambda: self._undone(self.file._bytes(at, size), skipped)), dtype).reshape(chunk)  # noqa: B023
            low, high = max(start, first[0]), min(stop, first[0] + chunk[0], shape[0])
            inner = [slice(0, min(c, n - f)) for c, n, f in zip(chunk[1:], shape[1:], first[1:], strict=True)]
            target = [slice(f, f + s.stop) for f, s in zip(first[1:], inner, strict=True)]
            out[(slice(low - start, high - start), *target)] = part[(slice(low - first[0], high - first[0]), *inner)]
        return out


class File(Node):
    """An open file, at a local path or a URI of a file system that Arrow knows. Reads are ranges, so a task takes only what it needs."""

    def __init__(self, path: str):
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        self._source = system.open_input_file(place)
        self._heaps: dict[int, dict[int, bytes]] = {}
        self._parts: dict[int, bytes] = {}
        self.base = next((b for b in (0, *(512 << k for k in range(16))) if self._source.read_at(8, b) == SIGNATURE), None)
        if self.base is None:
            raise FormatError(f"{path} is no HDF5 file")
        head = self._bytes(0, 112)
        version = head[8]
        offsets = head[9:11] if version >= 2 else head[13:15]
        if version > 3 or offsets != b"\x08\x08":
            raise FormatError("only superblocks 0 to 3 with places of 8 bytes are read")
        super().__init__(self, struct.unpack_from("<Q", head, {0: 64, 1: 68}.get(version, 36))[0])

    def __enter__(self) -> File:
        return self

    def __exit__(self, *_) -> None:
        self._source.close()

    def _part(self, at: int, undone: Callable[[], bytes]) -> bytes:
        """A chunk as it was before its filters; the last four of up to 16 MB are kept, for reads that go on where the one before ended."""
        found = self._parts.pop(at, None)
        found = undone() if found is None else found
        if len(found) <= 1 << 24:
            self._parts[at] = found
        if len(self._parts) > 4:
            self._parts.pop(next(iter(self._parts)))
        return found

    def _bytes(self, at: int, size: int) -> bytes:
        raw = self._source.read_at(size, self.base + at)
        if len(raw) < size and at != 0:
            raise FormatError("the file is cut off")
        return raw

    def _expect(self, at: int, sign: bytes, size: int) -> bytes:
        raw = self._bytes(at, size)
        if raw[:4] != sign:
            raise FormatError(f"no {sign.decode()} where one should be")
        return raw

    def _messages(self, at: int) -> Iterator[tuple[int, bytes]]:
        head = self._bytes(at, 16)
        old = head[:4] != b"OHDR"
        if old:
            blocks = [(at + 16, struct.unpack_from("<I", head, 8)[0])]
        else:
            flags = head[5]
            skip = 6 + 16 * (flags >> 5 & 1) + 4 * (flags >> 4 & 1)
            width = 1 << (flags & 3)
            blocks = [(at + skip + width, int.from_bytes(self._bytes(at + skip, width), "little"))]
        while blocks:
            begin, size = blocks.pop(0)
            block, k = self._bytes(begin, size), 0
            lead = 8 if old else 4 + 2 * (flags >> 2 & 1)
            while k + lead <= size:
                kind, length = struct.unpack_from("<HH", block, k) if old else struct.unpack_from("<BH", block, k)
                raw = block[k + lead : k + lead + length]
                k += lead + length
                if kind == MORE:
                    place, more = struct.unpack_from("<QQ", raw)
                    blocks.append((place, more) if old else (place + 4, more - 8))  # without signature and checksum
                elif kind:
                    yield kind, raw

    def _shape(self, raw: bytes) -> tuple[int, ...]:
        if raw[0] == 2 and raw[3] == 2:
            return (0,)
        return struct.unpack_from(f"<{raw[1]}Q", raw, 8 if raw[0] == 1 else 4)

    def _attribute(self, raw: bytes) -> tuple[str, object]:
        version = raw[0]
        sizes = struct.unpack_from("<HHH", raw, 2)
        at, parts = 8 + (version == 3), []
        for size in sizes:
            parts.append(raw[at : at + size])
            at += _up(size) if version == 1 else size
        try:
            kind, shape = _Type(parts[1]), self._shape(parts[2])
            values = self._values(np.frombuffer(raw[at:], kind.dtype, int(np.prod(shape, dtype=np.int64))).reshape(shape or (1,)), kind)
        except FormatError:
            return _name(parts[0]), None
        return _name(parts[0]), values if shape else values[0]

    def _symbols(self, tree: int, heap: int) -> dict[str, int]:
        size, _, place = struct.unpack_from("<QQQ", self._expect(heap, b"HEAP", 32), 8)
        names, found, nodes = self._bytes(place, size), {}, [tree]
        while nodes:
            at = nodes.pop()
            if self._bytes(at, 4) == b"SNOD":
                n = struct.unpack_from("<H", self._bytes(at + 6, 2))[0]
                for name, header, cache in struct.iter_unpack("<QQI20x", self._bytes(at + 8, 40 * n)):
                    if cache != 2:  # symbolic links have no place
                        found[_name(names[name:])] = header
            else:
                n = struct.unpack_from("<H", self._expect(at, b"TREE", 24), 6)[0]
                nodes += [x for _, x in struct.iter_unpack("<QQ", self._bytes(at + 24, 16 * n))]
        return dict(sorted(found.items()))

    def _chunks(self, tree: int, rank: int, start: int, stop: int, height: int) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """First places, bytes, skipped filters and place of the chunks with rows of ``start`` to ``stop``; other branches are not read."""
        head = self._expect(tree, b"TREE", 24)
        level, n = head[5], struct.unpack_from("<H", head, 6)[0]
        key = 8 + 8 * (rank + 1)
        raw = self._bytes(tree + 24, n * (key + 8) + key)
        firsts = [struct.unpack_from(f"<II{rank}Q", raw, k * (key + 8)) for k in range(n + 1)]
        for k in range(n):
            size, skipped, *first = firsts[k]
            at = struct.unpack_from("<Q", raw, k * (key + 8) + key)[0]
            if level:  # a branch holds the chunks from its key up to the next one
                if first[0] < stop and (k + 1 == n or firsts[k + 1][2] + height > start):
                    yield from self._chunks(at, rank, start, stop, height)
            elif first[0] < stop and first[0] + height > start:
                yield tuple(first), size, skipped, at

    def _heap(self, at: int) -> dict[int, bytes]:
        if at not in self._heaps:
            if len(self._heaps) > 64:
                self._heaps.clear()
            size = struct.unpack_from("<Q", self._expect(at, b"GCOL", 16), 8)[0]
            raw, k, found = self._bytes(at, size), 16, {}
            while k + 16 <= size:
                number, _, length = struct.unpack_from("<HH4xQ", raw, k)
                if not number:
                    break
                found[number] = raw[k + 16 : k + 16 + length]
                k += 16 + _up(length)
            self._heaps[at] = found
        return self._heaps[at]

    def _values(self, stored: np.ndarray, kind: _Type) -> np.ndarray:
        if kind.kind == 9:
            flat = stored.reshape(-1)
            texts = [self._heap(at).get(k, b"")[:n].decode("utf-8", "replace") if n else "" for n, at, k in zip(flat["n"].tolist(), flat["at"].tolist(), flat["k"].tolist(), strict=True)]
            return np.array(texts, object).reshape(stored.shape)
        if kind.kind == 3:
            return np.array([_name(x) for x in stored.reshape(-1).tolist()], object).reshape(stored.shape)
        return stored != 0 if kind.flag else stored


class Writer:
    """Builds a file in memory. A tree is a dict of arrays and further dicts; its entry ``@`` holds the attributes."""

    #: Symbols of a leaf, children of a group's node and of a chunk node: half of each stands in the superblock.
    LEAF, BRANCH, CHUNKS = 256, 32, 64

    def __init__(self, chunk_bytes: int = 1 << 20, level: int = 4):
        self.chunk_bytes, self.level, self.out = chunk_bytes, level, bytearray(96)

    def file(self, tree: dict) -> bytes:
        root = self._group(tree)
        head = SIGNATURE + struct.pack("<8B2HI4Q", 0, 0, 0, 0, 0, 8, 8, 0, self.LEAF // 2, self.BRANCH // 2, 0, 0, NOWHERE, len(self.out), NOWHERE)
        self.out[:96] = (head + struct.pack("<QQII16x", 0, root, 0, 0)).ljust(96, b"\0")
        return bytes(self.out)

    def _put(self, raw: bytes) -> int:
        self.out += b"\0" * (-len(self.out) % 8)
        at = len(self.out)
        self.out += raw
        return at

    def _header(self, messages: list[tuple[int, bytes]]) -> int:
        body = b"".join(struct.pack("<HHB3x", kind, _up(len(raw)), 0) + raw.ljust(_up(len(raw)), b"\0") for kind, raw in messages)
        return self._put(struct.pack("<BBHII4x", 1, 0, len(messages), 1, len(body)) + body)

    def _attributes(self, named: dict) -> list[tuple[int, bytes]]:
        found = []
        for name, value in named.items():
            array = np.asarray(value, object if isinstance(value, str) else None)
            kind, stored = self._type(array)
            label, space = name.encode() + b"\0", self._space(array.shape)
            parts = (x.ljust(_up(len(x)), b"\0") for x in (label, kind, space))
            found.append((ATTRIBUTE, struct.pack("<BxHHH", 1, len(label), len(kind), len(space)) + b"".join(parts) + stored.tobytes()))
        return found

    def _space(self, shape: tuple[int, ...]) -> bytes:
        return struct.pack(f"<BBB5x{len(shape)}Q", 1, len(shape), 0, *shape)

    def _type(self, array: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The type message of an array and its elements as stored."""
        kind = array.dtype.kind
        if kind in "iu":
            size = array.dtype.itemsize
            return struct.pack("<B3sIHH", 0x10, bytes([8 * (kind == "i"), 0, 0]), size, 0, 8 * size), array.astype(array.dtype.newbyteorder("<"))
        if kind == "f":
            size = array.dtype.itemsize
            sign, exponent, bias = {4: (31, 8, 127), 8: (63, 11, 1023)}[size]
            return struct.pack("<B3sIHHBBBBI", 0x11, bytes([0x20, sign, 0]), size, 0, 8 * size, sign - exponent, exponent, 0, sign - exponent, bias), array.astype(array.dtype.newbyteorder("<"))
        if kind == "b":
            base, stored = self._type(array.astype(np.int8))
            return struct.pack("<B3sI", 0x18, bytes([2, 0, 0]), 1) + base + b"FALSE\0\0\0TRUE\0\0\0\0" + b"\0\1", stored
        return struct.pack("<B3sI", 0x19, bytes([1, 1, 0]), 16) + struct.pack("<B3sIHH", 0x10, bytes(3), 1, 0, 8), self._texts(array)

    def _texts(self, array: np.ndarray) -> np.ndarray:
        """Texts in heaps of some thousand, and where each one lies."""
        raw = ["" if x is None else str(x) for x in array.reshape(-1).tolist()]
        out = np.zeros(len(raw), [("n", "<u4"), ("at", "<u8"), ("k", "<u4")])
        for i in range(0, len(raw), 4096):
            texts = [x.encode() for x in raw[i : i + 4096]]
            body = b"".join(struct.pack("<HH4xQ", k, 1, len(t)) + t.ljust(_up(len(t)), b"\0") for k, t in enumerate(texts, 1))
            body += struct.pack("<HH4xQ", 0, 0, max(16, 4096 - 16 - len(body)))  # the rest is free
            size = max(4096, 16 + len(body))
            at = self._put((b"GCOL\1\0\0\0" + struct.pack("<Q", size) + body).ljust(size, b"\0"))
            out["n"][i : i + 4096], out["at"][i : i + 4096], out["k"][i : i + 4096] = [len(t) for t in texts], at, np.arange(1, len(texts) + 1)
        return out.reshape(array.shape)

    def _dataset(self, array: np.ndarray, named: dict) -> int:
        kind, stored = self._type(array)
        messages = [(SPACE, self._space(array.shape)), (TYPE, kind), (FILL, struct.pack("<BBBB", 2, 2, 0, 0))]
        if stored.size and stored.nbytes > 64 and array.ndim:
            rows = max(1, min(len(stored), self.chunk_bytes * len(stored) // stored.nbytes))
            chunk = (rows, *stored.shape[1:])
            entries = []
            for i in range(0, len(stored), rows):
                part = np.zeros(chunk, stored.dtype)
                part[: len(stored[i : i + rows])] = stored[i : i + rows]
                size = stored.dtype.itemsize
                raw = zlib.compress(np.frombuffer(part.tobytes(), np.uint8).reshape(-1, size).T.tobytes(), self.level)
                entries.append((struct.pack(f"<II{array.ndim + 1}Q", len(raw), 0, i, *[0] * array.ndim), self._put(raw)))
            end = struct.pack(f"<II{array.ndim + 1}Q", 0, 0, _up(len(stored), rows), *[0] * array.ndim)
            tree = self._tree(1, entries, end, self.CHUNKS)
            messages.append((LAYOUT, struct.pack(f"<BBBQ{array.ndim + 1}I", 3, 2, array.ndim + 1, tree, *chunk, stored.dtype.itemsize)))
            messages.append((FILTERS, struct.pack("<BB6x", 1, 2) + struct.pack("<HHHHII", SHUFFLE, 0, 1, 1, stored.dtype.itemsize, 0) + struct.pack("<HHHHII", GZIP, 0, 1, 1, self.level, 0)))
        else:
            place = self._put(stored.tobytes()) if stored.size else NOWHERE
            messages.append((LAYOUT, struct.pack("<BBQQ", 3, 1, place, stored.nbytes)))
        return self._header(messages + self._attributes(named))

    def _tree(self, kind: int, entries: list[tuple[bytes, int]], end: bytes, width: int) -> int:
        """A tree over ``entries``, keys and places in order; ``end`` is the key behind the last."""
        level = 0
        while True:
            nodes = []
            for i in range(0, len(entries), width):
                part = entries[i : i + width]
                after = entries[i + width][0] if i + width < len(entries) else end
                raw = b"TREE" + struct.pack("<BBHQQ", kind, level, len(part), NOWHERE, NOWHERE) + b"".join(k + struct.pack("<Q", at) for k, at in part) + after
                nodes.append((part[0][0], self._put(raw.ljust(24 + width * (len(end) + 8) + len(end), b"\0"))))
            if len(nodes) == 1:
                return nodes[0][1]
            entries, level = nodes, level + 1

    def _group(self, tree: dict) -> int:
        children = sorted((name.encode(), self._group(x) if isinstance(x, dict) else self._dataset(np.asarray(x), {})) for name, x in tree.items() if name != "@" and not isinstance(x, tuple))
        children += [(name.encode(), self._dataset(np.asarray(x[0]), x[1])) for name, x in tree.items() if isinstance(x, tuple)]  # with attributes
        children.sort()
        names, places = bytearray(8), []
        for name, _ in children:
            places.append(len(names))
            names += name + b"\0" * (_up(len(name) + 1) - len(name))
        heap = self._put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), 1, self._put(bytes(names))))
        entries, before = [], 0
        for i in range(0, max(1, len(children)), self.LEAF):
            part = list(zip(places, children, strict=True))[i : i + self.LEAF]
            raw = b"SNOD" + struct.pack("<BxH", 1, len(part)) + b"".join(struct.pack("<QQII16x", at, header, 0, 0) for at, (_, header) in part)
            entries.append((struct.pack("<Q", before), self._put(raw.ljust(8 + 40 * self.LEAF, b"\0"))))
            before = part[-1][0] if part else 0
        table = struct.pack("<QQ", self._tree(0, entries, struct.pack("<Q", before), self.BRANCH), heap)
        return self._header([(TABLE, table), *self._attributes(tree.get("@", {}))])


def save(path: str | Path, tree: dict, **options) -> None:
    """Write a tree to a file under another name first, so that a repeated task leaves one whole file."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(str(path)) if "://" in str(path) else (fs.LocalFileSystem(), str(path).removeprefix("file:"))
    raw = Writer(**options).file(tree)
    with system.open_output_stream(f"{place}.{zlib.crc32(raw):08x}.part") as out:
        out.write(raw)
    system.move(f"{place}.{zlib.crc32(raw):08x}.part", place)
