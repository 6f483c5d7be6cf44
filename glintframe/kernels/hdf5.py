"""Numeric arrays in HDF5 files, in plain Python: the old layout (superblock 0, version 1 headers, symbol tables).

Reads contiguous, compact and chunked data, chunks as they are or deflated, and nested groups. Writes contiguous
data. Follows the public file format specification. Files of this kind keep dimensions in reverse order, so arrays
are transposed both ways.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"\x89HDF\r\n\x1a\n"
NONE = 0xFFFFFFFFFFFFFFFF


class File:
    """A file's bytes as a tree of groups (dict) and arrays."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        for base in (0, 512, 1024, 2048):  # a user block may come first
            if data[base : base + 8] == MAGIC:
                break
        else:
            raise ValueError("no HDF5 signature")
        self.base = base
        if data[base + 8] != 0:
            raise ValueError(f"superblock version {data[base + 8]} is not supported")
        self.osize, self.lsize = data[base + 13], data[base + 14]
        entry = base + 24 + 4 * self.osize
        self.root = self.base + self._int(entry + self.osize, self.osize)

    def _int(self, at: int, size: int) -> int:
        return int.from_bytes(self.data[at : at + size], "little")

    def _ref(self, at: int) -> int | None:
        v = self._int(at, self.osize)
        return None if v == (1 << 8 * self.osize) - 1 else self.base + v

    def messages(self, header: int) -> list[tuple[int, int, int]]:
        """(type, place, size) of all messages of an object header, continuation blocks included."""
        count, first = struct.unpack_from("<HxxxxI", self.data, header + 2)
        todo, out = [(header + 16, first)], []
        while todo:
            at, size = todo.pop(0)
            end = at + size
            while at + 8 <= end and len(out) < count:
                kind, n = struct.unpack_from("<HH", self.data, at)
                out.append((kind, at + 8, n))
                if kind == 16:
                    todo.append((self._ref(at + 8), self._int(at + 8 + self.osize, self.lsize)))
                at += 8 + n
        return out

    def node(self, header: int) -> dict | np.ndarray:
        found = {kind: at for kind, at, _ in reversed(self.messages(header))}
        if 17 in found:
            heap = self._ref(found[17] + self.osize)
            names = self._ref(heap + 8 + 2 * self.lsize)
            return {n: self.node(h) for n, h in self._symbols(self._ref(found[17]), names)}
        if not {1, 3, 8} <= found.keys():
            return {}
        return self._array(found[1], found[3], found[8])

    def _symbols(self, tree: int, names: int):
        for child in self._children(tree, self.lsize):
            if self.data[child : child + 4] == b"SNOD":
                for k in range(self._int(child + 6, 2)):
                    at = child + 8 + k * (2 * self.osize + 24)
                    start = names + self._int(at, self.osize)
                    yield self.data[start : self.data.index(b"\0", start)].decode(), self._ref(at + self.osize)
            else:
                yield from self._symbols(child, names)

    def _children(self, tree: int, key: int):
        at = tree + 8 + 2 * self.osize
        for _ in range(self._int(tree + 6, 2)):
            yield self._ref(at + key)
            at += key + self.osize

    def _chunks(self, tree: int, key: int):
        at, leaf = tree + 8 + 2 * self.osize, self.data[tree + 5] == 0
        for _ in range(self._int(tree + 6, 2)):
            child = self._ref(at + key)
            if leaf:
                yield at, child
            else:
                yield from self._chunks(child, key)
            at += key + self.osize

    def _type(self, at: int) -> np.dtype:
        kind, size = self.data[at] & 15, self._int(at + 4, 4)
        order = ">" if self.data[at + 1] & 1 else "<"
        if kind == 0:
            return np.dtype(f"{order}{'i' if self.data[at + 1] & 8 else 'u'}{size}")
        if kind == 1:
            return np.dtype(f"{order}f{size}")
        if kind == 3:
            return np.dtype(f"S{size}")
        if kind == 8:
            return np.dtype("u1")
        if kind == 7:
            return np.dtype(f"V{size}")
        raise ValueError(f"datatype class {kind} is not supported")

    def _array(self, space: int, kind: int, layout: int) -> np.ndarray:
        rank, head = self.data[space + 1], 8 if self.data[space] == 1 else 4
        dims = tuple(self._int(space + head + self.lsize * i, self.lsize) for i in range(rank))
        t = self._type(kind)
        n = int(np.prod(dims, dtype=np.int64))
        if self.data[layout] != 3:
            raise ValueError(f"layout version {self.data[layout]} is not supported")
        how = self.data[layout + 1]
        if how == 0:
            out = np.frombuffer(self.data, t, n, layout + 4).reshape(dims)
        elif how == 1:
            at = self._ref(layout + 2)
            out = np.zeros(dims, t) if at is None else np.frombuffer(self.data, t, n, at).reshape(dims)
        elif how == 2:
            out, tree = np.zeros(dims, t), self._ref(layout + 3)
            size = [self._int(layout + 3 + self.osize + 4 * i, 4) for i in range(rank)]
            for key, at in self._chunks(tree, 16 + 8 * rank) if tree is not None else ():
                stored, skip = struct.unpack_from("<II", self.data, key)
                raw = self.data[at : at + stored]
                block = np.frombuffer(raw if skip & 1 else zlib.decompress(raw), t).reshape(size)
                start = [self._int(key + 8 + 8 * i, 8) for i in range(rank)]
                to = tuple(slice(s, min(s + c, d)) for s, c, d in zip(start, size, dims, strict=True))
                out[to] = block[tuple(slice(0, s.stop - s.start) for s in to)]
        else:
            raise ValueError(f"layout class {how} is not supported")
        return out.T


def read(data: bytes) -> dict:
    f = File(data)
    return f.node(f.root)


def text(a: np.ndarray) -> str:
    """A string kept as bytes or as 16-bit characters."""
    raw = a.T.tobytes()
    kept = raw.decode("utf-8", "ignore") if a.dtype.kind == "S" else a.T.astype("<u2").tobytes().decode("utf-16-le", "ignore")
    return kept.replace("\0", "").strip()


def stage_position(tree: dict, device: str = "MAC5000_Stage_Controller") -> tuple[float, float]:
    """x and y of the device's entry among the referenced structures, whose names differ from file to file."""
    for entry in tree.get("#refs#", {}).values():
        if isinstance(entry, dict) and "deviceType" in entry and text(entry["deviceType"]) == device:
            return float(entry["pos"]["x"].ravel()[0]), float(entry["pos"]["y"].ravel()[0])
    raise KeyError(f"no {device} in the file")


def write(tree: dict) -> bytes:
    """Bytes of a file with these groups and arrays, data contiguous; up to 64 members in a group."""
    out = bytearray(96)

    def put(b: bytes) -> int:
        out.extend(b"\0" * (-len(out) % 8))
        out.extend(b)
        return len(out) - len(b)

    def header(messages: list[tuple[int, bytes]]) -> int:
        body = b""
        for kind, m in messages:
            m += b"\0" * (-len(m) % 8)
            body += struct.pack("<HHBxxx", kind, len(m), 0) + m
        return put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    def array(a: np.ndarray) -> int:
        a = np.ascontiguousarray(np.asarray(a).T)
        at = put(a.tobytes())
        size = a.dtype.itemsize
        if a.dtype.kind in "iub":
            kind = struct.pack("<BBBBIHH", 0x10, 8 if a.dtype.kind == "i" else 0, 0, 0, size, 0, 8 * size)
        elif a.dtype.kind == "f":
            bits = (52, 11, 0, 52, 1023) if size == 8 else (23, 8, 0, 23, 127)
            kind = struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, 8 * size - 1, 0, size, 0, 8 * size, bits[0], bits[1], bits[2], bits[3], bits[4])
        else:
            raise ValueError(f"type {a.dtype} can't be written")
        space = struct.pack("<BBB5x", 1, a.ndim, 0) + b"".join(struct.pack("<Q", n) for n in a.shape)
        return header([(1, space), (3, kind), (8, struct.pack("<BBQQ", 3, 1, at, a.nbytes))])

    def group(members: dict) -> tuple[int, int, int]:
        if len(members) > 64:
            raise ValueError("a group can't have more than 64 members")
        places = {n: group(m)[0] if isinstance(m, dict) else array(m) for n, m in sorted(members.items())}
        names, offsets = bytearray(8), {}
        for n in places:
            offsets[n] = len(names)
            names += n.encode() + b"\0"
            names += b"\0" * (-len(names) % 8)
        data = put(bytes(names))
        heap = put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), NONE, data))
        entries = b"".join(struct.pack("<QQI4x16x", offsets[n], at, 0) for n, at in places.items())
        snod = put(b"SNOD" + struct.pack("<BxH", 1, len(places)) + entries.ljust(64 * 40, b"\0"))
        last = list(offsets.values())[-1] if offsets else 0
        tree_at = put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, NONE, NONE) + struct.pack("<QQQ", 0, snod, last).ljust(33 * 16, b"\0"))
        return header([(17, struct.pack("<QQ", tree_at, heap))]), tree_at, heap

    root, tree_at, heap = group(tree)
    out[:96] = (
        MAGIC + struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, 32, 16, 0) + struct.pack("<QQQQ", 0, NONE, len(out), NONE) + struct.pack("<QQI4xQQ", 0, root, 1, tree_at, heap)
    )
    return bytes(out)
