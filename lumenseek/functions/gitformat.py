"""Git's file formats, as far as single records go: object headers, deltas, trees, index entries. The formats' constants are fixed values."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

#: Type numbers in packs.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFFSET_DELTA, REF_DELTA = 6, 7
DIRECTORY, GITLINK = 0o40000, 0o160000


def hasher(width: int):
    """SHA-1 for ids of 20 bytes, SHA-256 for those of 32."""
    return hashlib.sha1 if width == 20 else hashlib.sha256


def object_id(kind: str, content: bytes, width: int = 20) -> str:
    return hasher(width)(b"%s %d\0" % (kind.encode(), len(content)) + content).hexdigest()


def loose(data: bytes) -> tuple[str, bytes]:
    """Kind and content of a loose object's file."""
    head, _, content = zlib.decompress(data).partition(b"\0")
    kind, _, size = head.partition(b" ")
    if len(content) != int(size):
        raise ValueError(f"object of {len(content)} bytes, its header tells {int(size)}")
    return kind.decode(), content


def entry_head(data: bytes) -> tuple[int, int, int]:
    """Type number, size and how many bytes the head takes, of an entry of a pack."""
    first = data[0]
    size, shift, at = first & 15, 4, 1
    while data[at - 1] & 128:
        size |= (data[at] & 127) << shift
        shift += 7
        at += 1
    return first >> 4 & 7, size, at


def entry(kind: int, content: bytes) -> bytes:
    """An entry of a pack that holds a whole object."""
    size = len(content)
    head = [kind << 4 | size & 15]
    size >>= 4
    while size:
        head[-1] |= 128
        head.append(size & 127)
        size >>= 7
    return bytes(head) + zlib.compress(content)


def back_offset(data: bytes, at: int) -> tuple[int, int]:
    """How far before an entry its base lies, and where the number ends."""
    value = data[at] & 127
    while data[at] & 128:
        at += 1
        value = (value + 1) << 7 | data[at] & 127
    return value, at + 1


def _size(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if not data[at - 1] & 128:
            return value, at


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The object that a delta makes of its base: copies from the base and insertions."""
    told, at = _size(delta, 0)
    size, at = _size(delta, at)
    if told != len(base):
        raise ValueError(f"delta for a base of {told} bytes met one of {len(base)}")
    parts = []
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 128:
            where = length = 0
            for bit in range(7):
                if op >> bit & 1:
                    if bit < 4:
                        where |= delta[at] << 8 * bit
                    else:
                        length |= delta[at] << 8 * (bit - 4)
                    at += 1
            length = length or 65536
            if where + length > len(base):
                raise ValueError("delta copies from beyond its base")
            parts.append(base[where : where + length])
        elif op:
            parts.append(delta[at : at + op])
            at += op
        else:
            raise ValueError("delta with a reserved instruction")
    out = b"".join(parts)
    if len(out) != size:
        raise ValueError(f"delta made {len(out)} bytes of {size}")
    return out


def tree_entries(content: bytes, width: int = 20) -> Iterator[tuple[int, str, str]]:
    """mode, name and id of each entry of a tree; names must be UTF-8."""
    at = 0
    while at < len(content):
        end = content.index(b"\0", at)
        mode, _, name = content[at:end].partition(b" ")
        at = end + 1 + width
        yield int(mode, 8), name.decode("utf-8"), content[end + 1 : at].hex()


def tree(entries: list[tuple[int, str, str]]) -> bytes:
    """A tree's content; directories are ordered as if their names ended with a slash."""
    key = lambda e: e[1].encode() + (b"/" if e[0] == DIRECTORY else b"")
    return b"".join(b"%o %s\0%s" % (mode, name.encode(), bytes.fromhex(sha)) for mode, name, sha in sorted(entries, key=key))


def index_entries(data: bytes, version: int, n: int, width: int = 20) -> Iterator[tuple[str, int, int, str, int]]:
    """path, mode, stage, id and size on disk of n entries of an index that begin with the data."""
    at, path = 0, b""
    for _ in range(n):
        mode, size = struct.unpack_from(">I", data, at + 24)[0], struct.unpack_from(">I", data, at + 36)[0]
        sha = data[at + 40 : at + 40 + width].hex()
        (flags,) = struct.unpack_from(">H", data, at + 40 + width)
        name = at + 42 + width + (2 if version > 2 and flags & 0x4000 else 0)
        if version == 4:
            cut, name = back_offset(data, name)
            end = data.index(b"\0", name)
            path = path[: len(path) - cut] + data[name:end]
            at = end + 1
        else:
            end = data.index(b"\0", name)
            path = data[name:end]
            at += (end - at) // 8 * 8 + 8
        yield path.decode("utf-8"), mode, flags >> 12 & 3, sha, size
