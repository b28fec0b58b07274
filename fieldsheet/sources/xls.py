"""Legacy binary workbooks: compound files with a BIFF8 stream, as far as cells go."""

from __future__ import annotations

import struct
from collections.abc import Iterator

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
END = 0xFFFFFFFA  # sector numbers from here on are marks


class Unreadable(ValueError):
    """The file is damaged, protected or of an older format."""


def stream(data: bytes, names: tuple[str, ...] = ("Workbook", "Book")) -> bytes:
    """The named stream of a compound file."""
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    at = lambda n: data[(n + 1) * size : (n + 2) * size]
    first_dir, = struct.unpack_from("<I", data, 48)
    cutoff, mini_start, _, difat, _ = struct.unpack_from("<5I", data, 56)
    blocks = list(struct.unpack_from("<109I", data, 76))
    while difat < END:
        more = struct.unpack(f"<{size // 4}I", at(difat))
        blocks += more[:-1]
        difat = more[-1]
    fat = [x for b in blocks if b < END for x in struct.unpack(f"<{size // 4}I", at(b).ljust(size, b"\xff"))]

    def chain(n: int, table: list[int], part) -> bytes:
        out, seen = [], 0
        while n < END:
            out.append(part(n))
            n, seen = table[n], seen + 1
            if seen > len(table):
                raise Unreadable("a chain of sectors has no end")
        return b"".join(out)

    entries = chain(first_dir, fat, at)
    root = None
    for i in range(0, len(entries) - 127, 128):
        e = entries[i : i + 128]
        n, = struct.unpack_from("<H", e, 64)
        name, kind = e[: max(0, n - 2)].decode("utf-16-le", "replace"), e[66]
        start, length = struct.unpack_from("<2I", e, 116)
        if kind == 5:
            root = start
        if kind == 2 and name in names:
            if length >= cutoff:
                return chain(start, fat, at)[:length]
            raw = chain(mini_start, fat, at)
            mini = list(struct.unpack(f"<{len(raw) // 4}I", raw))
            whole = chain(root, fat, at)
            return chain(start, mini, lambda n: whole[n * small : (n + 1) * small])[:length]
    raise Unreadable("no workbook stream")


def records(book: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """Record types with their parts: a record, and what continues it."""
    held: tuple[int, list[bytes]] | None = None
    while at + 4 <= len(book):
        kind, n = struct.unpack_from("<2H", book, at)
        body = book[at + 4 : at + 4 + n]
        at += 4 + n
        if kind == 0x3C and held:
            held[1].append(body)
            continue
        if held:
            yield held
        held = (kind, [body])
    if held:
        yield held


def shared_strings(parts: list[bytes]) -> list[str]:
    """The shared strings; a string cut by a part's end says its width anew at the next part's start."""
    count, = struct.unpack_from("<I", parts[0], 4)
    p, at, out = 0, 8, []

    def take(n: int) -> bytes:
        nonlocal p, at
        got = b""
        while len(got) < n:
            if at >= len(parts[p]):
                p, at = p + 1, 0
            more = parts[p][at : at + n - len(got)]
            got, at = got + more, at + len(more)
        return got

    for _ in range(count):
        length, flags = struct.unpack("<HB", take(3))
        runs = struct.unpack("<H", take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", take(4))[0] if flags & 4 else 0
        wide, text, left = flags & 1, "", length
        while left:
            if at >= len(parts[p]):
                p, at = p + 1, 1
                wide = parts[p][0] & 1
            room = min(left, (len(parts[p]) - at) // (2 if wide else 1))
            raw = parts[p][at : at + room * (2 if wide else 1)]
            text += raw.decode("utf-16-le" if wide else "latin-1", "replace")
            at, left = at + len(raw), left - room
        take(4 * runs + extra)
        out.append(text)
    return out


def plain_string(b: bytes, at: int, width: int = 2) -> str:
    n = int.from_bytes(b[at : at + width], "little")
    at += width
    wide = b[at] & 1
    return b[at + 1 : at + 1 + n * (2 if wide else 1)].decode("utf-16-le" if wide else "latin-1", "replace")


def rk(v: int) -> float:
    x = float((v - (1 << 32) if v >> 31 else v) >> 2) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & ~3) << 32))[0]
    return x / 100 if v & 1 else x


def cells(data: bytes) -> Iterator[tuple[int, str, int, int, float | str]]:
    """``sheet_ord, sheet_name, row, column, value``, rows and columns from 0; formulas give stored values."""
    if not data.startswith(MAGIC):
        raise Unreadable("not a compound file")
    book = stream(data)
    sheets, strings = [], []
    for kind, parts in records(book):
        b = parts[0]
        if kind == 0x809 and not sheets and struct.unpack_from("<H", b)[0] != 0x600:
            raise Unreadable("an older format than BIFF8")
        if kind == 0x2F:
            raise Unreadable("protected by a password")
        if kind == 0x85:
            sheets.append((struct.unpack_from("<I", b)[0], plain_string(b, 6, 1)))
        elif kind == 0xFC:
            strings = shared_strings(parts)
        elif kind == 0x0A:
            break
    for i, (at, name) in enumerate(sheets):
        waiting = None
        for kind, parts in records(book, at):
            b = parts[0]
            if kind == 0x0A:
                break
            if kind == 0x207 and waiting:
                yield (i, name, *waiting, plain_string(b"".join(parts), 0))
                waiting = None
            if kind not in (0xFD, 0x203, 0x27E, 0xBD, 0x06, 0x204, 0xD6, 0x205):
                continue
            r, c = struct.unpack_from("<2H", b)
            if kind == 0xFD:
                yield i, name, r, c, strings[struct.unpack_from("<I", b, 6)[0]]
            elif kind == 0x203:
                yield i, name, r, c, struct.unpack_from("<d", b, 6)[0]
            elif kind == 0x27E:
                yield i, name, r, c, rk(struct.unpack_from("<I", b, 6)[0])
            elif kind == 0xBD:
                for k in range((len(b) - 6) // 6):
                    yield i, name, r, c + k, rk(struct.unpack_from("<I", b, 6 + 6 * k)[0])
            elif kind == 0x06:
                if b[12:14] != b"\xff\xff":
                    yield i, name, r, c, struct.unpack_from("<d", b, 6)[0]
                elif b[6] == 0:
                    waiting = (r, c)
                elif b[6] == 1:
                    yield i, name, r, c, "true" if b[8] else "false"
                elif b[6] == 3:
                    yield i, name, r, c, ""
            elif kind in (0x204, 0xD6):
                yield i, name, r, c, plain_string(b, 6)
            elif not b[7]:
                yield i, name, r, c, "true" if b[6] else "false"
