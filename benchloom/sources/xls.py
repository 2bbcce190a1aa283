"""Sheets of ``.xls`` books: a compound file (sectors in chains) that holds one stream of records (BIFF8).

Texts are shared: a table of all texts stands at the head of the book, cut into records of at most 8224 bytes that continue each
other, also within a text, where the next record says anew how its characters are stored. Numbers keep their value: days stay the
numbers that sheets count, as in ``.xlsx``. Books with a password and those before BIFF8 raise ValueError.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import batched

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
# Fixed values of the compound format: marks of sectors, and the size below which a stream is kept in small sectors.
FREE, END, FAT_SECTOR = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD
LAST_SECTOR = 0xFFFFFFFA
SMALL = 4096
# Numbers of records.
BOF, EOF, CONTINUE, BOUNDSHEET, SST, FILEPASS = 0x0809, 0x000A, 0x003C, 0x0085, 0x00FC, 0x002F
LABELSST, LABEL, RSTRING, NUMBER, RK, MULRK, FORMULA, STRING, BOOLERR = 0x00FD, 0x0204, 0x00D6, 0x0203, 0x027E, 0x00BD, 0x0006, 0x0207, 0x0205
# What cells in error show.
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}
MAX_RECORD, MAX_ROWS = 8224, 65536


def stream(content: bytes, names: tuple[str, ...] = ("Workbook", "Book")) -> bytes:
    """A stream of a compound file, the first of ``names`` that it has."""
    if content[:8] != MAGIC:
        raise ValueError("not a compound file")
    shift, small_shift = struct.unpack_from("<HH", content, 30)
    n_fat, first_dir = struct.unpack_from("<II", content, 44)
    cutoff, first_small, n_small, first_difat = struct.unpack_from("<IIII", content, 56)
    size, per = 1 << shift, (1 << shift) // 4

    def sector(i: int) -> bytes:
        return content[(i + 1) * size : (i + 2) * size].ljust(size, b"\0")

    listed, more = list(struct.unpack_from("<109I", content, 76)), first_difat
    while more <= LAST_SECTOR and len(listed) < n_fat + 109:
        *part, more = struct.unpack(f"<{per}I", sector(more))
        listed += part
    fat = [x for i in listed if i <= LAST_SECTOR for x in struct.unpack(f"<{per}I", sector(i))]

    def chain(start: int, links: list[int], piece) -> bytes:
        out, seen = [], 0
        while start <= LAST_SECTOR:
            if start >= len(links) or seen > len(links):
                raise ValueError("broken chain of sectors")
            out.append(piece(start))
            start, seen = links[start], seen + 1
        return b"".join(out)

    found = {}
    for at in range(0, len(folder := chain(first_dir, fat, sector)) - 127, 128):
        length, kind = struct.unpack_from("<HB", folder, at + 64)
        start, n = struct.unpack_from("<II", folder, at + 116)
        if kind in (2, 5):
            found["" if kind == 5 else folder[at : at + max(length - 2, 0)].decode("utf-16-le").lower()] = (start, n)
    for name in names:
        if name.lower() in found:
            start, n = found[name.lower()]
            if n >= cutoff:
                return chain(start, fat, sector)[:n]
            held, unit = chain(found[""][0], fat, sector), 1 << small_shift
            links = list(struct.unpack(f"<{per * n_small}I", chain(first_small, fat, sector)[: 4 * per * n_small])) if n_small else []
            return chain(start, links, lambda i: held[i * unit : (i + 1) * unit])[:n]
    raise ValueError("a compound file without a book")


def records(data: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """Records from a place on: the number and the pieces of each (those that continue it are its further pieces)."""
    held: tuple[int, list[bytes]] | None = None
    while at + 4 <= len(data):
        kind, n = struct.unpack_from("<HH", data, at)
        body, at = data[at + 4 : at + 4 + n], at + 4 + n
        if kind == CONTINUE and held:
            held[1].append(body)
            continue
        if held:
            yield held
        held = (kind, [body])
    if held:
        yield held


class _Pieces:
    """Reads over the pieces of a record; characters that go on in the next piece start there with a new mark of their width."""

    def __init__(self, pieces: list[bytes], at: int = 0):
        self.pieces, self.i, self.at = pieces, 0, at

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.at >= len(self.pieces[self.i]):
                self.i, self.at = self.i + 1, 0
                if self.i >= len(self.pieces):
                    raise ValueError("a record ends within a value")
            part = self.pieces[self.i][self.at : self.at + n - len(out)]
            out, self.at = out + part, self.at + len(part)
        return out

    def text(self, width_of_count: int = 2) -> str:
        n, mark = int.from_bytes(self.take(width_of_count), "little"), self.take(1)[0]
        runs = int.from_bytes(self.take(2), "little") if mark & 8 else 0
        extra = int.from_bytes(self.take(4), "little") if mark & 4 else 0
        wide, units = mark & 1, []
        while n > 0:
            if self.at >= len(self.pieces[self.i]):
                wide = self.take(1)[0] & 1
            here = min(n, (len(self.pieces[self.i]) - self.at) // (2 if wide else 1))
            if here == 0:
                raise ValueError("a character is cut")
            part, n = self.take(here * (2 if wide else 1)), n - here
            units.append(part if wide else part.decode("latin-1").encode("utf-16-le"))
        self.take(4 * runs + extra)
        return b"".join(units).decode("utf-16-le", "replace")


def _rk(x: int) -> float:
    value = float((x >> 2) - (1 << 30 if x & 0x80000000 else 0)) if x & 2 else struct.unpack("<d", struct.pack("<Q", (x & 0xFFFFFFFC) << 32))[0]
    return value / 100 if x & 1 else value


def _book(data: bytes) -> tuple[dict[str, int], list[str]]:
    """Where each sheet's records begin, in the book's order, and the shared texts."""
    sheets, shared = {}, []
    for kind, pieces in records(data):
        body = pieces[0]
        if kind == BOF and struct.unpack_from("<H", body)[0] != 0x0600:
            raise ValueError("a book older than BIFF8")
        if kind == FILEPASS:
            raise ValueError("the book has a password")
        if kind == BOUNDSHEET and body[5] == 0:
            sheets[_Pieces(pieces, 6).text(1)] = struct.unpack_from("<I", body)[0]
        elif kind == SST:
            reader = _Pieces(pieces, 8)
            shared = [reader.text() for _ in range(struct.unpack_from("<I", body, 4)[0])]
        elif kind == EOF:
            break
    return sheets, shared


def sheet_names(content: bytes) -> list[str]:
    return list(_book(stream(content))[0])


def cells(content: bytes, sheet: str | None = None) -> Iterator[tuple[int, int, object]]:
    """Row and column (from 0) and value of each filled cell: a number, a text, or ``1`` and ``0`` for true and false."""
    data = stream(content)
    sheets, shared = _book(data)
    if not sheets:
        return
    sheet = sheet or next(iter(sheets))
    if sheet not in sheets:
        raise KeyError(f"no sheet {sheet!r}; there are {', '.join(sheets)}")
    formula, depth = None, 0
    for kind, pieces in records(data, sheets[sheet]):
        body = pieces[0]
        depth += (kind == BOF) - (kind == EOF)  # a chart within a sheet has its own records
        if depth == 0:
            break
        if depth > 1 or kind in (BOF, EOF):
            continue
        if kind == STRING and formula:
            yield *formula, _Pieces(pieces).text()
        if kind not in (LABELSST, LABEL, RSTRING, NUMBER, RK, MULRK, FORMULA, BOOLERR):
            continue
        row, column = struct.unpack_from("<HH", body)
        if kind == LABELSST:
            yield row, column, shared[struct.unpack_from("<I", body, 6)[0]]
        elif kind in (LABEL, RSTRING):
            n, mark = struct.unpack_from("<HB", body, 6)
            yield row, column, body[9 : 9 + n * (1 + (mark & 1))].decode("utf-16-le" if mark & 1 else "latin-1", "replace")
        elif kind == NUMBER:
            yield row, column, struct.unpack_from("<d", body, 6)[0]
        elif kind == RK:
            yield row, column, _rk(struct.unpack_from("<I", body, 6)[0])
        elif kind == MULRK:
            for k in range((len(body) - 6) // 6):
                yield row, column + k, _rk(struct.unpack_from("<I", body, 6 + 6 * k)[0])
        elif kind == BOOLERR:
            yield row, column, ERRORS.get(body[6], "#N/A") if body[7] else str(body[6])
        elif kind == FORMULA:
            formula = (row, column)
            if body[12:14] != b"\xff\xff":
                yield row, column, struct.unpack_from("<d", body, 6)[0]
            elif body[6] in (1, 2):  # true or false, or an error; 0 is a text in the record that follows, 3 is empty
                yield row, column, str(body[8]) if body[6] == 1 else ERRORS.get(body[8], "#N/A")


def _text(s: str, width_of_count: str) -> bytes:
    data = s.encode("utf-16-le")
    return struct.pack(f"<{width_of_count}B", len(data) // 2, 1) + data


def _record(kind: int, body: bytes) -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def write_book(sheets: dict[str, list[list[object]]]) -> bytes:
    """A book of sheets: numbers stay numbers, other cells become shared texts, empty ones are left out."""
    texts: dict[str, int] = {}
    bodies, uses = [], 0
    for grid in sheets.values():
        if len(grid) > MAX_ROWS:
            raise ValueError(f"a sheet takes {MAX_ROWS} rows")
        out = [_record(BOF, struct.pack("<HHHHII", 0x0600, 0x0010, 0, 0, 0, 6))]
        for i, row in enumerate(grid):
            for j, v in enumerate(row):
                if isinstance(v, (int, float)):
                    out.append(_record(NUMBER, struct.pack("<HHHd", i, j, 0, float(v))))
                elif v not in (None, ""):
                    out.append(_record(LABELSST, struct.pack("<HHHI", i, j, 0, texts.setdefault(str(v), len(texts)))))
                    uses += 1
        bodies.append(b"".join([*out, _record(EOF, b"")]))
    pieces = [struct.pack("<II", uses, len(texts))]
    for s in texts:
        data = _text(s, "H")
        if len(pieces[-1]) + 5 > MAX_RECORD:
            pieces.append(b"")
        while data:
            room = (MAX_RECORD - len(pieces[-1])) // 2 * 2
            if len(pieces[-1]) + len(data) > MAX_RECORD and len(data) % 2 == 1:
                room -= 1  # count and mark are three bytes: the cut falls between characters
            pieces[-1] += data[:room]
            data = data[room:]
            if data:
                pieces.append(b"\x01")
    table = b"".join(_record(SST if k == 0 else CONTINUE, p) for k, p in enumerate(pieces))
    head = _record(BOF, struct.pack("<HHHHII", 0x0600, 0x0005, 0, 0, 0, 6))
    bound = [struct.pack("<BB", 0, 0) + _text(n, "B") for n in sheets]
    at, places = len(head) + sum(8 + len(b) for b in bound) + len(table) + 4, []
    for b in bodies:
        places.append(at)
        at += len(b)
    return compound(head + b"".join(_record(BOUNDSHEET, struct.pack("<I", p) + b) for p, b in zip(places, bound)) + table + _record(EOF, b"") + b"".join(bodies))


def compound(data: bytes, name: str = "Workbook") -> bytes:
    """A compound file with one stream; a short one is kept in small sectors, as the format wants it."""
    pad = lambda b: b.ljust(-(-len(b) // 512) * 512, b"\0")
    follow = lambda first, n: [*range(first + 1, first + n), END] if n else []
    small = len(data) < SMALL
    n_small = -(-len(data) // 64)
    links = pad(struct.pack(f"<{n_small}I", *follow(0, n_small))) if small else b""
    links = links[: 4 * n_small].ljust(len(links), b"\xff")
    parts = [b"", links, pad(data)]  # folder, links of small sectors, data
    n_parts = [1, len(parts[1]) // 512, len(parts[2]) // 512]
    n_fat = 1
    while n_fat * 128 < sum(n_parts) + n_fat:
        n_fat += 1
    if n_fat > 109:
        raise ValueError("a book of more than 7 MB is not written")
    first = [n_fat, n_fat + 1, n_fat + 1 + n_parts[1]]
    fat = [FAT_SECTOR] * n_fat + [x for f, n in zip(first, n_parts) for x in follow(f, n)]
    fat += [FREE] * (n_fat * 128 - len(fat))

    def entry(title: str, kind: int, child: int, start: int, size: int) -> bytes:
        words = title.encode("utf-16-le")
        return words.ljust(64, b"\0") + struct.pack("<HBBIII", len(words) + 2, kind, 1, FREE, FREE, child) + bytes(36) + struct.pack("<IQ", start, size)

    root = entry("Root Entry", 5, 1, first[2] if small and data else END, n_small * 64 if small else 0)
    parts[0] = pad(root + entry(name, 2, FREE, (0 if data else END) if small else first[2], len(data)))
    head = MAGIC + bytes(16) + struct.pack("<HHHHH6xIIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, n_fat, first[0], 0, SMALL, first[1] if n_parts[1] else END, n_parts[1], END, 0, 0)[:-4]
    listed = [*range(n_fat), *[FREE] * (109 - n_fat)]
    return head + struct.pack("<109I", *listed) + b"".join(struct.pack("<128I", *f) for f in batched(fat, 128)) + b"".join(parts)
