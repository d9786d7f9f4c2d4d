"""Encapsulated pixel data: fragments to frames, run-length and lossless JPEG decoding, and the encoders that fixtures need."""

from __future__ import annotations

import struct

import numpy as np

from ..errors import InvalidDicomError

#: Transfer syntaxes.
IMPLICIT, EXPLICIT, DEFLATED, BIG = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.2"
RUN_LENGTH, LOSSLESS, LOSSLESS_FIRST = "1.2.840.10008.1.2.5", "1.2.840.10008.1.2.4.57", "1.2.840.10008.1.2.4.70"


def frames(fragments: list[bytes], n: int, extended: bytes | None = None) -> list[bytes]:
    """The n encoded frames of an offset table and its fragments.

    Several fragments are one frame, if there is one, or a frame each, or are
    joined where the extended or the basic offset table says that frames begin.
    """
    table, parts = (fragments[0], fragments[1:]) if fragments else (b"", [])
    if n == 1:
        return [b"".join(parts)]
    if len(parts) == n:
        return parts
    begins = np.frombuffer(extended, "<u8").tolist() if extended else np.frombuffer(table, "<u4").tolist()
    if len(begins) != n:
        raise InvalidDicomError(f"{len(parts)} fragments for {n} frames and no offset table")
    starts, out, at = set(begins), [], 0
    for p in parts:
        if at in starts:
            out.append(b"")
        if not out:
            raise InvalidDicomError("no frame begins at the first fragment")
        out[-1] += p
        at += 8 + len(p)
    if len(out) != n:
        raise InvalidDicomError("the offset table does not fit the fragments")
    return out


# --- run lengths --------------------------------------------------------------------


def unpacked(data: bytes, size: int) -> bytes:
    """``size`` bytes of literal runs (count - 1, bytes) and repeats (257 - count, byte)."""
    out, at = bytearray(), 0
    while len(out) < size and at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + n + 2]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    if len(out) < size:
        raise InvalidDicomError("the run lengths end before the frame is full")
    return bytes(out[:size])


def packed(data: bytes) -> bytes:
    out, at = bytearray(), 0
    values = np.frombuffer(data, np.uint8)
    edges = np.append(np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)) if len(values) else []
    literal = bytearray()

    def flush() -> None:
        for i in range(0, len(literal), 128):
            piece = literal[i : i + 128]
            out.extend([len(piece) - 1, *piece])
        literal.clear()

    for end in edges:
        n = int(end) - at
        if n < 3:
            literal += data[at:end]
        else:
            flush()
            while n:
                k = min(n, 128)
                out.extend([257 - k, data[at]] if k > 1 else [0, data[at]])
                n -= k
        at = int(end)
    flush()
    return bytes(out) + b"\x00" * (len(out) % 2)


def decode_runs(frame: bytes, rows: int, cols: int, width: int) -> np.ndarray:
    """A frame of one sample per pixel of ``width`` bytes: a segment per byte, the highest first."""
    if len(frame) < 64:
        raise InvalidDicomError("the frame has no segment table")
    n, *begins = struct.unpack_from("<16I", frame)
    if n != width:
        raise InvalidDicomError(f"{n} segments for {width} bytes a pixel")
    ends = [*begins[1:n], len(frame)]
    planes = [np.frombuffer(unpacked(frame[i:j], rows * cols), np.uint8) for i, j in zip(begins[:n], ends, strict=True)]
    return np.stack(planes[::-1], axis=1).copy().view(f"<u{width}").reshape(rows, cols)


def encode_runs(a: np.ndarray) -> bytes:
    """The inverse of ``decode_runs`` for an array of unsigned integers."""
    planes = a.astype(f"<u{a.itemsize}").reshape(-1, 1).view(np.uint8)[:, ::-1]
    parts = [packed(p.tobytes()) for p in planes.T]
    begins = np.cumsum([64, *map(len, parts)])[:-1].tolist()
    return struct.pack("<16I", len(parts), *begins, *[0] * (15 - len(parts))) + b"".join(parts)


# --- lossless JPEG ------------------------------------------------------------------


def codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(code, length, symbol): codes of a length follow each other, those of the next begin at the double."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, length, symbols[at]))
            code, at = code + 1, at + 1
        code *= 2
    return out


def differences(data: bytes, n: int, table: list[tuple[int, int, int]]) -> np.ndarray:
    """n differences of entropy-coded data: a code for the number of bits, then these bits."""
    look = np.zeros(1 << 16, np.int32)  # of the next 16 bits: length and symbol
    for code, length, symbol in table:
        look[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    find, data = look.tolist(), data.replace(b"\xff\x00", b"\xff") + b"\x00" * 8
    out, held, have, at, end = [0] * n, 0, 0, 0, len(data)
    for i in range(n):
        while have < 32 and at < end:
            held = (held << 32 | int.from_bytes(data[at : at + 4], "big")) if at + 4 <= end else held << 32
            have, at = have + 32, at + 4
        entry = find[held >> (have - 16) & 0xFFFF]
        if not entry:
            raise InvalidDicomError("an unknown code in the compressed frame")
        have -= entry >> 8
        bits = entry & 0xFF
        if bits == 16:
            out[i] = 32768
        elif bits:
            have -= bits
            v = held >> have & ((1 << bits) - 1)
            out[i] = v if v >> (bits - 1) else v - (1 << bits) + 1
        held &= (1 << have) - 1
    return np.array(out, np.int64)


def predicted(d: np.ndarray, kind: int, first: int) -> np.ndarray:
    """Samples modulo 2 ** 16 from their differences to the prediction: kind 1 the left one, 2 the upper one, 3 to 7 of both and the one between."""
    rows, cols = d.shape
    d = d.copy()
    d[0, 0] += first
    if kind == 1:
        d[:, 0] = np.cumsum(d[:, 0])
        return np.cumsum(d, axis=1) & 0xFFFF
    if kind == 2:
        d[0] = np.cumsum(d[0])
        return np.cumsum(d, axis=0) & 0xFFFF
    of = {3: lambda a, b, c: c, 4: lambda a, b, c: a + b - c, 5: lambda a, b, c: a + ((b - c) >> 1), 6: lambda a, b, c: b + ((a - c) >> 1), 7: lambda a, b, c: (a + b) >> 1}[kind]
    out = [(np.cumsum(d[0]) & 0xFFFF).tolist()]
    for row in d[1:].tolist():
        up = out[-1]
        now = [(row[0] + up[0]) & 0xFFFF]
        for x in range(1, cols):
            now.append((row[x] + of(now[-1], up[x], up[x - 1])) & 0xFFFF)
        out.append(now)
    return np.array(out)


def decode_lossless(frame: bytes) -> np.ndarray:
    """A frame of one component of a lossless process with Huffman codes."""
    at, tables, shape, bits, restart = 2, {}, None, 0, 0
    if frame[:2] != b"\xff\xd8":
        raise InvalidDicomError("the compressed frame has no start")
    while at + 4 <= len(frame):
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body, at = frame[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] & 15] = codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC3:
            bits, rows, cols, components = struct.unpack_from(">BHHB", body)
            if components != 1:
                raise InvalidDicomError("only one sample per pixel is read")
            shape = (rows, cols)
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise InvalidDicomError("the compressed frame is not lossless with Huffman codes")
        elif marker == 0xDA:
            break
    else:
        raise InvalidDicomError("the compressed frame has no scan")
    if shape is None or restart:
        raise InvalidDicomError("restarts inside a compressed frame are not read" if restart else "the compressed frame has no size")
    kind, point = body[3], body[5] & 15
    if not 1 <= kind <= 7:
        raise InvalidDicomError(f"unknown prediction {kind}")
    end = frame.rfind(b"\xff\xd9")
    d = differences(frame[at : end if end >= at else len(frame)], shape[0] * shape[1], tables[body[2] >> 4])
    return (predicted(d.reshape(shape), kind, 1 << (bits - point - 1)) << point) & 0xFFFF


def encode_lossless(a: np.ndarray, kind: int = 1) -> bytes:
    """The inverse of ``decode_lossless`` for 16-bit unsigned integers, with one plain code table."""
    v = a.astype(np.int64)
    rows, cols = v.shape
    left, up, both = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    left[:, 1:], up[1:], both[1:, 1:] = v[:, :-1], v[:-1], v[:-1, :-1]
    p = {1: left, 2: up, 3: both, 4: left + up - both, 5: left + ((up - both) >> 1), 6: up + ((left - both) >> 1), 7: (left + up) >> 1}[kind].copy()
    p[0, 1:], p[1:, 0], p[0, 0] = v[0, :-1], v[:-1, 0], 1 << 15
    text = []
    for x in ((v - p + 32767) % 65536 - 32767).ravel().tolist():
        n = abs(x).bit_length() if x != 32768 else 16
        text.append(f"{n:05b}" + (f"{x if x > 0 else x + (1 << n) - 1:0{n}b}" if 0 < n < 16 else ""))
    bits = "".join(text)
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    part = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    table = bytes([0, 0, 0, 0, 0, 17, *[0] * 11, *range(17)])  # seventeen codes of five bits
    return b"\xff\xd8" + part(0xC3, struct.pack(">BHHB3B", 16, rows, cols, 1, 1, 0x11, 0)) + part(0xC4, table) + part(0xDA, bytes([1, 1, 0, kind, 0, 0])) + data + b"\xff\xd9"


def decode(fragments: list[bytes], syntax: str, n: int, rows: int, cols: int, width: int, extended: bytes | None = None) -> np.ndarray:
    """(frames, rows, columns) of unsigned stored values."""
    if syntax == RUN_LENGTH:
        return np.stack([decode_runs(f, rows, cols, width) for f in frames(fragments, n, extended)])
    if syntax in (LOSSLESS, LOSSLESS_FIRST):
        out = np.stack([decode_lossless(f) for f in frames(fragments, n, extended)])
        if out.shape[1:] != (rows, cols):
            raise InvalidDicomError("the compressed frame has another size than the header says")
        return out.astype(f"<u{width}")
    raise InvalidDicomError(f"compressed pixels ({syntax}) are not read")


def encapsulated(encoded: list[bytes]) -> list[bytes]:
    """An offset table and a fragment for each frame, of even length."""
    even = [f + b"\x00" * (len(f) % 2) for f in encoded]
    begins = np.cumsum([0, *[8 + len(f) for f in even]])[:-1]
    return [begins.astype("<u4").tobytes(), *even]


