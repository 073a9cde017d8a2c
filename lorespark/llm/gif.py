"""GIF: LZW code streams, palettes, disposal and transparency, in numpy and plain Python."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

CLEAR, END, FIRST = 256, 257, 258
#: Codes between two clears fill the table; the clear is the last of them.
_FULL = 4096 - FIRST
GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


def _widths(least: int, n: int) -> np.ndarray:
    """Bits of the first, second, ... code after a clear, for roots of ``least`` bits."""
    size = (1 << least) + 2 + np.maximum(0, np.arange(n) - 1)
    return np.minimum(12, np.floor(np.log2(size)).astype(np.int64) + 1)


_W8 = _widths(8, _FULL + 2)


def lzw_encode(data: bytes) -> bytes:
    """Codes of ``data`` (8-bit roots) as bytes, from a first clear to the end code."""
    segments, codes, table, nxt = [], [], {}, FIRST
    get, add = table.get, codes.append
    p = data[0] if data else None
    for b in data[1:]:
        k = p << 8 | b
        c = get(k)
        if c is not None:
            p = c
            continue
        add(p)
        table[k] = nxt
        nxt += 1
        p = b
        if nxt == 4096:
            add(CLEAR)
            segments.append(codes)
            codes, nxt = [], FIRST
            table.clear()
            add = codes.append
    if p is not None:
        codes.append(p)
    codes.append(END)
    segments.append(codes)
    values = np.array([CLEAR, *(c for s in segments for c in s)], np.int64)
    widths = np.concatenate([_W8[:1], *[_W8[: len(s)] for s in segments]])
    bits = np.unpackbits(values.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, count=12, bitorder="little")
    return np.packbits(bits[np.arange(12) < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(data: bytes, least: int, limit: int) -> bytes:
    """At most ``limit`` samples of a code stream; what a broken stream still gives, if it breaks off."""
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.int64)
    clear, end, first = 1 << least, (1 << least) + 1, (1 << least) + 2
    n = 4096 - first + 2
    widths = _W8 if least == 8 else _widths(least, n)
    offsets = np.concatenate([[0], np.cumsum(widths)])
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    put = out.append
    bit, total = 0, 8 * len(data)
    table, prev = list(roots), None
    add = table.append
    started = 0  # codes since the last clear
    while bit < total:
        if started == 0:
            at, w = bit + offsets[:-1], widths
        else:  # the table is full and no clear came: codes of 12 bits go on
            w = np.full(n, 12, np.int64)
            at = bit + 12 * np.arange(n)
        fits = at + w <= total
        at, w = at[fits], w[fits]
        if not len(at):
            break
        byte = at >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (at & 7) & ((1 << w) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else None
        codes_left = iter(codes[:stop].tolist())
        if prev is None:
            c = next(codes_left, None)
            if c is not None:
                if c >= clear:
                    break
                prev = roots[c]
                put(prev)
        size = len(table)
        for c in codes_left:
            if c < size:
                entry = table[c]
                if size < 4096:
                    add(prev + entry[:1])
                    size += 1
            elif c == size < 4096:
                entry = prev + prev[:1]
                add(entry)
                size += 1
            else:
                return b"".join(out)[:limit]
            put(entry)
            prev = entry
        if stop is None:
            bit = int(at[-1] + w[-1])
            started += len(codes)
            continue
        if codes[stop] == end:
            break
        bit = int(at[stop] + w[stop])
        table, prev, started = list(roots), None, 0
        add = table.append
    return b"".join(out)[:limit]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode(samples: bytes, width: int = 192, rows: int = 512, delay_cs: int = 4) -> bytes:
    """``samples`` (whole rows of ``width``) as grey frames of at most ``rows`` rows each."""
    height = len(samples) // width
    if not height or height * width != len(samples):
        raise ValueError("samples fill whole rows, one at least")
    out = [b"GIF89a", width.to_bytes(2, "little"), min(rows, height).to_bytes(2, "little"), b"\xf7\0\0", GREY.tobytes()]
    for top in range(0, height, rows):
        part = samples[top * width : (top + rows) * width]
        out += [b"\x21\xf9\x04\x04", delay_cs.to_bytes(2, "little"), b"\0\0", b"\x2c\0\0\0\0", width.to_bytes(2, "little"), (len(part) // width).to_bytes(2, "little"), b"\0\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    index: int
    delay_cs: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    transparent: int | None
    indices: np.ndarray
    canvas: np.ndarray = field(repr=False)  # RGBA after drawing

    def drawn(self) -> np.ndarray:
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]


def decode(data: bytes) -> list[Frame]:
    """Frames as shown: each drawn over what the disposal of the one before left."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), data[10]
    at = 13

    def palette(at: int, flags: int) -> tuple[np.ndarray | None, int]:
        if not flags & 0x80:
            return None, at
        n = 3 << ((flags & 7) + 1)
        return np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    common, at = palette(at, flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    frames: list[Frame] = []
    disposal, delay, transparent = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = blocks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little")
                transparent = body[3] if body[0] & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError(f"block {data[at]} is unknown")
        left, top, w, h = (int.from_bytes(data[at + k : at + k + 2], "little") for k in (1, 3, 5, 7))
        packed = data[at + 9]
        own, at = palette(at + 10, packed)
        least = data[at]
        body, at = blocks(at + 1)
        colours = own if own is not None else common if common is not None else GREY
        flat = np.zeros(w * h, np.uint8)
        got = np.frombuffer(lzw_decode(body, least, w * h), np.uint8)
        flat[: len(got)] = got
        image = flat.reshape(h, w)
        if packed & 0x40:
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(image)
            straight[order] = image
            image = straight
        before = canvas.copy() if disposal == 3 else None
        region = canvas[top : top + h, left : left + w]
        seen = image[: region.shape[0], : region.shape[1]]
        table = np.full((256, 4), 255, np.uint8)
        table[:, :3] = colours[np.minimum(np.arange(256), len(colours) - 1)]
        rgba = table.view(np.uint32)[:, 0][seen].view(np.uint8).reshape(*seen.shape, 4)
        if transparent is None:
            region[...] = rgba
        else:
            shown = seen != transparent
            region[shown] = rgba[shown]
        frames.append(Frame(len(frames), delay, left, top, w, h, disposal, transparent, image, canvas.copy()))
        if disposal == 2:
            region[:] = 0
        elif before is not None:
            canvas = before
        disposal, delay, transparent = 0, 0, None
    return frames


def histogram(frame: Frame, bins: int = 16) -> list[int]:
    """Counts of the red, green and blue of what the frame's canvas shows, ``bins`` each."""
    canvas = frame.canvas.reshape(-1, 4)
    shown = canvas[:, 3] > 0
    canvas = canvas if shown.all() else canvas[shown]
    fine = [np.bincount(canvas[:, k], minlength=256) for k in range(3)]
    return np.concatenate([np.add.reduceat(c, np.arange(0, 256, 256 // bins)) for c in fine]).tolist()
