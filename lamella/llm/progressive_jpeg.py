"""Progressive JPEG media columns: coefficient arrays from scans, numpy inverse transform, full-resolution RGB.

Reading. ``decode`` walks the markers of a progressive (SOF2) file, and adds
each scan, by spectral selection and successive approximation, to one integer
coefficient array a component. ``to_rgb`` dequantises, inverse-transforms all
blocks by one matrix product, repeats chroma samples to full resolution and
converts to an (height, width, 3) uint8 tensor. A scan whose Huffman table has
a single one-bit code has a fixed stride and is read as a whole by numpy; all
other scans go through the general bit reader. Both give the same arrays.

Writing. ``encode_payload`` stores bytes without loss as quantised
coefficients of a 4:2:0 image: byte v is the coefficient v if v >= 128, else
v - 255, the 256 values whose magnitude takes eight bits and whose extra bits
are v itself. A component's DC coefficients come in a scan of their own, AC 1-5
in one scan, AC 6-63 in two by successive approximation. A comment segment
names the payload's length, as whole MCUs are filled up with bytes 255.

Defined results: null text is the empty text, whose payload is 576 bytes 255;
equal texts give equal values; repeated rows give a row each; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.llm.common import add_columns, table, texts_of

UNIT = 576
MCU_BYTES = 384
PAD = 255


def _zigzag() -> np.ndarray:
    """Row-major place of the k-th coefficient: diagonals, by turns upwards and downwards."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


ZIGZAG = _zigzag()


def _basis() -> np.ndarray:
    """(64, 64): row k is the 8x8 sample block of the k-th zigzag coefficient."""
    u = np.arange(8)
    one = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, math.sqrt(1 / 8), 0.5)[None, :]
    full = np.einsum("yv,xu->vuyx", one, one).reshape(64, 64)
    return full[ZIGZAG].astype(np.float32)


BASIS = _basis()
_V = np.arange(256)
_COEFFICIENT = np.where(_V >= 128, _V, _V - 255).astype(np.int16)
_MAGNITUDE = np.abs(_COEFFICIENT)
#: First pass of AC 6-63: a zero code bit and seven extra bits of the halved magnitude, complemented if negative.
_HALF = np.where(_V >= 128, _MAGNITUDE >> 1, 127 - (_MAGNITUDE >> 1)).astype(np.uint8)
_LOW = (_MAGNITUDE & 1).astype(np.uint8)


# ---------------------------------------------------------------- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_code_table(kind: int, symbol: int) -> bytes:
    """A Huffman table whose only code is the bit 0."""
    return _segment(0xC4, bytes([kind << 4, 1, *[0] * 15, symbol]))


def _scan(component: int, low: int, high: int, ah: int, al: int, data: bytes) -> bytes:
    return _segment(0xDA, bytes([1, component, 0, low, high, ah << 4 | al])) + data


def _bits(bits: np.ndarray) -> bytes:
    fill = -bits.size % 8
    flat = np.concatenate([bits.ravel(), np.ones(fill, np.uint8)]) if fill else bits.ravel()
    return np.packbits(flat).tobytes().replace(b"\xff", b"\xff\x00")


def _dc_scan(v: np.ndarray) -> bytes:
    """Each block by itself: a restart marker behind every block but the last."""
    n = len(v)
    rows = np.empty((n, 5), np.uint8)
    rows[:, 0] = v >> 1
    rows[:, 1] = np.where(v & 1, 0xFF, 0x7F)
    rows[:, 2] = 0
    rows[:, 3] = 0xFF
    rows[:, 4] = 0xD0 + (np.arange(n) & 7)
    use = np.ones((n, 5), bool)
    use[:, 2] = v & 1
    use[-1, 3:] = False
    return rows[use].tobytes()


def grid(payload_bytes: int) -> tuple[int, int]:
    """MCU columns and rows of the image for a payload."""
    count = -(-payload_bytes // MCU_BYTES)
    cols = math.isqrt(count - 1) + 1
    return cols, -(-count // cols)


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG file that holds the payload in its coefficients."""
    cols, rows = grid(len(payload))
    cells = np.full(cols * rows * MCU_BYTES, PAD, np.uint8)
    cells[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = cells.reshape(-1, 64)
    n = cols * rows
    parts = [blocks[: 4 * n], blocks[4 * n : 5 * n], blocks[5 * n :]]
    out = [b"\xff\xd8", _segment(0xFE, b"payload=%d" % len(payload)), _segment(0xDB, bytes([0, *[1] * 64]))]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * rows, 16 * cols, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out += [_segment(0xDD, struct.pack(">H", 1)), _one_code_table(0, 8)]
    out += [_scan(c, 0, 0, 0, 0, _dc_scan(p[:, 0])) for c, p in enumerate(parts, 1)]
    out += [_segment(0xDD, struct.pack(">H", 0)), _one_code_table(1, 0x08)]
    for c, p in enumerate(parts, 1):
        bits = np.zeros((len(p), 5, 9), np.uint8)
        bits[:, :, 1:] = np.unpackbits(np.ascontiguousarray(p[:, 1:6])[:, :, None], axis=2)
        out.append(_scan(c, 1, 5, 0, 0, _bits(bits)))
    out.append(_one_code_table(1, 0x07))
    out += [_scan(c, 6, 63, 0, 1, _HALF[p[:, 6:]].tobytes()) for c, p in enumerate(parts, 1)]
    out.append(_one_code_table(1, 0x00))
    for c, p in enumerate(parts, 1):
        bits = np.zeros((len(p), 59), np.uint8)
        bits[:, 1:] = _LOW[p[:, 6:]]
        out.append(_scan(c, 6, 63, 1, 0, _bits(bits)))
    out.append(b"\xff\xd9")
    return b"".join(out)


# ---------------------------------------------------------------- reading


class Component:
    def __init__(self, ident: int, h: int, v: int, quant: int):
        self.ident, self.h, self.v, self.quant = ident, h, v, quant
        self.table = np.ones(64, np.int32)

    def allocate(self, width: int, height: int, hmax: int, vmax: int) -> None:
        self.wide = -(-(-(-width * self.h // hmax)) // 8)
        self.tall = -(-(-(-height * self.v // vmax)) // 8)
        self.stride = -(-width // (8 * hmax)) * self.h
        lines = -(-height // (8 * vmax)) * self.v
        self.coefficients = np.zeros((lines * self.stride, 64), np.int32)


class Image:
    """A decoded file: size, components with coefficient arrays, comments."""

    def __init__(self):
        self.width = self.height = 0
        self.components: list[Component] = []
        self.comments: list[bytes] = []


class Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.codes, code, at = {}, 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[length, code] = symbols[at]
                code += 1
                at += 1
            code <<= 1
        self.single = symbols[0] if len(symbols) == 1 and counts[0] == 1 else None


_NEXT_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def decode(data: bytes, fast: bool = True) -> Image:
    """Coefficient arrays of a progressive file; ``fast`` False forces the general reader."""
    image, quant, tables, restart, at = Image(), {}, {}, 0, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    while at < len(data):
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            image.comments.append(body)
        elif marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                quant[body[i] & 15] = np.frombuffer(body[i + 1 : i + 1 + 64 * (1 + wide)], ">u2" if wide else "u1").astype(np.int32)
                i += 1 + 64 * (1 + wide)
        elif marker == 0xC2:
            _, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            image.components = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            hmax, vmax = max(c.h for c in image.components), max(c.v for c in image.components)
            for c in image.components:
                c.allocate(image.width, image.height, hmax, vmax)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError(f"not a progressive Huffman file: SOF marker {marker:#x}")
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                n = sum(body[i + 1 : i + 17])
                tables[body[i]] = Huffman(body[i + 1 : i + 17], body[i + 17 : i + 17 + n])
                i += 17 + n
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            end = _NEXT_MARKER.search(data, at)
            raw = data[at : end.start() if end else len(data)]
            at += len(raw)
            by_ident = {c.ident: c for c in image.components}
            chosen = [(by_ident[body[1 + 2 * k]], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            low, high, ah, al = body[-3], body[-2], body[-1] >> 4, body[-1] & 15
            if not (fast and len(chosen) == 1 and _read_fixed(chosen[0], tables, low, high, ah, al, restart, raw)):
                _read_general(image, chosen, tables, low, high, ah, al, restart, raw)
    for c in image.components:
        c.table = quant[c.quant]
    return image


def _extend(bits: np.ndarray, size: int) -> np.ndarray:
    return np.where(bits >> (size - 1) & 1, bits, bits - (1 << size) + 1)


def _read_fixed(chosen, tables, low, high, ah, al, restart, raw) -> bool:
    """A scan of one component whose table has one code of one bit; False if its layout is another."""
    c, dc, ac = chosen
    symbol = tables[dc if low == 0 else 16 | ac].single if (dc if low == 0 else 16 | ac) in tables else None
    if symbol is None or c.stride != c.wide:
        return False
    n = c.wide * c.tall
    target = c.coefficients[:n]
    if low == 0:
        if ah or restart != 1 or symbol != 8:
            return False
        pairs = np.frombuffer(_RESTART.sub(b"", raw).replace(b"\xff\x00", b"\xff"), np.uint8)
        if len(pairs) != 2 * n or (pairs[::2] & 0x80).any():
            return False
        v = (pairs[::2].astype(np.int32) << 1) | (pairs[1::2] >> 7)
        target[:, 0] = _extend(v, 8) << al
        return True
    if restart:
        return False
    width = high - low + 1
    data = np.frombuffer(raw.replace(b"\xff\x00", b"\xff"), np.uint8)
    if ah == 0:
        size = symbol & 15
        if symbol >> 4 or not 1 <= size <= 10 or len(data) != -(-n * width * (size + 1) // 8):
            return False
        if size == 7:
            codes = data.reshape(n, width)
            if (codes & 0x80).any():
                return False
            values = codes.astype(np.int32)
        else:
            bits = np.unpackbits(data)[: n * width * (size + 1)].reshape(n, width, size + 1)
            if bits[:, :, 0].any():
                return False
            values = bits[:, :, 1:] @ (1 << np.arange(size - 1, -1, -1))
        target[:, low : high + 1] = _extend(values, size) << al
        return True
    band = target[:, low : high + 1]
    if symbol or len(data) != -(-n * (width + 1) // 8) or not band.all():
        return False
    bits = np.unpackbits(data)[: n * (width + 1)].reshape(n, width + 1)
    if bits[:, 0].any():
        return False
    band += np.sign(band) * (bits[:, 1:].astype(np.int32) << al)
    return True


class _Bits:
    def __init__(self, raw: bytes):
        self.bits = np.unpackbits(np.frombuffer(raw.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
        self.at = 0

    def one(self) -> int:
        self.at += 1
        return self.bits[self.at - 1] if self.at <= len(self.bits) else 1

    def take(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.one()
        return out

    def symbol(self, table: Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.one()
            if (length, code) in table.codes:
                return table.codes[length, code]
        raise ValueError("no such Huffman code")

    def value(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _read_general(image, chosen, tables, low, high, ah, al, restart, raw) -> None:
    """Any scan, bit by bit: Huffman codes, zero runs, bands that end early, refinement, restarts."""
    if len(chosen) == 1:
        c, dc, ac = chosen[0]
        units = [[(c, dc, ac, y * c.stride + x)] for y in range(c.tall) for x in range(c.wide)]
    else:
        hmax, vmax = max(c.h for c in image.components), max(c.v for c in image.components)
        across, down = -(-image.width // (8 * hmax)), -(-image.height // (8 * vmax))
        units = [
            [(c, dc, ac, (my * c.v + v) * c.stride + mx * c.h + h) for c, dc, ac in chosen for v in range(c.v) for h in range(c.h)]
            for my in range(down)
            for mx in range(across)
        ]
    parts = _RESTART.split(raw) if restart else [raw]
    size = restart or len(units)
    for part, first in zip(parts, range(0, len(units), size)):
        bits, predicted, run = _Bits(part), {}, 0
        for unit in units[first : first + size]:
            for c, dc, ac, place in unit:
                block = c.coefficients[place]
                if low == 0:
                    if ah:
                        block[0] |= bits.one() << al
                    else:
                        predicted[c.ident] = predicted.get(c.ident, 0) + bits.value(bits.symbol(tables[dc]))
                        block[0] = predicted[c.ident] << al
                elif ah == 0:
                    run = _ac_first(bits, tables[16 | ac], block, low, high, al, run)
                else:
                    run = _ac_refine(bits, tables[16 | ac], block, low, high, al, run)


def _ac_first(bits: _Bits, table: Huffman, block, low, high, al, run) -> int:
    if run:
        return run - 1
    k = low
    while k <= high:
        symbol = bits.symbol(table)
        zeros, size = symbol >> 4, symbol & 15
        if size:
            k += zeros
            block[k] = bits.value(size) * (1 << al)
            k += 1
        elif zeros == 15:
            k += 16
        else:
            return (1 << zeros) + bits.take(zeros) - 1
    return 0


def _ac_refine(bits: _Bits, table: Huffman, block, low, high, al, run) -> int:
    def correct(k: int) -> None:
        if bits.one():
            block[k] += (1 << al) if block[k] > 0 else -(1 << al)

    k = low
    if not run:
        while k <= high:
            symbol = bits.symbol(table)
            zeros, size = symbol >> 4, symbol & 15
            new = 0
            if size:
                new = (1 << al) if bits.one() else -(1 << al)
            elif zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            while k <= high:
                if block[k]:
                    correct(k)
                elif zeros == 0:
                    if new:
                        block[k] = new
                    k += 1
                    break
                else:
                    zeros -= 1
                k += 1
    if run:
        for j in range(k, high + 1):
            if block[j]:
                correct(j)
        run -= 1
    return run


def read_payload(image: Image) -> bytes:
    """The bytes that ``encode_payload`` stored, from the coefficient arrays."""
    size = next(int(x.removeprefix(b"payload=")) for x in image.comments if x.startswith(b"payload="))
    flat = np.concatenate([c.coefficients.ravel() for c in image.components])[:size]
    return np.where(flat > 0, flat, flat + 255).astype(np.uint8).tobytes()


def to_rgb(image: Image) -> np.ndarray:
    """(height, width, 3) uint8 of a three-component image, or of a grey one."""
    hmax, vmax = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        samples = (c.coefficients * c.table).astype(np.float32) @ BASIS
        lines = len(c.coefficients) // c.stride
        plane = samples.reshape(lines, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(lines * 8, c.stride * 8)
        plane = np.clip(np.rint(plane + 128), 0, 255)
        if c.h < hmax:
            plane = plane.repeat(hmax // c.h, axis=1)
        if c.v < vmax:
            plane = plane.repeat(vmax // c.v, axis=0)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, axis=2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.empty((*y.shape, 3), np.float32)
    rgb[..., 0] = y + 1.402 * cr
    rgb[..., 1] = y - 0.344136 * cb - 0.714136 * cr
    rgb[..., 2] = y + 1.772 * cb
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def pad_payload(raw: bytes) -> bytes:
    return raw + bytes([PAD]) * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def feature(rgb: np.ndarray) -> str:
    """Size, and per channel mean and standard deviation in 1/16 steps."""
    flat = rgb.reshape(-1, 3)
    n, total, squares = len(flat), flat.sum(axis=0, dtype=np.int64), np.einsum("ij,ij->j", flat, flat, dtype=np.int64)
    mean = total / n
    spread = np.sqrt(np.maximum(squares / n - mean**2, 0))
    return f"{rgb.shape[1]}x{rgb.shape[0]};" + ",".join(f"{int(m * 16)}:{int(s * 16)}" for m, s in zip(mean, spread))


def media_columns(documents: DataFrame, text_col: str = "text", tensors: bool = False) -> DataFrame:
    """documents with ``jpeg`` and, on demand, ``rgb`` (raw tensor), ``rgb_height`` and ``rgb_width``."""
    fields = [T.StructField("jpeg", T.BinaryType())]
    if tensors:
        fields += [T.StructField("rgb", T.BinaryType()), T.StructField("rgb_height", T.IntegerType()), T.StructField("rgb_width", T.IntegerType())]

    def make():
        def one(text):
            media = encode_payload(pad_payload(text or b""))
            if not tensors:
                return (media,)
            rgb = to_rgb(decode(media))
            return media, rgb.tobytes(), rgb.shape[0], rgb.shape[1]

        return lambda texts: [one(t) for t in texts_of(texts)]

    return add_columns(documents, [text_col], T.StructType(fields), make)


DIGEST = T.StructType(
    [T.StructField(n, T.StringType() if n in ("payload_sha256", "media_sha256", "feature") else T.LongType()) for n in
     ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")]
)


def digest(text: bytes | None) -> tuple:
    raw = text or b""
    media = encode_payload(pad_payload(raw))
    image = decode(media)
    payload = read_payload(image)
    return (
        len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
        len(media), hashlib.sha256(media).hexdigest(), feature(to_rgb(image)),
    )


def op3_progressive_jpeg(spark, sf_dir: str) -> DataFrame:
    def make():
        return lambda texts: [digest(t) for t in texts_of(texts)]

    source = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    return add_columns(source, ["text"], DIGEST, make).drop("text")
