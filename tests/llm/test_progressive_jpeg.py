import hashlib
import struct
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lamella.llm import progressive_jpeg as pj
from lamella.llm.common import table


@settings(max_examples=25, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip_both_readers(raw):
    payload = pj.pad_payload(raw)
    assert len(payload) % 576 == 0 and payload.startswith(raw) and set(payload[len(raw) :]) <= {255}
    media = pj.encode_payload(payload)
    fast, slow = pj.decode(media), pj.decode(media, fast=False)
    for a, b in zip(fast.components, slow.components):
        assert (a.coefficients == b.coefficients).all()
    assert pj.read_payload(fast) == payload


def test_zigzag_and_transform():
    assert pj.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(pj.ZIGZAG) == list(range(64))
    assert np.allclose(pj.BASIS @ pj.BASIS.T, np.eye(64), atol=1e-5)


class Writer:
    """A plain progressive encoder for tests: fixed eight-bit codes, one bit string a scan."""

    def __init__(self):
        self.bits, self.symbols = [], list(range(255))

    def put(self, value, n):
        self.bits += [(value >> i) & 1 for i in range(n - 1, -1, -1)]

    def symbol(self, s):
        self.put(self.symbols.index(s), 8)

    def value(self, v):
        n = abs(v).bit_length()
        self.put(v if v >= 0 else v + (1 << n) - 1, n)

    def data(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def write(components, width, height, sampling):
    out = [b"\xff\xd8", pj._segment(0xDB, bytes([0, *[1] * 64]))]
    out.append(pj._segment(0xC2, struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))))
    w = Writer()
    for kind in (0, 1):
        out.append(pj._segment(0xC4, bytes([kind << 4, *[0] * 7, 255, *[0] * 8]) + bytes(w.symbols)))
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    order = [
        (i, (my * v + y) * across * h + mx * h + x) for my in range(down) for mx in range(across) for i, (h, v) in enumerate(sampling) for y in range(v) for x in range(h)
    ]
    header = bytes([3, 1, 0, 2, 0, 3, 0])
    last = [0, 0, 0]
    for i, place in order:
        dc = int(components[i][place, 0]) >> 1
        w.symbol(abs(dc - last[i]).bit_length())
        w.value(dc - last[i])
        last[i] = dc
    out.append(pj._segment(0xDA, header + bytes([0, 0, 1])) + w.data())
    w = Writer()
    for i, place in order:
        w.put(int(components[i][place, 0]) & 1, 1)
    out.append(pj._segment(0xDA, header + bytes([0, 0, 0x10])) + w.data())
    for i, blocks in enumerate(components):
        w, run = Writer(), 0

        def flush():
            nonlocal run
            if run:
                n = run.bit_length() - 1
                w.symbol(n << 4)
                w.put(run - (1 << n), n)
                run = 0

        for b in blocks:
            zeros = 0
            for k in range(1, 64):
                v = int(np.sign(b[k])) * (abs(int(b[k])) >> 1)
                if not v:
                    zeros += 1
                    continue
                flush()
                while zeros > 15:
                    w.symbol(0xF0)
                    zeros -= 16
                w.symbol(zeros << 4 | abs(v).bit_length())
                w.value(v)
                zeros = 0
            if zeros:
                run += 1
        flush()
        out.append(pj._segment(0xDA, bytes([1, i + 1, 0, 1, 63, 1])) + w.data())
        w = Writer()
        for b in blocks:
            zeros, held = 0, []
            last_new = max([k for k in range(1, 64) if abs(int(b[k])) == 1], default=0)
            for k in range(1, 64):
                m = abs(int(b[k]))
                if not m:
                    zeros += 1
                    continue
                while zeros > 15 and k <= last_new:
                    w.symbol(0xF0)
                    w.bits += held
                    held, zeros = [], zeros - 16
                if m > 1:
                    held.append(m & 1)
                    continue
                w.symbol(zeros << 4 | 1)
                w.put(int(b[k] > 0), 1)
                w.bits += held
                held, zeros = [], 0
            if zeros or held:
                w.symbol(0)
                w.bits += held
        out.append(pj._segment(0xDA, bytes([1, i + 1, 0, 1, 63, 0x10])) + w.data())
    return b"".join(out) + b"\xff\xd9"


def test_general_files():
    rng = np.random.default_rng(3)
    for width, height, sampling in ((32, 32, [(2, 2), (1, 1), (1, 1)]), (16, 8, [(1, 1)] * 3), (32, 16, [(2, 1), (1, 1), (1, 1)])):
        hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
        mcus = width // (8 * hmax) * (height // (8 * vmax))
        parts = []
        for h, v in sampling:
            c = rng.integers(-40, 40, (mcus * h * v, 64))
            c[rng.random(c.shape) < 0.8] = 0
            c[rng.random(c.shape) < 0.05] = 1
            c[1::3, 5:] = 0
            parts.append(c)
        image = pj.decode(write(parts, width, height, sampling))
        for c, want in zip(image.components, parts):
            assert (c.coefficients == want).all()
        assert pj.to_rgb(image).shape == (height, width, 3)


def test_flat_image():
    image = pj.decode(pj.encode_payload(pj.pad_payload(b"")))
    for c in image.components:
        c.coefficients[:] = 0
    assert (pj.to_rgb(image) == 128).all()


def test_query(spark, sf):
    texts = {r.doc_id: r.text.encode() for r in table(spark, sf, "documents").collect()}
    rows = pj.op3_progressive_jpeg(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        p = pj.pad_payload(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r.media_bytes > len(p)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 576), (4, "é" * 40000), (4, "é" * 40000)], "doc_id long, text string").selectExpr("*", "1 AS jpeg")
    out = {r.doc_id: r for r in pj.media_columns(docs, tensors=True).collect()}
    for i, text in ((1, ""), (2, ""), (3, "x" * 576), (4, "é" * 40000)):
        image = pj.decode(bytes(out[i].jpeg))
        assert pj.read_payload(image) == pj.pad_payload(text.encode())
        assert len(out[i].rgb) == out[i].rgb_height * out[i].rgb_width * 3
    assert pj.media_columns(docs.limit(0)).count() == 0
