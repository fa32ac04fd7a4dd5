"""Word hashes, k-gram hashes and minimiser positions of texts, with numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)
#: Bytes of a text that are hashed at once; a longer word is still one word.
CHUNK = 1 << 20
#: Bytes of a word that are hashed in blocks of eight; a longer one goes to xxhash.
LONG = 256
#: Bytes of short texts that are hashed in one go.
TOGETHER = 1 << 17
_IS_SPACE = bytes(b == 0x20 or 0x09 <= b <= 0x0D for b in range(256))
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space, A-Z lower-cased."""
    if not text:
        return np.zeros(0, np.uint64)
    low, out, at = text.lower(), [], 0
    while len(low) - at > CHUNK:
        end = _next_space(low, at + CHUNK)
        out.append(_hashed(low[at:end])[0])
        at = end
    out.append(_hashed(low[at:] if at else low)[0])
    return np.concatenate(out) if len(out) > 1 else out[0]


def word_hashes_of(texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
    """word_hashes of each text; short ones are hashed together."""
    held, size = [], 0
    for text in texts:
        if text and len(text) > TOGETHER:
            yield from _together(held)
            yield word_hashes(text)
            held, size = [], 0
            continue
        held.append(text or b"")
        size += len(held[-1])
        if size > TOGETHER:
            yield from _together(held)
            held, size = [], 0
    yield from _together(held)


def _together(texts: list[bytes]) -> Iterator[np.ndarray]:
    if texts:
        h, starts = _hashed(b"\n".join(texts).lower())
        ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])).tolist()
        for i, j in zip([0, *ends], ends):
            yield h[i:j]


def _next_space(low: bytes, at: int) -> int:
    """The first place from ``at`` on with white space, else the end."""
    while at < len(low):
        found = np.flatnonzero(np.frombuffer(low[at : at + CHUNK].translate(_IS_SPACE), bool))
        if len(found):
            return at + int(found[0])
        at += CHUNK
    return len(low)


def _hashed(low: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words."""
    space = np.frombuffer(b"\x01" + low.translate(_IS_SPACE) + b"\x01", bool)
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, sizes = edges[::2], np.diff(edges)[::2]
    # Eight bytes from every place on; bytes behind the word are masked.
    eights = np.ndarray(len(low), "<u8", low + bytes(8), 0, (1,))
    h = mix((eights[starts] & _LOW_BYTES[np.minimum(sizes, 8)]) ^ sizes.astype(np.uint64) * np.uint64(_P))
    left = np.flatnonzero(sizes > 8)
    if len(left):
        for i in left[sizes[left] > LONG].tolist():
            h[i] = xxhash.xxh3_64_intdigest(low[starts[i] : starts[i] + sizes[i]])
        done = 8
        left = left[sizes[left] <= LONG]
        while len(left):
            h[left] = mix(h[left] ^ (eights[starts[left] + done] & _LOW_BYTES[np.minimum(sizes[left] - done, 8)]))
            done += 8
            left = left[sizes[left] > done]
    return h, starts


_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS))
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _P, np.uint64)]))
            _INVERSES = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _INVERSE, np.uint64)]))
    return _POWERS[:n], _INVERSES[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads low differences over all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, in time independent of k."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers, inverses = _powers(len(words))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers, dtype=np.uint64)])
    return mix((sums[k:] - sums[:n]) * inverses[:n])


def least_positions(grams: np.ndarray, window: int) -> np.ndarray:
    """For each ``window`` grams in a row the position of the least hash, leftmost on ties."""
    n = len(grams)
    if n < window:
        return np.zeros(0, np.int64)
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    fill = -n % window
    blocks = np.concatenate([key, np.full(fill, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, window)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(backward[: n - window + 1], forward[window - 1 : n])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions that are the least hash, leftmost on ties, of some ``window`` grams in a row."""
    places = least_positions(grams, window)
    return places[np.concatenate([[True], places[1:] != places[:-1]])] if len(places) else places


def occurrence(keys: np.ndarray) -> np.ndarray:
    """How many equal keys stand before each key."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    first = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])[: len(keys)]
    starts = np.flatnonzero(first)
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))
    return out
