"""Word shingles as 64-bit hashes, vectorised over a portion of texts.

Words are the runs of bytes between ASCII white space, A-Z in lower case. A
word of up to 16 bytes is hashed as its length and two 64-bit numbers, mixed one
after another (up to 8 bytes, different words can't meet); a longer one by
BLAKE2b. A shingle's hash mixes those of its words. Two sets are compared by
these hashes: for two sets of a million shingles, the chance that any two
different ones meet is about 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np

WORDS = 5
PORTION_BYTES = 1_000_000
SHORT = 16
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_random = np.random.Generator(np.random.PCG64(20240607))
_PLACE = _random.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_START = np.uint64(0x9E3779B97F4A7C15)
#: By number of bytes: a mask of the first ones.
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of the words between ``starts`` and ``ends`` of the bytes ``joined``, after which come 16 bytes more."""
    sizes = ends - starts
    eights = np.lib.stride_tricks.as_strided(joined.view(np.uint8), (len(joined) - 7, 8), (1, 1))
    hashes = _mixed(sizes.astype(np.uint64) * _START)
    for at in (0, 8):
        some = np.flatnonzero(sizes > at) if at else slice(None)
        numbers = eights[starts[some] + at].view("<u8").ravel() & _KEPT[np.clip(sizes[some] - at, 0, 8)]
        hashes[some] = _mixed(hashes[some] ^ numbers)
    for k in np.flatnonzero(sizes > SHORT):
        hashes[k] = int.from_bytes(blake2b(joined[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return hashes


def _portion(raws: list[bytes]) -> Iterator[np.ndarray]:
    joined = np.frombuffer(b"\n".join(raws) + b"\n" * (1 + SHORT), np.uint8)
    space = _SPACE[joined]
    edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edges[0::2], edges[1::2]
    words = _word_hashes(joined, starts, ends)
    bounds = np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raws]))
    windows = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        windows += words[k : k + len(windows)] * _PLACE[k]
    windows = _mixed(windows).view(np.int64)
    for begin, end in zip(bounds[:-1], bounds[1:]):
        count = end - begin
        if count >= WORDS:
            yield np.unique(windows[begin : end - WORDS + 1])
        elif count:
            whole = (words[begin:end] * _PLACE[:count]).sum(dtype=np.uint64) + np.uint64(count)
            yield _mixed(np.array([whole], np.uint64)).view(np.int64)
        else:
            yield np.empty(0, np.int64)


def shingle_sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: all of its five-word windows; with fewer words, the whole sequence; without, none."""
    portion, size = [], 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass").lower() if text else b""
        portion.append(raw)
        size += len(raw)
        if size > PORTION_BYTES:
            yield from _portion(portion)
            portion, size = [], 0
    if portion:
        yield from _portion(portion)
