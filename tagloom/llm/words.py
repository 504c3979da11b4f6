"""Words and five-word shingles of whole texts as 64-bit hashes (numpy, used inside Arrow functions).

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]`` after A-Z are lowered, so no other letter changes. A text with
fewer words than a shingle gives one shingle, its whole sequence; a text without words gives none.
"""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
_SPAN = 64
_PIECE = 1 << 20
_RANDOM = np.random.default_rng(641)
#: Odd multipliers, one for each place in a shingle.
_PLACES = _RANDOM.integers(1 << 63, size=SHINGLE * 8, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: A random number for each byte at each place in a word; none for blanks, the same for A-Z and a-z.
_BYTES = _RANDOM.integers(1 << 64, size=(_SPAN, 256), dtype=np.uint64, endpoint=False)
_BYTES[:, 65:91] = _BYTES[:, 97:123]
_BYTES[:, _BLANK] = 0
_BYTES = _BYTES.ravel()


def words_of(text: str | None) -> list[bytes]:
    """``bytes.split`` and ``bytes.lower`` know exactly the six ASCII blanks and A-Z."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _piece_hashes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    inside = ~_BLANK[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    own, first = raw[starts[0] :], starts - starts[0]
    place = np.arange(len(own)) - np.repeat(first, np.diff(first, append=len(own)))
    sums = np.add.reduceat(_BYTES[(place & (_SPAN - 1)) << 8 | own], first)
    for i in np.flatnonzero(ends - starts > _SPAN):
        sums[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].lower())
    return mixed(sums)


def word_hashes(text: str | None) -> np.ndarray:
    """The words' hashes in order (uint64): of each word the sum of its bytes' numbers, of one over 64 bytes xxHash."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    if len(data) <= _PIECE:
        return _piece_hashes(data)
    out, at = [], 0
    while at < len(data):  # pieces end at a blank, so that a very long text takes little memory
        end = at + _PIECE
        while end < len(data) and not _BLANK[data[end]]:
            end += 1
        out.append(_piece_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes, ascending (uint64)."""
    h = word_hashes(text)
    n = len(h)
    if not n:
        return h
    width = min(n, size)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total += h[i : n - width + 1 + i] * _PLACES[i]
    total = mixed(total)
    total.sort()
    return total[np.append(True, total[1:] != total[:-1])]
