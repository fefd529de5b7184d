"""Word shingles of whole texts as sorted 64-bit hashes, by array arithmetic over the bytes of a text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Byte table: A-Z to lower case, the white space characters 0x20 and 0x09-0x0D to 0x20.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
_RNG = np.random.default_rng(20240101)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
#: An odd factor for each place in a shingle; further places draw theirs from the same sequence.
_WORD = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def _factor(place: int) -> np.uint64:
    while len(_WORD) <= place:
        drawn = hashlib.blake2b(str(len(_WORD)).encode(), digest_size=8, key=b"place").digest()
        _WORD.append(np.uint64(int.from_bytes(drawn, "little") | 1))
    return _WORD[place]


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
RUN_BYTES = 1 << 20
#: Words up to this length are hashed by a key of their own for each place, longer ones by BLAKE2b.
SHORT_WORD = 64
_KEY = _RNG.integers(1, 1 << 63, SHORT_WORD, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, r in enumerate((_R, _R_INV)):
            steps = np.full(size, r, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a run of UTF-8 bytes, and the places where they start.

    Sums of byte values times keys drawn for each place: two words collide with a chance of about 2 ** -64, whatever
    their structure. (Powers of one number as keys would have strings that collide for every such number.)
    """
    folded = _FOLD[data]
    space = folded == 32
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    sizes = ends - starts
    inside = np.flatnonzero(~space)
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(len(inside)) - np.repeat(firsts, sizes)
    terms = _BYTE[folded[inside]] * _KEY[np.minimum(place, SHORT_WORD - 1)]
    out = mix(np.add.reduceat(terms, firsts) + sizes.astype(np.uint64))
    for i in np.flatnonzero(sizes > SHORT_WORD).tolist():
        digest = hashlib.blake2b(folded[starts[i] : ends[i]].tobytes(), digest_size=8, key=b"word").digest()
        out[i] = int.from_bytes(digest, "little")
    return out, starts


def _cuts(data: bytes) -> Iterator[bytes]:
    """Runs of a long text, cut at white space."""
    at = 0
    while len(data) - at > RUN_BYTES:
        end = at + RUN_BYTES
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of `size` words; of fewer words, of the whole sequence; of none, nothing."""
    n = len(words)
    if n == 0:
        return words
    k = min(n, size)
    out = words[: n - k + 1] * _factor(0)
    for j in range(1, k):
        out = out + words[j : n - k + 1 + j] * _factor(j)
    return mix(out + np.uint64(k))


def shingle_sets(texts: list[bytes | None], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text. Short texts share one pass over their joined bytes."""
    at = 0
    while at < len(texts):
        run, total = [], 0
        while at < len(texts) and (not run or total + len(texts[at] or b"") <= RUN_BYTES):
            run.append(texts[at] or b"")
            total += len(run[-1]) + 1
            at += 1
        if len(run) == 1:
            words = np.concatenate([word_hashes(np.frombuffer(c, np.uint8))[0] for c in _cuts(run[0])])
            yield np.unique(shingle_hashes(words, size))
            continue
        words, starts = word_hashes(np.frombuffer(b" ".join(run), np.uint8))
        ends = np.cumsum([len(x) + 1 for x in run])
        edges = np.searchsorted(starts, [0, *ends])
        for a, b in zip(edges, edges[1:], strict=False):
            s = shingle_hashes(words[a:b], size)
            s.sort()
            yield s[np.diff(s, prepend=s[:1] - np.uint64(1)) != 0] if len(s) else s
