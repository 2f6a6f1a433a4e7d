"""Word hashes of many texts at once.

A word of up to eight bytes is hashed by a bijection of its bytes, so that two such words of one length never have one hash; a longer one has the first 64 bits of
its BLAKE2b digest, of which those seen before are kept in a cache of bounded size. So no shape of words makes two of them equal. Words are maximal runs of bytes other than blank
and control-white-space (9 to 13); UTF-8 has these bytes for these characters only.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

_PIECE = 1 << 20
#: The cache starts anew beyond so many words; words longer than the second are not kept.
CACHED_WORDS, CACHED_LENGTH = 1 << 17, 64

_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Digests(dict):
    def __missing__(self, word: bytes) -> int:
        digest = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= CACHED_LENGTH:
            self[word] = digest
        return digest


_DIGESTS = _Digests()


def _hash_piece(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words in `raw`, which ends with a space."""
    blank = SPACES[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[::2], edge[1::2]
    size = end - start
    # the eight bytes from each word's start, without what stands behind the word
    eight = np.lib.stride_tricks.as_strided(np.frombuffer(raw + bytes(8), np.uint8), (len(raw), 8), (1, 1))
    block = np.ascontiguousarray(eight[start]).view("<u8")[:, 0] & _MASKS[np.minimum(size, 8)]
    out = mix(block + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    long = np.flatnonzero(size > 8)
    if len(long):
        if len(_DIGESTS) > CACHED_WORDS:
            _DIGESTS.clear()
        words = (raw[a:b] for a, b in zip(start[long].tolist(), end[long].tolist()))
        out[long] = np.fromiter(map(_DIGESTS.__getitem__, words), np.uint64, len(long))
    return out, start


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes, and the offsets of each text's words among them (one more than texts)."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        held, size, first = [], 0, at
        while at < len(texts) and (not held or size + len(texts[at]) < _PIECE):
            held.append(texts[at])
            size += len(texts[at]) + 1
            at += 1
        if size > 2 * _PIECE:
            for piece in _cut(held[0]):
                h, _ = _hash_piece(piece + b" ")
                hashes.append(h)
                counts[first] += len(h)
            continue
        h, start = _hash_piece(b" ".join(held) + b" ")
        upto = np.searchsorted(start, np.cumsum([len(t) + 1 for t in held]))
        counts[first:at] = np.diff(upto, prepend=0)
        hashes.append(h)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(counts)))


def _cut(text: bytes) -> Iterator[bytes]:
    """Pieces of a very long text, cut between words."""
    data, at = np.frombuffer(text, np.uint8), 0
    while at < len(data):
        end = min(at + _PIECE, len(data))
        if end < len(data):
            blanks = np.flatnonzero(SPACES[data[at:end]])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
            else:
                rest = (np.flatnonzero(SPACES[data[k : k + _PIECE]]) + k for k in range(end, len(data), _PIECE))
                end = next((int(x[0]) + 1 for x in rest if len(x)), len(data))
        yield text[at:end]
        at = end


def runs(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A hash of each `n` consecutive words (one fewer for each word that lacks followers), mixed after each word."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(size, np.uint64(salt), np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0xFF51AFD7ED558CCD) + hashes[i : i + size])
    return out
