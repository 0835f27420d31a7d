"""Word n-grams of many texts in NumPy: xxhash64 keys and an open-addressed
table that gives every distinct n-gram one slot.

A slot is found by linear probing and only taken for equal if length and bytes
agree, so equal hashes never merge different n-grams. All probes of a chunk
run together, one array step per probe distance.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

#: ASCII letters lower-cased, digits and bytes from 0x80 kept, the rest blank.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
CHUNK_WORDS = 1 << 16
#: Longer n-grams are not interned: each occurrence is looked at by itself.
LONG = 128
# fixed values: the xxhash64 primes
P1, P2, P3, P4, P5 = (
    np.uint64(x)
    for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class Chunk:
    """Words of consecutive documents, and the n-grams that start in them."""

    def __init__(self, pieces: list[tuple[int, list[bytes], int]], longest: int):
        """pieces: (document, words, number of words whose n-grams count)."""
        words = [w for _, ws, _ in pieces for w in ws]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.text = b" ".join(words)
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        piece = np.repeat(np.arange(len(pieces)), [len(ws) for _, ws, _ in pieces])
        counted = np.concatenate([np.empty(0, bool), *[np.arange(len(ws)) < own for _, ws, own in pieces]])
        doc = np.array([d for d, _, _ in pieces], np.int64)
        start, end, owner = [], [], []
        for n in range(1, longest + 1):
            last = max(0, len(words) - n + 1)
            at = np.flatnonzero((piece[:last] == piece[n - 1 :]) & counted[:last])
            start.append(starts[at])
            end.append(ends[at + n - 1])
            owner.append(doc[piece[at]])
        self.start, self.doc = np.concatenate(start), np.concatenate(owner)
        self.length = np.concatenate(end) - self.start
        # the eight bytes from every byte on, as one number
        padded = self.text + bytes(16)
        self.loads = np.ascontiguousarray(np.ndarray((len(self.text) + 9,), "<u8", padded, strides=(1,)))

    def keep(self, at: np.ndarray) -> None:
        self.start, self.doc, self.length = self.start[at], self.doc[at], self.length[at]

    def gram(self, i: int) -> bytes:
        return self.text[self.start[i] : self.start[i] + self.length[i]]

    def word64(self, at: np.ndarray, i: int) -> np.ndarray:
        """Bytes 8i to 8i+7 of the n-grams `at`, zero beyond their ends."""
        rest = self.length[at] - 8 * i
        cut = (np.maximum(8 - rest, 0) * 8).astype(np.uint64)
        return (self.loads[self.start[at] + 8 * i] << cut) >> cut


def chunks(texts: Iterable[tuple[int, str | None]], longest: int, n_words: np.ndarray | None = None) -> Iterator[Chunk]:
    """Chunks of about CHUNK_WORDS words; a long text goes on in the next.
    `n_words` takes the number of words of each document."""
    pieces: list[tuple[int, list[bytes], int]] = []
    held = 0
    for doc, text in texts:
        words = words_of(text)
        if n_words is not None:
            n_words[doc] = len(words)
        for at in range(0, len(words), CHUNK_WORDS):
            own = min(CHUNK_WORDS, len(words) - at)
            pieces.append((doc, words[at : at + own + longest - 1], own))
            held += own
            if held >= CHUNK_WORDS:
                yield Chunk(pieces, longest)
                pieces, held = [], 0
    if pieces:
        yield Chunk(pieces, longest)


def by_length(length: np.ndarray) -> np.ndarray:
    """Stable order by length (a radix sort where the lengths are short)."""
    short = length.astype(np.uint16) if length.max(initial=0) < 1 << 16 else length
    return np.argsort(short, kind="stable")


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def crc32(chunk: Chunk, grams: np.ndarray) -> np.ndarray:
    """crc32 of the n-grams `grams`, one array step per byte."""
    order = by_length(chunk.length[grams])
    length, start = chunk.length[grams][order], chunk.start[grams][order]
    text = np.frombuffer(chunk.text, np.uint8)
    crc = np.full(len(grams), 0xFFFFFFFF, np.uint32)
    for i in range(int(length[-1]) if len(length) else 0):
        more = int(np.searchsorted(length, i, side="right"))
        c = crc[more:]
        crc[more:] = CRC[(c ^ text[start[more:] + i]) & np.uint32(255)] ^ (c >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = ~crc
    return out


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(chunk: Chunk) -> np.ndarray:
    """xxhash64 (seed 0) of all n-grams: those under 32 bytes as arrays."""
    n = len(chunk.start)
    order = by_length(chunk.length)
    length = chunk.length[order]
    short = int(np.searchsorted(length, 32))
    size, at = length[:short], chunk.start[order[:short]].copy()
    h = size.astype(np.uint64) + P5
    for done in (8, 16, 24):
        low = int(np.searchsorted(size, done))
        x = h[low:] ^ (_rotl(chunk.loads[at[low:]] * P2, 31) * P1)
        h[low:] = _rotl(x, 27) * P1 + P4
        at[low:] += 8
    some = np.flatnonzero(size & 4)
    x = h[some] ^ ((chunk.loads[at[some]] & np.uint64(0xFFFFFFFF)) * P1)
    h[some] = _rotl(x, 23) * P2 + P3
    at[some] += 4
    for k in range(3):
        some = np.flatnonzero((size & 3) > k)
        x = h[some] ^ ((chunk.loads[at[some] + k] & np.uint64(255)) * P5)
        h[some] = _rotl(x, 11) * P1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    out = np.empty(n, np.uint64)
    out[order[:short]] = h
    out[order[short:]] = [xxhash.xxh64_intdigest(chunk.gram(i)) for i in order[short:].tolist()]
    return out


class GramTable:
    """Slots with key, length, bytes, bucket and count; emptied when half full."""

    def __init__(self, buckets: int, bits: int = 20):
        self.buckets = buckets
        self.totals = np.zeros(buckets, np.int64)
        self._allocate(bits)

    def _allocate(self, bits: int) -> None:
        self.size = 1 << bits
        self.key = np.zeros(self.size, np.uint64)
        # 32 bits hold them all, and more of the table stays in the cache
        self.length = np.zeros(self.size, np.int32)  # 0: free
        self.at = np.zeros(self.size, np.int32)
        self.bucket = np.zeros(self.size, np.int32)
        self.count = np.zeros(self.size, np.int64)
        self.claim = np.zeros(self.size, np.int32)
        self.bytes = np.zeros(self.size, np.uint64)
        self.used = self.filled = 0

    def flush(self) -> np.ndarray:
        """Counts per bucket of everything counted so far; empties the table."""
        taken = np.flatnonzero(self.length)
        np.add.at(self.totals, self.bucket[taken], self.count[taken])
        self.length[taken] = 0
        self.count[taken] = 0
        self.used = self.filled = 0
        return self.totals

    def _equal(self, chunk: Chunk, grams: np.ndarray, slots: np.ndarray) -> np.ndarray:
        same = chunk.length[grams] == self.length[slots]
        i = 0
        rest = np.flatnonzero(same)
        while len(rest):
            ok = chunk.word64(grams[rest], i) == self.bytes[self.at[slots[rest]] + i]
            same[rest[~ok]] = False
            i += 1
            rest = rest[ok & (chunk.length[grams[rest]] > 8 * i)]
        return same

    def _insert(self, chunk: Chunk, grams: np.ndarray, slots: np.ndarray, keys: np.ndarray) -> None:
        words = (chunk.length[grams] + 7) // 8
        at = self.filled + np.cumsum(words) - words
        self.filled += int(words.sum())
        if self.filled > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros(max(len(self.bytes), self.filled), np.uint64)])
        self.key[slots], self.length[slots], self.at[slots] = keys, chunk.length[grams], at
        for i in range(int(words.max(initial=0))):
            more = np.flatnonzero(words > i)
            self.bytes[at[more] + i] = chunk.word64(grams[more], i)
        self.bucket[slots] = crc32(chunk, grams) % np.uint32(self.buckets)
        self.used += len(grams)

    def slots(self, chunk: Chunk) -> np.ndarray:
        """The slot of every n-gram occurrence of the chunk."""
        n = len(chunk.start)
        if 2 * (self.used + n) > self.size:
            self.flush()
        if 2 * n > self.size:
            self._allocate((2 * n).bit_length())
        keys = xxh64(chunk)
        slot = (keys & np.uint64(self.size - 1)).astype(np.int64)
        open_ = np.arange(n)
        while len(open_):
            s = slot[open_]
            settled = np.zeros(len(open_), bool)
            free = np.flatnonzero(self.length[s] == 0)
            if len(free):
                self.claim[s[free]] = open_[free]
                won = free[self.claim[s[free]] == open_[free]]
                self._insert(chunk, open_[won], s[won], keys[open_[won]])
                settled[won] = True  # their own bytes were just stored
            maybe = np.flatnonzero((self.key[s] == keys[open_]) & ~settled)
            settled[maybe] = self._equal(chunk, open_[maybe], s[maybe])
            open_ = open_[~settled]
            slot[open_] = (slot[open_] + 1) & (self.size - 1)
        return slot


def bucket_batches(
    texts: Iterable[tuple[int, str | None]], table: GramTable, longest: int, n_words: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, slot, bucket) of all n-gram occurrences, chunk by chunk;
    slot is -1 for n-grams of more than LONG bytes."""
    for chunk in chunks(texts, longest, n_words):
        long_ = np.flatnonzero(chunk.length > LONG)
        if len(long_):
            found = np.array([zlib.crc32(chunk.gram(i)) % table.buckets for i in long_.tolist()], np.int32)
            yield chunk.doc[long_], np.full(len(long_), -1), found
            chunk.keep(np.flatnonzero(chunk.length <= LONG))
        slots = table.slots(chunk)
        yield chunk.doc, slots, table.bucket[slots]
