"""Byte-level BPE ids by a hierarchical-bitmap rank queue.

The pairs of a pre-token wait in buckets, one a merge rank, that hold positions of a linked
list. A bitmap of three levels over the ranks marks the buckets in use: find-first-set picks
the next rank in three steps whatever the length, and entries that a neighbouring merge has
made stale are skipped. Every merge costs constant time, so a pre-token of a million bytes is
no special case.

Texts are cut at each space before a non-space, which is always a pre-token boundary; the ids
of such a unit are kept in a bounded cache, since most units of a corpus occur again.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re

import regex

#: Where the vocabulary lies; a parameter of the operators, set by the environment here.
VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")

#: Fixed value: the public pattern that cuts text into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space that ``re`` knows but Unicode's property does not.
_CUT = re.compile("[ ](?=[^\\s]|[\x1c-\x1f])")
_ODD = re.compile("[ ](?:[\\s]|$)|[\x1c-\x1f]")

CACHE_ENTRIES, CACHE_LENGTH = 1 << 18, 64


class RankQueue:
    """Buckets of positions by rank under a bitmap of three levels of 64-bit words."""

    def __init__(self, ranks: int) -> None:
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank in use with its positions in order, or None."""
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        rank = b << 6 | (word & -word).bit_length() - 1
        self.low[b] &= self.low[b] - 1
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


class _Units(dict):
    """Ids (little-endian int32 in bytes) of the units seen; forgets all when full."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, unit: str) -> bytes:
        ids = self.encode(unit)
        if len(unit) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[unit] = ids
        return ids


class Encoder:
    def __init__(self, vocabulary: bytes) -> None:
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines()) if token}
        self.size = max(self.ranks.values()) + 1
        self.queue = RankQueue(self.size)  # empty again after every pre-token
        self.words = regex.compile(PATTERN)
        self.first = _Units(lambda unit: b"".join(map(self.pieces.__getitem__, self.words.findall(unit))))
        self.later = _Units(lambda unit: b"".join(map(self.pieces.__getitem__, self.words.findall(" " + unit))))
        self.pieces = _Units(lambda piece: b"".join(i.to_bytes(4, "little") for i in self.merged(piece.encode("utf-8", "replace"))))

    def merged(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        if n < 2:
            return [ranks[data]] if n else []
        end = list(range(1, n + 1))  # of the token that starts here
        before = list(range(-1, n - 1))
        wait = [-1] * n  # rank of the pair that starts here; -1: none
        queue = self.queue
        for i in range(n - 1):
            rank = ranks.get(data[i : i + 2])
            if rank is not None:
                wait[i] = rank
                queue.push(rank, i)
        while (found := queue.pop()) is not None:
            rank, bucket = found
            for i in bucket:
                if wait[i] != rank:  # stale
                    continue
                j = end[i]
                k = end[i] = end[j]
                wait[j] = wait[i] = -1
                if k < n:
                    before[k] = i
                    r = ranks.get(data[i : end[k]])
                    if r is not None:
                        wait[i] = r
                        queue.push(r, i)
                h = before[i]
                if h >= 0:
                    r = ranks.get(data[h:k])
                    wait[h] = -1 if r is None else r
                    if r is not None:
                        queue.push(r, h)
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian int32; null and empty texts have none."""
        if not text:
            return b""
        units = _CUT.split(text) if _ODD.search(text) else text.split(" ")
        return self.first[units[0]] + b"".join(map(self.later.__getitem__, units[1:]))


def vocabulary(path: str = VOCABULARY) -> bytes:
    """The vocabulary file, to be sent to the executors: they need no copy of their own."""
    try:
        with open(path, "rb") as file:
            return file.read()
    except OSError as missing:
        raise FileNotFoundError(f"no vocabulary at {path}: set TOKENIZER_FILE or give the path") from missing


_encoders: dict[bytes, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    """The encoder of a vocabulary, made once a process."""
    key = hashlib.md5(data).digest()
    if key not in _encoders:
        _encoders[key] = Encoder(data)
    return _encoders[key]


def decoder(data: bytes) -> list[bytes]:
    """The bytes of every id."""
    ranks = encoder(data).ranks
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out
