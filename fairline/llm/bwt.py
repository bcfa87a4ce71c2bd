"""Merging Burrows-Wheeler transforms of shards by iterative interleave refinement; runs inside tasks.

Texts are sequences of overlapping blocks: the suffix at byte p begins with the block of ``block`` bytes at p, followed by
the suffix at p + block. So a comparison of 200 bytes takes 4 steps of 50 bytes instead of 200. A shard's transform lists, in
the order of its sorted suffixes, the block before each suffix (none at a text's first bytes).

Shards are merged without comparing suffixes of different shards: an interleave says, for each place of the merged order,
which shard the suffix comes from. It starts as one shard after the other. A step deals it out by the merged transform's
blocks, stably, after which the order is right by one block more. Two neighbours that are parted in step j have j - 1 blocks
in common, so after enough steps what isn't parted are the intervals of suffixes that share that many bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from fairline.llm.words import U, mix


@dataclass
class Shard:
    """``order``: sorted suffixes, as places in the bytes of the chunk; ``before``: the block before each, -1 for none;
    ``ends``: how many of the first suffixes are shorter than a block."""

    order: np.ndarray
    before: np.ndarray
    ends: int


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes at each place where so many follow."""
    if len(data) < size:
        return np.empty(0, U)
    have, length, out, done = data.astype(U) + U(1), 1, None, 0
    left = size
    while left:
        if left & 1:
            if out is None:
                out, done = have, length
            else:
                n = len(data) - done - length + 1
                out = mix(out[:n] * U(0xD1342543DE82EF95) + have[done : done + n] + U(done))
                done += length
        left >>= 1
        if left:
            n = len(data) - 2 * length + 1
            have = mix(have[:n] * U(0x9E3779B97F4A7C15) + have[length : length + n] + U(length))
            length *= 2
    return out


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    sorted_ = keys[order]
    step = np.zeros(len(keys), np.int32)
    np.cumsum(sorted_[1:] != sorted_[:-1], out=step[1:], dtype=np.int32)
    new = np.empty(len(keys), np.int32)
    new[order] = step
    return new


def sorted_shard(symbol: np.ndarray, follow: np.ndarray, preceded: np.ndarray) -> Shard:
    """A shard from the block at each of its suffixes (-1 if shorter) and the index of the suffix one block on.

    ``preceded`` says, by suffix, the block before it. Ranks are refined by doubling the number of blocks compared.
    """
    n = len(symbol)
    short = symbol < 0
    ends = int(short.sum())
    rank = np.empty(n, np.int32)
    rank[short] = np.arange(ends)  # each end is a value of its own, in the order of places
    rank[~short] = ends + _ranks(symbol[~short])
    follow = np.where(short, np.arange(n, dtype=np.int32), follow)
    while True:
        new = _ranks(rank * np.int64(n + 1) + np.where(short, 0, rank[follow] + 1))
        if new.max(initial=0) == n - 1:
            order = np.empty(n, np.int32)
            order[new] = np.arange(n, dtype=np.int32)
            return Shard(order, preceded[order], ends)
        rank, follow = new, follow[follow]


def interleave(shards: list[Shard], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each suffix in merged order, how many blocks it has in common with the one before, at most ``steps``)."""
    which = np.concatenate([np.full(len(s.order), i, np.int8) for i, s in enumerate(shards)])
    first = np.concatenate([np.full(s.ends, i, np.int8) for i, s in enumerate(shards)])
    n, ends = len(which), len(first)
    common = np.full(n, steps, np.int8)
    common[0] = 0
    apart = np.zeros(n, bool)
    apart[0] = True
    for step in range(steps):
        before = np.empty(n, np.int32)
        for i, shard in enumerate(shards):
            before[which == i] = shard.before
        group = np.cumsum(apart, dtype=np.int32)
        there = np.flatnonzero(before >= 0).astype(np.int32)
        order = there[np.argsort(before[there] * np.int64(n) + there)]  # stable by block
        which = np.concatenate([first, which[order]])
        block, group = before[order], group[order]
        parted = np.ones(n, bool)
        parted[ends + 1 :] = (block[1:] != block[:-1]) | (group[1:] != group[:-1])
        common[parted & (common > step)] = step
        apart = parted
    return which, common


def repeated_starts(data: np.ndarray, offsets: np.ndarray, length: int, block: int, n_shards: int = 4) -> np.ndarray:
    """Whether the ``length`` bytes at each place also begin at another place of any text; False where a text ends before.

    A text is ``data`` from offset to next offset but for the last byte, which is a separator: its suffix is the empty one.
    ``length`` is a multiple of ``block``. Blocks are compared by 64-bit hashes.
    """
    size, sizes = len(data), np.diff(offsets)
    if not size:
        return np.zeros(0, bool)
    place = np.arange(size, dtype=np.int32)
    full = place + block < np.repeat(offsets[1:].astype(np.int32), sizes)
    symbol = np.full(size, -1, np.int32)
    symbol[full] = _ranks(rolling(data, block)[place[full]])
    preceded = np.full(size, -1, np.int32)
    inner = place - block >= np.repeat(offsets[:-1].astype(np.int32), sizes)
    preceded[inner] = symbol[place[inner] - block]
    shard_of = np.repeat((np.arange(len(sizes)) % n_shards).astype(np.int8), sizes)
    shards, places = [], []
    for i in range(min(n_shards, len(sizes))):
        own = np.flatnonzero(shard_of == i).astype(np.int32)
        index = np.zeros(size, np.int32)
        index[own] = np.arange(len(own))
        follow = index[np.minimum(own + block, size - 1)]
        shards.append(sorted_shard(symbol[own], follow, preceded[own]))
        places.append(own)
    which, common = interleave(shards, length // block)
    at = np.empty(size, np.int32)
    for i, (shard, own) in enumerate(zip(shards, places, strict=True)):
        at[which == i] = own[shard.order]
    joined = common >= length // block
    joined[:-1] |= joined[1:]
    out = np.zeros(size, bool)
    out[at[joined]] = True
    return out
