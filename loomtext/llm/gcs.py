"""Golomb-coded sets, and the stream filter made of them."""

from __future__ import annotations

import numpy as np

BLOCK = 128


class GolombSet:
    """A sorted set of integers under 2**universe_bits, kept as Golomb-Rice coded gaps in blocks of 128.

    The quotients of a block lie together in unary, its remainders together in
    rice bits each, so blocks are decoded without a loop over their values. The
    first value of each block is kept plain as the index; a probe decodes only
    the block that could hold it.
    """

    def __init__(self, values: np.ndarray, universe_bits: int):
        """`values`: sorted, distinct, not empty."""
        n = len(values)
        self.n, self.universe_bits = n, universe_bits
        self.rice = max(0, int(np.floor(np.log2(max(1.0, np.log(2) * 2.0**universe_bits / n)))))
        self.firsts = values[::BLOCK].copy()
        gaps = np.diff(values, prepend=values[:1])
        gaps[::BLOCK] = 0
        q = (gaps >> np.uint64(self.rice)).astype(np.int64)
        ends = np.cumsum(q + 1)
        unary = np.zeros(int(ends[-1]), np.uint8)
        unary[ends - 1] = 1
        self.starts = np.concatenate([[0], ends[BLOCK - 1 :: BLOCK]])[: len(self.firsts)]
        self.starts = np.append(self.starts, ends[-1])
        self.unary = np.packbits(unary)
        shifts = np.arange(self.rice - 1, -1, -1, dtype=np.uint64)
        packed = np.packbits(((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)) if self.rice else np.empty(0, np.uint8)
        self.rest = np.concatenate([packed, np.zeros(8, np.uint8)])  # so that eight bytes can be read at any value

    def __len__(self) -> int:
        return self.n

    def nbytes(self) -> int:
        return self.unary.nbytes + self.rest.nbytes + self.firsts.nbytes + self.starts.nbytes

    def _decode(self, blocks: np.ndarray) -> np.ndarray:
        """Values of the given blocks, which must rise; nothing else is read."""
        from_bit, to_bit = self.starts[blocks], self.starts[blocks + 1]
        at = _ranges(from_bit, to_bit)
        bits = self.unary[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
        q = np.diff(np.flatnonzero(bits), prepend=-1) - 1
        gaps = q.astype(np.uint64) << np.uint64(self.rice)
        first = blocks * BLOCK
        size = np.minimum(first + BLOCK, self.n) - first
        if self.rice:
            bit = _ranges(first, first + size) * self.rice
            window = self.rest[(bit >> 3)[:, None] + np.arange(8)].view(">u8").ravel().astype(np.uint64)
            gaps |= window << (bit & 7).astype(np.uint64) >> np.uint64(64 - self.rice)
        heads = np.cumsum(size) - size
        gaps[heads] = self.firsts[blocks]
        total = np.cumsum(gaps, dtype=np.uint64)  # wraps around, as does the difference
        before = np.concatenate([[np.uint64(0)], total[heads[1:] - 1]])
        return total - np.repeat(before, size)

    def values(self) -> np.ndarray:
        return self._decode(np.arange(len(self.firsts)))

    def contains(self, probes: np.ndarray) -> tuple[np.ndarray, int]:
        """For each probe whether it is in the set, and the number of blocks decoded: those that could hold a probe."""
        block = np.searchsorted(self.firsts, probes, "right") - 1
        asked = np.unique(block[block >= 0])
        if not len(asked):
            return np.zeros(len(probes), bool), 0
        held = self._decode(asked)
        at = np.minimum(np.searchsorted(held, probes), len(held) - 1)
        return held[at] == probes, len(asked)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The whole numbers of all half-open ranges, one range after the other."""
    n = hi - lo
    return np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)


class SeenFilter:
    """Whether each value of a stream has come before, in a Golomb-coded log-structured set.

    New values gather in a plain sorted buffer, which is sealed into a Golomb
    set once it holds `generation` values and a sixteenth of all that are kept;
    sets of like size are merged, so there are a handful of them. `expected`
    sums, over all probes, the chance that a value never seen hits a kept one;
    `asked` and `decoded` count the blocks there were when values were probed,
    and those of them that were decoded.
    """

    def __init__(self, universe_bits: int, generation: int = 1 << 10):
        self.bits, self.generation = universe_bits, generation
        self.buffer = np.empty(0, np.uint64)
        self.levels: list[GolombSet] = []
        self.expected = 0.0
        self.kept = self.asked = self.decoded = 0

    def offer(self, values: np.ndarray) -> np.ndarray:
        """Flags, in order, for a run of the stream."""
        uniq, first = np.unique(values, return_index=True)
        old = np.zeros(len(uniq), bool)
        if len(self.buffer):
            at = np.minimum(np.searchsorted(self.buffer, uniq), len(self.buffer) - 1)
            old |= self.buffer[at] == uniq
        for level in self.levels:
            ask = np.flatnonzero(~old)
            if len(ask):
                old[ask], decoded = level.contains(uniq[ask])
                self.decoded += decoded
                self.asked += len(level.firsts)
        new = uniq[~old]
        self.expected += len(new) * (self.kept + len(new) / 2) / 2.0**self.bits
        self.kept += len(new)
        if len(new):
            self.buffer = np.union1d(self.buffer, new)
            if len(self.buffer) >= max(self.generation, self.kept >> 4):
                self._seal()
        seen = np.ones(len(values), bool)
        seen[first[~old]] = False
        return seen

    def _seal(self) -> None:
        values, self.buffer = self.buffer, np.empty(0, np.uint64)
        while self.levels and len(self.levels[-1]) < 2 * len(values):
            values = np.union1d(values, self.levels.pop().values())
        self.levels.append(GolombSet(values, self.bits))

    def nbytes(self) -> int:
        return self.buffer.nbytes + sum(x.nbytes() for x in self.levels)
