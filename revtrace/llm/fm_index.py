"""A compressed FM-index of word sequences in numpy: suffix order, a wavelet matrix over the BWT, backward search for many streams at once."""
from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank of symbols in a sequence: a level of packed bits, with counts of ones by word, for each bit of a symbol."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.n, self.depth = len(seq), max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for level in range(self.depth - 1, -1, -1):
            bit = (seq >> level) & 1 == 1
            packed = np.zeros(self.n // 64 + 1, np.uint64)
            raw = np.packbits(bit, bitorder="little")
            packed.view(np.uint8)[:len(raw)] = raw
            ones = np.zeros(len(packed), np.int64)
            np.cumsum(np.bitwise_count(packed[:-1]), out=ones[1:])
            self.levels.append((packed, ones, self.n - int(bit.sum())))
            seq = np.concatenate([seq[~bit], seq[bit]])
        # of the last order: where each symbol's block begins
        self.begin = np.searchsorted(self._last_order(seq), self._reversed(np.arange(sigma)))

    def _reversed(self, symbols: np.ndarray) -> np.ndarray:
        out = np.zeros_like(symbols)
        for b in range(self.depth):
            out |= ((symbols >> b) & 1) << (self.depth - 1 - b)
        return out

    def _last_order(self, seq: np.ndarray) -> np.ndarray:
        return self._reversed(seq)  # blocks stand in the order of the reversed bits

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[k] stands before position at[k]."""
        pos = at.copy()
        for level, (packed, ones, zeros) in zip(range(self.depth - 1, -1, -1), self.levels):
            word = pos >> 6
            below = (np.uint64(1) << (pos & 63).astype(np.uint64)) - np.uint64(1)
            r = ones[word] + np.bitwise_count(packed[word] & below)
            pos = np.where((symbol >> level) & 1 == 1, zeros + r, pos - r)
        return pos - self.begin[symbol]


class FMIndex:
    """Over sequences of symbols 1..sigma-1, each closed by symbol 0. Patterns up to `depth` symbols can be searched; the suffixes
    are sorted that deep. owners: a number for each sequence; the smallest owner of a match can be asked for."""

    def __init__(self, sequences: list[np.ndarray], owners: np.ndarray, sigma: int, depth: int):
        self.depth = depth
        sizes = np.array([len(s) + 1 for s in sequences])
        text = np.zeros(int(sizes.sum()), np.int64)
        ends = np.cumsum(sizes)
        for s, e in zip(sequences, ends):
            text[e - 1 - len(s):e - 1] = s
        n = len(text)
        ranks, rank, span = [], text, 1
        sa = np.argsort(text, kind="stable")
        ranks.append((1, text))
        while span < depth:
            after = np.zeros(n, np.int64)
            after[:n - span] = rank[span:] + 1
            key = rank * (max(n, sigma) + 2) + after
            sa = np.argsort(key, kind="stable")
            ordered = key[sa]
            rank = np.empty(n, np.int64)
            rank[sa] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            span *= 2
            ranks.append((span, rank))
        self.owner = np.repeat(owners, sizes)[sa]
        bwt = text[sa - 1]
        self.wavelet = WaveletMatrix(bwt, sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        lcp, a, b = np.zeros(n, np.int64), sa[:-1].copy(), sa[1:].copy()
        for size, r in reversed(ranks):  # symbols that neighbours in suffix order have in common, up to depth
            fits = (a < n) & (b < n)
            same = np.zeros(n - 1, bool)
            same[fits] = r[a[fits]] == r[b[fits]]
            lcp[1:][same] += size
            a[same] += size
            b[same] += size
        self.lcp = lcp
        self._bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def group(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix, the range of suffixes that share `depth` symbols with it: the ancestor at that depth."""
        if depth not in self._bounds:
            begins = np.flatnonzero(np.concatenate([[True], self.lcp[1:] < depth]))
            number = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(self.lcp))))
            self._bounds[depth] = begins[number], np.append(begins[1:], len(self.lcp))[number]
        return self._bounds[depth]

    def least_owner(self, depth: int) -> np.ndarray:
        """For each suffix, the smallest owner among those that share `depth` symbols with it."""
        begins, _ = self.group(depth)
        starts = np.unique(begins)
        return np.repeat(np.minimum.reduceat(self.owner, starts), np.diff(np.append(starts, len(begins))))

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the ranges of symbol + what [low, high) stand for."""
        base = self.first[symbol]
        return base + self.wavelet.rank(symbol, low), base + self.wavelet.rank(symbol, high)

    def stream(self, sequences: list[np.ndarray], limit: int):
        """Matching statistics, from the right end of all sequences at once. Yields (numbers of the sequences, their positions, match
        length up to `limit`, first suffix of the match's range); symbols the index does not know are -1."""
        order = np.argsort([-len(s) for s in sequences], kind="stable")
        sizes = np.array([len(sequences[k]) for k in order])
        longest = int(sizes[0]) if len(sizes) else 0
        table = np.zeros((longest, len(order)), np.int64)
        for col, k in enumerate(order):
            table[:sizes[col], col] = sequences[k][::-1]
        n = len(self.lcp)
        low, high, length = np.zeros(len(order), np.int64), np.full(len(order), n, np.int64), np.zeros(len(order), np.int64)
        for s in range(longest):
            live = int(np.searchsorted(-sizes, -s, "left"))  # sequences with more than s symbols stand first
            symbol, lo, hi, m = table[s, :live], low[:live], high[:live], length[:live]
            full = m >= limit  # keep the limit - 1 symbols that stand first, then extend
            if full.any():
                g_low, g_high = self.group(limit - 1)
                at = lo[full]
                lo[full], hi[full], m[full] = g_low[at], g_high[at], limit - 1
            known = symbol >= 0
            new_lo, new_hi = self.step(np.where(known, symbol, 0), lo, hi)
            good = known & (new_lo < new_hi)
            lost = np.flatnonzero(known & ~good & (m > 0))
            if len(lost):  # the longest beginning of the match that the symbol extends, by bisection over ancestors
                least, most = np.zeros(len(lost), np.int64), m[lost] - 1
                while True:
                    open_ = np.flatnonzero(least < most)
                    if not len(open_):
                        break
                    mid = (least[open_] + most[open_] + 1) // 2
                    a, b = self._ancestors(mid, lo[lost[open_]])
                    x, y = self.step(symbol[lost[open_]], a, b)
                    least[open_] = np.where(x < y, mid, least[open_])
                    most[open_] = np.where(x < y, most[open_], mid - 1)
                a, b = self._ancestors(least, lo[lost])
                x, y = self.step(symbol[lost], a, b)
                new_lo[lost], new_hi[lost] = x, y
                m[lost] = least
                good[lost] = x < y
            lo[:] = np.where(good, new_lo, 0)
            hi[:] = np.where(good, new_hi, n)
            m[:] = np.where(good, m + 1, 0)
            yield order[:live], sizes[:live] - 1 - s, m, lo

    def _ancestors(self, depth: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.zeros(len(at), np.int64), np.full(len(at), len(self.lcp), np.int64)
        for d in np.unique(depth[depth > 0]):
            sel = depth == d
            g_low, g_high = self.group(int(d))
            a[sel], b[sel] = g_low[at[sel]], g_high[at[sel]]
        return a, b
