"""Byte-pair merging of many short pieces at once, over matrices of ids."""

from __future__ import annotations

import numpy as np

NEVER = np.int32(1 << 30)
#: Pairs are looked up in a table of so many bits, by a multiplicative hash; the few that share a place by search.
TABLE_BITS = 18
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Pieces of up to so many symbols share a matrix; longer ones are merged one by one.
WIDTHS = (4, 8, 12, 16, 24, 32)


class PairTable:
    """Which neighbours merge, into what, and in which order (lowest rank first, leftmost first among equals)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> None:
        keys = (left.astype(np.int64) << 20) | right
        order = np.argsort(keys)
        # a last row that no pair has, for places of the table that hold nothing
        self.keys = np.append(keys[order], -1)
        self.rank, self.merged = np.append(rank.astype(np.int32)[order], NEVER), np.append(merged.astype(np.int32)[order], 0).astype(np.int32)
        place, rows = self._place(self.keys[:-1]), np.arange(len(keys), dtype=np.int32)
        self.table = np.full(1 << TABLE_BITS, len(keys), np.int32)
        self.table[place] = rows
        self.rest = rows[self.table[place] != rows]  # pairs whose place another one has, in order of their keys
        self.rest_keys = self.keys[self.rest]
        self.shared = np.zeros(1 << TABLE_BITS, bool)
        self.shared[place[self.rest]] = True

    @staticmethod
    def _place(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * SPREAD >> np.uint64(64 - TABLE_BITS)).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left.astype(np.int64) << 20) | right
        place = self._place(keys)
        at = self.table[place]
        hit = self.keys[at] == keys
        again = np.nonzero(self.shared[place] & ~hit)
        if len(again[0]):
            asked = keys[again]
            at[again] = self.rest[np.minimum(np.searchsorted(self.rest_keys, asked), len(self.rest) - 1)]
            hit[again] = self.keys[at[again]] == asked
        return np.where(hit, self.rank[at], NEVER), self.merged[at]

    def merge_rows(self, rows: list[list[int]]) -> list[list[int]]:
        """The ids that remain of each row of ids."""
        sizes = np.array([len(r) for r in rows], np.int64)
        ids, left = self.merge_flat(np.array([i for r in rows for i in r], np.int32), sizes)
        ids, ends = ids.tolist(), np.cumsum(left).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def merge_flat(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids that remain of rows of ids, all in one array, and how many of each row."""
        out, left, start = ids.astype(np.int32), sizes.copy(), np.cumsum(sizes) - sizes
        low = 1  # one symbol has no neighbour
        for width in WIDTHS:
            at = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for a in range(0, len(at), 1 << 15):
                part = at[a : a + (1 << 15)]
                left[part] = self._matrix(out, start[part], sizes[part], width)
        for i in np.flatnonzero(sizes > low).tolist():
            got = self.merge_one(ids[start[i] : start[i] + sizes[i]].tolist())
            out[start[i] : start[i] + len(got)], left[i] = got, len(got)
        place = np.arange(len(out)) - np.repeat(start, sizes)
        return out[place < np.repeat(left, sizes)], left

    def _matrix(self, out: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        """Merges the rows of ``out`` that begin at start, in their places; how many ids remain of each."""
        places = np.arange(width)
        size, left, live = size.copy(), size.copy(), np.arange(len(start))
        ids = out[np.minimum(start[:, None] + places, len(out) - 1)]
        rank, into = self.find(ids[:, :-1], ids[:, 1:])
        rank[places[1:] >= size[:, None]] = NEVER
        while len(live):
            best = rank.argmin(1)
            rows_ = np.arange(len(live))
            on = rank[rows_, best] < NEVER
            if not on.all():
                done = np.flatnonzero(~on)
                own = places < size[done, None]
                out[(start[live[done]][:, None] + places)[own]] = ids[done][own]
                left[live[done]] = size[done]
                live, best, ids, rank, into, size = live[on], best[on], ids[on], rank[on], into[on], size[on]
                if not len(live):
                    break
                rows_ = np.arange(len(live))
            ids[rows_, best] = into[rows_, best]
            past = places[:-1] > best[:, None]
            ids[:, :-1] = np.where(past, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(past[:, :-1], rank[:, 1:], rank[:, :-1])
            into[:, :-1] = np.where(past[:, :-1], into[:, 1:], into[:, :-1])
            size -= 1
            rank[:, -1] = NEVER
            right = np.minimum(best + 1, width - 1)
            r, m = self.find(ids[rows_, best], ids[rows_, right])
            col = np.minimum(best, width - 2)
            ok = best + 1 < size
            rank[rows_, col] = np.where(ok, r, NEVER)
            into[rows_, col] = np.where(ok, m, 0)
            k = np.flatnonzero(best > 0)
            if len(k):
                b = best[k]
                rank[k, b - 1], into[k, b - 1] = self.find(ids[k, b - 1], ids[k, b])
        return left

    def merge_one(self, ids: list[int]) -> list[int]:
        """One row of any length, with a heap and links."""
        import heapq

        n = len(ids)
        ids, nxt, prev, alive = list(ids), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank, into = (x.tolist() for x in self.find(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)))
        heap = [(r, i, ids[i], ids[i + 1], m) for i, (r, m) in enumerate(zip(rank, into)) if r < NEVER]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            r, m = self.find(np.array([ids[i]]), np.array([ids[j]]))
            if r[0] < NEVER:
                heapq.heappush(heap, (int(r[0]), i, ids[i], ids[j], int(m[0])))

        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            alive[j], ids[i], nxt[i] = False, m, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                offer(i, nxt[i])
            if prev[i] >= 0:
                offer(prev[i], i)
        return [x for x, on in zip(ids, alive) if on]
