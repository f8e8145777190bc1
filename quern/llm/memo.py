"""A memo of encoded pieces of text, kept in numpy arrays and asked for a whole buffer at once.

Pieces of at most SHORT bytes are known by their bytes, held as three numbers; a hash of these finds the
place in a sorted table, and the bytes found there are compared, so an answer is never another
piece's.  Each distinct piece of a buffer is looked up once; new ones are encoded together.  Longer
pieces are encoded each time.  The table is bounded: beyond `keep` pieces only the newest stay."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from quern.llm.common import LOW, U64, mix, ranges, words_at

SHORT = 23
RECENT = 1 << 16
_TURN = U64(0x9E3779B97F4A7C15)
_KINDS = {"hash": U64, "a": U64, "b": U64, "c": U64, "off": np.int64, "count": np.uint8}


class _Table:
    """Pieces sorted by hash; their ids lie one after another in `ids`."""

    def __init__(self, kind):
        self.rows = {f: np.zeros(0, _KINDS[f]) for f in _KINDS}
        self.ids = np.zeros(0, kind)

    def __len__(self) -> int:
        return len(self.rows["hash"])

    def find(self, h, a, b, c) -> np.ndarray:
        """The row of each piece, or -1."""
        if not len(self):
            return np.full(len(h), -1)
        r = self.rows
        at = np.minimum(np.searchsorted(r["hash"], h), len(self) - 1)
        return np.where((r["hash"][at] == h) & (r["a"][at] == a) & (r["b"][at] == b) & (r["c"][at] == c), at, -1)

    def add(self, other: dict[str, np.ndarray], ids: np.ndarray) -> None:
        """More pieces; of two that hash alike the older stays."""
        joined = {f: np.concatenate([self.rows[f], other[f] + len(self.ids) if f == "off" else other[f]]) for f in _KINDS}
        order = np.argsort(joined["hash"], kind="stable")
        h = joined["hash"][order]
        order = order[np.concatenate([[True], h[1:] != h[:-1]])]
        self.rows = {f: v[order] for f, v in joined.items()}
        self.ids = np.concatenate([self.ids, ids])


class PieceMemo:
    """encode: a list of pieces (bytes) -> (their ids one after another, how many each has)."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], kind=np.uint16, keep: int = 1_500_000):
        self.encode, self.kind, self.keep = encode, kind, keep
        self.old, self.new = _Table(kind), _Table(kind)

    def ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, how many each has)."""
        size = end - start
        off, count, pool = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), [self.old.ids, self.new.ids]
        short = np.flatnonzero(size <= SHORT)
        word, s, n = words_at(data), start[short], size[short]
        a = word[s] & LOW[np.minimum(n, 8)]
        b, c = np.zeros(len(s), U64), np.zeros(len(s), U64)
        for part, at in ((b, 8), (c, 16)):
            more = np.flatnonzero(n > at)
            part[more] = word[s[more] + at] & LOW[np.minimum(n[more] - at, 8)]
        c |= n.astype(U64) << U64(56)  # the size, where no byte of a piece is: zeros may be bytes or the end
        h = mix(mix(mix(a) * _TURN ^ b) * _TURN ^ c)
        order = np.argsort(h)
        hs = h[order]
        lead = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]])) if len(hs) else np.zeros(0, np.int64)
        which = np.empty(len(h), np.int64)
        which[order] = np.repeat(np.arange(len(lead)), np.diff(np.concatenate([lead, [len(h)]])))
        first = order[lead]
        # pieces that hash like another one of this buffer are encoded by themselves
        odd = (a != a[first][which]) | (b != b[first][which]) | (c != c[first][which])
        u = (h[first], a[first], b[first], c[first])
        u_off, u_count = np.zeros(len(first), np.int64), np.full(len(first), -1)
        base = 0
        for table in (self.old, self.new):
            row = table.find(*u)
            hit = np.flatnonzero((row >= 0) & (u_count < 0))
            u_off[hit], u_count[hit] = table.rows["off"][row[hit]] + base, table.rows["count"][row[hit]]
            base += len(table.ids)
        miss = np.flatnonzero(u_count < 0)
        if len(miss):
            made, sizes = self._encoded(data, s[first[miss]], n[first[miss]])
            u_off[miss], u_count[miss] = base + np.cumsum(sizes) - sizes, sizes
            pool.append(made)
            base += len(made)
        off[short], count[short] = u_off[which], u_count[which]
        rest = np.concatenate([np.flatnonzero(size > SHORT), short[np.flatnonzero(odd)]])
        if len(rest):
            made, sizes = self._encoded(data, start[rest], size[rest])
            off[rest], count[rest] = base + np.cumsum(sizes) - sizes, sizes
            pool.append(made)
        out = np.concatenate(pool)[ranges(off, count)]
        if len(miss):
            self._remember(dict(zip(_KINDS, (*(x[miss] for x in u), u_off[miss] - len(self.old.ids) - len(self.new.ids), u_count[miss].astype(np.uint8)))), pool[2])
        return out, count

    def _encoded(self, data, start, size) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes() if size.sum() * 4 > len(data) else None
        pieces = [raw[a : a + n] if raw is not None else data[a : a + n].tobytes() for a, n in zip(start.tolist(), size.tolist())]
        return self.encode(pieces)

    def _remember(self, rows, ids) -> None:
        self.new.add(rows, ids)
        if len(self.new) > RECENT:
            if len(self.old) + len(self.new) > self.keep:
                self.old = _Table(self.kind)
            self.old.add(self.new.rows, self.new.ids)
            self.new = _Table(self.kind)
