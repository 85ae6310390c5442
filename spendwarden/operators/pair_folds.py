"""What rules want of pairs of similar names, worked out where the pairs are found.

A name comes with short lists of what its vendors are, one entry each. Whole pairs of names never leave the task; rows do that are
results, or of which there are no more than names in a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .fuzzy_join import Fold

STEP = 1 << 20  # entries met at a time
DENSE = 1 << 24  # amounts of a table of vendors, names and payers that is held whole
ROWS = 1 << 14  # rows of it that are multiplied at a time


def _list(t: pa.Table, column: str) -> tuple[np.ndarray, pa.Array]:
    """Offsets of each row's entries, and the entries."""
    a = t.column(column).combine_chunks()
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    sizes = np.diff(a.offsets.to_numpy())
    return np.concatenate([[0], np.cumsum(sizes)]), a.flatten()


def _column(t: pa.Table, column: str) -> pa.Array:
    a = t.column(column).combine_chunks()
    return a.chunk(0) if isinstance(a, pa.ChunkedArray) else a


def _spread(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in rows, entry) for all entries of these rows."""
    many = offsets[rows + 1] - offsets[rows]
    of = np.repeat(np.arange(len(rows)), many)
    return of, np.arange(len(of)) + np.repeat(offsets[rows] - np.cumsum(many) + many, many)


def _crossed(lo: np.ndarray, left: np.ndarray, ro: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, left entry, right entry) for every two entries of every pair of rows, STEP at a time."""
    p, q = lo[left + 1] - lo[left], ro[right + 1] - ro[right]
    upto = np.cumsum(p * q)
    for at in range(0, int(upto[-1]) if len(upto) else 0, STEP):
        flat = np.arange(at, min(at + STEP, int(upto[-1])))
        pair = np.searchsorted(upto, flat, "right")
        place = flat - (upto[pair] - p[pair] * q[pair])
        yield pair, lo[left[pair]] + place // q[pair], ro[right[pair]] + place % q[pair]


class NameGraph(Fold):
    """Of names with first (the least vendor id) and rows (vendors) and no (the name's number): edges between first ids that join the
    same components as all pairs (kind 0: a, b), the numbers of names of several vendors that have a similar one (kind 1: a), and
    pairs of vendors counted at the first id of the name first in order (kind 2: a, n)."""

    schema = "kind tinyint, a bigint, b bigint, n bigint"

    def __init__(self, counts: bool = True):
        self.counts = counts

    def open(self, t):
        self.first, self.rows, self.no = _column(t, "first"), t.column("rows").to_numpy(), t.column("no").to_numpy()
        size = t.num_rows
        # rows of one name are one node: blocks of a cell and rows of pairs may hold it twice
        self.at = np.unique(self.no, return_inverse=True)[1]
        self.top = np.arange(size)
        self.touched = np.zeros(size, dtype=bool)
        self.n = np.zeros(size, dtype=np.int64)
        if self.counts:
            self.order = np.empty(size, dtype=np.int64)
            self.order[np.argsort(t.column("name").to_numpy(), kind="stable")] = np.arange(size)

    def pairs(self, left, right, score):
        self.touched[left] = self.touched[right] = True
        if self.counts:
            np.add.at(self.n, np.where(self.order[left] < self.order[right], left, right), self.rows[left] * self.rows[right])
        x, y = self.top[self.at[left]], self.top[self.at[right]]
        while True:
            apart = np.flatnonzero(x != y)
            if not len(apart):
                return
            left, right, x, y = left[apart], right[apart], x[apart], y[apart]
            high, some = np.unique(np.maximum(x, y), return_index=True)
            self.top[high] = np.minimum(x, y)[some]
            while not np.array_equal(up := self.top[self.top], self.top):
                self.top = up
            yield self._rows(0, self.first.take(pa.array(left[some])), self.first.take(pa.array(right[some])), None)
            x, y = self.top[self.at[left]], self.top[self.at[right]]

    def _rows(self, kind, a, b, n):
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int8)), a, none if b is None else b, none if n is None else n], names=["kind", "a", "b", "n"])

    def done(self):
        shared = np.unique(self.no[self.touched & (self.rows > 1)])
        if len(shared):
            yield self._rows(1, pa.array(shared), None, None)
        some = np.flatnonzero(self.n)
        if len(some):
            yield self._rows(2, self.first.take(pa.array(some)), None, pa.array(self.n[some]))


class VendorPairs(Fold):
    """Of names with ids (of their vendors): every two vendors of similar names."""

    schema = "a bigint, b bigint"

    def open(self, t):
        self.offsets, self.ids = _list(t, "ids")

    def pairs(self, left, right, score):
        for _, a, b in _crossed(self.offsets, left, self.offsets, right):
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(a)), self.ids.take(pa.array(b))], names=["a", "b"])


class VendorNames(Fold):
    """Of names with ids, first and rows: a row per vendor and similar name, in both directions."""

    schema = "vendor_id bigint, name string, other_name string, other_vendors bigint, first_vendor bigint, score double"

    def open(self, t):
        self.offsets, self.ids = _list(t, "ids")
        self.name, self.rows, self.first = (_column(t, c) for c in ("name", "rows", "first"))

    def pairs(self, left, right, score):
        for mine, other in ((left, right), (right, left)):
            for lo in range(0, len(mine), STEP):
                of, entry = _spread(self.offsets, mine[lo : lo + STEP])
                at, to = pa.array(mine[lo + of]), pa.array(other[lo + of])
                yield pa.RecordBatch.from_arrays(
                    [self.ids.take(pa.array(entry)), self.name.take(at), self.name.take(to), self.rows.take(to), self.first.take(to), pa.array(score[lo + of])],
                    names=["vendor_id", "name", "other_name", "other_vendors", "first_vendor", "score"])


class Elsewhere(Fold):
    """Of names with the id, spelling and address of their vendors (lists in order of all three): a row per vendor and similar name
    with vendors at other addresses, their number and the first of them."""

    schema = "vendor_id bigint, other_id bigint, others bigint, spelled string, other_spelled string, score double"

    def open(self, t):
        self.offsets, self.ids = _list(t, "ids")
        self.spelled = _list(t, "spelled")[1]
        codes = _list(t, "at")[1].dictionary_encode().indices
        self.code = codes.to_numpy(zero_copy_only=False).astype(np.int64)
        entries = len(self.code)
        begin, end = self.offsets[:-1], self.offsets[1:]
        # the first entry of each name, and the first one elsewhere
        self.low = begin
        row = np.repeat(np.arange(len(begin)), end - begin)
        away = np.flatnonzero(self.code != self.code[begin[row]]) if entries else np.zeros(0, dtype=np.int64)
        self.second = np.full(len(begin), -1)
        self.second[row[away][::-1]] = away[::-1]

    def pairs(self, left, right, score):
        for mine, other in ((left, right), (right, left)):
            some = (self.offsets[mine + 1] > self.offsets[mine]) & (self.offsets[other + 1] > self.offsets[other])
            mine, other, by = mine[some], other[some], score[some]
            for lo in range(0, len(mine), STEP):
                of, entry = _spread(self.offsets, mine[lo : lo + STEP])
                to = other[lo + of]
                many = self.offsets[to + 1] - self.offsets[to]
                here = np.zeros(len(to), dtype=np.int64)
                single = many == 1
                here[single] = self.code[self.offsets[to[single]]] == self.code[entry[single]]
                rest = np.flatnonzero(~single)
                for at, e in _meet(self.offsets, to[rest]):
                    np.add.at(here, rest[at], (self.code[e] == self.code[entry[rest[at]]]).astype(np.int64))
                ok = many > here
                entry, to, n, s = entry[ok], to[ok], (many - here)[ok], by[lo + of[ok]]
                pick = np.where(self.code[self.low[to]] == self.code[entry], self.second[to], self.low[to])
                a, b = pa.array(entry), pa.array(pick)
                yield pa.RecordBatch.from_arrays([self.ids.take(a), self.ids.take(b), pa.array(n), self.spelled.take(a), self.spelled.take(b), pa.array(s)],
                                                 names=["vendor_id", "other_id", "others", "spelled", "other_spelled", "score"])


def _meet(offsets: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in rows, entry), about STEP entries at a time."""
    many = np.cumsum(offsets[rows + 1] - offsets[rows])
    lo = 0
    while lo < len(rows):
        done = many[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(many, done + STEP, "right")))
        of, entry = _spread(offsets, rows[lo:hi])
        yield lo + of, entry
        lo = hi


class CommonPayers(Fold):
    """Of names with lists (vendor, payer, paid) in order of vendor: a row per vendor and similar name that both got least or more
    from the payers they share. low is the lowest vendor of the other name among these payees, pool what that name got."""

    schema = "entity_id bigint, low bigint, common bigint, paid bigint, pool bigint"

    def __init__(self, least: int, score: float):
        self.least, self.score = least, score

    def open(self, t):
        offsets, vendor = _list(t, "vendors")
        self.vendor = vendor.to_numpy(zero_copy_only=False)
        payer = _list(t, "payers")[1].to_numpy(zero_copy_only=False)
        paid = _list(t, "paid")[1].to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(t.num_rows), np.diff(offsets))
        payers, code = np.unique(payer, return_inverse=True)
        self.payers = max(1, len(payers))
        # entries by row, vendor: runs are the vendors of a name
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (self.vendor[1:] != self.vendor[:-1])
        begin = np.flatnonzero(new)
        most = np.add.reduceat(np.maximum(paid, 0), begin) if len(begin) else np.zeros(0, dtype=np.int64)
        keep = np.repeat(most >= self.least, np.diff(np.append(begin, len(row))))  # others can't get as much from some of their payers
        self.slot_offsets = np.concatenate([[0], np.cumsum(np.bincount(row[begin][most >= self.least], minlength=t.num_rows))])
        slots = most >= self.least
        self.slot_vendor = self.vendor[begin][slots]
        sizes = np.diff(np.append(begin, len(row)))[slots]
        self.entry_offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.entry_payer, self.entry_paid = code[keep], paid[keep]
        # what all vendors of a name got, by payer
        key = row * self.payers + code
        order = np.argsort(key, kind="stable")
        self.key, at = np.unique(key[order], return_index=True)
        self.pool = np.add.reduceat(paid[order], at) if len(at) else np.zeros(0, dtype=np.int64)
        self.low = self.vendor[order][at]  # lists come in order of vendor
        of = self.key // self.payers
        most = np.zeros(t.num_rows, dtype=np.int64)
        np.add.at(most, of, np.maximum(self.pool, 0))
        self.rich = (np.bincount(of, minlength=t.num_rows) > 0) & (most >= self.least)
        # few payers: sums of products of whole rows
        slot = np.repeat(np.arange(len(self.slot_vendor)), np.diff(self.entry_offsets))
        self.dense = (t.num_rows + len(self.slot_vendor)) * self.payers <= DENSE and len(np.unique(slot * self.payers + self.entry_payer)) == len(slot)
        if self.dense:
            self.slot_paid, self.slot_has = (np.zeros((len(self.slot_vendor), self.payers), dtype=x) for x in (np.int64, bool))
            self.slot_paid[slot, self.entry_payer], self.slot_has[slot, self.entry_payer] = self.entry_paid, True
            self.row_pool, self.row_has = (np.zeros((t.num_rows, self.payers), dtype=x) for x in (np.int64, bool))
            self.row_pool[of, self.key % self.payers], self.row_has[of, self.key % self.payers] = self.pool, True
            self.least_low, self.most_low = (np.zeros(t.num_rows, dtype=np.int64) for _ in range(2))
            self.least_low[of], self.most_low[of] = self.low, self.low
            np.minimum.at(self.least_low, of, self.low)
            np.maximum.at(self.most_low, of, self.low)

    def pairs(self, left, right, score):
        near = score / 100 >= self.score
        left, right = left[near], right[near]
        for mine, other in ((left, right), (right, left)):
            some = self.rich[other] & (self.slot_offsets[mine + 1] > self.slot_offsets[mine])
            for at, slot in _meet(self.slot_offsets, mine[some]):
                yield from self._judged(slot, other[some][at])

    def _judged(self, slot: np.ndarray, other: np.ndarray):
        if self.dense:
            plain = self.least_low[other] == self.most_low[other]  # else the lowest payee depends on the payers
            for lo in range(0, len(slot), ROWS):
                some = lo + np.flatnonzero(plain[lo : lo + ROWS])
                s, o = slot[some], other[some]
                mine, theirs = self.slot_has[s], self.row_has[o]
                paid, pool = (self.slot_paid[s] * theirs).sum(1), (self.row_pool[o] * mine).sum(1)
                ok = np.flatnonzero((paid >= self.least) & (pool >= self.least))
                common = (mine[ok] & theirs[ok]).sum(1)
                ok, common = ok[common > 0], common[common > 0]
                if len(ok):
                    yield self._rows(s[ok], self.least_low[o[ok]], common, paid[ok], pool[ok])
            slot, other = slot[~plain], other[~plain]
        for at, entry in _meet(self.entry_offsets, slot):
            key = other[at] * self.payers + self.entry_payer[entry]
            to = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[to] == key
            at, entry, to = at[hit], entry[hit], to[hit]
            if not len(at):
                continue
            begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            paid, pool = np.add.reduceat(self.entry_paid[entry], begin), np.add.reduceat(self.pool[to], begin)
            ok = (paid >= self.least) & (pool >= self.least)
            if ok.any():
                common, low = np.diff(np.append(begin, len(at))), np.minimum.reduceat(self.low[to], begin)
                yield self._rows(slot[at[begin]][ok], low[ok], common[ok], paid[ok], pool[ok])

    def _rows(self, slot, *more):
        return pa.RecordBatch.from_arrays([pa.array(self.slot_vendor[slot]), *[pa.array(x) for x in more]], names=["entity_id", "low", "common", "paid", "pool"])


class Crossings(Fold):
    """Of names with rows: how many pairs of their rows there are."""

    schema = "n bigint"

    def open(self, t):
        self.rows = t.column("rows").to_numpy()

    def pairs(self, left, right, score):
        yield pa.RecordBatch.from_arrays([pa.array([int((self.rows[left] * self.rows[right]).sum())])], names=["n"])


class Sums(Fold):
    """Of left names (side 0) and right names (side 1) with lists (kinds, amounts, counts): per left name and kind, sums over all similar right names.

    Sums are those of one step; rows of a name and kind are to be added up."""

    schema = "name string, kind string, amount decimal(38,0), n bigint"

    def open(self, t):
        self.name = _column(t, "name")
        self.offsets, kinds = _list(t, "kinds")
        coded = kinds.dictionary_encode()
        self.kinds, self.code = coded.dictionary, coded.indices
        code = self.code.fill_null(len(self.kinds)).to_numpy().astype(np.int64)
        self.code, self.many = code, len(self.kinds) + 1
        self.kinds = pa.concat_arrays([self.kinds, pa.nulls(1, self.kinds.type)])
        self.amount, self.n = (_list(t, c)[1].to_numpy(zero_copy_only=False) for c in ("amounts", "counts"))
        top = int(np.abs(self.amount).max(initial=0))
        self.safe = top < 1 << 62 and top * STEP < 1 << 62

    def pairs(self, left, right, score):
        for at, entry in _meet(self.offsets, right):
            key, of = np.unique(left[at] * self.many + self.code[entry], return_inverse=True)
            order = np.argsort(of, kind="stable")
            begin = np.searchsorted(of[order], np.arange(len(key)))
            amount = self.amount[entry][order] if self.safe else self.amount[entry][order].astype(object)
            sums = np.add.reduceat(amount, begin) if len(begin) else amount
            n = np.add.reduceat(self.n[entry][order], begin) if len(begin) else self.n[:0]
            yield pa.RecordBatch.from_arrays(
                [self.name.take(pa.array(key // self.many)), self.kinds.take(pa.array(key % self.many)), pa.array(sums).cast(pa.decimal128(38, 0)) if self.safe else pa.array([*map(_decimal, sums)], pa.decimal128(38, 0)), pa.array(n)],
                names=["name", "kind", "amount", "n"])


def _decimal(x: int):
    from decimal import Decimal

    return Decimal(int(x))
