"""CBOR records in batches: all records of a batch are walked at once, by their declared types, into typed Arrow arrays.

Every step reads one head of each record: positions are an array, and what stands there is read with index arithmetic.  A list or map is
walked entry by entry, for all records that still have one.  What does not fit (another kind, a missing key without a default, endless texts and endless items under keys that are not asked for,
tags, halves, numbers that are not finite, lists or maps of more than LONGEST entries, broken bytes) is left to the
decoder of single records, which tells the fault."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..plans.types import BOOL, FLOAT, INT, STR, Enum, List, Option, Struct, VarType

LONGEST = 4096
_SIZES = np.array([0] * 24 + [1, 2, 4, 8] + [0] * 4)
MAX = (1 << 63) - 1
KINDS = {INT: pa.int64(), FLOAT: pa.float64(), STR: pa.string(), BOOL: pa.bool_()}


def supported(kind: VarType) -> bool:
    if isinstance(kind, Option):
        return supported(kind.inner)
    if isinstance(kind, List):
        return supported(kind.item)
    if isinstance(kind, Struct):
        return all(supported(t) for _, t in kind.fields)
    return kind in KINDS or isinstance(kind, Enum) and kind.plain


def arrow_type(kind: VarType) -> pa.DataType:
    if isinstance(kind, Option):
        return arrow_type(kind.inner)
    if isinstance(kind, List):
        return pa.list_(arrow_type(kind.item))
    if isinstance(kind, Struct):
        return pa.struct([(n, arrow_type(t)) for n, t in kind.fields])
    return KINDS.get(kind, pa.string())


class Walk:
    """``odd`` are the records that don't fit; their values mean nothing."""

    def __init__(self, records: pa.Array):
        known = records.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(known.buffers()[1], np.int64)[known.offset : known.offset + len(known) + 1]
        data = known.buffers()[2]
        self.data = np.append(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), np.zeros(16, np.uint8))
        self.start, self.end = offsets[:-1].copy(), offsets[1:].copy()
        self.odd = records.is_null().to_numpy(zero_copy_only=False) | (self.start == self.end)

    def fail(self, row: np.ndarray, where: np.ndarray) -> None:
        self.odd[row[where]] = True

    def head(self, at: np.ndarray, row: np.ndarray):
        """Major type, info, number and the place behind the head of the item at each place."""
        at = np.minimum(at, len(self.data) - 16)
        first = self.data[at]
        info = (first & 31).astype(np.int64)
        size = _SIZES[info]
        number = np.where(size > 0, 0, info).astype(np.uint64)
        for k in range(int(size.max(initial=0))):
            number = np.where(k < size, (number << np.uint64(8)) | self.data[at + 1 + k], number)
        behind = at + 1 + size
        self.fail(row, (info > 27) | (behind > self.end[row]))
        return first >> 5, info, number, behind

    def within(self, behind: np.ndarray, count: np.ndarray, row: np.ndarray) -> np.ndarray:
        """``count`` bytes from each place as numbers of this machine; records that end before are odd, and have none."""
        bad = count > (self.end[row] - behind).clip(0).astype(np.uint64)
        self.fail(row, bad)
        return np.where(bad | self.odd[row], 0, count).astype(np.int64)

    def entries(self, want: int, at: np.ndarray, row: np.ndarray):
        """Of lists (4) or maps (5) in turn: which have a k-th entry, until none has one.  ``at`` is moved behind heads and ends; the
        caller moves it behind entries."""
        first = self.data[np.minimum(at, len(self.data) - 16)]
        endless = first == (want << 5 | 31)
        rest = np.flatnonzero(~endless)
        count = np.zeros(len(at), np.int64)
        major, _, number, behind = self.head(at[rest], row[rest])
        self.fail(row[rest], (major != want) | (number > LONGEST))
        count[rest] = np.minimum(number, LONGEST)
        at[rest], at[endless] = behind, at[endless] + 1
        open_ = endless.copy()
        for k in range(LONGEST + 1):
            ends = np.flatnonzero(open_ & ~self.odd[row])
            ends = ends[self.data[np.minimum(at[ends], len(self.data) - 16)] == 0xFF]
            at[ends] += 1
            open_[ends] = False
            on = np.flatnonzero((open_ | ~endless & (count > k)) & ~self.odd[row])
            self.fail(row[on], at[on] >= self.end[row[on]])
            on = on[~self.odd[row[on]]]
            if not len(on):
                return
            if k == LONGEST:
                self.fail(row, open_)
                return
            yield on

    def ascii(self, behind: np.ndarray, length: np.ndarray, row: np.ndarray) -> None:
        """Texts that nobody reads must be texts all the same; those beyond ASCII are left to the other decoder."""
        ends = np.append(0, np.cumsum(length))
        owner = np.repeat(np.arange(len(row)), length)
        self.odd[row[owner[self.data[np.repeat(behind - ends[:-1], length) + np.arange(ends[-1])] > 127]]] = True

    def skip(self, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The places behind whole items.  Maps among them are left to the other decoder, for their keys."""
        at, left = at.copy(), np.ones(len(at), np.int64)
        while True:
            on = np.flatnonzero((left > 0) & ~self.odd[row])
            if not len(on):
                return at
            major, info, number, behind = self.head(at[on], row[on])
            with np.errstate(all="ignore"):
                real = np.where(info == 27, number.view(np.float64), number.astype(np.uint32).view(np.float32).astype(np.float64))
            self.fail(row[on], (major == 5) | (major == 7) & ((info == 25) | (info > 25) & ~np.isfinite(real)))
            length = self.within(behind, np.where((major == 2) | (major == 3), number, 0).astype(np.uint64), row[on])
            self.ascii(behind, length, row[on])
            inside = np.where(major == 4, np.minimum(number, np.uint64(1 << 40)), 0).astype(np.int64)
            at[on] = behind + length
            left[on] += inside + (major == 6) - 1

    def value(self, kind: VarType, at: np.ndarray, row: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The values at the places, and the places behind them."""
        if isinstance(kind, Option):
            first = self.data[np.minimum(at, len(self.data) - 16)]
            none = (first == 0xF6) | (first == 0xF7)
            some = np.flatnonzero(~none)
            got, behind = self.value(kind.inner, at[some], row[some])
            after, place = at + 1, np.full(len(at), -1)
            after[some], place[some] = behind, np.arange(len(some))
            return got.take(pa.array(place, mask=none)), after
        if isinstance(kind, List):
            return self.items(kind, at, row)
        if isinstance(kind, Struct):
            return self.members(kind, at, row)
        major, info, number, behind = self.head(at, row)
        if kind == BOOL:
            self.fail(row, (major != 7) | ((info != 20) & (info != 21)))
            return pa.array(info == 21), behind
        whole = (major <= 1) & (number <= MAX)
        signed = np.where(whole, number, 0).astype(np.int64)
        signed = np.where(major == 1, -1 - signed, signed)
        if kind == INT:
            self.fail(row, ~whole)
            return pa.array(signed), behind
        if kind == FLOAT:
            real = (major == 7) & ((info == 26) | (info == 27))
            with np.errstate(all="ignore"):
                x = np.where(info == 27, number.view(np.float64), number.astype(np.uint32).view(np.float32).astype(np.float64))
            self.fail(row, ~whole & ~real | real & ~np.isfinite(x))
            return pa.array(np.where(real, x, signed.astype(np.float64))), behind
        self.fail(row, major != 3)
        length = self.within(behind, number, row)
        ends = np.append(0, np.cumsum(length))
        if ends[-1] > MAX >> 32:
            raise pa.ArrowInvalid("texts of more than 2 GB in a batch")
        raw = self.data[np.repeat(behind - ends[:-1], length) + np.arange(ends[-1])]
        text = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes()))
        if (raw > 127).any():
            text.validate(full=True)
        if isinstance(kind, Enum):
            self.fail(row, ~np.isin(np.array(text.to_pylist(), object), kind.names) if len(text) else np.zeros(0, bool))
        return text, behind + length

    def items(self, kind: List, at: np.ndarray, row: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        parts, keys, at = [], [], at.copy()
        for on in self.entries(4, at, row):
            got, at[on] = self.value(kind.item, at[on], row[on])
            parts.append(got)
            keys.append(on)
        owner = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        # Of one record the entries came one after the other, so a stable sort by record keeps their order.
        items = pa.concat_arrays(parts).take(pa.array(np.argsort(owner, kind="stable"))) if parts else pa.array([], arrow_type(kind.item))
        ends = np.append(0, np.cumsum(np.bincount(owner, minlength=len(row))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items), at

    def members(self, kind: Struct, at: np.ndarray, row: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        arrays, at, _, _ = self.fields(dict(kind.fields), at, row)
        for (_, t), a in zip(kind.fields, arrays):
            if not isinstance(t, Option):
                self.fail(row, a.is_null().to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays(arrays, names=[n for n, _ in kind.fields]), at

    def fields(self, kinds: dict[str, VarType], at: np.ndarray, row: np.ndarray):
        """Maps: the values of each name (null where it is absent), the places behind, which names are there, and whether others are."""
        at, other = at.copy(), np.zeros(len(row), bool)
        found: dict[str, list] = {n: [] for n in kinds}
        for on in self.entries(5, at, row):
            major, _, number, behind = self.head(at[on], row[on])
            self.fail(row[on], major != 3)
            length = self.within(behind, number, row[on])
            after, rest = behind + length, np.ones(len(on), bool)
            for name, kind in kinds.items():
                key = name.encode("utf-8")
                same = np.flatnonzero(rest & (length == len(key)))
                for i, c in enumerate(key):
                    same = same[self.data[behind[same] + i] == c]
                if len(same):
                    rest[same] = False
                    got, after[same] = self.value(kind, after[same], row[on[same]])
                    found[name].append((on[same], got))
            left = np.flatnonzero(rest)
            other[on[left]] = True
            self.ascii(behind[left], length[left], row[on[left]])
            after[left] = self.skip(after[left], row[on[left]])
            at[on] = after
        arrays, there = [], []
        for name, kind in kinds.items():
            place, n = np.full(len(row), -1), 0
            for owners, got in found[name]:  # of a key that is there twice the last counts
                place[owners] = n + np.arange(len(got))
                n += len(got)
            values = pa.concat_arrays([g for _, g in found[name]]) if found[name] else pa.array([], arrow_type(kind))
            arrays.append(values.take(pa.array(place, mask=place < 0)))
            there.append(place >= 0)
        return arrays, at, there, other


def decoded(records: pa.Array, kinds: dict[str, VarType], optional: set[str], allow_extra: bool) -> tuple[list[pa.Array], list[np.ndarray], np.ndarray]:
    """Values of each name, where they are there, and the records that are left to the other decoder."""
    walk = Walk(records)
    row = np.arange(len(records))
    arrays, at, there, other = walk.fields(kinds, walk.start, row)
    walk.odd |= at != walk.end
    for name, has in zip(kinds, there):
        if name not in optional:
            walk.odd |= ~has
    if not allow_extra:
        walk.odd |= other
    return arrays, there, walk.odd
