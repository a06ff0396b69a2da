"""Counting quotient filter over numpy arrays (used inside tasks).

A fingerprint of ``bits`` bits is cut into a quotient (its first bits) and a
remainder. The remainders of a quotient are one run of slots in ascending
order, as near to slot ``quotient`` as the runs before it allow; the quotient
itself is not stored. Two bitmaps say which quotients have a run and at which
slots runs end: the k-th set bit of the one belongs to the k-th of the other.

A fingerprint seen once takes one slot. One seen more often is written as its
remainder twice, the number of digits, and the count less two in digits of the
slot's width: ascending runs hold no equal neighbours otherwise.

All fingerprints and counts can be read back exactly, so filters of any sizes
merge without loss, by merging their sorted fingerprints and adding counts.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = "<BBQQ"  # bits, quotient bits, quotients, slots
LOAD = 0.75


def summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct values with the sums of their counts."""
    if not len(values):
        return values, counts
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.add.reduceat(counts, first)


class CountingQuotientFilter:
    """``bits``: width of a fingerprint; ``quotient_bits``: width of its first part."""

    def __init__(self, bits: int, quotient_bits: int, occupied: np.ndarray, run_ends: np.ndarray, slots: np.ndarray):
        self.bits, self.quotient_bits = bits, quotient_bits
        self.occupied, self.run_ends, self.slots = occupied, run_ends, slots

    @property
    def remainder_bits(self) -> int:
        return self.bits - self.quotient_bits

    @classmethod
    def of(cls, values: np.ndarray, bits: int, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """The filter of fingerprints (``uint64`` below ``2 ** bits``, bits from
        4 to 64) in any order, seen ``counts`` times each."""
        values, counts = summed(np.asarray(values, np.uint64),
                                np.ones(len(values), np.uint64) if counts is None else np.asarray(counts, np.uint64))
        quotient_bits = min(max(int(np.ceil(np.log2(max(1, len(values)) / LOAD))), 1), bits - 3)
        r = np.uint64(bits - quotient_bits)
        quotients = (values >> r).astype(np.int64)
        remainders = values & ((np.uint64(1) << r) - np.uint64(1))
        # Slots that every fingerprint takes, and what stands in them.
        width = np.ones(len(values), np.int64)
        many = np.flatnonzero(counts > 1)
        digits = []
        for i in many.tolist():
            rest, own = int(counts[i]) - 2, []
            while rest:
                own.append(rest & ((1 << int(r)) - 1))
                rest >>= int(r)
            digits.append(own)
            width[i] = 3 + len(own)
        start = np.concatenate([[0], np.cumsum(width)])
        slots = np.repeat(remainders, width)
        for i, own in zip(many.tolist(), digits):
            at = start[i] + 2
            slots[at] = len(own)
            slots[at + 1:at + 1 + len(own)] = own
        of_slot = np.repeat(quotients, width)
        n = len(slots)
        # A slot lies at its quotient, or right after the slot before it.
        place = np.arange(n) + np.maximum.accumulate(of_slot - np.arange(n)) if n else np.zeros(0, np.int64)
        last = np.flatnonzero(np.concatenate([of_slot[1:] != of_slot[:-1], [True]])) if n else np.zeros(0, np.int64)
        size = max(1 << quotient_bits, int(place[-1]) + 1 if n else 0)
        occupied, run_ends, table = np.zeros(1 << quotient_bits, bool), np.zeros(size, bool), np.zeros(size, np.uint64)
        occupied[of_slot[last]] = True
        run_ends[place[last]] = True
        table[place] = slots
        return cls(bits, quotient_bits, occupied, run_ends, table)

    def _runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Quotient, first slot and last slot of every run."""
        quotients, ends = np.flatnonzero(self.occupied), np.flatnonzero(self.run_ends)
        return quotients, np.maximum(quotients, np.concatenate([[0], ends[:-1] + 1])) if len(ends) else ends, ends

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints, ascending, and their counts."""
        quotients, starts, ends = self._runs()
        lengths = ends - starts + 1
        total = int(lengths.sum())
        if not total:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        run = np.repeat(np.arange(len(quotients)), lengths)
        place = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[run]
        slots = self.slots[place]
        counts = np.ones(total, np.uint64)
        entry = np.ones(total, bool)
        after = 0
        for i in np.flatnonzero((slots[1:] == slots[:-1]) & (run[1:] == run[:-1])).tolist():
            if i < after:  # digits of a count
                continue
            n = int(slots[i + 2])
            counts[i] = 2 + sum(int(d) << (self.remainder_bits * j) for j, d in enumerate(slots[i + 3:i + 3 + n]))
            after = i + 3 + n
            entry[i + 1:after] = False
        values = (quotients[run].astype(np.uint64) << np.uint64(self.remainder_bits)) | slots
        return values[entry], counts[entry]

    def count(self, value: int) -> int:
        """How often a fingerprint was seen, from its run alone."""
        quotient, remainder = value >> self.remainder_bits, value & ((1 << self.remainder_bits) - 1)
        if not self.occupied[quotient]:
            return 0
        k = int(np.count_nonzero(self.occupied[:quotient]))
        ends = np.flatnonzero(self.run_ends)
        at, end = max(quotient, int(ends[k - 1]) + 1 if k else 0), int(ends[k])
        while at <= end:
            here, n = int(self.slots[at]), 1
            step = 1
            if at < end and int(self.slots[at + 1]) == here:
                m = int(self.slots[at + 2])
                n = 2 + sum(int(d) << (self.remainder_bits * j) for j, d in enumerate(self.slots[at + 3:at + 3 + m]))
                step = 3 + m
            if here == remainder:
                return n
            at += step
        return 0

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """One filter with the fingerprints of all and the sums of their counts."""
        parts = [f.items() for f in filters]
        return cls.of(np.concatenate([v for v, _ in parts]), filters[0].bits, np.concatenate([c for _, c in parts]))

    def to_bytes(self) -> bytes:
        """Bitmaps, then the slots, each in as many bytes as a remainder needs."""
        n = -(-self.remainder_bits // 8)
        return b"".join([struct.pack(_HEAD, self.bits, self.quotient_bits, len(self.occupied), len(self.slots)),
                         np.packbits(self.occupied).tobytes(), np.packbits(self.run_ends).tobytes(),
                         self.slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        bits, quotient_bits, n_occupied, n_slots = struct.unpack_from(_HEAD, raw)
        data, at = np.frombuffer(raw, np.uint8), struct.calcsize(_HEAD)
        occupied = np.unpackbits(data[at:at + -(-n_occupied // 8)], count=n_occupied).astype(bool)
        at += -(-n_occupied // 8)
        run_ends = np.unpackbits(data[at:at + -(-n_slots // 8)], count=n_slots).astype(bool)
        at += -(-n_slots // 8)
        slots = np.zeros((n_slots, 8), np.uint8)
        n = -(-(bits - quotient_bits) // 8)
        slots[:, :n] = data[at:at + n * n_slots].reshape(n_slots, n)
        return cls(bits, quotient_bits, occupied, run_ends, slots.view("<u8").reshape(-1))
