"""Spans of bytes as keys: a verified hash table over Arrow's text buffers, and a table-driven transducer of bytes.

Both work on a whole buffer at once, by numpy inside a task. ``SpanTable`` gives equal spans
one number: open addressing over 64-bit hashes, where a span only joins an entry after its
group, its length and all its bytes have been compared, so equal hashes never merge
different words. ``Transducer`` is a finite-state machine given by three tables: the class
of each byte, the next state, and what is emitted on the way.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash

#: Spans beyond this many bytes are hashed and compared one by one, in C.
LONG = 512
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings (null: empty) and the n + 1 offsets of its rows in them."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


class SpanTable:
    """Numbers equal spans of bytes alike; entries keep their numbers from call to call.

    The arena holds the bytes of all entries, and after them those of the buffer at hand.
    """

    def __init__(self, room: int = 1 << 12) -> None:
        self.slots = np.full(1 << max(4, room.bit_length()), -1, np.int64)
        self.arena = np.zeros(1 << 16, np.uint8)
        self.used = self.count = 0
        # Room for entries, and after them for the spans of a call.
        self.start, self.length, self.group = (np.zeros(16, np.int64) for _ in range(3))
        self.first, self.hash = (np.zeros(16, np.uint64) for _ in range(2))

    def _words(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Eight bytes of the arena from each place, those beyond ``left`` as zeros."""
        eight = np.ndarray((len(self.arena) - 7,), "<u8", self.arena, strides=(1,))
        return eight[at] & _KEEP[np.minimum(left, 8)]

    def _hashes(self, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self._words(start, length)
        h = (first ^ (length.astype(np.uint64) << np.uint64(56)) ^ group.astype(np.uint64) * _MIX[1]) * _MIX[0]
        live, at = np.flatnonzero((length > 8) & (length <= LONG)), 8
        while len(live):
            h[live] = ((h[live] ^ (h[live] >> np.uint64(29))) + self._words(start[live] + at, length[live] - at)) * _MIX[1]
            at += 8
            live = live[length[live] > at]
        for i in np.flatnonzero(length > LONG).tolist():
            h[i] ^= np.uint64(xxhash.xxh64_intdigest(self.arena[start[i] : start[i] + length[i]]))
        return first, h ^ (h >> np.uint64(32))

    def _equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the spans of ``length`` from a and from b agree after their first eight bytes."""
        out = np.ones(len(a), bool)
        live, at = np.flatnonzero((length > 8) & (length <= LONG)), 8
        while len(live):
            left = length[live] - at
            same = self._words(a[live] + at, left) == self._words(b[live] + at, left)
            out[live[~same]] = False
            at += 8
            live = live[same & (left > 8)]
        for i in np.flatnonzero(length > LONG).tolist():
            out[i] = np.array_equal(self.arena[a[i] : a[i] + length[i]], self.arena[b[i] : b[i] + length[i]])
        return out

    def _grow(self, spans: int) -> None:
        if 2 * (self.count + spans) > len(self.slots):
            size = 1 << (3 * (self.count + spans)).bit_length()
            self.slots = np.full(size, -1, np.int64)
            at, who = (self.hash[: self.count] & np.uint64(size - 1)).astype(np.int64), np.arange(self.count)
            while len(who):  # entries differ, so each only needs a free slot
                free = self.slots[at] < 0
                self.slots[at[free]] = who[free]
                lost = self.slots[at] != who
                at, who = (at[lost] + 1) & (size - 1), who[lost]

    def number(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
        """The entry of each span of ``data``; spans of different groups are never equal."""
        start, length = np.asarray(start, np.int64) + self.used, np.asarray(length, np.int64)
        group = np.zeros(len(start), np.int64) if group is None else np.asarray(group, np.int64)
        if (need := self.used + len(data) + 8) > len(self.arena):
            self.arena = np.concatenate([self.arena[: self.used], np.zeros(max(need, 2 * self.used) - self.used, np.uint8)])
        self.arena[self.used : self.used + len(data)] = data
        self._grow(len(start))
        first, h = self._hashes(start, length, group)
        # Spans of this call have the numbers after those of the entries, until the call ends.
        base, n = self.count, len(start)
        for name, new in (("start", start), ("length", length), ("group", group), ("first", first), ("hash", h)):
            if base + n > len(getattr(self, name)):
                setattr(self, name, np.concatenate([getattr(self, name)[:base], np.zeros(base + 2 * n, new.dtype)]))
            getattr(self, name)[base : base + n] = new
        starts, lengths, groups, firsts, hashes = self.start, self.length, self.group, self.first, self.hash
        mask, entry = len(self.slots) - 1, np.full(n, -1, np.int64)
        at, who = (h & np.uint64(mask)).astype(np.int64), np.arange(n)
        claimed = []
        while len(who):
            free = self.slots[at] < 0
            self.slots[at[free]] = base + who[free]
            owner = self.slots[at]
            claimed.append(at[free & (owner == base + who)])
            i = base + who
            same = (hashes[owner] == hashes[i]) & (firsts[owner] == firsts[i]) & (lengths[owner] == lengths[i]) & (groups[owner] == groups[i])
            ask = np.flatnonzero(same & (owner != i) & (lengths[i] > 8))
            same[ask] = self._equal(starts[owner[ask]], starts[i[ask]], lengths[i[ask]])
            entry[who[same]] = owner[same]
            at, who = (at[~same] + 1) & mask, who[~same]
        slots = np.concatenate(claimed) if claimed else np.zeros(0, np.int64)
        owners = self.slots[slots]
        order = np.argsort(owners)
        slots, owners = slots[order], owners[order]
        new = np.full(n, -1, np.int64)
        new[owners - base] = np.arange(base, base + len(owners))
        self.slots[slots] = new[owners - base]
        late = entry >= base
        entry[late] = new[entry[late] - base]
        for own in (starts, lengths, groups, firsts, hashes):
            own[base : base + len(owners)] = own[owners]
        self.count = base + len(owners)
        # The new entries' bytes move together; the rest of the buffer goes.
        size = lengths[base : self.count]
        ends = np.cumsum(size)
        if len(size):
            places = np.repeat(starts[base : self.count] - (ends - size), size) + np.arange(ends[-1])
            self.arena[self.used : self.used + int(ends[-1])] = self.arena[places]
            starts[base : self.count] = self.used + ends - size
            self.used += int(ends[-1])
        return entry

    def bytes_of(self, entry: int) -> bytes:
        return self.arena[self.start[entry] : self.start[entry] + self.length[entry]].tobytes()


@dataclass(frozen=True)
class Transducer:
    """A finite-state machine over bytes: ``classes`` (256), ``step`` and ``emit`` (state, class).

    The class of a byte alone decides the next state here, whatever the state before (as no
    white space of the rule is part of a longer UTF-8 sequence); this is checked. So the
    states of a whole buffer are one look-up, and what is emitted is a second one, by the
    state before and the class. A row begins in state 0.
    """

    classes: np.ndarray
    step: np.ndarray
    emit: np.ndarray
    after: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        if (self.step != self.step[0]).any():
            raise ValueError("the next state must follow from the byte's class")
        object.__setattr__(self, "after", self.step[0][self.classes].astype(np.uint8))

    def run(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What each byte emits; ``ends`` are the offsets of rows."""
        state = np.zeros(len(data), np.uint8)
        state[1:] = self.after[data[:-1]]
        begin = ends[:-1]
        state[begin[begin < ends[1:]]] = 0
        return self.emit[state, self.classes[data]]


#: What a byte may emit, as bits.
BEGIN, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8


def word_transducer(symbols: str) -> Transducer:
    """Words between ASCII white space, capitals A-Z, code points, and the given ASCII symbols."""
    kinds = {(gap, cap, more, sym): i for i, (gap, cap, more, sym) in enumerate([(1, 0, 0, 0), (0, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1)])}
    marks = set(symbols.encode("ascii"))
    # Each byte by what it is: white space, A-Z, a byte within a character, a symbol, or any other.
    classes = np.array([kinds[b in b" \t\n\v\f\r", 0x41 <= b <= 0x5A, 0x80 <= b < 0xC0, b in marks] for b in range(256)], np.uint8)
    step = np.array([[0, 1, 1, 1, 1]] * 2)
    emit = np.array([[POINT, POINT, POINT | CAPITAL, 0, POINT | SYMBOL]] * 2, np.uint8)
    emit[0, 1:] |= BEGIN
    return Transducer(classes, step, emit)
