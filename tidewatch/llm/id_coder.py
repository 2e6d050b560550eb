"""An adaptive range coder for token ids, for many blocks at once.

Three models predict each id: order 2 and order 1 remember the id that last followed the two or one before it, order 0
counts ids by their high byte and by their low byte given the high one. They are mixed as weights: how often each of
them was right after the last two outcomes gives the shares of the interval that order 2's id, order 1's id and order
0's distribution get. An arithmetic coder narrows its interval to the share of the best model that is right. Each block
starts from the same state and adapts to itself alone, so it can be read without any other; all state is integer, so
that any machine reads what another wrote.

Which model was right depends on no id but through earlier outcomes, and what order 0 gives on no outcome. A block
therefore holds all its outcomes first and then the ids of order 0, and both are dealt to PARTS intervals: outcomes by
PARTS runs of positions, ids one to each in turn. The models are the block's, whichever interval they serve. Blocks and
their parts go through the coder side by side, as lanes of arrays; what orders 1 and 2 say is put in last, block by block.
"""

from __future__ import annotations

import numpy as np

#: Ids in a block, ids there can be, and intervals of a block.
BLOCK, IDS, PARTS = 1 << 13, 1 << 16, 8
#: Contexts that a block remembers, as bits; groups of high bytes with low-byte counts of their own; models.
_SLOTS, _GROUPS, _OUTCOMES = 11, 32, 3
#: Bits of the shares of models and of a byte.
_SHARE, _BYTE = 12, 12
#: What a byte's being seen counts for, when having not been seen counts 1.
_SEEN = np.float32(20)
#: The interval is below 2**_WHOLE wide; a digit of 24 bits is written as soon as it is below 2**_LEAST.
_WHOLE, _DIGIT = 61, 24
_LEAST = _WHOLE - _DIGIT
#: Bits of the third digit that the interval holds; a reader keeps the others.
_THIRD = _WHOLE - 2 * _DIGIT
#: Outcomes of a part, which are coded by twos, after which weights take effect, and the weight above which a model's is halved.
_LEARN, _HEAVY = {2, 4, *range(8, BLOCK // PARTS, 8)}, 4000
#: Ids of a part after which order 0's distribution is drawn anew, for bytes whose counts have grown by more than a _GROWN-th.
_REDRAW = [2, 5, 9, 14, 20, 28, 38, 50, 64, 80, 100, 124, 150, 180, 216, 256, 304, 360, 424, 500, 590, 690, 800, 920]
_GROWN = 4
#: Sums of 256 counts and their total, filled up to whole rows of 16; what every byte has before it is seen, summed up.
_ROW = 272
_LEAST_SUMS = np.arange(1, 257, dtype=np.uint16)
#: Slots of an id as the last one and as the one before.
_SLOT1, _SLOT2 = (np.arange(IDS) * by >> 4 & (1 << _SLOTS) - 1 for by in (40503, 30029))


class _Shares:
    """Counts of bytes by row and, as shares of 2**_BYTE, their running sums."""

    def __init__(self, rows: int) -> None:
        self.counts = np.zeros((rows, 256), dtype=np.uint16)
        self.total, self.drawn = (np.zeros(rows, dtype=np.int64) for _ in range(2))
        self.sums = np.full((rows, _ROW), 1 << _BYTE, dtype=np.uint16)
        self.sums[:, :256] = np.arange(256, dtype=np.uint16) << _BYTE - 8
        self.coarse = np.ascontiguousarray(self.sums[:, 0:256:16])
        self.fine = self.sums.reshape(-1, 16)
        self.flat = self.sums.ravel()

    def count(self, row: np.ndarray, byte: np.ndarray) -> None:
        np.add.at(self.counts.ravel(), row * 256 + byte, np.uint16(1))  # of another type it would be slow
        self.total += np.bincount(row, minlength=len(self.total))

    def redraw(self, rows: int) -> None:
        """Draw the shares anew of those of the first rows that have grown enough."""
        grown = np.flatnonzero((self.total - self.drawn)[:rows] * _GROWN > self.drawn[:rows])
        self.drawn[grown] = self.total[grown]
        for at in range(0, len(grown), 512):
            of = grown[at : at + 512]
            sums = np.cumsum(self.counts.take(of, axis=0), axis=1, dtype=np.int32).astype(np.float32)  # of another type it would be slow
            sums *= _SEEN
            sums += _LEAST_SUMS
            sums *= np.float32((1 << _BYTE) - 256) / sums[:, -1:]
            drawn = sums.astype(np.int32).astype(np.uint16)
            drawn += _LEAST_SUMS
            self.sums[of, 1:256] = drawn[:, :-1]
            self.coarse[of, 1:] = drawn[:, 15:255:16]

    def of(self, row: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the bytes' shares begin, and how large they are."""
        at = row * _ROW + byte
        begin = self.flat.take(at).astype(np.int64)
        return begin, self.flat.take(at + 1) - begin

    def found(self, row: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The byte of each row into whose share v falls: the row's 16 sixteenths first, then 16 bytes."""
        v = v.astype(np.uint16)[:, None]
        part = _set(self.coarse.take(row, axis=0) <= v)
        return part * 16 + _set(self.fine.take(row * (_ROW // 16) + part, axis=0) <= v)


def _set(below: np.ndarray) -> np.ndarray:
    """How many of 16 flags are set, less one."""
    two = below.view(np.uint64)
    return ((two[:, 0] + two[:, 1]) * np.uint64(0x0101010101010101) >> np.uint64(56)).view(np.int64) - 1  # bytes summed up in the highest


class _Weights:
    """How often each model was right after the last two outcomes, by block, as shares of 2**_SHARE."""

    def __init__(self, lanes: int) -> None:
        self.weights = np.tile(np.array([8, 4, 20], dtype=np.int64), (lanes * 9, 1))
        self.row = np.repeat(np.arange(lanes) * 9, PARTS)
        self.shares()

    def shares(self) -> None:
        """Where the shares of orders 2, 1 and 0 begin and the last one ends, by row."""
        heavy = self.weights.sum(1) > _HEAVY
        self.weights[heavy] = self.weights[heavy] >> 1 | 1
        each = 1 + self.weights[:, :2] * ((1 << _SHARE) - _OUTCOMES) // self.weights.sum(1, keepdims=True)
        self.share2, self.both = each[:, 0].copy(), each.sum(1)

    def learn(self, rows: np.ndarray, outcomes: np.ndarray) -> None:
        np.add.at(self.weights.ravel(), (rows * _OUTCOMES + outcomes).ravel(), 24)
        self.shares()


class _Order0:
    """The counts of ids of blocks in the order of how many ids order 0 has to give: those with a step to go come first."""

    def __init__(self, many: np.ndarray) -> None:
        """many: ids of order 0 by block, in descending order."""
        self.high, self.low = _Shares(len(many)), _Shares(len(many) * _GROUPS)
        self.lane = np.repeat(np.arange(len(many)), PARTS)
        self.steps = -(-int(many[0]) // PARTS)
        self.going = PARTS * np.searchsorted(-many, -PARTS * np.arange(self.steps))
        self.frames = [*zip([0, *_REDRAW], [*(at for at in _REDRAW if at < self.steps), self.steps], strict=False)]

    def learn(self, ids: list[np.ndarray], then: int) -> None:
        """Count the ids of some steps and draw anew for the lanes that go on."""
        x, lane = np.concatenate(ids), np.concatenate([self.lane[: len(i)] for i in ids])
        high = x >> 8
        self.high.count(lane, high)
        self.low.count(lane * _GROUPS + (high & _GROUPS - 1), x & 255)
        self.high.redraw(then // PARTS)
        self.low.redraw(then // PARTS * _GROUPS)


class _Writer:
    """Intervals that are narrowed side by side, and the digits that they have given."""

    def __init__(self, lanes: int, most: int) -> None:
        self.size, self.at, self.width = most, np.zeros(lanes, dtype=np.int64), np.full(lanes, (1 << _WHOLE) - 1)
        self.out, self.begin = np.zeros(lanes * most, dtype=np.uint32), np.arange(lanes) * most
        self.filled = self.begin.copy()

    def narrow(self, start: np.ndarray, share: np.ndarray, bits: int) -> None:
        """Narrow the first intervals to shares of 2**bits, 24 bits at most."""
        width = self.width[: len(start)]
        unit = width >> bits
        self.at[: len(start)] += start * unit
        np.multiply(unit, share, out=width)
        of = np.flatnonzero(width < 1 << _LEAST)
        self.digit(of)
        width[of] <<= _DIGIT

    def digit(self, of: np.ndarray) -> None:
        low = self.at[of]
        place = self.filled[of[low >> _WHOLE > 0]] - 1
        while len(place):  # a carry runs on through digits that overflow
            more = self.out[place] + np.uint32(1) & np.uint32((1 << _DIGIT) - 1)
            self.out[place] = more
            place = place[more == 0] - 1
        low &= (1 << _WHOLE) - 1
        place = self.filled[of]
        self.out[place] = low >> _LEAST
        self.filled[of] = place + 1
        self.at[of] = (low & (1 << _LEAST) - 1) << _DIGIT

    def end(self) -> tuple[np.ndarray, np.ndarray]:
        """The digits by interval and how many there are; one more names a number within, as zeros follow it."""
        self.at += (1 << _LEAST) - 1
        self.digit(np.arange(len(self.at)))
        return self.out.reshape(-1, self.size), self.filled - self.begin


class _Reader:
    """Intervals that are narrowed side by side by their digits."""

    def __init__(self, data: np.ndarray) -> None:
        """data: digits by interval, each with three zeros after it at least."""
        lanes, size = data.shape
        self.data, self.used = data.ravel(), np.arange(lanes) * size + 3
        first, second, third = data[:, :3].T.astype(np.int64)
        self.code = first << _LEAST | second << _THIRD | third >> _DIGIT - _THIRD
        self.spare, self.width = third & (1 << _DIGIT - _THIRD) - 1, np.full(lanes, (1 << _WHOLE) - 1)

    def reorder(self, order: np.ndarray) -> None:
        self.used, self.code, self.spare, self.width = (x[order] for x in (self.used, self.code, self.spare, self.width))

    def narrow(self, below: np.ndarray, width: np.ndarray) -> None:
        """Narrow the first intervals to these widths, from so far above their lower ends on."""
        n = len(below)
        self.code[:n] -= below
        self.width[:n] = width
        of = np.flatnonzero(width < 1 << _LEAST)
        at = self.used[of]
        digit = self.data.take(at, mode="clip").astype(np.int64)  # an interval may run on for a step after its last id
        self.used[of] = at + 1
        self.code[of] = self.code[of] << _DIGIT | self.spare[of] << _THIRD | digit >> _DIGIT - _THIRD
        self.spare[of] = digit & (1 << _DIGIT - _THIRD) - 1
        self.width[of] <<= _DIGIT


def _outcomes(ids: np.ndarray) -> np.ndarray:
    """Which model is right for each of ids (positions x blocks): 0 for order 2, 1 for order 1, 2 for neither."""
    steps, lanes = ids.shape
    base = np.arange(lanes) << _SLOTS
    next1, next2 = (np.zeros(lanes << _SLOTS, dtype=np.uint16) for _ in range(2))
    out, last = np.empty((steps, lanes), dtype=np.uint8), np.zeros((2, lanes), dtype=np.uint16)
    for begin in range(0, steps, 64):
        x = ids[begin : begin + 64]
        wide = np.concatenate([last, x])
        slot1 = _SLOT1.take(wide[1:-1]) + base
        slot2 = slot1 ^ _SLOT2.take(wide[:-2])
        guess1, guess2 = np.empty_like(x), np.empty_like(x)
        for t, ids_now in enumerate(x):
            next1.take(slot1[t], out=guess1[t], mode="wrap")
            next2.take(slot2[t], out=guess2[t], mode="wrap")
            next1[slot1[t]] = ids_now
            next2[slot2[t]] = ids_now
        out[begin : begin + 64] = np.where(guess2 == x, 0, np.where(guess1 == x, 1, 2))
        last = wide[-2:]
    return out


def _filled_in(ids: np.ndarray, outcomes: np.ndarray) -> None:
    """Put what orders 1 and 2 say into ids (positions x blocks), which hold those of order 0."""
    lanes = ids.shape[1]
    base = np.arange(lanes) << _SLOTS
    next1, next2 = (np.zeros(lanes << _SLOTS, dtype=np.uint16) for _ in range(2))
    slot1, before, follows = base, 0, 0
    guess1, guess2 = np.empty((2, lanes), dtype=np.uint16)
    for x, by2, by1 in zip(ids, outcomes == 0, outcomes == 1, strict=True):
        slot2 = slot1 ^ before
        next1.take(slot1, out=guess1, mode="wrap")
        next2.take(slot2, out=guess2, mode="wrap")
        np.copyto(x, guess1, where=by1)
        np.copyto(x, guess2, where=by2)
        next1[slot1] = x
        next2[slot2] = x
        before, slot1 = follows, _SLOT1.take(x) + base
        follows = _SLOT2.take(x)


def encoded(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """The blocks of a sequence of ids; all but the last hold `block` ids, and the last one of several is filled with zeros.

    A block is, as 16-bit little-endian numbers, the positions of a part and the digits of each part but the last, then
    the parts' digits.
    """
    n = len(ids)
    if not n:
        return []
    if int(ids.max()) >= IDS or block > BLOCK:
        raise ValueError(f"ids must be below {IDS} and blocks hold {BLOCK} at most")
    lanes, each = -(-n // block), -(-min(n, block) // (2 * PARTS)) * 2
    table = np.zeros((lanes, block), dtype=np.uint16)
    table.ravel()[:n] = ids
    whole = np.zeros((lanes, each * PARTS), dtype=np.uint16)
    whole[:, :block] = table[:, : each * PARTS]
    outcomes = np.ascontiguousarray(_outcomes(np.ascontiguousarray(whole.T)).T)
    many = np.count_nonzero(outcomes == 2, axis=1)
    order = np.argsort(-many, kind="stable")
    many, outcomes, whole = many[order], outcomes[order], whole[order]
    writer, weights = _Writer(lanes * PARTS, each * 3 // 2 + 8), _Weights(lanes)

    by_step = np.concatenate([np.zeros((2, lanes * PARTS), dtype=np.uint8), outcomes.reshape(-1, each).T])
    cuts = [0, *sorted(at for at in _LEARN if at < each), each]
    for begin, end in zip(cuts, cuts[1:], strict=False):
        some = by_step[begin : end + 2].astype(np.int64)
        now, rows = some[2:], weights.row + some[:-2] * _OUTCOMES + some[1:-1]
        share2, both = weights.share2.take(rows), weights.both.take(rows)
        start = np.where(now == 0, 0, np.where(now == 1, share2, both))
        share = np.where(now == 0, share2, np.where(now == 1, both, 1 << _SHARE)) - start
        start, share = (start[::2] << _SHARE) + share[::2] * start[1::2], share[::2] * share[1::2]
        for t in range((end - begin) // 2):
            writer.narrow(start[t], share[t], 2 * _SHARE)
        weights.learn(rows, now)

    if many[0]:
        order0 = _Order0(many)
        rest = np.zeros((lanes, order0.steps * PARTS), dtype=np.uint16)
        there = np.arange(order0.steps * PARTS) < many[:, None]
        rest[there] = whole[outcomes == 2]
        rest, there = (np.ascontiguousarray(x.reshape(lanes, -1, PARTS).transpose(1, 0, 2)).reshape(-1, lanes * PARTS) for x in (rest, there))
        for begin, end in order0.frames:
            m = order0.going[begin]
            lane, x = order0.lane[:m], rest[begin:end, :m].astype(np.int64)
            hi_begin, hi_size = order0.high.of(lane, x >> 8)
            lo_begin, lo_size = order0.low.of(lane * _GROUPS + (x >> 8 & _GROUPS - 1), x & 255)
            start, share = (hi_begin << _BYTE) + hi_size * lo_begin, hi_size * lo_size
            none = ~there[begin:end, :m]  # a part whose ids have ended stays as it is
            start[none], share[none] = 0, 1 << 2 * _BYTE
            for t in range(begin, end):
                k = order0.going[t]
                writer.narrow(start[t - begin, :k], share[t - begin, :k], 2 * _BYTE)
            if end < order0.steps:
                order0.learn([x[t - begin, : order0.going[t]] for t in range(begin, end)], order0.going[end])

    out, digits = writer.end()
    heads = np.concatenate([np.full((lanes, 1), each), digits.reshape(lanes, PARTS)[:, :-1]], axis=1).astype("<u2")
    data = out[np.arange(out.shape[1]) < digits[:, None]].astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()
    cuts = np.concatenate([[0], 3 * np.cumsum(digits.reshape(lanes, PARTS).sum(1))]).tolist()
    found: list[bytes] = [b""] * lanes
    for i, at in enumerate(order.tolist()):
        found[at] = heads[i].tobytes() + data[cuts[i] : cuts[i + 1]]
    return found


def decoded(blocks: list[bytes], counts: list[int]) -> np.ndarray:
    """The ids of blocks that `encoded` made; counts: of ids, equal for all but the last."""
    lanes, head = len(blocks), 2 * PARTS
    if not lanes:
        return np.zeros(0, dtype=np.uint16)
    heads = np.frombuffer(b"".join(b[:head] for b in blocks), dtype="<u2").reshape(lanes, PARTS).astype(np.int64)
    each, total = int(heads[0, 0]), np.array([(len(b) - head) // 3 for b in blocks])
    digits = np.concatenate([heads[:, 1:], (total - heads[:, 1:].sum(1))[:, None]], axis=1).ravel()
    flat = np.zeros((int(total.sum()), 4), dtype=np.uint8)
    flat[:, 1:] = np.frombuffer(b"".join(b[head:] for b in blocks), dtype=np.uint8).reshape(-1, 3)
    data = np.zeros((lanes * PARTS, int(digits.max()) + 4), dtype=np.uint32)
    data[np.arange(data.shape[1]) < digits[:, None]] = flat.view(">u4").ravel()
    reader, weights = _Reader(data), _Weights(lanes)

    width, now = lanes * PARTS, np.zeros(lanes * PARTS, dtype=np.int64)
    bounds, lane, row = np.zeros((4, width), dtype=np.int64), np.arange(width), weights.row
    by_step, seen_rows, seen = np.empty((each, width), dtype=np.uint8), [], []
    for t in range(each):
        if t in _LEARN:
            weights.learn(np.array(seen_rows), np.array(seen))
            seen_rows, seen = [], []
        seen_rows.append(row)
        first = t % 2 == 0
        if first:
            unit = reader.width >> 2 * _SHARE
            place = (reader.code.view(np.uint64) // unit.view(np.uint64)).view(np.int64)
            below, share = 0, 1 << _SHARE
        np.multiply(weights.share2.take(row), share, out=bounds[1])
        np.multiply(weights.both.take(row), share, out=bounds[2])
        bounds[3] = share << _SHARE
        before, now = now, (place >= bounds[1]).astype(np.int64) + (place >= bounds[2])
        at = now * width + lane
        start = bounds.ravel().take(at)
        size = bounds.ravel().take(at + width) - start
        below = below + start
        if first:
            place -= start
            share = size >> _SHARE
        else:
            reader.narrow(below * unit, size * unit)
        by_step[t] = now
        seen.append(now)
        row = weights.row + before * _OUTCOMES + now
    outcomes = np.ascontiguousarray(by_step.T).reshape(lanes, -1)

    many = np.count_nonzero(outcomes == 2, axis=1)
    order = np.argsort(-many, kind="stable")
    many = many[order]
    ids = np.zeros((lanes, each * PARTS), dtype=np.uint16)
    if many[0]:
        order0 = _Order0(many)
        reader.reorder((order[:, None] * PARTS + np.arange(PARTS)).ravel())
        rest = np.zeros((order0.steps, width), dtype=np.uint16)
        for begin, end in order0.frames:
            seen = []
            for t in range(begin, end):
                k = order0.going[t]
                of = order0.lane[:k]
                unit = reader.width[:k] >> 2 * _BYTE
                place = (reader.code[:k].view(np.uint64) // unit.view(np.uint64)).view(np.int64)
                hi = order0.high.found(of, place >> _BYTE)
                hi_begin, hi_size = order0.high.of(of, hi)
                group = of * _GROUPS + (hi & _GROUPS - 1)
                lo = order0.low.found(group, ((place - (hi_begin << _BYTE)) / hi_size).astype(np.int64))
                lo_begin, lo_size = order0.low.of(group, lo)
                reader.narrow(((hi_begin << _BYTE) + hi_size * lo_begin) * unit, hi_size * lo_size * unit)
                seen.append(hi << 8 | lo)
                rest[t, :k] = seen[-1]
            if end < order0.steps:
                order0.learn(seen, order0.going[end])
        rest = np.ascontiguousarray(rest.reshape(-1, lanes, PARTS).transpose(1, 0, 2)).reshape(lanes, -1)
        back = np.argsort(order)
        ids[outcomes == 2] = rest[back][np.arange(rest.shape[1]) < many[back][:, None]]
    ids = np.ascontiguousarray(ids.T)
    _filled_in(ids, np.ascontiguousarray(outcomes.T))
    block, last = counts[0], counts[-1]
    return np.ascontiguousarray(ids.T[:, :block]).ravel()[: block * (lanes - 1) + last]
