"""Adaptive context-mixing range coder for token ids below 65536; many blocks are coded in step.

Each block is a lane of numpy arrays with a model of its own, so blocks stand alone. For each id the model asks, in
this order: is it what followed the last two ids (order 2), is it what followed the last id (order 1), else which
high byte (order 0, adaptive counts) and low byte. The chance of each yes is a mix of two adaptive chances, that of
the order itself at its confidence and that of the next lower order, with a weight that learns which predicts
better. All arithmetic is in whole numbers, so every machine decodes alike.

The range coder keeps 48 bits, gives out 16 at a time and adds carries to the words already given.
"""

from __future__ import annotations

import numpy as np

MAX_ID = 1 << 16
SLOTS = 1 << 11
ONE = 4096
STEP = 12
REBUILD = 32
LOW_BITS, FULL_BITS = 32, 48


class _Encoder:
    def __init__(self, lanes: int, tokens: int) -> None:
        self.low = np.zeros(lanes, np.int64)
        self.range = np.full(lanes, (1 << FULL_BITS) - 1, np.int64)
        self.out = np.zeros((lanes, 4 * tokens + 8), np.uint16)
        self.size = np.zeros(lanes, np.int64)

    def code(self, at: np.ndarray, start: np.ndarray, freq: np.ndarray, part: np.ndarray) -> None:
        low = self.low[at] + part * start
        span = part * freq
        over = np.flatnonzero(low >> FULL_BITS)
        if len(over):
            low[over] &= (1 << FULL_BITS) - 1
            self._carry(at[over])
        small = np.flatnonzero(span < 1 << LOW_BITS)
        if len(small):
            lane = at[small]
            self.out[lane, self.size[lane]] = low[small] >> LOW_BITS
            self.size[lane] += 1
            low[small] = (low[small] & ((1 << LOW_BITS) - 1)) << 16
            span[small] <<= 16
        self.low[at], self.range[at] = low, span

    def _carry(self, lane: np.ndarray) -> None:
        place = self.size[lane] - 1
        while len(lane):
            self.out[lane, place] += np.uint16(1)
            more = self.out[lane, place] == 0
            lane, place = lane[more], place[more] - 1

    def finish(self) -> list[bytes]:
        for shift in (32, 16, 0):
            self.out[np.arange(len(self.low)), self.size] = (self.low >> shift) & 0xFFFF
            self.size += 1
        return [self.out[k, :n].astype("<u2").tobytes() for k, n in enumerate(self.size.tolist())]


class _Decoder:
    def __init__(self, payloads: list[bytes]) -> None:
        words = [np.frombuffer(p, "<u2") for p in payloads]
        self.words = np.zeros((len(words), max(map(len, words), default=0) + 4), np.int64)
        for k, w in enumerate(words):
            self.words[k, : len(w)] = w
        self.range = np.full(len(words), (1 << FULL_BITS) - 1, np.int64)
        self.value = (self.words[:, 0] << 32) | (self.words[:, 1] << 16) | self.words[:, 2]
        self.size = np.full(len(words), 3)

    def code(self, at: np.ndarray, start: np.ndarray, freq: np.ndarray, part: np.ndarray) -> None:
        value, span = self.value[at] - part * start, part * freq
        small = np.flatnonzero(span < 1 << LOW_BITS)
        if len(small):
            lane = at[small]
            place = np.minimum(self.size[lane], self.words.shape[1] - 1)
            value[small] = (value[small] << 16) | self.words[lane, place]
            self.size[lane] += 1
            span[small] <<= 16
        self.value[at], self.range[at] = value, span


def _walk(lengths: np.ndarray, ids: np.ndarray | None, coder) -> np.ndarray:
    """Step through all lanes at once, longest first; with ids it encodes, without it decodes and returns them."""
    lanes, longest = len(lengths), int(lengths.max(initial=0))
    writing = ids is not None
    if not writing:
        ids = np.zeros((lanes, longest), np.int64)
    order2, order1 = np.zeros(lanes * SLOTS, np.int32), np.zeros(lanes * SLOTS, np.int32)
    chance = {k: np.full(lanes * 8, ONE // 2) for k in ("two", "one", "one_alone", "none")}
    weight = {k: np.full(lanes, 8) for k in ("first", "second")}
    counts = np.ones((lanes, 256), np.int32)
    below = np.zeros((lanes, 257), np.int64)
    last1, last2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")

    def yes_or_no(at, a, b, k_a, k_b, w, truth):
        pa, pb, wt = a[k_a], b[k_b], w[at]
        p = np.clip((wt * pa + (16 - wt) * pb) >> 4, 32, ONE - 32)
        part = coder.range[at] >> 12
        hit = truth if writing else coder.value[at] < part * p
        coder.code(at, np.where(hit, 0, p), np.where(hit, p, ONE - p), part)
        goal = np.where(hit, ONE, 0)
        a[k_a], b[k_b] = pa + ((goal - pa) >> 4), pb + ((goal - pb) >> 5)
        w[at] = np.clip(wt + np.sign(pa - pb) * np.where(hit, 1, -1), 1, 15)
        return hit

    for t in range(longest):
        n = int(active[t])
        if t % REBUILD == 0:
            np.cumsum(counts[:n], axis=1, out=below[:n, 1:])
        lane = np.arange(n)
        one, two = last1[:n], last2[:n]
        slot1 = lane * SLOTS + ((one * 40503 >> 3) & (SLOTS - 1))
        slot2 = lane * SLOTS + (((one * 30011 + two * 50021) >> 4) & (SLOTS - 1))
        seen1, seen2 = order1[slot1].astype(np.int64), order2[slot2].astype(np.int64)
        guess1, sure1, guess2, sure2 = seen1 >> 2, seen1 & 3, seen2 >> 2, seen2 & 3
        agree = (guess1 == guess2) & (sure1 > 0)
        symbol = ids[:n, t].copy()
        found = np.zeros(n, bool)
        i = np.flatnonzero(sure2)
        if len(i):
            k = i * 8 + agree[i]
            hit = yes_or_no(i, chance["two"], chance["one"], k + 2 * sure2[i], k + 2 * sure1[i], weight["first"], symbol[i] == guess2[i])
            found[i[hit]] = True
            symbol[i[hit]] = guess2[i[hit]]
        i = np.flatnonzero((sure1 > 0) & ~found & ~(agree & (sure2 > 0)))
        if len(i):
            hit = yes_or_no(i, chance["one_alone"], chance["none"], i * 8 + sure1[i], i * 8, weight["second"], symbol[i] == guess1[i])
            found[i[hit]] = True
            symbol[i[hit]] = guess1[i[hit]]
        i = np.flatnonzero(~found)
        if len(i):
            part = coder.range[i] // below[i, 256]
            if writing:
                high = symbol[i] >> 8
            else:
                target = np.minimum(coder.value[i] // part, below[i, 256] - 1)
                high = np.zeros(len(i), np.int64)
                for step in (128, 64, 32, 16, 8, 4, 2, 1):
                    high += np.where(below[i, high + step] <= target, step, 0)
            start = below[i, high]
            coder.code(i, start, below[i, high + 1] - start, part)
            part = coder.range[i] >> 8
            low = symbol[i] & 255 if writing else np.minimum(coder.value[i] // part, 255)
            coder.code(i, low, np.ones(len(i), np.int64), part)
            symbol[i] = high << 8 | low
        ids[:n, t] = symbol
        counts[lane, symbol >> 8] += STEP
        for table, slot, seen, guess, sure in ((order1, slot1, seen1, guess1, sure1), (order2, slot2, seen2, guess2, sure2)):
            right = (guess == symbol) & (sure > 0)
            table[slot] = np.where(right, seen + (sure < 3), np.where(sure > 1, seen - 1, symbol << 2 | 1))
        last2[:n], last1[:n] = one.copy(), symbol
    return ids


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Payload of each block of ids."""
    lengths = np.array([len(b) for b in blocks], np.int64)
    if any(len(b) and (b.min() < 0 or b.max() >= MAX_ID) for b in blocks):
        raise ValueError("ids must be from 0 to 65535")
    order = np.argsort(-lengths, kind="stable")
    ids = np.zeros((len(blocks), int(lengths.max(initial=0))), np.int64)
    for row, k in enumerate(order.tolist()):
        ids[row, : lengths[k]] = blocks[k]
    coder = _Encoder(len(blocks), ids.shape[1])
    _walk(lengths[order], ids, coder)
    out: list[bytes] = [b""] * len(blocks)
    for k, payload in zip(order.tolist(), coder.finish(), strict=True):
        out[k] = payload
    return out


def decode(payloads: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """Ids of each block, from its payload and its number of ids."""
    sizes = np.array(lengths, np.int64)
    order = np.argsort(-sizes, kind="stable")
    ids = _walk(sizes[order], None, _Decoder([payloads[k] for k in order.tolist()]))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(payloads)
    for row, k in enumerate(order.tolist()):
        out[k] = ids[row, : sizes[k]].copy()
    return out
