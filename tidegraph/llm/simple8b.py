"""Simple-8b word-aligned coding of unsigned ids, vectorised over blocks.

A 64-bit word is a 4-bit selector (the top bits) and 60 bits of payload; the selector says how many ids of which width
the payload holds. Selector 14 stands for a run of zeros without payload, selector 15 is an escape: the next word is
one raw 64-bit id. Ids are coded in blocks of BLOCK; the offset of each block's first word is kept, so blocks are
coded and decoded side by side and any block can be read alone.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128
#: Fixed values of the format: ids in a word and bits for each, by selector.
COUNTS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 120, 1], dtype=np.int64)
WIDTHS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0, 64], dtype=np.int64)
ZEROS, ESCAPE = 14, 15
_PAD = int(COUNTS.max())


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)


def _ahead(a: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(a)
    if k < a.shape[1]:
        out[:, :-k] = a[:, k:]
    return out


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For each place the selector that takes the most ids from there on; places past a block's end fit anything."""
    best = np.where(bits > 60, ESCAPE, 0).astype(np.uint8)
    widest, span = bits, 1
    doubled = {1: bits}
    while span < _PAD:
        doubled[2 * span] = np.maximum(doubled[span], _ahead(doubled[span], span))
        span *= 2
    for s in range(1, ESCAPE):
        c, half = int(COUNTS[s]), 1
        while half * 2 <= c:
            half *= 2
        widest = doubled[half] if half == c else np.maximum(doubled[half], _ahead(doubled[half], c - half))
        best[widest <= WIDTHS[s]] = s
    return best


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offset of each block's first word) of unsigned 64-bit ids."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    padded = np.zeros((blocks, BLOCK + _PAD), np.uint64)
    whole = n // BLOCK
    padded[:whole, :BLOCK] = ids[: whole * BLOCK].reshape(whole, BLOCK)
    padded[whole:, : n - whole * BLOCK] = ids[whole * BLOCK :]
    best = _selectors(_bit_lengths(padded[:, :BLOCK]))
    flat, chosen = padded.reshape(-1), best.reshape(-1)
    lane, at, slot = np.arange(blocks), np.arange(blocks) * BLOCK, np.zeros(blocks, np.int64)
    end = np.minimum(at + BLOCK, n)
    used, steps = np.zeros(blocks, np.int64), []
    while len(lane):  # one word for each block that isn't done
        sel = chosen[at]
        steps.append((lane, at, slot, sel))
        slot = slot + 1 + (sel == ESCAPE)
        at = at + COUNTS[sel]
        left = at < end
        if not left.all():
            used[lane[~left]] = slot[~left]
            lane, at, slot, end = lane[left], at[left], slot[left], end[left]
    first = np.zeros(blocks + 1, np.int64)
    np.cumsum(used, out=first[1:])
    words = np.zeros(int(first[-1]), np.uint64)
    lane, at, slot, sel = (np.concatenate(x) for x in zip(*steps, strict=True))
    slot += first[lane]
    at += lane * _PAD  # places in the padded blocks
    for s in np.unique(sel):
        of = np.flatnonzero(sel == s)
        word, here = np.full(len(of), np.uint64(int(s) << 60), np.uint64), at[of]
        if s == ESCAPE:
            words[slot[of] + 1] = flat[here]
        elif s != ZEROS:
            for k in range(int(COUNTS[s])):
                word |= flat[here + k] << np.uint64(k * int(WIDTHS[s]))
        words[slot[of]] = word
    return words, first[:-1].astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids back from words and block offsets."""
    words = np.asarray(words, dtype=np.uint64)
    if not n:
        return np.zeros(0, np.uint64)
    blocks = len(offsets)
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (sel == ESCAPE).any():
        starts = {int(x) for x in offsets}
        after = False
        for i in range(len(words)):  # a raw word may look like any selector, so only a walk tells them apart
            if after and i not in starts:
                raw[i], after = True, False
            else:
                after = sel[i] == ESCAPE
    counts = np.where(raw, 0, COUNTS[sel])
    before = np.concatenate([[0], np.cumsum(counts)[:-1]])
    block = np.zeros(len(words), np.int64)
    block[offsets[1:].astype(np.int64)] = 1
    block = np.cumsum(block)
    place = before - before[offsets.astype(np.int64)][block]
    out = np.zeros(blocks * BLOCK, np.uint64)
    for s in np.unique(sel[~raw]):
        of = np.flatnonzero((sel == s) & ~raw)
        if s == ZEROS:
            continue
        if s == ESCAPE:
            out[block[of] * BLOCK + place[of]] = words[of + 1]
            continue
        width = int(WIDTHS[s])
        mask = np.uint64((1 << width) - 1)
        for k in range(int(COUNTS[s])):
            inside = place[of] + k < BLOCK
            to = of[inside]
            out[block[to] * BLOCK + place[to] + k] = (words[to] >> np.uint64(k * width)) & mask
    return out[:n]
