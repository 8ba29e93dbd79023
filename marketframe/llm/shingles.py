"""Word shingles and BagMinHash signatures of many texts at once, in NumPy.

Words are runs of characters other than ASCII white space, lower-cased.  A shingle is
five words in a row; a shorter text has one shingle of all its words.  Weights are
how often a shingle occurs, so similarity is the weighted Jaccard of multisets.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Words per shingle.
SHINGLE = 5
#: Bytes of text hashed at once.
SECTION = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_SHIFTS = tuple(np.uint64(s) for s in (30, 27, 31))
_MULTIPLIERS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_PLACES = np.array(
    [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    dtype=np.uint64,
)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _SHIFTS[0])) * _MULTIPLIERS[0]
    x = (x ^ (x >> _SHIFTS[1])) * _MULTIPLIERS[1]
    return x ^ (x >> _SHIFTS[2])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS.clear()
        for base in (_BASE, inverse):
            factors = np.full(n + 1, base, dtype=np.uint64)
            factors[0] = 1
            _POWERS.append(np.cumprod(factors))
    return _POWERS[0], _POWERS[1]


def normal(text: str | None) -> bytes:
    """Lower-cased words with one space between them."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").split()) if text else b""


def digest(normalised: bytes) -> bytes | None:
    """128-bit identity of a text's words; null without words."""
    return hashlib.md5(normalised).digest() if normalised else None


def word_hashes(normalised: bytes) -> np.ndarray:
    """One hash per word: a polynomial in the word's bytes, finalised."""
    out = []
    at = 0
    while at < len(normalised):
        stop = len(normalised)
        if stop - at > SECTION:
            # sections end between words
            stop = normalised.find(b" ", at + SECTION)
            stop = len(normalised) if stop < 0 else stop
        codes = np.frombuffer(normalised, dtype=np.uint8, count=stop - at, offset=at)
        up, down = _powers(len(codes) + 1)
        gaps = np.flatnonzero(codes == 32)
        starts = np.concatenate([[0], gaps + 1])
        ends = np.concatenate([gaps, [len(codes)]])
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
        out.append(mix((sums[ends] - sums[starts]) * down[starts]))
        at = stop + 1
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of all shingles of one text, in order, repeats included."""
    n = min(SHINGLE, len(words))
    if not n:
        return words
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        total += words[k : k + len(total)] * _PLACES[k]
    return mix(total + np.uint64(n))


def multiset(normalised: bytes) -> np.ndarray:
    """Sorted elements of the text's shingle multiset, all different.

    The i-th occurrence of a shingle is an element of its own, so weighted Jaccard of
    multisets is plain Jaccard of these sets.
    """
    found = np.sort(shingle_hashes(word_hashes(normalised)))
    if len(found) < 2:
        return found
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    if len(first) == len(found):
        return found
    nth = np.arange(len(found)) - np.repeat(first, np.diff(np.append(first, len(found))))
    again = nth > 0
    found[again] = mix(found[again] + nth[again].astype(np.uint64) * _ODD)
    return np.sort(found)


def bag_signatures(texts: list[bytes], size: int) -> np.ndarray:
    """BagMinHash signatures: ``len(texts) x size`` of 32-bit point identities.

    A shingle of weight c owns the unit cells 0..c-1.  Cells are grouped in dyadic
    intervals [0,1), [1,2), [2,4), ...; an interval carries a Poisson process whose
    rate is its length, each point falls on one cell and one signature component at
    random, and counts if its cell is below c.  All randomness is hashed from the
    shingle, interval and number of the point, so two texts share the points of the
    cells both own.  A component is the identity of its earliest point.  Points come
    in order of time and end at a horizon by which all components are very likely
    hit; texts with a component left are done again with a farther one.
    """
    found = [np.sort(shingle_hashes(word_hashes(t))) for t in texts]
    weight = np.array([len(f) for f in found], dtype=np.float64)
    out = np.zeros((len(texts), size), dtype=np.uint32)
    todo, reach = np.arange(len(texts)), np.log(size) + 5.0
    while len(todo):
        which = np.repeat(np.arange(len(todo)), [len(found[i]) for i in todo])
        keys = np.concatenate([found[i] for i in todo])
        first = np.flatnonzero(
            np.concatenate([[True], (keys[1:] != keys[:-1]) | (which[1:] != which[:-1])])
        )
        counts = np.diff(np.append(first, len(keys)))
        keys, which = keys[first], which[first]
        horizon = reach * size / weight[todo]
        times, points = _earliest(keys, which, counts, horizon, len(todo), size)
        done = np.isfinite(times).all(axis=1)
        out[todo[done]] = points[done]
        todo, reach = todo[~done], reach * 2
    return out


def _earliest(keys, which, counts, horizon, texts: int, size: int):
    """Time and identity of the earliest point of each component."""
    streams, owners, rates, limits = [], [], [], []
    low, length, level = 0, 1, 0
    salts = np.arange(1, 65, dtype=np.uint64) * _ODD
    live = np.arange(len(keys))
    while len(live):
        streams.append(mix(keys[live] ^ salts[level]))
        owners.append(which[live])
        rates.append(np.full(len(live), float(length)))
        limits.append(counts[live] - low)
        low, length, level = low + length, max(1, low + length), level + 1
        live = live[counts[live] > low]
    stream, owner = np.concatenate(streams), np.concatenate(owners)
    rate, limit = np.concatenate(rates), np.concatenate(limits)
    ends = horizon[owner]
    # streams are drawn in blocks of about as many points as they are expected to have
    block = np.exp2(np.ceil(np.log2(np.maximum(rate * ends, 1.0)))).astype(np.int64)
    block = np.minimum(block, 4096)
    slots, times, points = [], [], []
    for width in np.unique(block):
        at = np.flatnonzero(block == width)
        clock, start = np.zeros(len(at)), np.uint64(1)
        while len(at):
            steps = (np.arange(width, dtype=np.uint64) + start) * _ODD
            draw = mix(stream[at][:, None] + steps)
            unit = ((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53
            time = np.cumsum(np.log(unit) / -rate[at][:, None], axis=1) + clock[:, None]
            row, column = np.nonzero(time <= ends[at][:, None])
            mine = at[row]
            place = mix(draw[row, column] ^ _PLACES[0])
            cell = ((place >> np.uint64(40)).astype(np.float64) * 2.0**-24 * rate[mine]).astype(
                np.int64
            )
            counted = cell < limit[mine]
            component = (place[counted] & np.uint64(0xFFFFFFFF)) % np.uint64(size)
            slots.append(owner[mine[counted]] * size + component.astype(np.int64))
            times.append(time[row[counted], column[counted]])
            points.append(mix(place[counted]).astype(np.uint32))
            clock, start = time[:, -1], start + np.uint64(width)
            more = clock <= ends[at]
            at, clock = at[more], clock[more]
    slot, time, point = np.concatenate(slots), np.concatenate(times), np.concatenate(points)
    best = np.full(texts * size, np.inf)
    np.minimum.at(best, slot, time)
    won = time == best[slot]
    winner = np.zeros(texts * size, dtype=np.uint32)
    winner[slot[won]] = point[won]
    return best.reshape(texts, size), winner.reshape(texts, size)


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit hash per text and band."""
    grouped = signatures.astype(np.uint64).reshape(len(signatures), bands, rows)
    total = np.zeros((len(signatures), bands), dtype=np.uint64)
    for r in range(rows):
        total = mix(total * _ODD + grouped[:, :, r] + np.uint64(1))
    total += np.arange(1, bands + 1, dtype=np.uint64) * _PLACES[1]
    return mix(total).view(np.int64)


def overlaps(one: np.ndarray, many: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Common elements of the sorted set ``one`` with each set of the joined ``many``."""
    at = np.searchsorted(one, many)
    at[at == len(one)] = 0
    hit = (one[at] == many).astype(np.int64) if len(one) else np.zeros(len(many), np.int64)
    return np.add.reduceat(hit, starts) if len(starts) else np.empty(0, np.int64)
