"""Word shingles of whole texts as 64-bit hashes, vectorised over many texts at a time."""

from __future__ import annotations

import numpy as np

WORDS = 5
CHUNK = 1 << 21

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _BASE + _U(seed)) | _U(1)


_PLACE = constants(WORDS, 5)
_POWERS = [np.ones(1, _U)]


def powers(n: int) -> np.ndarray:
    have = _POWERS[0]
    if len(have) < n:
        have = np.full(max(n, CHUNK + 1), _BASE, _U)
        have[0] = 1
        have = _POWERS[0] = np.multiply.accumulate(have)
    return have


def _words(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of one buffer."""
    a = np.frombuffer(buf, np.uint8)
    space = _IS_SPACE[a]
    edge = np.diff(np.concatenate([[True], space, [True]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, _U), starts
    p = powers(len(a) + 1)
    total = np.concatenate([[_U(0)], np.cumsum((a.astype(_U) + _U(1)) * p[: len(a)], dtype=_U)])
    h = (total[ends] - total[starts]) * p[len(a) - starts]
    # words at other places of the buffer have the same hash: all are scaled to its end
    return mix(h * _inverse(len(a)) ^ (ends - starts).astype(_U)), starts


def _inverse(n: int) -> np.uint64:
    return _U(pow(pow(int(_BASE), n, 1 << 64), -1, 1 << 64))


def _pieces(raw: bytes) -> list[bytes]:
    """raw, cut before spaces into pieces of about CHUNK bytes."""
    out, at = [], 0
    while len(raw) - at > CHUNK:
        end = next((k for k in range(at + CHUNK, len(raw)) if _IS_SPACE[raw[k]]), len(raw))
        out.append(raw[at:end])
        at = end
    return [*out, raw[at:]]


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): text k's distinct shingles, ascending, are hashes[bounds[k]:bounds[k + 1]].

    A-Z are lowered and words are what ASCII white space leaves; a text of fewer words than WORDS
    has its whole word sequence as one shingle, one without words has none. Null counts as empty.
    """
    with np.errstate(over="ignore"):
        sets: list[np.ndarray] = []
        group: list[bytes] = []
        size = 0
        for t in [*texts, ...]:
            raw = None if t is ... else (t or "").encode().lower()
            if group and (raw is None or size + len(raw) > CHUNK):
                sets += _sets(group)
                group, size = [], 0
            if raw is not None:
                if len(raw) > CHUNK:
                    words = np.concatenate([_words(p)[0] for p in _pieces(raw)])
                    sets.append(_of_words(words))
                else:
                    group.append(raw)
                    size += len(raw) + 1
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
        return (np.concatenate(sets) if sets else np.empty(0, _U)), bounds


def _of_words(w: np.ndarray) -> np.ndarray:
    if not len(w):
        return w
    n = len(w) - WORDS + 1
    if n < 1:
        return mix(np.add.reduce(w * _PLACE[: len(w)], keepdims=True) + _U(len(w)))
    total = w[:n] * _PLACE[0]
    for k in range(1, WORDS):
        total += w[k : k + n] * _PLACE[k]
    return np.unique(mix(total))


def _sets(raws: list[bytes]) -> list[np.ndarray]:
    words, starts = _words(b" ".join(raws))
    ends = np.cumsum([len(r) + 1 for r in raws])
    at = np.concatenate([[0], np.searchsorted(starts, ends)])
    long = np.empty(0, _U)
    if len(words) >= WORDS:
        n = len(words) - WORDS + 1
        long = words[:n] * _PLACE[0]
        for k in range(1, WORDS):
            long += words[k : k + n] * _PLACE[k]
        long = mix(long)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out.append(np.unique(long[a : b - WORDS + 1]) if b - a >= WORDS else _of_words(words[a:b]))
    return out


def signatures(hashes: np.ndarray, bounds: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """MinHash values (uint32) of the sets, a row each; the sets must not be empty."""
    a, b = constants(k, seed), constants(k, seed + 1)
    out = np.empty((len(bounds) - 1, k), np.uint32)
    with np.errstate(over="ignore"):
        step = 1 << 18
        lo = 0
        while lo < len(bounds) - 1:
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + step, "right")) - 1)
            part, cuts = hashes[bounds[lo] : bounds[hi]], bounds[lo:hi] - bounds[lo]
            for j in range(k):
                out[lo:hi, j] = np.minimum.reduceat(part * a[j] + b[j], cuts) >> _U(32)
            lo = hi
    return out
