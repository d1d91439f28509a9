"""Array code for texts: Arrow arrays in, NumPy arrays out.

Kernels work on slices of a megabyte of text, so their memory doesn't depend on how Spark cuts batches, only on the
longest single text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

SLICE = 1 << 20
FNV_START, FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
_WORDS = regex.compile(r"[\p{Alphabetic}\p{N}]+")
_MARKED_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[pa.Array]:
    """The array in parts of at most so many bytes, each of one text at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = done = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
        yield texts.slice(at, to - at)
        at, done = to, int(size[to - 1])


def by_slice(run: Callable[[pa.Array], pa.Array], dtype: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    def whole(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], dtype), *map(run, slices(texts))])

    return whole


@cache
def _class(pattern: str) -> np.ndarray:
    """Which code points match, as a table."""
    out = np.zeros(0x110000, bool)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        for m in regex.finditer(f"{pattern}+", "".join(map(chr, range(low, high)))):
            out[low + m.start() : low + m.end()] = True
    return out


def letters_and_digits() -> np.ndarray:
    return _class(r"[\p{Alphabetic}\p{N}]")


def spaces() -> np.ndarray:
    return _class(r"\p{White_Space}")


def tokens(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case."""
    return _WORDS.findall(text.lower()) if text else []


def fnv(words: list[str]) -> np.ndarray:
    """FNV-1a of each word's UTF-8."""
    raw = [w.encode() for w in words]
    size = np.array([len(b) for b in raw], np.int64)
    order = np.argsort(-size, kind="stable")
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    start = (np.cumsum(size) - size)[order]
    size = size[order]
    h = np.full(len(raw), FNV_START)
    for i in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -i, "left"))
        h[:n] = (h[:n] ^ data[start[:n] + i]) * FNV_PRIME
    out = np.empty_like(h)
    out[order] = h
    return out


def hashed_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every token, and where each text's begin, and their number.

    A token is a run of letters, marks and digits, each lowered by itself, as in the SQL of the near-duplicates.
    """
    vocabulary: dict[str, int] = {}
    ids, starts = [], [0]
    for text in pc.utf8_lower(texts).to_pylist():
        ids += [vocabulary.setdefault(t, len(vocabulary)) for t in _MARKED_WORDS.findall(text or "")]
        starts.append(len(ids))
    return fnv(list(vocabulary))[np.array(ids, np.int64)] if ids else np.zeros(0, np.uint64), np.array(starts)


def simhash(texts: pa.Array) -> pa.Array:
    """Bit i is set if at least half of the tokens' hashes have it; a text without tokens has all bits set. Null stays null."""
    h, starts = hashed_tokens(texts)
    total = np.diff(starts)
    out = np.zeros(len(total), np.uint64)
    for bit in range(64):
        ones = np.concatenate(([0], np.cumsum(h >> np.uint64(bit) & np.uint64(1), dtype=np.int64)))
        out |= (2 * (ones[starts[1:]] - ones[starts[:-1]]) >= total).astype(np.uint64) << np.uint64(bit)
    return pa.array(out.view(np.int64), mask=np.asarray(texts.is_null()))


def token_sets(texts: pa.Array) -> pa.Array:
    """Sorted hashes of each text's distinct tokens."""
    h, starts = hashed_tokens(texts)
    sets = [np.unique(h[a:b]).view(np.int64) for a, b in zip(starts, starts[1:], strict=False)]
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))


def bands(sets: pa.Array, k: int, n_bands: int, mixed: bool) -> pa.Array:
    """The key of each of the bands of each set's MinHash signature.

    The plain family xors a token's hash with a counter, so its functions hardly differ; mixed spreads the bits first.
    """
    h = sets.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
    count = pc.fill_null(pc.list_value_length(sets), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    some = count > 0
    first = (np.cumsum(count) - count)[some]
    rows = -(-k // n_bands)
    out = np.zeros((len(count), -(-k // rows)), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            salt = np.uint64((i + 0x9E3779B185EBCA87) % (1 << 64))
            x = h ^ salt
            if mixed:
                x = (h + salt * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xFF51AFD7ED558CCD)
                x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
                x ^= x >> np.uint64(29)
            low = np.full(len(count), np.uint64(0xFFFFFFFFFFFFFFFF))
            if len(first):
                low[some] = np.minimum.reduceat(x, first)
            out[:, i // rows] = out[:, i // rows] * np.uint64(1315423911) ^ low
    offsets = np.arange(len(count) + 1) * out.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out.ravel().view(np.int64)))


def term_counts(texts: pa.Array) -> pa.Array:
    """(hash, count) of each text's tokens, sorted by hash."""
    h, starts = hashed_tokens(texts)
    parts = [np.unique(h[a:b], return_counts=True) for a, b in zip(starts, starts[1:], strict=False)]
    offsets = np.concatenate(([0], np.cumsum([len(k) for k, _ in parts])))
    keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in parts)]).view(np.int64)
    counts = np.concatenate([np.zeros(0, np.int64), *(c for _, c in parts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(keys), pa.array(counts)], ["t", "n"]))


QUALITY = ("ascii_ratio", "entropy", "readability", "unique_tokens", "nonprint_cleanliness", "repeated_bigram_cleanliness", "char_run_cleanliness", "avg_word_len_penalty", "punctuation_balance", "symbol_ratio_penalty")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def quality(texts: pa.Array) -> pa.Array:
    """The components of a text's quality; all 0 for a blank one."""
    strings = [x or "" for x in texts.to_pylist()]
    n_texts = len(strings)
    cp = np.frombuffer("".join(s + "\n" for s in strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    length = np.array([len(s) for s in strings], np.int64)
    starts = np.concatenate(([0], np.cumsum(length + 1)))
    doc = np.repeat(np.arange(n_texts), length + 1)
    inside = np.ones(len(cp), bool)
    inside[starts[1:] - 1] = False
    n = np.maximum(length, 1).astype(float)

    def total(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc[x & inside], minlength=n_texts).astype(float)

    def share(values: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.divide(values, whole, out=np.zeros(n_texts), where=whole > 0)

    seen, times = np.unique((doc << 21 | cp)[inside], return_counts=True)
    of = seen >> 21
    p = times / n[of]
    distinct = np.bincount(of, minlength=n_texts)
    entropy = np.clip(share(np.bincount(of, -p * np.log(p), n_texts), np.log(np.maximum(distinct, 1))), 0, 1)

    alnum = letters_and_digits()[cp] & inside
    edge = np.flatnonzero(np.diff(np.concatenate(([False], alnum, [False])).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    word_doc = doc[begin]
    words = np.bincount(word_doc, minlength=n_texts).astype(float)
    letters = np.bincount(word_doc, end - begin, n_texts)
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(int((end - begin).max(initial=1)) - 1, _MIX | np.uint64(4)))))
        place = np.arange(int((end - begin).sum())) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin)
        spots = np.repeat(begin, end - begin) + place
        value = (cp[spots].astype(np.uint64) + np.uint64(1)) * _MIX
        value = (value ^ value >> np.uint64(31)) * power[place]
        sums = np.add.reduceat(value, np.cumsum(end - begin) - (end - begin)) if len(begin) else value
        keys = np.unique(np.stack([word_doc.astype(np.uint64), sums]), axis=1) if len(begin) else np.zeros((2, 0), np.uint64)
    unique = np.bincount(keys[0].astype(np.int64), minlength=n_texts)

    vowel = np.isin(cp, np.array([ord(c) for c in "aeiouyAEIOUY"]))
    opens = np.concatenate(([0], np.cumsum(vowel & ~np.concatenate(([False], vowel[:-1])))))
    syllables = np.bincount(word_doc, np.maximum(opens[end] - opens[begin], 1), n_texts)
    sentences = np.maximum(total(np.isin(cp, [46, 33, 63])), 1)
    ease = 206.835 - 1.015 * words / sentences - 84.6 * share(syllables, words)

    change = np.concatenate(([True], (cp[1:] != cp[:-1]) | ~inside[1:] | ~inside[:-1]))
    run_start = np.flatnonzero(change)
    run = np.diff(np.append(run_start, len(cp)))
    longest = np.maximum.reduceat(run, np.searchsorted(run_start, starts[:-1]))
    pair = (inside[1:] & inside[:-1]).nonzero()[0]
    seen, times = np.unique(doc[pair] << 42 | cp[pair] << 21 | cp[pair + 1], return_counts=True)
    repeated = np.bincount((seen >> 42)[times > 1], minlength=n_texts)

    uneven, brackets = np.zeros(n_texts), np.zeros(n_texts)
    for a, b in ("()", "[]", "{}"):
        x, y = total(cp == ord(a)), total(cp == ord(b))
        uneven, brackets = uneven + np.abs(x - y), brackets + x + y
    usual = letters_and_digits()[cp] | spaces()[cp] | np.isin(cp, np.array([ord(c) for c in ",.!?;:-'\""]))
    columns = {
        "ascii_ratio": total(cp <= 0x7F) / n, "entropy": entropy, "readability": np.where(words > 0, np.clip(ease / 100, 0, 1), 0), "unique_tokens": share(unique, words),
        "nonprint_cleanliness": 1 - total((cp < 0x20) & (cp != 10) & (cp != 9)) / n, "repeated_bigram_cleanliness": 1 - np.clip(repeated / n, 0, 1),
        "char_run_cleanliness": np.clip(1 - (longest - 1) / np.minimum(n, 200), 0, 1), "avg_word_len_penalty": np.where(words > 0, 1 - np.clip(share(letters, words) / 20, 0, 1), 0),
        "punctuation_balance": 1 - share(uneven, brackets), "symbol_ratio_penalty": 1 - total(~usual) / n,
    }
    blank = np.bincount(doc[inside & ~spaces()[cp]], minlength=n_texts) == 0
    return pa.StructArray.from_arrays([pa.array(np.where(blank, 0.0, columns[c])) for c in QUALITY], list(QUALITY))
