"""Operator 1: suffix-array dedup of passages that repeat, within and across documents.

A passage of at least MIN_WORDS words repeats if the same words in the same order come earlier in the corpus. Any such
passage holds an anchor: the K words whose hash is least in a window are an anchor wherever these words occur, and a
window never is longer than the passage. Anchors that occur once drop out; around the others, as many words as a passage
can reach are brought together. There the suffixes that begin at the anchors are sorted by mergesort: two suffixes are
compared by binary search over prefix polynomial hashes for the length of their common extension and then by the next
word, so a comparison takes the logarithm of the length. Neighbours in the suffix array with a long enough extension,
grouped by the hash of the words before the anchor, are the occurrences of a passage; what is claimed to be equal is
compared byte by byte before it is reported.

At scale: equal texts are one text; of a group of copies, however many, the first alone is searched, and the others are
reported by a join. Texts are shuffled once, by document, for both joins that need them. The shuffle by anchor holds a
few of them per hundred words, the one behind it only the surroundings of those that repeat; equal surroundings within a
document travel once. Passages that many different texts hold, anchored in as many surroundings, meet in one Python
worker; where these are more than SORT_BYTES, they lie in mapped files and their passages are grouped by hashes, one offset
from the anchor after the other, so that the memory is about 100 bytes an occurrence, however long the texts are.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROW_KEY, Prefix, mapped, row_key, slices, table, text_bytes, word_hashes, words, written

MIN_WORDS, K = 50, 16
CHUNK = 6 << 20
#: Words that are compared at once, bytes of surroundings that are sorted at once, rows of a batch of results, and
#: occurrences whose texts are read again at once.
WORDS_AT_ONCE, SORT_BYTES, ROWS_OUT, HITS_AT_ONCE = 1 << 17, 2 << 20, 10_000, 2000


def _window(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width] for each i where it fits, by doubling."""
    at, have = x, 1
    while have * 2 <= width:
        at = op(at[:-have], at[have:])
        have *= 2
    return op(at[: len(x) - width + 1], at[width - have :][: len(x) - width + 1]) if width > have else at


def anchors(h: np.ndarray, first: np.ndarray, end: np.ndarray, min_words: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of each anchor. h: word hashes; first, end: of each text of min_words words or more."""
    out_at, out_key = [], []
    grams = Prefix(h)
    width = min_words - k + 1
    for a, b in zip(first, end, strict=True):
        at = np.arange(a, b - k + 1)
        g = grams.of(at, at + k)
        g = (g ^ g >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        low = _window(g, width, np.minimum)
        # an anchor is the least of some window: the largest least of the windows around it is itself
        pad = np.zeros(width - 1, np.uint64)
        top = _window(np.concatenate((pad, low, pad)), width, np.maximum)
        keep = g == top
        out_at.append(at[keep])
        out_key.append(g[keep])
    if not out_at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_at), np.concatenate(out_key)


def _texts(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, where texts begin, words' first bytes and ends, each text's first word and the end of its words."""
    buf, starts = text_bytes(part.column("text"))
    begin, end, doc = words(buf, starts)
    low = np.searchsorted(doc, np.arange(len(starts)))
    return buf, starts, begin, end, low[:-1], low[1:]


def _anchor_rows(min_words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                buf, _, begin, end, first, last = _texts(part)
                long = np.flatnonzero(last - first >= min_words)
                at, key = anchors(word_hashes(buf, begin, end), first[long], last[long], min_words, k)
                doc = long[np.searchsorted(first[long], at, "right") - 1]
                rk = part.column("k").take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), rk, pa.array((at - first[doc]).astype(np.int32))], names=["anchor", "k", "at"])

    return run


def _extents(min_words: int):
    """Of each text of min_words words or more: how many they are, the first character of the first and the end of the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                buf, starts, begin, end, first, last = _texts(part)
                chars = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
                at = np.flatnonzero(last - first >= min_words)
                zero = chars[starts[at]]
                columns = (last[at] - first[at], chars[begin[first[at]]] - zero, chars[end[last[at] - 1]] - zero)
                yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(at)), *map(pa.array, columns)], names=["k", "n_words", "start_char", "end_char"])

    return run


_KEY = pa.struct([("a", pa.int64()), ("b", pa.int64())])
_AROUND = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("k", _KEY), ("before", pa.int32()), ("text", pa.string()), ("at", pa.list_(pa.int32())), ("char", pa.list_(pa.int64()))])


def _surroundings(min_words: int, k: int):
    """Of each repeated anchor of a document: the words that a passage around it can hold, once for equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                buf, starts, begin, end, first, last = _texts(part)
                data = buf.tobytes()
                chars = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
                out: list[tuple] = []
                held = 0
                for d, (i, rk, found) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "k", "found")), strict=True)):
                    same: dict[tuple[int, int, bytes], tuple] = {}
                    for x in sorted(found, key=lambda x: x["at"]):
                        w = int(first[d]) + x["at"]
                        lo, hi = max(int(first[d]), w - (min_words - k)), min(int(last[d]), w + min_words)
                        text = data[begin[lo] : end[hi - 1]]
                        key = (x["anchor"], w - lo, text)
                        if key not in same:
                            same[key] = (x["anchor"], i, rk, w - lo, text.decode("utf-8", "surrogatepass"), [], [])
                            out.append(same[key])
                            held += len(text)
                        same[key][5].append(x["at"])
                        same[key][6].append(int(chars[begin[lo]] - chars[starts[d]]))
                        if held > CHUNK:  # a text's equal surroundings then travel more than once, which changes nothing
                            yield pa.RecordBatch.from_pylist([dict(zip(_AROUND.names, r, strict=True)) for r in out], _AROUND)
                            out, held, same = [], 0, {}
                yield pa.RecordBatch.from_pylist([dict(zip(_AROUND.names, r, strict=True)) for r in out], _AROUND)

    return run


class Suffixes:
    """Suffixes that begin at given words of a sequence, each of bounded length."""

    def __init__(self, h: np.ndarray, at: np.ndarray, length: np.ndarray):
        self.h, self.at, self.length = np.append(h, np.uint64(0)), at, length
        self.prefix = Prefix(h)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words suffixes i and j have in common from their start: binary search over prefix hashes."""
        a, b = self.at[i], self.at[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.length[i], self.length[j])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.prefix.of(a, a + mid) == self.prefix.of(b, b + mid)
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
        return low

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before j: by the hash of the first word in which they differ; one that ends sooner comes first."""
        n = self.common(i, j)
        x, y = self.length[i], self.length[j]
        ended = (n >= x) | (n >= y)
        return np.where(ended, x < y, self.h[self.at[i] + n] < self.h[self.at[j] + n])

    def sort(self) -> np.ndarray:
        """The suffix array, by mergesort from single suffixes up; all merges of a level at once."""
        n = len(self.at)
        order, width = np.arange(n), 1
        place = np.arange(n)
        while width < n:
            run = place // width
            other = np.minimum((run ^ 1) * width, n)
            low, high = other.copy(), np.minimum(other + width, n)
            left = run % 2 == 0
            while True:  # of each suffix: how many of the run to be merged with come before it
                on = np.flatnonzero(low < high)
                if not len(on):
                    break
                mid = (low[on] + high[on]) >> 1
                mine, theirs = order[on], order[mid]
                swap = left[on]
                # a suffix of the left run goes first among equals
                earlier = self.before(np.where(swap, theirs, mine), np.where(swap, mine, theirs))
                earlier = np.where(swap, earlier, ~earlier)
                low[on] = np.where(earlier, mid + 1, low[on])
                high[on] = np.where(earlier, high[on], mid)
            new = np.empty(n, np.int64)
            new[np.minimum(run * width, other) + (place - run * width) + (low - other)] = order
            order, width = new, width * 2
        return order


class Verify:
    """Exact comparison of stretches of words."""

    def __init__(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.buf, self.begin, self.size = buf, begin, end - begin

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from word a on are those from b on, byte for byte; equal claims are compared once, a few at a time."""
        key = np.stack([a, b, n])
        by = np.lexsort(key)
        new = np.concatenate(([True], (np.diff(key[:, by]) != 0).any(0)))[: len(by)]
        once, words = by[new], np.cumsum(n[by[new]])
        parts, at = [np.zeros(0, bool)], 0
        while at < len(once):
            to = max(at + 1, int(np.searchsorted(words, (words[at - 1] if at else 0) + WORDS_AT_ONCE, "right")))
            parts.append(self._same(*key[:, once[at:to]]))
            at = to
        out = np.empty(len(a), bool)
        out[by] = np.concatenate(parts)[np.cumsum(new) - 1]
        return out

    def _same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        of = np.repeat(np.arange(len(a)), n)
        if not len(of):
            return out
        step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        x, y = a[of] + step, b[of] + step
        equal = self.size[x] == self.size[y]
        np.logical_and.at(out, of[~equal], False)
        x, y, of = x[equal], y[equal], of[equal]
        size = self.size[x]
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        differ = self.buf[np.repeat(self.begin[x], size) + step] != self.buf[np.repeat(self.begin[y], size) + step]
        out[np.repeat(of, size)[differ]] = False
        return out


def ranks(ids: pa.Array, k: pa.Array) -> np.ndarray:
    """Documents' places in the order of ids, null last, then keys."""
    none = np.asarray(ids.is_null())
    ids, ks = ids.fill_null(0).to_numpy(), [x.to_numpy() for x in k.flatten()]
    by = np.lexsort((ks[1], ks[0], ids, none))
    new = np.ones(len(by), bool)
    new[1:] = (ids[by][1:] != ids[by][:-1]) | (ks[0][by][1:] != ks[0][by][:-1]) | (ks[1][by][1:] != ks[1][by][:-1]) | (none[by][1:] != none[by][:-1])
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new)
    return rank


def repeats(batch: pa.RecordBatch, min_words: int, k: int) -> dict[str, np.ndarray]:
    """The intervals around each anchor that earlier occurrences cover. batch: rows of _AROUND, all of each anchor in it."""
    buf, starts, begin, end, first, last = _texts(batch)
    h = word_hashes(buf, begin, end)
    left = batch.column("before").to_numpy().astype(np.int64)
    at = first + left
    suffixes = Suffixes(h, at, np.minimum(last - at, min_words))
    check = Verify(buf, begin, end)
    order = suffixes.sort()
    near = suffixes.common(order[:-1], order[1:])
    claimed = np.flatnonzero(near >= k)
    wrong = claimed[~check.same(at[order[claimed]], at[order[claimed + 1]], near[claimed])]
    for x in wrong:  # a collision: count the words that really agree
        i, j = at[order[x]], at[order[x + 1]]
        one, n = np.ones(1, np.int64), 0
        while n < near[x] and check.same(np.array([i + n]), np.array([j + n]), one)[0]:
            n += 1
        near[x] = n

    rank = ranks(batch.column("doc_id"), batch.column("k"))
    count = np.diff(batch.column("at").offsets.to_numpy())
    of = np.repeat(np.arange(len(at)), count)
    place = batch.column("at").flatten().to_numpy().astype(np.int64)
    char = batch.column("char").flatten().to_numpy().astype(np.int64)
    lowest = place[np.cumsum(count) - count]
    when = rank << 32 | lowest

    high = np.full(len(of), -1)
    low = np.full(len(of), min_words)
    source = np.zeros((2, len(of)), np.int64)
    several = count > 1
    for o in range(min_words - k + 1):
        run = np.cumsum(np.concatenate(([0], near < min_words - o)))
        fits = (left[order] >= o) & (suffixes.length[order] >= min_words - o)
        some = np.flatnonzero(fits)
        member, run = order[some], run[some]
        share = np.bincount(run)[run] > 1
        member, run = member[share | several[member]], run[share | several[member]]
        if not len(member):
            continue
        before = suffixes.prefix.of(at[member] - o, at[member])
        by = np.lexsort((when[member], before, run))
        member, run, before = member[by], run[by], before[by]
        head = np.concatenate(([True], (run[1:] != run[:-1]) | (before[1:] != before[:-1])))
        earliest = np.full(len(at), -1)
        earliest[member] = member[np.flatnonzero(head)][np.cumsum(head) - 1]
        e = earliest[of]
        again = (e >= 0) & ((rank[of] != rank[e]) | (place - lowest[e] >= min_words))
        spot = np.flatnonzero(again)
        source[0, spot] = e[spot]
        high[spot] = o
        unset = spot[low[spot] == min_words]
        source[1, unset] = e[unset]
        low[unset] = o
    hit = np.flatnonzero(high >= 0)
    for far, which in ((high, 0), (low, 1)):
        hit = hit[check.same(at[of[hit]] - far[hit], at[source[which, hit]] - far[hit], far[hit])]
    chars = np.zeros(len(buf) + 1, np.int32 if len(buf) < 1 << 31 else np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
    m, f = of[hit], source[0, hit]
    zero = char[hit] - chars[starts[m]]
    b, e = at[m] - high[hit], at[m] - low[hit] + min_words - 1
    return {
        "row": m, "start_word": place[hit] - high[hit], "end_word": place[hit] - low[hit] + min_words, "start_char": zero + chars[begin[b]], "end_char": zero + chars[end[e]],
        "first_row": f, "first_word": lowest[f] - high[hit],
    }


def repeats_of_many(rows: pa.Table, min_words: int, k: int) -> Iterator[dict[str, np.ndarray]]:
    """What repeats() gives, in parts, of one anchor with more surroundings than are sorted in memory.

    rows: a mapped file. The passages of each row are hashed, those of each offset go to a mapped file; then one offset
    after the other the rows are grouped by them. Texts are read again, a few at a time, to compare what is claimed.
    """
    offsets, n = min_words - k + 1, rows.num_rows
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    hashes = mapped(offsets * n, np.uint64).reshape(offsets, n)
    done = 0
    for batch in rows.to_batches():
        for part in slices(batch):
            buf, _, begin, end, first, last = _texts(part)
            to = done + part.num_rows
            at = first + part.column("before").to_numpy()
            left[done:to], right[done:to] = at - first, last - at
            prefix = Prefix(word_hashes(buf, begin, end))
            for o in range(offsets):
                some = np.flatnonzero((left[done:to] >= o) & (right[done:to] >= min_words - o))
                hashes[o, done + some] = prefix.of(at[some] - o, at[some] - o + min_words)
            done = to
    rank = ranks(rows["doc_id"].combine_chunks(), rows["k"].combine_chunks())
    spots, chars = rows["at"].combine_chunks(), rows["char"].combine_chunks()
    count = spots.value_lengths().to_numpy().astype(np.int64)
    of = np.repeat(np.arange(n), count)
    place, char = spots.flatten().to_numpy().astype(np.int64), chars.flatten().to_numpy()
    lowest = place[np.cumsum(count) - count]
    when = rank << 32 | lowest
    high, low = np.full(len(of), -1), np.full(len(of), min_words)
    source = np.zeros((2, len(of)), np.int64)
    for o in range(offsets):
        member = np.flatnonzero((left >= o) & (right >= min_words - o))
        if not len(member):
            continue
        h = hashes[o, member]
        by = np.lexsort((when[member], h))
        head = np.concatenate(([True], h[by][1:] != h[by][:-1]))
        earliest = np.full(n, -1)
        earliest[member[by]] = member[by][np.flatnonzero(head)][np.cumsum(head) - 1]
        e = earliest[of]
        spot = np.flatnonzero((e >= 0) & ((rank[of] != rank[e]) | (place - lowest[e] >= min_words)))
        source[0, spot] = e[spot]
        high[spot] = o
        unset = spot[low[spot] == min_words]
        source[1, unset] = e[unset]
        low[unset] = o
    hits = np.flatnonzero(high >= 0)
    begins = np.cumsum([0, *map(len, rows["text"].chunks)])
    for x in range(0, len(hits), HITS_AT_ONCE):
        hit = hits[x : x + HITS_AT_ONCE]
        used, back = np.unique(np.concatenate([of[hit], source[0, hit], source[1, hit]]), return_inverse=True)
        m, *sources = back.reshape(3, -1)
        cut = np.searchsorted(used, begins)
        texts = pa.concat_arrays([c.take(pa.array(used[i:j] - z)) for c, i, j, z in zip(rows["text"].chunks, cut[:-1], cut[1:], begins[:-1], strict=True) if i < j])
        buf, starts, begin, end, first, _ = _texts(pa.RecordBatch.from_arrays([texts], names=["text"]))
        at, check = first + left[used], Verify(buf, begin, end)
        ok = np.ones(len(hit), bool)
        for far, f in zip((high[hit], low[hit]), sources, strict=True):
            ok &= check.same(at[m] - far, at[f] - far, np.full(len(hit), min_words))
        hit, m = hit[ok], m[ok]
        to = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=to[1:])
        zero, f = char[hit] - to[starts[m]], source[0, hit]
        b, e = at[m] - high[hit], at[m] - low[hit] + min_words - 1
        yield {
            "row": of[hit], "start_word": place[hit] - high[hit], "end_word": place[hit] - low[hit] + min_words, "start_char": zero + to[begin[b]], "end_char": zero + to[end[e]],
            "first_row": f, "first_word": lowest[f] - high[hit],
        }


def by_anchor(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch | pa.Table]:
    """Rows sorted by anchor, cut so that no anchor is in two parts: batches of about so many bytes of text, and of an
    anchor that has more a table in a mapped file."""
    held: list[pa.RecordBatch] = []
    size, spool = 0, None
    with tempfile.TemporaryDirectory(prefix="corpusmill-") as at:

        def read() -> pa.Table:
            spool.close()
            out = pa.ipc.open_file(pa.memory_map(f"{at}/rows")).read_all()
            os.unlink(f"{at}/rows")  # the mapping outlives the name
            return out

        for part in (part for batch in batches for part in slices(batch)):
            if spool:
                n = int(np.searchsorted(part.column(0).to_numpy(), anchor, "right"))
                if n:
                    spool.write_batch(part.slice(0, n))
                if n == part.num_rows:
                    continue
                yield read()
                spool, part = None, part.slice(n)
            held.append(part)
            size += pc.sum(pc.binary_length(part.column("text"))).as_py()
            if size < limit:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = whole.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut:
                yield whole.slice(0, cut)
            held = [whole.slice(cut)]
            size = pc.sum(pc.binary_length(held[0].column("text"))).as_py()
            if size >= limit:
                spool, anchor = pa.ipc.new_file(f"{at}/rows", whole.schema), key[-1]
                spool.write_batch(held[0])
                held, size = [], 0
        if spool:
            yield read()
        elif held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _intervals(min_words: int, k: int, limit: int = SORT_BYTES):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_anchor(batches, limit):
            ids, ks = ((x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x) for x in (rows.column("doc_id"), rows.column("k")))
            for got in repeats_of_many(rows, min_words, k) if isinstance(rows, pa.Table) else [repeats(rows, min_words, k)]:
                for at in range(0, len(got["row"]), ROWS_OUT):
                    some = {c: x[at : at + ROWS_OUT] for c, x in got.items()}
                    m, f = pa.array(some["row"]), pa.array(some["first_row"])
                    columns = [ids.take(m), ks.take(m), *(pa.array(some[c], pa.int64()) for c in ("start_word", "end_word", "start_char", "end_char")), ids.take(f), pa.array(some["first_word"], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k", "start_word", "end_word", "start_char", "end_char", "first_doc_id", "first_word"])

    return run


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, k: int = K, sort_bytes: int = SORT_BYTES) -> DataFrame:
    """Rows (doc_id, start_word, end_word, start_char, end_char, first_doc_id, first_word): every stretch of a document
    that consists of passages of min_words words that come earlier, and where the first of these comes first.

    Words are runs of other characters than space, tab, line and form feed and carriage return; what is between them
    doesn't count. Earlier means a document of smaller id (null last, then by a hash of id and text) or, in the same
    document, at least min_words words before, so a passage doesn't repeat itself by overlapping. The first occurrence
    of a passage is no repeat. Stretches that touch or overlap are one.
    Null cases: null and empty texts, and those of fewer than min_words words, repeat nothing; null ids are reported as
    null; rows equal in id and text are one document; ties of id are ordered by a hash of id and text; texts are read
    whole, however long; an empty table gives an empty one. Other columns are not read. sort_bytes: anchors with more
    bytes of surroundings are worked on in mapped files, with the same result.
    """
    if not 1 <= k <= min_words:
        raise ValueError("k must lie between 1 and min_words")
    rows = docs.filter("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", row_key().alias("k"))
    # of equal texts the first, and how many documents have them
    same = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("other"), "text").alias("b"))
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")
    member = written(rows.select(same.alias("same"), who.alias("who")).distinct(), "suffix-texts")
    first = written(member.groupBy("same").agg(F.min("who").alias("first"), F.count("*").alias("n")), "suffix-first")
    only = first.select(F.col("first.k").alias("k"), "n")

    def of(some: DataFrame) -> DataFrame:
        """The texts of some, by shuffled keys: the same exchange of texts each time."""
        return rows.join(some.hint("shuffle_hash"), "k", "left_semi").select("doc_id", "text", "k")

    found = of(only.select("k")).mapInArrow(_anchor_rows(min_words, k), f"anchor bigint, k {ROW_KEY}, at int")
    found = found.withColumn("n", F.count("*").over(W.partitionBy("anchor"))).filter("n > 1")
    found = found.groupBy("k").agg(F.array_distinct(F.collect_list(F.struct("anchor", "at"))).alias("found"))
    around = rows.join(found.hint("shuffle_hash"), "k").select("doc_id", "k", "text", "found").mapInArrow(_surroundings(min_words, k), f"anchor bigint, doc_id bigint, k {ROW_KEY}, before int, text string, at array<int>, char array<bigint>")
    parts = around.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_intervals(min_words, k, sort_bytes), f"doc_id bigint, k {ROW_KEY}, start_word bigint, end_word bigint, start_char bigint, end_char bigint, first_doc_id bigint, first_word bigint")
    order = W.partitionBy("k", "doc_id").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(order.rowsBetween(W.unboundedPreceding, -1))
    parts = parts.withColumn("new", F.when(reach >= F.col("start_word"), 0).otherwise(1))
    parts = parts.withColumn("stretch", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = parts.groupBy("k", "doc_id", "stretch").agg(
        F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"),
        F.min(F.struct("start_word", F.col("first_doc_id").isNull().alias("none"), "first_doc_id", "first_word")).alias("first"))
    names = ["doc_id", "start_word", "end_word", "start_char", "end_char"]
    out = written(out.select("k", *names, F.col("first.first_doc_id").alias("first_doc_id"), F.col("first.first_word").alias("first_word")), "suffix-stretches")
    # a later copy is one stretch, and its first passage comes first where that of the first copy does
    extents = of(only.filter("n > 1").select("k")).mapInArrow(_extents(min_words), f"k {ROW_KEY}, n_words bigint, start_char bigint, end_char bigint")
    begun = out.filter("start_word = 0").select("k", "first_doc_id", "first_word", F.lit(True).alias("begun"))
    known = extents.join(begun, "k", "left").withColumnRenamed("k", "known")
    later = member.join(first.filter("n > 1"), "same").filter("who.k <> first.k").join(known, F.col("first.k") == F.col("known"))
    copies = later.select(
        "who.doc_id", F.lit(0).cast("bigint").alias("start_word"), F.col("n_words").alias("end_word"), "start_char", "end_char",
        F.when(F.col("begun"), F.col("first_doc_id")).otherwise(F.col("first.doc_id")).alias("first_doc_id"), F.coalesce("first_word", F.lit(0)).alias("first_word"))
    return out.drop("k").unionByName(copies)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir))


SQL = r"""
with parts as (select doc_id, regexp_extract_all(text, '\s*\S+') as p, regexp_extract_all(text, '\S+') as w from documents),
h1 as (select doc_id, unnest(range(0, len(w))) as i, unnest(w) as w, len(w) as n from parts where len(w) >= 50),
h2 as (select doc_id, i, n, hash(w) as a, hash(w, lead(w) over o) as b from h1 window o as (partition by doc_id order by i)),
h4 as (select *, hash(b, lead(b, 2) over o) as c from h2 window o as (partition by doc_id order by i)),
h8 as (select *, hash(c, lead(c, 4) over o) as d from h4 window o as (partition by doc_id order by i)),
h16 as (select *, hash(d, lead(d, 8) over o) as e from h8 window o as (partition by doc_id order by i)),
h32 as (select *, hash(e, lead(e, 16) over o) as g from h16 window o as (partition by doc_id order by i)),
keyed as (select doc_id, i, n, hash(g, lead(e, 32) over o, lead(b, 48) over o) as t from h32 window o as (partition by doc_id order by i)),
f as (select doc_id, i, min((doc_id, i)) over (partition by t) as first from keyed where i <= n - 50),
rep as (select doc_id, i, first from f where doc_id <> first[1] or i - first[2] >= 50),
cut as (select *, case when lag(i) over (partition by doc_id order by i) + 50 >= i then 0 else 1 end as new from rep),
str as (select *, sum(new) over (partition by doc_id order by i rows unbounded preceding) as s from cut),
spans as (select doc_id, min(i) as start_word, max(i) + 50 as end_word, arg_min(first, i) as first from str group by doc_id, s),
chars as (select doc_id, unnest(range(0, len(w))) as j, unnest(p) as p, unnest(w) as w from parts where doc_id in (select doc_id from spans)),
ends as (select doc_id, j, sum(length(p)) over (partition by doc_id order by j rows unbounded preceding) as e, length(w) as n from chars)
select s.doc_id, start_word, end_word, (a.e - a.n)::bigint as start_char, b.e::bigint as end_char, first[1] as first_doc_id, first[2] as first_word
from spans s join ends a on a.doc_id = s.doc_id and a.j = s.start_word join ends b on b.doc_id = s.doc_id and b.j = s.end_word - 1
"""
