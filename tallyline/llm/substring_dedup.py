"""Substring dedup by super-k-mers.

A window is k consecutive words. Its minimiser is the smallest hash among its word pairs; consecutive windows with the
same minimiser travel as one packed string, a super-k-mer, to the bucket of that minimiser, so that a text travels less
than three times instead of k times and all copies of a window meet in one bucket. There the windows are sorted by a
64-bit hash, equal neighbours are compared word for word, and each distinct window gets its smallest document. Only
windows with a smaller document elsewhere are answered.

Very frequent word pairs, found by counting all pairs in classes of their hashes, come last in the order of hashes, so that
no bucket takes a large share of the windows because of one pair; a window of such pairs only goes by its own hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from tallyline.llm.common import count_slices, key_id, mix, pair, session, size_of, sum_slices, text_bytes, text_slices, word_table
from tallyline.llm.exchange import FAN, exchange

WINDOW = 13
#: Bytes of packed strings that one bucket takes on average.
BUCKET_BYTES = 12 << 20
#: Packed strings hold so many times the bytes of the texts, about.
EXPANSION = 3
#: Word pairs are counted by so many leading bits of their hashes; a class with over one in COMMON of all pairs is frequent.
PAIR_BITS, COMMON, COMMON_LEAST = 20, 4096, 10_000
_TOP = np.uint64(1 << 63)


def window_values(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive word hashes, by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out, at, width, level = None, 0, 1, h
    while k:
        if k & 1:
            part = level[at : at + n]
            out = part if out is None else pair(out, part, 7)
            at += width
        k >>= 1
        if k:
            level = pair(level[:-width], level[width:], width) if len(level) > width else level[:0]
            width *= 2
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values."""
    n, level, width = len(x) - w + 1, x, 1
    if n <= 0:
        return x[:0]
    while width * 2 <= w:
        level = np.minimum(level[:-width], level[width:])
        width *= 2
    return np.minimum(level[:n], level[w - width : w - width + n])


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, so many as counted."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def frequent_pairs(docs: DataFrame, least: int = COMMON_LEAST) -> np.ndarray:
    """Which classes of word pairs are frequent in all documents: a table of fixed size."""
    session(docs)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << PAIR_BITS, dtype=np.int64)
        for pdf in frames:
            for part in text_slices(pdf):
                lists = [t.split() for t in part["text"]]
                _, _, h = word_table(b"".join(b" ".join(x) + b" " for x in lists if x))
                doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                pairs = pair(h[:-1], h[1:])[doc[:-1] == doc[1:]]
                counts += np.bincount((pairs >> np.uint64(64 - PAIR_BITS)).astype(np.int64), minlength=len(counts))
        for i, body in count_slices(counts):
            yield pd.DataFrame({"slice": [i], "body": [body]})

    counts = sum_slices(docs.select(text_bytes().alias("text")).mapInPandas(work, "slice int, body binary"), PAIR_BITS).astype(np.int64)
    return counts > max(least, int(counts.sum()) // COMMON)


class Cut:
    """The super-k-mers of one batch; distinct ones in the order in which they are sent."""

    def __init__(self, pdf: pd.DataFrame, k: int, buckets: int, frequent: np.ndarray):
        lists = [t.split() for t in pdf["text"]]
        self.norms = [b" ".join(x) for x in lists]
        self.n_words = np.array([len(x) for x in lists], dtype=np.int64)
        del lists
        buf = b"".join(x + b" " for x in self.norms if x)
        starts, ends, h = word_table(buf)
        self.doc = np.repeat(np.arange(len(self.norms)), self.n_words)
        self.keys = pdf["k"].to_numpy(dtype=np.int64)
        self.total, n = len(h), len(h) - k + 1
        self.entries: list[bytes] = []
        none = np.empty(0, dtype=np.int64)
        self.first = self.count = self.which = self.low = self.widths = self.offset = none
        self.bucket = none
        if n <= 0:
            return
        valid = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        if not len(valid):
            return
        if k > 1:
            pairs = pair(h[:-1], h[1:])
            last = frequent[(pairs >> np.uint64(64 - PAIR_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(63)
            low = sliding_min((pairs >> np.uint64(1)) | last, k - 1)[valid]
            alone = np.flatnonzero(low >= _TOP)
            if len(alone):
                low[alone] = window_values(h, k)[valid[alone]]
        else:
            low = h[valid]
        new = np.ones(len(valid), dtype=bool)
        new[1:] = (np.diff(valid) != 1) | (low[1:] != low[:-1])
        head = np.flatnonzero(new)
        first = valid[head]
        count = np.diff(np.append(head, len(valid)))
        seen: dict[bytes, int] = {}
        which = np.fromiter((seen.setdefault(buf[a:b], len(seen)) for a, b in zip(starts[first].tolist(), ends[first + count + k - 2].tolist(), strict=True)), np.int64, len(first))
        bucket, widths = np.empty(len(seen), dtype=np.int64), np.empty(len(seen), dtype=np.int64)
        bucket[which] = (mix(low[head]) % np.uint64(buckets)).astype(np.int64)
        widths[which] = count
        smallest = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(smallest, which, self.keys[self.doc[first]])
        order = np.argsort(bucket, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        strings = list(seen)
        self.entries = [strings[i] for i in order.tolist()]
        self.first, self.count, self.which = first, count, place[which]
        self.bucket, self.widths, self.low = bucket[order], widths[order], smallest[order]
        self.offset = np.cumsum(self.widths) - self.widths

    def bounds(self) -> list[tuple[int, int, int]]:
        """(bucket, from, to) over the distinct super-k-mers."""
        if not len(self.bucket):
            return []
        at = np.flatnonzero(np.append(True, np.diff(self.bucket) != 0))
        return [(int(self.bucket[a]), int(a), int(b)) for a, b in zip(at, np.append(at[1:], len(self.bucket)), strict=True)]


def pack(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.array([len(parts), *map(len, parts)], dtype="<i8").tobytes(), *parts]))


def unpack(body: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n = int(np.frombuffer(raw[:8], "<i8")[0])
    at, out = 8 + 8 * n, []
    for size in np.frombuffer(raw[8:at], "<i8").tolist():
        out.append(raw[at : at + size])
        at += size
    return out


def smallest_documents(bodies: list[bytes], k: int, value=window_values) -> list[bytes]:
    """For each body of packed super-k-mers: which of its windows have a smaller document elsewhere, and that document."""
    lows, texts, sizes = [], [], []
    for body in bodies:
        low, text = unpack(body)
        lows.append(np.frombuffer(low, "<i8"))
        sizes.append(len(lows[-1]))
        texts.append(text)
    buf = b"".join(texts)  # each string ends with a newline
    del texts
    starts, ends, h = word_table(buf)
    low = np.concatenate(lows)
    last = np.frombuffer(buf, dtype=np.uint8)[ends] == 10
    entry = np.cumsum(last) - last
    n = len(h) - k + 1
    at = np.flatnonzero(entry[:n] == entry[k - 1 :])
    values = value(h, k)[at]
    order = np.argsort(values, kind="stable")
    values, at = values[order], at[order]
    same = np.zeros(len(at) + 1, dtype=bool)
    same[1:-1] = values[1:] == values[:-1]
    at = at[same[:-1] | same[1:]]  # windows whose hash occurs more than once
    again = ~same[:-1][same[:-1] | same[1:]]
    if len(at):
        pieces = [buf[a:b] for a, b in zip(starts[at].tolist(), ends[at + k - 1].tolist(), strict=True)]
        group = np.cumsum(again) - 1
        heads = np.flatnonzero(again)
        if any(pieces[i] != pieces[j] for i, j in enumerate(heads[group].tolist())):  # two windows share a hash: group by the words
            seen: dict[bytes, int] = {}
            group = np.fromiter((seen.setdefault(x, len(seen)) for x in pieces), np.int64, len(pieces))
            order = np.argsort(group, kind="stable")
            at, group = at[order], group[order]
            heads = np.flatnonzero(np.append(True, np.diff(group) != 0))
        least = np.minimum.reduceat(low[entry[at]], heads)[group]
        told = least < low[entry[at]]
        at, least = at[told], least[told]
    else:
        least = np.empty(0, dtype=np.int64)
    head_of = np.append(0, np.flatnonzero(last) + 1)  # first word of each entry
    ent, within = entry[at], at - head_of[entry[at]]
    base = np.cumsum([0, *sizes])
    body_of = np.searchsorted(base, ent, side="right") - 1
    out = []
    for i in range(len(bodies)):
        own = body_of == i
        out.append(pack((ent[own] - base[i]).astype("<i4").tobytes(), within[own].astype("<i4").tobytes(), least[own].astype("<i8").tobytes()))
    return out


def repeated_words(cut: Cut, replies: dict[int, bytes], k: int) -> np.ndarray:
    """Which words of the batch a window covers that also starts in a smaller document."""
    least = np.repeat(cut.low, cut.widths)
    for bucket, a, _ in cut.bounds():
        if bucket in replies:
            ent, within, low = unpack(replies[bucket])
            at = cut.offset[a + np.frombuffer(ent, "<i4")] + np.frombuffer(within, "<i4")
            least[at] = np.frombuffer(low, "<i8")
    windows = ragged(cut.first, cut.count)
    values = least[ragged(cut.offset[cut.which], cut.count)] if len(windows) else least[:0]
    hit = windows[values < cut.keys[cut.doc[windows]]]
    steps = np.zeros(cut.total + 1, dtype=np.int64)
    np.add.at(steps, hit, 1)
    np.add.at(steps, hit + k, -1)
    return np.cumsum(steps)[:-1] > 0


def dedup_substrings(docs: DataFrame, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES, common_least: int = COMMON_LEAST, fan: int = FAN) -> DataFrame:
    """Removes each word covered by a window of words that also starts in a document with a smaller doc_id.

    docs: doc_id, text; other columns are ignored. Returns doc_id, n_words, n_removed, text (kept words joined by one
    space), one row for each row of docs. Words are runs of bytes other than ASCII white space. Null and empty texts have
    no words. A null doc_id counts as smaller than all others. Rows with the same doc_id count as one document and do not
    remove each other's words. An empty table gives an empty result.
    """
    size = size_of(docs)
    buckets = max(1, -(-size * EXPANSION // bucket_bytes))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_pairs(docs, common_least))  # of fixed size: a byte for each class

    def scatter(pdf):
        cut = Cut(pdf, window, buckets, frequent.value)
        for bucket, a, b in cut.bounds():
            yield bucket, pack(cut.low[a:b].astype("<i8").tobytes(), b"".join(x + b"\n" for x in cut.entries[a:b]))

    def gather(bodies):
        return smallest_documents(bodies, window)

    def finish(pdf, replies):
        cut = Cut(pdf, window, buckets, frequent.value)
        gone = repeated_words(cut, replies, window)
        removed = np.bincount(cut.doc, weights=gone, minlength=len(cut.norms)).astype(np.int64)
        ends = np.cumsum(cut.n_words)
        texts = []
        for i, norm in enumerate(cut.norms):
            if removed[i]:
                own = gone[ends[i] - cut.n_words[i] : ends[i]].tolist()
                norm = b" ".join([w for w, g in zip(norm.split(b" "), own, strict=True) if not g])
            texts.append(norm.decode("utf-8", "replace"))
        return pd.DataFrame({"k": cut.keys, "n_words": cut.n_words, "n_removed": removed, "text": texts})

    out = exchange(docs, buckets, scatter, gather, finish, "k bigint, n_words bigint, n_removed bigint, text string", size=size, fan=fan)
    return out.select(key_id().alias("doc_id"), "n_words", "n_removed", "text")
