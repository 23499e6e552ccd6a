"""Benchmark decontamination over a positional inverted index of the training documents.

The index is partitioned by documents: each shard holds its documents' distinct terms and, for each term, the sorted
positions where it stands. Test phrases travel to the shards in blocks of a stated size; a shard takes the list of a
phrase's rarest term (by its count over all documents), shifts it by the term's offset, and intersects it with the shifted
lists of the other terms, rarest first, by binary search. No list ever leaves its shard.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import id_key, key_id, session, text_bytes, written

WINDOW = 10
#: Bytes of text that one shard of the index takes.
SHARD_BYTES = 8 << 20
#: Bytes of benchmark text that one block of phrases takes; more blocks are searched one after the other.
BLOCK_BYTES = 4 << 20
#: A-Z to a-z; every other byte outside 0-9, a-z and 0x80-0xFF parts words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

INDEX = "shard string, keys binary, lengths binary, terms binary, offsets binary, positions binary"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def _z(a: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a if isinstance(a, bytes) else a.tobytes())


def _u(x: bytes, kind: str | None = None):
    raw = zstandard.ZstdDecompressor().decompress(x)
    return np.frombuffer(raw, kind) if kind else raw


def make_shard(keys: list[int], texts: list[list[bytes]]) -> pd.DataFrame:
    """One shard: positions count over the shard, and a gap follows each document."""
    lengths = np.array([len(x) for x in texts], dtype="<i8")
    flat = [w for x in texts for w in x]
    place = {w: i for i, w in enumerate(sorted(set(flat)))}
    ids = np.fromiter(map(place.__getitem__, flat), np.int32, len(flat))
    order = np.argsort(ids, kind="stable")
    offsets = np.append(0, np.cumsum(np.bincount(ids, minlength=len(place)))).astype("<i8")
    gaps = order + np.repeat(np.arange(len(lengths)), lengths)[order]
    steps = np.diff(gaps, prepend=0).astype("<i4")
    return pd.DataFrame({"shard": [uuid.uuid4().hex], "keys": [_z(np.array(keys, dtype="<i8"))], "lengths": [_z(lengths)], "terms": [_z(b" ".join(place))], "offsets": [_z(np.diff(offsets).astype("<i4"))], "positions": [_z(steps)]})


def positional_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Stores the postings of all words of docs (doc_id, text) in the shared folder; one row for each shard."""
    session(docs)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, texts, size = [], [], 0
        for pdf in frames:
            for k, text in zip(pdf["k"].tolist(), pdf["text"], strict=True):
                if keys and size + len(text) > shard_bytes:
                    yield make_shard(keys, texts)
                    keys, texts, size = [], [], 0
                keys.append(k)
                texts.append(words_of(text))
                size += len(text)
        if keys:
            yield make_shard(keys, texts)

    return written(docs.select(id_key().alias("k"), text_bytes().alias("text")).mapInPandas(work, INDEX), "postings")


class Shard:
    """A shard opened for search."""

    def __init__(self, row):
        self.name = row.shard
        self.keys, self.lengths = _u(row.keys_, "<i8"), _u(row.lengths, "<i8")
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        terms = _u(row.terms)
        self.terms = {w: i for i, w in enumerate(terms.split(b" "))} if terms else {}
        self.offsets = np.append(0, np.cumsum(_u(row.offsets, "<i4"), dtype=np.int64))
        self.positions = np.cumsum(_u(row.positions, "<i4"), dtype=np.int64)
        self.span = int((self.lengths + 1).sum()) + 1
        # one sorted array of (term, position) keys: binary search in it is a search in the term's list
        self.lists = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets)) * self.span + self.positions

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = term * self.span + position
        at = np.searchsorted(self.lists, key)
        at[at == len(self.lists)] = 0
        return (self.lists[at] == key) & (position >= 0) & (position < self.span) if len(self.lists) else np.zeros(len(key), dtype=bool)

    def has_near(self, term: np.ndarray, position: np.ndarray, slop: int, doc: np.ndarray) -> np.ndarray:
        """Whether the term stands within slop of the position, in the same document."""
        lo = np.maximum(position - slop, self.starts[doc])
        hi = np.minimum(position + slop, self.starts[doc] + self.lengths[doc] - 1)
        a, b = np.searchsorted(self.lists, term * self.span + lo), np.searchsorted(self.lists, term * self.span + hi, side="right")
        return (b > a) & (hi >= lo)

    def find(self, phrases: list[tuple[bytes, ...]], rarity: dict[bytes, int], slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, position, document in the shard) for each place where a phrase stands; with slop, where each term is within slop of its place."""
        hits_p, hits_s, hits_d = [], [], []
        by_length: dict[int, list[int]] = {}
        for i, phrase in enumerate(phrases):
            by_length.setdefault(len(phrase), []).append(i)
        for length, which in by_length.items():
            own = [i for i in which if all(w in self.terms for w in phrases[i])]
            if not own:
                continue
            ids = np.array([[self.terms[w] for w in phrases[i]] for i in own], dtype=np.int64)
            rare = np.array([[rarity.get(w, 0) for w in phrases[i]] for i in own], dtype=np.int64)
            order = np.argsort(rare, axis=1, kind="stable")
            lead = order[:, 0]
            term = ids[np.arange(len(own)), lead]
            n = self.offsets[term + 1] - self.offsets[term]
            for at, to in _blocks(n, 1 << 20):
                counts = n[at:to]
                row = np.repeat(np.arange(at, to), counts)
                flat = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.offsets[term[at:to]], counts)
                start = self.positions[flat] - lead[row]
                doc = np.searchsorted(self.starts, self.positions[flat], side="right") - 1
                if slop:  # the rarest term, too, may stand beside its place
                    shift = np.tile(np.arange(-slop, slop + 1), len(row))
                    row, doc, start = (np.repeat(x, 2 * slop + 1) for x in (row, doc, start))
                    start = start + shift
                for j in range(1, length):
                    column = order[row, j]
                    if slop:
                        keep = self.has_near(ids[row, column], start + column, slop, doc)
                    else:
                        keep = self.has(ids[row, column], start + column)
                    row, start, doc = row[keep], start[keep], doc[keep]
                hits_p.append(np.array(own, dtype=np.int64)[row])
                hits_s.append(start)
                hits_d.append(doc)
        if not hits_p:
            return (np.empty(0, dtype=np.int64),) * 3
        return np.concatenate(hits_p), np.concatenate(hits_s), np.concatenate(hits_d)


def _blocks(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with about `most` postings at once."""
    at, ends = 0, np.cumsum(counts)
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def _opened(frames: Iterator[pd.DataFrame]) -> Iterator[Shard]:
    for pdf in frames:
        for row in pdf.rename(columns={"keys": "keys_"}).itertuples(index=False):
            yield Shard(row)


def term_counts(index: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often each word of the vocabulary stands in all documents."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for terms, sizes in zip(pdf["terms"], pdf["offsets"], strict=True):
                found = [(w, n) for w, n in zip(_u(terms).split(b" "), _u(sizes, "<i4").tolist(), strict=False) if w in vocabulary]
                yield pd.DataFrame({"term": [w for w, _ in found], "n": [n for _, n in found]}).astype({"n": "int64"})

    counted = index.select("terms", "offsets").mapInPandas(work, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r.term): r.n for r in counted.collect()}  # at most the words of one block


def phrases_of(items: list[tuple[str | None, bytes]], window: int) -> tuple[list[tuple[bytes, ...]], list[list[str]]]:
    """The distinct windows of some test items, and the items of each."""
    owners: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            own = owners.setdefault(tuple(words[i : i + window]), set())
            if item is not None:
                own.add(item)
    return list(owners), [sorted(x) for x in owners.values()]


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The test items, a block of bounded size at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item"), text_bytes().alias("text")).toLocalIterator():
        if block and size + len(r.text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.item, bytes(r.text)))
        size += len(r.text)
    yield block


MATCHES = "shard string, k bigint, doc bigint, n_words bigint, spans array<struct<start:bigint,stop:bigint>>, items array<string>"


def _search(index: DataFrame, items, window: int, slop: int) -> DataFrame:
    phrases, owners = phrases_of(items, window)
    rarity = term_counts(index, frozenset(w for p in phrases for w in p))
    shared = index.sparkSession.sparkContext.broadcast((phrases, owners, rarity))  # one block at most

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phrases, owners, rarity = shared.value
        sizes = np.array([len(p) for p in phrases], dtype=np.int64)
        for shard in _opened(frames):
            which, start, doc = shard.find(phrases, rarity, slop)
            low, high = start - slop, start + sizes[which] + slop
            low = np.maximum(low, shard.starts[doc]) - shard.starts[doc]
            high = np.minimum(high, shard.starts[doc] + shard.lengths[doc]) - shard.starts[doc]
            spans: dict[int, list[tuple[int, int]]] = {}
            named: dict[int, set[str]] = {}
            order = np.lexsort((low, doc))
            for d, a, b in zip(doc[order].tolist(), low[order].tolist(), high[order].tolist(), strict=True):
                own = spans.setdefault(d, [])
                if own and a <= own[-1][1]:
                    own[-1] = (own[-1][0], max(b, own[-1][1]))
                else:
                    own.append((a, b))
            for d, p in set(zip(doc.tolist(), which.tolist(), strict=True)):
                named.setdefault(d, set()).update(owners[p])
            n = len(shard.keys)
            yield pd.DataFrame({"shard": shard.name, "k": shard.keys, "doc": np.arange(n), "n_words": shard.lengths, "spans": [[{"start": a, "stop": b} for a, b in spans.get(i, ())] for i in range(n)], "items": [sorted(named.get(i, ())) for i in range(n)]})

    return index.mapInPandas(work, MATCHES)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Finds windows of test items in documents, as exact phrases, or with slop as terms near their places.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. A window is `window` consecutive words of an
    item, or all words of a shorter item. Returns for each row of docs: doc_id, n_words, n_hit (words in any occurrence),
    spans (array of start, stop in words; merged), items (the item_ids found, as strings, sorted). With slop, a match is a
    place such that every term stands within `slop` words of its own place in one document, and the span reaches as far.
    Null and empty texts have no words; an item without words has no window. Items with a null item_id mark words but are
    not named; items that share an item_id count as one. Duplicate rows of docs each get a row. An empty benchmark gives
    rows without hits, an empty docs table an empty result.
    """
    session(docs)
    index = positional_index(docs, shard_bytes)
    found = [_search(index, block, window, slop) for block in benchmark_blocks(benchmark, block_bytes)]
    if len(found) == 1:
        out = found[0]
    else:  # every block gave every document a row: bring those of a document together
        row = ["shard", "k", "doc", "n_words"]
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        parts = every.select(*row, F.explode("spans").alias("s")).select(*row, "s.start", "s.stop")
        w = Window.partitionBy(*row).orderBy("start", "stop")
        apart = F.col("start") > F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
        merged = parts.withColumn("__new", F.when(apart, 1).otherwise(0)).withColumn("__g", F.sum("__new").over(w)).groupBy(*row, "__g").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        hits = merged.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
        items = every.select(*row, F.explode("items").alias("i")).groupBy(*row).agg(F.array_sort(F.collect_set("i")).alias("items"))
        out = found[0].select(*row).join(hits, row, "left").join(items, row, "left")
        out = out.select("k", "n_words", F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    total = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return out.select(key_id().alias("doc_id"), "n_words", total.alias("n_hit"), "spans", "items")
