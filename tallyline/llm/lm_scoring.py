"""Cross-entropy difference of two matched bigram models.

The target and the background model share one vocabulary (all words of the corpus), order and smoothing; each token's loss
under the one less its loss under the other scores the document. Counts cover the whole corpus: each batch of documents
sends its distinct n-grams with their counts to buckets, which answer with the corpus counts. A document's own counts are
taken out of its model before it is scored, so that a target document is not rewarded for having been counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import id_key, key_id, mix, pair, session, size_of, text_bytes, text_slices, word_table, written
from tallyline.llm.exchange import FAN, exchange

#: Smoothing: added to each word's count, and the weight of the word model in the bigram model.
ADD, PRIOR = 0.5, 4.0
#: Bytes of n-grams that one bucket takes; a text's n-grams take about as many bytes as itself.
BUCKET_BYTES = 16 << 20
#: Bytes of text whose distinct words one task joins.
VOCABULARY_BYTES = 128 << 20
_START = np.uint64(0x5851F42D4C957F2D)


def planes(a: np.ndarray) -> bytes:
    """An array's bytes, the first of each value together, then the second, ...: small values compress to almost nothing."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def unplanes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _z(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _u(body: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(body)


class Grams:
    """The n-grams of a batch: distinct keys, and for each token its word, the word before, and their pair."""

    def __init__(self, pdf: pd.DataFrame):
        lists = [t.lower().split() for t in pdf["text"]]
        self.n = np.array([len(x) for x in lists], dtype=np.int64)
        self.target = pdf["mark"].to_numpy(dtype=bool)
        buf = b"".join(b" ".join(x) + b" " for x in lists if x)
        del lists
        _, _, h = word_table(buf)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.first = np.zeros(len(h), dtype=bool)
        self.first[(np.cumsum(self.n) - self.n)[self.n > 0]] = True
        before = np.roll(h, 1)
        before[self.first] = _START
        keys = np.concatenate([mix(h), pair(before, h, 11)])
        self.keys, inverse = np.unique(keys, return_inverse=True)
        self.word, self.pair = inverse[: len(h)], inverse[len(h) :]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each key, in target and in background documents."""
        of = self.target[self.doc]
        both = np.concatenate([self.word, self.pair])
        in_target = np.concatenate([of, of])
        all_counts = np.bincount(both, minlength=len(self.keys))
        own = np.bincount(both[in_target], minlength=len(self.keys))
        return own.astype("<u4"), (all_counts - own).astype("<u4")

    def own(self, ids: np.ndarray) -> np.ndarray:
        """How often the token's key stands in its own document."""
        joint = self.doc * max(1, len(self.keys)) + ids
        _, inverse, counts = np.unique(joint, return_inverse=True, return_counts=True)
        return counts[inverse]

    def bounds(self, buckets: int) -> Iterator[tuple[int, int, int]]:
        """(bucket, from, to): buckets are ranges of keys."""
        cuts = np.searchsorted(self.keys, (np.arange(buckets, dtype=np.float64) / buckets * 2.0**64).astype(np.uint64))
        for b, (a, z) in enumerate(zip(cuts, np.append(cuts[1:], len(self.keys)), strict=True)):
            if a < z:
                yield b, int(a), int(z)


def _lengths_and_vocabulary(docs: DataFrame, slices: int) -> tuple[DataFrame, int]:
    """k and n, the number of words, of each document; and how many words the corpus has, one more for those it has not.

    A task sends its distinct word hashes in slices by their range; a slice's hashes are made one set as they stream by.
    """
    session(docs)
    edges = (np.arange(slices, dtype=np.float64) / slices * 2.0**64).astype(np.uint64)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, new, held = np.empty(0, dtype=np.uint64), [], 0
        for pdf in frames:
            for part in text_slices(pdf):
                lists = [t.lower().split() for t in part["text"]]
                new.append(np.unique(word_table(b"".join(b" ".join(x) + b" " for x in lists if x))[2]))
                held += len(new[-1])
                if held > 1 << 20:
                    seen, new, held = np.unique(np.concatenate([seen, *new])), [], 0
                yield pd.DataFrame({"k": part["k"], "n": [len(x) for x in lists], "slice": -1, "body": None})
        seen = np.unique(np.concatenate([seen, *new]))
        cuts = np.append(np.searchsorted(seen, edges), len(seen)).tolist()
        for i, (a, z) in enumerate(zip(cuts, cuts[1:])):
            if a < z:
                yield pd.DataFrame({"k": [0], "n": [0], "slice": [i], "body": [_z(planes(np.diff(seen[a:z], prepend=np.uint64(0)).astype("<u8")))]})

    def sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seen = None, np.empty(0, dtype=np.uint64)
        for pdf in frames:
            for i, body in zip(pdf["slice"].tolist(), pdf["body"], strict=True):
                if i != now:
                    if now is not None:
                        yield pd.DataFrame({"n": [len(seen)]})
                    now, seen = i, np.empty(0, dtype=np.uint64)
                seen = np.union1d(seen, np.cumsum(unplanes(_u(body), "<u8"), dtype=np.uint64))
        if now is not None:
            yield pd.DataFrame({"n": [len(seen)]})

    found = written(docs.select(id_key().alias("k"), text_bytes().alias("text")).mapInPandas(work, "k bigint, n bigint, slice int, body binary"), "words")
    words = found.where("slice >= 0").select("slice", "body").repartition("slice").sortWithinPartitions("slice").mapInPandas(sizes, "n bigint")
    return found.where("slice < 0").select("k", "n"), 1 + (words.agg(F.sum("n")).first()[0] or 0)


def score_documents(docs: DataFrame, target: DataFrame, add: float = ADD, prior: float = PRIOR, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN) -> DataFrame:
    """Scores documents by how much better a target model predicts them than a background model.

    docs: doc_id, text; target: doc_id of the documents that train the target model; all others train the background
    model; other columns are ignored. Words are runs of bytes other than ASCII white space, A-Z lower-cased. Returns doc_id,
    n_tokens, loss_target, loss_background (nats a token) and difference (the first less the second: the lower, the more
    like the target), one row for each row of docs. Null and empty texts have no tokens and losses of 0. A null doc_id is in
    the background. Corpus counts and the size of the one vocabulary, which both models share, are exact.
    """
    chosen = target.select(F.col("doc_id").cast("bigint").alias("k")).where("k is not null").distinct()
    size = size_of(docs)
    lengths, vocabulary = _lengths_and_vocabulary(docs, max(1, -(-size // VOCABULARY_BYTES)))
    s = lengths.join(chosen.withColumn("t", F.lit(1)), "k", "left").agg(*[F.coalesce(F.sum(F.when(F.col("t").isNotNull() if x else F.col("t").isNull(), v)), F.lit(0)) for v in (F.col("n").cast("bigint"), F.lit(1)) for x in (True, False)]).first()
    totals, texts = np.array(s[:2], dtype=np.float64), np.array(s[2:], dtype=np.float64)
    buckets = max(1, -(-size // bucket_bytes))

    def scatter(pdf):
        g = Grams(pdf)
        t, b = g.counts()
        for bucket, a, z in g.bounds(buckets):
            steps = np.diff(g.keys[a:z], prepend=np.uint64(0)).astype("<u8")
            yield bucket, _z(planes(steps) + planes(t[a:z]) + planes(b[a:z]))

    def gather(bodies):
        keys, t, b, sizes = [], [], [], []
        for body in bodies:
            raw = _u(body)
            n = len(raw) // 16
            keys.append(np.cumsum(unplanes(raw[: 8 * n], "<u8"), dtype=np.uint64))
            t.append(unplanes(raw[8 * n : 12 * n], "<u4"))
            b.append(unplanes(raw[12 * n :], "<u4"))
            sizes.append(n)
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        st = np.bincount(inverse, weights=np.concatenate(t), minlength=len(every)).astype("<u8")
        sb = np.bincount(inverse, weights=np.concatenate(b), minlength=len(every)).astype("<u8")
        ends = np.cumsum(sizes)
        return [_z(planes(st[inverse[e - n : e]]) + planes(sb[inverse[e - n : e]])) for e, n in zip(ends, sizes, strict=True)]

    def finish(pdf, replies):
        g = Grams(pdf)
        corpus = np.zeros((2, len(g.keys)))
        for bucket, a, z in g.bounds(buckets):
            raw = _u(replies[bucket])
            corpus[0, a:z], corpus[1, a:z] = unplanes(raw[: len(raw) // 2], "<u8"), unplanes(raw[len(raw) // 2 :], "<u8")
        own_word, own_pair = g.own(g.word), g.own(g.pair)
        before, own_before = np.roll(g.word, 1), np.roll(own_word, 1)
        losses = []
        for side in (0, 1):
            inside = (g.target if side == 0 else ~g.target)[g.doc]
            word = corpus[side, g.word] - np.where(inside, own_word, 0)
            both = corpus[side, g.pair] - np.where(inside, own_pair, 0)
            context = np.where(g.first, texts[side] - inside, corpus[side, before] - np.where(inside, own_before, 0))
            total = totals[side] - np.where(inside, g.n[g.doc], 0)
            alone = (word + add) / (total + add * vocabulary)
            losses.append(-np.log((both + prior * alone) / (context + prior)))
        per = [np.bincount(g.doc, weights=x, minlength=len(g.n)) / np.maximum(g.n, 1) for x in losses]
        diff = np.bincount(g.doc, weights=losses[0] - losses[1], minlength=len(g.n)) / np.maximum(g.n, 1)
        return pd.DataFrame({"k": pdf["k"], "n_tokens": g.n, "loss_target": per[0].round(9), "loss_background": per[1].round(9), "difference": diff.round(9)})

    out = exchange(docs, buckets, scatter, gather, finish, "k bigint, n_tokens bigint, loss_target double, loss_background double, difference double", marks=chosen, size=size, fan=fan)
    return out.select(key_id().alias("doc_id"), "n_tokens", "loss_target", "loss_background", "difference")
