"""Quality classifier by co-training of two views.

The content view sees which words a text holds; the metadata view sees the page's source and language, its length and the
shape of its text, but no word. Each view is a logistic model. In each round either view labels those of all unlabelled
documents of which it is surest and hands them to the other; at the end both views are calibrated on labelled
documents that no round has seen, and their calibrated log odds are combined. There is one such pair for low quality and
one for toxicity; the models are then applied to all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import FETCHES, NULL_ID, counted, id_key, key_id, session, text_bytes, text_slices, written

#: Labelled documents that the models are fitted on at most, and pseudo-labels that a view hands on in a round.
LABELLED, PSEUDO = 16_000, 400
ROUNDS, SURE = 2, 0.95
#: Features of labelled documents that a fit works on at once.
AT_ONCE = 1 << 16
WORDS = 1 << 18
#: Of numeric metadata, the number of classes each is cut into.
CUTS = 12
#: Letters, digits and bytes outside ASCII stay; A-Z become a-z; other bytes part words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_UPPER, _MARKS, _DIGITS = (bytes(b for b in range(256) if not f(b)) for f in (lambda b: 65 <= b <= 90, lambda b: 33 <= b <= 126 and not chr(b).isalnum(), lambda b: 48 <= b <= 57))


def content(text: bytes) -> np.ndarray:
    """The hashed words of a text, each once."""
    return np.unique(np.fromiter((crc32(w) & (WORDS - 1) for w in set(text.translate(TABLE).split())), np.int32))


def metadata(text: bytes, source: str, lang: str) -> tuple[int, int, list[float]]:
    """Hashed source and language, and numbers about the page."""
    words = text.split()
    n, size, lines = max(1, len(words)), max(1, len(text)), text.split(b"\n")
    share = lambda table: len(text.translate(None, table)) / size
    numbers = [np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), len(set(words)) / n, len(set(lines)) / len(lines), size / n, share(_UPPER), share(_MARKS), share(_DIGITS), max(map(len, lines)) / size]
    return crc32(source.encode()) & 1023, crc32(lang.encode()) & 63, numbers


class Logistic:
    """A logistic model of binary features in lists, with features weighted by their class odds; fitted by full gradients."""

    def __init__(self, size: int):
        self.size, self.w, self.b = size, np.zeros(size), 0.0

    def fit(self, lists: list[np.ndarray], y: np.ndarray, steps: int = 120, decay: float = 0.02, most: int = AT_ONCE) -> Logistic:
        """The features stay in four bytes each; what is worked out for each of them goes by pieces of about `most`."""
        seen = np.zeros(self.size, dtype=np.int64)
        for x in lists:
            np.add.at(seen, x, 1)
        lists = [x[seen[x] > 1].astype(np.int32) for x in lists]
        lengths = np.array([len(x) for x in lists], dtype=np.int64)
        flat = np.concatenate([np.empty(0, np.int32), *lists])
        del lists
        ends = np.cumsum(lengths)
        # whole rows, in order, so that the sums are those of one piece
        cuts = np.append(np.flatnonzero(np.diff(ends // most, prepend=0)), len(ends))
        cuts = list(zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True))
        pieces = [(a, b, int(ends[a - 1]) if a else 0, int(ends[b - 1])) for a, b in cuts if a < b]
        pos = np.zeros(self.size)
        for a, b, lo, hi in pieces:
            np.add.at(pos, flat[lo:hi], np.repeat(y[a:b], lengths[a:b]))
        n1, n0 = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
        odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((seen - pos + 0.5) / (n0 + 1))
        odds[seen < 2] = 0
        used = np.flatnonzero(seen > 1)
        place = np.zeros(self.size, dtype=np.int32)
        place[used] = np.arange(len(used))
        for _, _, lo, hi in pieces:
            flat[lo:hi] = place[flat[lo:hi]]
        own = odds[used]
        w, m, v, b, mb, vb = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used)), np.log(n1 / n0), 0.0, 0.0
        weight = np.where(y > 0, 0.5 / n1, 0.5 / n0) * len(y)
        z = np.zeros(len(y))
        for t in range(1, steps + 1):
            worth = w * own
            for a, to, lo, hi in pieces:
                z[a:to] = np.bincount(np.repeat(np.arange(to - a), lengths[a:to]), weights=worth[flat[lo:hi]], minlength=to - a)
            r = (1 / (1 + np.exp(-np.clip(z + b, -30, 30))) - y) * weight / len(y)
            g = np.zeros(len(used))
            for a, to, lo, hi in pieces:
                some = flat[lo:hi]
                np.add.at(g, some, np.repeat(r[a:to], lengths[a:to]) * own[some])
            g += decay * w / len(used) ** 0.5
            gb = r.sum()
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            b -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
        self.w[used] = w * own
        self.b = b
        return self

    def score(self, lists: list[np.ndarray]) -> np.ndarray:
        return np.array([self.w[x].sum() for x in lists]) + self.b


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibration(z: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights and a constant for some columns of log odds, by regularised Newton steps."""
    x = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + 0.05 * w)
        w -= np.clip(step, -2, 2)
    return w


class Head:
    """The two views for one label, and their calibration."""

    def __init__(self, words: list[np.ndarray], pages: list[np.ndarray], y: np.ndarray, held: np.ndarray, size: int):
        self.words, self.pages, self.y, self.held, self.size = words, pages, y.astype(np.float64), held, size
        self.own = np.flatnonzero(~held)
        self.sets = [[[lists[i] for i in self.own], list(self.y[self.own])] for lists in (words, pages)]
        self.prior = self.y[self.own].mean() if len(self.own) else 0.0
        self.taken: set[int] = set()

    def fit(self) -> None:
        self.views = [Logistic(n).fit(lists, np.array(labels)) for n, (lists, labels) in zip((WORDS, self.size), self.sets, strict=True)]

    def quotas(self, pseudo: int) -> tuple[int, int]:
        """How many documents a view may hand on as negative and as positive."""
        return round(pseudo * (1 - self.prior)), round(pseudo * self.prior)

    def take(self, giver: int, label: int, words: np.ndarray, page: np.ndarray) -> None:
        """One view's pseudo-label goes to the other."""
        lists, labels = self.sets[1 - giver]
        lists.append((page, words)[giver])
        labels.append(float(label))

    def calibrate(self) -> None:
        seen = np.flatnonzero(self.held) if self.held.any() else self.own
        z = np.column_stack([m.score([lists[i] for i in seen]) for m, lists in zip(self.views, (self.words, self.pages), strict=True)])
        self.cal = [calibration(z[:, [i]], self.y[seen]) for i in (0, 1)]
        self.mixed = calibration(self._calibrated(z), self.y[seen])

    def _calibrated(self, z: np.ndarray) -> np.ndarray:
        return np.column_stack([z[:, i] * self.cal[i][0] + self.cal[i][1] for i in (0, 1)])

    def odds(self, words: list[np.ndarray], pages: np.ndarray) -> np.ndarray:
        """Log odds by each view."""
        return np.column_stack([self.views[0].score(words), self.views[1].w[pages].sum(axis=1) + self.views[1].b])

    def probability(self, words: list[np.ndarray], pages: np.ndarray) -> np.ndarray:
        if not words:
            return np.empty(0)
        return _sigmoid(np.column_stack([self._calibrated(self.odds(words, pages)), np.ones(len(words))]) @ self.mixed)


class CoTrained:
    """Models of low quality and toxicity over shared features."""

    def __init__(self, rows: list[tuple]):
        """rows: k, words, source, lang, numbers, low, toxic."""
        rows = sorted(rows, key=lambda r: r[0])
        numbers = np.array([r[4] for r in rows], dtype=np.float64) if rows else np.empty((0, 0))
        self.cuts = np.quantile(numbers, np.linspace(0, 1, CUTS + 1)[1:-1], axis=0).T if len(rows) else np.empty((0, 0))
        self.size = 1024 + 64 + (CUTS + 1) * max(1, numbers.shape[1])
        words, pages = [r[1] for r in rows], list(self.pages([r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows]))
        held = np.array([crc32(str(r[0]).encode()) % 4 == 0 for r in rows], dtype=bool)
        self.heads: list[Head | None] = []
        for i in (5, 6):
            y = np.array([r[i] for r in rows], dtype=np.int64)
            learn = len(y) and 0 < y.sum() < len(y)
            if learn and not (0 < y[held].sum() < held.sum() and 0 < y[~held].sum() < (~held).sum()):
                held = np.zeros(len(y), dtype=bool)
            self.heads.append(Head(words, pages, y, held, self.size) if learn else None)

    def pages(self, source, lang, numbers) -> np.ndarray:
        """The metadata features of some pages: a row of feature numbers for each."""
        first = np.column_stack([np.asarray(source, dtype=np.int64), 1024 + np.asarray(lang, dtype=np.int64)])
        if not len(first) or not len(self.cuts):
            return first
        x = np.array([list(n) for n in numbers], dtype=np.float64)
        classes = [1088 + i * (CUTS + 1) + np.searchsorted(cuts, x[:, i]) for i, cuts in enumerate(self.cuts)]
        return np.column_stack([first, *classes])

    def bare(self) -> CoTrained:
        """The model without what it learns from."""
        out = copy(self)
        out.heads = [h and copy(h) for h in self.heads]
        for h in filter(None, out.heads):
            for name in ("words", "pages", "y", "held", "own", "sets", "taken"):
                h.__dict__.pop(name, None)
        return out

    def scores(self, words: list[np.ndarray], pages: np.ndarray) -> list[np.ndarray]:
        return [h.probability(words, pages) if h else np.zeros(len(words)) for h in self.heads]


def _opened(pdf: pd.DataFrame, model: CoTrained) -> tuple[list[np.ndarray], np.ndarray]:
    return [np.frombuffer(w, np.int32) for w in pdf["words"]], model.pages(pdf["source"], pdf["lang"], pdf["numbers"])


def _surest(features: DataFrame, model: CoTrained, pseudo: int) -> list[tuple[int, int, int, int]]:
    """(head, giver, label, k) of the documents of which each view is surest, surest first: a top-k over all of them.

    Every task keeps its own surest ones, so that few rows meet. Lists are longer than asked by what was taken before.
    """
    shared = features.sparkSession.sparkContext.broadcast(model.bare())  # of fixed size
    most = {(i, g, label): h.quotas(pseudo)[label] + len(h.taken) + pseudo for i, h in enumerate(model.heads) if h for g in (0, 1) for label in (0, 1)}
    edge = float(np.log(SURE / (1 - SURE)))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, best = shared.value, {c: (np.empty(0), np.empty(0, dtype=np.int64)) for c in most}
        for pdf in frames:
            words, pages = _opened(pdf, m)
            k = pdf["k"].to_numpy(dtype=np.int64)
            for i, h in enumerate(m.heads):
                z = h.odds(words, pages) if h else None
                for g in (0, 1) if h else ():
                    for label in (0, 1):
                        size = z[:, g] if label else -z[:, g]
                        sure = size >= edge
                        size, own = np.append(best[i, g, label][0], size[sure]), np.append(best[i, g, label][1], k[sure])
                        order = np.lexsort((own, -size))[: most[i, g, label]]
                        best[i, g, label] = size[order], own[order]
        for (i, g, label), (size, own) in best.items():
            if len(own):
                yield pd.DataFrame({"list": i * 4 + g * 2 + label, "most": most[i, g, label], "size": size, "k": own})

    rows = features.mapInPandas(work, "list int, most int, size double, k bigint")
    rank = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("size"), "k"))
    top = rows.withColumn("rank", rank).where(F.col("rank") <= max(most.values())).where("rank <= most")
    return [(r["list"] >> 2, r["list"] >> 1 & 1, r["list"] & 1, r.k) for r in sorted(top.collect(), key=lambda r: (r["list"], r["rank"]))]


def _exchange_labels(features: DataFrame, model: CoTrained, pseudo: int) -> None:
    """One round: each view hands on the documents of which it is surest; none is taken twice for one label."""
    chosen: list[tuple[int, int, int, int]] = []
    counts: dict[tuple[int, int, int], int] = {}
    for i, giver, label, k in _surest(features, model, pseudo):
        head = model.heads[i]
        if k not in head.taken and counts.get((i, giver, label), 0) < head.quotas(pseudo)[label]:
            head.taken.add(k)
            counts[i, giver, label] = counts.get((i, giver, label), 0) + 1
            chosen.append((i, giver, label, k))
    rows = {r[0]: r for r in _rows(features, sorted({c[3] for c in chosen}))}
    for i, giver, label, k in chosen:
        r = rows[k]
        model.heads[i].take(giver, label, r[1], model.pages([r[2]], [r[3]], [r[4]])[0])


def _rows(features: DataFrame, ids: list[int]) -> list[tuple]:
    """The features of some documents, bounded by the caller; one row for each id, of repeated ids the least."""
    if not ids:
        return []
    some = features.sparkSession.createDataFrame([(i,) for i in ids], "k bigint")
    least = features.join(F.broadcast(some), "k").groupBy("k").agg(F.min(F.struct("words", "source", "lang", "numbers")).alias("x"))
    return [(r.k, np.frombuffer(r.words, np.int32), r.source, r.lang, r.numbers) for r in least.select("k", "x.*").coalesce(FETCHES).toLocalIterator()]


FEATURES = "k bigint, words binary, source int, lang int, numbers array<double>"


def features_of(docs: DataFrame) -> DataFrame:
    """k and the features of both views of each document, computed once and stored for all rounds and the final scores."""
    session(docs)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part in text_slices(pdf):
                pages = [metadata(*x) for x in zip(part["text"], part["source"], part["lang"], strict=True)]
                yield pd.DataFrame({"k": part["k"], "words": [content(t).tobytes() for t in part["text"]], "source": [p[0] for p in pages], "lang": [p[1] for p in pages], "numbers": [p[2] for p in pages]})

    return written(_columns(docs).mapInPandas(work, FEATURES), "features")


def _columns(docs: DataFrame) -> DataFrame:
    has = {c.lower() for c in docs.columns}
    other = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in has else F.lit("")).alias(c)
    return docs.select(id_key().alias("k"), text_bytes().alias("text"), other("source"), other("lang"))


def fit(features: DataFrame, labels: DataFrame, labelled: int = LABELLED, pseudo: int = PSEUDO, rounds: int = ROUNDS) -> CoTrained:
    """Fits the models on at most `labelled` labelled documents, chosen by a hash of the id, and on pseudo-labels: in each round
    either view hands on at most `pseudo` for each label, the surest of all unlabelled documents with an id."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("k")).agg((1 - F.min("quality")).cast("int").alias("low"), F.max("toxic").cast("int").alias("toxic"))
    known = written(known.where("low is not null and toxic is not null"), "known")
    ids = features.select("k").distinct()
    chosen = {r.k: (r.low, r.toxic) for r in known.join(ids, "k", "left_semi").orderBy(F.xxhash64("k"), "k").limit(labelled).collect()}
    model = CoTrained([(*r, *chosen[r[0]]) for r in _rows(features, list(chosen))])
    others = features.where(F.col("k") != NULL_ID).join(counted(known.select("k")), "k", "left_anti")
    for turn in range(rounds + 1):
        for head in filter(None, model.heads):
            head.fit()
        if turn < rounds and any(model.heads):
            _exchange_labels(others, model, pseudo)
    for head in filter(None, model.heads):
        head.calibrate()
    return model


def score(features: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, p_low_quality, p_toxic and keep (both under one half), one row for each row of features."""
    shared = session(features).sparkContext.broadcast(model.bare())  # of fixed size: two weights for each hashed feature and label

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            low, toxic = shared.value.scores(*_opened(pdf, shared.value))
            yield pd.DataFrame({"k": pdf["k"], "p_low_quality": low.round(6), "p_toxic": toxic.round(6)})

    out = features.mapInPandas(work, "k bigint, p_low_quality double, p_toxic double")
    return out.select(key_id().alias("doc_id"), "p_low_quality", "p_toxic", ((F.col("p_low_quality") < 0.5) & (F.col("p_toxic") < 0.5)).alias("keep"))


def classify(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pseudo: int = PSEUDO, rounds: int = ROUNDS) -> DataFrame:
    """Fits on labelled documents and scores all.

    docs: doc_id, text and, where present, source and lang; labels: doc_id, quality (1 good), toxic (1 toxic); other
    columns are ignored. Returns doc_id, p_low_quality, p_toxic, keep for each row of docs. Several labels of one document
    count as its worst, several rows of one labelled doc_id as the one with the least features; rows without a label or id
    are left out of the fit. Null texts, sources and languages are empty. A label with one class only, or no label at all,
    gives the probability 0. An empty table gives an empty result.
    """
    features = features_of(docs)
    return score(features, fit(features, labels, labelled, pseudo, rounds))
