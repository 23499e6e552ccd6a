"""Batches of documents ask buckets of keys: a packed scatter, gather and reply.

Documents fall into batches by a hash of their rows, so that a batch's content never depends on the order in which rows
arrive and a recomputed task sends the same bytes. Each batch sends every bucket one packed row; a key that fills a third
of the corpus reaches its bucket once for each batch at most. A bucket answers each batch that asked, and the batch, met
again through the same exchange, applies the answers to its documents.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import NULL_ID, id_key, session, size_of, text_bytes

BATCH_BYTES = 8 << 20
#: Messages that a batch sends at most, and bytes of messages that a group of buckets deals out at once.
FAN, MERGED = 8192, 64 << 20

#: (batch number, its rows) -> (bucket, body) pairs, and (batch number, its rows, {bucket: reply}) -> rows
Scatter = Callable[[pd.DataFrame], Iterator[tuple[int, bytes]]]
Gather = Callable[[list[bytes]], list[bytes]]
Finish = Callable[[pd.DataFrame, dict[int, bytes]], pd.DataFrame]


def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    """A batch's rows in an order that depends on their content only."""
    return pdf.sort_values(["k", "text"], kind="stable", ignore_index=True)


def exchange(docs: DataFrame, buckets: int, scatter: Scatter, gather: Gather, finish: Finish, schema: str, marks: DataFrame | None = None, batch_bytes: int = BATCH_BYTES, size: int | None = None, fan: int = FAN) -> DataFrame:
    """docs: doc_id, text. Returns what finish makes of each batch; scatter names buckets below `buckets`, in ascending order.

    marks: k, the keys of some documents; they travel to the batches beside the documents, so that no text is shuffled for
    a join, and arrive as the column "mark".

    With more than `fan` buckets a batch sends a message to each of `fan` groups of them. A group's messages stream through one
    task, which joins those of many batches before it deals them to buckets; answers go back the same way. So a batch sends
    and gets at most `fan` messages whatever the corpus, and a message in a group holds what many batches have for a bucket.
    """
    session(docs)
    n = max(1, -(-(size_of(docs) if size is None else size) // batch_bytes))
    rows = docs.select(id_key().alias("k"), text_bytes().alias("text"), F.lit(False).alias("is_mark"))
    if marks is not None:
        rows = rows.unionByName(marks.select("k", F.lit(b"").alias("text"), F.lit(True).alias("is_mark")))
    salt = F.xxhash64("k", "text") if marks is None else F.when(F.col("k") == NULL_ID, F.xxhash64("text")).otherwise(F.xxhash64("k"))
    rows = rows.withColumn("batch", F.pmod(salt, F.lit(n)))
    width = -(-buckets // fan)  # buckets of a group

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        marked = set(pdf["k"][pdf["is_mark"]].tolist())
        out = ordered(pdf[~pdf["is_mark"]])
        return out.assign(mark=[k in marked for k in out["k"].tolist()])

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        batch = int(pdf["batch"].iloc[0])
        sent = list(scatter(own(pdf)))
        if width > 1:
            sent = [(g, pickle.dumps(list(own))) for g, own in groupby(sent, key=lambda x: x[0] // width)]
        return pd.DataFrame({"bucket": [b for b, _ in sent], "batch": batch, "body": [x for _, x in sent]})

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("batch", kind="stable", ignore_index=True)
        return pd.DataFrame({"batch": pdf["batch"], "bucket": pdf["bucket"], "body": gather(list(pdf["body"]))})

    def close(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        replies = dict(zip(right["bucket"], right["body"], strict=True))
        if width > 1:
            replies = {b: x for body in replies.values() for b, x in pickle.loads(body)}
        return finish(own(left), replies)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Messages of a group, batch after batch: so many at once as MERGED bytes hold make a chunk, and a row for each bucket."""
        group, chunk, held, size = None, 0, {}, 0

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"bucket": list(held), "grp": group, "chunk": chunk, "body": [pickle.dumps(x) for x in held.values()]})

        for pdf in frames:
            for g, batch, body in zip(pdf["bucket"].tolist(), pdf["batch"].tolist(), pdf["body"], strict=True):
                if g != group or size >= MERGED:
                    if held:
                        yield rows()
                    group, chunk, held, size = g, chunk + 1 if g == group else 0, {}, 0
                for b, x in pickle.loads(body):
                    held.setdefault(b, []).append((batch, x))
                size += len(body)
        if held:
            yield rows()

    def answer_chunks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk", kind="stable", ignore_index=True)
        asked = [pickle.loads(x) for x in pdf["body"]]
        replies = iter(gather([x for own in asked for _, x in own]))
        return pd.DataFrame({"grp": pdf["grp"], "chunk": pdf["chunk"], "bucket": pdf["bucket"], "body": [pickle.dumps([(batch, next(replies)) for batch, _ in own]) for own in asked]})

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The answers of a chunk, put together for each batch."""
        now, held = None, {}

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"batch": list(held), "bucket": now[0], "body": [pickle.dumps(x) for x in held.values()]})

        for pdf in frames:
            for g, c, b, body in zip(pdf["grp"].tolist(), pdf["chunk"].tolist(), pdf["bucket"].tolist(), pdf["body"], strict=True):
                if (g, c) != now:
                    if held:
                        yield rows()
                    now, held = (g, c), {}
                for batch, x in pickle.loads(body):
                    held.setdefault(batch, []).append((b, x))
        if held:
            yield rows()

    sent = rows.groupBy("batch").applyInPandas(send, "bucket bigint, batch bigint, body binary")
    if width == 1:
        replies = sent.groupBy("bucket").applyInPandas(answer, "batch bigint, bucket bigint, body binary")
    else:
        chunks = sent.repartition("bucket").sortWithinPartitions("bucket", "batch").mapInPandas(deal, "bucket bigint, grp bigint, chunk bigint, body binary")
        answers = chunks.groupBy("bucket").applyInPandas(answer_chunks, "grp bigint, chunk bigint, bucket bigint, body binary")
        replies = answers.repartition("grp").sortWithinPartitions("grp", "chunk", "bucket").mapInPandas(part, "batch bigint, bucket bigint, body binary")
    return rows.groupBy("batch").cogroup(replies.groupBy("batch")).applyInPandas(close, schema)
