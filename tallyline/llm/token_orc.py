"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on the document ids."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.llm.common import id_key, key_id, new_path, session, size_of, text_bytes

END = 0
#: Bytes of text that one file takes on average, and of encoded ids that one stripe takes.
FILE_BYTES, STRIPE_BYTES = 64 << 20, 16 << 20
#: Segments that a generation of the memory holds, and bytes of text whose segments are told apart at once.
REMEMBERED, CHUNK = 400_000, 1 << 20
#: Rows that go to the writer at once.
ROWS = 500
#: Between a character that is no white space and ASCII white space no piece of a byte-level BPE reaches, nor from an ASCII
#: letter to ASCII punctuation.
SPACE = b" \n\r\t"
#: Other white space, at which the rule above need not hold: such texts are encoded in one piece.
OTHER_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff]")
#: Of each byte: 1 is white space by the rule above, 2 may begin other white space in UTF-8, 3 is a letter, 4 punctuation.
KIND = np.zeros(256, dtype=np.uint8)
KIND[list(SPACE)] = 1
KIND[list(string.ascii_letters.encode())] = 3
KIND[list(string.punctuation.encode())] = 4
KIND[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = 2


class SegmentEncoder:
    """Encodes whole texts with the tokenizers library, each distinct segment between certain boundaries once.

    The segments of a chunk of texts are cut and told apart as Arrow arrays; only its distinct ones are looked up. They are
    remembered in two generations: when the young one is full it takes the old one's place, and what is met again comes back
    from there, so frequent segments stay.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.added = [x.content for x in self.t.get_added_tokens_decoder().values()]
        # a byte-level piece has one character for each byte
        self.width = np.array([len(self.t.id_to_token(i) or "") for i in range(self.t.get_vocab_size())], dtype=np.int64)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, segments: list[bytes]) -> dict[bytes, bytes]:
        """Ids of segments not met before. Those that start with white space and end without it are encoded in rows, which the
        pieces' widths part again."""
        in_row, rest = [], []
        for s in segments:
            (in_row if s[0] in SPACE and s[-1] not in SPACE else rest).append(s)
        made = {}
        for at in range(0, len(in_row), 512):
            row = in_row[at : at + 512]
            ids = np.array(self.t.encode_batch_fast([b"".join(row).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.cumsum(self.width[ids])
            to = np.cumsum(list(map(len, row)))
            cut = np.searchsorted(ends, to)
            if cut[-1] != len(ids) - 1 or (ends[cut] != to).any():
                rest += row
                continue
            raw, cut = ids.tobytes(), ((cut + 1) * 4).tolist()
            made.update(zip(row, [raw[x:y] for x, y in zip([0, *cut[:-1]], cut, strict=True)], strict=True))
        if rest:
            made.update(zip(rest, self.whole([s.decode() for s in rest]), strict=True))
        return made

    def _ids(self, segments: list[bytes]) -> list[bytes]:
        """Ids of distinct segments."""
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        known = list(map(self.young.get, segments))
        missing = [s for s, x in zip(segments, known, strict=True) if x is None]
        if not missing:
            return known
        made = {s: x for s in missing if (x := self.old.get(s)) is not None}
        made.update(self._new([s for s in missing if s not in made]))
        self.young.update((s, x) for s, x in made.items() if len(s) <= 64)
        return [made[s] if x is None else x for s, x in zip(segments, known, strict=True)]

    def chunks(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The texts in their order, some at a time: ids of all of them, and where each text's ids start and end in these."""
        at, raw = 0, [t.encode() for t in texts]
        while at < len(raw):
            to, size = at, 0
            while to < len(raw) and (to == at or size + len(raw[to]) <= CHUNK):
                size += len(raw[to])
                to += 1
            yield self._chunk(texts[at:to], raw[at:to])
            at = to

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        return [values[a:b].tobytes() for values, at in self.chunks(texts) for a, b in zip(at[:-1], at[1:], strict=True)]

    def _chunk(self, texts: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        docs = np.append(0, np.cumsum(list(map(len, raw))))
        kind = KIND[data]
        maybe = set(np.searchsorted(docs, np.flatnonzero(kind == 2), "right").tolist())
        odd = [i for i, t in enumerate(texts) if (i + 1 in maybe and OTHER_SPACE.search(t)) or any(a in t for a in self.added)]
        space = kind == 1
        starts = np.zeros(len(data) + 1, dtype=bool)
        starts[1:-1] = (space[1:] & ~space[:-1]) | ((kind[1:] == 4) & (kind[:-1] == 3))
        starts[docs] = True
        starts = np.flatnonzero(starts).astype(np.int32)
        segments = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        which = segments.indices.to_numpy()
        _, ends, distinct = segments.dictionary.buffers()
        ends, distinct = np.frombuffer(ends, np.int32)[: len(segments.dictionary) + 1].tolist(), distinct.to_pybytes()
        known = self._ids([distinct[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
        size = np.fromiter(map(len, known), np.int32, len(known)) // 4
        first = np.cumsum(size, dtype=np.int32) - size
        each = size[which]
        upto = np.append(np.int32(0), np.cumsum(each, dtype=np.int32))
        values = np.frombuffer(b"".join(known), "<u4")[np.repeat(first[which] - upto[:-1], each) + np.arange(upto[-1], dtype=np.int32)]
        at = upto[np.searchsorted(starts, docs)]
        if not odd:
            return values, at
        parts = np.split(values, at[1:-1])
        for i, ids in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
            parts[i] = np.frombuffer(ids, "<u4")
        return np.concatenate(parts), np.append(0, np.cumsum(list(map(len, parts)))).astype(np.int32)


@lru_cache(maxsize=2)
def encoder(path: str) -> SegmentEncoder:
    return SegmentEncoder(path)


def sliced(batch: pa.RecordBatch, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many bytes of text, or one row: only a part's texts become Python objects at once."""
    ends, at = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, end: int = END, file_bytes: int = FILE_BYTES, stripe_bytes: int = STRIPE_BYTES) -> str:
    """Encodes whole texts, appends the id `end` to each, and writes them in ascending doc_id order. Returns the path.

    docs: doc_id, text; other columns are ignored. Null and empty texts hold the end id alone; null doc_ids come first; rows
    with one doc_id follow each other by their text. The files part the id range in order; ORC keeps minima, maxima
    and a Bloom filter of doc_id for every stripe and row group, so a lookup reads the stripes that may hold the id.
    """
    spark = session(docs)
    path = path or new_path(spark, "tokens")
    files = max(spark.sparkContext.defaultParallelism, -(-size_of(docs) // file_bytes))
    rows = docs.select(id_key().alias("k"), text_bytes().alias("text")).repartitionByRange(files, "k").sortWithinPartitions("k", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for batch in (part for whole in batches for part in sliced(whole)):
            row = 0
            for ids, at in e.chunks([t.decode("utf-8", "replace") for t in batch.column("text").to_pylist()]):
                values = np.insert(ids, at[1:], np.uint32(end)).view(np.int32)
                at = at + np.arange(len(at), dtype=np.int32)
                for lo in range(0, len(at) - 1, ROWS):
                    to = at[lo : lo + ROWS + 1]
                    lists = pa.ListArray.from_arrays(pa.array(to - to[0]), pa.array(values[to[0] : to[-1]]))
                    yield pa.RecordBatch.from_arrays([batch.column("k").slice(row, len(to) - 1), pa.array(np.diff(to), pa.int64()), lists], names=["doc_id", "n_tokens", "ids"])
                    row += len(to) - 1

    out = rows.mapInArrow(work, "doc_id bigint, n_tokens bigint, ids array<int>")
    options = {"compression": "snappy", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(stripe_bytes)}
    out.select(key_id("doc_id").alias("doc_id"), "n_tokens", "ids").write.options(**options).orc(path)
    return path


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """The stored rows: doc_id, n_tokens, ids. A condition on doc_id reaches the stripes' statistics and Bloom filters."""
    rows = spark.read.schema("doc_id bigint, n_tokens bigint, ids array<int>").orc(path)
    return rows if where is None else rows.where(where)


def token_offsets(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the stored rows, read back from the files."""
    rows = spark.read.schema("doc_id bigint, n_tokens bigint, ids array<int>").orc(path)
    rows = rows.select(F.col("_metadata.file_name").alias("file"), id_key().alias("k"), "ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<i4", copy=False)
            sums = [crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("k"), pa.array(np.diff(at), pa.int64()), pa.array(sums, pa.int64())], names=["file", "k", "n_tokens", "ids_crc32"])

    read = rows.mapInArrow(work, "file string, k bigint, n_tokens bigint, ids_crc32 bigint")
    # files part the ids in the order of their names; one row for each file
    sizes = spark.read.schema("n_tokens bigint").orc(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.sum("n_tokens").alias("total"))
    before = sizes.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("base"))
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("k", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = read.withColumn("upto", within).join(before, "file")
    return out.select(key_id().alias("doc_id"), (F.col("base") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
