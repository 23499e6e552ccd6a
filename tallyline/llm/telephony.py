"""Telephony audio as a media column: companded 8-bit samples and ADPCM blocks, decoded with numpy.

mu-law and A-law expand through tables of 256 entries built from their defining rules; ADPCM blocks advance in step, one
sample of all blocks at a time. Stored is a WAV file with 8-bit companded samples, of which the payload comes back bit for
bit; resampled linear PCM is a second column where asked for.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row

from tallyline.llm.common import id_key, key_id, new_path, session, text_bytes
from tallyline.llm.token_orc import sliced

UNIT, RATE = 64, 8000
#: Level of the zstd compression of the stored columns: samples repeat, but with other bytes between, so a low one is weak.
#: A page holds PAGE bytes, as a sample of PCM takes four times the room of a character and repeats lie as much farther apart.
#: A row group holds GROUP bytes, of its last pages as they are and of the others compressed: a reader takes some 4,096 rows of a
#: group at once. How much there is, is looked at after every row.
LEVEL, PAGE, GROUP = 11, 8 << 20, 12 << 20
STORED = {"compression": "zstd", "parquet.compression.codec.zstd.level": str(LEVEL), "parquet.page.size": str(PAGE), "parquet.block.size": str(GROUP), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
#: Bytes of text whose media are made at once, and of media that are read at once.
SLICE = 1 << 20
#: WAV format tags; fixed by the file format.
FORMATS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
#: Step change for each ADPCM code of three bits; fixed values of the codec.
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
#: Steps of the ADPCM quantiser; fixed values of the codec.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 255
    size = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 85
    part, size = a >> 4 & 7, (a & 15) << 4
    size = np.where(part == 0, size + 8, size + 264 << np.maximum(part - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM, one channel: blocks (n, size) of bytes to samples (n, 2 * (size - 4) + 1).

    A block starts with its first sample (16 bits, little-endian) and the index of its first step; low nibbles come first.
    """
    n, size = blocks.shape
    out = np.empty((n, 2 * (size - 4) + 1), dtype=np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    out[:, 0] = value
    codes = np.empty((n, 2 * (size - 4)), dtype=np.uint8)
    codes[:, 0::2], codes[:, 1::2] = blocks[:, 4:] & 15, blocks[:, 4:] >> 4
    codes = np.ascontiguousarray(codes.T)  # one row for each step in time
    for t in range(codes.shape[0]):
        c = codes[t]
        step = STEPS[index]
        diff = (step >> 3) + np.where(c & 4, step, 0) + np.where(c & 2, step >> 1, 0) + np.where(c & 1, step >> 2, 0)
        value = np.clip(value + np.where(c & 8, -diff, diff), -32768, 32767)
        index = np.clip(index + INDEX_STEPS[c & 7], 0, len(STEPS) - 1)
        out[:, t + 1] = value
    return out


def expand(payload: bytes, codec: str, block: int = UNIT) -> np.ndarray:
    """Linear 16-bit samples of a payload; an incomplete last ADPCM block is filled with zeros."""
    data = np.frombuffer(payload, dtype=np.uint8)
    if codec == "adpcm":
        if len(data) % block:
            data = np.append(data, np.zeros(-len(data) % block, dtype=np.uint8))
        return decode_adpcm(data.reshape(-1, block)).ravel()
    return (MULAW if codec == "mulaw" else ALAW)[data]


def expand_adpcm(payloads: list[bytes], block: int = UNIT, most: int = 2 << 20) -> Iterator[np.ndarray]:
    """The samples of payloads of whole ADPCM blocks; about `most` bytes of blocks of many payloads are decoded together."""
    at = 0
    while at < len(payloads):
        to, size = at, 0
        while to < len(payloads) and (to == at or size + len(payloads[to]) <= most):
            size += len(payloads[to])
            to += 1
        pcm = decode_adpcm(np.frombuffer(b"".join(payloads[at:to]), dtype=np.uint8).reshape(-1, block))
        ends = np.cumsum([len(p) // block for p in payloads[at:to]])
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            yield pcm[a:b].ravel()
        at = to


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation at the new rate, rounded half up in integers, so that every machine gets the same samples."""
    if not len(pcm) or rate == to:
        return pcm
    n = len(pcm) * to // rate
    if to % rate == 0:  # the same in whole steps
        step = to // rate
        a = pcm.astype(np.int32)
        b = np.append(a[1:], a[-1:])
        frac = np.arange(step, dtype=np.int32)
        return ((2 * (a[:, None] * (step - frac) + b[:, None] * frac) + step) // (2 * step)).astype(np.int16).ravel()
    num = np.arange(n, dtype=np.int64) * rate
    at, frac = num // to, num % to
    a, b = pcm[at].astype(np.int64), pcm[np.minimum(at + 1, len(pcm) - 1)].astype(np.int64)
    return ((a * (to - frac) + b * frac + to // 2) // to).astype(np.int16)


def wav(payload: bytes, codec: str, rate: int = RATE, block: int = UNIT) -> bytes:
    """A WAV file of one channel around a coded payload."""
    adpcm = codec == "adpcm"
    per_block = 2 * (block - 4) + 1
    samples = len(payload) // block * per_block if adpcm else len(payload)
    align, bits = (block, 4) if adpcm else (1, 8)
    extra = struct.pack("<HH", 2, per_block) if adpcm else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", FORMATS[codec], 1, rate, rate * block // per_block if adpcm else rate, align, bits) + extra
    pad = b"\0" * (len(payload) % 2)
    chunks = b"".join([b"fmt ", struct.pack("<I", len(form)), form, b"fact", struct.pack("<II", 4, samples), b"data", struct.pack("<I", len(payload)), payload, pad])
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def unwav(media: bytes) -> tuple[bytes, str, int]:
    """Payload, codec and rate of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, rate = 12, "", 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack("<HHI", media[at + 8 : at + 16])
            codec = {v: k for k, v in FORMATS.items()}[tag]
        elif name == b"data":
            return media[at + 8 : at + 8 + size], codec, rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def padded(text: bytes) -> bytes:
    """A text's bytes with zeros up to a positive multiple of the unit."""
    return text + b"\0" * (UNIT - len(text) if not text else -len(text) % UNIT)


def loudness(pcm: np.ndarray) -> str:
    """Mean square, mean absolute value, peak and sign changes, in integers."""
    if not len(pcm):
        return "0.0.0.0"
    square = total = peak = changes = 0
    for at in range(0, len(pcm), 1 << 20):
        x = pcm[at : at + (1 << 20)].astype(np.int32)
        size = np.abs(x)
        square, total, peak = square + int((x * x).sum(dtype=np.int64)), total + int(size.sum(dtype=np.int64)), max(peak, int(size.max()))
        changes += int(np.count_nonzero(np.diff(x < 0)))
    return f"{square // len(pcm)}.{total // len(pcm)}.{peak}.{changes}"


def _parts(rows: Iterator[Row], most: int) -> Iterator[list[Row]]:
    """Rows whose media, or what is last in them where there are none, begin within the same `most` bytes."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row.media or row[-1] or b"") + UNIT
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def store_media(docs: DataFrame, path: str | None = None, codec: str = "mulaw", rate: int = RATE, pcm_rate: int | None = None) -> str:
    """Writes doc_id, n_bytes, media (WAV) and, with pcm_rate, pcm (16-bit little-endian, resampled) as Parquet; returns the path.

    docs: doc_id, text; other columns are ignored. The payload is the text's UTF-8 bytes with zeros up to a positive
    multiple of 64; null is empty. One row for each row of docs: repeated rows are stored again, a null doc_id stays null, an
    empty table gives an empty one. Each task stores its rows in the order of their texts, so that like ones share a page, and
    makes the media of SLICE bytes of text at once, so the longest text bounds its memory.
    """
    spark = session(docs)
    path = path or new_path(spark, "media")
    names = ["k", "n_bytes", "media"] + ["pcm"] * bool(pcm_rate)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole, SLICE)):
            texts = batch.column("text").to_pylist()
            loads = [padded(t) for t in texts]
            columns = [batch.column("k"), pa.array([len(t) for t in texts], pa.int64()), pa.array([wav(x, codec, rate) for x in loads], pa.binary())]
            if pcm_rate:
                columns.append(pa.array([resample(expand(x, codec), rate, pcm_rate).astype("<i2").tobytes() for x in loads], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(id_key().alias("k"), text_bytes().alias("text")).sortWithinPartitions("text").mapInArrow(work, "k bigint, n_bytes bigint, media binary" + ", pcm binary" * bool(pcm_rate))
    rows.select(key_id().alias("doc_id"), *names[1:]).write.options(**STORED).parquet(path)
    return path


def media_features(media: DataFrame, pcm_rate: int = 2 * RATE) -> DataFrame:
    """doc_id, n_bytes, media and, where stored, pcm -> the digest and features of the stored bytes.

    The features are loudness figures of the resampled expansion, of the payload read as A-law, and of it read as ADPCM blocks.
    The first are those of the stored pcm where there is such a column (pcm_rate is not used then). Where media is null, so
    are all of the figures; a null pcm counts as no samples; other columns, of whatever name, are ignored. Rows come to
    Python through an RDD, so shuffles that `media` itself needs run when this is called.
    """
    spark = session(media)
    stored = ["pcm"] * ("pcm" in media.columns)

    def work(rows: Iterator[Row]) -> Iterator[tuple]:
        for part in _parts(rows, SLICE):
            yield from ((r.k, r.n_bytes, *[None] * 6) for r in part if r.media is None)
            part = [r for r in part if r.media is not None]
            opened = [unwav(r.media) for r in part]
            for r, (payload, codec, rate), blocks in zip(part, opened, expand_adpcm([padded(p) for p, _, _ in opened]), strict=True):
                linear = np.frombuffer(r.pcm or b"", dtype="<i2") if stored else resample(expand(payload, codec), rate, pcm_rate)
                feature = "|".join((loudness(linear), loudness(expand(payload, "alaw")), loudness(blocks)))
                yield r.k, r.n_bytes, len(payload), sha256(payload).hexdigest(), crc32(payload[-UNIT:]), len(r.media), sha256(r.media).hexdigest(), feature

    schema = "k bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    # not in Arrow, whose batches of 64 MB for each task lie beside the heap, in the JVM and again in Python
    rows = media.select(id_key().alias("k"), "n_bytes", "media", *stored).rdd.mapPartitions(work)
    out = spark.createDataFrame(rows, schema, verifySchema=False)
    return out.select(key_id().alias("doc_id"), *out.columns[1:])
