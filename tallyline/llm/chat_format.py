"""Chat formatting with offset-aligned loss masks.

Turns are rendered as `<|role|>\\n`, the text, `<|end|>\\n`. Inside texts `<|` never stands: `<`, any number of backslashes
and `|` get one backslash more, which reading takes away again. A conversation is rendered whole and encoded once with
character offsets; sorted spans of the answers meet the sorted spans of the tokens by binary search. Ids, offsets and masks
go from the tokenizer to the writer as Arrow arrays, some conversations at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import id_key, key_id, session
from tallyline.llm.token_orc import sliced

END_TURN = "<|end|>\n"
#: Characters after which a rendered conversation goes on in a further row. A turn is never cut. A new row starts with "<"
#: after a line end, where the tokenizer always starts anew, so the ids are those of the whole.
ROW_CHARS = 1 << 20
#: Characters whose tokens are Python objects at once, and characters of rows that go to the writer at once.
PIECE, BATCH_CHARS = 1 << 16, 1 << 18
#: Between such a character and a space or a line end no piece of a byte-level BPE reaches.
CUT = re.compile(r"[!-~](?=[ \n])")
#: For the table of formatted conversations: row groups stay small even if large rows follow many small ones (their size is
#: looked at after every row), so that neither the writer nor a batch of the vectorised reader, which never reaches over a row
#: group and takes some 60 bytes of heap for each token, holds many large rows.
STORED = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}

ROWS = "k bigint, part bigint, n_turns bigint, formatted string, spans array<struct<start:bigint,stop:bigint>>, ids array<int>, starts array<int>, stops array<int>, mask array<boolean>"
COUNTS = ["n_turns", "loss_chars", "formatted_chars", "n_ids", "n_loss_ids"]
SAID = "k bigint, part bigint, turns binary, loss binary, " + ", ".join(f"{c} bigint" for c in COUNTS)
DIGESTS = "k bigint, turns_sha256 string, loss_sha256 string, " + ", ".join(f"{c} bigint" for c in COUNTS)


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text) if "<" in text else text


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "<" in text else text


def render(role: str, text: str) -> tuple[str, str]:
    """A turn's head, and its text with the end mark still to come."""
    return "<|" + re.sub(r"\|(\\*)>", r"|\1\\>", escaped(role)) + "|>\n", escaped(text)


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text, and where the text stands, of each turn."""
    at = 0
    while at < len(formatted):
        head = formatted.index("|>\n", at + 2)
        stop = formatted.index(END_TURN, head + 3)
        role = re.sub(r"\|(\\*)\\>", r"|\1>", formatted[at + 2 : head])
        yield unescaped(role), unescaped(formatted[head + 3 : stop]), head + 3, stop
        at = stop + len(END_TURN)


def token_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens (start, stop) share a character with a span; both sorted, spans apart from each other."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), dtype=bool)
    at = np.searchsorted(spans[:, 0], offsets[:, 1], side="left") - 1
    return (at >= 0) & (spans[np.maximum(at, 0), 1] > offsets[:, 0])


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encoded(tokenizer, text: str, added: list[str], most: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a text, and (start, stop) of each in characters; long texts are encoded a piece at a time, with the same result.
    added: what the tokenizer looks for before it parts a text; a text that holds such a string is encoded whole."""
    ids, offsets, at = [], [], 0
    whole = len(text) <= most or any(a in text for a in added)
    while at < len(text):
        cut = None if whole else CUT.search(text, at + most - 1)
        to = cut.end() if cut else len(text)
        e = tokenizer.encode(text[at:to], add_special_tokens=False)
        ids.append(np.array(e.ids, dtype=np.int32))
        offsets.append(np.array(e.offsets, dtype=np.int32).reshape(-1, 2) + np.int32(at))
        at = to
    return np.concatenate([np.empty(0, np.int32), *ids]), np.concatenate([np.empty((0, 2), np.int32), *offsets])


def format_conversations(conversations: DataFrame, tokenizer: str, answers: tuple[str, ...] = ("assistant",), row_chars: int = ROW_CHARS) -> DataFrame:
    """Renders, encodes and masks conversations.

    conversations: conv_id, turn, role, text; other columns are ignored. Returns conv_id, part (0, and more for very long
    conversations), n_turns, formatted, spans (of answers, in characters, empty ones too), ids, starts and stops (the
    characters of each id), mask (of ids: shares a character with an answer). Turns go by turn (null first), then role, then text; null roles and texts are empty; rows
    with a null conv_id are one conversation. A conversation streams through its task and is never held whole.
    """
    session(conversations)
    columns = id_key("conv_id").alias("k"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    rows = conversations.select(*columns).repartition("k").sortWithinPartitions("k", "turn", "role", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(tokenizer)
        added = [x.content for x in t.get_added_tokens_decoder().values()]
        key, part, turns, pieces, spans, size, done, chars = None, 0, 0, [], [], 0, [], 0

        def row() -> tuple:
            text, own = "".join(pieces), np.array(spans, dtype=np.int64).reshape(-1, 2)
            ids, offsets = encoded(t, text, added)
            return key, part, turns, text, own, ids, offsets, token_mask(offsets, own[own[:, 0] < own[:, 1]])

        for batch in (x for whole in batches for x in sliced(whole)):
            for k, role, text in zip(*(batch.column(c).to_pylist() for c in ("k", "role", "text")), strict=True):
                if k != key or size >= row_chars:
                    if turns:
                        done.append(row())
                        chars += size
                    if chars >= BATCH_CHARS:
                        yield _batch(done)
                        done, chars = [], 0
                    part = part + 1 if k == key else 0
                    key, turns, pieces, spans, size = k, 0, [], [], 0
                head, body = render(role, text)
                if role in answers:
                    spans.append((size + len(head), size + len(head) + len(body)))
                pieces += [head, body, END_TURN]
                size += len(head) + len(body) + len(END_TURN)
                turns += 1
        if turns:
            yield _batch([*done, row()])

    return rows.mapInArrow(work, ROWS).select(key_id().alias("conv_id"), "part", "n_turns", "formatted", "spans", "ids", "starts", "stops", "mask")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    keys, parts, turns, texts, spans, ids, offsets, masks = zip(*rows, strict=True)

    def ends(lists: tuple) -> pa.Array:
        return pa.array(np.append(0, np.cumsum(list(map(len, lists)))), pa.int32())

    pairs, both, at = np.concatenate(spans), np.concatenate(offsets), ends(ids)
    own = pa.StructArray.from_arrays([pa.array(x) for x in pairs.T], names=["start", "stop"])
    columns = [pa.array(x, pa.int64()) for x in (keys, parts, turns)] + [pa.array(texts, pa.string()), pa.ListArray.from_arrays(ends(spans), own)]
    columns += [pa.ListArray.from_arrays(at, pa.array(x)) for x in (np.concatenate(ids), *both.T, np.concatenate(masks))]
    return pa.RecordBatch.from_arrays(columns, names=["k", "part", "n_turns", "formatted", "spans", "ids", "starts", "stops", "mask"])


def _table(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def masked_text(text: str, spans: list[tuple[int, int]], starts: np.ndarray, stops: np.ndarray) -> list[str]:
    """What the tokens under the mask (their first and last characters) hold of each span. A token may reach over a span's end
    into the template; that part is no answer."""
    steps = np.zeros(len(text) + 1, dtype=np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, stops, -1)
    under = np.cumsum(steps)[:-1] > 0
    return [text[a:b] if under[a:b].all() else "".join(text[i] for i in np.flatnonzero(under[a:b]) + a) for a, b in spans]


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted: rows of format_conversations, stored. Returns for each conversation what its output says.

    conv_id, n_turns, turns_sha256 (role, line end, text, line end of each turn), loss_chars and loss_sha256 (the
    unescaped answers, as far as the characters of tokens under the mask hold them), formatted_chars, n_ids, n_loss_ids. A
    null conv_id stays null; an empty table gives an empty result.
    """
    session(formatted)
    rows = formatted.select(id_key("conv_id").alias("k"), "part", "formatted", "spans", F.size("ids").cast("bigint").alias("n_ids"), "starts", "stops", "mask")
    rows = rows.mapInArrow(_said, SAID).repartition("k").sortWithinPartitions("k", "part")
    return rows.mapInArrow(_digests, DIGESTS).select(key_id().alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_ids", "n_loss_ids")


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each stored row: role, line end, text, line end of its turns; its unescaped answers as the mask has them; counts."""
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * len(COUNTS)]
    names, done, chars = ["k", "part", "turns", "loss", *COUNTS], [], 0
    for batch in batches:
        lists = {c: (batch.column(c).offsets.to_numpy(), batch.column(c).values) for c in ("spans", "starts", "stops", "mask")}
        for i, (k, part, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("k", "part", "n_ids")), strict=True)):
            text, own = batch.column("formatted")[i].as_py(), {c: values[at[i] : at[i + 1]] for c, (at, values) in lists.items()}
            mask, starts, stops = (own[c].to_numpy(zero_copy_only=False) for c in ("mask", "starts", "stops"))
            turns = [f"{role}\n{body}\n" for role, body, _, _ in parse(text)]
            spans = zip(*(own["spans"].field(c).to_pylist() for c in ("start", "stop")), strict=True)
            loss = "".join(map(unescaped, masked_text(text, list(spans), starts[mask], stops[mask])))
            done.append((k, part, "".join(turns).encode(), loss.encode(), len(turns), len(loss), len(text), n, int(mask.sum())))
            chars += len(text)
            if chars >= BATCH_CHARS:
                yield _table(done, kinds, names)
                done, chars = [], 0
    if done:
        yield _table(done, kinds, names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests and sums of the rows of each conversation, which stream by."""
    kinds, names = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * len(COUNTS)], ["k", "turns_sha256", "loss_sha256", *COUNTS]
    key, turns, loss, counts = None, None, None, None
    for batch in batches:
        done = []
        for k, more, answers, *own in zip(batch.column("k").to_pylist(), batch.column("turns"), batch.column("loss"), *(batch.column(c).to_pylist() for c in COUNTS), strict=True):
            if k != key:
                if counts:
                    done.append((key, turns.hexdigest(), loss.hexdigest(), *counts))
                key, turns, loss, counts = k, sha256(), sha256(), [0] * len(COUNTS)
            turns.update(more.as_buffer())
            loss.update(answers.as_buffer())
            counts = [a + b for a, b in zip(counts, own, strict=True)]
        if done:
            yield _table(done, kinds, names)
    if counts:
        yield _table([(key, turns.hexdigest(), loss.hexdigest(), *counts)], kinds, names)
