"""SentencePiece encoding and decoding by streaming Viterbi.

The best segmentation maximises the sum of the pieces' scores. Positions arrive one by one; only the last `longest piece`
of them can still start a piece, so only their scores and backpointers are kept. Whenever the backpointer paths of all of
them meet in one boundary, every id before it is settled and leaves. Every text goes through this decoder. The pieces of
public vocabularies do not reach over the start of a word or from a word to the punctuation behind it, so all paths are sure
to meet there and at each line end: the stretch between two such boundaries is streamed when it is first met, and its
settled ids are remembered.
"""

from __future__ import annotations

import re
import string
import struct
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import id_key, key_id, session, text_bytes

SPACE = "▁"
#: Remembered segments; the store starts anew when it is full.
REMEMBERED = 400_000


class Vocabulary:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        own = [i for i in range(size) if i not in special and not model.is_byte(i)]
        self.ids = {self.pieces[i]: (i, model.get_score(i)) for i in own}
        self.longest = max(map(len, self.ids), default=1)
        self.prefixes = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        # of each prefix the piece's id and score, or nothing where it is no piece itself
        self.steps = {p: self.ids.get(p, ()) for p in self.prefixes}
        self.unknown = min((s for _, s in self.ids.values()), default=0.0) - 10
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        self.crosses = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        alone = "".join(c for c in "\n\t\r" if c not in inner)
        # segments between boundaries that no piece crosses: spaces and a word, the punctuation behind a letter or digit with what
        # follows it, a control character, or spaces at an end
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        marks = re.escape("".join(sorted(set(string.punctuation) - {y for x, y in pairs if x.isalnum()})))
        sign, other = rf"(?:(?![ {alone}])[\W_])", rf"(?:(?![ {alone}{marks}])[\W_])"
        word = rf" *+(?=[^ {alone}]){sign}*+(?:[^\W_]++(?:{other}{sign}*+)?+)*+"
        self.segment = re.compile("|".join([word, *([f"[{alone}]"] if alone else []), " +"]))
        self.hole = next(c for c in map(chr, range(0xFFFF, 0, -1)) if c not in self.prefixes and not 0xD800 <= ord(c) < 0xE000)
        self.unk = model.unk_id()
        self.bytes = [b""] * size
        for i in own:
            self.bytes[i] = self.pieces[i].replace(SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            self.bytes[i] = bytes([b])

    def fallback(self, char: str) -> list[int]:
        """The ids of a character without a piece: of its bytes, or of the unknown piece where the model lacks one of them."""
        ids = [self.byte_ids.get(b) for b in char.encode()]
        return [self.unk] if None in ids else ids


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class StreamingViterbi:
    """Takes characters, gives settled ids. The state is bounded by the longest piece, but where paths run side by side for long.

    Boundaries are extended one after the other, each once the longest piece that could start there is in sight. When no path
    reaches past the boundary that is next, all go through it, and what lies before is settled; where several boundaries are
    open for long, their paths are followed back to where they meet.
    """

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.text = ""  # characters since the last settled boundary
        self.best = [0.0]  # score of the best path to each boundary in it
        self.back: list[tuple[int, int]] = [(0, -1)]  # where its last piece starts, and the piece's id (-1: fallback)
        self.at = self.reach = 0  # the boundary to extend next, and the furthest that a path has reached

    def feed(self, text: str) -> list[int]:
        longest, out = self.v.longest, []
        for i in range(0, len(text), 4 * longest):
            self.text += text[i : i + 4 * longest]
            if len(self.text) - self.at > longest:
                out += self._extend(len(self.text) - longest)
        return out

    def _extend(self, stop: int) -> list[int]:
        v, out = self.v, []
        ids, step, longest, unknown = v.ids, v.steps.get, v.longest, v.unknown
        s = self.text.replace(SPACE, v.hole).replace(" ", SPACE)  # a literal U+2581 is no space
        n, best, back, a, reach = len(s), self.best, self.back, self.at, self.reach
        best += [float("-inf")] * (n + 1 - len(best))
        back += [(0, -1)] * (n + 1 - len(back))
        settled = 0
        while a < stop:
            if a > settled and (a == reach or a - settled >= 2 * longest):
                to = a if a == reach else self._meeting(a, reach)
                if to > settled:
                    out += self._ids(settled, to)
                    settled = to
            base = best[a]
            for e in range(a + 1, min(n, a + longest) + 1):
                found = step(s[a:e])
                if found is None:
                    break
                if found and base + found[1] > best[e]:
                    best[e], back[e] = base + found[1], (a, found[0])
                    if e > reach:
                        reach = e
            if s[a] not in ids and base + unknown > best[a + 1]:
                best[a + 1], back[a + 1] = base + unknown, (a, -1)
                if a + 1 > reach:
                    reach = a + 1
            a += 1
        self.at, self.reach = a - settled, reach - settled
        if settled:
            self.text, self.best = self.text[settled:], best[settled:]
            self.back = [(0, -1), *((x - settled, p) for x, p in back[settled + 1 :])]
        return out

    def _meeting(self, low: int, high: int) -> int:
        """The last boundary that the paths to all open boundaries have in common."""
        alive = {e for e in range(low, high + 1) if self.best[e] > float("-inf")}
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(self.back[last][0])
        return alive.pop()

    def _ids(self, since: int, to: int) -> list[int]:
        out, back = [], self.back
        while to > since:
            start, piece = back[to]
            out.append([piece] if piece >= 0 else self.v.fallback(self.text[start:to]))
            to = start
        return [i for part in reversed(out) for i in part]

    def finish(self) -> list[int]:
        out = self._extend(len(self.text))
        out += self._ids(0, len(self.text))
        self.__init__(self.v)
        return out


def encode_segment(vocab: Vocabulary, segment: str) -> list[int]:
    """The ids of what lies between two boundaries, by a stream of its own."""
    stream = StreamingViterbi(vocab)
    return stream.feed(segment) + stream.finish()


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.known: dict[str, bytes] = {}
        self.stream = StreamingViterbi(self.v)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; a text that is not empty starts with the usual extra space."""
        if not text:
            return b""
        if self.v.crosses:
            stream = StreamingViterbi(self.v)
            return np.array(stream.feed(" " + text) + stream.finish(), dtype="<u4").tobytes()
        segments = self.v.segment.findall(" " + text)
        got = list(map(self.known.get, segments))
        if None in got:
            for i in [i for i, x in enumerate(got) if x is None]:
                x = self.known.get(segments[i])
                if x is None:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    ids = self.stream.feed(segments[i]) + self.stream.finish()
                    x = struct.pack(f"<{len(ids)}I", *ids)
                    if len(segments[i]) <= 64:
                        self.known[segments[i]] = x
                got[i] = x
        return b"".join(got)

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of some ids."""
        raw = b"".join(map(self.v.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw[1:] if raw else raw


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """docs: doc_id, text; other columns are ignored. model: the path of a SentencePiece model file on every machine.

    Returns doc_id, ids (binary: little-endian unsigned 32-bit integers), n_ids, one row for each row of docs. Null and
    empty texts have no ids; a null doc_id stays null; equal rows give equal rows. A character without a piece becomes the ids of
    its bytes, and so does U+2581, which would otherwise come back as a space: every text survives the round trip, unless
    the model has no byte pieces; then such characters become the unknown piece and are lost.
    """
    session(docs)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model)
        for pdf in frames:
            ids = [c.encode(t.decode("utf-8", "replace")) for t in pdf["text"]]
            yield pd.DataFrame({"k": pdf["k"], "ids": ids, "n_ids": [len(x) // 4 for x in ids]})

    rows = docs.select(id_key().alias("k"), text_bytes().alias("text"))
    return rows.mapInPandas(work, "k bigint, ids binary, n_ids bigint").select(key_id().alias("doc_id"), "ids", "n_ids")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """encoded: doc_id, ids. Returns doc_id, text; null ids give an empty text."""
    session(encoded)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model)
        for pdf in frames:
            yield pd.DataFrame({"k": pdf["k"], "text": [c.decode(x or b"").decode("utf-8", "replace") for x in pdf["ids"]]})

    return encoded.select(id_key().alias("k"), "ids").mapInPandas(work, "k bigint, text string").select(key_id().alias("doc_id"), "text")


def encoded_digest(docs: DataFrame, model: str) -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_ids, ids_crc32, decoded_sha256, same (whether the text came back whole)."""
    from hashlib import sha256

    session(docs)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model)
        for pdf in frames:
            rows = []
            for t in pdf["text"]:
                ids = c.encode(t.decode("utf-8", "replace"))
                back = c.decode(ids)
                rows.append((len(ids) // 4, crc32(ids), sha256(back).hexdigest(), back == t))
            yield pd.DataFrame(rows, columns=["n_ids", "ids_crc32", "decoded_sha256", "same"]).assign(k=pdf["k"].to_numpy())

    rows = docs.select(id_key().alias("k"), text_bytes().alias("text"))
    out = rows.mapInPandas(work, "k bigint, n_ids bigint, ids_crc32 bigint, decoded_sha256 string, same boolean")
    return out.select(key_id().alias("doc_id"), "n_ids", "ids_crc32", "decoded_sha256", "same")
