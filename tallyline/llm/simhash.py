"""SimHash near-dedup with covering locality-sensitive hashing.

Each bit position i of a fingerprint has a vector m(i) of radius + 1 bits. Table v, for every non-zero v of so many bits,
keeps the positions with an odd overlap of m(i) and v. The vectors of at most `radius` differing positions span fewer than
radius + 1 dimensions, so some v is orthogonal to all of them and its table does not see the difference: every pair
within the radius shares a bucket of some table, with certainty.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import NULL_ID, count_slices, counted, id_key, key_id, mix, pair, released, session, spread_join, sum_slices, text_bytes, text_slices, word_table, written
from tallyline.llm.components import components

SHINGLE, RADIUS = 4, 4
#: Buckets with more fingerprints than this are not compared within one task but linked by midpoints.
BUCKET = 4096
#: Buckets of at most so many fingerprints are compared side by side with the others of their kind.
FEW = 8
#: Bytes of fingerprints that a part of a table takes on average, fingerprints that a task packs at once, and fingerprints of
#: one part that a task holds before it sets crowded buckets aside.
PART_BYTES, PACKED, HELD = 8 << 20, 1 << 17, 1 << 22
#: Bytes that one task takes of the midpoints.
MIDPOINT_BYTES = 32 << 20


def fingerprint_batch(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprints of some texts."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for i, text in enumerate(texts):
        words = text.lower().split()  # of bytes: A-Z and ASCII white space only
        if not words:
            continue
        joined = memoryview(b" ".join(words))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.append(0, ends[:-1] + 1)
        n = max(1, len(words) - shingle + 1)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)]
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, n, 1 << 16):
            part = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs: doc_id, text. Returns k (the doc_id without nulls) and fp, the fingerprint as a signed bigint."""
    session(docs)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"k": pdf["k"], "fp": fingerprint_batch(list(pdf["text"]), shingle).view(np.int64)})

    return docs.select(id_key().alias("k"), text_bytes().alias("text")).mapInPandas(work, "k bigint, fp bigint")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """One mask for each table."""
    top = (1 << (radius + 1)) - 1
    vectors = [i % top + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, top + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect the same fingerprints as all pairs within the radius do: each fingerprint is reached once."""
    left, out = values, []
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            x = reached.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                new = left[near]
                out += [(int(x), int(y)) for y in new]
                reached += list(new)
                left = left[~near]
    return out


def table_links(fps: np.ndarray, mask: int, radius: int, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct fingerprints with all members of the buckets they fall into in one table: links a and b that connect what
    the pairs of each bucket connect, and the members of buckets of more than `bucket`, which are left out of the links."""
    keys = fps & np.uint64(mask)
    order = np.lexsort((fps, keys))
    fps, keys = fps[order], keys[order]
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(fps)])
    sizes = np.diff(np.append(begins, len(fps)))
    size = np.repeat(sizes, sizes)
    out = [np.empty((0, 2), dtype=np.uint64)]
    few = np.flatnonzero(size <= min(FEW, bucket))
    for d in range(1, FEW):
        x = few[few + d < len(fps)]
        x = x[(keys[x] == keys[x + d]) & (np.bitwise_count(fps[x] ^ fps[x + d]) <= radius)]
        out.append(np.stack([fps[x], fps[x + d]], axis=1))
    for at, n in zip(begins.tolist(), sizes.tolist(), strict=True) if (sizes > FEW).any() else ():
        if FEW < n <= bucket:
            out.append(np.array(spanning_links(fps[at : at + n], radius), dtype=np.uint64).reshape(-1, 2))
    links = np.concatenate(out)
    return links[:, 0], links[:, 1], fps[size > bucket]


def crowded(fps: np.ndarray, mask: int, bucket: int) -> np.ndarray:
    """Which fingerprints fall into buckets of more than `bucket` of them."""
    _, which, n = np.unique(fps & np.uint64(mask), return_inverse=True, return_counts=True)
    return n[which] > bucket


def _gathered(frames: Iterator[pd.DataFrame], column: str = "fp") -> Iterator[np.ndarray]:
    """A column of fingerprints, PACKED of them at a time."""
    held, size = [], 0
    for pdf in frames:
        held.append(pdf[column].to_numpy(dtype=np.int64).view(np.uint64))
        size += len(pdf)
        if size >= PACKED:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def flips(radius: int) -> np.ndarray:
    """All words with at most half the radius of bits set, rounded up."""
    return np.array([sum(1 << i for i in c) for n in range(-(-radius // 2) + 1) for c in combinations(range(64), n)], dtype=np.uint64)


def midpoint_links(hot: DataFrame, radius: int, task_bytes: int = MIDPOINT_BYTES) -> DataFrame:
    """Links among the fingerprints of crowded buckets, in a number of steps linear in their number.

    Two fingerprints within the radius have a midpoint within half of it of both. Each fingerprint sends all such points,
    packed by hash; those that send the same point are linked in a star through an exact check of the radius.
    """
    pattern = flips(radius)
    parts = max(1, -(-hot.count() * len(pattern) * 16 // task_bytes))

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            all_fps = pdf["fp"].to_numpy(dtype=np.int64).view(np.uint64)
            for at in range(0, len(all_fps), 256):
                own = all_fps[at : at + 256]
                points, owner = (own[:, None] ^ pattern[None, :]).ravel(), np.repeat(own, len(pattern))
                part = (mix(points) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                for p in range(parts):
                    if cuts[p] < cuts[p + 1]:
                        idx = order[cuts[p] : cuts[p + 1]]
                        yield pd.DataFrame({"part": [p], "body": [np.concatenate([points[idx], owner[idx]]).tobytes()]})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        halves = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in pdf["body"]]
        points, owner = np.concatenate([x[0] for x in halves]), np.concatenate([x[1] for x in halves])
        order = np.lexsort((owner, points))
        points, owner = points[order], owner[order]
        near = (points[1:] == points[:-1]) & (owner[1:] != owner[:-1])
        # neighbours at one midpoint may be up to twice half the radius apart; odd radii need the check, even ones pass it
        links = np.unique(np.stack([owner[:-1][near], owner[1:][near]], axis=1), axis=0)
        if radius % 2:
            members = np.split(owner, np.flatnonzero(points[1:] != points[:-1]) + 1)
            found = {x for m in members if len(m) > 1 for x in spanning_links(np.unique(m), radius)}
            links = np.array(sorted(found), dtype=np.uint64).reshape(-1, 2)
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := parent.get(x, x)) != x:
                parent[x] = parent.get(y, y)
                x = y
            return x

        out = []
        for a, b in links.tolist():
            ra, rb = top(a), top(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
        pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return hot.select("fp").mapInPandas(send, "part bigint, body binary").groupBy("part").applyInPandas(meet, "a bigint, b bigint")


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, part_bytes: int = PART_BYTES, held: int = HELD) -> DataFrame:
    """fps: distinct fp. Returns links a, b with the components of all pairs within the radius.

    Every table is dealt into parts by a hash of its keys. A task packs the fingerprints it sends to a part, eight bytes each;
    no key travels and nothing is joined or broadcast. Whoever gets a part sets its crowded buckets aside as soon as it
    holds more than `held` fingerprints, so that a bucket of any size needs no more memory than that.
    """
    session(fps)
    masks = covering_masks(radius)
    parts = max(1, -(-fps.count() * 8 // part_bytes))  # of each table

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in _gathered(frames):
            for t, mask in enumerate(masks):
                part = (mix(own & np.uint64(mask)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                some = np.flatnonzero(np.diff(cuts))
                yield pd.DataFrame({"part": t * parts + some, "body": [own[order[cuts[p] : cuts[p + 1]]].tobytes() for p in some.tolist()]})

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links; a fingerprint of a crowded bucket is linked with itself."""
        now, mine, size, most, full = -1, [], 0, held, np.empty(0, dtype=np.uint64)

        def rows(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        def end() -> Iterator[pd.DataFrame]:
            if mine:
                a, b, hot = table_links(np.concatenate(mine), masks[now // parts], radius, bucket)
                yield rows(np.concatenate([a, hot]), np.concatenate([b, hot]))

        for pdf in frames:
            for part, body in zip(pdf["part"].tolist(), pdf["body"], strict=True):
                if part != now:
                    yield from end()
                    now, mine, size, most, full = part, [], 0, held, np.empty(0, dtype=np.uint64)
                new = np.frombuffer(body, np.uint64)
                if len(full):  # keys known as crowded
                    hot = np.isin(new & np.uint64(masks[now // parts]), full)
                    yield rows(new[hot], new[hot])
                    new = new[~hot]
                mine.append(new)
                size += len(new)
                if size > most:
                    every = np.concatenate(mine)
                    hot = crowded(every, masks[now // parts], bucket)
                    yield rows(every[hot], every[hot])
                    full = np.union1d(full, every[hot] & np.uint64(masks[now // parts]))
                    mine, size = [every[~hot]], int(np.count_nonzero(~hot))
                    most = max(held, 2 * size)
        yield from end()

    dealt = fps.select("fp").mapInPandas(send, "part bigint, body binary").repartition("part").sortWithinPartitions("part")
    found = written(dealt.mapInPandas(meet, "a bigint, b bigint"), "links")
    links = found.where("a <> b")
    hot = written(found.where("a = b").select(F.col("a").alias("fp")).distinct(), "hot")
    if not hot.isEmpty():
        links = links.union(midpoint_links(hot, radius))
    return links


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Groups documents whose fingerprints are linked through chains of at most `radius` differing bits.

    docs: doc_id, text; other columns are ignored. Returns doc_id, fingerprint (16 hexadecimal digits), component_id (the
    smallest doc_id of the group), one row for each row of docs. A text of fewer words than a shingle is one shingle; a
    text without words, or null, has fingerprint zero and is linked like any other. Rows with a null doc_id take part,
    and name a group only if no other row of it has an id (component_id is null then). An empty table gives an empty result.
    """
    marked = written(fingerprints(docs, shingle), "fingerprints")
    first = written(marked.groupBy("fp").agg(F.min(key_id()).alias("least"), F.count("*").alias("__n")), "first")
    roots = components(fingerprint_links(first.select("fp"), radius, bucket))
    both = roots.union(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "fp")
    linked = both.join(first.select("fp", "least"), "fp")
    low = linked.groupBy("root").agg(F.min("least").alias("low"))
    group = both.join(low, "root").select("fp", "low")
    each = written(first.join(group, "fp", "left").select("fp", "__n", F.coalesce("low", "least").alias("component_id")), "each")
    return spread_join(marked, each, ["fp"], F.col("k")).select(key_id().alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- near-duplicates by a similarity of shingle sets ----

#: Fingerprints of a text's set of words and the bits that may differ in them: candidates of an earlier rule, which tests
#: hold against the groups.
PRINTS, TOGETHER = 3, 32
#: Members of a crowded list that are compared at once.
BLOCK = 2048
#: Members of lists that one task compares on average.
TASK_MEMBERS = 100_000
#: Every round reaches so many times further among a list's neighbours.
REACH = 32
#: Shingles are counted by so many leading bits of their hashes: a table of fixed size.
COUNT_BITS = 21
_SALTS = mix(np.arange(1, 4097, dtype=np.uint64))


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, a text without words has none."""
    n = max(1, len(words) - shingle + 1) if words else 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(n)]
    return np.unique(np.array(hashes, dtype=np.uint64)).view(np.int64)


def _node(words: list[bytes]) -> int:
    """A hash of the word sequence."""
    return xxhash.xxh3_64_intdigest(b" ".join(words))


def shingles(lists: list[list[bytes]], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of each text in order: the text's number and a hash."""
    sizes = np.array([len(w) for w in lists], dtype=np.int64)
    _, _, words = word_table(b"".join(b" ".join(w) + b" " for w in lists if w))
    room = np.where(sizes > 0, np.maximum(sizes, shingle), 0)  # a shorter text is filled up
    filled = np.zeros(int(room.sum()), dtype=np.uint64)
    filled[np.arange(len(words)) + np.repeat((np.cumsum(room) - room) - (np.cumsum(sizes) - sizes), sizes)] = words
    n = np.where(room > 0, room - shingle + 1, 0)
    doc = np.repeat(np.arange(len(lists)), n)
    at = np.arange(len(doc)) + np.repeat((np.cumsum(room) - room) - (np.cumsum(n) - n), n)
    hashes = filled[at]
    for j in range(1, shingle):
        hashes = pair(hashes, filled[at + j])
    return doc, hashes


def batch_shingles(lists: list[list[bytes]], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text: the text's number and a hash, sorted by both."""
    doc, hashes = shingles(lists, shingle)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1]))[: len(doc)]
    return doc[new], hashes[new]


def _described(docs: DataFrame, shingle: int) -> DataFrame:
    """k, th (a hash of the text), node and fp (the fingerprint) for each document, and rows of slices of this task's shingle counts."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << COUNT_BITS, dtype=np.int64)
        for pdf in frames:
            for part in text_slices(pdf):
                lists = [t.lower().split() for t in part["text"]]
                nodes = np.array([_node(w) for w in lists], dtype=np.uint64).view(np.int64)
                counts += np.bincount((shingles(lists, shingle)[1] >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(counts))
                fps = fingerprint_batch(list(part["text"])).view(np.int64)
                yield pd.DataFrame({"k": part["k"], "th": part["th"], "node": nodes, "fp": fps, "slice": -1, "body": None})
        for i, body in count_slices(counts):
            yield pd.DataFrame({"k": [0], "th": [0], "node": [0], "fp": [0], "slice": [i], "body": [body]})

    rows = docs.select(id_key().alias("k"), F.xxhash64(text_bytes()).alias("th"), text_bytes().alias("text"))
    return rows.mapInPandas(work, "k bigint, th bigint, node bigint, fp bigint, slice int, body binary")


def _by_fingerprint(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """nodes: node, fp. Candidates by SimHash: the covering tables' links between fingerprints, each between the smallest nodes
    of either, and every other node of a fingerprint with its smallest."""
    least = written(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("__n")), "prints")
    left, right = (least.select(F.col("fp").alias(c), F.col("least").alias(f"l{c}")) for c in "ab")
    links = written(fingerprint_links(least.select("fp"), radius).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near")
    across = links.join(left, "a").join(right, "b").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
    within = spread_join(nodes, least, ["fp"], F.col("node")).where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return across.union(within)


def prefix(doc: np.ndarray, hashes: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which shingles, rarest first, stand in their text's prefix: index, place and size of the set.

    Two sets of a similarity s share a shingle among the first n - ceil(s n) + 1 of each in any one order of all shingles.
    """
    order = np.lexsort((hashes, counts, doc))
    sizes = np.bincount(doc)[doc]
    begins = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])[: len(doc)])
    place = np.arange(len(doc)) - np.repeat(begins, np.diff(np.append(begins, len(doc))))
    first = place <= sizes - np.ceil(similarity * sizes - 1e-9)
    return order[first], place[first], sizes[first]


def _prefixes(docs: DataFrame, counts: np.ndarray, shingle: int, similarity: float) -> DataFrame:
    """node, n (the size of its set), at (the place of a shingle of its prefix) and key (the shingle's hash).

    The order of all shingles is by the count of their class, then by their hash: shingles that meet in a class seem more
    frequent than they are, which changes the order but not what the prefixes guarantee. A node that comes again in a task
    is passed over; the rows may still hold a node several times.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # of fixed size: 4 bytes for each class

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in frames:
            for part in text_slices(pdf):
                lists, nodes = [], []
                for t in part["text"]:
                    words = t.lower().split()
                    node = _node(words)
                    if words and node not in seen:
                        seen.add(node)
                        lists.append(words)
                        nodes.append(node)
                if lists:
                    doc, hashes = batch_shingles(lists, shingle)
                    idx, place, sizes = prefix(doc, hashes, shared.value[(hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)], similarity)
                    yield pd.DataFrame({"node": np.array(nodes, dtype=np.uint64).view(np.int64)[doc[idx]], "n": sizes, "at": place, "key": hashes[idx].view(np.int64)})

    return docs.select(text_bytes().alias("text")).mapInPandas(work, "node bigint, n bigint, at bigint, key bigint")


def _in_company(tokens: DataFrame) -> DataFrame:
    """The rows of prefixes whose shingle stands in the prefixes of several nodes, each once, with size, the number of nodes."""
    crowd = tokens.groupBy("key").agg(F.min("node").alias("__a"), F.max("node").alias("__b"), F.count("*").alias("__n")).where("__a <> __b").select("key", "__n")
    some = written(spread_join(tokens, written(crowd, "crowd"), ["key"], F.col("node")).distinct(), "some")
    return spread_join(some, written(some.groupBy("key").agg(F.count("*").alias("size"), F.count("*").alias("__n")), "sizes"), ["key"], F.col("node"))


def can_reach(n1, at1, n2, at2, similarity: float):
    """At the first shingle that two sets share, in the order of rarity, no more than what follows in both can be common to them."""
    common = np.minimum(n1 - at1, n2 - at2)
    return common >= similarity * (n1 + n2 - common) - 1e-9


def block_pairs(pdf: pd.DataFrame, low: int, high: int, similarity: float) -> np.ndarray:
    """Pairs of members of one list (key, part) that lie low to high - 1 places apart, in different groups, and can reach the similarity."""
    pdf = pdf.assign(order=mix(pdf["node"].to_numpy(dtype=np.int64).view(np.uint64) ^ mix(pdf["salt"].to_numpy(dtype=np.int64).view(np.uint64))))
    pdf = pdf.sort_values(["key", "part", "order"], kind="stable")
    key, part, node, root, n, at = (pdf[c].to_numpy() for c in ("key", "part", "node", "root", "n", "at"))
    begins = np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]))
    block = np.cumsum(begins)
    out = [np.empty((0, 2), dtype=np.int64)]
    for d in range(low, min(high, int(np.bincount(block).max()))):
        x = np.flatnonzero((block[:-d] == block[d:]) & (root[:-d] != root[d:]))
        x = x[can_reach(n[x], at[x], n[x + d], at[x + d], similarity)]
        out.append(np.stack([np.minimum(node[x], node[x + d]), np.maximum(node[x], node[x + d])], axis=1))
    return np.unique(np.concatenate(out), axis=0)


PAIRS = "a bigint, b bigint"


def _neighbours(alive: DataFrame, turn: int, low: int, high: int, block: int, similarity: float) -> DataFrame:
    """Candidates among members low to high - 1 places apart. A list of at most `block` members keeps its order, so that all its
    pairs come up in the end; a longer one is cut into parts anew in every round."""
    tasks = max(1, -(-alive.count() // TASK_MEMBERS))
    crowded, side = F.col("size") > block, F.col("key").bitwiseAND(F.lit(1))
    salt = side + F.when(crowded, F.lit(2 * turn + 2)).otherwise(0)
    part = F.when(crowded, F.pmod(F.xxhash64("node", side, F.lit(turn)), F.ceil(F.col("size") / block))).otherwise(0).cast("bigint")
    rows = alive.where(F.col("size") > low).select("key", part.alias("part"), salt.cast("bigint").alias("salt"), "node", "root", "n", "at")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = block_pairs(pdf, low, high, similarity)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.groupBy(F.pmod(F.xxhash64("key", "part"), F.lit(tasks))).applyInPandas(work, PAIRS).distinct()


def _strangers(alive: DataFrame, block: int, similarity: float) -> DataFrame:
    """Candidates among all members of the lists of more than `block` members that are not of one group.

    Each member has one home part. Members of all groups but the list's largest visit every part, so that a list of which
    most members are joined already costs rows in proportion to its length. The visitors stream past a part's members.
    """
    lists = alive.where(F.col("size") > block).withColumn("parts", F.ceil(F.col("size") / block))
    largest = lists.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).getField("root").alias("largest"))
    home = lists.select("key", F.pmod(F.xxhash64("node"), F.col("parts")).cast("bigint").alias("part"), F.lit(False).alias("visits"), "node", "root", "n", "at")
    visits = lists.join(largest, "key").where("root <> largest").select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("visits"), "node", "root", "n", "at")
    rows = written(home.union(visits), "visits")
    tasks = max(1, -(-rows.count() // TASK_MEMBERS))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own = None, []
        for pdf in frames:
            cut = (pdf["key"].diff().ne(0) | pdf["part"].diff().ne(0) | (pdf["visits"] != pdf["visits"].shift())).cumsum()
            for _, some in pdf.groupby(cut.to_numpy(), sort=False):
                place = (int(some["key"].iloc[0]), int(some["part"].iloc[0]))
                if place != now:
                    now, own = place, []
                if not some["visits"].iloc[0]:
                    own.append(some)
                    continue
                if not own:
                    continue
                h = pd.concat(own) if len(own) > 1 else own[0]
                own = [h]
                node, root, n, at = (h[c].to_numpy() for c in ("node", "root", "n", "at"))
                for i in range(0, len(some), 256):
                    v = some.iloc[i : i + 256]
                    vn, vr, vs, va = (v[c].to_numpy()[:, None] for c in ("node", "root", "n", "at"))
                    x, y = np.nonzero((vr != root) & can_reach(vs, va, n, at, similarity))
                    pairs = np.unique(np.stack([np.minimum(vn[x, 0], node[y]), np.maximum(vn[x, 0], node[y])], axis=1), axis=0)
                    if len(pairs):
                        yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.repartition(tasks, "key", "part").sortWithinPartitions("key", "part", "visits").mapInPandas(work, PAIRS).distinct()


class _Checker:
    """Checks candidates exactly, by their texts' sets of shingles; a set is made once."""

    def __init__(self, docs: DataFrame, first: DataFrame, shingle: int, similarity: float):
        self.docs, self.first, self.shingle, self.similarity, self.sets = docs, first, shingle, similarity, None

    def _make(self, ends: DataFrame) -> None:
        shingle = self.shingle

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for part in text_slices(pdf, 1 << 20):
                    lists = [t.lower().split() for t in part["text"]]
                    nodes = np.array([_node(w) for w in lists], dtype=np.uint64).view(np.int64)
                    yield pd.DataFrame({"node": nodes, "hashes": [shingle_set(w, shingle) for w in lists]})

        # the smallest key of a node is enough to find one of its texts; other texts of that key drop out by their node
        keys = written(self.first.join(ends, "node").select("k").distinct(), "keys")
        texts = self.docs.select(id_key().alias("k"), text_bytes().alias("text")).join(counted(keys), "k", "left_semi")
        made = texts.mapInPandas(work, "node bigint, hashes array<bigint>").join(counted(ends), "node", "left_semi")
        new = written(made.groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")
        self.sets = new if self.sets is None else self.sets.union(new)

    def links(self, found: DataFrame) -> DataFrame:
        ends = found.select(F.col("a").alias("node")).union(found.select(F.col("b").alias("node"))).distinct()
        ends = written(ends if self.sets is None else ends.join(self.sets.select("node"), "node", "left_anti"), "ends")
        if not ends.isEmpty():
            self._make(ends)
        left, right = (self.sets.select(F.col("node").alias(c), F.col("hashes").alias(f"h{c}")) for c in "ab")
        both = counted(found).join(left, "a").join(right, "b")
        both = both.select("a", "b", F.size("ha").alias("na"), F.size("hb").alias("nb"), F.size(F.array_intersect("ha", "hb")).alias("common"))
        return both.where(F.col("common") >= self.similarity * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _groups(docs: DataFrame, shingle: int, similarity: float, block: int, reach: int) -> tuple[DataFrame, DataFrame]:
    """k, th and node of each document; and for each node its group's smallest node, root, if it is not its own."""
    described = written(_described(docs, shingle), "described")
    marked = described.where("slice < 0").select("k", "th", "node")
    first = written(described.where("slice < 0").groupBy("node").agg(F.min("k").alias("k"), F.min("fp").alias("fp")), "firsts")
    tokens = written(_prefixes(docs, sum_slices(described.where("slice >= 0"), COUNT_BITS), shingle, similarity), "prefixes")
    alive = written(_in_company(tokens).withColumn("root", F.col("node")), "members")
    widest = alive.agg(F.max("size")).first()[0] or 0
    check, roots = _Checker(docs, first, shingle, similarity), None

    def joined(found: DataFrame) -> bool:
        nonlocal roots, alive
        found = written(found, "candidates")
        if found.isEmpty():
            return False
        links = check.links(found)
        roots = components(links if roots is None else links.union(roots.select("node", "root")))
        every = alive.drop("root").join(counted(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
        # a list whose members are all of one group is done
        mixed = every.groupBy("key").agg(F.min("root").alias("__a"), F.max("root").alias("__b")).where("__a <> __b").select("key")
        alive = written(every.join(counted(written(mixed, "mixed")), "key", "left_semi").select(*alive.columns), "members")
        return True

    # SimHash links what lies within its radius; the rest of the similar pairs share a shingle of their prefixes, where the
    # first round links next neighbours, so that later ones find most groups joined
    joined(_by_fingerprint(first.select("node", "fp")))
    turn, low, high = 0, 1, 2
    while low < min(widest, block) and not alive.isEmpty():
        joined(_neighbours(alive, turn, low, high, block, similarity))
        turn, low, high = turn + 1, high, high * reach
    if widest > block and not alive.isEmpty():
        joined(_strangers(alive, block, similarity))
    return marked, roots if roots is not None else first.select("node", F.col("node").alias("root")).limit(0)


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, block: int = BLOCK, reach: int = REACH) -> DataFrame:
    """Groups documents linked by a Jaccard similarity of at least `similarity` of their sets of `shingle`-word shingles.

    The first candidates are those of SimHash (see near_duplicates): texts whose fingerprints of four-word shingles differ in at
    most RADIUS bits, found by the covering tables. Similar texts may lie farther apart than that, so more candidates
    come from a prefix filter: with the shingles of each set in one order, rarest in the corpus first, two sets of
    that similarity share a shingle of their prefixes, with certainty; every candidate is checked exactly. Texts of one
    word sequence are one node from the start. Rounds compare those that share a shingle with ever further
    neighbours, but never two of one group, so that a large group of copies takes a number of checks linear in its size.

    docs: doc_id, text; other columns are ignored. Returns doc_id, component_id (the smallest doc_id of the group), one row
    for each row of docs. A text of fewer words than a shingle is one shingle; texts without words, or null, are
    copies of each other and of nothing else. Rows with a null doc_id take part, and name a group only if no other row of it
    has an id (component_id is null then). An empty table gives an empty result.
    """
    with released(session(docs)):
        marked, roots = _groups(docs, shingle, similarity, block, reach)
        nodes = marked.groupBy("node").agg(F.min(key_id()).alias("least"), F.count("*").alias("__n"))
        named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        each = written(named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "__n", "component_id"), "each")
        return written(spread_join(marked, each, ["node"], F.col("k")).select(key_id().alias("doc_id"), "component_id"), "similar", outer=True)


def first_of_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each group of similar documents (see similar_documents) the row with the smallest doc_id, whole; rows without an id all stay.

    Of rows with one doc_id in one group the one whose text has the smallest hash stays, of equal rows one. All columns
    of docs are kept; an empty table gives an empty result.
    """
    with released(session(docs)):
        marked, roots = _groups(docs, shingle, similarity, BLOCK, REACH)
        marked = marked.where(F.col("k") != NULL_ID)
        nodes = marked.groupBy("node").agg(F.min(F.struct("k", "th")).alias("least"), F.count("*").alias("__n"))
        named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        each = written(named.join(named.groupBy("root").agg(F.min("least").alias("stays")), "root").select("node", "__n", "stays"), "each")
        gone = written(spread_join(marked, each, ["node"], F.col("k")).where(F.struct("k", "th") != F.col("stays")).select(F.col("k").alias("__k"), F.col("th").alias("__th")).distinct(), "dropped", outer=True)
        twice = written(marked.groupBy(F.col("k").alias("__k"), F.col("th").alias("__th")).agg(F.count("*").alias("n")).where("n > 1").drop("n").join(counted(gone), ["__k", "__th"], "left_anti"), "twice", outer=True)
    rows = docs.withColumns({"__k": id_key(), "__th": F.xxhash64(text_bytes())}).join(counted(gone), ["__k", "__th"], "left_anti")
    if not twice.isEmpty():
        rows = rows.join(counted(twice), ["__k", "__th"], "left_anti").unionByName(rows.join(counted(twice), ["__k", "__th"], "left_semi").dropDuplicates(["__k", "__th"]))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
