"""Line dedup by a suffix array over line ids, built by distributed prefix doubling with DataFrame operations only.

The corpus is the sequence of its lines, document after document, in (doc_id, text hash, row) order. A suffix's name at
depth d is the first position at which the next d lines occur, so that names order the suffixes by their first d lines and
all suffixes with a longest common prefix of d or more form one interval. Doubling joins the names of a suffix and of the
suffix d lines on; suffixes whose interval has shrunk to one leave the race, and doubling goes on from `min_lines` until no
interval holds two. A position that its interval names elsewhere starts a later copy of at least d lines; the stretches that
later copies cover are deleted. `repeated_runs` also finds each copy's exact longest common prefix with an earlier place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import NULL_ID, spread_join, written

MIN_LINES = 3
_ROW, _LINE, _AT, _NAME = "__row", "__line", "__at", "__name"


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a row number that stays, for rows may repeat."""
    return written(docs.withColumn(_ROW, F.monotonically_increasing_id()), "rows")


def _lines(rows: DataFrame) -> DataFrame:
    """One row for each line: its row, its place, the order of its document, and its id."""
    lines = rows.select(_ROW, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("__k"), F.xxhash64("text").alias("__h"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias(_AT, _LINE))
    place = F.struct(F.col("__k").alias("k"), F.col("__h").alias("h"), F.col(_ROW).alias("row"), F.col(_AT).alias("at"))
    return lines.select(_ROW, _AT, place.alias("__place"), F.unhex(F.md5(F.col(_LINE).cast("binary"))).alias("__id"))


def _named(suffixes: DataFrame, key: list[str]) -> DataFrame:
    """Names suffixes by the first place of their key; drops those whose key occurs once. Suffixes of a very frequent key are
    spread over several tasks."""
    classes = suffixes.groupBy(*key).agg(F.count("*").alias("__n"), F.min("__place").alias(_NAME)).where("__n > 1")
    return spread_join(suffixes, written(classes, "classes"), key, F.xxhash64(_ROW, _AT)).select(_ROW, _AT, "__place", F.col(_NAME))


def _doubled(names: DataFrame, step: int) -> DataFrame:
    """Names of suffixes by the prefixes that two of their names, `step` lines apart, make together."""
    later = Window.partitionBy(_ROW).orderBy(_AT).rangeBetween(step, step)
    pairs = names.select(_ROW, _AT, "__place", F.col(_NAME).alias("__first"), F.first(_NAME).over(later).alias("__second")).where("__second is not null")
    return written(_named(pairs, ["__first", "__second"]), "names")


def line_suffixes(rows: DataFrame, depth: int) -> DataFrame:
    """Suffixes of the line sequence that share their first `depth` lines with another, with their names."""
    names = written(_named(_lines(rows), ["__id"]), "names")
    at = 1
    while at < depth:
        step = min(at, depth - at)
        names = _doubled(names, step)
        at += step
    return names


def intervals(rows: DataFrame, depth: int) -> dict[int, DataFrame]:
    """Names at `depth` and at its doubles, as long as two suffixes share such a prefix."""
    out, names = {}, line_suffixes(rows, depth)
    while not names.isEmpty():
        out[depth] = names
        names = _doubled(names, depth)
        depth *= 2
    return out


def _copies(names: DataFrame) -> DataFrame:
    return names.where(F.col(_NAME) != F.col("__place"))


def _with_end(names: DataFrame, places: DataFrame, depth: int) -> DataFrame:
    """places with __end, the name of the last `depth` lines of a prefix of __l lines; null where it is shared with none."""
    ends = names.select(F.col(_ROW).alias("__r"), F.col(_AT).alias("__a"), F.col(_NAME).alias("__end"))
    return places.join(ends, (F.col(_ROW) == F.col("__r")) & (F.col(_AT) + F.col("__l") - depth == F.col("__a")), "left").drop("__r", "__a")


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """The maximal later copies of runs of `min_lines` or more lines.

    Returns doc_id, start, n_lines, source_doc_id, source_start: lines of docs (doc_id, text), counted from 0, that repeat an
    earlier place, the first one that has them all; runs of a document may overlap but none lies in another. A null doc_id
    sorts first. Null and empty texts are one empty line; an empty table gives an empty result.
    """
    levels = intervals(_numbered(docs.select("doc_id", "text")), min_lines)
    found = None
    for depth, names in levels.items():
        p = _copies(names)
        if 2 * depth in levels:  # the longer prefix tells more
            p = p.join(_copies(levels[2 * depth]).select(_ROW, _AT), [_ROW, _AT], "left_anti")
        p = written(p.select(_ROW, _AT, "__place", F.col(_NAME).alias("__class"), F.col(_NAME).alias("__source"), F.lit(depth).alias("__len")), "runs")
        # the longest common prefix lies between depth and its double: two overlapping prefixes of that depth tell any length
        step = 1 << max(0, depth - 1).bit_length() >> 1
        while step and not p.isEmpty():
            asked = p.withColumn("__l", F.col("__len") + step)
            asked = _with_end(names, asked, depth)
            lengths = asked.where("__end is not null").select("__class", "__l").distinct()
            members = names.select(_ROW, _AT, "__place", F.col(_NAME).alias("__class")).join(lengths, "__class")
            first = _with_end(names, members, depth).where("__end is not null").groupBy("__class", "__l", "__end").agg(F.min("__place").alias("__first"))
            p = asked.join(first, ["__class", "__l", "__end"], "left")
            longer = F.coalesce(F.col("__first") != F.col("__place"), F.lit(False))
            p = written(p.select(_ROW, _AT, "__place", "__class", F.when(longer, F.col("__first")).otherwise(F.col("__source")).alias("__source"), F.when(longer, F.col("__l")).otherwise(F.col("__len")).alias("__len")), "runs")
            step >>= 1
        found = p if found is None else found.union(p)
    schema = "doc_id bigint, start int, n_lines bigint, source_doc_id bigint, source_start int"
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    end = F.col(_AT) + F.col("__len")
    before = F.max(end).over(Window.partitionBy(_ROW).orderBy(_AT).rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("__before", before).where((end > F.col("__before")) | F.col("__before").isNull())
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return runs.select(back("__place.k").alias("doc_id"), F.col(_AT).alias("start"), F.col("__len").cast("bigint").alias("n_lines"), back("__source.k").alias("source_doc_id"), F.col("__source.at").alias("source_start"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Deletes the later copies of repeated runs of lines, in one document or between documents.

    docs: doc_id, text and any other columns, which stay. A line goes if it is one of `min_lines` consecutive lines of its
    document that also stand at an earlier place (in doc_id order, null first, then by row and line; places may overlap, so a
    line that repeats six times at once keeps its first one). Returns the columns of docs with the text that is left, and
    n_lines and n_removed, whose names give way (a leading underscore) where docs has them. Texts that lose no line stay as they
    are, null included; a text that loses all its lines becomes empty. Line ends are \\n; other white space counts.
    """
    kept_names = docs.columns
    taken = {c.lower() for c in kept_names}
    n_lines, n_removed = ("_" * (n in taken) + n for n in ("n_lines", "n_removed"))
    rows = _numbered(docs)
    levels = intervals(rows.select(_ROW, "doc_id", "text"), min_lines)
    starts = [_copies(names).select(_ROW, _AT, (F.col(_AT) + depth).alias("__to")) for depth, names in levels.items()]
    starts = reduce(DataFrame.union, starts) if starts else rows.select(_ROW, F.lit(0).alias(_AT), F.lit(0).alias("__to")).limit(0)
    # later copies as stretches without gaps; what is left of a text is the slices between them
    w = Window.partitionBy(_ROW).orderBy(_AT, "__to")
    apart = F.col(_AT) > F.max("__to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = starts.withColumn("__new", F.when(apart, 1).otherwise(0)).withColumn("__g", F.sum("__new").over(w))
    stretches = islands.groupBy(_ROW, "__g").agg(F.min(_AT).alias("a"), F.max("__to").alias("b")).withColumn("n", F.col("b") - F.col("a"))
    change = stretches.groupBy(_ROW).agg(F.sum("n").alias("__lost"), F.sort_array(F.collect_list(F.struct("a", "b"))).alias("__cuts"))
    out = rows.join(change.hint("merge"), _ROW, "left")  # one plan at every size
    split = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    froms, tos = F.concat(F.array(F.lit(0)), F.col("__cuts.b")), F.concat(F.col("__cuts.a"), F.array(F.size(split)))
    left = F.flatten(F.transform(F.arrays_zip(froms.alias("x"), tos.alias("y")), lambda z: F.slice(split, z["x"] + 1, z["y"] - z["x"])))
    new = F.array_join(left, "\n")
    lines = F.size(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).cast("bigint")
    columns = [F.when(F.col("__lost").isNull(), F.col("text")).otherwise(new).alias("text") if c == "text" else F.col(f"`{c}`") for c in kept_names]
    return out.select(*columns, lines.alias(n_lines), F.coalesce("__lost", F.lit(0)).cast("bigint").alias(n_removed))
