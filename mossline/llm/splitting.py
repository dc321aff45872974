"""Splitting oversized items at natural boundaries, by ranges of bytes.

A text, or a file of any size, is worked on in ranges of bytes, and no task holds a whole item. Workers look at one range
with a halo on both sides and note its boundaries: lines, and where these are long words, and where there are none the
characters of a grid. What a position is depends on nearby text only. The tables of the ranges are stitched: lengths in
characters, summed up per item, turn positions in a range into offsets from the item's start and give the lengths of
lines that go on over ranges. The tables of a segment of an item are then cut in order, from the segment's anchor to that
of the next; the pieces come out as offsets in bytes and characters, by which they are read from their range. The result
doesn't depend on how large the ranges are.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mossline.runtime import cut

LIMIT, OVERLAP = 2_000, 200
#: Bytes of a range, and of a segment, the stretch of an item that is cut in order.
RANGE_BYTES, SEGMENT_BYTES = 65_536, 1 << 18
#: Strength of a boundary: inside a word, between words, between lines, after a blank line, before a definition.
FORCED, WORD, LINE, BLANK, DEFINITION = range(5)
BREAKS = re.compile(r"\r\n|\r|\n")
WORD_START = re.compile(r"(?<=\s)\S")
STARTS_DEFINITION = re.compile(r"[ \t]*(?:@|(?:async[ \t]+def|def|class)\b)")
#: Characters that are looked at behind a boundary, and before it, to tell its strength.
AHEAD, BEHIND = 64, 1_000


def grid_of(limit: int, overlap: int) -> int:
    """Characters after which the next kind of boundary is noted, so that wherever a cut is due there is one shortly before."""
    return max(1, min(64, (overlap or limit // 2) // 4))


def decoded(data: bytes, whole_start: bool, whole_end: bool) -> tuple[str, int, np.ndarray | None]:
    """The text of some bytes, how many bytes of a cut character were left out before it, and the byte at which each character starts.

    None for the last if all are ASCII. A byte that is no UTF-8 counts as one character.
    """
    skipped = 0
    while not whole_start and skipped < min(3, len(data)) and data[skipped] & 0xC0 == 0x80:
        skipped += 1
    end = len(data)
    if not whole_end:
        back = next((k for k in range(1, min(4, end) + 1) if data[end - k] & 0xC0 != 0x80), 0)
        if back and data[end - back] >= 0xC0 and back < (2 if data[end - back] < 0xE0 else 3 if data[end - back] < 0xF0 else 4):
            end -= back
    text = data[skipped:end].decode("utf-8", "surrogateescape")
    if len(text) == end - skipped and text.isascii():
        return text, skipped, None
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sizes = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    sizes[(codes >= 0xDC80) & (codes <= 0xDCFF)] = 1
    return text, skipped, np.concatenate([[0], np.cumsum(sizes)])


def boundary_table(data: bytes, left: int, size: int, begin: int, last: bool, grid: int) -> tuple[int, list[int], list[int], list[int], int | None, int | None, int]:
    """(characters, bytes, places, strengths, end of the first line, start of the last line, longest line inside) of a range.

    data: the range with its halos; left: bytes before the range; size: bytes of it; begin: where in the item it begins;
    last: no range follows. Bytes and places, in characters, are from the range's start. A boundary belongs to the range
    in which what follows it begins; the end of the item is none, but ends a line.
    """
    text, skipped, starts = decoded(data, begin == left, last)
    char_of = (lambda b: max(0, b - skipped)) if starts is None else (lambda b: int(np.searchsorted(starts, max(0, b - skipped))))
    byte_of = (lambda c: c + skipped) if starts is None else (lambda c: int(starts[c]) + skipped)
    low = char_of(left)
    high = len(text) if last else char_of(left + size)
    found: list[tuple[int, int]] = []
    first = final = None
    inner, line = 0, 0

    def long_line(a: int, b: int) -> None:
        """Notes words of a line that begin more than a grid behind its start, and places of the grid between far words."""
        if b - a <= grid or b <= low or a >= high:
            return
        stops = [a, *(m.start() for m in WORD_START.finditer(text, max(a, low - 2 * grid) + 1, b)), b]
        for x, y in zip(stops, stops[1:], strict=False):
            if x - a > grid and low <= x < high:
                found.append((x, WORD))
            if y - x > grid and y > low:
                base, least, most = begin - left, max(x + grid + 1, low, 1), min(y, high) - 1
                if least > most:
                    continue
                for q in range(-(-(base + byte_of(least - 1) + 1) // grid) * grid, base + byte_of(most) + 1, grid):
                    c = char_of(q - base)
                    if not found or found[-1][0] != c:
                        found.append((c, FORCED))

    for m in BREAKS.finditer(text):
        at = m.end()
        long_line(line, m.start())
        if at > high:
            break
        if low <= at < high or (at == high and last):
            if first is None:
                first = m.start() - low
            else:
                inner = max(inner, m.start() - line)
            final = at - low
        if low <= at < high and begin - left + byte_of(at) > 0:
            before = text[max(line, m.start() - BEHIND) : m.start()]
            strength = BLANK if not before.strip() else LINE
            if STARTS_DEFINITION.match(text, at, at + AHEAD) and not before.lstrip().startswith("@"):
                strength = DEFINITION
            found.append((at, strength))
        line = at
    else:
        long_line(line, len(text))
    return high - low, [byte_of(c) - left for c, _ in found], [c - low for c, _ in found], [s for _, s in found], first, final, inner


def tables_of(slices: DataFrame, grid: int) -> DataFrame:
    """_id, _no, _begin, _size, _n, _chars, _bytes, _places, _strengths, _first, _final, _inner: the boundary table of each range."""
    kind = slices.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [batch.column(i).to_pylist() for i in range(2, 7)]
            rows = [boundary_table(data, left, size, begin, begin + size >= n, grid) for begin, left, size, n, data in zip(*numbers, strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(4), batch.column(5), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]],
                ["_id", "_no", "_begin", "_size", "_n", "_chars", "_bytes", "_places", "_strengths", "_first", "_final", "_inner"],
            )

    return slices.select("_id", "_no", "_begin", "_left", "_size", "_n", "_data").mapInArrow(
        run, f"_id {kind}, _no long, _begin long, _size int, _n long, _chars int, _bytes array<int>, _places array<int>, _strengths array<int>, _first int, _final int, _inner int"
    )


def stitched(tables: DataFrame) -> DataFrame:
    """_id, _no, _offset, _total, _longest: characters before each range and in the whole item, and the item's longest line."""
    own = tables.select("_id", "_no", "_chars", "_first", "_final", "_inner")
    before = Window.partitionBy("_id").orderBy("_no").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_id")
    placed = own.withColumn("_offset", F.coalesce(F.sum("_chars").over(before), F.lit(0)))
    begun = F.coalesce(F.max(F.col("_offset") + F.col("_final")).over(before), F.lit(0))
    lined = placed.withColumn("_begun", begun).withColumn("_total", F.sum("_chars").over(whole))
    ends = F.greatest(F.col("_inner"), F.coalesce(F.col("_offset") + F.col("_first") - F.col("_begun"), F.lit(0)))
    rest = F.col("_total") - F.coalesce(F.max(F.col("_offset") + F.col("_final")).over(whole), F.lit(0))
    return lined.select("_id", "_no", "_offset", "_total", F.greatest(F.max(ends).over(whole), rest).cast("int").alias("_longest"))


def pieces_between(places: list[int], strengths: list[int], start: int, end: int, limit: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, strength of the end) of the pieces from `start` to `end`, which cut at some of the boundaries.

    places: boundaries in order, also some before `start`. Every piece has at most `limit` characters and begins up to
    `overlap` before the end of the one before it, at a line if one begins there, else at a word. It ends at the strongest
    boundary of its last two thirds, the latest of equal ones; failing that at any line, then at a word, then anywhere.
    """
    done = start
    while done < end:
        first = done
        if done and overlap:
            near = range(bisect_left(places, done - overlap), bisect_left(places, done))
            first = next((places[i] for least in (LINE, WORD, FORCED) for i in near if strengths[i] >= least), done)
        if end - first <= limit:
            i = bisect_left(places, end)
            yield first, end, strengths[i] if i < len(places) and places[i] == end else DEFINITION
            return
        high = first + limit
        inside = range(bisect_right(places, done), bisect_right(places, high))
        late = done + (high - done) // 3
        best = max(((strengths[i], places[i]) for i in inside if strengths[i] >= LINE and places[i] > late), default=None)
        best = best or max(((strengths[i], places[i]) for i in inside if strengths[i] >= LINE), default=None) or max(((strengths[i], places[i]) for i in inside), default=None)
        if best is None:
            raise ValueError("no boundary within the limit")
        yield first, best[1], best[0]
        done = best[1]


def zone(limit: int) -> int:
    """Bytes behind the start of a segment in which its anchor is looked for; there is a boundary in any stretch of that length."""
    return 2 * limit + 64


def anchor(marks: list[tuple[int, int, int]], at: int, limit: int) -> int | None:
    """Which of the boundaries (byte, place, strength) a segment that begins at byte `at` begins with: the strongest near, the first of equal ones."""
    low, high = bisect_left(marks, (at,)), bisect_left(marks, (at + zone(limit),))
    return max(range(low, high), key=lambda i: (marks[i][2], -i), default=None)


def offsets_of(slices: DataFrame, limit: int, overlap: int, segment_bytes: int) -> DataFrame:
    """_id, _piece_no, _start, _end, _start_byte, _end_byte, _strength, _longest: the pieces of each item as offsets."""
    tables = cut(tables_of(slices, grid_of(limit, overlap)))
    known = tables.join(stitched(tables), ["_id", "_no"])
    back, ahead = 4 * (overlap + 1), zone(limit)
    low = F.floor(F.greatest(F.lit(0), F.col("_begin") - ahead) / segment_bytes)
    high = F.least(F.floor((F.col("_begin") + F.col("_size") - 1 + back) / segment_bytes), F.floor((F.col("_n") - 1) / segment_bytes))
    table = F.struct("_no", "_begin", "_offset", "_bytes", "_places", "_strengths").alias("_t")
    segments = known.withColumn("_segment", F.explode(F.sequence(low, high))).groupBy("_id", "_segment").agg(
        F.sort_array(F.collect_list(table)).alias("_tables"), F.first("_n").alias("_n"), F.first("_total").alias("_total"), F.first("_longest").alias("_longest")
    )
    kind = slices.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kept = [], []
            for i, (segment, tables, n, total) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 5)), strict=True)):
                marks = [(t["_begin"] + b, t["_offset"] + p, s) for t in tables for b, p, s in zip(t["_bytes"], t["_places"], t["_strengths"], strict=True)]
                places, strengths = [m[1] for m in marks], [m[2] for m in marks]
                byte_at = {p: b for b, p, _ in marks} | {0: 0, total: n}
                begin = anchor(marks, segment * segment_bytes, limit) if segment else None
                stop = anchor(marks, (segment + 1) * segment_bytes, limit)
                if segment and begin is None:
                    continue
                cuts = list(pieces_between(places, strengths, places[begin] if segment else 0, places[stop] if stop is not None else total, limit, overlap))
                kept.append(i)
                rows.append(([a for a, _, _ in cuts], [b for _, b, _ in cuts], [byte_at[a] for a, _, _ in cuts], [byte_at[b] for _, b, _ in cuts], [s for *_, s in cuts]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            own = [batch.column(c).take(pa.array(kept, pa.int64())) for c in (0, 1, 5)]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(list(c), pa.list_(pa.int64() if k < 4 else pa.int32())) for k, c in enumerate(columns)]], ["_id", "_segment", "_longest", "_starts", "_ends", "_from", "_to", "_kinds"])

    pieces = cut(
        segments.select("_id", "_segment", "_tables", "_n", "_total", "_longest")
        .mapInArrow(run, f"_id {kind}, _segment long, _longest int, _starts array<long>, _ends array<long>, _from array<long>, _to array<long>, _kinds array<int>")
    )
    earlier = Window.partitionBy("_id").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.select("_id", "_segment", F.size("_starts").alias("_k")).select("_id", "_segment", F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_before"))
    each = F.posexplode(F.arrays_zip("_starts", "_ends", "_from", "_to", "_kinds")).alias("_i", "_p")
    return pieces.join(counts, ["_id", "_segment"]).select("_id", "_before", "_longest", each).select(
        "_id", (F.col("_before") + F.col("_i")).alias("_piece_no"), F.col("_p._starts").alias("_start"), F.col("_p._ends").alias("_end"),
        F.col("_p._from").alias("_start_byte"), F.col("_p._to").alias("_end_byte"), F.col("_p._kinds").alias("_strength"), "_longest",
    )


def emitted(offsets: DataFrame, slices: DataFrame, range_bytes: int) -> DataFrame:
    """The offsets with the text of each piece, read from the range it begins in and that range's halo."""
    placed = offsets.withColumn("_no", F.floor(F.col("_start_byte") / range_bytes))
    data = slices.select("_id", "_no", "_begin", "_left", "_data")
    at = (F.col("_start_byte") - F.col("_begin") + F.col("_left") + 1).cast("int")
    own = F.substring("_data", at, (F.col("_end_byte") - F.col("_start_byte")).cast("int"))
    return placed.join(data, ["_id", "_no"]).select(*offsets.columns, F.make_valid_utf8(own.cast("string")).alias("_piece"))


def halos(limit: int, overlap: int) -> tuple[int, int]:
    """Bytes before and behind a range: what tells the strength of a boundary, and the rest of a piece."""
    return 4 * (BEHIND + 3 * grid_of(limit, overlap) + 8), 4 * (limit + AHEAD + 4)


def slices_of_texts(items: DataFrame, limit: int, overlap: int, range_bytes: int) -> DataFrame:
    """_id, _no, _begin, _left, _size, _n, _data: the ranges of each text (_id, _text) with their halos, each byte copied once or twice."""
    left, right = halos(limit, overlap)
    with_bytes = items.select("_id", F.col("_text").cast("binary").alias("_b")).select("_id", "_b", F.length("_b").cast("long").alias("_n"))

    def own(i: Column) -> Column:
        begin = i * range_bytes
        before = F.least(begin, F.lit(left))
        size = F.least(F.lit(range_bytes).cast("long"), F.col("_n") - begin)
        return F.struct(
            i.alias("_no"), begin.alias("_begin"), before.cast("int").alias("_left"), size.cast("int").alias("_size"),
            F.substring("_b", (begin - before + 1).cast("int"), (before + size + right).cast("int")).alias("_data"),
        )

    ranges = F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n") / range_bytes) - 1), own)
    return with_bytes.filter("_n > 0").select("_id", "_n", F.explode(ranges).alias("_r")).select("_id", "_n", "_r.*")


def split_offsets(items: DataFrame, *, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """key, piece_no BIGINT, start_char BIGINT, end_char BIGINT, boundary INT, longest_line INT: as `split_texts`, without the texts."""
    return _named(offsets_of(_slices(items, key, text, limit, overlap, range_bytes, segment_bytes), limit, overlap, segment_bytes), key)


def split_texts(items: DataFrame, *, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """key, piece_no BIGINT, start_char BIGINT, end_char BIGINT, boundary INT, longest_line INT, piece STRING.

    Only texts of more than `limit` code points are cut; others, and null ones, give no row. Joining the parts of all
    pieces from where the one before ends gives the text again. longest_line is that of the whole text. Null keys are
    dropped; of a key's rows the one with the longest text counts, then the one with the larger hash of it.
    """
    slices = _slices(items, key, text, limit, overlap, range_bytes, segment_bytes)
    return _named(emitted(offsets_of(slices, limit, overlap, segment_bytes), slices, range_bytes), key, "_piece")


def _slices(items: DataFrame, key: str, text: str, limit: int, overlap: int, range_bytes: int, segment_bytes: int) -> DataFrame:
    if not 0 <= overlap < limit // 2 or limit < 16:
        raise ValueError("the overlap must be less than half the limit, and that at least 16")
    if segment_bytes < 8 * limit or range_bytes < 1:
        raise ValueError("a segment must hold eight times the limit")
    long = items.select(F.col(key).alias("_id"), F.col(text).alias("_text")).filter((F.length("_text") > limit) & F.col("_id").isNotNull())
    once = long.groupBy("_id").agg(F.max_by("_text", F.struct(F.length("_text"), F.xxhash64("_text"))).alias("_text"))
    return slices_of_texts(once, limit, overlap, range_bytes)


def _named(pieces: DataFrame, key: str, *more: str) -> DataFrame:
    return pieces.select(
        F.col("_id").alias(key), F.col("_piece_no").alias("piece_no"), F.col("_start").alias("start_char"), F.col("_end").alias("end_char"),
        F.col("_strength").alias("boundary"), F.col("_longest").alias("longest_line"), *[F.col(c).alias(c[1:]) for c in more],
    )


def files_below(spark: SparkSession, path: str) -> DataFrame:
    """path, n_bytes of the files below a folder of any file system that Spark reads; their content isn't."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("n_bytes"))


def split_files(files: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = 1 << 20, segment_bytes: int = 1 << 20) -> DataFrame:
    """path, piece_no BIGINT, start_char BIGINT, end_char BIGINT, boundary INT, longest_line INT, piece STRING for files of UTF-8 text.

    files: path STRING (a local path or the URI of a file system that Arrow knows: file, hdfs, s3, gs), n_bytes BIGINT.
    Each worker reads its range with its halos and no more. A byte that is no UTF-8 counts as one character and is read
    as U+FFFD. Files of at most `limit` characters give one piece, empty ones none.
    """
    slices = slices_of_files(files, limit, overlap, range_bytes)
    return _named(emitted(offsets_of(slices, limit, overlap, segment_bytes), slices, range_bytes), "path", "_piece")


def slices_of_files(files: DataFrame, limit: int, overlap: int, range_bytes: int) -> DataFrame:
    """The same columns as `slices_of_texts`, read from files by their ranges."""
    left, right = halos(limit, overlap)
    n = F.ceil(F.col("n_bytes") / range_bytes).cast("long")
    work = files.filter("n_bytes > 0 and path is not null").groupBy("path").agg(F.max("n_bytes").alias("n_bytes")).select("path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("no")).repartition("path", "no")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, n_bytes, no in zip(batch["path"], batch["n_bytes"], batch["no"], strict=True):
                begin = int(no) * range_bytes
                before, size = min(begin, left), min(range_bytes, int(n_bytes) - begin)
                data = read_bytes(path, begin - before, min(int(n_bytes), begin + size + right) - begin + before)
                yield pd.DataFrame([(path, no, begin, before, size, n_bytes, data)], columns=["_id", "_no", "_begin", "_left", "_size", "_n", "_data"])

    return work.mapInPandas(run, "_id string, _no long, _begin long, _left int, _size int, _n long, _data binary")


def read_bytes(path: str, at: int, n: int) -> bytes:
    """n bytes of a file from `at` on."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as file:
        return file.read_at(n, at)


def rebuilt(pieces: DataFrame, *, key: str, text: str) -> DataFrame:
    """key, text: the items again, from the parts of their pieces that the piece before doesn't have."""
    before = F.coalesce(F.lag("end_char").over(Window.partitionBy(key).orderBy("piece_no")), F.lit(0))
    parts = pieces.withColumn("_part", F.substring("piece", (before - F.col("start_char") + 1).cast("int"), F.length("piece")))
    return parts.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_no", "_part"))), lambda p: p["_part"]), "").alias(text))


def latest_rows(nodes: DataFrame, *, key: str, text: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(_key, _text, _at, _hash of all rows, _key and _last of each key): what tells each key's row with the latest `at`, nulls first.

    Of equal times the larger hash of the text counts. The texts don't take part in the choice: only times and hashes are
    grouped, and of the texts only those that may be needed are joined to the chosen ones.
    """
    rows = nodes.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(at).alias("_at")).filter("_key is not null").withColumn("_hash", F.xxhash64("_text"))
    return rows, rows.groupBy("_key").agg(F.max(F.struct("_at", "_hash")).alias("_last"))


def oversized_latest(nodes: DataFrame, *, key: str, text: str, at: str, limit: int) -> DataFrame:
    """key, text of the rows that are the latest of their key and longer than `limit` code points, one row a key."""
    rows, last = latest_rows(nodes, key=key, text=text, at=at)
    long = rows.filter(F.length("_text") > limit)
    same = (long["_key"] == last["_key"]) & long["_at"].eqNullSafe(F.col("_last._at")) & (long["_hash"] == F.col("_last._hash"))
    return long.join(last, same).select(long["_key"].alias(key), long["_text"].alias(text)).dropDuplicates([key])
