"""Deduplication of repeated byte strings by suffix arrays, sorted in two stages.

Text is removed where a string of `width` bytes also starts earlier: in a document
of smaller id or further up in the same one.  A corpus has as many suffixes as
bytes, of which few can repeat, so the arrays are built over what can:

1. A window of `width` bytes has an anchor, the least hashed `gram` bytes in it.
   Equal windows have equal anchors, so only windows whose anchor occurs twice in
   the corpus (of texts that are equal only the first counts) can repeat.
2. Consecutive windows of one anchor are cut out as strings of at most 64 windows.
   Equal strings are one, with their first and last source coordinate (document,
   text, byte).  Strings of an anchor with more than `hot` different ones, as at the
   ends of a passage that many documents quote, are cut into parts of 16 windows by
   the anchor's place in them.  All windows of a part share a core of 85 bytes; only
   parts whose core recurs go on, equal ones as one, and where more than `hot`
   different ones share a core these are cut again, with longer cores.
3. Strings are dealt by anchor to groups of about a megabyte, each of which gets its
   suffix array.  Only suffixes smaller than their successors are sorted directly;
   scanning the buckets of first bytes upwards then induces the others: each suffix
   met puts its predecessor, if larger, at the next place of the predecessor's
   bucket.  Neighbours in the array with a common prefix of `width` bytes are one
   class of windows; all of a class but its earliest coordinate are repeats.
4. Repeats go back by joins to all documents that hold the string, which are cut.

Coordinates are ordered by id, then by a hash of the text, then by byte.  Strings
are sorted to a depth of `width` rounded up to words of 8 bytes.

Defined results: null and empty texts have no bytes; texts shorter than `width` stay
whole; equal rows are judged alike, as one; rows that share an id but not the text
count as earlier or later by the hash of their texts; a null id is neither smaller
nor larger than others, so its row loses only what it repeats itself; an empty table
gives an empty result; very long texts are read in stretches.  Only the id and the
text are read, so docs' further columns change nothing.  Hashes only choose
candidates and name equal strings (128 bits); bytes decide what is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .arrow import TEXT, column, emit_rows, lists, map_texts, pieces
from .cluster import discard, settled, written, written_at
from .tokens import _RANDOM, mix, text_buffer, window_hashes

STRETCH = 4 << 20
GROUP_BYTES = 1 << 20
MASK = 64
PARTS = 4
END = 0xFF  # in no UTF-8 text


def _sliding(values: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    out, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        out = least(out[:-step], out[step:]) if len(out) > step else out[:0]
        reach += step
    return out


def _stretches(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first byte, data, offsets) of pieces that hold every window; only one row's text is ever cut."""
    if len(offsets) > 2 or len(data) <= 2 * STRETCH:
        yield 0, data, offsets
    else:
        for at in range(0, len(data), STRETCH):
            own = data[at : at + STRETCH + width - 1]
            yield at, own, np.array([0, len(own)])


def anchored(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whole windows (first bytes), their rows and anchors' hashes, and the hashes of all grams."""
    hashes = window_hashes(_RANDOM[data], gram)
    least = _sliding(hashes, width - gram + 1, np.minimum)
    sizes = np.maximum(np.diff(offsets) - width + 1, 0)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(rows)) + np.repeat(offsets[:-1] - (np.cumsum(sizes) - sizes), sizes)
    return at, rows, least[at] if len(at) else np.zeros(0, np.uint64), hashes


def sign(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """Of (doc, digest, key, n_bytes, body): without body, with the hashes of each text's anchors, and those of them at several places."""

    def prepare():
        def make(bodies: pa.Array, _: pa.RecordBatch) -> list[pa.Array]:
            data, offsets = text_buffer(bodies)
            found: list[np.ndarray] = []
            for first, own, bounds in _stretches(data, offsets, width):
                at, rows, anchor, hashes = anchored(own, bounds, width, gram)
                if len(at):
                    # a gram is an anchor if the greatest of the least hashes of the windows around it is its own
                    least = np.zeros(len(hashes) + width - gram, np.uint64)
                    least[at + width - gram] = anchor
                    place = np.flatnonzero((_sliding(least, width - gram + 1, np.maximum)[: len(hashes)] == hashes) & (hashes > 0))
                    row = np.searchsorted(bounds, place, "right") - 1
                    found.append(np.stack([row.astype(np.uint64), hashes[place], (place + first).astype(np.uint64)]))
            row, value, place = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.uint64)
            order = np.lexsort((place, value, row))
            row, value, place = row[order], value[order], place[order]
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
            other = ~fresh
            other[1:] &= place[1:] != place[:-1]  # stretches overlap
            number = np.cumsum(fresh) - 1
            several = np.zeros(int(fresh.sum()), bool)
            several[number[other]] = True
            row, value = row[fresh].astype(np.int64), value[fresh].view(np.int64)
            rows = np.arange(len(bodies) + 1)
            return [lists(value, np.searchsorted(row, rows)), lists(value[several], np.searchsorted(row[several], rows))]

        return make

    return map_texts(docs, "body", ["doc", "digest", "key", "n_bytes"], "grams array<long>, again array<long>", prepare)


def candidates(signed: DataFrame) -> DataFrame:
    """(doc, key, grams): of the first document of each text, the anchors that occur at two places."""
    firsts = signed.groupBy("digest", F.col("doc").isNull().alias("lone")).agg(
        F.min("doc").alias("doc"), F.first("key").alias("key"), F.first("grams").alias("grams"), F.first("again").alias("again")
    )
    firsts, firsts_at = written_at(firsts.drop("digest"))
    grams = firsts.where("not lone").select("doc", "key", F.explode("grams").alias("gram"))
    shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    both = grams.join(shared.hint("shuffle_hash"), "gram").unionByName(firsts.select("doc", "key", F.explode("again").alias("gram")))
    out = written(both.groupBy("doc", "key").agg(F.collect_set("gram").alias("grams")))
    discard(signed.sparkSession, firsts_at)
    return out


OCCURRENCES = "doc long, key long, at long, gram long, body binary"


def occurrences(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """Of (doc, key, body, grams): the strings of consecutive windows whose anchor is one of grams."""

    def prepare():
        def make(bodies: pa.Array, batch: pa.RecordBatch) -> list:
            data, offsets = text_buffer(bodies)
            wanted = column(batch, "grams")
            owner = np.repeat(np.arange(len(bodies), dtype=np.uint64), wanted.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            salt = np.uint64(0x9E3779B97F4A7C15)
            wanted = np.unique(mix(wanted.flatten().to_numpy(zero_copy_only=False).view(np.uint64) + owner * salt))
            docs, keys = column(batch, "doc"), column(batch, "key").to_numpy(zero_copy_only=False)
            out = []
            for base, own, bounds in _stretches(data, offsets, width):
                at, row, anchor, _ = anchored(own, bounds, width, gram)
                fresh = np.ones(len(at), bool)
                fresh[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(fresh)
                n = np.diff(np.append(first, len(at)))
                kept = np.isin(mix(anchor[first] + row[first].astype(np.uint64) * salt), wanted)
                first, n = first[kept], n[kept]
                parts = -(-n // MASK)
                inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                first, n = np.repeat(first, parts) + MASK * inner, np.minimum(np.repeat(n, parts) - MASK * inner, MASK)
                size = n + width - 1
                ends = np.concatenate([[0], np.cumsum(size)])
                places = np.repeat(at[first] - ends[:-1], size) + np.arange(ends[-1])
                body = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(own[places])])
                out.append([docs.take(pa.array(row[first])), keys[row[first]], at[first] + base - bounds[row[first]], anchor[first].view(np.int64), body])
            one = [[x[i] for x in out] for i in range(5)]
            return [pa.concat_arrays(one[0]), *(np.concatenate(x) for x in one[1:4]), pa.concat_arrays(one[4])]

        return make

    return emit_rows(texts, "body", ["doc", "key", "grams"], OCCURRENCES, prepare)


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; data ends in END, which nothing follows."""
    n = len(data)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    step[-1] = -1
    ahead = np.minimum.accumulate(np.where(step != 0, np.arange(n), n)[::-1])[::-1]  # the next place with another byte after it
    return step[ahead] > 0


def _words(data: np.ndarray, more: int) -> np.ndarray:
    """The 8 bytes from each place on, as one number; what is beyond the end, by `more` places at most, reads as 0."""
    padded = np.concatenate([data, np.zeros(more + 8, np.uint8)])
    return np.ndarray((len(data) + more,), ">u8", padded.tobytes(), 0, (1,))


def sorted_directly(data: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """places by their suffixes' first `depth` bytes, 8 bytes at a time; only what still ties is looked at again."""
    words = _words(data, depth + 8)
    first = words[places].astype(np.uint64)
    order = np.argsort(first)
    places, first = places[order], first[order]
    fresh = np.ones(len(places) + 1, bool)
    fresh[1:-1] = first[1:] != first[:-1]
    open_ = np.flatnonzero(~(fresh[:-1] & fresh[1:]))  # in a group of several
    group = np.cumsum(fresh[:-1])[open_]
    for at in range(8, depth, 8):
        if not len(open_):
            break
        own = places[open_]
        word = words[own + at].astype(np.uint64)
        order = np.lexsort((word, group))
        word = word[order]
        places[open_] = own[order]
        fresh = np.ones(len(own) + 1, bool)
        fresh[1:-1] = (group[1:] != group[:-1]) | (word[1:] != word[:-1])
        left = ~(fresh[:-1] & fresh[1:])
        group, open_ = np.cumsum(fresh[:-1])[left], open_[left]
    return places


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """All places of data by their suffixes, to at least `depth` bytes, in two stages; data ends in END."""
    n = len(data)
    smaller = smaller_than_next(data)
    direct = sorted_directly(data, np.flatnonzero(smaller), depth)
    cuts = np.searchsorted(data[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[END].append(np.array([n - 1]))  # what precedes the empty suffix
    out = []

    def induce(scanned: np.ndarray, c: int) -> np.ndarray:
        """Deals the larger predecessors of what was scanned in bucket c to their buckets; returns those of bucket c."""
        before = scanned[scanned > 0] - 1
        before = before[~smaller[before]]
        first = data[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        edges = np.flatnonzero(np.diff(first)) + 1
        same = before[:0]
        for part in np.split(before, edges):
            if len(part):
                if data[part[0]] == c:
                    same = part
                else:
                    waiting[data[part[0]]].append(part)
        return same

    for c in range(256):
        found = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        waiting[c] = []
        while len(found):  # a run of one byte induces within its bucket
            out.append(found)
            found = induce(found, c)
        part = direct[cuts[c] : cuts[c + 1]]
        if len(part):
            out.append(part)
            induce(part, c)
    return np.concatenate(out)


def common_prefix(data: np.ndarray, array: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in the array, up to `depth`."""
    out = np.zeros(len(array), np.int64)
    words = _words(data, depth + 8)
    left = np.arange(1, len(array))
    for at in range(0, depth, 8):
        x = words[array[left] + at].astype(np.uint64) ^ words[array[left - 1] + at].astype(np.uint64)
        differ = x != 0
        # the highest byte that differs is the first in the text
        high = np.zeros(int(differ.sum()), np.int64)
        for k, least in enumerate((1 << np.arange(8, 64, 8, dtype=np.uint64)).tolist()):
            high[x[differ] >= least] = k + 1
        out[left[differ]] = at + 7 - high
        left = left[~differ]
    out[left] = depth
    return np.minimum(out, depth)


JUDGED = "number binary, inner long, outer long"


def judge(table: pa.Table, width: int) -> pa.Table:
    """Per string (number, scope, body, first and last coordinate): masks of its windows that repeat an earlier one, at the first and at later coordinates."""
    bodies = table["body"].combine_chunks().cast(pa.large_binary())
    n = len(bodies)
    offsets = np.frombuffer(bodies.buffers()[1], np.int64)[bodies.offset : bodies.offset + n + 1]
    raw = np.frombuffer(bodies.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data = np.full(len(raw) + n, END, np.uint8)
    data[np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(offsets))] = raw
    starts = offsets[:-1] + np.arange(n)
    array = suffix_array(data, width)
    owner = np.repeat(np.arange(n), np.diff(offsets) + 1)[array]
    shift = array - starts[owner]
    whole = shift + width <= np.diff(offsets)[owner]  # a window, not a string's rest
    array, owner, shift = array[whole], owner[whole], shift[whole]
    doc = np.array(table["doc"].fill_null(0).to_numpy())
    key, at, scope = (table[c].to_numpy() for c in ("key", "at", "scope"))
    later = table["repeated"].to_numpy(zero_copy_only=False)
    fresh = common_prefix(data, array, width) < width
    several = ~fresh | np.append(~fresh[1:], False)  # the others are alone in their class
    kind, many, place = np.cumsum(fresh)[several], owner[several], at[owner[several]] + shift[several]
    order = np.lexsort((place, key[many], doc[many], scope[many], kind))
    kind, within = kind[order], scope[many][order]
    first = np.ones(len(kind), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (within[1:] != within[:-1])
    earliest = np.ones(len(owner), bool)
    earliest[np.flatnonzero(several)[order]] = first
    bit = np.uint64(1) << shift.astype(np.uint64)
    inner, outer = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    np.bitwise_or.at(inner, owner[~earliest], bit[~earliest])
    # a class with a string of several coordinates has later ones, whichever of its strings is earliest
    np.bitwise_or.at(outer, owner[later[owner]], bit[later[owner]])
    return pa.table([table["number"], pa.array(inner.view(np.int64)), pa.array(outer.view(np.int64))], ["number", "inner", "outer"])


def judged(strings: DataFrame, width: int) -> DataFrame:
    """JUDGED for (number, scope, gram, body, first, repeated)."""
    total = strings.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    groups = max(1, total // GROUP_BYTES)
    rows = strings.select(
        F.pmod(F.xxhash64("gram"), F.lit(groups)).alias("group"), "number", "scope", "body", F.col("first.doc").alias("doc"), F.col("first.key").alias("key"), F.col("first.at").alias("at"), "repeated"
    )
    return rows.groupBy("group").applyInArrow(lambda t: judge(t, width), JUDGED)


def merged(occurred: DataFrame) -> DataFrame:
    """Equal strings as one, with the first coordinate and whether there is another."""
    where = F.struct("doc", "key", "at")
    out = occurred.groupBy("number").agg(F.first("scope").alias("scope"), F.first("gram").alias("gram"), F.first("body").alias("body"), F.min(where).alias("first"), F.max(where).alias("last"))
    return out.withColumn("repeated", F.col("first") != F.col("last")).drop("last")


PART = "of binary, i long, n long, range long, core long, body binary, first struct<doc: long, key: long, at: long>, scope long"


def parts_of(strings: DataFrame, width: int, gram: int, most: int) -> DataFrame:
    """PART: each string's windows in parts of at most `most` neighbours that have their anchor at about the same place.

    A part's range is the anchor's place in its windows, in steps of `most`; core is the first of the width - most + 1 bytes that
    all windows of the range share.  Both follow from a window's own bytes, so equal windows fall into parts of equal range and core.
    """
    keep = ["number", "first", "scope"]
    out = to_arrow_schema(StructType.fromDDL(PART))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch):
                bodies = rows.column(len(keep)).cast(pa.large_binary())
                offsets = np.frombuffer(bodies.buffers()[1], np.int64)[bodies.offset : bodies.offset + len(bodies) + 1]
                data = np.frombuffer(bodies.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                offsets = offsets - offsets[0]
                at, row, anchor, hashes = anchored(data, offsets, width, gram)
                # a string has one anchor; where its gram stands several times, a window goes by the first one in it
                own = np.zeros(len(offsets) - 1, np.uint64)
                own[row] = anchor
                standing = np.flatnonzero(hashes == np.repeat(own, np.diff(offsets))[: len(hashes)])
                place = standing[np.searchsorted(standing, at)]
                step = (place - at) // most
                fresh = np.ones(len(at), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1]) | (step[1:] != step[:-1])
                begin = np.flatnonzero(fresh)
                n = np.diff(np.append(begin, len(at)))
                size = n + width - 1
                ends = np.concatenate([[0], np.cumsum(size)])
                bytes_at = np.repeat(at[begin] - ends[:-1], size) + np.arange(ends[-1])
                body = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[bytes_at])])
                taken = rows.take(pa.array(row[begin]))
                core = place[begin] - step[begin] * most - at[begin]
                numbers = [pa.array(x, pa.int64()) for x in (at[begin] - offsets[row[begin]], n, step[begin], core)]
                yield pa.RecordBatch.from_arrays([taken.column(0), *numbers, body.cast(pa.binary()), taken.column(1), taken.column(2)], schema=out)

    return strings.select(*keep, F.col("body").alias(TEXT)).mapInArrow(run, PART)


def halved(strings: DataFrame, width: int, gram: int, most: int) -> tuple[DataFrame, DataFrame]:
    """parts_of() strings with their numbers, and the different parts whose core is in several of them, as strings of their own."""
    scope = F.col("scope").cast("string").cast("binary")
    level = F.lit(f" {most} ").cast("binary")
    rows = parts_of(strings, width, gram, most).select(
        "of", "i", "n", "scope", "body",
        F.xxhash64("scope", F.lit(most), "range", F.substring("body", F.col("core").cast("int") + 1, F.lit(width - most + 1))).alias("gram"),
        F.unhex(F.md5(F.concat(scope, level, F.col("range").cast("string").cast("binary"), F.lit(b" "), F.col("body")))).alias("number"),
        F.struct(F.col("first.doc").alias("doc"), F.col("first.key").alias("key"), (F.col("first.at") + F.col("i")).alias("at")).alias("first"),
    )
    rows, rows_at = written_at(rows, "zstd")
    several = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    shared, shared_at = written_at(rows.join(several, "gram"), "zstd")  # what stands alone repeats nothing
    discard(strings.sparkSession, rows_at)
    one = shared.groupBy("number").agg(F.first("scope").alias("scope"), F.first("gram").alias("gram"), F.first("body").alias("body"), F.min("first").alias("first"))
    one = written(one.withColumn("repeated", F.lit(False)))
    return shared.select("number", "of", "i", "n", "first"), one


def lowest_bits(n: Column) -> Column:
    """A mask of n bits, 1 to MASK."""
    return F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (F.lit(MASK) - n).cast("int"))


def crowded_in(strings: DataFrame, hot: int) -> DataFrame:
    """(gram): anchors of more than `hot` different strings."""
    return strings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("gram")


def judged_by_parts(strings: DataFrame, width: int, gram: int, hot: int) -> DataFrame:
    """JUDGED of all strings: those of crowded anchors by their parts, which go on to smaller ones while their cores are crowded."""
    few, levels, most = [], [], MASK
    now = strings
    while most > 1:
        crowded = written(crowded_in(now, hot))
        if not crowded.limit(1).count():
            break
        most //= PARTS
        few.append(now.join(crowded, "gram", "left_anti"))
        many = now.join(crowded, "gram")
        rows, one = halved(many, width, gram, most)
        levels.append((many, rows, one))
        now = one
    if most > 1:
        few.append(now)  # a single window is its core: none of them is in two different parts
    result = few[0]
    for other in few[1:]:
        result = result.unionByName(other)
    result = judged(result, width)
    if not levels:
        return result
    result = written(result.where("inner <> 0 or outer <> 0"))
    of_parts = result.select("number", "inner")
    for many, rows, one in reversed(levels):
        whole = lowest_bits(F.col("n"))
        known = one.select("number", F.col("first").alias("earliest")).join(of_parts, "number", "left")
        # a part repeats what its earliest place repeats, and as a whole where it is not that place
        inner = F.when(F.col("first").eqNullSafe(F.col("earliest")), F.coalesce("inner", F.lit(0).cast("long"))).otherwise(whole)
        back = rows.join(known, "number").select("of", F.call_function("shiftleft", inner, F.col("i").cast("int")).alias("inner"))
        back = written(back.groupBy(F.col("of").alias("number")).agg(F.bit_or("inner").alias("inner")))
        of_parts = of_parts.unionByName(back)
    many = levels[0][0]
    outer = many.select("number", F.when(F.col("repeated"), lowest_bits(F.octet_length("body") - (width - 1))).otherwise(F.lit(0).cast("long")).alias("outer"))
    hot_ones = outer.join(back, "number", "left").select("number", F.coalesce("inner", F.lit(0).cast("long")).alias("inner"), "outer")
    return result.unionByName(hot_ones)


def repeats(texts: DataFrame, width: int, gram: int, hot: int) -> DataFrame:
    """(doc, key, marks): places and masks of the windows of each text that start earlier elsewhere."""
    spark = texts.sparkSession
    found = occurrences(texts, width, gram)
    scope = F.when(F.col("doc").isNull(), F.col("key")).otherwise(F.lit(0).cast("long"))  # a row without an id only meets itself
    number = F.unhex(F.md5(F.concat(scope.cast("string").cast("binary"), F.lit(b" "), F.col("body"))))
    found, found_at = written_at(found.select("doc", "key", "at", "gram", "body", scope.alias("scope"), number.alias("number")), "zstd")
    strings, strings_at = written_at(merged(found), "zstd")
    result, result_at = settled(spark, lambda: judged_by_parts(strings, width, gram, hot).where("inner <> 0 or outer <> 0").join(strings.select("number", "first"), "number"))
    discard(spark, strings_at)
    is_first = F.struct("doc", "key", "at").eqNullSafe(F.col("first"))
    hits = found.select("doc", "key", "at", "number").join(result.hint("shuffle_hash"), "number").select("doc", "key", F.struct("at", F.when(is_first, F.col("inner")).otherwise(F.col("outer")).alias("mask")).alias("mark"))
    out = written(hits.where("mark.mask <> 0").groupBy("doc", "key").agg(F.collect_list("mark").alias("marks")))
    for at in (found_at, result_at):
        discard(spark, at)
    return out


SPANS = "array<struct<at: long, n: long>>"


def cut(texts: DataFrame, width: int) -> DataFrame:
    """Of (doc, n_bytes, body, whole, marks): what is left of each text, and the spans that go."""
    kind = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))

    def prepare():
        def make(bodies: pa.Array, batch: pa.RecordBatch) -> list[pa.Array]:
            data, offsets = text_buffer(bodies)
            marks, whole = column(batch, "marks"), column(batch, "whole").to_pylist()
            removed, spans, kept = [], [], []
            for i in range(len(bodies)):
                own = data[offsets[i] : offsets[i + 1]]
                own_marks = marks[i].values if marks[i].is_valid else None
                if whole[i]:
                    span, left = np.array([[0, len(own)]]), b""
                elif own_marks is None:
                    span, left = np.zeros((0, 2), np.int64), own.tobytes()
                else:
                    at, mask = (own_marks.field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                    bits = np.unpackbits(np.ascontiguousarray(mask).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    string, shift = np.nonzero(bits)
                    starts = at[string] + shift
                    edges = np.bincount(starts, minlength=len(own) + 1) - np.bincount(starts + width, minlength=len(own) + 1)
                    gone = np.cumsum(edges)[:-1] > 0
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).reshape(-1, 2)
                    span, left = np.stack([turn[:, 0], turn[:, 1] - turn[:, 0]], axis=1), own[~gone].tobytes()
                removed.append(int(span[:, 1].sum()))
                spans.append([{"at": a, "n": n} for a, n in span.tolist()])
                kept.append(left)
            return [pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]

        return make

    return map_texts(texts, "body", ["doc", "n_bytes", "marks", "whole"], f"n_removed long, spans {SPANS}, kept binary", prepare).drop("marks", "whole")


def suffix_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 100, gram: int = 32, hot: int = 256) -> DataFrame:
    """Per row: id_col, n_bytes, n_removed, spans (maximal removed stretches of bytes) and kept, the bytes that are left."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), body.alias("body"), F.xxhash64(body).alias("key"))
    sized = rows.select("doc", "key", "body", F.octet_length("body").cast("long").alias("n_bytes"), F.unhex(F.sha2("body", 256)).alias("digest"))
    signed, signed_at = written_at(sign(sized, width, gram))
    wanted, wanted_at = written_at(candidates(signed))
    first = signed.groupBy("digest").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    copies = signed.where(F.col("n_bytes") >= width).select("doc", "key", "digest").join(first, "digest").where("doc > first")
    copies = copies.select(F.col("doc").alias("of"), F.col("key").alias("of_key")).distinct()
    copies, copies_at = written_at(copies)
    discard(docs.sparkSession, signed_at)

    def joined(other: DataFrame, how: str) -> DataFrame:
        return rows.join(other.hint("shuffle_hash"), F.col("doc").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), how).drop("of", "of_key")

    marks = repeats(joined(wanted.withColumnsRenamed({"doc": "of", "key": "of_key"}), "inner"), width, gram, hot)
    discard(docs.sparkSession, wanted_at)
    none = F.lit(None).cast("array<struct<at: long, mask: long>>")
    marks = marks.select(F.col("doc").alias("of"), F.col("key").alias("of_key"), "marks", F.lit(False).alias("whole"))
    marks = marks.unionByName(copies.withColumns({"marks": none, "whole": F.lit(True)}))
    texts = joined(marks, "left").withColumns({"whole": F.coalesce("whole", F.lit(False)), "n_bytes": F.octet_length("body").cast("long")})
    return cut(texts, width).withColumnRenamed("doc", id_col).select(id_col, "n_bytes", "n_removed", "spans", "kept")
