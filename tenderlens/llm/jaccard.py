"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Texts are sets of hashed word n-grams (a shorter text is one n-gram).  Equal
sets form a class, handled once.  Bands of MinHash rows, sized for the wanted
recall at the threshold, are shuffled on their hashes; every bucket links its
classes to its smallest one, so a bucket of n classes makes n links, not n * n.
Connected classes form a block of candidates, in which all pairs of like size are
compared on the full sets: matrix products over the shared n-grams of two tiles at a time,
tiles being bounded in rows and n-grams.  Hence a pair is lost only if no chain
of shared buckets joins it, and links are counted without being listed.

Result per row: class_id (smallest id among rows connected by links), n_links
(other rows whose similarity reaches the threshold, copies included).

Defined results: null and empty texts are equal, empty sets: copies of one
another and of nothing else; rows that repeat an id are rows of their own; a
null id is never a class id unless all ids of the class are null; an empty
table gives an empty result; very long texts are one set each, whole.  The join
reads only the id and the text, so further columns, whatever their names, change
nothing; keep_one() keeps all of them and uses __node, __rep, __place, __id and
__body inside.

All pairs of a block whose sizes allow the threshold are compared, so a link is
lost only where no chain of buckets joins two texts; in return work grows with the
square of the sets of like size in a block.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import emit_rows, lists, map_texts
from .cluster import checkpointed, written
from .components import components
from .tokens import SPACE_SEPARATED, Words, mix, range_hashes, whole_windows, window_hashes, words_of

TILE_ROWS = 1024
TILE_NGRAMS = 2_000_000
COLUMNS = 4096


def band_plan(threshold: float, recall: float, max_hashes: int = 96) -> tuple[int, int]:
    """(bands, rows): the most rows for which bands within max_hashes find a pair at the threshold with that probability."""
    for rows in range(max_hashes, 0, -1):
        miss = 1 - threshold**rows
        bands = next((b for b in range(1, max_hashes // rows + 1) if 1 - miss**b >= recall), None)
        if bands:
            return bands, rows
    return max_hashes, 1


def ngram_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of every row, and row bounds."""
    rows = words.rows()
    at = whole_windows(words.bounds, n)
    grams = window_hashes(words.hashes, n)[at] if len(at) else np.zeros(0, np.uint64)
    owner = rows[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        grams = np.concatenate([grams, range_hashes(words.hashes, words.bounds[short], words.bounds[short + 1])])
        owner = np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[fresh], owner[fresh]
    return grams, np.searchsorted(owner, np.arange(len(words.counts) + 1))


def digests(grams: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    raw = grams.view(np.uint8)
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def band_hashes(grams: np.ndarray, bounds: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """A (texts, bands) table of hashes; texts without n-grams get zeros."""
    keys = np.random.default_rng(seed).integers(1, 1 << 63, (2, bands * rows), dtype=np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, bands), np.uint64)
    if len(full):
        starts = bounds[full]
        for b in range(bands):
            acc = np.full(len(full), b + 1, np.uint64)
            for k in range(b * rows, (b + 1) * rows):
                least = np.minimum.reduceat((grams ^ keys[0, k]) * (keys[1, k] | np.uint64(1)), starts)
                acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + least)
            out[full, b] = acc
    return out


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left set with every right set."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(np.unique(a), np.unique(b), assume_unique=True)
    if not len(common):
        return out

    def places(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        col = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        hit = common[col] == flat
        order = np.argsort(col[hit], kind="stable")
        return row[hit][order], col[hit][order]

    (ra, ca), (rb, cb) = places(left, a), places(right, b)
    for first in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - first)
        tiles = []
        for n, r, c in ((len(left), ra, ca), (len(right), rb, cb)):
            i, j = np.searchsorted(c, [first, first + width])
            tile = np.zeros((n, width), np.float32)
            tile[r[i:j], c[i:j] - first] = 1
            tiles.append(tile)
        out += tiles[0] @ tiles[1].T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    shared = shared_counts(left, right).astype(np.float64)
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    # compared as integers would be: the least similarity that passes is the threshold itself
    return shared >= threshold * (sizes - shared) - 1e-9


def smallest_reached(links: np.ndarray, ids: list[bytes]) -> list[int]:
    """Index of the smallest id in each node's component of a square link table."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    root = [-1] * len(ids)
    for start in order:
        if root[start] < 0:
            root[start], stack = start, [start]
            while stack:
                for other in np.flatnonzero(links[stack.pop()]).tolist():
                    if root[other] < 0:
                        root[other] = start
                        stack.append(other)
    return root


VERIFIED = "node binary, links long, root binary"


def verify(table: pa.Table, threshold: float) -> pa.Table:
    """Links within each block of candidates of one group; side 1 and 2: two tiles, of which only the pairs across count."""
    table = table.sort_by("block")
    blocks = table["block"].to_pylist()
    nodes, sides, weights = table["node"].to_pylist(), table["side"].to_numpy(), table["weight"].to_numpy()
    grams = table["grams"].combine_chunks()
    flat, bounds = grams.flatten().to_numpy(zero_copy_only=False).view(np.uint64), grams.offsets.to_numpy() - grams.offsets[0].as_py()
    out = {"node": [], "links": [], "root": []}
    at = 0
    while at < len(blocks):
        to = at
        while to < len(blocks) and blocks[to] == blocks[at]:
            to += 1
        seen: dict[tuple[bytes, int], int] = {}
        for i in range(at, to):  # rows with one id and one text come once for each row
            seen.setdefault((nodes[i], int(sides[i])), i)
        own = list(seen.values())
        sets = [flat[bounds[i] : bounds[i + 1]] for i in own]
        across = np.array([sides[i] == 2 for i in own])
        weight = weights[own]
        if any(sides[i] for i in own):
            links = np.zeros((len(own), len(own)), bool)
            if across.any() and not across.all():
                first, second = np.flatnonzero(~across), np.flatnonzero(across)
                links[np.ix_(first, second)] = linked([sets[i] for i in first], [sets[i] for i in second], threshold)
                links |= links.T
        else:
            links = linked(sets, sets, threshold)
            np.fill_diagonal(links, False)
        ids = [nodes[i] for i in own]
        out["node"] += ids
        out["links"] += (links @ weight).tolist()
        out["root"] += [ids[r] for r in smallest_reached(links, ids)]
        at = to
    return pa.table({"node": pa.array(out["node"], pa.binary()), "links": pa.array(out["links"], pa.int64()), "root": pa.array(out["root"], pa.binary())})


def candidate_blocks(classes: DataFrame) -> DataFrame:
    """(node, label) of classes that share a band hash with another, connected."""
    bands = classes.select("node", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("band", "least")
    edges = bands.join(buckets, "band").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return components(edges)


def tiles(blocks: DataFrame, threshold: float) -> DataFrame:
    """Rows (node, label, ...) dealt to groups: small blocks share a group, large ones are cut into tiles that meet in pairs.

    A large block is cut by levels of size first, a level being so wide that sets two levels apart are
    too unlike in size to pass; hence only tiles of the same or of adjacent levels meet.
    """
    sizes = blocks.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("g"))
    tiled = F.greatest(F.ceil(F.col("n") / TILE_ROWS), F.ceil(F.col("g") / TILE_NGRAMS)).cast("int")
    large = sizes.select("label", (tiled > 1).alias("large"))
    total = blocks.agg(F.count(F.lit(1)), F.sum("n_grams")).first()
    bins = max(1, (total[0] or 0) // TILE_ROWS, (total[1] or 0) // TILE_NGRAMS) * 2
    # a hair wider than the threshold asks for, against rounding; at thresholds near 1 or 0 still whole levels
    width = max(-math.log(max(threshold, 1e-9)), 1e-3) * (1 + 1e-6)
    level = F.when(F.col("large"), F.floor(F.log(F.greatest("n_grams", F.lit(1)).cast("double")) / width)).otherwise(0).cast("int")
    rows = blocks.join(large, "label").withColumn("level", level)
    levels = rows.groupBy("label", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("g")).select("label", "level", tiled.alias("k"))
    above = levels.select("label", (F.col("level") - 1).alias("level"), F.col("k").alias("k_above"))
    below = levels.select("label", (F.col("level") + 1).alias("level"), F.col("k").alias("k_below"))
    dealt = levels.join(above, ["label", "level"], "left").join(below, ["label", "level"], "left")
    rows = rows.join(dealt, ["label", "level"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))

    def meet(step: int, k: str) -> Column:
        """The tiles of the level that many steps away."""
        last = F.coalesce(k, F.lit(0)) - 1
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda t: F.struct((F.col("level") + step).alias("level"), t.alias("tile"))))

    none = F.array().cast("array<struct<level:int,tile:int>>")
    others = F.concat(*(F.coalesce(meet(step, k), none) for step, k in ((-1, "k_below"), (0, "k"), (1, "k_above"))))
    own = F.struct("level", "tile")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(others))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    block = F.concat_ws(":", F.hex("label"), low["level"], low["tile"], high["level"], high["tile"])
    group = F.when(F.col("large"), block).otherwise(F.pmod(F.xxhash64("label"), F.lit(bins)).cast("string"))
    return rows.select("node", "weight", block.alias("block"), side.alias("side"), group.alias("group"))


def labelled_nodes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = 5, threshold: float = 0.8, recall: float = 0.999, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(id_col, node) for every row of docs, and (node, rep, weight, links, label) for every set; sets of one label are a class."""
    bands, rows = band_plan(threshold, recall)

    def sign():
        def make(texts: pa.Array, _: pa.RecordBatch) -> list[pa.Array]:
            grams, bounds = ngram_sets(words_of(texts, SPACE_SEPARATED), n)
            hashes = band_hashes(grams, bounds, bands, rows, seed).view(np.int64)
            counts = np.diff(bounds)
            kept = np.repeat(counts > 0, bands)  # empty sets meet as one class, not in buckets
            at = np.concatenate([[0], np.cumsum((counts > 0) * bands)])
            return [pa.array(digests(grams, bounds), pa.binary()), pa.array(counts, pa.int64()), lists(hashes.ravel()[kept], at)]

        return make

    body = F.coalesce(F.col(text), F.lit(""))
    rows_ = docs.select(F.col(id_col).alias("__id"), F.xxhash64(body).alias("__key"), body.alias("__body"))
    signed = written(map_texts(rows_, "__body", ["__id", "__key"], "node binary, n_grams long, bands array<long>", sign))
    members = signed.select(F.col("__id").alias(id_col), "node")
    # a class's text is that of one row: the smallest id's, told from other rows of that id (or of none) by a hash of the text
    own = F.struct(F.col("__id").isNull().alias("none"), "__id", "__key")
    classes = signed.groupBy("node").agg(
        F.min(own).alias("own"),
        F.count(F.lit(1)).alias("weight"),
        F.first("n_grams").alias("n_grams"),
        F.first("bands").alias("bands"),
    )
    classes = written(classes.select("node", F.col("own.__id").alias("rep"), F.col("own.__key").alias("rep_key"), "weight", "n_grams", "bands"))

    blocks = checkpointed(candidate_blocks(classes).join(classes.drop("bands"), "node"))
    dealt = tiles(blocks, threshold)
    wanted = blocks.select("rep", "rep_key", F.col("node").alias("wanted"))
    texts = rows_.join(wanted, F.col("__id").eqNullSafe(F.col("rep")) & (F.col("__key") == F.col("rep_key")))

    def sets():
        done: set[bytes] = set()  # rows that share id and text meet in one task, which needs one of them

        def make(texts: pa.Array, batch: pa.RecordBatch) -> list:
            grams, bounds = ngram_sets(words_of(texts, SPACE_SEPARATED), n)
            keys = digests(grams, bounds)
            same = []
            for i, k in enumerate(batch.column(0).to_pylist()):
                if k == keys[i] and k not in done:
                    done.add(k)
                    same.append(i)
            chosen = pa.array(same, pa.int64())
            return [pa.array(keys, pa.binary()).take(chosen), lists(grams.view(np.int64), bounds).take(chosen)]

        return make

    full = emit_rows(texts, "__body", ["wanted"], "node binary, grams array<long>", sets)
    checked = dealt.join(full, "node").groupBy("group").applyInArrow(lambda t: verify(t, threshold), VERIFIED)
    checked = written(checked)

    labels = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    merged = classes.select("node", "rep", "weight").join(links, "node", "left").join(labels, "node", "left")
    return members, merged.withColumn("label", F.coalesce("label", "node"))


def jaccard_join(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """(id_col, class_id, n_links, n_copies) for every row of docs; options are those of labelled_nodes()."""
    members, merged = labelled_nodes(docs, text, id_col, **options)
    heads = merged.groupBy("label").agg(F.min("rep").alias("class_id"))
    merged = merged.join(heads, "label").select(
        "node",
        "class_id",
        (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.col("weight").alias("n_copies"),
    )
    return members.join(merged, "node").select(id_col, "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = 5, **options) -> DataFrame:
    """docs with one row of each class: of the rows with the class's smallest id and that id's smallest set, the first by its values."""
    members, merged = labelled_nodes(docs, text, id_col, n=n, **options)
    first = merged.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("x"))
    first = written(first.select(F.col("x.node").alias("__node"), F.col("x.rep").alias("__rep")))

    def sign():
        def make(texts: pa.Array, _: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array(digests(*ngram_sets(words_of(texts, SPACE_SEPARATED), n)), pa.binary())]

        return make

    kept = map_texts(docs, text, docs.columns, "__node binary", sign).join(first, "__node").where(F.col(id_col).eqNullSafe(F.col("__rep")))
    if members.groupBy("node", id_col).count().where("count > 1").limit(1).count():
        others = F.to_json(F.struct(*(c for c in docs.columns if c != text))) if len(docs.columns) > 1 else F.lit("")
        order = Window.partitionBy("__node").orderBy(text, others)
        kept = kept.withColumn("__place", F.row_number().over(order)).where("__place = 1")
    return kept.select(*docs.columns)
