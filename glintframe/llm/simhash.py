"""Near-duplicate search: 128-bit SimHash fingerprints and exact Hamming search by vantage-point trees.

Fingerprint: the distinct words of the lower-cased text (runs of letters and digits) vote with the bits of their
MD5; a bit is set if more than half of the words set it. Two documents are near copies if their fingerprints
differ in at most RADIUS bits.

Search: the 128 bits are divided into bands. If two fingerprints differ in at most RADIUS bits, they differ in at
most radius = RADIUS // BANDS bits of some band, so each band is searched alone, in the Hamming metric of its bits.
(Over all 128 bits distances to any point concentrate so much that a tree with a radius of 20 prunes nothing.)

A band has a vantage-point tree over its distinct values. A node's vantage point v is that of a few of its points
from which distances differ most; its points within the median distance of v go inside, the others outside, and each
side keeps its least and its largest distance. By the triangle inequality a query q comes nowhere within the radius
of a side unless d(q, v) lies within the radius of that range, and the branch is pruned. The top levels are planted
from the counts of all values and divide the band among shards: each fingerprint is stored in one shard, and is a
query in every shard whose boundary it overlaps, that is that the bounds don't rule out. Below, each shard plants
the rest of the tree and follows all its queries through it at once. Values that a leaf finds within the radius stand
for their fingerprints, which are compared in all bits, so the pairs are exact; of the bands that find a pair the
first reports it.

Results: ``near_classes`` has one row per document, with its class, a connected component of near copies named by
its smallest id, and its links, the number of other documents within RADIUS bits. k near copies have k * (k - 1) / 2
pairs and classes grow with the corpus, so pairs are no result for a large one. Each is still found, compared in all
bits and counted, but a shard passes on no more than one hook and one count for each of its points.

``near_pairs`` lists the pairs. Equal fingerprints are one point, under the smallest id. The result has the pair
(smallest id, other id, 0) for each of the others and one pair of smallest ids for every two near points: the star
stands for all pairs between the copies.

Documents without a word, null and empty texts have no fingerprint and are near nothing: classes of their own, no
links. Null ids take no part in pairs and classes and are kept by ``drop_near_duplicates``. Rows with equal ids count
once in pairs and are one row in one class; with different fingerprints they are counted apart in links. Of rows that
share an id, all stay or go. Other columns are ignored (``near_classes``, ``near_pairs``) or passed through. An empty
table gives an empty result. Very long texts are hashed as a whole; ties (equal distances, equal fingerprints) change
nothing but which id stands for them, the smallest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from glintframe.llm.common import fresh, named, slices, small_enough, staged, tidy

RADIUS = 20
BANDS = 7
#: Fingerprints of a band that one shard stores, and the least levels of a tree that divide it among shards.
SHARD_POINTS = 262_144
LEAST_DEPTH = 2
LEAF, LEAF_QUERIES = 64, 4096
#: Pairs that are compared at once, and points that are looked at to choose a vantage point, of which so many are tried.
BLOCK_PAIRS = 1 << 20
LOOK, TRY = 256, 4
MOST_TASKS = 100_000
WORD = r"[^\p{L}\p{N}]+"
SLICE_BYTES = 4 << 20


def _word_bits(words: list[bytes]) -> np.ndarray:
    """Bits of the words' MD5, a byte each, as (n, 16) of uint64."""
    md5 = hashlib.md5
    return np.unpackbits(np.frombuffer(b"".join([md5(w).digest() for w in words]), np.uint8).reshape(-1, 16), axis=1).view(np.uint64)


def simhash(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints, (n, 2) of uint64, and whether the text has a word."""
    if texts.null_count:
        texts = texts.fill_null("")
    split = pc.split_pattern_regex(pc.utf8_lower(texts), WORD)
    n = len(texts)
    off = np.asarray(split.offsets).astype(np.int64)
    off, flat = off - off[0], split.flatten()
    coded = flat.dictionary_encode()
    vocabulary = coded.dictionary.cast(pa.binary()).to_pylist()
    out, some = np.zeros((n, 2), np.uint64), np.zeros(n, bool)
    if not vocabulary:
        return out, some
    bits = _word_bits(vocabulary)
    empty = vocabulary.index(b"") if b"" in vocabulary else -1
    key = np.repeat(np.arange(n), np.diff(off)) * len(vocabulary) + coded.indices.to_numpy()
    key = np.sort(key)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    text, word = np.divmod(key, len(vocabulary))
    text, word = text[word != empty], word[word != empty]
    size = np.bincount(text, minlength=n)
    some = size > 0
    # Eight byte-wide counters share a 64-bit integer; at most 255 words of a text are added before they are widened.
    place = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    new = np.flatnonzero((place % 255) == 0)
    votes = np.zeros((n, 128), np.int64)
    step = 1 << 9
    for a in range(0, len(new), step):
        starts = new[a : a + step]
        end = new[a + step] if a + step < len(new) else len(word)
        sums = np.add.reduceat(bits[word[starts[0] : end]], starts - starts[0], axis=0).view(np.uint8)
        owner = text[starts]
        head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        votes[owner[head]] += np.add.reduceat(sums.astype(np.int64), head, axis=0)
    packed = np.packbits(2 * votes > size[:, None], axis=1)
    return packed.view(">u8").astype(np.uint64), some


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, hi, lo) for the rows that have an id and a word; no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "_text", SLICE_BYTES):
                f, some = simhash(b.column(1))
                part = pa.RecordBatch.from_arrays([b.column(0), pa.array(f[:, 0].view(np.int64)), pa.array(f[:, 1].view(np.int64))], ["doc_id", "hi", "lo"])
                yield part.filter(pa.array(some))

    source = docs.where(named(doc_id).isNotNull() & named(text).isNotNull()).select(named(doc_id).alias("doc_id"), named(text).alias("_text"))
    return source.mapInArrow(tidy(work), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, hi bigint, lo bigint")


def band_widths(bands: int) -> list[int]:
    return [128 // bands + (b < 128 % bands) for b in range(bands)]


def band_values(hi: np.ndarray, lo: np.ndarray, bands: int) -> list[np.ndarray]:
    """Each band's bits as integers, from the most significant bit on."""
    out, at = [], 0
    for width in band_widths(bands):
        s = 128 - at - width
        if s >= 64:
            v = hi >> np.uint64(s - 64)
        elif s + width <= 64:
            v = lo >> np.uint64(s)
        else:
            v = (lo >> np.uint64(s)) | (hi << np.uint64(64 - s))
        out.append((v & np.uint64((1 << width) - 1)).astype(np.uint32))
        at += width
    return out


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def vantage(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[int, int, np.ndarray]:
    """The vantage point of distinct values, their median distance to it, counted, and all distances.

    The median is below the largest distance, so that both sides have points, if there are two values.
    """
    n = len(values)
    look = values[:: max(1, n // LOOK)]
    tried = values[:: max(1, n // TRY)][:TRY]
    v = tried[int(np.argmax(_distance(tried[:, None], look).std(1)))]
    d = _distance(values, v)
    reach = np.cumsum(np.bincount(d, counts))
    least, most = int(d.min()), int(d.max())
    inner = np.arange(least, max(most, least + 1))
    return int(v), int(inner[np.argmin(np.abs(2 * reach[inner] - reach[-1]))]), d


#: Of a node: vantage point, median distance, least and largest distance inside and outside. No distance is within NONE.
NODE = ("vantage", "median", "in_least", "in_most", "out_least", "out_most")
_NONE = (1000, -1000)


def _ranges(d: np.ndarray, median: int) -> tuple[int, int, int, int]:
    near, far = d[d <= median], d[d > median]
    return (*((int(near.min()), int(near.max())) if len(near) else _NONE), *((int(far.min()), int(far.max())) if len(far) else _NONE))


def plant(values: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """The top levels of a band's tree, nodes in the order of a heap from 0 on: (2 ** depth - 1, 6)."""
    nodes = np.tile(np.array([0, -1, *_NONE, *_NONE], np.int64), ((1 << depth) - 1, 1))
    parts = {0: np.arange(len(values))}
    for node in range(len(nodes)):
        at = parts.pop(node, None)
        if at is None or not len(at):
            continue
        v, median, d = vantage(values[at], counts[at])
        nodes[node] = (v, median, *_ranges(d, median))
        parts[2 * node + 1], parts[2 * node + 2] = at[d <= median], at[d > median]
    return nodes


def route(value: np.ndarray, nodes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points, the shards that they may come within the radius of, and whether the shard stores the point."""
    point, node, home = np.arange(len(value)), np.zeros(len(value), np.int64), np.ones(len(value), bool)
    for _ in range((len(nodes) + 1).bit_length() - 1):
        v, median, a, b, c, e = nodes[node].T
        d = _distance(value[point], v.astype(np.uint32))
        near, far = (d >= a - radius) & (d <= b + radius), (d >= c - radius) & (d <= e + radius)
        point, node, home = np.concatenate([point[near], point[far]]), np.concatenate([2 * node[near] + 1, 2 * node[far] + 2]), np.concatenate([(home & (d <= median))[near], (home & (d > median))[far]])
    return point, node - len(nodes), home


def value_pairs(stored: np.ndarray, queries: np.ndarray, radius: int, counts: dict[str, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in stored, in queries) of the distinct values within the radius, by a vantage-point tree of stored."""
    stack = [(np.arange(len(stored)), np.arange(len(queries)))]
    while stack:
        points, asked = stack.pop()
        if not len(points) or not len(asked):
            continue
        if len(points) <= LEAF:
            wide = -len(points) % 8 + len(points)  # eight comparisons are looked at in one
            padded = np.resize(stored[points], wide)
            for a in range(0, len(asked), LEAF_QUERIES):
                part = asked[a : a + LEAF_QUERIES]
                hits = (np.bitwise_count(queries[part, None] ^ padded) <= radius).ravel()
                some = np.flatnonzero(hits.view(np.uint64))
                i, j = np.divmod(some[:, None] * 8 + np.arange(8), wide)
                ok = hits.reshape(-1, 8)[some] & (j < len(points))
                yield points[j[ok]], part[i[ok]]
            if counts is not None:
                counts["leaf"] = counts.get("leaf", 0) + len(points) * len(asked)
            continue
        v, median, d = vantage(stored[points])
        in_least, in_most, out_least, out_most = _ranges(d, median)
        q = _distance(queries[asked], np.uint32(v))
        if counts is not None:
            counts["node"] = counts.get("node", 0) + len(asked)
        stack.append((points[d <= median], asked[(q >= in_least - radius) & (q <= in_most + radius)]))
        stack.append((points[d > median], asked[(q >= out_least - radius) & (q <= out_most + radius)]))


def _expanded(first: np.ndarray, size: np.ndarray, other: np.ndarray, other_size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places in the ranges first[k] .. + size[k] and other[k] .. + other_size[k], a block at a time."""
    side = 1 << (BLOCK_PAIRS.bit_length() // 2)
    large = size * other_size > BLOCK_PAIRS
    for k in np.flatnonzero(large).tolist():
        for a in range(0, int(size[k]), side):
            for b in range(0, int(other_size[k]), side):
                i, j = np.arange(a, min(a + side, size[k])), np.arange(b, min(b + side, other_size[k]))
                yield np.repeat(first[k] + i, len(j)), np.tile(other[k] + j, len(i))
    first, size, other, other_size = (x[~large] for x in (first, size, other, other_size))
    n = size * other_size
    block = np.cumsum(n) // BLOCK_PAIRS
    cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(n) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        m = n[a:b]
        k = np.repeat(np.arange(a, b), m)
        within = np.arange(len(k)) - np.repeat(np.cumsum(m) - m, m)
        i, j = np.divmod(within, other_size[k])
        yield first[k] + i, other[k] + j


def found(hi: np.ndarray, lo: np.ndarray, home: np.ndarray, band: int, bands: int, radius_all: int, counts: dict[str, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (stored point, query point, distance) of one shard that this band is the first to find, by blocks.

    All points are queries, those at home are stored. A pair of two values is reported where the smaller is stored,
    two points of one value in both orders.
    """
    radius = radius_all // bands
    values = band_values(hi, lo, bands)
    by = np.argsort(values[band], kind="stable")
    asked, first_asked, n_asked = np.unique(values[band][by], return_index=True, return_counts=True)
    own = by[home[by]]
    stored, first_own, n_own = np.unique(values[band][own], return_index=True, return_counts=True)
    for p, q in value_pairs(stored, asked, radius, counts):
        once = stored[p] <= asked[q]
        p, q = p[once], q[once]
        for i, j in _expanded(first_own[p], n_own[p], first_asked[q], n_asked[q]):
            i, j = own[i], by[j]
            d = np.bitwise_count(hi[i] ^ hi[j]).astype(np.int64) + np.bitwise_count(lo[i] ^ lo[j])
            if counts is not None:
                counts["full"] = counts.get("full", 0) + len(i)
            ok = (d <= radius_all) & (d > 0)
            if not ok.any():
                continue
            i, j, d = i[ok], j[ok], d[ok]
            new = np.ones(len(i), bool)
            for b in range(band):
                new &= np.bitwise_count(values[b][i] ^ values[b][j]) > radius
            yield i[new], j[new], d[new]


def search(hi: np.ndarray, lo: np.ndarray, home: np.ndarray, band: int, bands: int, radius_all: int, counts: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All that ``found`` finds."""
    pairs = list(found(hi, lo, home, band, bands, radius_all, counts))
    if not pairs:
        e = np.zeros(0, np.int64)
        return e, e, e
    return tuple(np.concatenate(x) for x in zip(*pairs, strict=True))


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of i and j, in place; root has a point of its component for each point, itself for that one."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, up := root[root]):
            root[:] = up


def hooks(hi: np.ndarray, lo: np.ndarray, home: np.ndarray, copies: np.ndarray, band: int, bands: int, radius_all: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each point of a shard, a point of the component that the shard's pairs make, the same for all of it, and how
    many documents its pairs lead to, a point standing for as many as it has copies. Pairs are held by blocks only."""
    value = band_values(hi, lo, bands)[band]
    root, links = np.arange(len(hi)), np.zeros(len(hi), np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> None:
        if held:
            i, j = (np.concatenate(x) for x in zip(*held, strict=True))
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            unite(root, i, j)
            held.clear()

    for i, j, _ in found(hi, lo, home, band, bands, radius_all):
        once = (value[i] != value[j]) | (i < j)  # points of one value are found in both orders
        held.append((i[once], j[once]))
        if sum(len(x) for x, _ in held) >= BLOCK_PAIRS:
            settle()
    settle()
    return root, links


def band_trees(points: DataFrame, bands: int, depth: int) -> list[np.ndarray]:
    """The top levels of each band's tree, from the counts of all values of the points.

    A band has at most 2 ** (128 // bands + 1) values, whatever the number of points; only the nodes come to the driver.
    """
    widths = band_widths(bands)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(1 << w, np.int64) for w in widths] if max(widths) <= 20 else None
        for batch in batches:
            hi, lo = (batch.column(c).to_numpy().view(np.uint64) for c in (0, 1))
            for b, value in enumerate(band_values(hi, lo, bands)):
                seen, n = np.unique(value, return_counts=True)
                if total is not None:
                    total[b][seen] += n
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), b, np.int32)), pa.array(seen.astype(np.int64)), pa.array(n)], ["band", "value", "n"])
        for b, t in enumerate(total or []):
            seen = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), b, np.int32)), pa.array(seen), pa.array(t[seen])], ["band", "value", "n"])

    def top(table: pa.Table) -> pa.Table:
        table = table.sort_by("value")
        nodes = plant(table["value"].to_numpy().astype(np.uint32), table["n"].to_numpy(), depth)
        return pa.table({"band": pa.array(np.full(len(nodes), table["band"][0].as_py(), np.int32)), "node": pa.array(np.arange(len(nodes))), **{c: pa.array(nodes[:, k]) for k, c in enumerate(NODE)}})

    values = points.select("hi", "lo").mapInArrow(tidy(count), "band int, value bigint, n bigint").groupBy("band", "value").agg(F.sum("n").alias("n"))
    planted = values.groupBy("band").applyInArrow(top, "band int, node bigint, " + ", ".join(f"{c} bigint" for c in NODE)).toArrow()
    out = [plant(np.zeros(0, np.uint32), np.zeros(0, np.int64), depth) for _ in range(bands)]
    table = np.stack([planted[c].to_numpy() for c in NODE], 1).astype(np.int64) if planted.num_rows else np.zeros((0, 6), np.int64)
    band, node = (planted[c].to_numpy() for c in ("band", "node"))
    for b in range(bands):
        out[b][node[band == b]] = table[band == b]
    return out


def _by_shard(points: DataFrame, n: int, radius: int, bands: int, shard_points: int) -> GroupedData:
    """The points, n of distinct fingerprints (hi, lo), with their columns, in each shard that stores or queries them.

    n sets how deep the shards go; no result depends on it.
    """
    depth = min(max(LEAST_DEPTH, (max(0, n - 1) // shard_points).bit_length()), min(band_widths(bands)))
    trees = points.sparkSession.sparkContext.broadcast(band_trees(points, bands, depth))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo = (batch.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
            for b, value in enumerate(band_values(hi, lo, bands)):
                point, shard, home = route(value, trees.value[b], radius // bands)
                at = pa.array(point)
                yield pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns], pa.array((shard * bands + b).astype(np.int32)), pa.array(home)], [*batch.schema.names, "shard", "home"])

    sent = points.mapInArrow(tidy(send), ", ".join(f"{c} {kind}" for c, kind in points.dtypes) + ", shard int, home boolean")
    return sent.repartition(min(bands << depth, MOST_TASKS), "shard").groupBy("shard")


def near_points(points: DataFrame, n: int, radius: int = RADIUS, bands: int = BANDS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """(a, b, hamming) with a < b for every two of the n distinct fingerprints (doc_id, hi, lo) within the radius."""
    kind = points.schema["doc_id"].dataType.simpleString()

    def solve(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        hi, lo = (table.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
        home = table.column("home").to_numpy()
        band = int(table.column("shard")[0].as_py()) % bands
        p, q, d = search(hi, lo, home, band, bands, radius)
        ids = table.column("doc_id")
        a, b = ids.take(pa.array(p)), ids.take(pa.array(q))
        values = band_values(hi, lo, bands)[band]
        one_value = pa.array(values[p] == values[q])  # found in both orders
        least, most = pc.min_element_wise(a, b), pc.max_element_wise(a, b)
        return pa.table({"a": least, "b": most, "hamming": pa.array(d, pa.int32())}).filter(pc.or_(pc.invert(one_value), pc.less(a, b)))

    return _by_shard(points.select("doc_id", "hi", "lo"), n, radius, bands, shard_points).applyInArrow(solve, f"a {kind}, b {kind}, hamming int")


def near_hooks(points: DataFrame, n: int, radius: int = RADIUS, bands: int = BANDS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """(hi, lo, doc_id, hook, links) of the n distinct fingerprints (doc_id, hi, lo, copies) that are near others, for
    each shard that finds so. The hooks connect what ``near_points`` connects; links add up to the copies of near points.
    """
    kind = points.schema["doc_id"].dataType.simpleString()

    def solve(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        hi, lo = (table.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
        home, copies = (table.column(c).to_numpy() for c in ("home", "copies"))
        root, links = hooks(hi, lo, home, copies, int(table.column("shard")[0].as_py()) % bands, bands, radius)
        some = np.flatnonzero(links)
        near = table.select(["hi", "lo", "doc_id"]).take(pa.array(some))
        return near.append_column("hook", table.column("doc_id").take(pa.array(root[some]))).append_column("links", pa.array(links[some]))

    return _by_shard(points.select("doc_id", "hi", "lo", "copies"), n, radius, bands, shard_points).applyInArrow(solve, f"hi bigint, lo bigint, doc_id {kind}, hook {kind}, links bigint")


def near_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, bands: int = BANDS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """(doc_id_a, doc_id_b, hamming): see above for copies of one fingerprint."""
    prints = staged(fingerprints(docs, doc_id, text))
    points = staged(prints.groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id")))
    near = near_points(points, points.count(), radius, bands, shard_points)
    equal = (
        prints.join(points.withColumnRenamed("doc_id", "a"), ["hi", "lo"])
        .where(F.col("doc_id") != F.col("a"))
        .select("a", F.col("doc_id").alias("b"), F.lit(0).alias("hamming"))
        .distinct()
    )
    return near.unionByName(equal).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"), "hamming")


def groups(pairs: DataFrame, rounds: int = 100) -> DataFrame:
    """Connected components of (doc_id_a, doc_id_b): (doc_id, group), group being the component's smallest id.

    Alternates between hanging every id on its smallest neighbour (large star) and on the smallest of the ids that
    it points to (small star), until nothing changes: the paths halve each time. Each round is written to the
    shared folder.
    """
    edges = staged(pairs.select(F.col("doc_id_a").alias("u"), F.col("doc_id_b").alias("v")).where("u <> v"))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = None
    for _ in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        edges = staged(small.select("e.u", "e.v").where("u <> v").distinct())
        now = mark(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("group"))


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, bands: int = BANDS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """(doc_id, class_id, links), a row for each id: see above."""
    prints = staged(fingerprints(docs, doc_id, text).distinct())
    points = staged(prints.groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")))
    near = staged(near_hooks(points, points.count(), radius, bands, shard_points))
    none = F.lit(None).cast(docs.schema[doc_id].dataType)
    sums = (
        points.select("hi", "lo", "doc_id", (F.col("copies") - 1).alias("links"))
        .unionByName(near.select("hi", "lo", none.alias("doc_id"), "links"))
        .groupBy("hi", "lo")
        .agg(F.min("doc_id").alias("point"), F.sum("links").alias("links"))
    )
    each = staged(prints.join(sums, ["hi", "lo"]).select("doc_id", "point", "links"))
    edges = near.select(F.col("hook").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b")).unionByName(each.select(F.col("point").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b")))
    no_links = F.lit(0).cast("bigint").alias("links")
    return (
        docs.where(named(doc_id).isNotNull())
        .select(named(doc_id).alias("doc_id"), none.alias("class_id"), no_links)
        .unionByName(groups(edges).select("doc_id", F.col("group").alias("class_id"), no_links))
        .unionByName(each.select("doc_id", none.alias("class_id"), "links"))
        .groupBy("doc_id")
        .agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"))
        .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "links")
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, bands: int = BANDS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """The input with one document, that of the smallest id, of each connected group of near copies; columns stay."""
    (drop,) = fresh(docs, "_drop")
    found = staged(groups(near_pairs(docs, doc_id, text, radius, bands, shard_points)).select(F.col("doc_id").alias(drop)).distinct())
    return docs.join(small_enough(found), named(doc_id) == F.col(drop), "left_anti")


def _sql() -> tuple[str, str]:
    def bits(part: str) -> str:  # sum of votes into one half of the fingerprint
        return " + ".join(f"(CASE WHEN 2 * sum(({part} >> {63 - i}) & 1) > count(*) THEN {1 << (63 - i)}::UBIGINT ELSE 0::UBIGINT END)" for i in range(64))

    prints = f"""
w AS (SELECT DISTINCT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))) AS word FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 16))::UBIGINT AS h, ('0x' || substr(md5(word), 17, 16))::UBIGINT AS l FROM w),
f AS MATERIALIZED (SELECT doc_id, {bits("h")} AS hi, {bits("l")} AS lo FROM m GROUP BY doc_id),"""
    classes = f"""
WITH RECURSIVE{prints}
e AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM f a JOIN f b ON a.doc_id <> b.doc_id WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= {RADIUS}),
c AS (SELECT doc_id, doc_id AS other FROM f UNION SELECT e.v, c.other FROM c JOIN e ON c.doc_id = e.u),
k AS (SELECT doc_id, min(other) AS class_id FROM c GROUP BY doc_id),
n AS (SELECT u AS doc_id, count(*) AS links FROM e GROUP BY u)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(links, 0) AS links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
    pairs = f"""
WITH{prints}
r AS (SELECT hi, lo, min(doc_id) AS rep FROM f GROUP BY hi, lo),
p AS (SELECT a.rep AS doc_id_a, b.rep AS doc_id_b, (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::INTEGER AS hamming FROM r a JOIN r b ON a.rep < b.rep)
SELECT * FROM p WHERE hamming <= {RADIUS}
UNION ALL SELECT r.rep, f.doc_id, 0 FROM f JOIN r USING (hi, lo) WHERE f.doc_id <> r.rep
"""
    return classes, pairs


#: Of ``near_classes``, by all pairs of documents, and of ``near_pairs``.
SQL, PAIRS_SQL = _sql()
