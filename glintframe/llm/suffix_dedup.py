"""Repeated passages by suffix arrays of words.

A passage is repeated if its MIN_WORDS words in a row (runs of anything but blank, tab, newline, form feed and
return, compared byte for byte) stand in a second place, in the same document or another. The result has, for each
document, the maximal stretches that such passages cover: (doc_id, start_char, end_char), 0-based, end excluded.

1. Shards: each task sorts the suffixes of runs of documents by Larsson and Sadakane's refinement, in numpy: suffixes
   are ranked by their first word, then groups of equal rank are sorted by the rank of the suffix h words on, with
   h doubling, and only groups that are still open are touched. A mark of its own ends each document, so no match
   goes on into the next. Kasai's pass over the text then gives the common prefixes of neighbours: it runs over all
   stretches of open suffixes side by side. Prefixes of MIN_WORDS or more are the repeats within the shard.
2. Candidates: each window of MIN_WORDS words has a key, the smallest hash of GRAM words in a row in it. Equal
   windows have equal keys, and neighbours mostly share theirs, so few keys represent a document. Only keys that
   occur in two shards or more go on.
3. Merging: each task goes over the documents with such keys again and hashes the windows by 128 bits. A shard's list
   of distinct windows, in order, is its sorted run; windows that it holds twice are reported where they are found. The
   runs are sent to partitions by hash and merged in pairs by binary search: a window's place is its place in its own
   run plus the number of smaller ones in the other. Windows with an equal neighbour there are in two shards. (Suffix
   arrays over words of two shards have no common order without the words themselves; of a window only its hash is
   sent, and so the order is that of the hashes.)

Null and empty texts and texts under MIN_WORDS words have no passages; very long texts are searched whole. Rows
without an id are left out, for there is no one to report. Rows that share an id are separate texts whose stretches
are reported together; ties and repeated rows repeat each other. Other columns are ignored, whatever their names. An
empty table gives an empty result. A document that is no copy of another is reported too if 50 words in a row of it
stand elsewhere, be it a license, a quoted passage or a stretch of a near copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.llm.common import BROADCAST_BYTES, char_index, measured_bytes, mix64, named, sieved, slices, staged, tidy, utf8, words

MIN_WORDS = 50
GRAM = 8
#: Words of one suffix array.
SHARD_WORDS = 1 << 19
SLICE_BYTES = 2 << 20
#: Windows that one merging task gets on average, and rows up to which its short runs are put together before merging.
MERGE_ROWS = 1 << 20
LEAST_RUN = 4096
_ODD = np.uint64(0xD1B54A32D192ED03)


class Words:
    """Words of a run of texts: hash, text, first character and the one after the last, within the text."""

    def __init__(self, column: pa.Array) -> None:
        data, off = utf8(column)
        self.hash, s, e, self.text = words(data, off)
        chars = char_index(data)
        base = chars[off[:-1]][self.text] if len(self.text) else np.zeros(0, np.int64)
        self.start, self.end = chars[s] - base, chars[e] - base
        self.texts = len(off) - 1


def suffix_array(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of a sequence of integers in order, each suffix's place there, and which have an equal first element.

    The last element must occur once. Larsson and Sadakane's refinement.
    """
    n = len(sequence)
    order = np.argsort(sequence, kind="stable")
    value = sequence[order]
    new = np.concatenate([[True], value[1:] != value[:-1]]) if n else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    single = new & np.concatenate([new[1:], [True]]) if n else new
    shared = np.empty(n, bool)
    shared[order] = ~single
    places = np.flatnonzero(~single)
    h = 1
    while len(places):
        at = order[places]
        both = rank[at] * n + rank[at + h]
        by = np.argsort(both, kind="stable")
        at, both = at[by], both[by]
        order[places] = at
        new = np.concatenate([[True], both[1:] != both[:-1]])
        rank[at] = places[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        places = places[~(new & np.concatenate([new[1:], [True]]))]
        h *= 2
    return order, rank, shared


def common_prefixes(sequence: np.ndarray, order: np.ndarray, place: np.ndarray, shared: np.ndarray, most: int) -> np.ndarray:
    """For each place in the order the common prefix with the one before, up to most. Kasai's pass over the text.

    A prefix of p at one suffix leaves at least p - 1 at the next. The pass runs along all stretches of suffixes
    that share their first element with another, side by side.
    """
    n = len(sequence)
    out = np.zeros(n, np.int64)
    before = np.full(n, -1, np.int64)
    inner = order[1:]
    before[inner] = order[:-1]
    live = shared & (before >= 0)
    edge = live & ~np.concatenate([[False], live[:-1]])
    at = np.flatnonzero(edge)
    size = np.flatnonzero(live & ~np.concatenate([live[1:], [False]])) - at + 1
    by = np.argsort(-size, kind="stable")  # the longest stretches first: those that end drop off the end
    at, size = at[by], size[by]
    prefix = np.zeros(len(at), np.int64)
    step = 0
    while len(at):
        keep = np.searchsorted(-size, -step, "left")
        at, size, prefix = at[:keep], size[:keep], prefix[:keep]
        if not keep:
            break
        i = at + step
        j = before[i]
        grow = np.arange(keep)
        while len(grow):
            p = prefix[grow]
            grow = grow[p < most]
            p = prefix[grow]
            a, b = i[grow] + p, j[grow] + p
            ok = (a < n) & (b < n)
            grow, a, b = grow[ok], a[ok], b[ok]
            grow = grow[sequence[a] == sequence[b]]
            prefix[grow] += 1
        out[place[i]] = prefix
        prefix = np.maximum(prefix - 1, 0)
        step += 1
    return out


def _intervals(first: np.ndarray, last: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Sorted by owner and first: marks where a stretch begins that touches none before."""
    if not len(first):
        return np.zeros(0, bool)
    wide = np.int64(1) << np.int64(40)
    reach = np.maximum.accumulate(owner * wide + last)
    new = np.ones(len(first), bool)
    new[1:] = owner[1:] * wide + first[1:] >= reach[:-1]
    return new


def shard_repeats(w: Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and last character of the stretches that are repeated within the words of one shard."""
    n = len(w.hash)
    # Words become ranks; after each text comes a mark of its own, smaller than all words.
    by = np.argsort(w.hash, kind="stable")
    value = w.hash[by]
    rank = np.empty(n, np.int64)
    rank[by] = np.cumsum(np.concatenate([[0], value[1:] != value[:-1]])) if n else 0
    shift = w.text  # texts before
    sequence = np.empty(n + w.texts, np.int64)
    where = np.arange(n) + shift
    ends = np.cumsum(np.bincount(w.text, minlength=w.texts)) + np.arange(w.texts)
    sequence[where] = rank + w.texts
    sequence[ends] = np.arange(w.texts)
    order, place, shared = suffix_array(sequence)
    shared[ends] = False
    prefix = common_prefixes(sequence, order, place, shared, least)
    high = prefix >= least
    hit = high | np.concatenate([high[1:], [False]])  # a suffix repeats the one before or the one after
    i = np.flatnonzero(hit[place[where]])
    return w.text[i], w.start[i], w.end[i + least - 1]


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k elements in a row, cut off at the end."""
    total, size = h, 1
    out, done = None, 0
    while True:
        if k & size:
            m = len(h) - done - size + 1
            if m <= 0:
                return np.zeros(0, np.uint64)
            out = total[:m].copy() if out is None else mix64(out[:m] * _ODD + total[done : done + m])
            done += size
        if size * 2 > k:
            return out
        m = len(total) - size
        if m <= 0:
            return np.zeros(0, np.uint64)
        total = mix64(total[:m] * _ODD + total[size:] + np.uint64(size))
        size *= 2


def _windows(w: Words, least: int) -> np.ndarray:
    """Places where a window of least words lies in one text."""
    n = len(w.hash) - least + 1
    return np.flatnonzero(w.text[:n] == w.text[least - 1 :]) if n > 0 else np.zeros(0, np.int64)


def window_keys(w: Words, least: int, gram: int) -> np.ndarray:
    """The smallest hash of gram words in a row in each run of least words, by the run's first word."""
    v = _grams(w.hash, gram)
    size, span = 1, least - gram + 1
    while size * 2 <= span:
        if len(v) <= size:
            return np.zeros(0, np.uint64)
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    rest = span - size
    if rest:
        v = np.minimum(v[:-rest], v[rest:]) if len(v) > rest else np.zeros(0, np.uint64)
    return v


def _distinct_pairs(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((key, text))
    text, key = text[by], key[by]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (key[1:] != key[:-1])]) if len(key) else np.zeros(0, bool)
    return text[new], key[new]


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Runs of documents of about most words."""
    held, size = [], 0
    for batch in batches:
        for b in slices(batch, "_text", SLICE_BYTES):
            data, _ = utf8(b.column(1))
            n = int(np.count_nonzero((data == 32) | (data == 10))) + b.num_rows
            if held and size + n > most:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
            held.append(b)
            size += n
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _plain(a: pa.Array | pa.ChunkedArray) -> pa.Array:
    return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a


def _stretches(owner: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first and last of what windows, sorted by owner and first, cover."""
    begin = np.flatnonzero(_intervals(first, last, owner))
    return owner[begin], first[begin], np.maximum.reduceat(last, begin) if len(begin) else last


def repeated_passages(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_words: int = MIN_WORDS,
    gram: int = GRAM,
    shard_words: int = SHARD_WORDS,
    merge_rows: int = MERGE_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(doc_id, start_char, end_char) of every stretch, see above."""
    gram = min(gram, min_words)
    rows = docs.where(named(doc_id).isNotNull() & named(text).isNotNull()).select(named(doc_id).alias("doc_id"), named(text).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, b in enumerate(_shards(batches, shard_words)):
            ids, w = b.column(0), Words(b.column(1))
            owner, first, last = _stretches(*shard_repeats(w, min_words))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(owner)), pa.nulls(len(owner), pa.int64()), pa.nulls(len(owner), pa.int64()), pa.array(first), pa.array(last)],
                ["doc_id", "key", "shard", "start_char", "end_char"],
            )
            at = _windows(w, min_words)
            owner, key = _distinct_pairs(w.text[at], window_keys(w, min_words, gram)[at])
            shard = np.full(len(key), task * (1 << 20) + k, np.int64)
            none = pa.nulls(len(key), pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(key.view(np.int64)), pa.array(shard), none, none], ["doc_id", "key", "shard", "start_char", "end_char"])

    found = staged(rows.mapInArrow(tidy(local), f"doc_id {kind}, key bigint, shard bigint, start_char bigint, end_char bigint"))
    keys = found.where("key is not null").select("doc_id", "key", "shard")
    crossing = keys.groupBy("key").agg(F.min("shard").alias("_a"), F.max("shard").alias("_b")).where("_a <> _b").select("key")
    wanted = staged(keys.join(crossing, "key").groupBy("doc_id").agg(F.collect_set("key").alias("_keys")).withColumnRenamed("doc_id", "_owner"))
    size = wanted.agg(F.sum(F.size("_keys"))).first()[0] or 0
    if measured_bytes(wanted) <= broadcast_bytes:
        chosen = rows.join(F.broadcast(wanted), F.col("doc_id") == F.col("_owner"))
    else:  # only documents with candidates are shuffled
        chosen = sieved(rows, wanted.select(F.col("_owner").alias("doc_id")), ["doc_id"]).join(wanted, F.col("doc_id") == F.col("_owner"))
    chosen = chosen.select("doc_id", "_text", "_keys")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, b in enumerate(_shards(batches, shard_words)):
            w = Words(b.column(1))
            at = _windows(w, min_words)
            if not len(at):
                continue
            key = window_keys(w, min_words, gram)[at]
            lists = b.column(2)
            n = np.diff(lists.offsets.to_numpy())
            have_text = np.repeat(np.arange(b.num_rows), n)
            have = lists.flatten().to_numpy().view(np.uint64)
            # (text, key) is looked up among the wanted ones by binary search.
            mixed, ours = mix64(have + mix64(have_text.astype(np.uint64))), mix64(key + mix64(w.text[at].astype(np.uint64)))
            mixed = np.sort(mixed)
            place = np.minimum(np.searchsorted(mixed, ours), max(len(mixed) - 1, 0))
            at = at[mixed[place] == ours] if len(mixed) else at[:0]
            h = _grams(w.hash, min_words)[at].view(np.int64)
            g = _grams(mix64(w.hash + _ODD), min_words)[at].view(np.int64)
            by = np.lexsort((g, h))
            h, g = h[by], g[by]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]) if len(h) else np.zeros(0, bool)
            twice = ~(new & np.concatenate([new[1:], [True]])) if len(h) else new
            # Windows that the shard holds twice are repeats already; one of each goes on for the other shards.
            i = np.sort(at[by[twice]])
            owner, first, last = _stretches(w.text[i], w.start[i], w.end[i + min_words - 1])
            one = at[by[new]]
            h, g = (np.concatenate([x[new], np.zeros(len(owner), np.int64)]) for x in (h, g))
            h[len(one) :] = mix64(owner.astype(np.uint64) + np.uint64(task + 1) * _ODD).view(np.int64)  # any partition
            run = np.concatenate([np.full(len(one), (task << 20) + k, np.int64), np.full(len(owner), -1, np.int64)])
            ids = b.column(0).take(pa.array(np.concatenate([w.text[one], owner])))
            first, last = np.concatenate([w.start[one], first]), np.concatenate([w.end[one + min_words - 1], last])
            yield pa.RecordBatch.from_arrays([ids, pa.array(h), pa.array(g), pa.array(run), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["doc_id", "h", "g", "run", "start_char", "end_char"])

    windows = chosen.mapInArrow(tidy(emit), f"doc_id {kind}, h bigint, g bigint, run bigint, start_char int, end_char int")
    # A key is the smallest of min_words - gram + 1 hashes, so it stands for half as many windows on average.
    parts = max(1, -(-size * (min_words - gram + 2) // (2 * merge_rows)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = [b for b in batches if b.num_rows]
        if not t:
            return
        t = pa.Table.from_batches(t).combine_chunks()
        h, g, run = (_plain(t.column(c)).to_numpy() for c in ("h", "g", "run"))
        done = np.flatnonzero(run < 0)
        order = merge_runs(h, g, run)
        h, g = h[order], g[order]
        same = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
        hit = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
        yield from t.take(pa.array(np.concatenate([done, hit]))).select(["doc_id", "start_char", "end_char"]).to_batches()

    across = windows.repartition(parts, "h").mapInArrow(tidy(merge), f"doc_id {kind}, start_char int, end_char int")
    within = found.where("key is null").select("doc_id", F.col("start_char").cast("int"), F.col("end_char").cast("int"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = [b for b in batches if b.num_rows]
        if not t:
            return
        t = pa.Table.from_batches(t).combine_chunks()
        coded = _plain(t.column(0)).dictionary_encode()
        owner = coded.indices.to_numpy().astype(np.int64)
        first, last = (_plain(t.column(c)).to_numpy().astype(np.int64) for c in (1, 2))
        by = np.lexsort((first, owner))
        owner, first, last = owner[by], first[by], last[by]
        owner, first, last = _stretches(owner, first, last)
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(owner)), pa.array(first), pa.array(last)], ["doc_id", "start_char", "end_char"])

    spans = across.unionByName(within)
    return spans.repartition(max(parts, 1), "doc_id").mapInArrow(tidy(unite), f"doc_id {kind}, start_char bigint, end_char bigint")


def merge_runs(h: np.ndarray, g: np.ndarray, run: np.ndarray, least_run: int = LEAST_RUN) -> np.ndarray:
    """The order of the rows with a run from 0 on by (h, g). The rows of a run come in order.

    Runs are merged in pairs, each element's place being its own place plus the number of smaller ones in the other
    run, by binary search. Short runs are put together first, so that many of them take few steps.
    """
    order = np.argsort(run, kind="stable")
    order = order[np.searchsorted(run[order], 0) :]
    if not len(order):
        return order
    new = np.concatenate([[True], run[order][1:] != run[order][:-1]])
    cuts = [int(c) for c in np.flatnonzero(new)]
    runs: list[np.ndarray] = []
    begin, several = 0, 0
    for c, end in zip(cuts, [*cuts[1:], len(order)], strict=True):
        several += 1
        if end - begin >= least_run or end == len(order):
            part = order[begin:end]
            if several > 1 or np.any(h[part][1:] < h[part][:-1]):  # a shuffle need not keep the order that was sent
                part = part[np.argsort(h[part], kind="stable")]
            runs.append(part)
            begin, several = end, 0
    while len(runs) > 1:
        merged = []
        for a, b in zip(runs[::2], runs[1::2], strict=False):
            ka, kb = h[a], h[b]
            out = np.empty(len(a) + len(b), np.int64)
            out[np.arange(len(a)) + np.searchsorted(kb, ka, "left")] = a
            out[np.arange(len(b)) + np.searchsorted(ka, kb, "right")] = b
            merged.append(out)
        if len(runs) % 2:
            merged.append(runs[-1])
        runs = merged
    order = runs[0]
    # Where first hashes collide, the few rows with them are put in order of the second.
    clash = np.flatnonzero((h[order][1:] == h[order][:-1]) & (g[order][1:] < g[order][:-1]))
    for value in np.unique(h[order][clash]).tolist():
        a, b = np.searchsorted(h[order], value, "left"), np.searchsorted(h[order], value, "right")
        order[a:b] = order[a:b][np.argsort(g[order[a:b]], kind="stable")]
    return order


SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[^ \\t\\n\\f\\r]+') AS w, regexp_split_to_array(text, '[^ \\t\\n\\f\\r]+') AS s FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
u AS (SELECT r, doc_id, unnest(w) AS word, unnest(s[1:len(w)]) AS gap, generate_subscripts(w, 1) AS i FROM t),
p AS (SELECT r, doc_id, i, word, sum(length(gap) + length(word)) OVER (PARTITION BY r ORDER BY i)::BIGINT AS e FROM u),
x AS (SELECT r, doc_id, i, e - length(word) AS b, lead(e, {MIN_WORDS - 1}) OVER q AS e, md5(string_agg(word, ' ') OVER (q ROWS BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)) AS h FROM p WINDOW q AS (PARTITION BY r ORDER BY i)),
f AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM x WHERE e IS NOT NULL) WHERE n > 1),
g AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f),
k AS (SELECT *, sum(CASE WHEN reach IS NULL OR b >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS stretch FROM g)
SELECT doc_id, min(b)::BIGINT AS start_char, max(e)::BIGINT AS end_char FROM k GROUP BY doc_id, stretch
"""
