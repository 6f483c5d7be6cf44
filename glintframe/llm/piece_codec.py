"""SentencePiece encoding and decoding, exact for merge-type models, by backtracking.

A merge-type model joins neighbouring pieces, the best-scored join first and the leftmost of equals, until none is
left. The encoder finds the same pieces without replaying the merges. An Aho-Corasick automaton lists the pieces at
each place of a word, the longest first. From the left the encoder appends the longest piece that is compatible
with the one before: two pieces are compatible if re-merging their joined text would give just these two. That is
seen by undoing their last merges one by one, latest first, and looking for a join across the border that would
have come earlier. If no piece fits, the last one is taken back and its place marked in a bitfield of failed
positions, so that no place is tried twice. A sequence with only compatible neighbours is the model's.

Text gets a blank before it, blanks become U+2581, and each piece lies within one run of U+2581 and the non-blanks
after it, so words are encoded alone and each distinct one once per batch. Characters that are no piece are written
as bytes. Decoding writes each piece's bytes, U+2581 as a blank, and drops the first blank.

Result: doc_id, ids, n_tokens, and round_trip, whether decoding gives the text again (it doesn't for texts that
contain U+2581 themselves). Empty text: no ids, round_trip true. Null text: null ids and round_trip, n_tokens 0.
Null ids of documents stay, repeated rows give equal rows, other columns are ignored, whatever their names. Ties
between merges go to the leftmost, as the model has it. Whole texts are encoded, however long. An empty table gives
an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.llm.common import named, slices, tidy, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
SLICE_BYTES = 2 << 20
#: Words whose encoding a worker keeps between batches; more are encoded again.
CACHED_WORDS = 1 << 18
#: Pairs of pieces whose compatibility it keeps.
CACHED_PAIRS = 1 << 18
_RUNS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class PieceModel:
    """The pieces of a merge-type model with how each is merged."""

    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        self.ids = {p: i for i, (p, ok) in enumerate(zip(self.pieces, plain, strict=True)) if ok}
        if any(BLANK in p.strip(BLANK) or (BLANK in p and not p.startswith(BLANK)) or BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece crosses a blank: words can't be encoded alone")
        self.code = "H" if n <= 1 << 16 else "I"
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        scores = np.array([sp.get_score(i) for i in range(n)])
        #: The order of merges: smaller is earlier. Equal scores are one merge, the leftmost first.
        self.rank = np.unique(-scores, return_inverse=True)[1].tolist()
        # How each piece is made; pieces that merging never makes of their own text are never part of an encoding.
        self.parts: list[tuple[int, int] | None] = [None] * n
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            made = self._merge(p)
            if made is not None:
                self.parts[i] = made
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.usable = {p: i for p, i in self.ids.items() if self.parts[i] is not None}
        #: Pairs of characters that stand side by side in some piece.
        self.joins = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.longest = max(map(len, self.usable))
        self._fits: dict[int, bool] = {}
        self.bytes = [
            bytes([self.byte_ids.index(i)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(BLANK, " ").encode() if not sp.is_unknown(i) else " ⁇ ".encode()
            for i, p in enumerate(self.pieces)
        ]

    def _merge(self, piece: str) -> tuple[int, int] | None:
        """The last merge that makes the piece, (-1, -1) for one character, None if merging ends otherwise."""
        seq = list(piece)
        if len(seq) == 1:
            return (-1, -1)
        while len(seq) > 1:
            best, at = None, -1
            for k in range(len(seq) - 1):
                i = self.ids.get(seq[k] + seq[k + 1])
                if i is not None and (best is None or self.rank[i] < best):
                    best, at = self.rank[i], k
            if best is None:
                return None
            if len(seq) == 2:
                return (self.ids.get(seq[0], -1), self.ids.get(seq[1], -1))
            seq[at : at + 2] = [seq[at] + seq[at + 1]]
        return None

    def fits(self, left: int, right: int) -> bool:
        """Whether re-merging the text of two neighbouring pieces gives these two."""
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= CACHED_PAIRS:
                self._fits.clear()
            known = self._fits[key] = self._remerge(left, right)
        return known

    def _remerge(self, left: int, right: int) -> bool:
        pieces, ids, rank, parts = self.pieces, self.ids, self.rank, self.parts
        limit = len(rank) + 1  # a join across the border counts if its rank is below
        while True:
            joined = ids.get(pieces[left] + pieces[right])
            if joined is not None and rank[joined] < limit:
                return False
            a, b = parts[left], parts[right]
            can_left, can_right = a[1] >= 0, b[0] >= 0
            if not can_left and not can_right:
                return True
            # The merge undone is the later of the two; of equals the right one came later.
            if can_left and (not can_right or rank[left] > rank[right]):
                limit, left = rank[left], a[1]
            else:  # a join across the border lies further left, so it wins a tie against this merge
                limit, right = rank[right] + 1, b[0]

    def packed(self, word: str, known: dict[str, bytes]) -> bytes:
        """Ids of a blank and a word, as bytes of the model's integers.

        The word is cut where no piece holds both characters: no merge goes across, and the parts recur. known keeps
        words as they are and later parts after a blank, which is in no word.
        """
        joins = self.joins
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in joins]
        if not cuts:
            out = array(self.code, self.encode_word(BLANK + word)).tobytes()
        else:
            parts = []
            for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True):
                part = word[a:b]
                key = " " + part if a else part
                e = known.get(key)
                if e is None:
                    e = array(self.code, self.encode_word(part if a else BLANK + part)).tobytes()
                    if len(known) < CACHED_WORDS:
                        known[key] = e
                parts.append(e)
            out = b"".join(parts)
        if len(known) < CACHED_WORDS:
            known[word] = out
        return out

    def encode_word(self, word: str) -> list[int]:
        """Pieces of a text that holds blanks only at its start."""
        # The automaton's longest matches from the left are the first way that backtracking goes.
        out: list[int] = []
        at = 0
        for end, (size, piece) in self.automaton.iter_long(word):
            if end - size + 1 != at or (out and not self.fits(out[-1], piece)):
                break
            out.append(piece)
            at = end + 1
        if at == len(word):
            return out
        out, at, n = [], 0, len(word)
        while at < n:
            end = at
            while end < n and word[end] in self.usable:
                end += 1
            if end > at:
                out += self._backtrack(word[at:end])
            if end < n:
                out += [self.byte_ids[b] for b in word[end].encode("utf-8", "replace")]
            at = end + 1
        return out

    def _backtrack(self, word: str) -> list[int]:
        """Pieces of a word in which every character is a piece."""
        usable, fits, longest, most = self.usable, self.fits, self.automaton.longest_prefix, self.longest
        end = len(word)
        failed = 0  # bit i: no encoding goes on from place i
        places, pieces, sizes = [0], [], [longest(word[:most])]
        while places[-1] < end:
            at, size = places[-1], sizes[-1]
            before = pieces[-1] if pieces else -1
            while size:
                to = at + size
                if not (failed >> to) & 1:
                    piece = usable.get(word[at:to])
                    if piece is not None and (before < 0 or fits(before, piece)):
                        break
                size -= 1
            else:
                failed |= 1 << at
                places.pop()
                sizes.pop()
                pieces.pop()
                continue
            sizes[-1] = size - 1
            pieces.append(piece)
            places.append(to)
            sizes.append(longest(word[to : to + most]))
        return pieces

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        return [i for w in _RUNS.findall((" " + text).replace(" ", BLANK)) for i in self.encode_word(w)]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(self.bytes[i] for i in ids)
        return raw.removeprefix(b" ").decode("utf-8", "replace")


@cache
def model(path: str) -> PieceModel:
    return PieceModel(path)


_kept: dict[str, dict[str, bytes]] = {}


def _encode_batch(m: PieceModel, texts: pa.Array, known: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of all texts."""
    n = len(texts)
    plain = texts.fill_null("") if texts.null_count else texts
    data, off = utf8(plain)
    # A text is odd if it has a blank next to another or at its ends, or U+2581 itself: its runs are found one by one.
    blank = data == 32
    odd = np.zeros(n, bool)
    if len(data):
        double = np.flatnonzero(blank[1:] & blank[:-1])
        ends = np.concatenate([off[:-1][np.diff(off) > 0], off[1:][np.diff(off) > 0] - 1])
        mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.zeros(0, np.int64)
        where = np.concatenate([double, ends[blank[ends]], mark])
        odd[np.searchsorted(off, where, "right") - 1] = True
    odd |= np.diff(off) == 0
    words = pc.split_pattern(plain, " ")
    word_off = np.asarray(words.offsets).astype(np.int64)
    word_off = word_off - word_off[0]
    coded = words.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    table: list[bytes] = []
    for w in coded.dictionary.to_pylist():
        e = known.get(w)
        if e is None:
            e = m.packed(w, known) if BLANK not in w else b""  # words with the mark itself are in odd texts
        table.append(e)
    kind = np.dtype(m.code)
    size = np.fromiter(map(len, table), np.int64, len(table)) // kind.itemsize
    flat = np.frombuffer(b"".join(table), kind).astype(np.int32)
    first = np.cumsum(size) - size
    count = size[codes]
    total = np.concatenate([[0], np.cumsum(count)])
    ids = flat[np.arange(total[-1]) - np.repeat(total[:-1] - first[codes], count)]
    lists = total[word_off]
    if odd.any():
        parts, sizes = [], np.diff(lists)
        at = 0
        for i in np.flatnonzero(odd).tolist():
            e = np.array(m.encode(plain[i].as_py()), np.int32)
            parts += [ids[at : lists[i]], e]
            at = lists[i + 1]
            sizes[i] = len(e)
        ids = np.concatenate([*parts, ids[at:]])
        lists = np.concatenate([[0], np.cumsum(sizes)])
    return lists, ids


def _same_after_decoding(m: PieceModel, pieces: pa.Array, lists: np.ndarray, ids: np.ndarray, texts: pa.Array) -> np.ndarray:
    out, out_off = utf8(pieces.take(pa.array(ids)))
    first = out_off[lists]  # bytes of the texts, each after a blank
    data, off = utf8(texts)
    size = np.diff(off)
    some = np.diff(lists) > 0
    same = (np.diff(first) == size + some) & ((size > 0) == some)
    # The decoded bytes without each text's first blank, beside the texts' own.
    keep = np.ones(len(out), bool)
    keep[first[:-1][some]] = False
    if same.all():
        differ = np.concatenate([[0], np.cumsum(out[keep] != data)])
        return differ[off[1:]] == differ[off[:-1]]
    return np.array([bool(s) and out[a + k : b].tobytes() == data[c:d].tobytes() for s, a, b, k, c, d in zip(same, first[:-1], first[1:], some, off[:-1], off[1:], strict=True)])


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) for every row; no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        known = _kept.setdefault(path, {})
        pieces = pa.array(m.bytes, pa.binary())
        for batch in batches:
            for b in slices(batch, "_text", SLICE_BYTES):
                texts = b.column(1)
                lists, ids = _encode_batch(m, texts, known)
                same = _same_after_decoding(m, pieces, lists, ids, texts)
                null = pa.array(np.asarray(texts.is_null())) if texts.null_count else None
                o = pa.array(lists, pa.int32())
                column = pa.ListArray.from_arrays(o, pa.array(ids), mask=null) if null is not None else pa.ListArray.from_arrays(o, pa.array(ids))
                trip = pa.array(same, mask=np.asarray(texts.is_null())) if null is not None else pa.array(same)
                yield pa.RecordBatch.from_arrays([b.column(0), column, pa.array(np.diff(lists).astype(np.int32)), trip], ["doc_id", "ids", "n_tokens", "round_trip"])

    source = docs.select(named(doc_id).alias("doc_id"), named(text).alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(tidy(work), f"doc_id {kind}, ids array<int>, n_tokens int, round_trip boolean")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids): null ids give a null text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(model(path).bytes, pa.binary())
        for b in batches:
            lists = b.column(1)
            null = np.asarray(lists.is_null())
            first = np.concatenate([[0], np.cumsum(np.where(null, 0, lists.value_lengths().fill_null(0).to_numpy()))])
            out, at = utf8(pieces.take(lists.flatten().cast(pa.int32())))
            raw, ends = out.tobytes(), at[first].tolist()
            texts = [None if n else raw[a + (raw[a : a + 1] == b" " and a < e) : e].decode("utf-8", "replace") for n, a, e in zip(null.tolist(), ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    source = encoded.select("doc_id", "ids")
    return source.mapInArrow(tidy(work), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")
