"""Secret scan by token efficiency.

A tokenizer's vocabulary packs language into few tokens; random strings need many. Candidates are all runs of at
least 16 characters of [A-Za-z0-9+/_-] that hold a letter, with up to two "=" after them; the "//" after a URL's
scheme is no part of a run. A candidate is reported if it has fewer characters a token, under the byte-level
vocabulary, than its kind may have:

* letters and digits, and access-key ids (20 capitals and digits with a known prefix): MAX_RATIO;
* letters of mixed case within a part, parts being what + / _ - divide: MIXED_RATIO;
* otherwise, where each part is all small, all capital or capitalised, as words are, each part of 16 letters or
  more is judged by itself: MAX_RATIO - WORD_SLACK * sqrt(16 / letters), since the ratio of a word scatters the more
  the shorter it is. Short random strings of one case can't be told from unknown words: a fifth of those of 16 small
  letters are reported, half of those of 24, nine in ten of those of 40.

What is known to be no secret is excluded: numbers (digits only), UUIDs, and hexadecimal strings of a digest's length
unless they are the value of something called a token, secret, key, password or credential ("token=", "--token ",
"token is ", "Bearer ") or stand in a URL's user-info; runs within plain e-mail addresses and the host and path of
URLs are identifiers as well, but not a URL's user-info, query and fragment, nor a named value in its path. A URL
reaches from its scheme, however far back, to the next blank, quote or angle bracket.

One row for each string found: doc_id, its first character and the one after it (0-based), its tokens and
characters a token. The string itself is not repeated. Null and empty texts have none; whole texts are scanned,
however long. Null ids stay, ties and repeated rows are all reported, other columns are ignored, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.llm.common import named, slices, tidy, utf8

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MIN_CHARS = 16
MAX_RATIO = 2.2
MIXED_RATIO = 1.9
WORD_SLACK = 0.6
SLICE_BYTES = 4 << 20

_KEY_ID = re.compile(rb"(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}")
_UUID = re.compile(rb"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_HEX = re.compile(rb"[0-9a-f]+|[0-9A-F]+")
_DIGEST = {32, 40, 56, 64, 96, 128}
_NAMED = re.compile(rb"""(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|key|credential|auth)[A-Za-z0-9_-]{0,16}["']?\s{0,4}(?:[=:]|=>|:=)\s{0,4}["'`]?$""", re.I)
#: A name and its value with blanks between. "key" and "auth" end other words ("turkey") or begin them ("author").
_SPOKEN = re.compile(rb"""(?:(?:token|secret|passw(?:or)?d|pwd|credential|(?<![a-z])(?:api|access|private|secret|auth|signing|encryption)?key|(?<![a-z])auth)s?(?:[_-][A-Za-z0-9_-]{0,16})?["'`]?\s{1,4}(?:(?:is|was|are|equals)(?:\s{0,4}[=:]\s{0,4}|\s{1,4}))?|(?<![a-z])bearer["'`]?[\s:=]{1,4})["'`(]?$""", re.I)
_SCHEME = re.compile(rb"[a-z][a-z0-9+.-]{1,9}://", re.I)
_LOCAL = rb"(?:^|[\s<>()\[\],;\"'`|\x80-\xff]|mail(?:to)?[:=])[A-Za-z0-9._%+-]"
_MAILBOX, _AT = re.compile(_LOCAL + rb"{0,64}$", re.I), re.compile(_LOCAL + rb"{1,64}@$", re.I)
_DOMAIN = re.compile(rb"@[A-Za-z0-9\x80-\xff-]+\.[A-Za-z0-9\x80-\xff]")
_LABEL = re.compile(rb"\.[A-Za-z0-9]")
_PARTS = re.compile(rb"[A-Za-z]+")
#: More bytes than _NAMED, _SPOKEN, _MAILBOX and _AT, whose repeats are all bounded, can reach back.
_REACH = 128


@cache
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("glintframe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_RUN = _table(bytes(c for c in range(128) if chr(c).isalnum() or chr(c) in "+/_-"))
_DIGITS = _table(b"0123456789")
_LETTERS = _table(bytes(c for c in range(128) if chr(c).isalpha()))
#: What ends a URL, and what ends its user-info.
_ENDS = _table(b" \t\n\r\f\v\"'<>")
_STOPS = _table(b" \t\n\r\f\v\"'<>/?#@")


class _Page:
    """The bytes of some texts, with what is asked about the places of candidates."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        self.raw, self.off = data.tobytes(), off
        self.ends = np.flatnonzero(_ENDS[data]) if len(data) else np.zeros(0, np.int64)
        self.stops = np.flatnonzero(_STOPS[data]) if len(data) else np.zeros(0, np.int64)
        self._urls: dict[int, tuple[int, int, int]] = {}

    def url(self, a: int, first: int, stop: int) -> tuple[bool, bool] | None:
        """None if place a is in no URL; else whether it is in the host or path, and in the part before any slash."""
        k = int(np.searchsorted(self.ends, a)) - 1
        begin = max(first, int(self.ends[k]) + 1 if k >= 0 else 0)
        if begin not in self._urls:  # once for each stretch without blanks
            end = min(stop, int(self.ends[k + 1]) if k + 1 < len(self.ends) else stop)
            m = _SCHEME.search(self.raw, begin, end)
            places = (-1, -1, -1)
            if m:
                slash = self.raw.find(b"/", m.end(), end)
                marks = [x for x in (self.raw.find(b"?", m.end(), end), self.raw.find(b"#", m.end(), end)) if x >= 0]
                places = (m.end(), slash if slash >= 0 else end, min(marks, default=end))
            self._urls[begin] = places
        scheme, slash, mark = self._urls[begin]
        if scheme < 0 or a < scheme:
            return None
        return a <= mark, a <= slash

    def user_info(self, b: int, stop: int) -> bool:
        k = int(np.searchsorted(self.stops, b))
        return k < len(self.stops) and self.stops[k] < stop and self.raw[self.stops[k]] == 64

    def excluded(self, a: int, b: int, first: int, stop: int) -> bool:
        """Whether a candidate is a known digest or identifier by itself or by what stands around it."""
        value, before = self.raw[a:b], self.raw[max(first, a - _REACH) : a]
        if _UUID.fullmatch(value):
            return True
        if _DOMAIN.match(self.raw, b, stop) and not set(value) & set(b"/=") and _MAILBOX.search(before):
            return True
        if _LABEL.match(self.raw, b, stop) and not set(value) & set(b"/+_=") and _AT.search(before):
            return True
        url = self.url(a, first, stop)
        host_or_path = url is not None and url[0]
        if host_or_path and url[1] and self.user_info(b, stop):
            return False
        named_value = _NAMED.search(before)
        if len(value) in _DIGEST and _HEX.fullmatch(value) and not named_value and not _SPOKEN.search(before):
            return True
        return host_or_path and not named_value


def _tokens(enc: tiktoken.Encoding, value: bytes) -> int:
    return len(enc.encode_ordinary(value.decode()))


def random_looking(value: bytes, enc: tiktoken.Encoding, min_chars: int, max_ratio: float) -> bool:
    """Whether the tokens are too many for its kind, see above."""
    body = value.rstrip(b"=")
    kind = np.frombuffer(body, np.uint8)
    if not _LETTERS[kind].any():
        return False
    if _DIGITS[kind].any() or _KEY_ID.fullmatch(body):
        return len(value) < max_ratio * _tokens(enc, value)
    parts = _PARTS.findall(body)
    if any(not (p.islower() or p.isupper() or p[1:].islower()) for p in parts):
        return len(value) < MIXED_RATIO * _tokens(enc, value)
    return any(len(p) >= min_chars and len(p) < (max_ratio - WORD_SLACK * math.sqrt(16 / len(p))) * _tokens(enc, p) for p in parts)


def _scan(column: pa.Array, enc: tiktoken.Encoding, min_chars: int, max_ratio: float):
    data, off = utf8(column)
    run = _RUN[data] if len(data) else np.zeros(0, bool)
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    begins = run & ~np.concatenate([[False], run[:-1]]) if len(run) else run
    begins |= run & edge[:-1]
    last = run & (~np.concatenate([run[1:], [False]]) | edge[1:]) if len(run) else run
    s, e = np.flatnonzero(begins), np.flatnonzero(last) + 1
    s, e = s[e - s >= min_chars], e[e - s >= min_chars]
    if not len(s):
        return
    page = _Page(data, off)
    raw = page.raw
    text = np.searchsorted(off, s, "right") - 1
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    for a, b, t in zip(s.tolist(), e.tolist(), text.tolist(), strict=True):
        first, stop = int(off[t]), int(off[t + 1])
        if a > first and raw[a - 1 : a + 2] == b"://":
            a += 2
            if b - a < min_chars:
                continue
        b += len(raw[b : min(stop, b + 2)]) - len(raw[b : min(stop, b + 2)].lstrip(b"="))
        value = raw[a:b]
        if random_looking(value, enc, min_chars, max_ratio) and not page.excluded(a, b, first, stop):
            n = _tokens(enc, value)
            at = int(chars[a] - chars[first])
            yield t, at, at + len(value), n, len(value) / n


def scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, min_chars: int = MIN_CHARS, max_ratio: float = MAX_RATIO
) -> DataFrame:
    """(doc_id, start_char, end_char, n_tokens, chars_per_token) for every string found; no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in batches:
            for b in slices(batch, "_text", SLICE_BYTES):
                found = list(_scan(b.column(1), enc, min_chars, max_ratio))
                if found:
                    rows, start, end, tokens, ratio = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(rows)), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(tokens, pa.int32()), pa.array(ratio, pa.float64())],
                        ["doc_id", "start_char", "end_char", "n_tokens", "chars_per_token"],
                    )

    source = docs.select(named(doc_id).alias("doc_id"), named(text).alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(tidy(work), f"doc_id {kind}, start_char bigint, end_char bigint, n_tokens int, chars_per_token double")
