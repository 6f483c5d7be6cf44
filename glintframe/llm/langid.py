"""Language identification by a byte convolutional network, trained in numpy on the labelled documents.

A text's UTF-8 bytes are folded to 76 classes (letters without case, digits, blanks, punctuation, lead bytes and
continuation bytes) and cut into windows of 128 bytes. Filters of 2, 3 and 4 bytes slide over a window; each
filter's largest response goes through a ReLU and a softmax layer gives the languages and one more class, "und",
for what is no language: it is trained on random letters, digits, encoded data and bytes, and is sure for windows without a letter. A document's
probabilities are the means of its windows', weighted by their length; every window of the whole text counts,
however long it is, in training as well.

A document is rejected, as "und", if that class has a probability of REJECT or more; else it has its best language,
with that one's probability as confidence. Null and empty texts have no window: their pred_lang is
"und", their confidence 0.0 and they are rejected. Null ids stay as they are, repeated rows give equal rows, ties
go to the first language by name, and other columns are ignored (``identify``) or passed through
(``keep_identified``), whatever their names. An empty table gives an empty result. Where no row is labelled (an empty
table, or lang null throughout) there is nothing to learn from: the model then knows no language and rejects only
null and empty texts; the others have pred_lang "und" and confidence 0.0 and are accepted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.llm.common import named, slices, tidy, utf8

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
UND = "und"
#: Probability of "und" from which a document is rejected.
REJECT = 0.7
#: Bound of the training sample: about so many labelled documents of each language, chosen by a hash of the id.
SAMPLE_PER_LANG = 400


def _classes() -> np.ndarray:
    c = np.zeros(256, np.uint8)  # class 0 is the padding
    for b in range(256):
        ch = chr(b)
        if "a" <= ch.lower() <= "z" and b < 128:
            c[b] = 1 + ord(ch.lower()) - 97
        elif b in (9, 10, 12, 13, 32):
            c[b] = 27
        elif 48 <= b < 58:
            c[b] = 28
        elif b < 32 or b == 127:
            c[b] = 29
        elif b < 128:
            c[b] = 30 + (b in b".,;:!?'\"()-") + 2 * (b in b"+/=_")
        elif b < 192:
            c[b] = 34 + (b & 31)  # folds the case of Latin letters
        else:
            c[b] = 66 + (b - 192 if b < 198 else 6 if b < 224 else 7 if b < 240 else 8)
    return c


CLASS = _classes()
N_CLASS = 76


_LETTER = np.array([0 < c < 27 or c > 33 for c in range(256)])


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of the texts' windows, (n, WINDOW + 3) and zero beyond the text; each window's text and length."""
    size = np.diff(off)
    n = -(-size // WINDOW)
    text = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    start = off[text] + k * WINDOW
    length = np.minimum(WINDOW, off[text + 1] - start)
    at = start[:, None] + np.arange(WINDOW)
    padded = np.zeros((len(text), WINDOW + 3), np.uint8)
    if len(data):
        padded[:, :WINDOW] = np.where(np.arange(WINDOW) < length[:, None], CLASS[data[np.minimum(at, len(data) - 1)]], 0)
    return padded, text, length


@dataclass
class Model:
    langs: list[str]
    filters: list[np.ndarray]  # for each width (width, N_CLASS, FILTERS)
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses of byte pairs, so that all filters at a place need two look-ups: at the place and two further on."""
        if not self.filters:  # no language
            return np.zeros((0, 0)), np.zeros((0, 0))
        two, three, four = self.filters
        z = np.zeros((N_CLASS, N_CLASS, FILTERS), np.float32)
        pair = lambda a, b: z + a[:, None] + b[None]
        here = np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1])], 2)
        on = np.concatenate([z, z + three[2][:, None], pair(four[2], four[3])], 2)
        return (np.ascontiguousarray(t.reshape(N_CLASS * N_CLASS, -1)) for t in (here, on))

    def probabilities(self, padded: np.ndarray, here: np.ndarray, on: np.ndarray, batch: int = 2048) -> np.ndarray:
        out = np.empty((len(padded), len(self.dense_bias)), np.float32)
        for a in range(0, len(padded), batch):
            x = padded[a : a + batch].T.astype(np.intp)
            codes = x[:-1] * N_CLASS + x[1:]
            top = np.full((x.shape[1], here.shape[1]), -np.inf, np.float32)
            one, two = np.empty_like(top), np.empty_like(top)
            for p in range(WINDOW):
                np.take(here, codes[p], 0, out=one, mode="clip")
                np.take(on, codes[p + 2] if p + 2 < len(codes) else codes[-1] * 0, 0, out=two, mode="clip")
                one += two
                np.maximum(top, one, out=top)
            z = np.maximum(top + self.bias, 0) @ self.dense + self.dense_bias
            z = np.exp(z - z.max(1, keepdims=True))
            out[a : a + batch] = z / z.sum(1, keepdims=True)
        return out


def _noise(n: int, rng: np.random.Generator, texts: list[bytes]) -> list[bytes]:
    """Windows of no language: encoded data, digits, random letters, bytes and marks, and shuffled text."""
    sets = [b"0123456789abcdef", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", b"0123456789 .,-", b"abcdefghijklmnopqrstuvwxyz ", bytes(range(33, 127)), b"#$%&*+-=_|~^@!<> ", bytes(range(128, 256))]
    out = []
    for i in range(n):
        if i % 8 == 7 and texts:
            t = np.frombuffer(texts[int(rng.integers(len(texts)))], np.uint8)
            t = t[t > 32]
            out.append(rng.permutation(t).tobytes() if len(t) >= 24 else b"0 1 2 3")
        else:
            out.append(rng.choice(np.frombuffer(sets[i % 8 % len(sets)], np.uint8), int(rng.integers(24, WINDOW + 1))).tobytes())
    return out


def fit(texts: list[str], labels: list[str], steps: int = 500, batch: int = 256, seed: int = 7) -> Model:
    """Train on whole texts with their languages. Windows are also cut short at random, so that short texts are known.

    Windows are drawn so that each document of a language has the same weight, and each language.
    """
    if not texts:
        return Model([UND], [], np.zeros(0, np.float32), np.zeros((0, 1), np.float32), np.zeros(1, np.float32))
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    x, text, length = windows(np.frombuffer(b"".join(raw), np.uint8), off)
    y = np.array([langs.index(v) for v in labels])[text]
    weight = 1.0 / np.bincount(text, minlength=len(raw))[text]
    noise = _noise(max(64, 4 * len(raw) // len(langs)), rng, [r[:WINDOW] for r in raw])
    nx, _, nl = windows(np.frombuffer(b"".join(noise), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in noise])]))
    x, length, y = np.concatenate([x, nx]), np.concatenate([length, nl]), np.concatenate([y, np.full(len(nx), len(langs))])
    k = len(langs) + 1
    weight = np.concatenate([weight, np.ones(len(nx))])
    reach = np.cumsum(weight / np.maximum(np.bincount(y, weight, k), 1e-9)[y])
    p = {f"w{w}": rng.normal(0, 0.3, (w, N_CLASS, FILTERS)).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:
        p[f"w{w}"][:, 0] = 0
    m = FILTERS * len(WIDTHS)
    p |= {"b": np.zeros(m, np.float32), "d": rng.normal(0, 0.2, (m, k)).astype(np.float32), "c": np.zeros(k, np.float32)}
    mean, var = ({n: np.zeros_like(v) for n, v in p.items()} for _ in range(2))
    rows = np.arange(batch)[:, None]
    for step in range(1, steps + 1):
        pick = np.minimum(np.searchsorted(reach, rng.random(batch) * reach[-1], "right"), len(x) - 1)
        keep = np.where((rng.random(batch) < 0.35) & (y[pick] < k - 1), rng.integers(4, WINDOW, batch), WINDOW)
        xb = np.where(np.arange(WINDOW + 3) < np.minimum(keep, length[pick])[:, None], x[pick], 0).astype(np.intp)
        yb = np.where(_LETTER[xb].any(1), y[pick], k - 1)  # without a letter it is no language, wherever it was cut out
        top, arg = [], []
        for w in WIDTHS:
            z = sum(p[f"w{w}"][j][xb[:, j : j + WINDOW]] for j in range(w))
            a = z.argmax(1)
            arg.append(a)
            top.append(np.take_along_axis(z, a[:, None], 1)[:, 0])
        pre = np.concatenate(top, 1) + p["b"]
        hid = np.maximum(pre, 0)
        z = hid @ p["d"] + p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[np.arange(batch), yb] -= 1
        z /= batch
        grad = {"d": hid.T @ z + 1e-4 * p["d"], "c": z.sum(0)}
        back = (z @ p["d"].T) * (pre > 0)
        grad["b"] = back.sum(0)
        for i, w in enumerate(WIDTHS):
            g, b = np.zeros_like(p[f"w{w}"]), back[:, i * FILTERS : (i + 1) * FILTERS]
            for j in range(w):
                code = xb[rows, arg[i] + j] * FILTERS + np.arange(FILTERS)
                g[j] = np.bincount(code.ravel(), b.ravel(), N_CLASS * FILTERS).reshape(N_CLASS, FILTERS)
            g[:, 0] = 0
            grad[f"w{w}"] = g
        rate = 0.01 * min(1, 2 * (1 - step / (steps + 1)))
        for n, v in p.items():
            mean[n] += 0.1 * (grad[n] - mean[n])
            var[n] += 0.01 * (grad[n] ** 2 - var[n])
            v -= (rate * (mean[n] / (1 - 0.9**step)) / (np.sqrt(var[n] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return Model([*langs, UND], [p[f"w{w}"] for w in WIDTHS], p["b"], p["d"], p["c"])


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Fit on a sample of the labelled rows, about sample_per_lang of each language, chosen by a hash of the id."""
    labelled = docs.where(named(lang).isNotNull() & named(doc_id).isNotNull())
    labelled = labelled.where(F.length(named(text)) > 0)
    sizes = {r[0]: r[1] for r in labelled.groupBy(named(lang)).count().collect()}
    if not sizes:
        return fit([], [])
    space = 1 << 40
    limit = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(space, space * sample_per_lang // n))])
    chosen = labelled.where(
        F.pmod(F.xxhash64(named(doc_id).cast("string")), F.lit(space)) < F.element_at(limit, named(lang))
    )
    rows = sorted(chosen.select(named(lang), named(text)).collect())
    return fit([r[1] for r in rows], [r[0] for r in rows])


def _document_scores(model: Model, here: np.ndarray, on: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class that each text gets, its probability and whether the text is accepted."""
    data, off = utf8(column)
    n = len(off) - 1
    if len(model.langs) == 1:
        return np.zeros(n, np.int64), np.zeros(n), np.diff(off) > 0
    x, text, length = windows(data, off)
    prob = model.probabilities(x, here, on)
    prob[~_LETTER[x].any(1)] = np.eye(prob.shape[1])[-1]
    prob *= length[:, None]
    total = np.zeros((n, prob.shape[1]))
    for c in range(prob.shape[1]):
        total[:, c] = np.bincount(text, prob[:, c], n)
    size = np.diff(off)
    total /= np.maximum(size, 1)[:, None]
    best = np.where((size > 0) & (total[:, -1] < REJECT), total[:, :-1].argmax(1), len(model.langs) - 1)
    return best, np.where(size > 0, total[np.arange(n), best], 0.0), best < len(model.langs) - 1


SLICE_BYTES = 2 << 20


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pred_lang, confidence, accepted) for every row."""
    langs = pa.array(model.langs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, on = model.tables()
        for batch in batches:
            for b in slices(batch, "_text", SLICE_BYTES):
                best, conf, accepted = _document_scores(model, here, on, b.column(1))
                names = langs.take(pa.array(best))
                yield pa.RecordBatch.from_arrays([b.column(0), names, pa.array(conf), pa.array(accepted)], ["doc_id", "pred_lang", "confidence", "accepted"])

    source = docs.select(named(doc_id).alias("doc_id"), named(text).alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(tidy(score), f"doc_id {kind}, pred_lang string, confidence double, accepted boolean")


def keep_identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose text is accepted; columns stay. No shuffle: rows are filtered where they are read."""
    at, names = docs.columns.index(text), docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # mapInArrow can't take names with dots

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, on = model.tables()
        for batch in batches:
            for b in slices(batch, f"c{at}", SLICE_BYTES):
                kept = b.filter(pa.array(_document_scores(model, here, on, b.column(at))[2]))
                yield pa.RecordBatch.from_arrays(kept.columns, names)

    return plain.mapInArrow(tidy(keep), docs.schema)
