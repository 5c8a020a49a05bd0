"""Toxicity: gradient-boosted trees over dense features, isotonically calibrated.

The features of a text are densities and maxima of two lexicons (whole words
and word beginnings, after undoing character substitutions), second-person
words and how close lexicon words stand to them, capitals, punctuation, and
substituted, repeated and odd characters.  Lexicons are learned with their
weights from the training rows: words of toxic texts with a clear excess there.
A training row sees weights without its own counts, so that the trees don't
trust words that only one text has.

Training rows are at most ``TRAIN_ROWS`` labelled ones that ``train`` allows,
those of least hash: a bounded sample, which travels as a small table.  Trees
and calibration are fitted on the driver in numpy; the calibration is fitted on
out-of-fold margins.  Scoring is one map-only pass over all whole texts.

Edge cases: null and empty texts get a score like any other; without labelled
rows of both kinds every score is the share of toxic ones (0 if there is none);
repeated rows get equal scores; a null doc_id is held out of training; tables
may be empty; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import columnar as C
from .storage import Scratch, small_batches

TRAIN_ROWS = 30_000
MIN_TOXIC = 4
MIN_Z = 3.0
BEGINNING = 6
THRESHOLD = 0.7

# Second-person words.
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie tú ti tus usted ustedes vosotros os".split()

FEATURES = (
    "words",
    "word_length",
    "lexicon_max",
    "lexicon_density",
    "strong_density",
    "strong_count",
    "beginning_max",
    "beginning_density",
    "strong_beginning_density",
    "strong_beginning_count",
    "second_person",
    "lexicon_near_second_person",
    "capitals",
    "capital_words",
    "exclamations",
    "questions",
    "punctuation",
    "substituted",
    "repeated",
    "symbols",
    "digits",
)

_U = np.uint64
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SUBSTITUTE = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"0134578@$!", b"oieastbasi", strict=True):
    _SUBSTITUTE[_a] = _b
_PLAIN = _SUBSTITUTE == np.arange(256)
_PUNCT = np.isin(np.arange(256), list(b".,;:!?'\"()-"))
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>@^~_+="))
_DIGIT = np.isin(np.arange(256), list(b"0123456789"))


def _hash_of(words: list[str]) -> np.ndarray:
    buf, off = C.utf8(pa.array(words))
    return C.hash_spans(buf, off[:-1], off[1:])


_SECOND = np.sort(_hash_of(SECOND_PERSON))


@dataclass
class Tokens:
    """Words of a batch: hash, hash of the beginning (0 for short words), row offsets."""

    buf: np.ndarray
    off: np.ndarray
    word: np.ndarray
    beginning: np.ndarray
    at: np.ndarray
    size: np.ndarray
    substituted: np.ndarray
    starts: np.ndarray


def tokens(column: pa.Array) -> Tokens:
    buf, off = C.utf8(column)
    letter = _LETTER[buf]
    inner = np.zeros(len(buf), bool)
    if len(buf) > 2:
        inner[1:-1] = ~_PLAIN[buf[1:-1]] & letter[:-2] & letter[2:]
    low = np.where(inner, _SUBSTITUTE[buf], C.LOWER[buf])
    starts, ends = C._runs(letter | inner, off)
    size = ends - starts
    beginning = np.zeros(len(starts), np.uint64)
    long = size > BEGINNING
    beginning[long] = C.hash_spans(low, starts[long], starts[long] + BEGINNING) ^ _U(1)
    return Tokens(buf, off, C.hash_spans(low, starts, ends), beginning, np.searchsorted(starts, off), size, np.concatenate([[0], np.cumsum(inner)]), starts)


@dataclass
class Lexicon:
    """Sorted hashes with weights: of all rows, without a toxic one, without a clean one."""

    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((3, 0)))

    def look_up(self, h: np.ndarray, kind: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(h))
        i = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[i] == h, self.weights[kind, i], 0.0)


def _row_max(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at) - 1)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        out[full] = np.maximum.reduceat(v, at[:-1][full])
    return out


def features(column: pa.Array, lexicon: Lexicon, label: np.ndarray | None = None) -> np.ndarray:
    """A row of FEATURES for each text; ``label`` marks training rows."""
    t = tokens(column)
    rows = len(t.at) - 1
    row = C.rows_of(t.at)
    kind = np.zeros(len(row), np.int64) if label is None else np.where(label[row] == 1, 1, 2)
    word, begin = lexicon.look_up(t.word, kind), lexicon.look_up(t.beginning, kind)
    n = np.maximum(np.diff(t.at), 1)
    chars = np.maximum(np.diff(t.off), 1)

    def total(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=v, minlength=rows)

    def rate(mask: np.ndarray) -> np.ndarray:
        return C.row_sums(mask[t.buf], t.off) / chars

    second = np.isin(t.word, _SECOND)
    near = np.concatenate([np.zeros(6, np.int64), np.cumsum(second), np.full(5, second.sum())])
    close = near[11:] - near[: len(second)] > 0 if len(second) else second
    upper = np.concatenate([[0], np.cumsum(_UPPER[t.buf])])
    shouted = (upper[t.starts + t.size] - upper[t.starts] == t.size) & (t.size > 1)
    again = np.zeros(len(t.buf), bool)
    again[2:] = (t.buf[2:] == t.buf[1:-1]) & (t.buf[2:] == t.buf[:-2])
    strong_word, strong_begin = word > 2.5, begin > 2.5
    out = [
        np.log1p(np.diff(t.at)),
        total(t.size) / n,
        _row_max(word, t.at),
        total(word) / n,
        total(strong_word) / n,
        total(strong_word),
        _row_max(begin, t.at),
        total(begin) / n,
        total(strong_begin) / n,
        total(strong_begin),
        total(second) / n,
        total(((word > 1) | (begin > 1)) & close) / n,
        rate(_UPPER),
        total(shouted) / n,
        C.row_sums(t.buf == ord("!"), t.off) / chars,
        C.row_sums(t.buf == ord("?"), t.off) / chars,
        rate(_PUNCT),
        (t.substituted[t.off[1:]] - t.substituted[t.off[:-1]]) / n,
        C.row_sums(again, t.off) / chars,
        rate(_SYMBOL),
        rate(_DIGIT),
    ]
    return np.column_stack(out).astype(np.float64)


def _distinct(t: Tokens, rows: np.ndarray) -> np.ndarray:
    """The distinct tokens of each of these rows, one behind the other."""
    row = C.rows_of(t.at)
    mine = np.isin(row, rows)
    h = np.concatenate([t.word[mine], t.beginning[mine]])
    r = np.concatenate([row[mine], row[mine]])
    h, r = h[h != 0], r[h != 0]
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new]


def _toxic_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in C.pieces(batches):
        rows = np.flatnonzero(b.column("toxic").to_numpy() == 1)
        h, n = np.unique(_distinct(tokens(b.column("text")), rows), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["token", "n"])


def _clean_counts(known: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for b in C.pieces(batches):
            h = _distinct(tokens(b.column("text")), np.flatnonzero(b.column("toxic").to_numpy() != 1))
            i = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            total += np.bincount(i[known[i] == h] if len(known) else i[:0], minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["place", "n"])

    return run


def learn_lexicon(train: DataFrame, toxic: int, clean: int) -> Lexicon:
    counted = train.mapInArrow(_toxic_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_TOXIC)
    top = counted.toPandas()  # tokens of MIN_TOXIC or more of the training rows' toxic texts, of bounded number
    token = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    known, pos = token[order], top["n"].to_numpy(np.int64)[order]
    neg = np.zeros(len(known), np.int64)
    clean_ones = train.mapInArrow(_clean_counts(known), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    neg[clean_ones["place"].to_numpy(np.int64)] = clean_ones["n"].to_numpy(np.int64)

    def weight(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = np.log((p + 0.5) / (toxic + 1)) - np.log((n + 0.5) / (clean + 1))
        z = w / np.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
        return np.where((z > MIN_Z) & (w > 0.5), w, 0.0)

    weights = np.stack([weight(pos, neg), weight(np.maximum(pos - 1, 0), neg), weight(pos, np.maximum(neg - 1, 0))])
    some = weights.max(0) > 0
    return Lexicon(known[some], weights[:, some])


class Trees:
    """Boosted regression trees of fixed depth on binned features, logistic loss."""

    def __init__(self, count: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: int = 8, ridge: float = 1.0):
        self.count, self.depth, self.rate, self.bins, self.least, self.ridge = count, depth, rate, bins, least, ridge
        self.start = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, k = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(k)]
        binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
        share = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.start = float(np.log(share / (1 - share)))
        margin = np.full(n, self.start)
        self.trees = []
        for _ in range(self.count):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            feature, bound = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                local = node - first
                gain = np.full(width, 1e-6)
                for j in range(k):
                    m = self.bins
                    key = local * m + binned[:, j]
                    gs, hs, cs = (np.cumsum(np.bincount(key, weights=w, minlength=width * m).reshape(width, m), 1) for w in (g, h, None))
                    gl, hl, cl = gs[:, :-1], hs[:, :-1], cs[:, :-1]
                    gr, hr, cr = gs[:, -1:] - gl, hs[:, -1:] - hl, cs[:, -1:] - cl
                    value = gl**2 / (hl + self.ridge) + gr**2 / (hr + self.ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.ridge)
                    value = np.where((cl >= self.least) & (cr >= self.least), value, -1)
                    best = value.argmax(1)
                    better = value[np.arange(width), best] > gain
                    for q in np.flatnonzero(better):
                        if best[q] < len(edges[j]):
                            gain[q] = value[q, best[q]]
                            feature[first + q], bound[first + q] = j, edges[j][best[q]]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > bound[node])
            leaf = node - (2**self.depth - 1)
            size = 2**self.depth
            value = -self.rate * np.bincount(leaf, weights=g, minlength=size) / (np.bincount(leaf, weights=h, minlength=size) + self.ridge)
            self.trees.append((feature, bound, value))
            margin += value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, bound, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > bound[node])
            out += value[node - (2**self.depth - 1)]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares non-decreasing fit, by pooling adjacent violators."""
    m, back = np.unique(margin, return_inverse=True)
    weight = np.bincount(back).astype(float)
    mean = np.bincount(back, weights=y) / weight
    blocks: list[list[float]] = []  # mean, weight, first, last
    for i in range(len(m)):
        blocks.append([mean[i], weight[i], m[i], m[i]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b = blocks.pop()
            a = blocks[-1]
            a[0] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1])
            a[1] += b[1]
            a[3] = b[3]
    at = np.array([v for b in blocks for v in (b[2], b[3])])
    return at, np.repeat([b[0] for b in blocks], 2)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    share: float

    def score(self, column: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(column), self.share)
        m = self.trees.margin(features(column, self.lexicon))
        # A little of the raw probability keeps the order inside a pooled block.
        return np.clip(0.98 * np.interp(m, *self.knots) + 0.02 / (1 + np.exp(-m)), 0, 1)


def _train_features(lexicon: Lexicon):
    width = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches):
            y = b.column("toxic").to_numpy()
            x = features(b.column("text"), lexicon, y)
            yield pa.RecordBatch.from_arrays([b.column("fold"), b.column("toxic"), C.list_array(x.ravel(), np.full(len(y), width), pa.float64())], ["fold", "toxic", "x"])

    return run


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, allowed: Column) -> Model:
    """The model of at most TRAIN_ROWS rows of ``labels`` that ``allowed`` (of doc_id) lets in."""
    scratch = Scratch(spark, "toxicity")
    usable = labels.filter(allowed & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    fold = F.pmod(F.xxhash64("text"), F.lit(3)).cast("int")
    train = docs.select("doc_id", "text").join(F.broadcast(scratch.save(chosen, "chosen")), "doc_id")
    train = scratch.save(train.select("text", "toxic", fold.alias("fold")), "train")
    count = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    toxic, clean = count.get(1, 0), sum(v for k, v in count.items() if k != 1)
    if not toxic or not clean:
        return Model(Lexicon(), None, None, toxic / max(toxic + clean, 1))
    lexicon = learn_lexicon(train, toxic, clean)
    rows = train.mapInArrow(_train_features(lexicon), "fold int, toxic int, x array<double>").toArrow()
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    y = (rows.column("toxic").to_numpy() == 1).astype(float)
    fold_of = rows.column("fold").to_numpy()
    order = np.lexsort((*x.T, y, fold_of))  # tasks end in any order
    x, y, fold_of = x[order], y[order], fold_of[order]
    out = np.zeros(len(y))
    for k in range(3):
        mine = fold_of == k
        if mine.all() or not mine.any():
            out[mine] = Trees().fit(x, y).margin(x[mine])
        else:
            out[mine] = Trees().fit(x[~mine], y[~mine]).margin(x[mine])
    return Model(lexicon, Trees().fit(x, y), isotonic(out, y), toxic / len(y))


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches):
            s = model.score(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= THRESHOLD) of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", "text").mapInArrow(_scores(model), f"doc_id {kind}, score double, predicted int")


def held_out() -> Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))


def toxicity_report(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(spark, docs, labels, ~held_out())
    return score_documents(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
