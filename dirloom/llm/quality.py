"""Quality rules: distribution divergence from language references.

Every document becomes two histograms, one over character classes and one over
the common words of its language.  Both are compared with the pooled histogram
of all documents of that language by Jensen-Shannon distance (base 2, so 0 to
1).  A histogram is judged only above a minimum length, as short texts scatter.

Two map-only passes: the first adds up the references (one small row per
language, bin and task is shuffled; texts with many symbols or capitals or few
words stay out of the references, so that junk doesn't shift them), the second scores each document against them.
The references are broadcast; they have one row per entry of COMMON and one for
all other languages, whatever the input.

Edge cases: null text counts as empty; an empty text has no words and fails the
base rule; a null or unlisted language is compared with every reference and the
nearest one counts; repeated rows are judged one by one; an empty table gives an
empty result; further columns are ignored by ``quality_signals`` and kept by
``filter_quality``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import columnar as C
from .storage import small_batches

# Frequent function words of each language.
COMMON = {
    "en": "the of and to in is that it was for on are as with be by at this from have".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au ce".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
OTHER = "und"

SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "sentence", "symbol", "other", "space")

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_CHARS_CLASS = 100
MIN_WORDS_COMMON = 100
#: A text of n characters may be MAX_CLASS_DISTANCE + SCATTER / sqrt(n) away.
MAX_CLASS_DISTANCE = 0.15
SCATTER = 1.2
MAX_WORD_DISTANCE = 0.31


_CLASS = np.full(256, CLASSES.index("other"), np.int64)
_CLASS[97:123] = _CLASS[0xC3:] = CLASSES.index("lower")
_CLASS[65:91] = CLASSES.index("upper")
_CLASS[48:58] = CLASSES.index("digit")
_CLASS[list(b".,;:!?'\"()-")] = CLASSES.index("sentence")
_CLASS[list(SYMBOLS)] = CLASSES.index("symbol")
_CLASS[C.SPACE] = CLASSES.index("space")
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_HEAD = (np.arange(256) & 0xC0) != 0x80
_LANGS = [*COMMON, OTHER]
_WORDS = sorted({w for ws in COMMON.values() for w in ws})


def _packed(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of each span of up to 8 as an integer, 0 for a longer span."""
    out = np.zeros(len(starts), np.uint64)
    size = ends - starts
    short = size <= 8
    for k in range(8):
        has = np.flatnonzero(short & (size > k))
        out[has] |= buf[starts[has] + k].astype(np.uint64) << np.uint64(8 * k)
    return out


def _pack_words(items: list[str]) -> np.ndarray:
    buf, off = C.utf8(pa.array(items))
    return _packed(buf, off[:-1], off[1:])


_WORD_HASH = _pack_words(_WORDS)
_WORD_ORDER = np.argsort(_WORD_HASH)
_WORD_SORTED = _WORD_HASH[_WORD_ORDER]
#: For each language, the columns of its words among _WORDS.
_WORD_COLUMNS = {k: np.array([_WORDS.index(w) for w in ws]) for k, ws in COMMON.items()}
_WORD_COLUMNS[OTHER] = np.arange(len(_WORDS))


def _repeated(key: np.ndarray) -> np.ndarray:
    """Which elements have an equal one."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def signals(column: pa.Array, histograms_only: bool = False) -> dict[str, np.ndarray]:
    """The counts of the base rules and the two histograms of each text."""
    buf, off = C.utf8(column)
    rows = len(off) - 1
    size = np.diff(off)
    starts, ends, at = C.words(buf, off)
    n_words = np.diff(at)
    head = _HEAD[buf]
    out = {"n_words": n_words, "n_symbols": C.row_sums(_SYMBOL[buf], off)}
    out["word_chars"] = C.row_sums(head & ~C.SPACE[buf], off)

    row_of_byte = np.repeat(np.arange(rows) * len(CLASSES), size)[head]
    out["classes"] = np.bincount(row_of_byte + _CLASS[buf[head]], minlength=rows * len(CLASSES)).reshape(rows, -1)

    low = C.LOWER[buf]
    word_row = C.rows_of(at)
    h = _packed(low, starts, ends)
    found = np.minimum(np.searchsorted(_WORD_SORTED, h), len(_WORD_SORTED) - 1)
    column_of = np.where(_WORD_SORTED[found] == h, _WORD_ORDER[found], len(_WORDS))
    width = len(_WORDS) + 1
    out["common"] = np.bincount(word_row * width + column_of, minlength=rows * width).reshape(rows, -1)

    if histograms_only:
        return out
    salt = C.mix(np.arange(rows, dtype=np.uint64) + np.uint64(1))
    exact = C.hash_spans(buf, starts, ends)
    grams, first = C.ngrams(exact, at, 3)
    twice = first[_repeated(grams ^ salt[word_row[first]])]
    cover = np.zeros(len(exact) + 3, np.int64)
    cover[twice] += 1
    cover[twice + 3] -= 1
    out["n_repeat_words"] = C.row_sums(np.cumsum(cover)[: len(exact)] > 0, at)

    ls, le, lat = C.lines(buf, off)
    line_row = C.rows_of(lat)
    has_word = np.concatenate([[0], np.cumsum(~C.SPACE[buf])])
    full = has_word[le] > has_word[ls]
    key = (C.hash_spans(buf, ls, le) ^ salt[line_row])[full]
    order = np.argsort(key, kind="stable")
    later = order[1:][key[order][1:] == key[order][:-1]]
    out["n_dup_lines"] = np.bincount(line_row[full][later], minlength=rows)
    return out


def _lang_index(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    place = {k: i for i, k in enumerate(_LANGS)}
    return np.array([place.get(v, len(_LANGS) - 1) for v in values], np.int64)


def _js(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of counts ``p`` to counts ``q``."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    q = (q / max(q.sum(), 1))[None, :]
    m = (p + q) / 2

    def kl(a: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0).sum(1)

    return np.sqrt(np.maximum((kl(p) + kl(q)) / 2, 0))


def _base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def _reference_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = len(CLASSES) + len(_WORDS) + 1
    total = np.zeros((len(_LANGS), width), np.int64)
    for b in C.pieces(batches):
        s = signals(b.column("text"), histograms_only=True)
        upper = s["classes"][:, CLASSES.index("upper")]
        lower = s["classes"][:, CLASSES.index("lower")]
        ok = (s["n_words"] >= MIN_WORDS) & (20 * s["n_symbols"] <= s["n_words"]) & (3 * upper <= lower)
        both = np.hstack([s["classes"], s["common"]])[ok]
        np.add.at(total, _lang_index(b.column("lang"))[ok], both)
    lang, bin_ = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bin_), pa.array(total[lang, bin_])], ["lang", "bin", "n"])


def language_references(docs: DataFrame) -> np.ndarray:
    """Pooled histograms: a row per language of COMMON and one for the others."""
    width = len(CLASSES) + len(_WORDS) + 1
    sums = small_batches(docs).select("text", "lang").mapInArrow(_reference_sums, "lang long, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    out = np.zeros((len(_LANGS), width), np.int64)
    for r in sums.collect():  # at most len(_LANGS) * width rows
        out[r["lang"], r["bin"]] = r["n"]
    return out


def distances(s: dict[str, np.ndarray], lang: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class distance, common-word distance) of each text to its language."""
    n = len(lang)
    by_class, by_word = np.ones(n), np.ones(n)
    for i, name in enumerate(_LANGS):
        if not refs[i].sum():
            continue
        mine = np.flatnonzero((lang == i) | (lang == len(_LANGS) - 1))
        if not len(mine):
            continue
        k = len(CLASSES)
        dc = _js(s["classes"][mine], refs[i, :k])
        cols = _WORD_COLUMNS[name]

        def fold(x: np.ndarray, cols: np.ndarray = cols) -> np.ndarray:
            own = x[..., cols]
            return np.concatenate([own, (x.sum(-1) - own.sum(-1))[..., None]], -1)

        dw = _js(fold(s["common"][mine]), fold(refs[i, k:]))
        by_class[mine] = np.minimum(by_class[mine], dc)
        by_word[mine] = np.minimum(by_word[mine], dw)
    return by_class, by_word


def _judge(refs: np.ndarray):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches):
            s = signals(b.column("text"))
            dc, dw = distances(s, _lang_index(b.column("lang")), refs)
            failed = _base_failed(s)
            chars = s["classes"].sum(1)
            odd = (chars >= MIN_CHARS_CLASS) & (dc > MAX_CLASS_DISTANCE + SCATTER / np.sqrt(np.maximum(chars, 1)))
            odd |= (s["n_words"] >= MIN_WORDS_COMMON) & (dw > MAX_WORD_DISTANCE)
            extra = [pa.array(s[k]) for k in names] + [pa.array(dc), pa.array(dw), pa.array(failed), pa.array(~failed & ~odd)]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*b.schema.names, *names, "class_distance", "word_distance", "base_failed", "kept"])

    return run


SIGNALS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double, base_failed boolean, kept boolean"


def quality_signals(docs: DataFrame) -> DataFrame:
    """doc_id with the counts, the distances and the verdict of every document."""
    from pyspark.sql.types import StructType

    refs = language_references(docs)
    schema = StructType([docs.schema[c] for c in ("doc_id", "text", "lang")])
    for f in StructType.fromDDL(SIGNALS):
        schema = schema.add(f)
    return docs.select("doc_id", "text", "lang").mapInArrow(_judge(refs), schema).drop("text", "lang")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns; no text is shuffled."""
    judge = _judge(language_references(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches):
            both = pa.RecordBatch.from_arrays([b.column("text"), b.column("lang")], ["text", "lang"])
            yield from (b.filter(x.column("kept")) for x in judge(iter([both])))

    return docs.mapInArrow(run, docs.schema)
