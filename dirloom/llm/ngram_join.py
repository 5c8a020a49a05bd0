"""N-gram Jaccard join: size-aware, heavy and light sets by different methods.

A document's set holds the hashes of its distinct word n-grams.  Documents with
equal sets form a class; one representative of each class takes part in the
join, so exact copies cost one aggregation whatever their number.

Small sets: two sets are linked if they share a subset of c elements with c
large enough for their sizes.  At 90 % a set of n elements can miss at most
n // 10, so its subsets of n, n - 1 (and n - 2 from 20 on, up to ``LEFT_OUT``)
elements are enumerated, hashed and grouped; the smallest member of a group is linked to the
others wherever c suffices for both sizes, which needs no verification and
connects all that any pair of the group would.

Large sets: first the inverted lists of one entry are counted (``singles``).  A
set that shares too few elements with all others together can't link, which
strikes out all but near copies; this is done twice, with a share of the elements
over all sets and with all elements over those left.  Then the elements are put
in one global order, frequent ones last, and the first n - ceil(0.9 n) + 1 form
the prefix (at 90 %); linked sets share a prefix element.  The inverted list of
each such element is scanned: each list's pivot (the member with the fewest
elements of its own) is compared with its members, linear in the list, and
components are formed.  Further rounds compare one more pivot of each list that
still has several components, until the pairs left are few; these are compared,
so that no link between components is lost while a large group of near copies
never becomes all its pairs.

The boundary between small and large is chosen by cost from the counts of sets
and the lengths of their lists.  Candidates must be allowed by sizes, positions,
elements held alone and sketches, and are verified on the exact sets, streamed
past the pivot's set in sorted partitions.

Memory: a worker holds a few MB of text, one pivot's set and one batch.  The
broadcast table of frequent elements only steers the order; it has at most
``HINTS`` rows at any size, and results don't depend on it.

Edge cases: null or wordless texts have no set and link with nothing; texts
with fewer words than n have one element; repeated rows each get their row and
the same component; a null doc_id keeps its row with a null component; tables
may be empty; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import columnar as C
from .graph import components
from .shingles import shingle_sets, signatures
from .singles import alone
from .storage import BROADCAST_ROWS, Scratch, free_name, only_ids

HINTS = 1 << 16
#: Sets that can miss up to so many elements may be enumerated.
LEFT_OUT = 2
#: Weight of a list comparison against that of a shuffled key.
COMPARE_COST = 8.0
#: Pivot rounds before the remaining pairs are compared.
PIVOT_ROUNDS = 6
#: Remaining pairs per list entry at which another pivot round doesn't pay.
FEW_PAIRS = 4
#: Cells of the sketch that bounds an intersection from above, and of its short form.
CELLS, SHORT = 64, 32
_U = np.uint64
SHORTS = [f"k{w}" for w in range(SHORT // 8)]


@dataclass(frozen=True)
class Threshold:
    """Link when den * intersection >= num * union."""

    num: int = 90
    den: int = 100

    def least_common(self, n, m):  # noqa: ANN001, ANN201
        """The least intersection that links sets of n and m elements."""
        a = self.num * (n + m)
        b = self.den + self.num
        return -(-a // b)

    def least_size(self, n):  # noqa: ANN001, ANN201
        return -(-self.num * n // self.den)

    def prefix(self, n):  # noqa: ANN001, ANN201
        return n - self.least_size(n) + 1

    def share(self) -> int:
        """One element in so many (a power of two) is enough to strike out an average
        set, of which three elements in four are held by it alone."""
        n = 1
        while 2 * n * (self.den - self.num) * 16 <= 7 * self.den:
            n *= 2
        return n

    def largest(self, left_out: int) -> int:
        """The largest size of a set that can miss ``left_out`` elements at most."""
        n = 1
        while n + 1 - self.least_size(n + 1) <= left_out:
            n += 1
        return n


def _frequent(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            some = count >= 3
            return pa.RecordBatch.from_arrays([pa.array(token[some].view(np.int64)), pa.array(count[some])], ["token", "n"])

        held, size = [], 0
        for b in C.pieces(batches):
            h, _ = shingle_sets(b.column("text"), n)
            held.append(h)
            size += len(h)
            if size > 1_000_000:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def frequent_elements(docs: DataFrame, n: int) -> np.ndarray:
    """The at most HINTS elements seen most, rarest first: an order hint only."""
    sums = docs.select("text").mapInArrow(_frequent(n), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = sums.orderBy(F.desc("n"), "token").limit(HINTS).toPandas()
    return top["token"].to_numpy(np.int64)[::-1].view(np.uint64)


def _identities(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches):
            h, at = shingle_sets(b.column("text"), n)
            s1, s2 = signatures(h, at)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at)), pa.array(s1), pa.array(s2)], ["doc_id", "n", "s1", "s2"])

    return run


def _features(n: int, t: Threshold, hints: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(hints.value)
        known = hints.value[order]
        for b in C.pieces(batches):
            h, at = shingle_sets(b.column("text"), n)
            size = np.diff(at)
            s1, s2 = signatures(h, at)
            row = C.rows_of(at)
            rank = np.zeros(len(h), np.int64)
            if len(known):
                i = np.minimum(np.searchsorted(known, h), len(known) - 1)
                rank = np.where(known[i] == h, order[i] + 1, 0)
            by = np.lexsort((h, rank, row))
            pos = np.arange(len(h)) - at[row]
            first = pos < t.prefix(size)[row]
            most = t.largest(LEFT_OUT)
            few = (size <= most)[row]
            cells = np.bincount(row * CELLS + (h >> _U(58)).astype(np.int64), minlength=len(size) * CELLS).reshape(-1, CELLS)
            short = cells.reshape(len(cells), SHORT, -1).sum(2)
            small_enough = short.max(1, initial=0) < 256
            packed = short.astype(np.uint8).view("<i8").reshape(len(short), -1) if len(short) else np.zeros((0, SHORT // 8), np.int64)
            shorts = [pa.array(packed[:, w].copy(), pa.int64(), mask=~small_enough) for w in range(SHORT // 8)]
            fits = cells.max(1, initial=0) < 1 << 16
            sketch = pa.array([x.tobytes() if ok else None for x, ok in zip(cells.astype("<u2"), fits, strict=True)], pa.binary())
            prefix = C.list_array(h[by][first].view(np.int64), np.where(size > 0, t.prefix(size), 0), pa.int64())
            small = C.list_array(h[few].view(np.int64), np.where(size <= most, size, 0), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size), pa.array(s1), pa.array(s2), prefix, small, sketch, *shorts], ["doc_id", "n", "s1", "s2", "prefix", "small", "sketch", *SHORTS])

    return run


def _subsets(t: Threshold):
    """(c, key) of every subset of a small set that can decide a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reps, sizes, cs, keys = [], [], [], []
            for rep, n, tokens in zip(b.column("rep").to_pylist(), b.column("n").to_pylist(), b.column("small").to_pylist(), strict=True):
                e = C.mix(np.array(tokens, np.int64).view(np.uint64))
                whole = e.sum(dtype=np.uint64)
                left_out = n - int(t.least_size(n))
                parts = [(n, np.array([whole]))]
                if left_out >= 1:
                    parts.append((n - 1, whole - e))
                if left_out >= 2:
                    i, j = np.triu_indices(n, 1)
                    parts.append((n - 2, whole - e[i] - e[j]))
                for c, key in parts:
                    reps.append(np.full(len(key), rep))
                    sizes.append(np.full(len(key), n))
                    cs.append(np.full(len(key), c))
                    keys.append(key.view(np.int64))
            if reps:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (reps, sizes, cs, keys)], ["rep", "n", "c", "key"])

    return run


def _verify(n: int, t: Threshold):
    """Rows sorted by (u, part, kind): a pivot row, then the members to compare with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, mine = None, np.zeros(0, np.uint64)
        for b in C.pieces(batches):
            h, at = shingle_sets(b.column("text"), n)
            s1, _ = signatures(h, at)
            u = b.column("u").to_numpy()
            v = b.column("v").to_numpy()
            ok = s1 == b.column("s1").to_numpy()
            out_u, out_v = [], []
            for i in range(len(u)):
                own = h[at[i] : at[i + 1]]
                if not ok[i]:
                    continue  # another text under the same id
                if v[i] == u[i]:
                    pivot, mine = u[i], own
                elif pivot == u[i]:
                    k = np.searchsorted(mine, own)
                    common = int((mine[np.minimum(k, len(mine) - 1)] == own).sum()) if len(mine) else 0
                    if t.den * common >= t.num * (len(mine) + len(own) - common):
                        out_u.append(u[i])
                        out_v.append(v[i])
            if out_u:
                yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], ["u", "v"])

    return run


def _bounded(t: Threshold):
    """The pairs whose sketches allow enough common elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = pc.and_(pc.is_valid(b.column("a")), pc.is_valid(b.column("b"))).to_numpy(zero_copy_only=False)
            keep = np.ones(b.num_rows, bool)
            at = np.flatnonzero(some)
            if len(at):
                x, y = (np.frombuffer(b"".join(b.column(c).take(pa.array(at)).to_pylist()), "<u2").reshape(-1, CELLS).astype(np.int64) for c in "ab")
                most = np.minimum(x, y).sum(1)
                keep[at] = (t.den + t.num) * most >= t.num * (x.sum(1) + y.sum(1))
            yield b.filter(pa.array(keep)).select(["u", "su", "v", "sv"])

    return run


def _filtered(pairs: DataFrame, reps: DataFrame, t: Threshold) -> DataFrame:
    """The pairs (u, su, v, sv) once each, without those that the sketches rule out."""
    about = reps.select("rep", "sketch")
    one = pairs.dropDuplicates(["u", "v"]).join(about.select(F.col("rep").alias("u"), F.col("sketch").alias("a")), "u")
    both = one.join(about.select(F.col("rep").alias("v"), F.col("sketch").alias("b")), "v")
    return both.mapInArrow(C.released(_bounded(t)), "u long, su long, v long, sv long")


def verified(docs: DataFrame, pairs: DataFrame, n: int, t: Threshold) -> DataFrame:
    """The pairs (u, su, v, sv) of ids and signatures whose sets are linked, as (u, v).

    A pivot's text is sent to 16 parts of its members, each part streamed past it."""
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(16)))
    member = dealt.select("u", "part", "v", F.col("sv").alias("s1"))
    pivot = dealt.groupBy("u", "part").agg(F.first("su").alias("s1")).select("u", "part", F.col("u").alias("v"), "s1")
    wanted = member.unionByName(pivot)
    texts = only_ids(docs.select(F.col("doc_id").cast("long").alias("v"), "text"), wanted.select("v").distinct(), "v")
    rows = wanted.join(texts, "v")
    ready = rows.repartition("u", "part").sortWithinPartitions("u", "part", (F.col("v") != F.col("u")).cast("int"))
    return ready.select("u", "v", "s1", "text").mapInArrow(C.released(_verify(n, t)), "u long, v long").distinct()


def _boundary(reps: DataFrame, t: Threshold) -> int:
    """The largest size that is enumerated: where subset keys cost less than list scans."""
    none, one, two = (t.largest(k) for k in range(LEFT_OUT + 1))
    few = reps.filter(F.col("n").between(none + 1, two))
    token = few.select("n", F.explode("prefix").alias("token"))
    lists = token.groupBy("token").agg(F.count("*").alias("len"), F.sum((F.col("n") <= one).cast("long")).alias("a"))
    scan = lists.agg(F.sum(F.col("a") * F.col("len")).alias("a"), F.sum((F.col("len") - F.col("a")) * F.col("len")).alias("b")).first()
    keys = few.agg(
        F.sum(F.when(F.col("n") <= one, F.col("n") + 1)).alias("a"),
        F.sum(F.when(F.col("n") > one, F.col("n") * (F.col("n") + 1) / 2 + 1)).alias("b"),
    ).first()
    cheaper = [(keys[k] or 0) <= (scan[k] or 0) * COMPARE_COST for k in ("a", "b")]
    return two if all(cheaper) else one if cheaper[0] else none


def _small_links(reps: DataFrame, most: int, t: Threshold) -> DataFrame:
    sets = reps.filter(F.col("n").between(t.least_size(t.largest(0) + 1), most)).select("rep", "n", "small")
    keys = sets.mapInArrow(C.released(_subsets(t)), "rep long, n long, c long, key long")
    hubs = keys.groupBy("c", "key").agg(F.min(F.struct("n", "rep")).alias("hub"), F.count("*").alias("len")).filter("len > 1").drop("len")
    met = keys.join(hubs, ["c", "key"])
    link = (t.den + t.num) * F.col("c") >= t.num * (F.col("n") + F.col("hub.n"))
    return met.filter(link & (F.col("rep") != F.col("hub.rep"))).select(F.col("rep").alias("u"), F.col("hub.rep").alias("v")).distinct()


def _short_bound(t: Threshold, a: str, b: str):
    """The short sketches allow the pair; a set without one may always pass."""
    most = F.lit(0).cast("long")
    for w in range(SHORT // 8):
        for k in range(8):
            x, y = (F.shiftrightunsigned(F.col(f"{p}k{w}"), 8 * k).bitwiseAND(F.lit(255)) for p in (a, b))
            most = most + F.least(x, y)
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    return F.col(f"{a}k0").isNull() | F.col(f"{b}k0").isNull() | ((t.den + t.num) * most >= t.num * (n + m))


def _possible(t: Threshold, a: str, b: str):
    """Sizes, list positions and the elements held alone allow the pair to be linked."""
    n, m, i, j, s, r = (F.col(f"{p}{x}") for x in ("n", "pos", "alone") for p in (a, b))
    most = F.least(F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1), n - s, m - r)
    return (t.den + t.num) * most >= t.num * (n + m)


def _large_links(docs: DataFrame, reps: DataFrame, small: DataFrame, most: int, n: int, t: Threshold, scratch: Scratch) -> DataFrame:
    sets = reps.filter(F.col("n") >= t.least_size(most + 1))
    entries = sets.select("rep", "n", "alone", "s1", F.posexplode("prefix").alias("pos", "token"))
    shared = entries.groupBy("token").agg(F.count("*").alias("len")).filter("len > 1").select("token")
    lists = scratch.save(entries.join(shared, "token"), "lists")
    fields = ("rep", "n", "alone", "s1", "pos", "comp")
    edges, few, before = small, FEW_PAIRS * lists.count(), None
    for r in range(PIVOT_ROUNDS + 1):
        if r:
            forest = components(edges, scratch, 2)  # an unfinished merger only leaves more to compare
            edges = forest.withColumnRenamed("root", "v")
            roots = forest.groupBy("u").agg(F.min("root").alias("root"))
            marked = lists.join(roots.withColumnRenamed("u", "rep"), "rep", "left").withColumn("comp", F.coalesce("root", "rep")).drop("root")
            part = marked.groupBy("token", "comp").agg(F.count("*").alias("c"))
            per = part.groupBy("token").agg(F.sum("c").alias("len"), F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("kinds")).filter("kinds > 1")
            open_ = scratch.save(marked.join(per.select("token", "len", F.col("top.comp").alias("main")), "token"), "open")
            left = open_.filter("comp <> main")
            todo = left.agg(F.sum("len")).first()[0] or 0
            if not todo:
                break
            slow = before is not None and 2 * todo > before  # few of the rest link with any pivot
            before = todo
            if r == PIVOT_ROUNDS or todo <= few or slow:
                about = reps.select("rep", "prefix", *SHORTS)
                a = left.join(about, "rep").select("token", *(F.col(c).alias(f"a_{c}") for c in (*fields, "prefix", *SHORTS)))
                b = open_.join(about, "rep").select("token", "main", *(F.col(c).alias(f"b_{c}") for c in (*fields, "prefix", *SHORTS)))
                # A pair is met in the list of its first common element alone.
                here = F.element_at(F.array_intersect("a_prefix", "b_prefix"), 1) == a["token"]
                once = (F.col("b_comp") == F.col("main")) | (F.col("a_rep") < F.col("b_rep"))
                met = a.join(b, (a["token"] == b["token"]) & (F.col("a_comp") != F.col("b_comp")) & once & _possible(t, "a_", "b_") & _short_bound(t, "a_", "b_") & here)
                first = F.col("a_rep") < F.col("b_rep")
                pick = lambda c, d: F.when(first, F.col(c)).otherwise(F.col(d))
                pairs = met.select(pick("a_rep", "b_rep").alias("u"), pick("a_s1", "b_s1").alias("su"), pick("b_rep", "a_rep").alias("v"), pick("b_s1", "a_s1").alias("sv"))
                pairs = scratch.save(_filtered(pairs, reps, t), "pairs")
                found = scratch.save(verified(docs, pairs, n, t), "found")
                edges = scratch.save(edges.unionByName(found), "edges")
                break
            lists = open_.select(*lists.columns)  # closed lists need no further round
            marked = open_.withColumn("turn", (F.col("comp") == F.col("main")).cast("int"))
        else:
            marked = lists.withColumn("comp", F.col("rep")).withColumn("turn", F.lit(0))
        rank = F.xxhash64("rep", F.lit(r))
        pivots = marked.groupBy("token").agg(F.min(F.struct("turn", (F.col("alone") / F.col("n")).alias("own"), rank.alias("k"), *fields)).alias("p"))
        pivots = pivots.select("token", *(F.col(f"p.{c}").alias(f"p_{c}") for c in fields))
        met = marked.join(pivots, "token").filter((F.col("comp") != F.col("p_comp")) & _possible(t, "", "p_"))
        pairs = met.select(F.col("p_rep").alias("u"), F.col("p_s1").alias("su"), F.col("rep").alias("v"), F.col("s1").alias("sv"))
        pairs = scratch.save(_filtered(pairs, reps, t), "pairs")
        found = scratch.save(verified(docs, pairs, n, t), "found")
        edges = scratch.save(edges.unionByName(found), "edges")
        scratch.release()
    return edges


def _candidates(docs: DataFrame, classes: DataFrame, n: int, t: Threshold, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(their texts, the classes that share enough elements with others to link)."""
    enough = t.den * (F.col("n") - F.col("alone")) >= t.num * F.col("n")
    elements = classes.agg(F.sum("n")).first()[0] or 0
    some = scratch.save(alone(docs, classes, n, elements, t.share()).filter(enough).drop("alone"), "some")
    scratch.release()
    elements = some.agg(F.sum("n")).first()[0] or 0
    texts = only_ids(docs, some.select(F.col("rep").alias("doc_id")), "doc_id")
    left = scratch.save(alone(texts, some, n, elements).filter(enough), "left")
    scratch.release()
    return only_ids(docs, left.select(F.col("rep").alias("doc_id")), "doc_id"), left


def _sets(texts: DataFrame, classes: DataFrame, n: int, t: Threshold) -> DataFrame:
    """The classes with the prefix, the small set and the sketches of each."""
    hints = texts.sparkSession.sparkContext.broadcast(frequent_elements(texts, n))
    schema = "doc_id long, n long, s1 long, s2 long, prefix array<long>, small array<long>, sketch binary, " + ", ".join(f"{k} long" for k in SHORTS)
    about = texts.mapInArrow(_features(n, t, hints), schema).withColumnRenamed("doc_id", "rep").dropDuplicates(["rep", "s1", "s2"])
    return classes.join(about, ["rep", "n", "s1", "s2"])


def jaccard_components(spark: SparkSession, docs: DataFrame, n: int = 3, threshold: Threshold = Threshold(), scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    t = threshold
    scratch = scratch or Scratch(spark, "ngram-join")
    others = [x for x, _ in scratch.tables]
    kind = docs.schema["doc_id"].dataType
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    whole = scratch.save(docs.mapInArrow(_identities(n), "doc_id long, n long, s1 long, s2 long"), "ids")
    docs = docs.filter("doc_id is not null")
    classes = whole.filter("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    classes = scratch.save(classes, "classes")
    texts, left = _candidates(docs, classes, n, t, scratch)
    reps = scratch.save(_sets(texts, left, n, t), "reps")
    scratch.release()
    most = _boundary(reps, t)
    small = scratch.save(_small_links(reps, most, t), "small")
    edges = _large_links(docs, reps, small, most, n, t, scratch)
    roots = scratch.save(components(edges, scratch), "roots")
    scratch.keep(*others, whole, classes, roots)
    placed = classes.join(roots.withColumnRenamed("u", "rep"), "rep", "left")
    placed = placed.select("n", "s1", "s2", F.coalesce("root", "rep").alias("component"))
    whole = whole.join(placed, ["n", "s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return whole.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"), component.cast(kind).alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, n: int = 5, threshold: Threshold = Threshold(80)) -> DataFrame:
    """The documents, one row of each component: the one with the smallest id (a null
    id comes last), whatever ids the rows share or lack; texts without words all stay.

    Rows are told apart by a key, which a written copy of ``docs`` holds fast."""
    scratch = Scratch(spark, "near-copies")
    row = free_name(docs, "row")
    keyed = scratch.save(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = jaccard_components(spark, keyed.select(F.col(row).alias("doc_id"), "text"), n, threshold, scratch)
    found = found.filter("n_shingles > 0").select(F.col("doc_id").alias("row"), "component_id")
    ids = keyed.select(F.col(row).alias("row"), "doc_id")
    placed = scratch.save(found.join(ids, "row"), "placed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = placed.groupBy("component_id").agg(first.alias("first")).select("first.row")
    gone = scratch.save(placed.select("row").join(kept, "row", "left_anti"), "gone")
    scratch.keep(keyed, gone)
    gone = gone.withColumnRenamed("row", row)
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return keyed.join(gone, row, "left_anti").drop(row)
