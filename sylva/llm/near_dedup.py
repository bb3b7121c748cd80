"""MinHash near-dedup with tensored banding.

A text is the set of its ``shingle``-word shingles. Two small collections of ``tables`` sub-keys each, of ``depth`` minhashes, are
computed; a table key is a pair of one sub-key of either collection, so tables**2 keys of 2 * depth minhashes cost only
2 * tables * depth minhashes. Two sets of similarity s share a key with probability (1 - (1 - s**depth)**tables)**2:
0.9997 at s = 0.75 and over 0.9999 at s = 0.85 with the defaults.

  1. Rows with equal sets are one class; the least id stands for it.
  2. Sub-keys that only one class has can't be part of a shared table key, and of sub-keys of one collection that the same classes
     share one says all: both are settled by an aggregation before any pair of sub-keys is formed, so a text without near copies
     emits no table key and a pair of near copies emits one, not hundreds.
  3. In rounds, every bucket (classes with one table key) picks a leader from its largest component so far, and its classes outside
     that component become candidates of the leader, at most two leaders a class and round. Candidates are verified on the full sets,
     and the links merge components. Buckets within one component are done.
  4. The classes of buckets that still hold several components are described by their differences from the common part of their group
     (classes whose buckets are connected): shingles of it that they lack, and shared ones beyond it. What two sets share follows
     exactly from their sizes, from how much each lacks and from how many differences they have in common, so a passage or text that a
     whole group shares no longer makes its texts alike. Sets that lack so little that they are similar without a common difference
     are all linked with the one that lacks least. The others meet the leaders of buckets of deep keys of their differences, in rounds
     in which components merge. What then is still in different components is tested where it may be similar by an exact bound: in the
     order from the rarest to the most frequent difference, the first common one stands so early that enough can follow in both. That
     goes in turns, between which components merge too. No link is lost by step 4, and none is capped.

Only texts of classes in buckets are moved, after a Bloom filter of their ids has left the others where they are.

Defined results: words are split at ASCII blanks and A-Z is lower-cased; a text of fewer words than a shingle is one shingle; a null
or empty text, or one of blanks, has the empty set and is linked with nothing; a row of null id gets the component of the other rows
with its set (null if there are none) and is kept only if that is null; rows of one id are each grouped by their own text, and sets
that one id stands for are one group; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm import bloom
from sylva.llm.components import connected
from sylva.llm.rows import drop_marked
from sylva.llm.skew import join_counted
from sylva.session import in_worker, shared_table, ship

PRIME = np.uint64(0x9E3779B97F4A7C15)
CACHE = 100_000
#: Keys of differences: two texts of which 43 % of the differences are common to both share one of the keys with a probability of 0.89.
DEEP, DEEP_TABLES = 4, 64
#: What is left is tested in so many turns, between which components merge.
TURNS = 3


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Texts to sorted arrays of their shingles' distinct 64-bit hashes."""

    def __init__(self, shingle: int) -> None:
        self.shingle = shingle
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.shingle, len(ids))
        h = np.full(len(ids) - n + 1, n, np.uint64)
        for i in range(n):
            h = mix(h * PRIME + ids[i : len(ids) - n + 1 + i])
        return np.unique(h)


def _hash_parameters(n: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, n + 1, dtype=np.uint64)
    return mix(k * PRIME) | np.uint64(1), mix(k * PRIME + np.uint64(77))


def minhashes(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One minimum for each parameter; the multiply-shift value's high half decides."""
    out = np.empty(len(a), np.uint64)
    for i in range(len(a)):
        out[i] = ((shingles * a[i] + b[i]) >> np.uint64(20)).min()
    return out


def sub_keys(shingles: np.ndarray, depth: int, tables: int, parameters: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """2 * tables sub-keys, the first collection's and then the second's, each telling its own place apart."""
    m = minhashes(shingles, *parameters).reshape(2 * tables, depth)
    h = np.arange(1, 2 * tables + 1, dtype=np.uint64)
    for i in range(depth):
        h = mix(h * PRIME + m[:, i])
    return h.view(np.int64)


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _sets(docs: DataFrame, shingle: int, tables: int, depth: int) -> DataFrame:
    """doc_id, tx, n_shingles, set (128-bit hash of the set), sub (array of sub-keys; null for an empty set). docs: doc_id, text, tx."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, parameters = Shingler(shingle), _hash_parameters(2 * tables * depth)
        for b in batches:
            for part in (b.slice(i, 1000) for i in range(0, len(b), 1000)):
                n, sets, subs = [], [], []
                for x in part.column(1):
                    s = make(x.as_py())
                    n.append(len(s))
                    sets.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    subs.append(sub_keys(s, depth, tables, parameters) if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(subs, pa.list_(pa.int64()))], names=["doc_id", "tx", "n_shingles", "set", "sub"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(in_worker("near_dedup", run), f"doc_id {kind}, tx bigint, n_shingles bigint, set binary, sub array<bigint>")


def _table_keys(sub: DataFrame, tables: int) -> DataFrame:
    """key, rep: the pairs of sub-keys (rep, sub) that at least two classes have, one of either collection."""
    flat = sub.select("rep", F.posexplode("sub").alias("at", "k")).select("rep", (F.col("at") < tables).alias("left"), "k")
    shared = flat.groupBy("left", "k").agg(F.min("rep").alias("lo"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("of")).where("n > 1")
    kept = shared_table(shared.groupBy("left", "lo", "n", "of").agg(F.min("k").alias("k")).select("left", "k", "n"), "subkeys")
    held = join_counted(flat, kept, ["left", "k"], "n", sub.count() * 2 * tables)
    own = held.groupBy("rep").agg(*[F.collect_list(F.when(F.col("left") == side, F.col("k"))).alias(n) for n, side in (("l", True), ("r", False))])
    return own.select("rep", "r", F.explode("l").alias("x")).select("rep", "x", F.explode("r").alias("y")).select(F.xxhash64("x", "y").alias("key"), "rep")


def _only(texts: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The rows of texts (rep, tx, text) whose rep is in ids (rep), and few others: what a join with ids needs to move."""
    filter_, bits = bloom.key_filter(ids.select(F.xxhash64("rep").alias("h")), n=n)
    return bloom.with_flag(texts.select("rep", "tx", "text", F.xxhash64("rep").alias("possible")), filter_, bits, "possible").where("possible").select("rep", "tx", "text")


def _verified(pairs: DataFrame, n: int, texts: DataFrame, shingle: int, numerator: int, denominator: int) -> DataFrame:
    """Those of the n pairs (a, b) whose full sets are similar enough; a and b are ids of texts (rep, text)."""
    for side in "ab":
        # A table of its own: a stage that reads texts in Python and compares them in Python would take twice the workers.
        own = shared_table(_only(texts, pairs.select(F.col(side).alias("rep")).distinct(), n), "sides")
        pairs = pairs.join(own.select(F.col("rep").alias(side), F.col("tx").alias(f"x{side}"), F.col("text").alias(f"t{side}")), side)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, sets = Shingler(shingle), {}

        def of(i: tuple[int, int], text: pa.Scalar) -> np.ndarray:  # an id may stand for several texts
            if i not in sets:
                if len(sets) >= 64:
                    sets.clear()
                sets[i] = make(text.as_py())
            return sets[i]

        for b in batches:
            keep = []
            for j, x, y in zip(zip(b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True), b.column(2), b.column(3), strict=True):
                y, x = of(j, y), make(x.as_py())
                both = 0
                if denominator * min(len(x), len(y)) >= numerator * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(denominator * both >= numerator * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "ta", "tb", "xb").mapInArrow(in_worker("near_dedup", test), "a bigint, b bigint")


def _differences(left: DataFrame, texts: DataFrame, shingle: int, numerator: int, denominator: int) -> DataFrame:
    """A row for each text of left (rep, c, g) that shares a shingle with another component of its group g: rep, c, g, u, els, keys, least, reach.

    What more than half of a group's texts hold is its common part L. els is how a text differs from L, so far as texts of another
    component may differ alike: shingles of L that it lacks and shared ones beyond L, the rarest differences first. Two texts are
    similar enough exactly where they have i differences in common with 2 * s * i >= u + u', s being numerator + denominator.
    keys: deep keys of els. least: the group's least u; reach: its largest 2 * s * size(els) - u.
    """
    s = numerator + denominator

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(shingle)
        for b in batches:
            for *own, text in zip(*(b.column(i).to_pylist() for i in range(5)), b.column(5), strict=True):
                h = make(text.as_py()).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(h), x)) for x in (*own, len(h))), pa.array(h)], names=["rep", "tx", "c", "g", "ng", "m", "h"])

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parameters = _hash_parameters(DEEP_TABLES * DEEP)
        column = lambda x, n: x.values.field(n).to_numpy() if x.values is not None else np.zeros(0, np.int64)
        for b in batches:
            us, els, keys = [], [], []
            for m, has, beyond, ref in zip(b.column(3).to_pylist(), b.column(4), b.column(5), b.column(6), strict=True):
                all_, lacks = column(ref, "h"), 0
                gone = ~np.isin(all_, has.values.to_numpy(zero_copy_only=False))
                lacks = int(gone.sum())
                h = np.concatenate([all_[gone], column(beyond, "h")])
                df = np.concatenate([column(ref, "df")[gone], column(beyond, "df")])
                h = h[np.lexsort((h, df))]
                us.append(2 * (numerator * m + s * lacks) - s * len(all_))
                els.append(h)
                keys.append(_deep_keys(h.view(np.uint64), parameters) if len(h) else np.zeros(0, np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (els, keys)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(us, pa.int64()), *lists], names=["rep", "c", "g", "u", "els", "keys"])

    own = shared_table(_only(texts, left, left.count()).join(left, "rep").select("rep", "tx", "c", "g", "text"), "sides")
    sizes = shared_table(own.groupBy("g").agg(F.count(F.lit(1)).alias("ng")), "sizes")
    own = join_counted(own, sizes, ["g"], "ng", own.count(), keep=True).select("rep", "tx", "c", "g", "ng", "text")
    flat = shared_table(own.mapInArrow(in_worker("near_dedup", explode), "rep bigint, tx bigint, c bigint, g bigint, ng bigint, m bigint, h bigint"), "flat")
    common = flat.groupBy("g", "h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("df"), F.max("ng").alias("ng")).where("lo < hi")
    common = shared_table(common.select("g", "h", "df", "ng", F.expr("2 * df > ng").alias("most")), "common")
    held = join_counted(flat, common.drop("ng"), ["g", "h"], "df", flat.count(), keep=True)
    lists = [F.collect_list(F.when(F.col("most"), F.col("h"))).alias("has"), F.collect_list(F.when(~F.col("most"), F.struct("df", "h"))).alias("beyond")]
    sets = held.groupBy("rep", "tx", "c", "g", "ng", "m").agg(*lists)
    # L has at most twice the mean size of the group's sets; one copy of it goes to every thousand texts.
    copies = F.floor(F.col("ng") / 1000) + 1
    ref = common.where("most").groupBy("g").agg(F.max("ng").alias("ng"), F.collect_list(F.struct((F.col("ng") - F.col("df")).alias("df"), "h")).alias("ref"))
    ref = ref.select("g", "ref", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)).alias("copy"))
    sets = sets.withColumn("copy", F.pmod(F.xxhash64("rep", "tx"), copies) + 1).join(ref, ["g", "copy"], "left")
    sets = shared_table(sets.select("rep", "c", "g", "m", "has", "beyond", F.coalesce("ref", F.array().cast("array<struct<df:bigint,h:bigint>>")).alias("ref")), "sets")
    diff = shared_table(sets.mapInArrow(in_worker("near_dedup", differ), "rep bigint, c bigint, g bigint, u bigint, els array<bigint>, keys array<bigint>"), "differences")
    bounds = diff.groupBy("g").agg(F.min("u").alias("least"), F.max(2 * s * F.size("els") - F.col("u")).alias("reach"), F.min_by("rep", "u").alias("nearest"), F.count(F.lit(1)).alias("k"))
    diff = join_counted(diff, shared_table(bounds, "bounds"), ["g"], "k", diff.count())
    return shared_table(diff, "differences")


def _deep_keys(els: np.ndarray, parameters: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Keys of DEEP minhashes each, of a set that isn't empty."""
    m = minhashes(els, *parameters).reshape(DEEP_TABLES, DEEP)
    h = np.arange(1, DEEP_TABLES + 1, dtype=np.uint64)
    for i in range(DEEP):
        h = mix(h * PRIME + m[:, i])
    return h.view(np.int64)


def _able(diff: DataFrame, s: int) -> DataFrame:
    """Rows of differences that may be similar to a text of their group by the differences, not only by lacking few of them."""
    return diff.where(f"2 * {s} * size(els) >= u + least and u <= reach")


def _early(diff: DataFrame, s: int) -> DataFrame:
    """g, h, rep, u, rest: differences h that stand early enough to be the first that two texts have in common; rest counts them and what follows."""
    flat = _able(diff, s).select("g", "rep", "u", "least", F.size("els").alias("d"), F.posexplode("els").alias("at", "h"))
    return shared_table(flat.where(f"2 * {s} * (d - at) >= u + least").select("g", "h", "rep", "u", (F.col("d") - F.col("at")).alias("rest")), "early")


def _early_pairs(early: DataFrame, comp: DataFrame, s: int, turn: int) -> DataFrame:
    """a, b (a > b): the pairs of one turn of TURNS whose texts are of different components and have an early difference in common, the rest allowing a link.

    A turn is a hash of the pair, and takes three times as many as all before it. All turns together lose no link.
    """
    early = early.join(comp.select("rep", "c"), "rep")
    mixed = early.groupBy("g", "h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("g", "h")
    early = early.join(mixed, ["g", "h"], "left_semi")
    a, b = (early.select("g", "h", *[F.col(n).alias(f"{n}{x}") for n in ("rep", "c", "u", "rest")]) for x in "ab")
    of = f"pmod(xxhash64(repa, repb), {4 ** (TURNS - 1)})"
    own = f"{of} < {4 ** turn}" + (f" and {of} >= {4 ** (turn - 1)}" if turn else "")
    fits = f"ca <> cb and repa > repb and 2 * {s} * least(resta, restb) >= ua + ub and {own}"
    return a.join(b, ["g", "h"]).where(fits).select(F.col("repa").alias("a"), F.col("repb").alias("b")).distinct()


def _merge(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (rep, c, m) after links (a, b) between its classes."""
    at = comp.select("rep", "c")
    edges = links.join(at.withColumnsRenamed({"rep": "a", "c": "x"}), "a").join(at.withColumnsRenamed({"rep": "b", "c": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    moved = connected(edges).withColumnRenamed("id", "c")
    return shared_table(comp.join(moved, "c", "left").select("rep", F.coalesce("component", "c").alias("c"), "m"), "comp")


def _tested(pairs: DataFrame, comp: DataFrame, texts: DataFrame, tested: DataFrame | None, likeness: tuple[int, int, int]) -> tuple[DataFrame, DataFrame | None, bool]:
    """comp after those of pairs (a, b) that weren't tested, all that have been tested now, and whether any was a link."""
    pairs = shared_table(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    if not (k := pairs.count()):
        return comp, tested, False
    links = shared_table(_verified(pairs, k, texts, *likeness), "links")
    tested = pairs if tested is None else tested.unionByName(pairs)
    if not links.limit(1).count():
        return comp, tested, False
    return _merge(comp, links), tested, True


def _led(live: DataFrame, comp: DataFrame, texts: DataFrame, tested: DataFrame | None, rounds: int, likeness: tuple[int, int, int], limits: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """live (key, rep) of buckets that may still be mixed, comp and tested, after rounds in which classes meet leaders of their buckets.

    A class meets two leaders a round; with limits (rep, u in half differences, d) all leaders whose d allows a link.
    """
    for r in range(rounds):
        named = live.join(comp.select("rep", "c"), "rep")
        parts = named.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"), F.min_by("rep", F.xxhash64("rep", F.lit(r)) if r else F.col("rep")).alias("lead"))
        mixed = parts.groupBy("key").agg(F.max_by(F.struct("lead", F.col("c").alias("lc")), F.struct("n", -F.col("c"))).alias("d"), F.count(F.lit(1)).alias("k")).where("k > 1").select("key", "d.lead", "d.lc")
        rest = shared_table(named.join(mixed, "key"), "mixed")
        live = rest.select("key", "rep")
        order = F.xxhash64("lead", F.lit(r)) if r else F.col("lead")
        met = rest.where("c <> lc").select("lead", "rep")
        if limits is None:
            two = met.groupBy("rep").agg(F.array_distinct(F.array(F.min_by("lead", order), *([F.max_by("lead", order)] if r else []))).alias("leads"))
            met = two.select(F.explode("leads").alias("lead"), "rep")
        pairs = met.select(F.greatest("rep", "lead").alias("a"), F.least("rep", "lead").alias("b")).distinct()
        if limits is not None:
            for side in "ab":
                pairs = pairs.join(limits.withColumnsRenamed({"rep": side, "u": f"u{side}", "d": f"d{side}"}), side)
            pairs = pairs.where("2 * least(da, db) >= ua + ub").select("a", "b")
        comp, tested, any_ = _tested(pairs, comp, texts, tested, likeness)
        if not any_:
            break
    return live, comp, tested


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, numerator: int, denominator: int, tables: int, depth: int, rounds: int) -> DataFrame:
    """For every row: doc_id, n_shingles, tx (hash of its text), set, component (null for a null id without others of its set), kept."""
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_hash(F.col(text_col)).alias("tx"))
    rows = shared_table(_sets(base, shingle, tables, depth), "signatures")
    n_rows = rows.count()
    first = F.min_by(F.struct("sub", F.col("n_shingles").alias("m"), "tx"), "doc_id")
    classes = rows.where("set is not null and doc_id is not null").groupBy("set").agg(F.min("doc_id").alias("rep"), first.alias("of"))
    classes = shared_table(classes.select("set", "rep", "of.tx", "of.m", "of.sub"), "classes")
    texts = base.where("doc_id is not null").select(F.col("doc_id").alias("rep"), "tx", "text")

    live = shared_table(_table_keys(classes.select("rep", "sub"), tables), "keys")
    comp = shared_table(classes.groupBy("rep").agg(F.max("m").alias("m")).select("rep", F.col("rep").alias("c"), "m").join(live.select("rep").distinct(), "rep", "left_semi"), "comp")
    if n := comp.count():
        texts = shared_table(_only(texts, comp, n).join(classes.join(comp, "rep", "left_semi").select("rep", "tx"), ["rep", "tx"], "left_semi"), "texts")
    likeness = (shingle, numerator, denominator)
    if n:
        live, comp, tested = _led(live, comp, texts, None, rounds, likeness)
        # What is still mixed is gone through. That no new pair was left says nothing: a leader's may all be tested.
        named = live.join(comp, "rep")
        mixed = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("rep").alias("first")).where("lo < hi").select("key", "first")
        near = shared_table(named.select("key", "rep", "c").join(mixed, "key"), "left")
        left = shared_table(near.select("rep", "c").distinct(), "left")
        if left.limit(1).count():
            groups = connected(near.select(F.col("rep").alias("a"), F.col("first").alias("b")))
            diff = _differences(left.join(groups.select(F.col("id").alias("rep"), F.col("component").alias("g")), "rep"), texts, *likeness)
            # All that lack little of the common part are linked with the one that lacks least; then leaders of deep keys, then what is left.
            star = diff.where("u + least <= 0 and rep <> nearest").select(F.greatest("rep", "nearest").alias("a"), F.least("rep", "nearest").alias("b")).distinct()
            comp, tested = _tested(star, comp, texts, tested, likeness)[:2]
            deep = _able(diff, numerator + denominator).select("rep", F.explode("keys").alias("k"), "g").select(F.xxhash64("g", "k").alias("key"), "rep")
            deep = shared_table(deep.distinct(), "keys")
            limits = shared_table(diff.groupBy("rep").agg((F.min("u") / (numerator + denominator)).alias("u"), F.max(F.size("els")).alias("d")), "limits")
            _, comp, tested = _led(deep, comp, texts, tested, rounds, likeness, limits)
            early = _early(diff, numerator + denominator)
            for turn in range(TURNS):
                comp, tested, _ = _tested(_early_pairs(early, comp, numerator + denominator, turn), comp, texts, tested, likeness)

    by_set = classes.select("set", "rep").join(comp.select("rep", "c"), "rep", "left").select("set", F.coalesce("c", "rep").alias("component"))
    sizes = rows.where("set is not null").groupBy("set").agg(F.count(F.lit(1)).alias("size"))
    by_set = shared_table(by_set.join(sizes, "set"), "sets")
    out = join_counted(rows.drop("sub"), by_set, ["set"], "size", n_rows, how="left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", "tx", "set", component.alias("component"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def find_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, numerator: int = 75, denominator: int = 100, tables: int = 16, depth: int = 3, rounds: int = 3) -> DataFrame:
    """For every row: doc_id, n_shingles, component_id, kept. Ids are bigint."""
    return _grouped(docs, id_col, text_col, shingle, numerator, denominator, tables, depth, rounds).select("doc_id", "n_shingles", F.col("component").alias("component_id"), "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, numerator: int = 75, denominator: int = 100, tables: int = 16, depth: int = 3, rounds: int = 3) -> DataFrame:
    """docs with the kept rows of :func:`find_groups`, and of rows of one id and one set a single one; all columns as they were.

    Rows, not ids, are dropped: another text of the same id stays if its own group keeps it. Of null ids, one row of each set that no
    other row has stays. Rows with the empty set all stay.
    """
    rows = shared_table(_grouped(docs, id_col, text_col, shingle, numerator, denominator, tables, depth, rounds), "groups")
    # Of the kept rows of one id and set, the text of the least hash stays, once.
    kept = rows.where("kept and set is not null")
    several = kept.groupBy(F.col("doc_id").alias("i"), F.col("set").alias("s")).agg(F.min("tx").alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1")
    repeated = kept.join(several, F.expr("doc_id <=> i and set = s")).select("doc_id", "tx", (F.col("tx") == F.col("least")).alias("one"))
    acts = rows.where("not kept").select("doc_id", "tx", F.lit(False).alias("one")).unionByName(repeated).distinct()
    acts = shared_table(acts.select(F.col("doc_id").alias("id"), F.col("tx").alias("mark"), "one"), "dropped")
    return drop_marked(docs, F.col(id_col).cast("long"), text_hash(F.col(text_col)), acts)
