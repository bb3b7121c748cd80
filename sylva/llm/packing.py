"""Best-fit packing with Martello-Toth dominance reduction.

Documents are tokenised, ended with id 0 and cut into pieces of at most ``capacity`` tokens. A piece counts for packing only by its
length, so the instance is a histogram of ``capacity`` entries, whatever the number of documents: it is solved on the driver, and
the solution, a list of bin patterns with multiplicities, is handed out by (length, rank within the length).

The reduction looks at every piece j, from the largest to the smallest, with the free space s = capacity - j, and permanently fixes a
set with it where that set provably dominates every other set that holds j: whatever else would share a sequence with j can change
places with the fixed partner, so no solution needs fewer sequences.
  1. nothing fits with j: {j};
  2. a piece of exactly s exists: {j, s};
  3. at most one more piece fits with j: {j, k}, k the largest that fits;
  4. at most two more fit, and no two of them together are longer than k: {j, k}.
Where no rule holds for j, the next smaller piece is tried; fixed pieces leave fewer for the others, so passes go on until one fixes
nothing. Best-fit decreasing takes the remainder: each piece goes to the fullest bin that has room.

Ranks need no global order: pieces of one length are dealt to buckets by a hash, ranked in their bucket, and the buckets' offsets are
running sums over the bucket counts; a frequent length is thus split over many tasks.

Defined results: a null or empty text is one piece of one token; rows of equal id are told apart by an order among them, each is
packed; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.session import in_worker, kept, shared_table, ship

CACHE = 150_000  # pieces of words whose ids a worker keeps, twice: of late and of before
PART = 512 << 10  # bytes of texts that are taken apart at a time
LONGEST = 64  # characters of a piece that is kept
#: Texts that the fast path takes: up to Latin Extended-A, where no normal form changes a character and case maps one to one.
SIMPLE = re.compile("[\x00-\u012f\u0131-\u017f]*")
#: The tokenizer's own pattern of pieces, in that range and after lower-casing.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºÀ-ÖØ-öø-ſ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºÀ-ÖØ-öø-ſ0-9²³¹¼½¾]+")


class WordIds:
    """Token ids of texts by a tokenizer whose pieces never cross blanks and end in tokens marked as word ends.

    ids(texts) gives each text's ids as little-endian unsigned 32-bit bytes, equal to encoding the whole text. A text is cut into
    pieces, which are looked up; unknown pieces are encoded together, their ids being told apart by the word-end tokens. Texts outside
    the plain range, and all texts of a tokenizer of another kind, are encoded as they are.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        kind = json.loads(Path(path).read_text(encoding="utf-8"))
        suffix = kind["model"].get("end_of_word_suffix")
        own = [p.get("pattern", {}).get("Regex") for p in (kind.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.fast = bool(suffix) and own[:1] == [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"]
        for token, i in vocab.items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.special = [t["content"] for t in kind.get("added_tokens", [])]
        self.late: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                raise ValueError("a piece without a word end")
            data, start = ids.tobytes(), 0
            for p, end in zip(part, (4 * cuts).tolist(), strict=True):
                self.late[p] = data[start:end]
                start = end

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [PIECES.findall(t.lower()) if self.fast and SIMPLE.fullmatch(t) and not any(x in t for x in self.special) else None for t in texts]
        if len(self.late) > CACHE:
            self.late, self.before = {}, self.late
        new = set().union(*filter(None, split)).difference(self.late)
        for p in new.intersection(self.before):
            self.late[p] = self.before[p]
        self._learn(list(new.difference(self.before)))
        look = self.late.__getitem__
        out = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if own is None else b"".join(map(look, own)) for t, own in zip(texts, split, strict=True)]
        for p in new:
            if len(p) > LONGEST:
                del self.late[p]
        return out


def word_ids(path: str) -> WordIds:
    """The worker's one tokenizer: its words are known to later tasks, too."""
    return kept(path, lambda: WordIds(path))


def tokenise(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, little-endian 32-bit)."""
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        for b in batches:
            step = max(1, int(len(b) * PART / max(1, b.nbytes)))
            for at in range(0, len(b), step):
                part = b.slice(at, step)
                source, piece, start, length, crc, held = [], [], [], [], [], []
                for k, ids in enumerate(words.ids(part.column(1).to_pylist())):
                    ids += end
                    for n, s in enumerate(range(0, len(ids), width)):
                        own = ids[s : s + width]
                        source.append(k)
                        piece.append(n)
                        start.append(s // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        held.append(own if with_ids else None)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(source, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(held, pa.binary())], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    kind = base.schema["doc_id"].dataType.simpleString()
    out = base.mapInArrow(in_worker("packing", run), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary")
    return out if with_ids else out.drop("ids")


Patterns = list[tuple[tuple[int, ...], int]]


def reduce_by_dominance(histogram: dict[int, int], capacity: int) -> tuple[Patterns, dict[int, int]]:
    """Bin patterns that dominate all alternatives, with how many bins have them, and the histogram of what is left."""
    left = {x: n for x, n in histogram.items() if n > 0}
    lengths = sorted(left)
    fixed: Patterns = []

    def take(pattern: tuple[int, ...], n: int) -> None:
        fixed.append((tuple(sorted(pattern, reverse=True)), n))
        for x in pattern:
            left[x] -= n
            if not left[x]:
                del left[x]
                lengths.pop(bisect.bisect_left(lengths, x))

    def smallest(k: int, without: int) -> list[int]:
        """The k smallest pieces, of which one of length ``without`` is taken out."""
        out: list[int] = []
        for x in lengths:
            out += [x] * min(k - len(out), left[x] - (x == without))
            if len(out) == k:
                break
        return out

    def longest_pair(s: int, without: int) -> int:
        """The largest sum of two pieces that is at most s, one piece of length ``without`` being taken out."""
        best, lo, hi = 0, 0, bisect.bisect_right(lengths, s) - 1
        while lo <= hi:
            a, b = lengths[lo], lengths[hi]
            if a + b > s:
                hi -= 1
            elif a < b or left[a] - (a == without) >= 2:
                best = max(best, a + b)
                lo += 1
            else:
                lo += 1
        return best

    def fix(j: int) -> bool:
        s = capacity - j
        at = bisect.bisect_right(lengths, s) - 1
        if at >= 0 and lengths[at] == j and left[j] < 2:
            at -= 1
        if at < 0:
            take((j,), left[j] if j > s else 1)
            return True
        k = lengths[at]
        pairs = left[j] // 2 if j == k else min(left[j], left[k])
        few = smallest(3, j)
        if k == s or len(few) < 2 or few[0] + few[1] > s or (len(few) < 3 or sum(few) > s) and longest_pair(s, j) <= k:
            take((j, k), pairs)  # what is taken only leaves fewer alternatives, so the rule holds until j or k is used up
            return True
        return False

    before = -1
    while before != len(fixed):
        before, below = len(fixed), capacity + 1
        while at := bisect.bisect_left(lengths, below):
            j = lengths[at - 1]
            if not fix(j):
                below = j
    return fixed, left


def best_fit(histogram: dict[int, int], capacity: int) -> Patterns:
    """Best-fit decreasing. Open bins by free space, each space with groups of equal patterns."""
    left, lengths = dict(histogram), sorted(histogram)
    bins: dict[int, Patterns] = {}
    spaces: list[int] = []

    def put(space: int, pattern: tuple[int, ...], n: int) -> None:
        if space not in bins:
            bins[space] = []
            bisect.insort(spaces, space)
        bins[space].append((pattern, n))

    for x in reversed(lengths):
        n = left[x]
        while n:
            at = bisect.bisect_left(spaces, x)
            if at == len(spaces):
                per = capacity // x
                full, rest = divmod(n, per)
                if full:
                    put(capacity - per * x, (x,) * per, full)
                if rest:
                    put(capacity - rest * x, (x,) * rest, 1)
                break
            space = spaces[at]
            pattern, m = bins[space].pop()
            if not bins[space]:
                del bins[space]
                spaces.pop(at)
            per = min(space // x, n)  # the same bin stays the fullest with room until it is full
            used = min(m, n // per)
            if used < m:
                put(space, pattern, m - used)
            put(space - per * x, pattern + (x,) * per, used)
            n -= used * per
    return [g for groups in bins.values() for g in groups]


def reduce_and_fit(histogram: dict[int, int], capacity: int) -> Patterns:
    """Bin patterns (lengths, longest first) with how many bins have them; every piece is in one bin."""
    fixed, left = reduce_by_dominance(histogram, capacity)
    return fixed + best_fit(left, capacity)


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, pieces of this length a bin, offset in the bin of the first of them)."""
    out, ranks, first = [], {}, 0
    for pattern, n in patterns:
        offset = 0
        for x in dict.fromkeys(pattern):
            per = pattern.count(x)
            out.append((x, ranks.get(x, 0), n * per, first, per, offset))
            ranks[x] = ranks.get(x, 0) + n * per
            offset += per * x
        first += n
    return out


def assign(pieces: DataFrame, capacity: int = 2048, rows_per_bucket: int = 20_000) -> DataFrame:
    """pieces (doc_id, piece, length, …), a table that is stable when read again, with sequence_id and offset."""
    spark = pieces.sparkSession
    salted = pieces.withColumn("_hash", F.xxhash64(*[c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]))
    n = pieces.count()
    buckets = max(16, -(-n // rows_per_bucket))
    salted = salted.withColumn("_bucket", F.pmod("_hash", F.lit(buckets)).cast("int"))
    counts = salted.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n"))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    slots = _slots(reduce_and_fit(histogram, capacity))
    names = ("length", "_first", "_ranks", "_sequence", "_per", "_at")
    columns = np.array(slots or [(0, 0, 0, 0, 1, 0)], np.int64).T
    slots = spark.createDataFrame(pa.table(dict(zip(names, map(pa.array, columns), strict=True))))  # a local table, which takes no Python worker
    by_length = slots.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("_first", "_ranks", "_sequence", "_per", "_at"))).alias("_slots"))
    ranked = (
        salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_hash", "doc_id", "piece")) - 1)
        .join(counts.drop("_n"), ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    )
    # The solver makes at most a few thousand patterns, so the slots are a bounded table.
    placed = ranked.join(F.broadcast(by_length), "length").withColumn("_s", F.element_at(F.filter("_slots", lambda s: s["_first"] <= F.col("_rank")), -1))
    inside = F.col("_rank") - F.col("_s._first")
    return placed.withColumns({"sequence_id": F.col("_s._sequence") + F.floor(inside / F.col("_s._per")), "offset": F.col("_s._at") + inside % F.col("_s._per") * F.col("length")}).select(*pieces.columns, "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for)."""
    pieces = shared_table(tokenise(docs, tokenizer_path, id_col, text_col, capacity, with_ids=with_ids), "pieces")
    return assign(pieces, capacity)
