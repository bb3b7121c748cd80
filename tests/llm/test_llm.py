"""The operators of sylva.llm on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest

from sylva.llm import bloom, components, decontaminate, exact_dedup, near_dedup, packing, preference, quality, revisit, secret_scan, suffix_dedup, url_filter

DOCS = "doc_id long, text string"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def words(seed, n, size=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def crowded(spark, rows):
    """docs with columns whose names the operators use inside."""
    d = docs(spark, rows)
    for c in ("row", "id", "sha", "possible", "n", "keep_id", "h", "a", "b", "key", "rep", "c", "m", "score", "s", "e", "g", "d", "length", "_hash", "sequence_id", "component", "t", "blob"):
        d = d.selectExpr("*", f"'x' as {c}")
    return d


# Bloom filters and components


def test_filters_have_no_false_negatives(spark):
    h = spark.range(5000).selectExpr("xxhash64(id) as h")
    for n in (None, 10_000_000):  # by one task, and merged
        data, bits = bloom.key_filter(h, n=n, max_bits=1 << 18)
        at = bloom.positions(np.array([r.h for r in h.collect()]), bits)
        assert bloom.contained(np.frombuffer(data, np.uint8), at).all()
    twice = h.where("h % 10 = 0").unionByName(h)
    data, bits = bloom.repeated_filter(twice.repartition(4), n=10_000_000, max_bits=1 << 18)
    at = bloom.positions(np.array([r.h for r in h.where("h % 10 = 0").collect()]), bits)
    assert bloom.contained(np.frombuffer(data, np.uint8), at).all()


@pytest.mark.parametrize("local", [0, 1000])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL", local)
    edges = [(i, i + 1) for i in range(20)] + [(100, 105), (103, 105), (7, 7), (5, 4)]
    got = {r.id: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 105: 100, 103: 100}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def test_url_filter(spark):
    urls = ["http://A.example.NET/en/x?y", "https://example.net/de/", "x://org", "x://a.org/fr/1#z", "mailto:a@b", None, "http://example.com/de/", "http://example.com/de", "http://notexample.com/de/", "http://net", "http://net/", "", "a://b://c/d"]
    pages = docs(spark, [(i, u) for i, u in enumerate(urls)] + [(None, urls[0]), (0, urls[0])], "page_id long, url string")
    rules = spark.createDataFrame([*url_filter.RULES, url_filter.RULES[0], (None, "/", "block")], "host string, path string, verdict string")
    for inline, limit in ((1 << 18, 0), (0, 32 << 20), (0, 0)):
        got = sorted(map(tuple, url_filter.judge(pages, rules, max_inline_bytes=inline, max_broadcast_bytes=limit).collect()), key=repr)
        by_id = {r[0]: r[1:] for r in got if r[0] is not None}
        assert by_id[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
        assert by_id[1] == ("example.net", "/de/", "net/", "block")
        assert by_id[2] == ("org", "", None, "allow")
        assert by_id[3] == ("a.org", "/fr/1", "org/fr/", "allow")
        assert by_id[4] == by_id[5] == by_id[11] == ("", "", None, "allow")
        assert by_id[6] == ("example.com", "/de/", "example.com/de/", "block")
        assert by_id[7][2] is None and by_id[8][2] is None and by_id[9][2] is None
        assert by_id[10] == ("net", "/", "net/", "block")
        assert len(got) == len(urls) + 2
    assert url_filter.judge(pages, rules.where("false")).where("rule is not null").count() == 0
    assert url_filter.judge(pages.where("false"), rules).count() == 0


@pytest.mark.parametrize("limit", [1 << 18, 0])
def test_url_filter_with_many_rules(spark, limit):
    r = random.Random(3)
    hosts = [f"{'abc'[r.randrange(3)]}.s{r.randrange(40)}.org" for _ in range(400)]
    urls = [f"http://{h}/" + "/".join(f"p{r.randrange(3)}" for _ in range(r.randrange(4))) for h in hosts] + ["http://a.s1.org/" + "x" * 100_000] + ["http://hot.s3.org/"] * 300
    listed = {(u.split("/")[2][r.choice((0, 2)):], "/" + "/".join(u.split("/")[3:][: r.randrange(3)])): r.choice(("allow", "block")) for u in urls[:80]}
    pages = docs(spark, list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' as host", "'x' as path", "'x' as block", "1 as size", "'x' as rule")
    rules = spark.createDataFrame([(*k, v) for k, v in listed.items()], "host string, path string, verdict string")

    def brute(url):
        host, path = url.split("/")[2], "/" + "/".join(url.split("/")[3:])
        fits = [(len(h + p), v == "block", h, p, v) for (h, p), v in listed.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (max(fits)[2] + max(fits)[3], max(fits)[4]) if fits else (None, "allow")

    got = {x.page_id: (x.rule, x.verdict) for x in url_filter.judge(pages, rules, max_inline_bytes=limit).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}


# 2


def labelled(spark):
    good = [(i, words(i, 120)) for i in range(0, 300)]
    bad = [(i, " ".join(w.upper() + "!!" for w in words(i, 100).split())) for i in range(300, 600)]
    d = docs(spark, good + bad)
    return d, spark.createDataFrame([(i, int(i < 300)) for i in range(600)] + [(None, 1), (3, None)], "doc_id long, quality int")


def test_quality_holds_out_and_separates(spark):
    d, labels = labelled(spark)
    model = quality.fit(d, labels)
    rows = quality.score(d, model).collect()
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(600)}
    held = [r for r in rows if r.held_out]
    assert sum((r.predicted == 1) == (r.doc_id < 300) for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    changed = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    again = quality.fit(d, changed)
    assert (again.good, again.slope, again.share) == (model.good, model.slope, model.share)  # held-out labels change nothing
    odd = quality.score(crowded(spark, [(1, None), (2, ""), (None, "x" * 100_000), (2, "")]), model).collect()
    assert len(odd) == 4 and {r.score for r in odd if r.doc_id in (1, 2)} == {model.share}
    many = quality.fit(d.unionByName(spark.range(2000).selectExpr("1L as doc_id", "concat('zzz', id) as text")), labels)
    assert (many.good, many.bad, many.slope) == (model.good, model.bad, model.slope)  # an id of many rows counts once, with its least text
    kept = quality.keep_good(crowded(spark, [(1, words(1, 100)), (400, "A!! " * 300)]), model)
    assert [r.doc_id for r in kept.collect()] == [1] and kept.columns[2] == "row"


def test_quality_without_labels(spark):
    d = docs(spark, [(1, "a")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(d, quality.fit(d, none)).collect()] == [1.0]
    assert quality.score(d.where("false"), quality.fit(d, none)).count() == 0


# 3


def plain_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = ["", None, "a", words(1, 5000), "it's I'M Ünï ΣΑΣ İ", "a\tb\x85c\xa0d", "<|endoftext|>x", "日本 语"] + [words(i, i * 7) for i in range(60)] + ["same text"] * 40
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, ""), (None, "n")]
    got = packing.pack(crowded(spark, rows), TOKENIZER, with_ids=True).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    by_doc: dict = {}
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    for i, t in enumerate(texts):
        pieces = sorted(by_doc[i])[:: 2 if i == 0 else 1]
        assert sum((p[2] for p in pieces), []) == plain_ids(tokenizer, t), t
        assert all(len(p[2]) == 2048 for p in pieces[:-1])
    bins: dict = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack(docs(spark, []), TOKENIZER).count() == 0


def fewest(lengths, capacity):
    """By exhaustive search."""
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


def test_decontamination_blocks_are_bounded():
    r = random.Random(2)
    for _ in range(200):
        item = [b"w" * r.randint(1, 9) for _ in range(r.randint(0, 60))]
        n, most, most_bytes = r.randint(1, 6), r.randint(1, 12), r.randint(1, 50)
        parts = list(decontaminate._parts(item, n, most, most_bytes))
        assert all(len(x) <= max(n, most) and (len(x) <= n or sum(map(len, x)) <= most_bytes) for x in parts)
        windows = lambda x: [tuple(x[i : i + n]) for i in range(max(1, len(x) - n + 1))] if x else []
        assert [w for x in parts for w in windows(x)] == windows(item)


def test_reduction_only_fixes_what_dominates():
    r = random.Random(6)
    for _ in range(200):
        capacity = r.choice([10, 20, 50])
        lengths = sorted((r.randint(1, capacity) for _ in range(r.randint(0, 9))), reverse=True)
        fixed, left = packing.reduce_by_dominance({x: lengths.count(x) for x in lengths}, capacity)
        rest = sorted((x for x, n in left.items() for _ in range(n)), reverse=True)
        assert sum(n for _, n in fixed) + fewest(rest, capacity) == fewest(lengths, capacity)


def test_reduction_fixes_a_good_share():
    r = random.Random(7)
    histogram: dict[int, int] = {}
    for _ in range(100_000):
        x = min(2048, int(r.lognormvariate(5, 1.2)) + 1)
        histogram[x] = histogram.get(x, 0) + 1
    fixed, left = packing.reduce_by_dominance(dict(histogram), 2048)
    below = [x for x, n in histogram.items() for _ in range(n) if x > 1024]
    assert sum(n for x, n in left.items() if x > 1024) < 0.5 * len(below)  # most larger pieces have found a partner
    together = sum(n for _, n in fixed) + sum(n for _, n in packing.best_fit(left, 2048))
    assert together <= sum(n for _, n in packing.best_fit(histogram, 2048))
    assert sum(n for _, n in packing.reduce_and_fit({5: 10**9, 2: 10**9, 4: 10**9}, 10)) > 0  # counts cost nothing


def test_patterns_hold_all_pieces_and_are_few():
    r = random.Random(4)
    for _ in range(150):
        capacity = r.choice([10, 20, 50])
        lengths = sorted((r.randint(1, capacity) for _ in range(r.randint(0, 9))), reverse=True)
        histogram = {x: lengths.count(x) for x in lengths}
        patterns = packing.reduce_and_fit(dict(histogram), capacity)
        held = sorted(itertools.chain.from_iterable(p * n for p, n in patterns), reverse=True)
        assert held == lengths and all(sum(p) <= capacity and n > 0 for p, n in patterns)
        assert sum(n for _, n in patterns) <= fewest(lengths, capacity) + 1
    many = packing.reduce_and_fit({x: 1_000_000 + x for x in range(1, 2049)}, 2048)
    assert len(many) < 20_000
    assert sum(n for _, n in many) <= 1.001 * -(-sum(x * (1_000_000 + x) for x in range(1, 2049)) // 2048)


# 4


def test_preference_pairs(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yo"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", None),
        (2, 0, "user", "x"), (4, 0, None, "same"), (5, 0, None, "same"), (None, 0, "user", "lost"), (7, 1, "assistant", "b"), (7, 1, "assistant", "a"),
    ]
    t = docs(spark, rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as chosen", "2 as t", "3 as side")
    got = {r.pair_id: r for r in preference.format_pairs(preference.neighbours_as_pairs(t)).collect()}
    assert set(got) == {0, 1, 2, 3}
    a = got[0]
    assert (a.n_common, a.prompt) == (1, "<|user|>\nhi<|end|>\n")
    assert a.chosen == "<|assistant|>\nyo<|end|>\n" and a.rejected == "<|assistant|>\nno<|end|>\n<|user|>\n<|end|>\n"
    assert [a.chosen[int(s) : int(e)] for s, e in [a.chosen_mask.split(":")]] == ["yo<|end|>\n"]
    assert got[1].rejected is None and got[1].n_common == 0 and got[1].chosen.endswith("x<|end|>\n") and got[1].chosen_mask == ""
    assert (got[2].n_common, got[2].chosen, got[2].rejected) == (1, "", "")
    assert got[3].chosen is None and got[3].rejected.index("a<|end|>") < got[3].rejected.index("b<|end|>")
    assert preference.format_pairs(preference.neighbours_as_pairs(t.where("false"))).count() == 0


# 5


def test_revisits(spark):
    schema = "record_id long, url string, ts long, status int, headers map<string,string>, payload_sha256 string"
    rows = [
        (1, "http://www.A.com/x/?utm_source=q&b=2&a=1#f", 10, 200, {"etag": "e1", "content-length": "5", "date": "d1"}, "p1"), (2, "https://a.com/x?a=1&b=2", 20, 200, {"etag": "e2"}, "p2"),
        (3, "a.com:80/x?a=1&b=2", 15, 304, {"etag": "W/e1", "date": "d2", "content-length": "0", "x": "y"}, None), (4, "http://a.com/x?a=1&b=2", 25, 304, {"etag": "e1"}, None), (5, "http://a.com/x?a=1&b=2", 20, 304, {"etag": "e1"}, None),
        (6, "http://a.com/y", 99, 304, {}, None), (7, None, 99, 304, None, None), (8, "http://a.com/x?a=1&b=2", 9000, 304, {}, None), (9, "http://a.com/x?a=1&b=2", None, 304, {}, None), (10, "http://a.com/x?a=1&b=2", 26, 404, {}, None),
        (11, "http://a.com/x?a=1&b=2", 30, 304, {"last-modified": "m"}, None),
    ]
    for width in (4096, 4):
        got = {r.record_id: r for r in revisit.resolve(spark.createDataFrame(rows, schema).selectExpr("*", "1 as bucket", "2 as full"), width).collect()}
        assert {k: (r.outcome, r.response_id) for k, r in got.items()} == {3: ("resolved", 1), 4: ("mismatch", 2), 5: ("resolved", 1), 6: ("no_response", None), 7: ("no_response", None), 8: ("resolved", 2), 11: ("mismatch", 2)}
        assert got[3].headers == {"etag": "W/e1", "content-length": "5", "date": "d2", "x": "y"} and got[3].payload_sha256 == "p1"
        assert got[8].headers == {"etag": "e2"}
    assert revisit.resolve(spark.createDataFrame([], schema)).count() == 0


# 6


def brute_hits(text, items, n=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    w, hit, found = split(text), set(), set()
    for name, t in items:
        own = split(t)
        for i in range(max(1, len(own) - n + 1) if own else 0):
            g = own[i : i + n]
            for j in range(len(w) - len(g) + 1):
                if w[j : j + len(g)] == g:
                    hit.update(range(j, j + len(g)))
                    found.add(name)
    return len(w), len(hit), sorted(str(x) for x in found if x is not None)


@pytest.mark.parametrize("block_words", [1_000_000, 12, 5])
def test_decontamination(spark, block_words):
    items = [(7, words(11, 25).replace(" ", "\n")), (8, words(8, 400).replace(" ", ",")), (1, words(1, 30)), (2, words(2, 12)), (3, "Short One"), (4, ""), (5, None), (None, words(3, 15)), (2, words(4, 12)), (6, words(1, 30))]
    rows = [(1, words(1, 30)), (2, "x " + words(1, 30).upper() + ", y"), (3, words(2, 9)), (4, "SHORT, one! " * 3), (5, None), (6, ""), (7, words(3, 15) + "é"), (8, "-".join(words(3, 15).split())), (9, words(9, 20_000) + " " + words(2, 12)), (9, "clean"), (None, words(4, 12)), (10, words(11, 25) + " and " + words(8, 400))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id, r.n_words, r.n_hit, r.items, r.items_sha256, r.contaminated) for r in decontaminate.report(crowded(spark, rows), bench, block_words=block_words).collect())
    want = []
    for i, t in rows:
        n, hit, found = brute_hits(t, items)
        want.append((i is None, i, n, hit, found, hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
    assert got == sorted(want)
    cleaned = {r.doc_id: r.text for r in decontaminate.clean(crowded(spark, rows[:7]), bench, block_words=block_words).collect()}
    assert set(cleaned) == {3, 5, 6} and cleaned[5] is None
    cut = decontaminate.clean(spark.createDataFrame([(1, "Keep this, please: " + words(9, 40) + " | " + words(2, 12) + " | End.", 7)], DOCS + ", n_chars long"), bench, length_col="n_chars").first()
    assert cut.text == "Keep this, please: " + words(9, 40) + " |  | End." and cut.n_chars == len(cut.text)
    assert decontaminate.report(docs(spark, rows), bench.where("false")).where("contaminated").count() == 0


# 7


def brute_repeats(texts, length):
    data, at = [(t or "").encode() for t in texts], {}
    for i, b in enumerate(data):
        for j in range(len(b) - length + 1):
            at.setdefault(b[j : j + length], []).append((i, j))
    out = []
    for i, b in enumerate(data):
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if len(at[b[j : j + length]]) > 1:
                gone[j : j + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone].tobytes())).hexdigest()))
    return out


@pytest.mark.parametrize(("most", "max_bits"), [(20_000, 1 << 28), (1, 1 << 28), (4, 1 << 11)])
def test_repeated_substrings(spark, most, max_bits):
    shared = words(1, 90)
    texts = [shared, "head é " + shared, shared[:250] + words(2, 60), words(3, 50) + shared[100:330] + words(4, 50), "ab" * 300, "xyz " * 120, None, "", "short", words(5, 100), words(5, 100), words(6, 3000)]
    texts += [words(10 + i, 30) + shared[40 + i : 320] + words(60 + i, 30) for i in range(25)] + [shared[:199], shared[7:206]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, words(7, 80)), (9, words(5, 100))]
    got = suffix_dedup.report(crowded(spark, rows).repartition(5), most=most, max_bits=max_bits).collect()
    have = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    want = sorted((i is None, i, *x) for (i, _), x in zip(rows, brute_repeats([t for _, t in rows], 200), strict=True))
    assert have == want
    assert suffix_dedup.report(docs(spark, [])).count() == 0


def test_column_ranges():
    for columns in (1, 2, 153):
        for level in range(9):
            ranges = suffix_dedup.column_ranges(columns, level)
            assert [x for a, b in ranges for x in range(a, b)] == list(range(columns))
    assert all(b - a == 1 for a, b in suffix_dedup.column_ranges(153, 8))


def test_long_texts_in_parts(monkeypatch):
    text, out = words(1, 4000).encode(), {}
    for most in (1000, 1 << 20):
        found = []
        for parts, data, ends, (start, count, place, h) in suffix_dedup.runs_of([text, b"x", text[50:900]], 200, 48, most):
            begins = np.concatenate(([0], ends))
            for s, c, p, a in zip(start.tolist(), count.tolist(), place.tolist(), h.tolist(), strict=True):
                k = int(np.searchsorted(ends, s, side="right"))
                found += [(parts[k][0], parts[k][1] + s - int(begins[k]) + j, a, p - s - j) for j in range(c)]
        out[most] = sorted(found)
        assert len(found) == len(set(found)) == len(text) - 199 + 850 - 199
    assert out[1000] == out[1 << 20]


def test_a_long_text_that_repeats_itself(spark):
    r = random.Random(3)
    fresh = lambda n: bytes(r.randrange(97, 123) for _ in range(n)).decode()
    passage = fresh(5000)
    far = fresh(10_000) + passage + fresh(485_000) + passage + fresh(95_000)  # the two are in different parts
    near = fresh(1000) + passage[2000:2300] + fresh(1000)  # its segments are of the same groups
    for rows, want in (([(1, far)], {1: (10_000, 2)}), ([(1, far), (2, near)], {1: (10_000, 2), 2: (300, 1)})):
        for most in (20_000, 1):
            got = suffix_dedup.report(docs(spark, rows), most=most).collect()
            assert {x.doc_id: (x.n_removed, x.n_spans) for x in got} == want


def test_columns_find_equal_strings(tmp_path):
    r = random.Random(2)
    length, gram, before = 8, 3, 5
    for _ in range(60):
        segments, leads = [], []
        for _ in range(r.randint(1, 12)):
            lead, run = r.randint(0, before), 1
            run = r.randint(1, lead + 1)
            segments.append(bytes(r.choices(b"ab", k=run - 1 + length)))
            leads.append(lead)
        found = suffix_dedup.column_rounds(segments, leads, str(tmp_path), length, gram)
        strings = {}
        for i, (s, lead) in enumerate(zip(segments, leads, strict=True)):
            for j in range(len(s) - length + 1):
                strings.setdefault((before - lead + j, s[j : j + length]), []).append(i)
        want = np.zeros_like(found)
        for (t, _), own in strings.items():
            if len(own) > 1:
                want[own, t] = True
        assert (found == want).all()


# 8


def test_exact_dedup(spark):
    rows = [(1, "a"), (2, "a"), (3, "A"), (4, None), (5, ""), (6, "x" * 200_000), (7, "x" * 200_000), (7, "x" * 200_000), (None, "a"), (None, "lone")]
    rows += [(100 + i, "hot") for i in range(500)] + [(1000 + i, f"t{i}") for i in range(500)]
    got = exact_dedup.find_duplicates(crowded(spark, rows).repartition(4)).collect()
    by: dict = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    want = []
    for i, t in rows:
        ids = [x for x in by[t or ""] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, keep, len(by[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    kept = exact_dedup.drop_duplicates(crowded(spark, rows).repartition(4))
    assert kept.columns == crowded(spark, rows[:1]).columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted(by)
    assert {r.doc_id for r in kept.collect()} == {max((x for x in v if x is not None), default=None) for v in by.values()}
    assert exact_dedup.find_duplicates(docs(spark, [])).count() == 0 and exact_dedup.drop_duplicates(docs(spark, [])).count() == 0
    for bits in (1, 16):  # a dense filter, and slices
        assert sorted(map(tuple, exact_dedup.find_duplicates(docs(spark, rows), max_bits=1 << 12, bits_per_row=bits).collect()), key=repr) == sorted(want, key=repr)
    assert sorted(map(repr, exact_dedup.drop_duplicates(docs(spark, rows), max_bits=1 << 12).collect())) == sorted(map(repr, kept.select("doc_id", "text").collect()))


def test_filters_stay_sparse_as_tables_grow(spark):
    """With a small bound on the filter's bits, the share of rows that are possibly repeated does not grow with the table."""
    shares = []
    for n in (1000, 8000):
        base = spark.range(n).selectExpr("id as doc_id", "cast(id as string) as sha", "xxhash64(id) as possible")
        shares.append(exact_dedup._marked(base, n, 16, 1 << 13).where("possible").count() / n)
    assert max(shares) < 0.03


# 9


def brute_spans(text):
    out = []
    for rank, (kind, pattern, group, least) in enumerate([("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return [s for _, _, s in sorted(out)]


def test_secret_scan(spark):
    h = "0123456789abcdef" * 2
    texts = [f"é𝄞 token = '{h}' x", "PassWord:abc password=abcdef", "secret: \"token\" : abcdefgh", "AKIA" + "A" * 16 + " AKIAAKIA", f"{h}g{h[:23]}", None, "", "api_key=a token=b secret=cccccc", "ſecret=abcdefgh toKen=abcdefgh", "x" * 300_000 + f" passwd=\"{h}", "token=" + h + "\n" + h]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0])]
    report, found, ledger = secret_scan.scan(crowded(spark, rows))
    got = secret_scan.digest(report).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute_spans(texts[r.doc_id or 0])
        assert r.spans == ",".join(want) and r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex"))
    more = docs(spark, [*rows, (50, "token=zzzzzzzz")])
    second, found2, ledger2 = secret_scan.scan(more, ledger=ledger, known=found)
    assert ledger2.count() == ledger.count() + 1 == len({t or "" for t in texts}) + 1
    assert {r.doc_id: r.spans for r in secret_scan.digest(second).collect()} == {**{r.doc_id: r.spans for r in got}, 50: "assign:0:14"}
    blind = secret_scan.scan(more, ledger=ledger2, known=found2.where("false"))[0]
    assert secret_scan.digest(blind).where("spans <> ''").count() == 0  # nothing is scanned twice
    assert secret_scan.scan(docs(spark, []))[0].count() == 0


def test_secret_scan_evaluates_rules_above_the_ledger_join_only(spark):
    texts = docs(spark, [(1, "token=abcdefgh")]).selectExpr("unhex(sha2(text, 256)) as b", "text")
    unseen = texts.selectExpr("b as blob")
    found = secret_scan.spans_by_blob(texts.join(unseen, texts["b"] == unseen["blob"]).select("blob", "text"), secret_scan.RULES)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = min(i for i, line in enumerate(plan) if "Join" in line)
    assert any("AKIA" in line for line in plan[:join]) and not any("AKIA" in line for line in plan[join:])


def test_secret_scan_moves_possibly_repeated_or_seen_texts_only(spark):
    rows = [(i, f"text {i} token=abcdef{i}") for i in range(4000)] + [(9000 + i, f"text {i} token=abcdef{i}") for i in range(20)] + [(1, "text 1 token=abcdef1")]
    texts = docs(spark, rows).selectExpr("unhex(sha2(text, 256)) as blob", "text")
    counted = texts.groupBy("blob").count().withColumnRenamed("count", "size")
    seen = docs(spark, rows[30:40]).selectExpr("unhex(sha2(text, 256)) as blob")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        alone, others = secret_scan.parted(texts, counted, seen, 1 << 20)
        plan = alone._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    moved = {r.text for r in others.collect()}
    assert alone.count() + others.count() == len(rows) and {t for _, t in rows[:20] + rows[30:40]} <= moved and len(moved) < 60
    # A filter that is full lets more texts through and changes nothing.
    wide, tight = (secret_scan.digest(secret_scan.scan(docs(spark, rows), max_filter_bytes=n)[0]) for n in (32 << 20, 1))
    assert wide.count() == len(rows) and wide.exceptAll(tight).count() == tight.exceptAll(wide).count() == 0
    assert wide.where("n_assign = 1").count() == len(rows)


def test_secret_scan_of_many_matches_in_one_text(spark):
    text = "0123456789abcdef0123456789 " * 200_000
    began = time.time()
    row = secret_scan.digest(secret_scan.scan(docs(spark, [(1, text)]))[0]).first()
    assert row.n_hex == 200_000 and row.spans.endswith(f"hex:{27 * 199_999}:{27 * 199_999 + 26}")
    assert time.time() - began < 60  # a quadratic fold would take hours


# 10


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_near_dedup(spark):
    r = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One  TWO"), (5, "one two three"), (6, words(1, 30_000)), (7, words(1, 30_000) + " end")]
    for group in range(12):
        base = words(100 + group, 120, 10_000).split()
        for k in range(r.randint(1, 25)):
            own = list(base)
            for _ in range(r.randint(0, 7)):
                own[r.randrange(120)] = f"x{r.randrange(10**6)}"
            rows.append((1000 * (group + 1) + k, " ".join(own)))
    rows += [(50_000 + i, words(1, 60) + " " + words(9000 + i, 100)) for i in range(40)]  # a passage in common, no more
    got = near_dedup.find_groups(crowded(spark, rows).repartition(4)).collect()
    want = brute_groups(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got} == want
    kept = near_dedup.drop_near_duplicates(crowded(spark, rows))
    assert {x.doc_id for x in kept.collect()} == {i for i, (_, _, k) in want.items() if k}
    assert kept.columns == crowded(spark, rows[:1]).columns
    odd = near_dedup.find_groups(docs(spark, [(None, "a b c d e f"), (7, "a b c d e f"), (None, "q"), (3, "r"), (3, "r")])).collect()
    assert sorted(((x.doc_id, x.component_id, x.kept) for x in odd), key=repr) == sorted([(None, 7, False), (7, 7, True), (None, None, True), (3, 3, True), (3, 3, True)], key=repr)
    assert near_dedup.find_groups(docs(spark, [])).count() == 0


def test_near_dedup_goes_on_while_buckets_are_mixed(spark, monkeypatch):
    base, other = words(1, 120, 10_000), words(2, 120, 10_000)
    rows = [(1, words(3, 120, 10_000)), (2, base), (3, base + " end"), (10, other), (11, other + " end")]
    # Where 2 and 3 meet, 1 leads; 10 and 11 link, so there is a second round, in which all pairs with a leader are tested.
    keys = [(100, 1), (100, 2), (100, 3), (200, 10), (200, 11)]
    monkeypatch.setattr(near_dedup, "_table_keys", lambda sub, tables: spark.createDataFrame(keys, "key long, rep long"))
    got = {x.doc_id: x.component_id for x in near_dedup.find_groups(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 10: 10, 11: 10}


def test_near_dedup_drops_rows_not_ids(spark):
    x, y, z = words(1, 40), words(2, 40), words(3, 40)
    for rows, want in (
        ([(3, x), (5, x), (5, y), (9, y)], [(3, x), (5, y)]),
        ([(3, x), (3, x), (3, "  " + x)], None),
        ([(5, y), (5, z), (6, z + " end")], [(5, y), (5, z)]),
        ([(None, x), (7, x), (None, y), (None, y), (None, z)], [(7, x), (None, y), (None, z)]),
        ([(1, ""), (1, ""), (2, None), (2, None)], [(1, ""), (1, ""), (2, None), (2, None)]),
    ):
        got = [tuple(r) for r in near_dedup.drop_near_duplicates(docs(spark, rows)).collect()]
        if want is None:
            assert len(got) == 1 and got[0] in rows
        else:
            assert sorted(got, key=repr) == sorted(want, key=repr)


def test_near_dedup_links_what_a_leader_stands_between(spark):
    r = random.Random(24)
    w = [f"w{r.randrange(10**8)}" for _ in range(1000)]
    clean = [f"c{r.randrange(10**8)}" for _ in range(400)]
    rows = [(10, " ".join(w)), (11, " ".join(w[:748])), (12, " ".join(w[106:854])), (1, " ".join(clean)), (2, " ".join(clean[:-1] + ["last"]))]
    want = brute_groups(rows)
    assert {x.doc_id: x.component_id for x in near_dedup.find_groups(docs(spark, rows)).collect()} == {i: c for i, (_, c, _) in want.items()}


def test_near_dedup_in_a_large_group_forms_few_pairs(spark, monkeypatch):
    """Edited copies of one text: most are too far from each other, some are near copies of an edited one; no link is lost, and pairs stay few."""
    r, base = random.Random(8), words(77, 150, 100_000).split()
    rows = [(0, " ".join(base))]
    for k in range(1, 300):
        own = list(base) if k % 10 else rows[-1][1].split()
        for _ in range(r.randint(3, 14) if k % 10 else 1):
            own[r.randrange(150)] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    formed = []
    plain = near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, n, *rest: formed.append(n) or plain(pairs, n, *rest))
    got = {x.doc_id: x.component_id for x in near_dedup.find_groups(docs(spark, rows)).collect()}
    assert got == {i: c for i, (_, c, _) in brute_groups(rows).items()}
    assert sum(formed) < 5 * len(rows)


def test_near_dedup_of_copies_that_are_mostly_too_far_apart(spark, monkeypatch):
    """Copies of a text that isn't among them, each with 4 of 200 words edited: a pair in a hundred is a link, and few of the others are tested."""
    n, r = 400, random.Random(400)
    base = [f"w{r.randrange(10**8)}" for _ in range(200)]
    rows = []
    for k in range(n):
        own = list(base)
        for i in r.sample(range(200), 4):
            own[i] = f"x{r.randrange(10**9)}"
        rows.append((k, " ".join(own)))
    formed = []
    plain = near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, n, *rest: formed.append(n) or plain(pairs, n, *rest))
    got = {x.doc_id: x.component_id for x in near_dedup.find_groups(docs(spark, rows)).collect()}
    assert got == {i: c for i, (_, c, _) in brute_groups(rows).items()}
    assert sum(formed) < n * (n - 1) / 2 / 5
