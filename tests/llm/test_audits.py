"""Language identification, whitening and the audit of filters, against brute force, finite differences and held-out rows."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sylva.llm import filter_audit, language, whitening


def crowded(df):
    """df with columns whose names the operators use inside."""
    have = set(df.columns)
    for c in ("h", "held", "part", "mask", "sha", "n", "x", "v", "d", "at", "upto", "lang", "component", "deviation", "whitened", "good", "rows", "first", "score", "held_out"):
        if c not in have:
            df = df.selectExpr("*", f"'x' as {c}")
    return df


# 11

SYLLABLES = {"aa": "ba ke li mo nu ta", "bb": "sch ung eit ver ich", "cc": "ção lhe ões não"}


def prose(lang, seed, words=60):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choices(SYLLABLES[lang].split(), k=r.randint(1, 4))) for _ in range(words))


def spoken(spark, n=240):
    rows = [(i, prose(lang, i), lang) for i in range(n) for lang in [list(SYLLABLES)[i % 3]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_gradients_are_those_of_finite_differences():
    rng = np.random.default_rng(1)
    net = language.Network.new(3, 2, rng, np.float64)
    net.bias += 0.1
    windows = rng.integers(60, 64, (5, 7)).astype(np.uint8)
    used = np.arange(7) < np.array([7, 7, 4, 1, 6])[:, None]
    target = np.array([0, 1, 1, 0, 1])
    _, gradients = language.loss_and_gradients(net, windows, used, target)
    for part, gradient in zip(net.parts, gradients, strict=True):
        places = list(zip(*np.nonzero(gradient), strict=True))
        for at in [places[i] for i in rng.choice(len(places), min(12, len(places)), replace=False)]:
            held, losses = part[at], []
            for step in (1e-5, -1e-5):
                part[at] = held + step
                losses.append(language.loss_and_gradients(net, windows, used, target)[0])
            part[at] = held
            assert math.isclose((losses[0] - losses[1]) / 2e-5, gradient[at], rel_tol=1e-4, abs_tol=1e-8)


def test_pooling_is_the_mean_over_all_positions():
    """Against a plain pass over one window after the other, unit by unit."""
    net = language.Network.new(4, 3, np.random.default_rng(2), np.float64)

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    def states(data, way):
        h, out = np.zeros(4), []
        for byte in data:
            x, g = net.inputs[way, byte], h @ net.states[way]
            reset, update = sigmoid(x[:4] + g[:4]), sigmoid(x[4:8] + g[4:8])
            candidate = np.tanh(x[8:] + reset * (g[8:] + net.bias[way, 0]))
            h = update * h + (1 - update) * candidate
            out.append(h)
        return out

    def brute(text, window):
        p = []
        for start in range(0, len(text), window):
            data = text[start : start + window].ljust(window, b"\0")
            left, right = states(data, 0), states(data[::-1], 1)[::-1]
            for t in range(min(window, len(text) - start)):
                e = np.exp(left[t] @ net.out[0] + right[t] @ net.out[1] + net.base)
                p.append(e / e.sum())
        return np.mean(p, axis=0)

    texts = [bytes(random.Random(n).randbytes(n)) for n in (1, 7, 8, 9, 100, 33)]
    for at_once in (1, 3, 1000):  # a text may be spread over several lots, a lot may hold several texts
        got = language.pooled(net, texts, 8, at_once)
        assert np.allclose(got, [brute(t, 8) for t in texts], atol=1e-12)


@pytest.fixture(scope="module")
def learned(spark):
    return language.fit(spoken(spark), rounds=120)


def test_language_of_held_out_texts(spark, learned):
    docs = spoken(spark)
    rows = language.predict(docs, learned).collect()
    assert learned.languages == sorted(SYLLABLES)
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(240)}
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang_pred == list(SYLLABLES)[r.doc_id % 3] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_learns_nothing_from_held_out_rows_or_other_columns(spark, learned):
    held = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"
    changed = crowded(spoken(spark).selectExpr("doc_id", f"if({held}, 'zzz', text) as text", f"if({held}, 'other', lang) as lang", "'s' as source"))
    again = language.fit(changed, rounds=120)
    assert again.languages == learned.languages
    assert all(np.allclose(a, b, atol=1e-3) for a, b in zip(again.network.parts, learned.network.parts, strict=True))


def test_language_of_odd_texts(spark, learned):
    long = prose("bb", 1, 40_000)
    rows = [(1, None), (2, ""), (3, "12 !? 3"), (None, "ver ich schung"), (4, long), (4, long), (5, "é"), (6, "1" * 100_000 + "ß")]
    got = language.predict(crowded(spark.createDataFrame(rows, "doc_id long, text string")), learned).collect()
    assert len(got) == len(rows)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (1, 2, 3))
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    assert [r.lang_pred for r in got if r.doc_id == 4] == ["bb", "bb"]
    assert all(r.lang_pred in SYLLABLES for r in got if r.doc_id in (5, 6))


def test_language_without_anything_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, None, "xx"), (3, "77", "xx")], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert {(r.lang_pred, r.score) for r in language.predict(docs, model).collect()} == {("und", 0.0)}
    assert language.predict(docs.where("false"), language.fit(docs.where("false"))).count() == 0
    one = language.fit(spark.createDataFrame([(i, "a b", "xx") for i in range(9)], docs.schema), rounds=2)
    assert [r.lang_pred for r in language.predict(docs.where("doc_id = 1"), one).collect()] == ["xx"]


def test_language_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "train", lambda inputs, used, target, languages: seen.append(Counter(target.tolist())))
    many = spoken(spark).unionByName(spark.range(3000).selectExpr("1L as doc_id", "concat('taba ', id) as text", "'bb' as lang"))
    language.fit(many, sample=10, spots=2)
    assert all(n <= 20 for n in seen[0].values()) and len(seen[0]) == 3


# 12


def brute_whitening(vectors, most=32):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors])
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return [int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True))) for row in x], centred @ v / np.sqrt(np.maximum(e, 1e-300)), e / e.sum()


@pytest.mark.parametrize("pairs", [4096, 7])
def test_whitening_is_that_of_lapack(spark, pairs):
    rng = np.random.default_rng(3)
    data = (rng.standard_normal((300, 6)) @ rng.standard_normal((6, 6)) * [9, 1, 4, 1, 1, 1] + [0, 5, 0, 0, -3, 0]).astype(np.float32)
    data[7:12] = data[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>").repartition(5)
    table, d = whitening.whole(df)
    model = whitening.fit(table, d, 4, pairs)
    got = {r.vec_id: r for r in whitening.whiten(table, model).collect()}
    deviation, whitened, explained = brute_whitening(data)
    assert [got[i].deviation for i in range(300)] == deviation
    y = np.array([got[i].whitened for i in range(300)])
    sign = np.sign((y * whitened[:, :4]).sum(axis=0))
    assert np.allclose(y * sign, whitened[:, :4], atol=1e-9)
    assert np.allclose(model.eigenvalues / model.trace, explained[:4], rtol=1e-10)
    assert whitening.identity_error(whitening.whiten(table, model), model.n, 4, pairs) < 1e-9


def test_whitening_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, 2.0]), (2, [0.5, -1.0, 2.5]), (None, [0.5, 0.25, 3.0]), (3, None), (4, [None, 1.0, 2.0]), (5, [nan, 1.0, 2.0]), (6, [1.0, -inf, 2.0]), (7, []), (8, [1.0]), (1, [0.5, 1.0, 2.0])]
    got = whitening.report(crowded(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))).collect()
    # the first dimension is constant, so two components are left, for each of the four rows that remain
    assert sorted(((r.vec_id, r.component) for r in got), key=repr) == sorted([(i, c) for i in (1, 1, 2, None) for c in (1, 2)], key=repr)
    assert {r.n for r in got} == {4} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    assert math.isclose(sum({r.component: r.explained for r in got}.values()), 1)
    deviation, _, _ = brute_whitening([v for _, v in (rows[0], rows[1], rows[2], rows[0])])
    assert {(r.vec_id, r.deviation) for r in got} == set(zip((1, 2, None, 1), deviation, strict=True))
    for few in ([], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(1, [2.0]), (2, [2.0])]):
        assert whitening.report(spark.createDataFrame(few, "vec_id long, embedding array<float>")).count() == 0


def test_whitening_of_large_entries(spark):
    df = spark.createDataFrame([(i, [i * 2.0e9, float(i % 3)]) for i in range(5)], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in whitening.report(df).collect()}
    assert got[2, 1].deviation == 384**2  # the first dimension lies at its mean, 5 * 128 - 256 of the second doesn't
    assert got[0, 1].deviation is None  # (5 * 64 * 4e9)^2 is no long
    with pytest.raises(Exception, match="1e17"):
        whitening.report(spark.createDataFrame([(1, [1e18])], "vec_id long, embedding array<double>")).collect()


# 13


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = defaultdict(list)
    for i, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        parts[lang or ""].append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out = []
    for part, docs in parts.items():
        sums = Counter()
        own = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for s, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                sums[f] += len(gone)
                own.append([part, order, s + 1, len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), f])
        out += [(*r[:9], sums[r[9]]) for r in own]
    return sorted(out)


@pytest.mark.parametrize("k", range(7))
def test_swaps_visit_every_order_once(k):
    order, seen = list(range(k)), [tuple(range(k))]
    for i in filter_audit.neighbour_swaps(k):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(itertools.permutations(range(k)))


def test_audit_is_that_of_filtering_in_every_order(spark):
    r = random.Random(5)
    long = " ".join(f"w{i}" for i in range(60_000))
    texts = [None, "", "A", " ".join(["x"] * 300), " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(250)), "# " * 210, " ".join(f"w{i}|" for i in range(250)), "ÄÖ É\x1cÜ é", "\t\n a \x0b B\x0c", long]
    rows = [(r.randrange(60), r.choice(texts), r.choice(["aa", "bb", None, ""])) for _ in range(200)]
    rows += [(None, texts[4], "aa"), (None, texts[4], "aa"), (None, None, "cc"), (7, texts[2], "aa"), (7, texts[2], "aa"), (100, "only copies", "dd"), (100, "only copies", "dd")]
    rows += [(1000 + i, "a hot text", "aa") for i in range(100)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(70)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (1003, 1, 1), (100, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(x) for x in filter_audit.audit(crowded(docs), crowded(marks)).collect())
    assert got == brute_audit(rows, labels)
    assert {x[0] for x in got} == {"", "aa", "bb", "cc", "dd"} and len(got) == 5 * 600


def test_audit_of_nothing_and_of_other_filters(spark):
    docs = spark.createDataFrame([(1, "a b", "xx"), (2, "a b", "xx"), (3, "c", "xx")], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.where("false"), marks).count() == 0
    one = filter_audit.audit(docs, marks, {"s": lambda text: ~text.contains(" ")}, "r").collect()
    assert sorted((x.filter_order, x.step, x.kept, x.removed) for x in one) == [("rs", 1, 2, 1), ("rs", 2, 1, 1), ("sr", 1, 2, 1), ("sr", 2, 1, 1)]
    assert {x.shapley for x in one} == {2}


def test_audit_moves_no_texts(spark, tmp_path):
    """Rows that move hold ids, hashes and masks."""
    docs = spark.createDataFrame([(i, "word " * 50 + str(i % 7), "xx") for i in range(50)], "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "docs"))
    marks = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    cells = filter_audit.cells(spark.read.parquet(str(tmp_path / "docs")), marks)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "audit-rows" in plan and "text#" not in plan and "Cartesian" not in plan
