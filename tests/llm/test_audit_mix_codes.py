"""Filter audit, source mixing and vector codes: edge cases, and results against brute force."""

import collections
import itertools
import math
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import filter_audit, source_mixing, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ("fp", "part", "mask", "size", "v", "pi", "bucket", "n", "of")


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH})


# Filter audit.


def texts(seed=5):
    """Texts that fail every mix of filters, groups of copies of two to a third of all rows, nulls, repeated rows and ids."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(60):
        n = int(rng.choice([0, 1, 30, 199, 200, 201, 260]))
        words = [f"w{v}" for v in rng.integers(0, int(rng.choice([40, 4000])), n)]
        extra = rng.choice(["", "#", "A" * 30, "é" * 90 + "ABC"])
        out.append(" ".join(words) + str(extra))
    out += out[:15] + [out[20]] * 60 + [None, "", "", " \t ", "x" * 60_000, "Ä\x1c\x85Ö"]
    rows = [(i, t, ["de", "en", None, ""][i % 4]) for i, t in enumerate(out)]
    rng.shuffle(rows)
    rows = [(int(i), t, None if p is None else str(p)) for i, t, p in rows]
    return [*rows, rows[3], rows[3], (None, out[0], "en"), (None, out[0], "en"), (None, None, None), (rows[5][0], out[20], "fr")]


def audit(rows, labels):
    good, toxic = ({d for d, *flags in labels if d is not None and flags[k] == 1} for k in (0, 1))
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    judged = []
    for d, t, part in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d}
        judged.append((part or "", {f for f, x in fails.items() if x}, d in good, d in toxic))
    out, shapley = {}, collections.Counter()
    for order in itertools.permutations("ABCDE"):
        for step, f in enumerate(order):
            for part in {p for p, *_ in judged}:
                here = [(x, g, t) for p, x, g, t in judged if p == part]
                before = set(order[:step])
                gone = [(g, t) for x, g, t in here if f in x and not x & before]
                out[part, "".join(order), step + 1] = [sum(not x & (before | {f}) for x, *_ in here), len(gone), sum(f in x and bool(x & before) for x, *_ in here), sum(x == {f} for x, *_ in here), sum(g for g, _ in gone), sum(t for _, t in gone)]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LABELS = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 140, 2)] + [(0, 0, 0), (7, None, 1), (None, 1, 1)]


@pytest.mark.parametrize("one_fingerprint", [False, True])
def test_audit_against_brute_force(spark, monkeypatch, one_fingerprint):
    """Also where all fingerprints are equal, so that every text is compared over the bounds of partitions."""
    if one_fingerprint:
        monkeypatch.setattr(filter_audit, "fingerprint", lambda text: F.length(text).cast("long") * 0)
    monkeypatch.setattr(filter_audit, "map_arrow", lambda df, fn, schema: df.mapInArrow(fn, schema))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        docs = clashing(spark.createDataFrame(texts(), "doc_id long, text string, lang string").repartition(3))
        labels = clashing(spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))
        rows = filter_audit.audit(docs, labels).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = audit(texts(), LABELS)
    assert len(rows) == len(want)
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows} == want


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a", None)], docs.schema)
    got = filter_audit.audit(one, labels).where("filter_order = 'BACDE'").orderBy("step").collect()
    assert [(r["kept"], r["removed"], r["unique_fails"], r["shapley"]) for r in got] == [(1, 0, 0, 0), (0, 1, 1, 120), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]


def test_audit_counters_add_up(spark):
    docs, labels = spark.createDataFrame(texts(), "doc_id long, text string, lang string"), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    judged = filter_audit.masks(docs)
    halves = [filter_audit.counters(judged.where(f"coalesce(doc_id, 0) % 2 = {k}"), labels) for k in (0, 1)]
    added = halves[0].unionByName(halves[1]).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    assert sorted(map(tuple, added.collect())) == sorted(map(tuple, filter_audit.counters(judged, labels).collect()))


# Source mixing.


def sources(seed=6, n=400):
    """A hot source, small ones, one of equal sizes, one without words, a null one, very long texts, null texts and repeated rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["hot", "hot", "hot", "b", "c", "same", "none"])
        size = {"same": 7, "none": 0}.get(str(source), int(rng.pareto(1.2) * 20))
        rows.append((i, " ".join(["w"] * min(size, 20_000)), str(source)))
    return [*rows, rows[0], rows[0], (None, "a b c", "b"), (None, "a b c", "b"), (900, None, "b"), (901, "", "c"), (902, "one two three", None), (903, "one " * 50, "Zeta"), (904, "x" * 70_000, "é")]


def shares(sizes):
    """Targets by resharing the excess round after round, in fractions."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    stopped, left = {}, Fraction(3, 2) * sum(sizes.values())
    while True:
        free = [s for s in order if s not in stopped]
        rest = left - sum(stopped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 2 * sizes[s]]
        if not above:
            return stopped | share
        stopped |= {s: Fraction(2 * sizes[s]) for s in above}


@pytest.mark.parametrize("bucket", [1000, 30])
def test_mix_meets_targets(spark, monkeypatch, bucket):
    monkeypatch.setattr(source_mixing, "BUCKET", bucket)
    monkeypatch.setattr(source_mixing, "FAN", 3)
    docs = clashing(spark.createDataFrame(sources(), "doc_id long, text string, source string").repartition(7))
    rows = source_mixing.mix(docs).collect()
    assert sorted((str(r["doc_id"]), str(r["source"]), r["size"]) for r in rows) == sorted((str(d), str(s), len(WORD.findall(t or ""))) for d, t, s in sources())
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["copies"] in (0, 1, 2)
    size = {s: sum(r["size"] for r in rs) for s, rs in by.items()}
    want = shares(size)
    assert sum(want.values()) == Fraction(3, 2) * sum(size.values())
    for s, rs in by.items():
        assert all(r["source_size"] == size[s] and r["target"] == pytest.approx(float(want[s])) for r in rs)
        largest = max(r["size"] for r in rs)
        off = abs(sum(r["taken"] for r in rs) - float(want[s]))
        assert off <= largest and (len(rs) < 40 or off <= max(4, 0.01 * float(want[s])))
        rate = float(want[s]) / size[s] if size[s] else 0
        held = [r for r in rs if r["size"]]
        assert abs(sum(r["copies"] for r in held) - rate * len(held)) <= source_mixing.LANDING
    again = source_mixing.mix(docs.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_steps_keep_totals_and_means():
    rng = np.random.default_rng(8)
    mean = np.zeros(3)
    for k in range(4000):
        units = [[0.2, 5, int(rng.integers(1 << 62)) - (1 << 61)], [0.7, 11, int(rng.integers(1 << 62))], [0.55, 3 + k % 5, k]]
        before = [sum(u[0] for u in units), sum(u[0] * u[1] for u in units)]
        source_mixing.step(units)
        assert [sum(u[0] for u in units), sum(u[0] * u[1] for u in units)] == pytest.approx(before)
        assert any(u[0] in (0.0, 1.0) for u in units) and all(0 <= u[0] <= 1 for u in units)
        mean += [u[0] for u in units]
    assert mean / 4000 == pytest.approx([0.2, 0.7, 0.55], abs=0.03)


def test_landing_is_the_nearest_outcome():
    units = [[0.5, 100, 0], [0.5, 60, 0], [0.5, 41, 0], [0.5, 3, 0]]
    source_mixing.land(units)
    assert abs(sum(u[0] * u[1] for u in units) - 102) == min(abs(sum(s for s, x in zip((100, 60, 41, 3), c) if x) - 102) for c in itertools.product((0, 1), repeat=4))


def test_mix_of_nothing(spark):
    assert source_mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    only = source_mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")).collect()
    assert [(r["target"], r["taken"]) for r in only] == [(0.0, 0), (0.0, 0)]


# Vector codes.


def test_nearest_is_exact():
    """Against int64 in full, where float32 cannot tell: large values, near ties and ties."""
    rng = np.random.default_rng(9)
    for scale in (3, 200, 1 << 12, 1 << 20, (1 << 28) - 1):
        for w in (1, 4, 9):
            c = rng.integers(-scale, scale + 1, (64, w))
            c[40:] = c[:24] + rng.integers(-1, 2, (24, w))
            c[33] = c[2]
            x = np.clip(c[rng.integers(0, 64, 3000)] + rng.integers(-2, 3, (3000, w)), -scale, scale)
            d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
            assert (vector_codes.nearest(x, c) == d.argmin(axis=1)).all()


def codes(rows):
    kept = []
    for i, v, label in rows:
        if v is not None and len(v) == 32 and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, [math.floor(256 * c) for c in v], label))
    seeds = sorted((i, v) for i, v, _ in kept if i is not None)[:64]
    books = [[v[2 * p : 2 * p + 2] for _, v in seeds] for p in range(16)]
    best = lambda s, book: min((sum((a - b) ** 2 for a, b in zip(s, e)), k) for k, e in enumerate(book))
    for _ in range(2):
        for p in range(16):
            held = collections.defaultdict(list)
            for _, v, _ in kept:
                held[best(v[2 * p : 2 * p + 2], books[p])[1]].append(v[2 * p : 2 * p + 2])
            books[p] = [[sum(c) // len(c) for c in zip(*held[k])] if k in held else e for k, e in enumerate(books[p])]
    out, total = [], collections.Counter()
    for i, v, label in kept:
        found = [best(v[2 * p : 2 * p + 2], books[p]) for p in range(16)]
        error = sum(d for d, _ in found)
        total[label] += error
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), error))
    return sorted((str(r[0]), str(r[1]), *r[2:], total[r[1]]) for r in out), books


def vectors(seed=10, n=150):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(c)) for c in rng.normal(0, 0.4, 32)], [None, 1, 2][i % 3]) for i in rng.permutation(n)]
    odd = [None if k == 3 else 0.5 for k in range(32)]
    bad = [(500, None, 1), (-1, odd, 1), (-2, [float("nan")] + [0.0] * 31, 2), (-3, [0.0] * 31 + [float("-inf")], 2), (501, [], 1), (502, [0.1] * 16, 1), (503, [0.1] * 33, 1)]
    return [*rows, *bad, rows[0], rows[0], (None, rows[1][1], 1), (rows[2][0], rows[3][1], None), (600, [0.0] * 32, 7)]


@pytest.mark.parametrize("n", [150, 20])
def test_codes_against_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(vector_codes, "BLOCK", 30)
    rows = vectors(n=n)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4).withColumns({c: F.lit("clash") for c in ("v", "code", "error", "of")})
    coded, books = vector_codes.compress(df)
    want, want_books = codes(rows)
    assert sorted((str(r["vec_id"]), str(r["label"]), r["code"], r["error"], r["label_error"]) for r in coded.collect()) == want
    assert books.tolist() == want_books


def test_codes_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], schema))[0].count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1), (2, [None] * 16, 1)], schema))[0].count() == 0
    with pytest.raises(Exception, match="is not below"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 16, 1)], schema))
