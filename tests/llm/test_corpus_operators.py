"""Operators that compare documents with each other: edge cases, and results against brute force."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarryline.llm import common, jaccard_join, line_dedup, substring_dedup
from quarryline.llm.shingles import WordHashes, runs

DOCS = "doc_id long, text string"


def corpus(seed=2):
    """Random texts with exact and near copies, shared passages, repeated lines and rows, nulls, and a hot group of near copies."""
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{int(v)}" for v in rng.zipf(1.3, n) % 400]
    texts = ["\n".join(" ".join(word(int(rng.integers(1, 30)))) for _ in range(int(rng.integers(1, 6)))) for _ in range(40)]
    passage, hot = " ".join(f"p{i}" for i in range(40)), [f"h{i}" for i in range(120)]
    texts += texts[:6] + [f"{t} {passage} end" for t in texts[6:14]] + [passage, "w1 w2 " * 60]
    for i in range(25):
        near = list(hot)
        near[int(rng.integers(0, 120))] = f"z{i}"
        texts.append(" ".join(near[:60]) + "\n" + " ".join(near[60:]))
    texts += [None, "", "  \n ", "one", "one", "one two three four", "a b c d e f g h i j k l m", "a b c d e f g h i j k l m", "x" * 70_000]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows = [(int(i), t) for i, t in rows]
    return [*rows, rows[0], rows[0], (None, texts[0]), (None, None), (rows[1][0], "another text under the same id but " + passage)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5).withColumns({c: F.lit("clash") for c in ("d", "h", "l", "n", "key", "set", "path", "copies")})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_windows(rows):
    first = {}
    for key, t in rows:
        w = (t or "").split()
        for i in range(len(w) - 12):
            if key is not None:
                first[tuple(w[i : i + 13])] = min(key, first.get(tuple(w[i : i + 13]), key))
    out = []
    for key, t in rows:
        w = (t or "").split()
        gone = {k for i in range(len(w) - 12) if key is not None and first[tuple(w[i : i + 13])] < key for k in range(i, i + 13)}
        out.append((str(key), len(w), len(gone), sha(" ".join(v for k, v in enumerate(w) if k not in gone))))
    return sorted(out)


@pytest.mark.parametrize(("hot", "shard"), [(1000, 8000), (2, 7)])
def test_substring_dedup(docs, nothing, monkeypatch, hot, shard):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SHARD", shard)
    got = [(str(r["doc_id"]), r["n_words"], r["n_removed"], sha(r["kept"])) for r in substring_dedup.dedup(docs).collect()]
    assert sorted(got) == brute_windows(corpus())
    assert substring_dedup.dedup(nothing).count() == 0


def test_samples_cover_every_window():
    words = [f"w{i % 37}".encode() for i in range(200)]
    sample, at, n = substring_dedup.sampled(words, WordHashes())
    assert at[0] == 0 and (np.cumsum(n)[:-1] == at[1:]).all() and n.sum() == 188
    grams = runs(WordHashes().of(words), substring_dedup.GRAM)
    for s, a, k in zip(sample, at, n, strict=True):
        assert all(grams[i : i + 8].min() == s for i in range(a, a + k))


def brute_lines(rows):
    lines = [((i is not None, i or 0), t, [v.split() for v in t.split("\n")]) for i, t in rows if t is not None]
    out = collections.Counter()
    for key, t, own in lines:
        gone = 0
        for number, w in enumerate(own):
            if not w:
                continue
            for key2, t2, other in lines:
                for number2, w2 in enumerate(other):
                    earlier = key2 < key or (key2 == key and t2 == t and number2 < number)
                    if earlier and w2 and 9 * len({*w} & {*w2}) >= 4 * (len({*w}) + len({*w2})):
                        gone += 1
                        break
                else:
                    continue
                break
        out[(str(key[1]) if key[0] else "None", len(own), gone)] += 1
    for i, t in rows:
        if t is None:
            out[(str(i), 0, 0)] += 1
    return out


def test_line_dedup(spark, docs, nothing):
    rows = [r for r in corpus() if r[1] is None or "same id" not in r[1]]  # between texts of one id the order is by hash
    df = spark.createDataFrame(rows, DOCS).withColumns({"h": F.lit("clash"), "words": F.lit("clash")})
    got = line_dedup.dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    assert collections.Counter((str(r["doc_id"]), r["n_lines"], r["n_removed"]) for r in got.collect()) == brute_lines(rows)
    assert line_dedup.dedup_lines(nothing).count() == 0
    assert line_dedup.dedup_lines(docs).count() == docs.count()


def test_line_dedup_four_words_in_five(spark):
    four, five = ["red oak leaf fell", "cold rain came down", "old men sat still"], ["red oak leaf | fell", "so cold rain came down", "old men sat still there"]
    rows = [(1, "\n".join(four[:2])), (2, "\n".join(five)), (3, four[2]), (4, "red oak leaf\noak leaf fell far"), (5, "red oak leaf"), (6, "oak leaf fell now so")]
    got = collections.Counter((str(r["doc_id"]), r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect())
    assert got == brute_lines(rows)
    assert got["2", 3, 2] == got["3", 1, 1] == 1


def sets_of(text):
    w = (text or "").split()
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute_groups(rows):
    held = [(i, t, sets_of(t)) for i, t in rows]
    live = [k for k, (i, _, s) in enumerate(held) if i is not None and s]
    links, root = collections.Counter(), list(range(len(held)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in live:
        for b in live:
            if a < b and 9 * len(held[a][2] & held[b][2]) >= 4 * (len(held[a][2]) + len(held[b][2])):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k in live:
        least[find(k)].append(held[k][0])
    return sorted((str(i), str(min(least[find(k)]) if k in set(live) else i), links[k]) for k, (i, _, _) in enumerate(held))


@pytest.mark.parametrize(("small", "block"), [(256, 512), (3, 4)])
def test_jaccard_join(docs, nothing, small, block):
    got = [(str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in jaccard_join.join(docs, small=small, block=block, recall=0.9999999).collect()]
    assert sorted(got) == brute_groups(corpus())
    assert jaccard_join.join(nothing).count() == 0


def test_components(spark):
    chain = [(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"x", b"y"), (b"z", b"z")]
    got = {bytes(r["node"]): bytes(r["root"]) for r in jaccard_join.components(spark.createDataFrame(chain, "a binary, b binary")).collect()}
    assert got == {bytes([i]): b"\x00" for i in range(41)} | {b"x": b"x", b"y": b"x"}


def test_recall_rises_with_runs():
    assert jaccard_join.runs_for(2, 0.9) < jaccard_join.runs_for(2, 0.9995) < jaccard_join.runs_for(3, 0.9995)


def test_large_buckets_take_further_steps(spark, monkeypatch):
    """Documents that share much boilerplate, and near copies of some: buckets split by further steps, and no link is lost."""
    shared = [f"b{i}" for i in range(60)]
    texts = [shared + [f"u{k}_{i}" for i in range(25)] for k in range(60)]
    texts += [[*t[:-1], "x"] for t in texts[:20]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    steps = []
    again = jaccard_join._next_step
    monkeypatch.setattr(jaccard_join, "_next_step", lambda *a: steps.append(1) or again(*a))
    got = [(str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in jaccard_join.join(spark.createDataFrame(rows, DOCS), small=5, block=16, recall=0.9999999).collect()]
    assert sorted(got) == brute_groups(rows) and len(steps) > 1


def test_sketches_lose_nothing():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for n in (1, 5, 63, 64, 65, 300, 3000):
        for _ in range(20):
            gone = int(rng.integers(0, n // 9 + 1))
            a, b = base[:n], np.concatenate([base[gone:n], rng.integers(0, 2**63, int(rng.integers(0, n // 20 + 1))).astype(np.uint64)])
            if not len(b) or 9 * len(np.intersect1d(a, b)) < 4 * (len(np.unique(a)) + len(np.unique(b))):
                continue
            size = np.array([len(np.unique(a)), len(np.unique(b))])
            both = [jaccard_join.parities(np.unique(x)).tobytes() for x in (a, b)]
            assert jaccard_join.alike(both, size, np.arange(2), np.arange(2)).tolist() == [0, 1]
            assert jaccard_join.alike(both, size, np.array([0]), np.array([1])).tolist() == [0, 1]


def planted_pairs(n, seed=12):
    """Pairs of documents with a similarity of 0.80 to 0.85, and documents that have none."""
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    while k < n:
        words = [f"w{v}" for v in rng.integers(0, 10**6, 120)]
        other = list(words)
        for at in rng.choice(24, 2 if rng.random() < 0.5 else 3, replace=False) * 5:
            other[at] = "changed"
        a, b = sets_of(" ".join(words)), sets_of(" ".join(other))
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
            k += 1
    return rows


@pytest.mark.parametrize(("passage", "small"), [("", jaccard_join.SMALL), (" ".join(f"shared{i}" for i in range(30)) + " ", 256)])
def test_recall_of_planted_pairs(spark, monkeypatch, passage, small):
    """Also where all share a passage, so that their common buckets are split by further steps."""
    steps, again = [], jaccard_join._next_step
    monkeypatch.setattr(jaccard_join, "_next_step", lambda *a: steps.append(1) or again(*a))
    rows = [(i, passage + t) for i, t in planted_pairs(1000)]
    found = jaccard_join.join(spark.createDataFrame(rows, DOCS), small=small).where("n_links > 0").count()
    assert found >= 0.99 * len(rows) and bool(steps) == bool(passage)


def test_places_are_shuffled_beyond_sent(spark, docs, monkeypatch):
    """The plans for more places than are broadcast give the same rows."""
    monkeypatch.setattr(jaccard_join, "SENT", -1)
    monkeypatch.setattr(line_dedup, "SENT", -1)
    got = [(str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in jaccard_join.join(docs, small=64, block=64, recall=0.9999999).collect()]
    assert sorted(got) == brute_groups(corpus())
    rows = [r for r in corpus() if r[1] is None or "same id" not in r[1]]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()
    assert collections.Counter((str(r["doc_id"]), r["n_lines"], r["n_removed"]) for r in found) == brute_lines(rows)


def pipeline_docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", F.when(F.col("doc_id") % 5 != 0, "en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage on its own input against plain Python."""
    rows = list({i: (i, t) for i, t in corpus() if i is not None}.values())
    item = "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11"
    rows += [(900, f"leak {item} here"), (901, "clean words only")]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = pipeline_docs(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = common.stash(stage(spark, docs, str(tmp_path)), "test")
        seen.append((name, {r["doc_id"]: r.asDict() for r in docs.collect()}, out))
        docs = out
    (_, raw, spoken), (_, before, cut), (_, many, few), (_, dirty, clean), (_, last, packed) = seen
    assert all(df.columns == columns for df in (spoken, cut, few, clean))
    letters = {i for i, r in raw.items() if r["text"] and any(c.isalpha() for c in r["text"])}
    assert {r["doc_id"] for r in spoken.collect()} == letters and spoken.where("lang IS NULL").isEmpty()
    gone = {key: n for (key, _, n), _ in brute_lines([(i, r["text"]) for i, r in before.items()]).items()}
    left = {r["doc_id"]: r["text"] for r in cut.collect()}
    for i, r in before.items():
        kept = (left.get(i) or "").count("\n") + 1 if i in left else 0
        assert kept == r["text"].count("\n") + 1 - gone[str(i)] or (i not in left and gone[str(i)])
    groups = brute_groups([(i, r["text"]) for i, r in many.items()])
    assert {r["doc_id"] for r in few.collect()} == {int(c) for _, c, _ in groups}
    assert {r["doc_id"] for r in clean.collect()} == {i for i, r in dirty.items() if item not in r["text"]} and 900 in dirty
    assert {r["doc_id"] for r in packed.collect()} == set(last)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_language_stage_without_labels(spark, tmp_path):
    rows = [(1, "words"), (2, "12 _ 34"), (3, ""), (4, None), (5, "é 1"), (6, " \n")]
    docs = pipeline_docs(spark, rows).withColumn("lang", F.lit(None).cast("string"))
    out = corpus_pipeline.identify_language(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and {(r["doc_id"], r["lang"]) for r in out.collect()} == {(1, None), (5, None)}


def test_pipeline_on_nothing(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = pipeline_docs(spark, [(1, "x")]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stash(stage(spark, docs, str(tmp_path)), "test")
    assert docs.count() == 0


def test_pipeline_with_clashing_columns(spark, tmp_path):
    """Extra columns of any name come through unchanged; repeated rows, null ids and ties are handled."""
    spark.createDataFrame([(1, "q1 q2 q3")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clash = ["n_lines", "N_Removed", "lang_pred", "score", "kept_id", "text_hash", "bad_id", "__k", "h", "d", "row", "a`b", "c.d"]
    rows = [(1, "alpha beta gamma delta epsilon\nalpha beta gamma delta epsilon"), (2, "one two three"), (2, "one two three"), (None, "null id words"), (None, "null id words"), (3, None), (4, ""), (5, "has q1 q2 q3 in")]
    docs = pipeline_docs(spark, rows).withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) for c in clash})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stash(stage(spark, docs, str(tmp_path)), "test")
        if name != "best-fit packing":
            assert docs.columns == columns
            for r in docs.collect():
                assert all(r[c] == f"{c}-{'null' if r['doc_id'] is None else r['doc_id']}" for c in clash)
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "2", "None", "None"]


def test_line_dedup_with_the_names_it_adds(spark):
    df = spark.createDataFrame([(1, "a b c d e\na b c d e", "x", "y")], DOCS + ", n_lines string, other string")
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "other", "n_lines", "n_removed"] and got.first()["n_removed"] == 1


def test_line_dedup_by_prefix_alone(spark):
    """Similar lines whose rarest words differ are found by the prefix join, and chains are not followed."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        words = [f"c{int(v)}" for v in rng.integers(0, 30, 24)]
        rows.append((i, " ".join(words) + "\n" + " ".join(words[:-2] + [f"r{i}", f"s{i}"])))
    got = collections.Counter((str(r["doc_id"]), r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect())
    assert got == brute_lines(rows)


@pytest.mark.parametrize("common, most", [(0, 100), (0, 1), (9, 2), (24, 8)])
def test_line_dedup_parts_lines_once_and_pairs_common_words(spark, monkeypatch, common, most):
    """Lines are parted once before candidates are verified; which words are looked up in pairs, and for which lines, changes no result; nor do lines on either side of LONG."""
    parted, again = [], line_dedup._words
    monkeypatch.setattr(line_dedup, "_words", lambda text: parted.append(1) or again(text))
    monkeypatch.setattr(line_dedup, "COMMON", common, raising=False)
    monkeypatch.setattr(line_dedup, "MOST", most, raising=False)
    rng = np.random.default_rng(7)
    rows = []
    for i in range(40):
        words = [f"c{int(v)}" for v in rng.choice(150, int(rng.choice([4, 5, 6, 20, 95, 100])), replace=False)]
        near = [w for w in words if rng.random() > 0.12] + [f"r{i}"] * (i % 2)
        rows.append((i, "\n".join([" ".join(words), " ".join(near), " ".join(words[: len(words) * 4 // 5])])))
    got = collections.Counter((str(r["doc_id"]), r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect())
    assert got == brute_lines(rows) and sum(k[2] for k in got) > 40
    assert len(parted) == 1 + 3


def test_pipeline_twice_in_one_process(spark, tmp_path):
    """Neither a second run nor a stage that is called before an earlier result is written takes away what that still reads."""
    rows = [(i, f"a line of words number {i} here\nand {i} more of them in the text") for i in range(30)]
    docs = pipeline_docs(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no such words are in any of these texts at all today")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    first, second = (corpus_pipeline.run(spark, str(tmp_path)) for _ in range(2))
    cut = corpus_pipeline.dedup_lines(spark, docs, str(tmp_path))
    groups = corpus_pipeline.dedup_documents(spark, docs, str(tmp_path))
    assert sorted(map(str, first.collect())) == sorted(map(str, second.collect())) and first.count() >= 30
    assert cut.count() == 30 and groups.count() == 30
