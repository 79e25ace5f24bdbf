"""The store: concurrent changes, segments and tombstones, merges, leases and vacuum."""

import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F

from quarryline.api import Engine
from quarryline.operators import accounting, graph, ingest, search, temporal
from quarryline.plans import schema as S
from quarryline.sources import store as store_module
from quarryline.sources.store import Change, Conflict, Store


def row(k, project="p"):
    return (str(k), project, "s", "q", 1, 0, 15, dt.datetime(2024, 1, 1))


def ids(store, table="accounting"):
    return sorted(r["id"] for r in store.read(table).collect())


def node(spark, *names, project="p"):
    rows = spark.createDataFrame([(n, "concept", n, 1, 1, None, None, 0) for n in names], "name string, node_type string, file_path string, start_line long, end_line long, summary string, content_hash string, ordinal long")
    return graph.node_rows(rows, project).withColumn("id", F.col("name"))


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "key string")


@pytest.mark.parametrize("step", ["_segment", "_put"])
def test_a_crash_leaves_the_state_before(spark, tmp_path, monkeypatch, step):
    Store(spark, str(tmp_path)).append("accounting", [row(1)])

    def stop(*a):
        raise RuntimeError("crash")

    broken = Store(spark, str(tmp_path))
    monkeypatch.setattr(broken, step, stop)
    with pytest.raises(RuntimeError):
        broken.append("accounting", [row(9)])
    assert ids(Store(spark, str(tmp_path))) == ["1"]
    Store(spark, str(tmp_path)).append("accounting", [row(2)])
    assert ids(Store(spark, str(tmp_path))) == ["1", "2"]


def test_one_writer_puts_a_manifest(spark, tmp_path):
    stores, won = [Store(spark, str(tmp_path)) for _ in range(6)], []

    def put(k):
        if stores[k]._put(1, {"live": {}, "by": k}):
            won.append(k)

    threads = [threading.Thread(target=put, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and stores[0].snapshot().state["by"] == won[0] and not stores[0]._put(1, {})


def test_two_facts_closed_at_once(spark, tmp_path):
    """Both closures hold, and no fact is there twice, whichever of the two is made again."""
    engines = [Engine(spark, str(tmp_path), str(tmp_path), "p") for _ in range(2)]
    facts = [engines[0].add_fact("decision", t)["id"] for t in ("one", "two", "three")]
    both, failed = threading.Barrier(2), []
    first = [True, True]

    def close(k):
        def changes(now):
            ended = spark.createDataFrame([(facts[k], "p", f"by {k}")], "id string, project_id string, superseded_by string")
            out = temporal.invalidation(now, "p", ended)
            if first[k]:  # neither commits before the other has read
                first[k] = False
                both.wait(60)
            return out

        try:
            engines[k].store.update(changes)
        except Exception as e:  # seen by the test's own thread
            failed.append(e)

    threads = [threading.Thread(target=close, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = engines[0].store.read("temporal_facts").collect()
    assert not failed and {r["id"]: r["superseded_by"] for r in rows} == {facts[0]: "by 0", facts[1]: "by 1", facts[2]: None} and len(rows) == 3
    assert [r["content"] for r in engines[1].facts().collect()] == ["three"]


def test_a_change_is_made_again_on_the_newer_state(spark, tmp_path):
    store, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    store.append("accounting", [row(k) for k in range(3)])
    asked = []

    def change(old):
        asked.append(old.count())
        if len(asked) == 1:
            other.append("accounting", [row("late")])
        return old.where("id <> '0'")

    store.change("accounting", change)
    assert asked == [3, 4] and ids(store) == ["1", "2", "late"]


def test_a_change_is_refused_if_it_never_fits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "ATTEMPTS", 2)
    store, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))

    def change(old):
        other.append("accounting", [row("x")])
        return old

    with pytest.raises(Conflict):
        store.change("accounting", change)
    assert ids(store) == ["x", "x"]


def test_other_projects_do_not_conflict(spark, tmp_path):
    store, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    store.append("accounting", [row(1)], "p")
    asked = []

    def change(old):
        asked.append(1)
        other.append("accounting", [row(2, "q")], "q")
        return old.where("false")

    store.change("accounting", change, "p")
    assert asked == [1] and ids(store) == ["2"]


def test_two_projects_indexed_at_once(spark, tmp_path, monkeypatch):
    """One project's whole index is committed between the other's read and its write."""
    for p in ("p1", "p2"):
        (tmp_path / p).mkdir()
        (tmp_path / p / "a.md").write_text(f"# Tide {p}\nspring tide\n")
    one, two = (Engine(spark, str(tmp_path / "store"), str(tmp_path / p), p) for p in ("p1", "p2"))
    written = one.store._written

    def slow(changes):
        if not two.store.read("nodes", "p2").head(1):
            two.index()
        return written(changes)

    monkeypatch.setattr(one.store, "_written", slow)
    one.index()
    assert {(r["project_id"], r["node_type"]) for r in one.store.read("nodes").collect()} == {(p, k) for p in ("p1", "p2") for k in ("file", "document")}
    assert [e._full_text("spring").count() for e in (one, two)] == [2, 2]
    assert {r["term"]: r["df"] for r in search.added_counts(one.store.read("fts_terms")).collect()}["spring"] == 4


def test_tombstones_hide_older_rows_only(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    alive = lambda: sorted((r["id"], r["summary"]) for r in store.read("nodes").collect())
    store.append("nodes", node(spark, "a", "b").withColumn("summary", F.lit("old")), "p")
    store.append("nodes", node(spark, "a", project="q").withColumn("summary", F.lit("of q")), "q")
    store.update(lambda now: [Change("nodes", "p", add=node(spark, "a", "c").withColumn("summary", F.lit("new")), remove=keys(spark, "a", "c"))])
    assert alive() == [("a", "new"), ("a", "of q"), ("b", "old"), ("c", "new")]
    store.update(lambda now: [Change("nodes", "p", remove=keys(spark, "b", "c"))])
    assert alive() == [("a", "new"), ("a", "of q")]
    store.append("nodes", node(spark, "b").withColumn("summary", F.lit("again")), "p")
    assert alive() == [("a", "new"), ("a", "of q"), ("b", "again")]


def test_edges_go_with_either_end(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    edges = spark.createDataFrame([("1", "p", "a", "b", "calls", 1.0), ("2", "p", "b", "c", "calls", 1.0), ("3", "p", "c", "d", "calls", 1.0)], "id string, project_id string, source_id string, target_id string, edge_type string, weight double")
    store.append("edges", edges.withColumn("created_at", F.current_timestamp()), "p")
    store.update(lambda now: [Change("edges", "p", remove=keys(spark, "b"))])
    assert ids(store, "edges") == ["3"]


def test_merges_keep_rows_and_drop_what_is_hidden(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "FAN", 3)
    store, rng, want = Store(spark, str(tmp_path)), random.Random(3), {}
    for i in range(14):
        new, gone = {f"n{rng.randrange(12)}" for _ in range(2)}, {f"n{rng.randrange(12)}" for _ in range(2)}
        add = node(spark, *sorted(new)).withColumn("summary", F.lit(str(i)))
        store.update(lambda now, add=add, dead=new | gone: [Change("nodes", "p", add=add, remove=keys(spark, *sorted(dead)))])
        want = {k: v for k, v in want.items() if k not in new | gone} | {k: str(i) for k in new}
        assert {r["id"]: r["summary"] for r in store.read("nodes").collect()} == want and store.read("nodes").count() == len(want)
    now = store.snapshot()
    assert len(now.entries("nodes")) < 3 * 2 and len(now.entries("nodes", kind="dead")) < 3
    raw = spark.read.parquet(*(f"{tmp_path}/{e['at']}" for e in now.entries("nodes")))
    assert raw.count() < 28


def test_a_large_merge_is_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """No task of a merge sorts more than about FILE_BYTES of the log."""
    monkeypatch.setattr(store_module, "FAN", 2)
    store, some = Store(spark, str(tmp_path)), F.sha2(F.col("id").cast("string"), 256)
    for k in range(2):
        log = spark.range(k * 150_000, (k + 1) * 150_000).select(some.alias("id"), F.lit("p").alias("project_id"), F.lit("s").alias("session_id"), F.reverse(some).alias("query_text"), *(F.col("id").alias(c) for c in ("pointer_tokens", "fetched_tokens", "traditional_est")), F.timestamp_seconds("id").alias("created_at"))
        store.append("accounting", log, "p")
    merged, = store.snapshot().entries("accounting")
    files = sorted(f.stat().st_size for f in (tmp_path / merged["at"]).glob("part-*"))
    assert merged["bytes"] > 32 << 20 and len(files) > 1 and files[-1] < 16 << 20
    assert tuple(accounting.stored_stats(store.snapshot(), "p").first()) == tuple(accounting.stats(store.read("accounting"), "p").first())


def test_a_merge_gives_way(spark, tmp_path, monkeypatch):
    """Segments that another writer replaces while they are merged are not brought back; what it hides meanwhile stays hidden."""
    monkeypatch.setattr(store_module, "FAN", 2)
    for what in ("replace", "remove"):
        store, other = Store(spark, f"{tmp_path}/{what}"), Store(spark, f"{tmp_path}/{what}")
        other._merge = lambda *a: None
        other.append("nodes", node(spark, "a", "b"), "p")
        swap = store._swap

        def late(*a, what=what, other=other, swap=swap):
            if what == "replace":
                other.change("nodes", lambda old: old.where("id = 'a'"), "p")
            else:
                other.update(lambda now: [Change("nodes", "p", remove=keys(spark, "b", "c"))])
            return swap(*a)

        monkeypatch.setattr(store, "_swap", late)
        store.append("nodes", node(spark, "c"), "p")
        assert ids(other, "nodes") == ["a"]


def test_vacuum_keeps_what_may_be_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "KEPT", 1)
    store = Store(spark, str(tmp_path))
    store.append("accounting", [row(0)])
    with store.lease() as held:
        for k in range(1, 5):
            store.change("accounting", lambda old, k=k: spark.createDataFrame([row(k)], S.ACCOUNTING))
        assert store.vacuum() == 0  # all younger than the grace
        assert store.vacuum(grace=-60) == 2  # of 1 and 2; 0 is leased, 3 is the manifest before
        assert [r["id"] for r in held.read("accounting").collect()] == ["0"] and ids(store) == ["4"]
        assert [r["id"] for r in store.snapshot(held.number).read("accounting").collect()] == ["0"]
    assert store.vacuum(grace=-60) == 1 and len(list((tmp_path / "accounting").iterdir())) == 2
    with store.lease(seconds=-1):
        assert store.vacuum() == 0 and not list((tmp_path / "leases").glob("[!.]*"))


def test_writes_follow_what_changed(spark, tmp_path, monkeypatch):
    """After a change of one file among many, what is written is a small part of what there is; a query equals that of a new index."""
    root, rng = tmp_path / "work", random.Random(5)
    root.mkdir()
    words = [f"{a}{b}" for a in "tide moon harbour reef gull".split() for b in range(60)]
    for i in range(60):
        (root / f"f{i}.md").write_text("\n".join(f"# Part {k}\n" + " ".join(rng.choices(words, k=120)) for k in range(4)))
    e = Engine(spark, str(tmp_path / "store"), str(root), "p")
    e.index()
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "store").rglob("part-*"))
    whole = size()
    (root / "f7.md").write_text("# Part 0\ntide1 tide2 harbour3\n")
    (root / "f8.md").unlink()
    e.index()
    assert size() - whole < whole / 8
    assert e.index()["indexed"] == 0 and len(e.store.snapshot().entries("fts")) == 2
    again = Engine(spark, str(tmp_path / "again"), str(root), "p")
    again.index()
    for q in ("tide1", "harbour3 reef4", "tide1 tide2 harbour3", "moon3", "gull1 nothing"):
        got, want = ([tuple(r) for r in x._full_text(q).collect()] for x in (e, again))
        assert [(i, round(raw, 9)) for i, raw, _ in got] == [(i, round(raw, 9)) for i, raw, _ in want] and want
    counts = lambda x: {r["term"]: (r["df"], r["total"]) for r in search.added_counts(x.store.read("fts_terms")).collect() if r["df"]}
    assert counts(e) == counts(again)


def text_rows(spark, rows, project="p"):
    return spark.createDataFrame([(i, project, None, t, i) for i, t in rows], S.FTS)


def edit(store, project, rows, gone):
    """Rows of the text index that come, and ids that go."""
    spark = store.spark
    stale = spark.createDataFrame([(i,) for i in gone], "id string")
    store.update(lambda now: ingest.text_changes(now, project, text_rows(spark, rows, project), stale))


def asked(store, query, project="p"):
    now = store.snapshot()
    name, hits = search.fts_search_stored(now.read("fts_postings"), now.read("fts_docs"), now.read("fts_terms"), query, project)
    return name, [(r["id"], round(r["raw"], 9)) for r in hits.collect()]


def test_merged_index_equals_a_new_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "FAN", 3)
    store, rng, held = Store(spark, f"{tmp_path}/a"), random.Random(6), {}
    for i in range(7):
        new = {f"n{rng.randrange(9)}": " ".join(rng.choices(["ebb", "flow", "moon", "sand"], k=30)) + f" turn{i}" for _ in range(3)}
        gone = {f"n{rng.randrange(9)}"} - set(new)
        edit(store, "p", list(new.items()), [*new, *gone])
        held = {k: v for k, v in held.items() if k not in gone} | new
    now = store.snapshot()
    assert len(now.entries("fts")) < 5 and {x["unit"] for x in now.entries("fts")} == {x["unit"] for x in now.entries("fts_docs")}
    again = Store(spark, f"{tmp_path}/b")
    edit(again, "p", list(held.items()), [])
    for q in ("ebb", "moon sand", "ebb turn6", "turn0"):
        assert asked(store, q) == asked(again, q)


def test_blocks_of_an_index(spark, monkeypatch):
    """Every block against brute force, of texts with marks, CJK characters, no token or null; spans that a batch parts; tokens are never shuffled."""
    monkeypatch.setattr(search, "SPAN", 4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rng, words = random.Random(8), ["tide", "Été", "海", "x1", "noon"]
    rows = [(f"n{i}", " ".join(rng.choices(words, k=rng.choice([1, 5, 30])))) for i in range(60)] + [("empty", ""), ("null", None), ("!", "-- "), ("edge", "Tide\x01\tx1\x01"), ("ctl", "TIDE\x00x1_x1\x7f\r\n noon.")]
    fts = text_rows(spark, rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        made = search.text_index(fts)
        docs = {(r["span"], r["at"]): r for r in made["fts_docs"].collect()}
        blocks = made["fts_postings"].collect()
        counts = {tuple(r) for r in search.index_counts(made["fts_docs"], made["fts_postings"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    toks = {r["node_id"]: r["toks"] for r in search.fts_index(fts).collect()}
    assert sorted(r["node_id"] for r in docs.values()) == sorted(toks) and all(r["size"] == len(toks[r["node_id"]]) - 2 for r in docs.values())
    got, want = {}, {}
    for b in blocks:
        assert b["top"] >= max(t * 2.2 / (t + 1.2 * (0.25 + 0.75 * docs[b["span"], a]["size"] / b["avg"])) for a, t in zip(b["at"], b["tf"], strict=True)) - 1e-12
        rest = b["positions"]
        for a, t in zip(b["at"], b["tf"], strict=True):
            got[b["term"], docs[b["span"], a]["node_id"]], rest = rest[:t], rest[t:]
        assert not rest
    for i, ts in toks.items():
        for p, t in enumerate(ts):
            if t != search.EDGE:
                want.setdefault((t, i), []).append(p)
    assert got == want and len({(b["term"], b["span"]) for b in blocks}) == len(blocks)
    assert counts == {tuple(r) for r in search.term_counts(fts).collect()}
    none = search.text_index(fts.limit(0))
    assert none["fts_docs"].count() == none["fts_postings"].count() == search.index_counts(none["fts_docs"], none["fts_postings"]).count() == 0


def test_an_index_shuffles_texts_only(spark):
    """On the way to the blocks there is one exchange, of the texts, and none for the layout of the blocks."""
    fts = text_rows(spark, [(f"n{i}", "tide moon reef " * 50) for i in range(200)])
    blocks = search.text_index(fts)["fts_postings"]
    plan = S.laid_out("fts_postings", blocks)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    parts = blocks.select("term", "span").rdd.glom().collect()
    assert sum(map(len, parts)) > 0 and all(p == sorted(p) for p in parts)


def test_top_k_reads_few_blocks(spark, monkeypatch):
    """The pruned search gives what the whole pass over token arrays gives, from a part of the blocks."""
    monkeypatch.setattr(search, "SPAN", 16)
    rng = random.Random(11)
    words = [f"w{k}" for k in range(40)]

    def text(i):
        rare = ["reef"] * rng.choice([0, 0, 0, 1, 1, 2, 9]) + ["gull"] * rng.choice([0, 0, 1, 6 * (i % 50 == 0)])
        body = rare + rng.choices(words, k=rng.choice([3, 10, 40, 120]))
        rng.shuffle(body)
        return " ".join(body)

    rows = [(f"n{i:04}", text(i)) for i in range(1600)] + [(f"same{i}", "reef " * 3) for i in range(60)]
    fts = text_rows(spark, rows).withColumn("project_id", F.when(F.col("node_id") > "n1200", "q").otherwise("p"))
    tables = {t: df.cache() for t, df in search.text_index(fts).items()} | {"fts_terms": search.term_counts(fts)}
    nodes, index = fts.select(F.col("node_id").alias("id")), search.fts_index(fts).cache()
    for q, project in (("reef", "p"), ("w3 gull nowhere", None), ("reef reef w1 gull", "q")):
        got, want = search.fts_search_stored(*(tables[t] for t in ("fts_postings", "fts_docs", "fts_terms")), q, project), search.fts_search(index, nodes, q, project)
        assert got[0] == want[0]
        assert [(r["id"], round(r["raw"], 9), round(r["score"], 9)) for r in got[1].collect()] == [(r["id"], round(r["raw"], 9), round(r["score"], 9)) for r in want[1].collect()]
    n, size = index.agg(F.count("*"), F.sum("size")).first()
    blocks = tables["fts_postings"].where("term IN ('reef', 'gull')").count()
    for average in (size / n, 3 * size / n, size / n / 3):  # an index that was built when texts were longer, or shorter
        weights = {"reef": 1.0, "gull": 2.5}
        best, read = search._best_rows(tables["fts_postings"], tables["fts_docs"], weights, average, "p", 20)
        share = lambda t, size, average=average: t * 2.2 / (t + 1.2 * (0.25 + 0.75 * size / average))
        every = sorted(((-round(sum(w * share(x.split().count(t), len(x.split()) + 1) for t, w in weights.items()), 9), i) for i, x in rows if i <= "n1200"))[:20]
        assert [(i, round(raw, 9)) for i, raw in best] == [(i, -raw) for raw, i in every]
        assert read <= blocks / (2 if average == size / n else 1)
    monkeypatch.setattr(search, "MOST_SPANS", 20)  # more spans reach the threshold than the driver sees
    assert [h[0] for h in search._best_rows(tables["fts_postings"], tables["fts_docs"], {"w3": 1.0, "w7": 0.5}, size / n, None, 20)[0]] == [h[0] for h in search._best_rows(tables["fts_postings"], tables["fts_docs"], {"w3": 1.0, "w7": 0.5}, size / n, None, 400)[0]][:20]


def test_nearest_vectors_read_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "SPAN", 16)
    rng = random.Random(13)
    words = [f"{a}_{k}" for a in ("tide", "moon", "reef", "gull", "sand") for k in range(40)]
    rows = [(f"n{i:04}", "p" if i % 3 else "q", " ".join(rng.choices(words, k=rng.choice([2, 4, 8]))), None, None) for i in range(1500)]
    rows += [(f"same{i}", "p", "tide_1 moon_2", None, None) for i in range(30)] + [("none", "p", "", None, None)]
    index = search.vector_index(spark.createDataFrame(rows, "id string, project_id string, name string, summary string, file_path string")).cache()
    kept = {t: df.cache() for t, df in search.vector_lists(index).items()}
    for q, project in (("tide_1 moon_2", "p"), ("reef_7 gull_9 sand_11", None), ("nothing here", "q"), ("!", "p")):
        got = search.vector_search_stored(kept["vector_lists"], kept["vector_docs"], q, project)
        want = search.vector_search(index, q, project)
        assert [(r["id"], round(r["score"], 9)) for r in got.collect()] == [(r["id"], round(r["score"], 9)) for r in want.collect()]
    hits, read = search._nearest(kept["vector_lists"], kept["vector_docs"], "tide_1 moon_2", "p", 20, search.MIN_COSINE)
    buckets = [str(b) for b, v in enumerate(search.X.query_vector("tide_1 moon_2")) if v]
    assert len(hits) == 20 and read < kept["vector_lists"].where(F.col("term").isin(buckets)).count() / 2


def test_rollups_give_the_same_reports(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "FAN", 3)
    store, rng = Store(spark, str(tmp_path)), random.Random(12)
    begin = dt.datetime(2024, 3, 9, tzinfo=dt.timezone.utc)
    for part in range(4):
        rows = [(f"{part}-{i}", rng.choice("pq"), rng.choice(["a", "b"]), "q", rng.randrange(50), rng.randrange(9), rng.randrange(900), begin + dt.timedelta(seconds=rng.randrange(3 * 86400))) for i in range(60)]
        for project in "pq":
            store.append("accounting", [r for r in rows if r[1] == project], project)
    now = store.snapshot()
    assert len(now.entries("accounting_sums", "p")) == 1 and len(now.entries("accounting", "p")) == 2
    log = now.read("accounting")
    moments = [begin + dt.timedelta(seconds=s) for s in (0, 86400 + 450, 86400 + 900, 100_000.000001, 10 * 86400)]
    cases = [{}, {"session": "a"}, {"session": "none"}, *({"since": F.lit(m)} for m in moments), *({"day": F.to_date(F.lit("2024-03-10")), "zone": z} for z in ("UTC", "+05:45", "America/St_Johns"))]
    for case in cases:
        assert tuple(accounting.stored_stats(now, "p", **case).first()) == tuple(accounting.stats(log, "p", **case).first())


def scanned(df):
    """Rows that the scans of a plan without shuffles give."""
    df.collect()
    rows, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if "Scan parquet" in plan.nodeName():
            rows += plan.metrics().apply("numOutputRows").value()
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return rows


def test_names_and_neighbours_read_little(spark, tmp_path):
    """A store of 90,000 nodes and edges: a scan for one node, a prefix or a word's grams gives a small part of the rows, and the answer is whole."""
    n, store = 90_000, Store(spark, str(tmp_path))
    some = spark.range(n).withColumn("name", F.concat(F.hex(F.xxhash64("id")), F.lit("_x"))).withColumn("id", F.sha2(F.col("id").cast("string"), 256))
    none = F.lit(None).cast("string")
    nodes = some.select("id", F.lit("p").alias("project_id"), "name", F.lit("concept").alias("node_type"), none.alias("file_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), none.alias("summary"), none.alias("content_hash"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"))
    store.append("nodes", nodes.coalesce(4), "p")
    edges = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("p").alias("project_id"), F.sha2(F.col("id").cast("string"), 256).alias("source_id"), F.sha2(((F.col("id") * 7 + 1) % n).cast("string"), 256).alias("target_id"), F.lit("calls").alias("edge_type"), F.lit(1.0).alias("weight"), F.current_timestamp().alias("created_at"))
    store.append("edges", edges.coalesce(4), "p")
    now = store.snapshot()
    first = nodes.first()
    assert len(now.entries("names")) == len(now.entries("edges_in")) == 1
    found = graph.neighbors_stored(now.read("edges", "p"), now.read("edges_in", "p"), now.read("nodes"), first["id"], "p")
    assert sorted(r["edge_id"] for r in found.collect()) == sorted(r["edge_id"] for r in graph.neighbors(nodes, edges, first["id"], "p").collect()) != []
    assert scanned(now.read("edges").where(F.col("source_id") == first["id"])) < n / 3 and scanned(now.read("edges_in").where(F.col("target_id") == first["id"])) < n / 3
    assert scanned(now.read("nodes").where(F.col("id") == first["id"])) < n / 3
    names, grams, low = now.read("names"), now.read("name_grams"), first["name"].lower()
    for q in (low[:5], low[4:11], low[9:], low, "_X", "g", "zzzz", low[3:6]):
        got, want = search.literal_search_stored(names, grams, q, "p"), search.literal_search(nodes, q, "p")
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    assert scanned(names.where(F.col("low").startswith(low[:5]))) < n / 3
    assert search._with_grams(names, grams, low[4:11]).count() < 20
