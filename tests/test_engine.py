import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F

from quarryline.api import Engine, TimedCache, report
from quarryline.operators import accounting, chunking, envscan, graph, search, temporal
from quarryline.plans import schema as S
from quarryline.sources import store as store_module
from quarryline.sources.store import Store
from quarryline.sources import workspace
from quarryline.sources.workspace import read_workspace


def nodes(spark, *names):
    return graph.build_nodes(spark, "p", [graph.NodeSpec(n) for n in names])


def names(df, all_nodes):
    return {r["name"] for r in df.join(all_nodes, "id").collect()}


def test_literal_gate(spark):
    n = nodes(spark, "load_tides", "merge_tides", "OpenHarbour")
    assert names(search.literal_search(n, "load"), n) == {"load_tides"}
    assert names(search.literal_search(n, "tides"), n) == {"load_tides", "merge_tides"}
    assert names(search.literal_search(n, "openharbour"), n) == {"OpenHarbour"}


def test_graph(spark):
    n = nodes(spark, "caller", "callee")
    ids = {r["name"]: r["id"] for r in n.collect()}
    e = graph.build_edges(spark, "p", [graph.EdgeSpec(ids["caller"], ids["callee"], "calls"), graph.EdgeSpec(ids["caller"], ids["callee"], "calls"), graph.EdgeSpec(ids["caller"], ids["caller"], "blah")])
    e = graph.insert_edges(spark.createDataFrame([], S.EDGES), e)
    assert e.count() == 2
    seen = lambda k: sorted(r["name"] for r in graph.neighbors(n, e, ids[k], "p").collect())
    assert seen("callee") == ["caller"]
    assert seen("caller") == ["callee", "caller"]
    assert {r["edge_type"] for r in e.collect()} == {"calls", "depends_on"}
    new = n.where("name = 'caller'").withColumn("name", F.lit("renamed"))
    assert {r["name"] for r in graph.upsert(n, new, ["id"]).collect()} == {"renamed", "callee"}
    fts = n.select(F.col("id").alias("node_id"))
    left = graph.cascade_delete(n, e, fts, n.where("name = 'caller'").select("id"))
    assert [df.count() for df in left] == [1, 0, 1]


def test_dedup_keeps_literal(spark):
    rows = spark.createDataFrame([("n1", 0.5, search.FULL_TEXT), ("n1", 0.9, search.LITERAL), ("n2", 0.7, search.VECTOR)], "id string, score double, tier string")
    got = [(r["id"], r["tier"]) for r in search.dedup_rank(rows, 10).collect()]
    assert got == [("n1", search.LITERAL), ("n2", search.VECTOR)]


def test_fts_strategies(spark):
    rows = spark.createDataFrame([(str(i), "p", f"n{i}", t, "x") for i, t in enumerate(["alpha beta", "alpha beta gamma", "beta alpha", "alpha betas", "other"])], S.FTS)
    index, n = search.fts_index(rows), spark.createDataFrame([(str(i),) for i in range(5)], "id string")
    assert search.fts_search(index, n, "alpha beta", "p")[0] == "prefix"
    assert search.fts_search(index, n, "alpha nothing", "p")[0] == "any"
    assert search.fts_search(index, n, "alpha", "p", limit=2)[1].count() == 2
    assert search.fts_search(index, n, "!!", "p")[1].count() == 0
    assert search.fts_search(index, n, "alpha", "other")[1].count() == 0


def test_facts(spark):
    rows = spark.createDataFrame([("architecture", "old"), ("nonsense", "x")], "fact_type string, content string")
    facts = temporal.fact_rows(rows, "p", F.lit("2024-01-01").cast("timestamp"))
    assert {r["fact_type"] for r in facts.collect()} == {"architecture", "decision"}
    ids = {r["content"]: r["id"] for r in facts.collect()}
    ended = spark.createDataFrame([(ids["old"], "p", "new")], "id string, project_id string, superseded_by string")
    after = temporal.invalidate(facts, ended, F.lit("2024-01-02").cast("timestamp"))
    assert [r["content"] for r in temporal.active_facts(after, "p").collect()] == ["x"]
    assert temporal.active_facts(after, "p", "architecture").count() == 0


def test_supersession_chain_is_whole(spark):
    links = [(f"f{i}", f"f{i + 1}" if i < 300 else None) for i in range(301)] + [("a", "b"), ("b", "c"), ("c", "b"), ("self", "self"), ("x", "no fact"), ("late", "f299")]
    facts = spark.createDataFrame(links, "id string, superseded_by string")
    chain = lambda *a: [(r["step"], r["id"]) for r in temporal.supersession_chain(facts, *a).collect()]
    assert chain("f0") == [(i, f"f{i}") for i in range(301)]
    assert chain("f0", 2) == [(0, "f0"), (1, "f1"), (2, "f2")]
    assert chain("late") == [(0, "late"), (1, "f299"), (2, "f300")]
    assert chain("a") == [(0, "a"), (1, "b"), (2, "c")]
    assert chain("self") == [(0, "self")] and chain("x") == [(0, "x")] and chain("no fact") == []


def test_stats(spark):
    log = spark.createDataFrame([("p", "a", 70, 0, 1050), ("p", "b", 31, 95, 465), ("q", "a", 8, 0, 0)], "project_id string, session_id string, pointer_tokens long, fetched_tokens long, traditional_est long")
    r = accounting.stats(log, "p").first()
    assert (r["total_queries"], r["total_pointer_tokens"], r["total_fetched_tokens"], r["total_traditional_estimate"], r["cumulative_savings_tokens"]) == (2, 101, 95, 1515, 1319)
    assert r["cumulative_savings_pct"] == pytest.approx(87.0627, abs=1e-3)
    assert accounting.stats(log, "q").first()["cumulative_savings_pct"] == 0
    assert accounting.stats(log, "p", session="a").first()["total_queries"] == 1
    assert report(0, 9999)["savings_pct"] == 0
    assert report(12, 0)["savings_pct"] == pytest.approx(100 * 14 / 15)


ENV_FILES = {
    "/w/.env": ("TIDE_URL=x\nMOON_KEY = abc\nlower=1\nPORT=80\n", [("TIDE_URL", True), ("MOON_KEY", True)]),
    "/w/a.py": ("import os\nos.getenv('A_ONE'); os.environ[\"A_TWO\"]; os.environ.get('A_THREE', 1)\n", [("A_ONE", False), ("A_TWO", False), ("A_THREE", False)]),
    "/w/b.ts": ("const { B_ONE, B_TWO: two, B_THREE = 3, lower } = process.env;\nprocess.env.B_FOUR; process.env['B_FIVE']\n", [(f"B_{n}", False) for n in ("ONE", "TWO", "THREE", "FOUR", "FIVE")]),
    "/w/c.rs": ("let x = std::env::var(\"C_ONE\"); let y = env::var(\"C_TWO\");\n", [("C_ONE", False), ("C_TWO", False)]),
    "/w/d.sh": ("echo $D_ONE ${D_TWO} $lower\n", [("D_ONE", False), ("D_TWO", False)]),
    "/w/e.yml": ("env:\n  - E_ONE: 1\n  - E_TWO=2\n  - E_THREE\n  E_FOUR: 4\n", [("E_ONE", True), ("E_TWO", True), ("E_THREE", True)]),
    "/w/f.md": ("| `F_ONE` | text |\n| F_TWO | $NOT_SHELL |\n", [("F_ONE", True), ("F_TWO", True)]),
}


def test_env(spark):
    found = {tuple(r) for r in envscan.scan(spark.createDataFrame([(p, t) for p, (t, _) in ENV_FILES.items()], "path string, content string")).collect()}
    assert found == {(n, p, d) for p, (_, names_) in ENV_FILES.items() for n, d in names_}
    reg = spark.createDataFrame([("p", "HARBOUR_URL", True, True), ("p", "TIDE_KEE", False, True), ("p", "TIDE_KEY", True, False)], "project_id string, key string, is_defined boolean, is_used boolean")
    assert envscan.validate(reg, "HARBOUR_URL") == (True, [])
    valid, near = envscan.validate(reg, "HARBOUR_URI")
    assert not valid and near[0] == "HARBOUR_URL"
    assert envscan.validate(reg.limit(0), "X") == (False, [])
    assert tuple(envscan.consistency(reg).first()) == (1, 1, 1, "issues_found")
    assert [tuple(r) for r in envscan.nearest_defined(reg).collect()] == [("TIDE_KEE", "TIDE_KEY")]


RUST = "pub fn tide(a: u8) -> u8 {\n  if a > 1 { 1 } else { 2 }\n}\nstruct Port {\n  x: u8,\n}\nimpl Show for Port {\n  fn draw(&self) {}\n}\npub trait Moored: Send {\n}\nenum Moon { Full, New }\n"
SCRIPTS = "export function moor(a) {\n  return a;\n}\nconst sail = async (u) => {\n  go();\n}\nexport default class Deck extends Base {\n}\nconst limit = 3;\n"
MARKDOWN = "intro\n# Title\ntext\n### deep\n## Section A\na\n## Section B\nb\n"


def test_chunks(spark):
    files = [("a.rs", RUST), ("b.ts", SCRIPTS), ("c.md", MARKDOWN), ("d.toml", "x = 1\ny = 2\n"), ("e.md", ""), ("f.rs", "fn x();\n")]
    rows = chunking.chunk_files(spark.createDataFrame([(f"/w/{n}", t) for n, t in files], "path string, content string")).collect()
    got = {(r["path"][3:], r["name"], r["node_type"], r["start_line"], r["end_line"]) for r in rows}
    assert got == {
        ("a.rs", "tide", "function", 1, 3), ("a.rs", "Port", "struct", 4, 6), ("a.rs", "Port", "impl", 7, 9), ("a.rs", "draw", "function", 8, 8),
        ("a.rs", "Moored", "trait", 10, 11), ("a.rs", "Moon", "enum", 12, 12), ("b.ts", "moor", "function", 1, 3),
        ("b.ts", "sail", "function", 4, 6), ("b.ts", "Deck", "function", 7, 8), ("c.md", "Title", "document", 2, 4), ("c.md", "Section A", "document", 5, 6),
        ("c.md", "Section B", "document", 7, 8), ("d.toml", "d.toml", "file", 1, 2), ("f.rs", "x", "function", 1, 1),
    }
    long = "pub fn name(" + "a: u8, " * 20 + ") {}"
    assert chunking.code_chunks("rs", long)[0][5] == "function: name"


@pytest.mark.parametrize("budget", [50_000, 2])
def test_crawl(spark, tmp_path, monkeypatch, budget):
    """Also where a task's budget is one folder, so that the tree is dealt out again and again."""
    monkeypatch.setattr(workspace, "BUDGET", budget)
    root, other = tmp_path / "root", tmp_path / "other"
    for p in ("main.rs", "readme.txt", "node_modules/lib.js", "src/app.ts", "src/deep/er/x.py", "_x/__init__.py", ".hidden/y.md", ".env"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(b"caf\xe9")
    (other / "dist").mkdir(parents=True)
    (other / "far.md").write_text("far")
    (other / "dist" / "no.md").write_text("no")
    for link, to in (("src/loop", root), ("src/again", root / "_x"), ("a", other), ("b", other), ("pruned", root / "node_modules")):
        (root / link).symlink_to(to, target_is_directory=True)
    (other / "back").symlink_to(other, target_is_directory=True)
    listed = lambda r: sorted(x["path"][len(str(root)) + 1 :] for x in workspace.list_files(spark, str(r)).collect())
    assert listed(root) == [".hidden/y.md", "_x/__init__.py", "a/far.md", "main.rs", "pruned/lib.js", "src/app.ts", "src/deep/er/x.py"]
    assert listed(root / "none") == listed(root / "node_modules") == []
    rows = read_workspace(spark, str(root), env_files=True).collect()
    assert len(rows) == 8 and {r["content"] for r in rows} == {"caf\ufffd", "far"} and all(r["error"] is None for r in rows)


def test_engine(spark, tmp_path):
    root = tmp_path / "work"
    root.mkdir()
    (root / "a.rs").write_text('pub fn fetch_rates() {\n  let x = env::var("API_URL");\n}\n')
    (root / "b.md").write_text("# Rates\nhow to fetch currency rates\n")
    (root / ".env").write_text("API_URI=1\n")
    e = Engine(spark, str(tmp_path / "store"), str(root))
    assert e.index() == {"total_files": 2, "indexed": 2, "skipped": 0, "errors": 0, "nodes_created": 4}
    assert e.index()["skipped"] == 2
    top = e.search("fetch_rates")["pointers"][0]
    assert top["chunk"] == "fetch_rates" and top["lines"] == "1-3"
    assert e.fetch(top["id"])["content"].startswith("pub fn fetch_rates")
    assert e.validate_env("API_URI") == {"valid": True, "suggestions": []}
    assert e.check_consistency()["unknown"] == [{"variable": "API_URL", "suggestion": "API_URI"}]
    assert len(e.neighbors(top["id"]).collect()) == 1
    (root / "a.rs").write_text("pub fn other() {\n}\n")
    (root / "b.md").unlink()
    assert e.index() == {"total_files": 1, "indexed": 1, "skipped": 0, "errors": 0, "nodes_created": 2}
    assert {r["name"] for r in e.store.read("nodes").collect()} == {str(root / "a.rs"), "other"}
    (root / "b.md").write_text("# Rates\nhow to fetch currency rates\n")
    assert e.index()["indexed"] == 1
    done = e.add_fact("decision", "use rates")
    e.invalidate_fact(done["id"])
    assert e.facts().count() == 0
    assert e.stats("24h")["cumulative"]["total_queries"] == 2
    for bad in (lambda: e.search(" "), lambda: e.fetch(""), lambda: e.add_fact("", "x"), lambda: e.validate_env("")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(LookupError):
        e.fetch("nothing")


def test_cache():
    c = TimedCache(2, 60)
    for k in "abc":
        c.put(k, k)
    assert c.get("a") is None and c.get("c") == "c"
    c.clear()
    assert c.get("c") is None
    old = TimedCache(2, 0)
    old.put("a", 1)
    assert old.get("a") is None


def test_store_with_two_writers(spark, tmp_path):
    stores = [Store(spark, str(tmp_path)) for _ in range(2)]

    def write(k):
        for i in range(4):
            stores[k].append("accounting", [(f"{k}-{i}", "p", "s", "q", 1, 0, 15, dt.datetime(2024, 1, 1))])

    threads = [threading.Thread(target=write, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {r["id"] for r in stores[0].read("accounting").collect()} == {f"{k}-{i}" for k in range(2) for i in range(4)}


def test_stored_index_follows_changes(spark, tmp_path):
    root = tmp_path / "work"
    root.mkdir()
    (root / "a.md").write_text("# Tides\nspring tide tables for the harbour\n")
    (root / "b.md").write_text("# Moon\nmoon and tide\n")
    e = Engine(spark, str(tmp_path / "store"), str(root))
    e.index()
    found = lambda q: {r["id"] for r in e._full_text(q).collect()}
    names = {r["id"]: r["file_path"][-4:] for r in e.store.read("nodes").collect()}
    assert {names[i] for i in found("spring tide")} == {"a.md", "b.md"}  # fewer than three phrase hits: any word counts
    assert {names[i] for i in found("harbour")} == {"a.md"}
    (root / "a.md").unlink()
    e.index()
    assert found("harbour") == set() and {names[i] for i in found("tide")} == {"b.md"}


def test_block_ends_against_a_scan_from_each_start():
    rng = random.Random(4)
    for _ in range(200):
        lines = ["".join(rng.choices("{}x ", k=rng.randint(0, 4))) for _ in range(rng.randint(1, 30))]
        starts = sorted(rng.choices(range(len(lines)), k=rng.randint(1, 10)))
        want = []
        for s in starts:
            depth, opened, end = 0, False, min(s + 1, len(lines) - 1)
            for i in range(s, len(lines)):
                opened = opened or "{" in lines[i]
                depth += lines[i].count("{") - lines[i].count("}")
                if opened and depth <= 0:
                    end = i
                    break
            want.append(end)
        assert chunking.block_ends(lines, starts) == want


def test_unchanged_chunks_keep_their_index(spark, tmp_path):
    root = tmp_path / "work"
    root.mkdir()
    (root / "a.rs").write_text("fn tide() {\n  ebb();\n}\nfn moon() {\n  full();\n}\n")
    e = Engine(spark, str(tmp_path / "store"), str(root))
    assert e.index()["nodes_created"] == 3
    (root / "a.rs").write_text("// new line\nfn tide() {\n  ebb();\n}\nfn moon() {\n  waning();\n}\n")
    assert e.index()["nodes_created"] == 2  # the file and one function
    assert {(r["name"], r["start_line"]) for r in e.store.read("nodes").where("node_type = 'function'").collect()} == {("tide", 2), ("moon", 5)}
    assert e.store.read("fts").count() == 3 and e.store.read("edges").count() == 2
    terms = {r["term"]: r["df"] for r in search.added_counts(e.store.read("fts_terms")).collect()}
    assert terms["waning"] == 2 and terms["full"] == 0 and terms[""] == e.store.read("fts_docs").count() == 3


def test_near_pairs_are_all_pairs(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(7)
    names = {"".join(rng.choices("AB_", k=rng.randint(0, 9))) for _ in range(60)} | {"TIDE_URL", "TIDE_URI", "TIDES_UL", "EDIT_URL", "", "A"}
    known = {"".join(rng.choices("AB_", k=rng.randint(0, 12))) for _ in range(60)} | {"TIDE_URL", "TIE_URL", "XTIDE_URLYZ", "", "AB"}
    df = lambda xs, c: spark.createDataFrame([(x,) for x in sorted(xs)], f"{c} string")
    for near in (1, 3):
        got = {tuple(r) for r in envscan.near_pairs(df(names, "variable"), df(known, "key"), near).collect()}
        assert got == {(a, b, d) for a in names for b in known if (d := edits(a, b)) <= near}
