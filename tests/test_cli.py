import io
import json
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarryline.api import Engine
from quarryline.cli import main, respond, serve
from quarryline.streaming.reports import windowed_stats


def test_rpc(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), str(tmp_path), project="p")
    ask = lambda method, **params: respond(e, json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}))
    assert ask("initialize")["result"]["serverInfo"]["name"] == "quarryline"
    assert len(ask("tools/list")["result"]["tools"]) == 8
    assert ask("nope")["error"]["code"] == -32603
    assert respond(e, "{")["error"]["code"] == -32700
    assert ask("notifications/initialized") is None
    assert ask("tools/call", name="search", arguments={"query": ""})["error"]["code"] == -32603
    assert json.loads(ask("tools/call", name="fact", arguments={"fact_type": "learning", "content": "x"})["result"]["content"][0]["text"])["status"] == "recorded"
    assert len(json.loads(ask("tools/call", name="facts")["result"]["content"][0]["text"])) == 1
    out = io.StringIO()
    serve(e, io.StringIO('{"id": 2, "method": "tools/list"}\n\n{"method": "notifications/x"}\n'), out, every=0)
    assert len(out.getvalue().splitlines()) == 1


def test_main(spark, tmp_path, capsys):
    root = tmp_path / "work"
    root.mkdir()
    (root / "a.rs").write_text("pub fn load_tides() {\n  let x = std::env::var(\"TIDE_URL\");\n}\n")
    (root / ".env").write_text("TIDE_URI=1\n")

    def run(*argv):
        assert main(["--store", str(tmp_path / "store"), "--root", str(root), *argv]) == 0
        return json.loads(capsys.readouterr().out)

    assert run("index")["nodes_created"] == 2
    top = run("search", "load_tides")["pointers"][0]
    assert top["chunk"] == "load_tides"
    assert run("fetch", top["id"])["content"].startswith("pub fn load_tides")
    assert run("fact", "decision", "tides first")["status"] == "recorded" and [f["content"] for f in run("facts", "decision")] == ["tides first"]
    assert run("validate_env", "TIDE_URX") == {"valid": False, "suggestions": ["TIDE_URI", "TIDE_URL"]}
    assert run("check_consistency")["unknown"] == [{"variable": "TIDE_URL", "suggestion": "TIDE_URI"}]
    assert run("stats", "--since", "24h")["cumulative"]["total_queries"] == 2


def test_reindex_every(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), str(tmp_path), project="p")
    seen = []
    e.index = lambda: seen.append(1)
    assert e.reindex_every(0) is None
    stop = e.reindex_every(0.05)
    time.sleep(0.4)
    stop.set()
    assert seen


def test_stream(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [("p", 10, 0, 150, at + timedelta(hours=h)) for h in (0, 5, 30)]
    spark.createDataFrame(rows, "project_id string, pointer_tokens long, fetched_tokens long, traditional_est long, created_at timestamp").write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "log")).schema).parquet(str(tmp_path / "log"))
    q = windowed_stats(stream).writeStream.outputMode("complete").format("memory").queryName("spans").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["total_queries"] for r in spark.table("spans").collect()) == [1, 2]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_operator_of_the_engine_runs(spark):
    for name in ("literal_prefix", "stats_since", "neighbors", "supersede", "chunk_code"):
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").select(F.lit(1)).count() > 0
