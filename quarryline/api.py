"""The engine: one method for each thing a client can ask."""

from __future__ import annotations

import datetime as dt
import threading
import time
from collections import OrderedDict
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import accounting, envscan, graph, ingest, search, temporal
from quarryline.sources.store import Snapshot, Store
from quarryline.sources.workspace import read_files


class TimedCache:
    """Keeps at most `size` answers for at most `ttl` seconds; when full, the expired ones go, then the oldest."""

    def __init__(self, size: int, ttl: float | None = None):
        self.size, self.ttl, self.held, self.lock = size, ttl, OrderedDict(), threading.Lock()

    def get(self, key):
        with self.lock:
            at, value = self.held.get(key, (0.0, None))
            return value if value is not None and (self.ttl is None or time.monotonic() - at < self.ttl) else None

    def put(self, key, value) -> None:
        with self.lock:
            self.held.pop(key, None)
            if len(self.held) >= self.size:
                now = time.monotonic()
                for k in [k for k, (at, _) in self.held.items() if self.ttl is not None and now - at >= self.ttl]:
                    del self.held[k]
                if len(self.held) >= self.size:
                    self.held.popitem(last=False)
            self.held[key] = (time.monotonic(), value)

    def clear(self) -> None:
        with self.lock:
            self.held.clear()


class Engine:
    """A project in a store.  Answers are plain dicts and lists; every one of them is small."""

    def __init__(self, spark: SparkSession, store: str, root: str = ".", project: str | None = None, session: str | None = None):
        self.spark, self.store, self.root = spark, Store(spark, store), root
        self.project = project or Path(root).resolve().name
        self.session = session or dt.date.today().isoformat()
        self.searches, self.fetches = TimedCache(256, 60.0), TimedCache(50)

    # Searching

    def _full_text(self, query: str, now: Snapshot | None = None) -> DataFrame:
        now = now or self.store.snapshot()
        return search.fts_search_stored(now.read("fts_postings"), now.read("fts_docs"), now.read("fts_terms"), query, self.project)[1]

    def _forget(self) -> None:
        self.searches.clear()
        self.fetches.clear()

    def search(self, query: str, top_k: int = search.TOP_K) -> dict:
        if not query.strip():
            raise ValueError("query must not be empty")
        key = (query.strip().lower(), top_k)
        answer = self.searches.get(key)
        if answer is None:
            with self.store.lease() as now:
                literal = search.literal_search_stored(now.read("names", self.project), now.read("name_grams", self.project), query, self.project)
                near = lambda: search.vector_search_stored(now.read("vector_lists", self.project), now.read("vector_docs", self.project), query, self.project)
                best = self.spark.createDataFrame(search.cascade(literal, lambda: self._full_text(query, now), near, top_k).collect(), "id string, score double, tier string")  # top_k rows
                found = search.pointers(best, graph.rows_of(now.read("nodes", self.project), "id", best))
                rows = [r.asDict() for r in found.orderBy(F.desc(F.round("relevance", 9)), "id").collect()]
            tokens = sum(r.pop("tokens") for r in rows)
            answer = {"pointers": rows, "accounting": report(tokens, 0)}
            self.searches.put(key, answer)
        self._record(query, answer["accounting"]["pointer_tokens"], 0, answer["accounting"]["traditional_rag_estimate"])
        return answer

    def fetch(self, node_id: str) -> dict:
        if not node_id.strip():
            raise ValueError("node_id must not be empty")
        answer = self.fetches.get(node_id)
        if answer is None:
            node = graph.get_node(self.store.read("nodes", self.project), node_id, self.project).first()
            if node is None:
                raise LookupError(f"node not found: {node_id}")
            one = self.spark.createDataFrame([(node_id, node["file_path"], node["start_line"], node["end_line"])], "id string, file_path string, start_line long, end_line long")
            part = search.fetched(one, read_files(one.where("file_path <> ''").select(F.col("file_path").alias("path")))).first()  # a task reads the file, the driver gets the lines
            answer = {"pointer_id": node_id, "content": part["content"], "file_path": node["file_path"] or "", "start_line": node["start_line"] or 0, "end_line": node["end_line"] or 0, "token_count": part["token_count"]}
            self.fetches.put(node_id, answer)
        self._record(node_id, 0, answer["token_count"], answer["token_count"] * X.TRADITIONAL_FACTOR)
        return answer

    # Indexing

    def index(self) -> dict:
        done = ingest.ingest(self.store, self.root, self.project)
        self._forget()
        self.store.vacuum()
        return asdict(done)

    def vacuum(self) -> dict:
        return {"folders_removed": self.store.vacuum()}

    def reindex_every(self, seconds: float = 300.0) -> threading.Event | None:
        """Index again and again in the background until the returned event is set; 0 means never."""
        if seconds <= 0:
            return None
        stop = threading.Event()

        def loop() -> None:
            while not stop.wait(seconds):
                self.index()

        threading.Thread(target=loop, daemon=True).start()
        return stop

    # Accounting

    def _record(self, query: str, pointer: int, fetched: int, traditional: int) -> None:
        now = dt.datetime.now(dt.timezone.utc)
        self.store.append("accounting", [(time.time_ns(), self.project, self.session, query, pointer, fetched, traditional, now)], self.project)

    def stats(self, since: str | None = None) -> dict:
        log = self.store.snapshot()
        seconds = X.parse_since(since) if since else None
        now = F.current_timestamp()
        zone = self.spark.conf.get("spark.sql.session.timeZone")
        reports = {
            "session": accounting.stored_stats(log, self.project, session=self.session),
            "today": accounting.stored_stats(log, self.project, day=F.to_date(F.from_utc_timestamp(now, zone)), zone=zone),
            "cumulative": accounting.stored_stats(log, self.project, since=accounting.seconds_ago(now, seconds) if seconds else None),
        }
        out: dict = {"project_id": self.project, "since_filter": since}
        for name, df in reports.items():
            r = df.first()
            out[name] = {
                "total_queries": r["total_queries"], "pointer_tokens_used": r["total_pointer_tokens"], "fetched_tokens_used": r["total_fetched_tokens"],
                "traditional_rag_estimate": r["total_traditional_estimate"], "actual_tokens_total": r["total_pointer_tokens"] + r["total_fetched_tokens"],
                "tokens_saved": r["cumulative_savings_tokens"], "savings_pct": f"{r['cumulative_savings_pct']:.1f}%",
            }
        return out

    # Facts

    def add_fact(self, fact_type: str, content: str, node_id: str | None = None, source: str | None = None) -> dict:
        if not fact_type.strip() or not content.strip():
            raise ValueError("fact_type and content must not be empty")
        one = self.spark.createDataFrame([(fact_type, content, node_id, source)], "fact_type string, content string, node_id string, source_reference string")
        rows = temporal.fact_rows(one, self.project, F.lit(dt.datetime.now(dt.timezone.utc)))
        self.store.append("temporal_facts", rows, self.project)
        return {"id": rows.first()["id"], "status": "recorded"}

    def invalidate_fact(self, fact_id: str, superseded_by: str | None = None) -> None:
        ended = self.spark.createDataFrame([(fact_id, self.project, superseded_by)], "id string, project_id string, superseded_by string")
        self.store.update(lambda now: temporal.invalidation(now, self.project, ended))

    def facts(self, fact_type: str | None = None) -> DataFrame:
        return temporal.active_facts(self.store.read("temporal_facts", self.project), self.project, fact_type)

    def fact_history(self, node_id: str) -> DataFrame:
        return temporal.fact_history(self.store.read("temporal_facts", self.project), node_id, self.project)

    # Environment variables

    def _registry(self) -> DataFrame:
        return self.store.read("config_registry", self.project).where(F.col("project_id") == self.project)

    def validate_env(self, env_var: str) -> dict:
        if not env_var.strip():
            raise ValueError("env_var must not be empty")
        valid, near = envscan.validate(self._registry(), env_var)
        return {"valid": valid, "suggestions": near}

    def check_consistency(self) -> dict:
        reg = self._registry()
        r = envscan.consistency(reg).first()
        keys = lambda c: [k["key"] for k in envscan.keys_of(reg, c).collect()]  # noqa: E731  a project's variables
        unknown = [x.asDict() for x in envscan.nearest_defined(reg).orderBy("variable").collect()]
        return {"status": r["status"], "summary": {k: r[k] for k in ("unknown", "unused", "consistent")}, "unknown": unknown, "unused": keys("unused"), "consistent": keys("consistent")}

    # Graph

    def neighbors(self, node_id: str) -> DataFrame:
        now = self.store.snapshot()
        return graph.neighbors_stored(now.read("edges", self.project), now.read("edges_in", self.project), now.read("nodes"), node_id, self.project)


def report(pointer: int, fetched: int) -> dict:
    traditional = pointer * X.TRADITIONAL_FACTOR
    total = pointer + fetched
    return {"pointer_tokens": pointer, "fetched_tokens": fetched, "total_tokens": total, "traditional_rag_estimate": traditional, "savings_pct": max((1 - total / traditional) * 100, 0.0) if traditional else 0.0}
