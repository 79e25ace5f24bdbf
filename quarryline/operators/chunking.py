"""Files into chunks: whole files and Markdown sections as column expressions, code items by a per-file scan of its lines."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators.envscan import extension

SCHEMA = "path string, ordinal long, name string, node_type string, content string, start_line long, end_line long, summary string"
SCRIPT = ("tsx", "ts", "jsx", "js")
#: A first line longer than this many bytes is not a summary.
SUMMARY_BYTES = 80

_IDENT = r"[^\W\d][\w]*"
_RUST = re.compile(rf"(?:pub )?(?:(?:async )?(fn)|(struct|enum|trait)) \s*({_IDENT})|(impl) (.*)")
_RUST_KIND = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "impl": "impl"}
_SCRIPT_START = re.compile(r"(?:export )?(?:function|const) |export default (?:function|class) ")
_SCRIPT_NAME = re.compile(r"(?:function|const|class) \s*([\w$]+)")


def lines_of(text: str) -> list[str]:
    lines = [v.removesuffix("\r") for v in text.split("\n")]
    return lines[:-1] if lines[-1] == "" else lines


def block_ends(lines: list[str], starts: list[int]) -> list[int]:
    """For each start the first line at which a brace has been opened and all since are closed; else the next line.

    One pass: depth is the running sum of braces.  A start is open from the first line with a brace on, and ends where the depth falls back
    to what it was before the start; of the open ones those with the greatest depth before them end first.
    """
    last = len(lines) - 1
    out = [min(s + 1, last) for s in starts]
    waiting: dict[int, list[int]] = {}
    next_open, by_line = None, {s: [] for s in starts}
    for k, s in enumerate(starts):
        by_line[s].append(k)
    for i in range(last, -1, -1):
        if "{" in lines[i]:
            next_open = i
        if next_open is not None:
            waiting.setdefault(next_open, []).extend(by_line.get(i, ()))
    depth, before, open_ = 0, {}, []
    for i, line in enumerate(lines):
        for k in by_line.get(i, ()):
            before[k] = depth
        depth += line.count("{") - line.count("}")
        for k in waiting.get(i, ()):
            heapq.heappush(open_, (-before[k], k))
        while open_ and -open_[0][0] >= depth:
            out[heapq.heappop(open_)[1]] = i
    return out


def _rust_item(line: str) -> tuple[str, str] | None:
    m = _RUST.match(line)
    if not m:
        return None
    if m[4]:
        target = m[5].partition("{")[0].split("for ")[-1].strip()
        name = re.match(r"[\w:]+", target)
        return (name[0], "impl") if name else None
    return m[3], _RUST_KIND[m[1] or m[2]]


def code_chunks(ext: str, text: str) -> list[tuple[str, str, str, int, int, str]]:
    """(name, type, content, first line, last line, summary) of the items of a Rust or script file; nested items overlap."""
    lines = lines_of(text)
    found: list[tuple[int, str, str, str]] = []
    for i, line in enumerate(lines):
        bare = line.strip()
        if ext == "rs":
            if item := _rust_item(bare):
                name, kind = item
                found.append((i, name, kind, f"{kind}: {bare if len(bare.encode()) <= SUMMARY_BYTES else name}"))
        elif (m := _SCRIPT_START.match(bare)) and (bare.startswith("export default ") or "=>" in bare or "(" in bare):
            m = _SCRIPT_NAME.search(bare)
            name = m[1] if m else f"anonymous_{i}"
            found.append((i, name, "function", f"TypeScript function: {name}"))
    ends = block_ends(lines, [f[0] for f in found])
    return [(name, kind, "\n".join(lines[i : end + 1]), i + 1, end + 1, summary) for (i, name, kind, summary), end in zip(found, ends, strict=True)]


def _code(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        names = ["path", "ordinal", "name", "node_type", "content", "start_line", "end_line", "summary"]
        for batch in batches:
            rows = [(path, n, *c) for path, ext, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for n, c in enumerate(code_chunks(ext, text or ""))]
            columns = zip(*rows, strict=True) if rows else ((),) * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return files.select("path", "ext", "content").mapInArrow(run, SCHEMA)


def markdown_sections(files: DataFrame) -> DataFrame:
    """A chunk for each # or ## heading, up to the line before the next."""
    lines = files.select("path", X.line_array(F.col("content")).alias("lines"))
    numbers = F.filter(F.transform("lines", lambda v, i: F.when(v.startswith("# ") | v.startswith("## "), i)), lambda i: i.isNotNull())
    starts = lines.select("path", "lines", numbers.alias("at")).select("path", "lines", "at", F.posexplode("at").alias("ordinal", "start"))
    end = F.coalesce(F.get("at", F.col("ordinal") + 1), F.size("lines"))
    heading = F.trim(F.regexp_replace(F.get("lines", F.col("start")), "^#+", ""))
    content = F.array_join(F.slice("lines", F.col("start") + 1, end - F.col("start")), "\n")
    return starts.select("path", F.col("ordinal").cast("long").alias("ordinal"), heading.alias("name"), F.lit("document").alias("node_type"), content.alias("content"), (F.col("start") + 1).cast("long").alias("start_line"), end.cast("long").alias("end_line"), heading.alias("summary"))


def whole_files(files: DataFrame) -> DataFrame:
    name = F.substring_index("path", "/", -1)
    return files.select("path", F.lit(0).cast("long").alias("ordinal"), name.alias("name"), F.lit("file").alias("node_type"), "content", F.lit(1).cast("long").alias("start_line"), X.count_lines(F.col("content")).alias("end_line"), F.concat(F.lit("File: "), name).alias("summary"))


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks of rows (path, content) by extension: Rust items, script functions, Markdown sections, else the whole file."""
    typed = files.withColumn("ext", extension(F.col("path")))
    code, script = F.col("ext") == "rs", F.col("ext").isin(*SCRIPT)
    return _code(typed.where(code | script)).unionByName(markdown_sections(typed.where("ext = 'md'"))).unionByName(whole_files(typed.where(~(code | script | (F.col("ext") == "md")))))
