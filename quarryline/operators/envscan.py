"""Environment variables: where texts define or use them, and what does not fit together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names that are never a project's own.
WHITELIST = (
    "CI", "TF_BUILD", "BUILD_BUILDID", "BUILD_SOURCEBRANCH", "PLAYWRIGHT_BASE_URL", "LOCALAPPDATA", "APPDATA", "PROGRAMFILES",
    "COMPUTERNAME", "USERNAME", "USERPROFILE", "SYSTEMROOT", "TEMP", "TMP", "PORT", "HOST", "KV_REST_API_URL", "KV_REST_API_TOKEN",
    "UPSTASH_REDIS_REST_URL", "UPSTASH_REDIS_REST_TOKEN",
)

_NAME = "[A-Z_][A-Z0-9_]*"
_JS = ("js", "ts", "jsx", "tsx")
#: What counts as a definition or a use, as (language, defines, pattern, groups).  `(?dm)`: only a newline ends a line.  Python: getenv(, environ.get( and environ[.
PATTERNS = (
    ("env", True, rf"(?dm)^\s*({_NAME})\s*=", (1,)),
    ("yaml", True, rf"(?dm)^\s*-\s*({_NAME})(?:\s*[:=]|\s*$)", (1,)),
    ("markdown", True, rf"\|\s*`?({_NAME})`?\s*\|", (1,)),
    ("python", False, r"""(?:getenv\(|environ\.get\(|environ\[)\s*['"]([^'"\]\)]+)['"]""", (1,)),
    ("javascript", False, rf"""process\.env(?:\.({_NAME})|\[\s*['"]([^'"]+)['"]\s*\])""", (1, 2)),
    ("rust", False, r"""env::var\(['"]([^'"]+)['"]\)""", (1,)),
    ("shell", False, rf"\$\{{?({_NAME})\}}?", (1,)),
)
#: Fixed value: the environment taken apart in a script.
_TAKEN_APART = r"\{([^}]*)\}\s*=\s*process\.env\b"
#: Suggestions at most, and the greatest distance at which an unknown name is taken for a defined one.
SUGGESTIONS, NEAR = 5, 3


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def _applies(language: str, ext: Column, base: Column) -> Column:
    return {
        "env": base.startswith(".env"), "yaml": ext.isin("yaml", "yml"), "markdown": ext == "md", "python": ext == "py",
        "javascript": ext.isin(*_JS), "rust": ext == "rs", "shell": ext.isin("sh", "bash", "zsh"),
    }[language]


def scan(files: DataFrame) -> DataFrame:
    """name, file_path, is_definition for every finding in rows (path, content).  One pass: each file yields one array."""
    ext, base, content = extension(F.col("path")), F.substring_index("path", "/", -1), F.coalesce(F.col("content"), F.lit(""))
    none = F.array().cast("array<struct<name: string, is_definition: boolean>>")
    as_hits = lambda names, defines: F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(defines).alias("is_definition")))
    found = none
    for language, defines, pattern, groups in PATTERNS:
        for g in groups:
            names = F.regexp_extract_all(content, F.lit(pattern), F.lit(g))
            found = F.concat(found, F.when(_applies(language, ext, base), as_hits(names, defines)).otherwise(none))
    items = F.flatten(F.transform(F.regexp_extract_all(content, F.lit(_TAKEN_APART), F.lit(1)), lambda x: F.split(x, ",")))
    keys = F.filter(F.transform(items, lambda i: F.trim(F.regexp_extract(i, r"^([^:=]*)", 1), F.lit(" \t\r\n"))), lambda k: k.rlike(r"^[\p{Lu}\p{N}_]+$"))
    found = F.concat(found, F.when(ext.isin(*_JS), as_hits(keys, False)).otherwise(none))
    rows = files.select(F.col("path").alias("file_path"), F.inline(found))
    return rows.where((F.col("name") != "") & ~F.col("name").isin(*WHITELIST)).select("name", "file_path", "is_definition")


def registry(hits: DataFrame, project: str) -> DataFrame:
    """A project's registry: each name, whether it is defined anywhere, whether it is used anywhere."""
    merged = hits.groupBy(F.col("name").alias("key")).agg(F.bool_or("is_definition").alias("is_defined"), F.bool_or(~F.col("is_definition")).alias("is_used"))
    return merged.select(F.lit(project).alias("project_id"), "key", "is_defined", "is_used", F.current_timestamp().alias("created_at"))


def suggestions(keys: DataFrame, name: str, limit: int = SUGGESTIONS) -> DataFrame:
    """key, dist of the known keys nearest to a name."""
    return keys.select("key").distinct().select("key", F.levenshtein(F.lit(name), F.col("key")).alias("dist")).orderBy("dist", "key").limit(limit)


def validations(keys: DataFrame, names: list[str], limit: int = SUGGESTIONS) -> DataFrame:
    """name, valid, near for each of some names: whether it is known and, if not, the known keys nearest to it.  One pass over the keys; a task passes on
    `limit` of them a name."""
    asked = keys.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
    each = keys.select("key").distinct().select("key", F.explode(F.array(*(F.lit(n) for n in dict.fromkeys(names)))).alias("name")).withColumn("dist", F.levenshtein("name", "key"))
    best = each.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("dist", "key"))).where(F.col("r") <= limit)
    found = best.groupBy("name").agg((F.min("dist") == 0).alias("valid"), F.sort_array(F.collect_list(F.struct("dist", "key"))).alias("best"))
    near = F.when(F.col("valid"), F.array().cast("array<string>")).otherwise(F.coalesce(F.col("best.key"), F.array().cast("array<string>")))
    return asked.join(found, "name", "left").select("name", F.coalesce("valid", F.lit(False)).alias("valid"), near.alias("near"))


def validate(keys: DataFrame, name: str) -> tuple[bool, list[str]]:
    """Whether a name is known and, if not, what it may have meant."""
    r = validations(keys, [name]).first()
    return r["valid"], r["near"]


def classify(reg: DataFrame) -> DataFrame:
    """key, class: unknown (used, not defined), unused (defined, not used) or consistent (anything else)."""
    kind = F.when(~F.col("is_defined") & F.col("is_used"), "unknown").when(F.col("is_defined") & ~F.col("is_used"), "unused").otherwise("consistent")
    return reg.select("key", "is_defined", kind.alias("class"))


def keys_of(reg: DataFrame, kind: str) -> DataFrame:
    """The keys of a class, in order."""
    return classify(reg).where(F.col("class") == kind).select("key").orderBy("key")


def _cuts(length: Column, pieces: int) -> Column:
    """(piece, start, size) of the parts of a name of this length, which differ in size by one at most; starts count from one."""
    size, longer = F.floor(length / pieces), length % pieces

    def cut(i: Column) -> Column:
        more = F.greatest(i - (F.lit(pieces) - longer), F.lit(0))  # the last ones are longer
        return F.struct(i.alias("piece"), (i * size + more + 1).cast("int").alias("start"), (size + F.when(i >= F.lit(pieces) - longer, 1).otherwise(0)).cast("int").alias("size"))

    return F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), cut)


def near_pairs(names: DataFrame, known: DataFrame, near: int = NEAR) -> DataFrame:
    """variable, key, dist of every pair within `near` edits.

    A known key is cut into near + 1 parts.  So many edits cannot touch all of them, so one stands whole in the variable, at most `near` places
    off.  Parts are joined with the variable's pieces of their size and place: an equi-join on length, part and content, whose candidates
    are verified.  No length or other hot key meets as a whole, but for keys of `near` characters at most, of which some parts are empty.
    """
    pieces = near + 1
    held = known.select("key", F.length("key").alias("length")).select("key", "length", F.inline(_cuts(F.col("length"), pieces)))
    held = held.select("key", "length", "piece", F.substr("key", "start", "size").alias("part"))
    lengths = F.sequence(F.greatest(F.length("variable") - near, F.lit(0)), F.length("variable") + near)
    asked = names.select("variable", F.explode(lengths).alias("length")).select("variable", "length", F.inline(_cuts(F.col("length"), pieces)))
    last = F.length("variable") - F.col("size") + 1
    starts = F.sequence(F.greatest(F.col("start") - near, F.lit(1)), F.least(F.col("start") + near, last))
    asked = asked.where((last >= 1) & (F.greatest(F.col("start") - near, F.lit(1)) <= F.least(F.col("start") + near, last)))
    asked = asked.select("variable", "length", "piece", "size", F.explode(starts).alias("at")).select("variable", "length", "piece", F.substr("variable", "at", "size").alias("part")).distinct()
    found = asked.join(held, ["length", "piece", "part"]).select("variable", "key").distinct()
    return found.withColumn("dist", F.levenshtein(F.col("variable"), F.col("key"), near)).where("dist >= 0")


def nearest_defined(reg: DataFrame, near: int = NEAR) -> DataFrame:
    """variable, suggestion: every unknown key, and the defined key within `near` edits that is nearest, then first; or null."""
    kinds = classify(reg)
    unknown = kinds.where(F.col("class") == "unknown").select(F.col("key").alias("variable"))
    best = near_pairs(unknown, kinds.where("is_defined").select("key"), near).groupBy("variable").agg(F.min(F.struct("dist", "key")).alias("m"))
    return unknown.join(best, "variable", "left").select("variable", F.col("m.key").alias("suggestion"))


def consistency(reg: DataFrame) -> DataFrame:
    """One row: the three counts and the status."""
    kinds = classify(reg)
    n = {c: F.count_if(F.col("class") == c) for c in ("unknown", "unused", "consistent")}
    return kinds.agg(*(v.alias(k) for k, v in n.items())).withColumn("status", F.when((F.col("unknown") == 0) & (F.col("unused") == 0), "clear").otherwise("issues_found"))
