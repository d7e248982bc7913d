"""Queries that go through files: each writes its tables as the files a source reads, in the shared scratch folder, and reads them back."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from loomlog.functions import text as X
from loomlog.operators import sequences as Q
from loomlog.operators.folds import ordered_sha256
from loomlog.sinks import archives, files
from loomlog.sources import catalogs, exports, lines
from loomlog.sources.tables import table
from loomlog.storage import materialize, scratch_path

#: Rows of a database or list file; messages of an exported conversation; conversations of a shard; bytes of an archive part.
FILE_ROWS, CONVERSATION, SHARD, CAP = 10_000, 200, 50, 256 << 10


def _publish(rows: DataFrame, name: str) -> str:
    """Writes (path, data) rows below a new scratch folder and returns it."""
    root = scratch_path(rows.sparkSession, name)
    materialize(files.publish(rows, root), "published")
    return root


def _compressed(rows: DataFrame) -> DataFrame:
    """Data of paths that end in .zst as two zstd frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for b in batches:
            out = []
            for path, data in zip(b.column("path").to_pylist(), b.column("data").to_pylist()):
                half = len(data) // 2
                frames = lambda d: zstandard.ZstdCompressor().compress(d[:half]) + zstandard.ZstdCompressor().compress(d[half:])  # noqa: E731, B023
                out.append(frames(data) if path.endswith(".zst") else data)
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.binary())], names=["path", "data"])

    return rows.mapInArrow(run, "path string, data binary")


def _log_files(spark: SparkSession, folder: str) -> str:
    """Each archive member as a log file: every third is archived, every second compressed, every fifth there in both forms."""
    rows = table(spark, folder, "archive_members")
    home = F.when(F.col("member_id") % 3 == 0, "archived_sessions").otherwise("sessions")
    plain = F.concat(home, F.lit("/rollout-"), F.col("session_id"), F.lit("-"), "member_id", F.lit(".jsonl"))
    paths = F.when(F.col("member_id") % 5 == 0, F.array(plain, F.concat(plain, F.lit(".zst")))).when(F.col("member_id") % 2 == 0, F.array(F.concat(plain, F.lit(".zst")))).otherwise(F.array(plain))
    data = F.encode(F.coalesce("body", F.lit("")), "utf-8")
    return _publish(_compressed(rows.select(F.explode(paths).alias("path"), data.alias("data"))), "logs")


def _member(path: str):
    return F.regexp_extract(path, r"-(\d+)\.jsonl(?:\.zst)?$", 1).cast("bigint")


def scan_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every log file, plain or compressed, with its byte range."""
    rows = lines.read_lines(spark, files.local_path(_log_files(spark, folder)))
    return rows.select(_member("path").alias("member_id"), F.col("path").endswith(".zst").alias("compressed"), "line_no", "byte_start", "byte_end", F.sha2("raw", 256).alias("sha256"))


def session_files(spark: SparkSession, folder: str) -> DataFrame:
    """Log files below a home folder with what their paths say, and which of several forms of one counts: the plain one."""
    found = lines.discover(spark, _log_files(spark, folder))
    best = lines.best_files(found.withColumn("key", _member("path")), "key").select(F.col("path").alias("b"))
    rows = found.join(best, F.col("path") == F.col("b"), "left")
    return rows.select(_member("path").alias("member_id"), "session_id", "archived", "compressed", F.col("b").isNotNull().alias("best"))


def _sqlite(rows: DataFrame) -> DataFrame:
    """One SQLite database for each bucket of catalog rows, as (path, data)."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        con = sqlite3.connect(":memory:")
        con.execute("CREATE TABLE threads (id TEXT, cwd TEXT, title TEXT, archived INTEGER, project_id TEXT)")
        con.execute("CREATE TABLE aliases (thread_id TEXT, name TEXT)")
        given = sorted(zip(*(t[c].to_pylist() for c in ("session_id", "cwd", "title", "archived", "project_id"))), key=lambda r: r[0])
        con.executemany("INSERT INTO threads VALUES (?, ?, ?, ?, ?)", given)
        con.executemany("INSERT INTO aliases VALUES (?, ?)", [(r[0], f"alias of {r[0]}") for r in given])
        con.commit()
        return pa.table({"path": [f"db-{key[0].as_py():06d}.sqlite"], "data": pa.array([con.serialize()], pa.binary())})

    return rows.groupBy("bucket").applyInArrow(run, "path string, data binary")


def _bucketed(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.crc32(F.encode(key, "utf-8")), F.lit(max(1, rows.count() // FILE_ROWS + 1))).cast("bigint"))


def _databases(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "session_catalog").where("session_id is not null")
    return catalogs.database_files(spark, f"{_publish(_sqlite(_bucketed(rows, 'session_id')), 'databases')}/*.sqlite")


def catalog_databases(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog out of SQLite files; a database has only some of the columns."""
    return catalogs.read_databases(_databases(spark, folder)).select("session_id", "cwd", "title", "archived", "project_id", "rollout_path")


def database_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles out of any table of the SQLite files that has them; the first table wins."""
    return catalogs.database_titles(_databases(spark, folder))


def renamed_titles(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog's titles, overridden by the last rename in an append-only file."""
    rows = table(spark, folder, "session_catalog").where("session_id is not null").select("session_id", "title")
    renamed = rows.where(F.substring("session_id", 1, 1).isin(*"02468ace")).withColumn("order", F.explode(F.array(F.lit(1), F.lit(2))))
    line = F.when(F.col("order") == 1, F.to_json(F.struct(F.col("session_id").alias("id"), F.lit("draft").alias("title")))).otherwise(F.to_json(F.struct("session_id", F.concat(F.lit("renamed "), F.col("session_id")).alias("thread_name"))))
    parts = _bucketed(renamed.withColumn("line", line), "session_id").groupBy("bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "line"))), lambda x: x["line"]), "\n").alias("text"))
    root = _publish(parts.select(F.format_string("index-%06d.jsonl", "bucket").alias("path"), F.encode("text", "utf-8").alias("data")), "renames")
    last = catalogs.latest_titles(lines.read_lines(spark, files.local_path(root))).select(F.col("session_id").alias("s"), F.col("title").alias("new"))
    return rows.join(last, F.col("session_id") == F.col("s"), "left").select("session_id", F.coalesce("new", F.nullif(F.trim("title"), F.lit(""))).alias("title"))


def tool_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles that sessions set by a tool call, the last one; calls are put into the legacy log's function calls."""
    rows = table(spark, folder, "response_items").where("payload.type = 'function_call' and session_id is not null")
    call = F.struct(F.lit(catalogs.TITLE_TOOL).alias("name"), F.to_json(F.struct(F.concat(F.lit("title "), "item_id").alias("title"))).alias("arguments"))
    raw = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("function_call").alias("type"), F.array(call).alias("calls")).alias("payload")))
    return catalogs.tool_titles(rows.select("session_id", F.col("item_id").alias("line_no"), raw.alias("raw")))


def resolved_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Sources named in a list file, by project, and the latest of each source; each path once, under the last that named it."""
    catalog = table(spark, folder, "session_catalog").where("session_id is not null")
    listed = catalog.where(F.substring("session_id", 1, 1).isin(*"01")).select("session_id", F.concat(F.lit("# next\n  "), F.col("session_id"), F.lit("  \n\n")).alias("entry"))
    parts = _bucketed(listed, "session_id").groupBy("bucket").agg(F.array_join(F.array_sort(F.collect_list("entry")), "").alias("text"))
    root = _publish(parts.select(F.format_string("list-%06d.txt", "bucket").alias("path"), F.encode("text", "utf-8").alias("data")), "lists")
    empty = spark.createDataFrame([], "source string")
    wanted = catalogs.listed_sources(spark.read.text(f"{root}/*.txt")) if not listed.isEmpty() else empty
    by = lambda df, rank, name: df.select("session_id", "rollout_path", F.lit(rank).alias("rank"), F.lit(name).alias("origin"))
    one = by(catalog.join(wanted, catalog["session_id"] == wanted["source"], "left_semi"), 1, "list")
    two = by(catalog.where(F.lower("project_id") == "lantern"), 2, "project")
    latest = catalog.where("updated_at is not null").groupBy("source").agg(F.max_by("session_id", F.struct("updated_at", "session_id")).alias("s"))
    three = by(catalog.join(latest, catalog["session_id"] == latest["s"], "left_semi"), 3, "latest")
    every = one.unionByName(two).unionByName(three).withColumn("key", F.coalesce(F.nullif(X.path_key("rollout_path"), F.lit("")), "session_id"))
    return every.groupBy("key").agg(F.max_by(F.struct("session_id", "origin"), F.struct("rank", "session_id")).alias("last")).select("last.session_id", "last.origin")


def _conversations(spark: SparkSession, folder: str) -> DataFrame:
    """conversation_id, number (from 1), role, text: the legacy messages in conversations of CONVERSATION messages."""
    rows = table(spark, folder, "response_items").where("payload.type = 'message'")
    said = F.array_join(F.filter(F.transform(F.coalesce("payload.content", F.array()), lambda p: p["text"]), lambda t: t.isNotNull()), "\n\n")
    rows = rows.select(F.coalesce("session_id", F.lit("none")).alias("s"), "item_id", F.coalesce("payload.role", F.lit("unknown")).alias("role"), said.alias("text"))
    rows = Q.numbered(rows, ["s"], "item_id", "no")
    conversation = F.concat_ws(":", "s", F.floor((F.col("no") - 1) / CONVERSATION))
    return rows.select(conversation.alias("conversation_id"), (F.pmod(F.col("no") - 1, F.lit(CONVERSATION)) + 1).alias("number"), "role", "text")


def _export(spark: SparkSession, folder: str) -> str:
    """An account export of the legacy messages: message k answers message k / 2, so that conversations branch; later children first."""
    rows = _conversations(spark, folder)
    sizes = materialize(rows.groupBy("conversation_id").agg(F.max("number").alias("last")), "conversations")
    node = lambda n: F.concat(F.lit("n"), n.cast("string"))
    rows = rows.join(sizes, "conversation_id")
    children = F.filter(F.array(F.col("number") * 2 + 1, F.col("number") * 2), lambda c: c <= F.col("last"))
    content = F.struct(F.struct(F.col("role").alias("role")).alias("author"), F.struct(F.array("text").alias("parts")).alias("content"))
    value = F.struct(F.when(F.col("number") > 1, node(F.floor(F.col("number") / 2))).alias("parent"), F.transform(children, node).alias("children"), content.alias("message"))
    whole = rows.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("number", value.alias("v")))).alias("m"))
    mapping = F.map_from_entries(F.transform("m", lambda x: F.struct(node(x["number"]), x["v"])))
    record = F.to_json(F.struct(F.col("conversation_id").alias("id"), F.concat(F.lit("Title of "), "conversation_id").alias("title"), F.lit(1700000000.25).alias("create_time"), mapping.alias("mapping")))
    shards = max(1, sizes.count() // SHARD)
    texts = materialize(whole.select(record.alias("record"), F.pmod(F.crc32(F.encode("conversation_id", "utf-8")), F.lit(shards)).alias("bucket")), "records")
    numbers = texts.select("bucket").distinct().withColumn("shard", F.row_number().over(W.orderBy("bucket")) - 1)  # a row for each shard
    parts = texts.join(numbers, "bucket").groupBy("shard").agg(F.concat(F.lit("["), F.array_join(F.collect_list("record"), ",\n"), F.lit("]")).alias("text"))
    return _publish(parts.select(F.format_string("export/conversations-%03d.json", "shard").alias("path"), F.encode("text", "utf-8").alias("data")), "export")


def export_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Message nodes of an account export in depth-first order of their branches."""
    if _conversations(spark, folder).isEmpty():
        return spark.createDataFrame([], "conversation_id string, node_id string, position bigint, depth bigint, parent string, role string, sha256 string")
    nodes = materialize(exports.message_nodes(spark, _export(spark, folder)), "nodes")
    order = exports.ordered_nodes(nodes).select(F.col("conversation_id").alias("c"), F.col("node_id").alias("n"), "position", "depth")
    rows = nodes.join(order, (F.col("conversation_id") == F.col("c")) & (F.col("node_id") == F.col("n")))
    return rows.select("conversation_id", "node_id", "position", "depth", "parent", "role", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


def export_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations of an account export that a title pattern finds: nodes, roles, creation time."""
    if _conversations(spark, folder).isEmpty():
        return spark.createDataFrame([], "conversation_id string, created string, nodes bigint, silent bigint, users bigint, others bigint")
    nodes = exports.message_nodes(spark, _export(spark, folder))
    rows = nodes.where(exports.matching(nodes, title="TITLE of .*[02468]:")).withColumn("created", exports.utc_text("created"))
    return rows.groupBy("conversation_id", "created").agg(
        F.count("*").alias("nodes"), F.count_if(~F.col("has_message")).alias("silent"), F.count_if(F.lower(F.trim("role")) == "user").alias("users"), F.count_if(F.lower(F.trim("role")) != "user").alias("others")
    )


def shard_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Shard numbers that are missing or repeated in an export whose shards are numbered by the archive members."""
    rows = table(spark, folder, "archive_members").select("member_id")
    names = rows.select(F.explode(F.when(F.col("member_id") % 11 == 5, F.array(F.lit("a"), F.lit("b"))).when(F.col("member_id") % 7 != 3, F.array(F.lit("a"))).otherwise(F.array())).alias("home"), "member_id")
    names = names.select(F.concat("home", F.lit("/conversations-"), F.format_string("%03d", F.pmod("member_id", F.lit(5000)))).alias("n")).select(F.concat("n", F.lit(".json")).alias("name"))
    return exports.shard_problems(names.unionByName(spark.createDataFrame([("media/picture-001.dat",), ("conversations-01.json",)], "name string")))


def archive_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Members of each session in ZIP parts below a cap, written, read back, verified and put together again."""
    rows = table(spark, folder, "archive_members")
    parts = archives.archives(rows, CAP)
    name = F.format_string("%s-%06d-%04d.zip", "session_id", "set_no", "part_no")
    root = _publish(parts.select(name.alias("path"), "data"), "archives")
    if rows.isEmpty():
        return spark.createDataFrame([], "member_id bigint, bytes bigint, sha256 string, whole boolean")
    checked = materialize(archives.verified(spark.read.format("binaryFile").load(f"{root}/*.zip").select("path", "content")), "checked")
    sha = ordered_sha256(checked.where("problem is null").select("id", "offset", "data"), {"id": pa.int64()}, ["offset"], "data").select(F.col("id").alias("i"), "sha256")
    order = W.partitionBy("id").orderBy("offset", "bytes")
    fits = checked.where("problem is null").withColumn("fits", F.col("offset") == F.coalesce(F.lag(F.col("offset") + F.col("bytes")).over(order), F.lit(0)))
    whole = fits.groupBy("id", "original_sha256", "original_bytes").agg(F.sum("bytes").alias("bytes"), F.every("fits").alias("fits"))
    good = F.col("fits") & (F.col("bytes") == F.col("original_bytes")) & (F.col("sha256") == F.col("original_sha256"))
    return whole.join(sha, F.col("id") == F.col("i")).select(F.col("id").alias("member_id"), "bytes", "sha256", good.alias("whole"))


def archive_problems(spark: SparkSession, folder: str) -> DataFrame:
    """What verification says of archives that were spoilt on purpose, each in one way."""
    rows = table(spark, folder, "archive_members").where("session_id is not null and octet_length(body) > 0")
    ways = ("whole", "cut", "renamed", "unlisted", "changed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            out = []
            for i, body in zip(b.column("member_id").to_pylist(), b.column("body").to_pylist()):
                data, way = body.encode(), ways[i % len(ways)]
                entry = {"member": "m", "id": i, "offset": 0, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest(), "original_bytes": len(data), "original_sha256": hashlib.sha256(data).hexdigest()}
                z = archives.zipped({"../m" if way == "renamed" else "m": data + b"!" * (way == "changed")}, [] if way == "unlisted" else [entry])
                out.append((f"{i}.zip", z[: len(z) // 2] if way == "cut" else z))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.binary())], names=["path", "content"])

    found = archives.verified(rows.select("member_id", "body").mapInArrow(run, "path string, content binary"))
    return found.select(F.regexp_extract("path", r"(\d+)\.zip$", 1).cast("bigint").alias("member_id"), F.coalesce("problem", F.lit("none")).alias("problem"))


def inventory_digest(spark: SparkSession, folder: str) -> DataFrame:
    """One hash over the names, hashes and sizes of each session's archive members."""
    rows = table(spark, folder, "archive_members").where("session_id is not null")
    rows = rows.select("session_id", F.concat_ws("-", "original", "member_id").alias("name"), F.sha2(F.coalesce("body", F.lit("")), 256).alias("sha"), "body_bytes")
    return archives.inventory_digest(rows, "name", "sha", "body_bytes", "session_id")


_NAMES = """scan_lines session_files catalog_databases database_titles renamed_titles tool_titles resolved_sources export_nodes export_inventory shard_gaps
archive_sets archive_problems inventory_digest""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

# ------------------------------------------------------------------------------------------------------------ SQL twins

from loomlog.plans.catalog_queries import _HAS, _PATH0  # noqa: E402

_FORMS = "(SELECT *, unnest(CASE WHEN member_id % 5 = 0 THEN [false, true] WHEN member_id % 2 = 0 THEN [true] ELSE [false] END) AS compressed FROM archive_members)"
_ROLLOUT = _PATH0.replace("cwd", "rollout_path")
_RKEY = rf"coalesce(nullif(lower(regexp_replace(CASE WHEN starts_with({_ROLLOUT}, '\\?\UNC\') THEN '\\' || substr({_ROLLOUT}, 9) WHEN starts_with({_ROLLOUT}, '\\?\') THEN substr({_ROLLOUT}, 5) ELSE {_ROLLOUT} END, '\\+$', '')), ''), session_id)"
_CONV = f"""m AS (SELECT coalesce(session_id, 'none') AS s, row_number() OVER (PARTITION BY coalesce(session_id, 'none') ORDER BY item_id) - 1 AS no, coalesce(payload.role, 'unknown') AS role,
array_to_string(list_filter(list_transform(coalesce(payload.content, []), lambda p: p.text), lambda t: t IS NOT NULL), chr(10) || chr(10)) AS text FROM response_items WHERE payload.type = 'message'),
c AS (SELECT s || ':' || (no // {CONVERSATION}) AS conversation_id, no % {CONVERSATION} + 1 AS number, role, text FROM m)"""

SQL = {
    "scan_lines": f"""WITH l AS (SELECT member_id, compressed, string_split(coalesce(body, ''), chr(10)) AS parts FROM {_FORMS}),
x AS (SELECT member_id, compressed, len(parts) AS n, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM l),
y AS (SELECT *, strlen(line) + CASE WHEN i < n THEN 1 ELSE 0 END AS size FROM x)
SELECT member_id, compressed, CAST(i AS BIGINT) AS line_no, CAST(sum(size) OVER w - size AS BIGINT) AS byte_start, CAST(sum(size) OVER w AS BIGINT) AS byte_end, sha256(line) AS sha256 FROM y WHERE i < n OR line <> '' WINDOW w AS (PARTITION BY member_id, compressed ORDER BY i)""",
    "session_files": f"SELECT member_id, session_id, member_id % 3 = 0 AS archived, compressed, NOT compressed OR member_id % 5 <> 0 AS best FROM {_FORMS}",
    "catalog_databases": f"SELECT session_id, cwd, title, archived, project_id, NULL AS rollout_path FROM {_HAS}",
    "database_titles": f"SELECT session_id, 'alias of ' || session_id AS title FROM {_HAS}",
    "renamed_titles": f"SELECT session_id, CASE WHEN session_id[1] IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'renamed ' || session_id ELSE nullif(trim(title), '') END AS title FROM {_HAS}",
    "tool_titles": "SELECT session_id, 'title ' || max(item_id) AS title FROM response_items WHERE payload.type = 'function_call' AND session_id IS NOT NULL GROUP BY session_id",
    "resolved_sources": f"""WITH c AS (SELECT *, {_RKEY} AS key FROM {_HAS}), u AS (SELECT session_id, key, 1 AS rank, 'list' AS origin FROM c WHERE session_id[1] IN ('0', '1')
UNION ALL SELECT session_id, key, 2, 'project' FROM c WHERE lower(project_id) = 'lantern' UNION ALL SELECT session_id, key, 3, 'latest' FROM c WHERE updated_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY updated_at DESC, session_id DESC) = 1)
SELECT session_id, origin FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank DESC, session_id DESC) = 1""",
    "export_nodes": f"""WITH RECURSIVE {_CONV}, t AS (SELECT conversation_id, number, [0] AS path, 0 AS depth FROM c WHERE number = 1
UNION ALL SELECT c.conversation_id, c.number, list_append(t.path, CASE WHEN c.number % 2 = 1 THEN 0 ELSE 1 END), t.depth + 1 FROM t JOIN c ON c.conversation_id = t.conversation_id AND c.number // 2 = t.number)
SELECT conversation_id, 'n' || number AS node_id, row_number() OVER (PARTITION BY conversation_id ORDER BY path) AS position, CAST(depth AS BIGINT) AS depth, CASE WHEN number > 1 THEN 'n' || (number // 2) END AS parent, role, sha256(CASE WHEN text = '' THEN '[Structured non-text content: keys=parts]' ELSE text END) AS sha256 FROM t JOIN c USING (conversation_id, number)""",
    "export_inventory": f"""WITH {_CONV} SELECT conversation_id, '2023-11-14T22:13:20.250000+00:00' AS created, count(*) AS nodes, 0 AS silent, count(*) FILTER (lower(trim(role)) = 'user') AS users, count(*) FILTER (lower(trim(role)) <> 'user') AS others
FROM c WHERE regexp_matches(conversation_id, '[02468]:') GROUP BY conversation_id""",
    "shard_gaps": """WITH n AS (SELECT member_id % 5000 AS number, unnest(CASE WHEN member_id % 11 = 5 THEN ['a', 'b'] WHEN member_id % 7 <> 3 THEN ['a'] ELSE [] END) AS home FROM archive_members),
k AS (SELECT number, count(*) AS n FROM n GROUP BY number) SELECT 'missing' AS problem, CAST(g AS BIGINT) AS number FROM generate_series(0, (SELECT max(number) FROM k)) s(g) WHERE g NOT IN (SELECT number FROM k)
UNION ALL SELECT 'repeated', number FROM k WHERE n > 1""",
    "archive_sets": "SELECT member_id, CAST(strlen(coalesce(body, '')) AS BIGINT) AS bytes, sha256(coalesce(body, '')) AS sha256, true AS whole FROM archive_members",
    "archive_problems": """SELECT member_id, unnest(CASE member_id % 5 WHEN 0 THEN ['none'] WHEN 1 THEN ['unreadable'] WHEN 2 THEN ['unsafe_name'] WHEN 3 THEN ['not_in_index'] ELSE ['wrong_hash'] END) AS problem
FROM archive_members WHERE session_id IS NOT NULL AND strlen(body) > 0""",
    "inventory_digest": """SELECT session_id, sha256(string_agg('["' || name || '","' || sha256(coalesce(body, '')) || '","' || body_bytes || '"]' || chr(10), '' ORDER BY name)) AS sha256
FROM (SELECT *, original || '-' || member_id AS name FROM archive_members WHERE session_id IS NOT NULL) GROUP BY session_id""",
}
