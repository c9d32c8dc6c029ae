"""Queries for sources, batching and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import batching, ordering
from tideline.plans import views
from tideline.plans.registry import query
from tideline.session import fresh_path, materialise
from tideline.sources import items as src
from tideline.sources import listing, sinks, states, storage

MESSAGE_LIMIT = 256 * 1024
LIMIT = 4096


@query(
    "src_1",
    """
    SELECT doc_id AS job_id, (u.i - 1)::BIGINT AS pos, coalesce((parts[u.i])::VARCHAR, 'null') AS item
    FROM (SELECT doc_id, from_json('[' || doc_id || ',"' || lang || '",{"n":' || n_chars || '},null,'
                 || substr(to_json([text])::VARCHAR, 2), '["JSON"]') AS parts FROM documents) d,
         unnest(range(1, len(parts) + 1)) AS u(i)
    """,
)
def src_1(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    items = F.concat(
        F.lit("["),
        F.col("doc_id").cast("string"),
        F.lit(',"'),
        F.col("lang"),
        F.lit('",{"n":'),
        F.col("n_chars").cast("string"),
        F.lit("},null,"),
        F.expr("substr(to_json(array(text)), 2)"),
    )
    return src.item_list(docs.select(F.col("doc_id").alias("job_id"), items.alias("items")))


PATHS = ["https://", "https://m.", "http://blog."]


@query(
    "src_2",
    """
    SELECT p.i AS path_index, page_id, path, size
    FROM v_files JOIN (VALUES (0, 'https://'), (1, 'https://m.'), (2, 'http://blog.')) AS p(i, prefix)
      ON starts_with(path, prefix)
    WHERE NOT ends_with(path, '/')
    """,
    "v_files",
)
def src_2(spark, sf_dir):
    return listing.list_files(views.files(spark, sf_dir), PATHS).select("path_index", "page_id", "path", "size")


@query(
    "src_2_storage",
    """
    SELECT DISTINCT 0 AS path_index, coalesce(source, '__HIVE_DEFAULT_PARTITION__') AS source, lang FROM documents WHERE lang IS NOT NULL
    UNION ALL SELECT DISTINCT 1, source, lang FROM documents WHERE source LIKE 'src1%' AND lang IS NOT NULL
    """,
)
def src_2_storage(spark, sf_dir):
    """The documents written in folders by source and language; these are listed under two prefixes, one of them part of the other."""
    path = fresh_path(spark, "stored").removeprefix("file:")
    views.table(spark, sf_dir, "documents").select("source", "lang", "doc_id").write.partitionBy("source", "lang").json(path)
    files = storage.list_keys(spark, [f"{path}/source=", f"{path}/source=src1"], include="**.json")
    parts = F.regexp_extract_all("path", F.lit("/(?:source|lang)=([^/]*)"), 1)
    found = files.select("path_index", parts[0].alias("source"), parts[1].alias("lang"))
    return found.filter("lang <> '__HIVE_DEFAULT_PARTITION__'").distinct()


INCLUDES = ["https://*.example.com/**", "http://*/*/{5,6}*", "https://m.*/es/[0-4]?"]
EXCLUDES = ["**.html", "https://*/[!ef]*/**", "**?page=*"]
KEEP_SQL = r"""
  (regexp_matches(path, '^https://[^/]*\.example\.com/.*$') OR regexp_matches(path, '^http://[^/]*/[^/]*/(5|6)[^/]*$')
   OR regexp_matches(path, '^https://m\.[^/]*/es/[0-4][^/]$'))
  AND NOT (regexp_matches(path, '^.*\.html$') OR regexp_matches(path, '^https://[^/]*/[^ef][^/]*/.*$')
   OR regexp_matches(path, '^.*[^/]page=[^/]*$'))
"""


@query("src_3", f"SELECT page_id, path, size FROM v_files WHERE {KEEP_SQL}", "v_files")
def src_3(spark, sf_dir):
    return listing.filter_globs(views.files(spark, sf_dir), INCLUDES, EXCLUDES)


@query(
    "src_4",
    """
    SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::BIGINT AS item_index,
           doc_id, n_chars, true AS valid
    FROM documents
    """,
)
def src_4(spark, sf_dir):
    """Documents written as one JSON-lines folder per source, then read back with their file order."""
    docs = views.table(spark, sf_dir, "documents")
    path = fresh_path(spark, "ndjson")
    lines = docs.select("source", "doc_id", F.to_json(F.struct("doc_id", "n_chars", "text")).alias("value"))
    (
        lines.repartitionByRange("source", "doc_id")
        .sortWithinPartitions("source", "doc_id")
        .drop("doc_id")
        .write.partitionBy("source")
        .text(path)
    )
    items = src.read_ndjson(spark, path)
    parsed = items.select(
        F.regexp_extract("file", "source=([^/]+)/", 1).alias("source"),
        "file",
        "item_index",
        F.from_json("item", "doc_id long, n_chars long").alias("v"),
        "valid",
    ).select("source", "file", "item_index", "v.doc_id", "v.n_chars", "valid")
    # A source may span several part files; their item counts turn file places into source places.
    parts = parsed.groupBy("source", "file").agg(F.count(F.lit(1)).alias("n"))
    before = ordering.running_before(parts, ["source"], ["file"], "n", "before")
    return parsed.join(before, ["source", "file"]).select(
        F.col("source"),
        (F.col("item_index") + F.col("before")).alias("item_index"),
        "doc_id",
        "n_chars",
        "valid",
    )


@query(
    "src_4_stream",
    "SELECT doc_id, n_chars, md5(text) AS text_md5, true AS valid FROM documents",
)
def src_4_stream(spark, sf_dir):
    """Two values a line, pretty-printed over several lines, decoded from whole files."""
    docs = views.table(spark, sf_dir, "documents")
    path = fresh_path(spark, "json-stream")
    value = F.concat(
        F.lit("{\n "),
        F.expr("substr(to_json(struct(doc_id, n_chars)), 2, length(to_json(struct(doc_id, n_chars))) - 2)"),
        F.lit(',\n "text":'),
        F.expr("substr(to_json(array(text)), 2, length(to_json(array(text))) - 2)"),
        F.lit("\n} 17"),
    )
    docs.select(value.alias("value")).write.text(path)
    items = src.read_json_stream(spark, path).filter(F.col("item") != "17")
    parsed = F.from_json("item", "doc_id long, n_chars long, text string").alias("v")
    return items.select(parsed, "valid").select("v.doc_id", "v.n_chars", F.md5("v.text").alias("text_md5"), "valid")


@query(
    "src_5",
    f"""
    SELECT p.i AS path_index, path
    FROM v_files JOIN (VALUES (0, 'https://'), (1, 'https://m.'), (2, 'http://blog.')) AS p(i, prefix)
      ON starts_with(path, prefix)
    WHERE NOT ends_with(path, '/') AND {KEEP_SQL}
    """,
    "v_files",
)
def src_5(spark, sf_dir):
    return listing.dry_run(views.files(spark, sf_dir), PATHS, INCLUDES, EXCLUDES).select("path_index", "path")


@query(
    "src_6",
    "SELECT path, page_id FROM v_files WHERE path > 'http://m' AND path LIKE '%/en/%' ORDER BY path, page_id LIMIT 40",
    "v_files",
)
def src_6(spark, sf_dir):
    matching = views.files(spark, sf_dir).filter(F.contains("path", F.lit("/en/")))
    return listing.list_bounded(matching, 40, "http://m").select("path", "page_id")


@query(
    "src_7",
    """
    SELECT 'levels' AS kind, array_to_string(parts[1:3], '/') AS name
    FROM (SELECT list_filter(string_split(path, '/'), lambda p: p <> '') AS parts FROM v_files)
    WHERE len(parts) >= 3 GROUP BY 2
    UNION ALL
    SELECT 'one', split_part(substr(path, 9), '/', 1) FROM v_files
    WHERE starts_with(path, 'https://') AND length(path) > 8 GROUP BY 2
    """,
    "v_files",
)
def src_7(spark, sf_dir):
    files = views.files(spark, sf_dir)
    deep = listing.list_levels(files, "", 3).select(F.lit("levels").alias("kind"), F.col("ancestor").alias("name"))
    return deep.unionByName(listing.list_one_level(files, "https://").select(F.lit("one").alias("kind"), "name"))


@query(
    "src_8",
    """
    SELECT job_id, api_name, marker AS file, in_progress, 'store' AS bucket, 'BatchAPI' AS kind, true AS valid
    FROM (SELECT job_id::VARCHAR AS job_id, api_name, marker, false AS in_progress FROM v_markers
          UNION ALL SELECT job_id::VARCHAR, api_name, NULL, true FROM v_markers WHERE marker = 'enqueuing')
    UNION ALL
    SELECT NULL, NULL, NULL, false, CASE WHEN ok THEN regexp_extract(path, '^https?://([^/]+)/', 1) END, NULL, ok
    FROM (SELECT path, regexp_matches(path, '^[a-z0-9]+://[^/]+/.+$') AS ok FROM v_files)
    """,
    "v_markers v_files",
)
def src_8(spark, sf_dir):
    marks = views.markers(spark, sf_dir)
    base = F.lit("s3://store/u1/jobs/BatchAPI/")
    job = F.concat("api_name", F.lit("/"), F.col("job_id").cast("string"))
    keys = marks.select(F.concat(base, F.lit("v1/"), job, F.lit("/"), "marker").alias("path"))
    running = marks.filter("marker = 'enqueuing'").select(F.concat(base, F.lit("in_progress/"), job).alias("path"))
    pages = views.files(spark, sf_dir).select("path")
    parsed = listing.parse_keys(keys.unionByName(running).unionByName(pages))
    return parsed.select("job_id", "api_name", "file", "in_progress", "bucket", "kind", "valid")


@query(
    "src_9",
    """
    WITH o AS (SELECT split_part(path, '/', 3) AS host, path || '#' || page_id AS path, md5(path || size) AS h FROM v_files),
    p AS (SELECT '' AS host, path, h FROM o UNION ALL SELECT host, path, h FROM o),
    d AS (SELECT host, md5(path || chr(10) || h) AS h FROM p)
    SELECT host, md5(concat_ws(',', count(*), sum(('0x' || substr(h, 1, 8))::BIGINT), sum(('0x' || substr(h, 9, 8))::BIGINT),
                               sum(('0x' || substr(h, 17, 8))::BIGINT), sum(('0x' || substr(h, 25, 8))::BIGINT))) AS fingerprint
    FROM d GROUP BY host
    """,
    "v_files",
)
def src_9(spark, sf_dir):
    files = views.files(spark, sf_dir)
    objects = files.select(
        F.split("path", "/")[2].alias("host"),
        F.concat("path", F.lit("#"), F.col("page_id").cast("string")).alias("path"),
        F.md5(F.concat("path", F.col("size").cast("string"))).alias("etag"),
    )
    return listing.fingerprint(objects.withColumn("host", F.lit("")).unionByName(objects), keys=["host"])


@query(
    "prj_7",
    f"SELECT item_id, strlen(body)::BIGINT AS bytes, strlen(body) <= {LIMIT} AS accepted FROM v_items",
    "v_items",
)
def prj_7(spark, sf_dir):
    checked = src.reject_oversize(views.items(spark, sf_dir), "body", LIMIT, mode="reject")
    return checked.select("item_id", "bytes", "accepted")


def _numbered_items(spark, sf_dir):
    items = views.items(spark, sf_dir)
    return ordering.numbered(items, [], ["item_id"], F.floor(F.col("item_id") / 10_000))


@query(
    "win_1",
    """
    SELECT (row_number() OVER (ORDER BY item_id) - 1) // 7 AS batch_id,
           ((row_number() OVER (ORDER BY item_id) - 1) % 7)::INTEGER AS item_no, item_id
    FROM v_items
    """,
    "v_items",
)
def win_1(spark, sf_dir):
    return batching.assign_batches(_numbered_items(spark, sf_dir), 7).select("batch_id", "item_no", "item_id")


@query(
    "win_1_files",
    """
    SELECT batch_id, string_agg(path, ' ' ORDER BY pos) AS items
    FROM (SELECT path, pos, pos // 16 AS batch_id
          FROM (SELECT path, row_number() OVER (ORDER BY path, page_id) - 1 AS pos FROM v_files))
    GROUP BY 1
    """,
    "v_files",
)
def win_1_files(spark, sf_dir):
    """Batches of file paths in key order, straddling folders; positions come from ranges."""
    files = views.files(spark, sf_dir).select("path", "page_id")
    placed = ordering.numbered_by_range(files, ["path", "page_id"])
    batches = batching.collect_batches(batching.assign_batches(placed, 16), "path")
    return batches.withColumn("items", F.array_join("items", " "))


@query(
    "win_2",
    """
    WITH RECURSIVE b AS (
      SELECT source, row_number() OVER (PARTITION BY source ORDER BY item_id) - 1 AS batch_id, strlen(body) AS bytes
      FROM v_items),
    g AS (
      SELECT source, batch_id, bytes AS total, 1 AS n, 0::BIGINT AS group_id FROM b WHERE batch_id = 0
      UNION ALL
      SELECT b.source, b.batch_id,
             CASE WHEN g.total + b.bytes > 262144 OR g.n = 64 THEN b.bytes ELSE g.total + b.bytes END,
             CASE WHEN g.total + b.bytes > 262144 OR g.n = 64 THEN 1 ELSE g.n + 1 END,
             CASE WHEN g.total + b.bytes > 262144 OR g.n = 64 THEN g.group_id + 1 ELSE g.group_id END
      FROM g JOIN b ON b.source = g.source AND b.batch_id = g.batch_id + 1)
    SELECT source, batch_id, group_id FROM g
    """,
    "v_items",
)
def win_2(spark, sf_dir):
    """All documents, in messages of at most 256 KiB and 64 bodies."""
    items = views.items(spark, sf_dir).select("source", "item_id", F.octet_length("body").cast("long").alias("bytes"))
    placed = ordering.numbered(items, ["source"], ["item_id"], F.floor(F.col("item_id") / 10_000), "batch_id")
    packed = batching.pack(placed, "source", max_bytes=MESSAGE_LIMIT, max_count=64, chunk=256)
    return packed.select("source", "batch_id", "group_id")


@query(
    "snk_1",
    "SELECT l_linestatus AS state, job_id, batch_no, ok, n_batches FROM v_batches, (SELECT count(*) AS n_batches FROM v_batches)",
    "v_batches",
)
def snk_1(spark, sf_dir):
    path = fresh_path(spark, "batches")
    rows = views.batches(spark, sf_dir).select(F.col("l_linestatus").alias("state"), "job_id", "batch_no", "ok")
    total = sinks.write_batches(rows, path, ["state"])
    return spark.read.parquet(path).withColumn("n_batches", F.lit(total).cast("long"))


@query(
    "snk_2",
    "SELECT job_id, batch_no AS batch_id, CASE WHEN ok THEN amount END AS result FROM v_batches",
    "v_batches",
)
def snk_2(spark, sf_dir):
    path = fresh_path(spark, "results")
    rows = views.batches(spark, sf_dir).select(
        "job_id", F.col("batch_no").alias("batch_id"), F.when(F.col("ok"), F.col("amount")).alias("result")
    )
    sinks.write_results(rows, path)
    return spark.read.schema("job_id long, batch_id long, result double").json(f"{path}/merged")


@query(
    "snk_3",
    """
    SELECT job_id, arg_max(marker, mtime) AS status, max(mtime) AS updated_at FROM v_markers GROUP BY 1
    """,
    "v_markers",
)
def snk_3(spark, sf_dir):
    """Twelve rounds of upserts, together all markers, dealt by digest and so out of the order of time."""
    path = fresh_path(spark, "state")
    rows = views.markers(spark, sf_dir).select(
        "job_id", F.col("marker").alias("status"), F.col("mtime").alias("updated_at")
    )
    dealt = materialise(rows.withColumn("_turn", F.pmod(F.xxhash64("job_id", "status"), F.lit(12))), "markers")
    for turn in range(12):
        states.write_job_state(dealt.filter(F.col("_turn") == turn).drop("_turn"), path)
    return states.read_job_state(spark, path)
