"""File listings: prefixes, globs, levels, keys and fingerprints.

A listing is a DataFrame with a ``path`` column (and size, time, hash as available).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.ordering import numbered_by_range


def list_storage(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """List stored files. Spark prunes the content column, so no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def list_files(listing: DataFrame, paths: Sequence[str], distinct: bool = False) -> DataFrame:
    """Files below any of the given prefixes (or equal to a full key), directory objects left out.

    ``path_index`` is the place of the matching prefix in ``paths``; the reading order is
    (path_index, path). A file under two prefixes is listed twice unless ``distinct``.
    """
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(paths)])
    hits = F.filter(wanted, lambda w: F.startswith(F.col("path"), w["p"]))
    found = listing.filter(~F.endswith("path", F.lit("/"))).withColumn("_hits", hits).filter(F.size("_hits") > 0)
    if distinct:
        return found.withColumn("path_index", F.col("_hits")[0]["i"]).drop("_hits")
    return found.withColumn("_hit", F.explode("_hits")).withColumn("path_index", F.col("_hit.i")).drop("_hits", "_hit")


def glob_to_regex(pattern: str) -> str:
    """An anchored regular expression for a glob in which ``/`` separates and ``**`` does not stop at it."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            i += 1
            if pattern[i : i + 1] == "*":
                i += 1
                out.append(".*")
            else:
                out.append("[^/]*")
            continue
        if c == "?":
            out.append("[^/]")
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise ValueError(f"failed to interpret glob pattern: {pattern}")
            body = pattern[i + 1 : end]
            negated = body.startswith("!")
            out.append("[" + ("^" if negated else "") + body[negated:].replace("\\", "\\\\").replace("^", "\\^") + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"failed to interpret glob pattern: {pattern}")
    return "^(?s:" + "".join(out) + ")$"


def glob_match(path: Column, patterns: Sequence[str]) -> Column:
    """Whether any of the globs matches the whole path."""
    matched = F.lit(False)
    for pattern in patterns:
        matched = matched | path.rlike(glob_to_regex(pattern))
    return matched


def filter_globs(listing: DataFrame, includes: Sequence[str] = (), excludes: Sequence[str] = ()) -> DataFrame:
    """Keep paths that match any include (all, if none is given) and no exclude."""
    kept = listing.filter(glob_match(F.col("path"), includes)) if includes else listing
    return kept.filter(~glob_match(F.col("path"), excludes)) if excludes else kept


def dry_run(
    listing: DataFrame,
    paths: Sequence[str],
    includes: Sequence[str] = (),
    excludes: Sequence[str] = (),
    require_files: bool = True,
) -> DataFrame:
    """The files a submission would process; an error if there are none. Reads no content."""
    files = filter_globs(list_files(listing, paths), includes, excludes)
    if require_files and files.isEmpty():
        raise ValueError("no files match the given paths, includes and excludes")
    return files


def list_bounded(
    listing: DataFrame, max_results: int | None, start_after: str | tuple | None = None, ties: Sequence[str] = ()
) -> DataFrame:
    """The first ``max_results`` paths in key order, after (not including) ``start_after``.

    Where paths repeat, ``ties`` are the columns that order equal ones, and ``start_after`` may be the whole
    place (path, *ties) of the last row seen, so that pages neither repeat nor lose a row.
    """
    place = ["path", *ties]
    files = listing
    if start_after is not None:
        seen = start_after if isinstance(start_after, tuple) else (start_after,)
        columns = place[: len(seen)]
        files = files.filter(F.struct(*columns) > F.struct(*[F.lit(v).cast(listing.schema[c].dataType).alias(c) for c, v in zip(columns, seen, strict=True)]))
        files = files.filter(F.col("path") >= seen[0])  # a plain bound, which sources understand
    ordered = files.orderBy(*place)
    return ordered if max_results is None else ordered.limit(max_results)


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def _folder(prefix: str) -> str:
    return prefix if prefix.endswith("/") else prefix + "/"


def list_levels(listing: DataFrame, prefix: str, depth: int) -> DataFrame:
    """Distinct ancestors ``depth`` levels below ``prefix``."""
    base = [p for p in prefix.split("/") if p]
    level = len(base) + depth
    below = listing.filter(F.startswith("path", F.lit(_folder(prefix)))) if base else listing
    parts = _parts(F.col("path"))
    return (
        below.filter(F.size(parts) >= level)
        .select(F.array_join(F.slice(parts, 1, level), "/").alias("ancestor"))
        .distinct()
    )


def list_one_level(listing: DataFrame, prefix: str) -> DataFrame:
    """Names directly below ``prefix``, as a directory listing shows them."""
    base = _folder(prefix) if prefix else ""
    below = listing.filter(F.startswith("path", F.lit(base)) & (F.length("path") > len(base)))
    return below.select(F.split(F.expr(f"substring(path, {len(base) + 1})"), "/")[0].alias("name")).distinct()


JOB_KEY = r"^([a-z0-9]+)://([^/]+)/(.+)$"


def parse_keys(paths: DataFrame) -> DataFrame:
    """Split object paths into bucket and key, and job keys into kind, api, job and file.

    Job keys end in ``.../jobs/<kind>/<version>/<api>/<job>/<file>``; in-progress keys in
    ``.../jobs/<kind>/in_progress/<api>/<job>``. Paths without scheme and bucket are invalid.
    """
    split = paths.withColumn("_key", F.regexp_extract("path", JOB_KEY, 3)).withColumn("_parts", F.split("_key", "/"))

    def part(n: int) -> Column:
        return F.try_element_at("_parts", F.lit(-n))

    def filled(n: int) -> Column:
        return F.forall(F.slice("_parts", -n, n), lambda p: p != "")

    valid = F.col("_key") != ""
    long_enough = F.size("_parts") >= 5
    split = split.withColumn(
        "_progress", long_enough & (part(5) == "jobs") & (part(3) == "in_progress") & F.when(long_enough, filled(5))
    ).withColumn("_progress", F.coalesce("_progress", F.lit(False)))
    deep = F.size("_parts") >= 6
    split = split.withColumn(
        "_job", ~F.col("_progress") & F.coalesce(deep & (part(6) == "jobs") & F.when(deep, filled(6)), F.lit(False))
    )
    either = lambda a, b: F.when(F.col("_progress"), a).when(F.col("_job"), b)
    return split.select(
        *paths.columns,
        valid.alias("valid"),
        F.when(valid, F.split_part("path", F.lit("/"), F.lit(3))).alias("bucket"),
        F.when(valid, F.col("_key")).alias("key"),
        F.col("_progress").alias("in_progress"),
        either(part(4), part(5)).alias("kind"),
        either(part(2), part(3)).alias("api_name"),
        either(part(1), part(2)).alias("job_id"),
        F.when(F.col("_job"), part(1)).alias("file"),
    )


#: Hex digits of each of the four sums that make a fingerprint.
PART = 8


def fingerprint(listing: DataFrame, hash_col: str = "etag", keys: Sequence[str] = ()) -> DataFrame:
    """One digest per key group over the paths and hashes of its objects, whatever their number or order.

    Every object's (path, hash) has an md5; its four quarters are summed over the group, and the
    fingerprint is the md5 of the count and the sums. Sums merge, so partial aggregates meet in the shuffle and no group
    is ever gathered. An object that is added, removed, renamed or changed changes the fingerprint; a null hash
    counts as empty, and repeated objects count each.
    """
    digest = F.md5(F.concat("path", F.lit("\n"), F.coalesce(hash_col, F.lit(""))))
    quarters = [F.conv(F.substring(digest, 1 + PART * i, PART), 16, 10).cast("long") for i in range(4)]
    sums = listing.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(q).alias(f"_s{i}") for i, q in enumerate(quarters)]
    )
    parts = [F.col(n).cast("string") for n in ("_n", "_s0", "_s1", "_s2", "_s3")]
    return sums.select(*keys, F.md5(F.concat_ws(",", *parts)).alias("fingerprint"))
