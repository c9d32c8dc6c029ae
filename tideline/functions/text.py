"""Text expressions: endpoints, names, readable numbers, instance types.

Patterns below are fixed values that decide what is valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of valid names.
ENDPOINT = r"^[a-zA-Z0-9_\-\./]*$"
QUERY_STRING = r"(https?://.*)\?[^:\s]*"
NAME_PATTERNS = {
    "leading_space": r"^\s+",
    "trailing_space": r"\s+$",
    "alnum_dash_dot_underscore": r"^[a-zA-Z0-9_\-\.]+$",
    "alnum_dash_underscore": r"^[a-zA-Z0-9_\-]+$",
    "alnum_dot_underscore": r"^[a-zA-Z0-9_\.]+$",
    "alnum_dash": r"^[a-zA-Z0-9\-]+$",
    "dns1035": r"^[a-z]([-a-z0-9]*[a-z0-9])?$",
    "dns1123": r"^[a-z0-9]([-a-z0-9]*[a-z0-9])?$",
    "tag": r"^[\sa-zA-Z0-9_\-\.:/+@]+$",
    "registry_url": r"(^[a-zA-Z0-9][a-zA-Z0-9-_]*)\.dkr\.ecr(\-fips)?\.([a-zA-Z0-9][a-zA-Z0-9-_]*)\.amazonaws\.com(\.cn)?",
}
# Fixed value: the published pattern of image references. A run of dashes is written -+ where the published one has an
# optional run, which means the same and which a backtracking matcher would try in too many ways.
IMAGE = r"^(?:(?:[a-z0-9]|[a-z0-9][a-z0-9-]*[a-z0-9])(?:(?:\.(?:[a-z0-9]|[a-z0-9][a-z0-9-]*[a-z0-9]))+)?(?::[0-9]+)?/)?[a-z0-9]+(?:(?:(?:[._]|__|-+)[a-z0-9]+)+)?(?:(?:/[a-z0-9]+(?:(?:(?:[._]|__|-+)[a-z0-9]+)+)?)+)?(?::[a-zA-Z0-9_][a-zA-Z0-9_.-]{0,127})?(?:@[A-Za-z][A-Za-z0-9]*(?:[-_+.][A-Za-z][A-Za-z0-9]*)*:[0-9A-Fa-f]{32,})?$"


def ensure_prefix(text: Column, prefix: str) -> Column:
    return F.when(F.startswith(text, F.lit(prefix)), text).otherwise(F.concat(F.lit(prefix), text))


def ensure_suffix(text: Column, suffix: str) -> Column:
    return F.when(F.endswith(text, F.lit(suffix)), text).otherwise(F.concat(text, F.lit(suffix)))


def canonical_endpoint(text: Column) -> Column:
    """With a leading and without a trailing slash; the root is ``/``."""
    return F.when(text.isin("", "/"), "/").otherwise(F.regexp_replace(ensure_prefix(text, "/"), "/$", ""))


def endpoint_with_slash(text: Column) -> Column:
    return F.when(text.isin("", "/"), "/").otherwise(ensure_suffix(ensure_prefix(text, "/"), "/"))


def endpoint_problem(text: Column, allow_empty: bool = False) -> Column:
    """``charset``, ``double_slash`` or ``empty``; null for a valid endpoint."""
    problem = F.when(~text.rlike(ENDPOINT), "charset").when(F.contains(text, F.lit("//")), "double_slash")
    return problem if allow_empty else problem.when(canonical_endpoint(text) == "/", "empty")


def join_path(first: Column, *rest: Column) -> Column:
    """Parts joined by exactly one slash where they meet."""
    whole = first
    for part in rest:
        whole = F.concat(ensure_suffix(whole, "/"), F.regexp_replace(part, "^/", ""))
    return whole


def without_query(text: Column) -> Column:
    return F.regexp_replace(text, QUERY_STRING, "$1")


def normalise_endpoints(rows: DataFrame, column: str) -> DataFrame:
    text = F.col(column)
    bare = without_query(text)
    path = F.regexp_replace(F.regexp_replace(bare, r"^https?://[^/]+", ""), "#.*$", "")
    return rows.withColumns(
        {
            "bare_url": bare,
            "endpoint": canonical_endpoint(path),
            "endpoint_slash": endpoint_with_slash(path),
            "joined": join_path(F.lit("/v1"), path, F.lit("predict")),
            "problem": endpoint_problem(path),
        }
    )


def validate_names(rows: DataFrame, column: str) -> DataFrame:
    """One boolean column per class of names."""
    text = F.col(column)
    checks = {name: text.rlike(pattern) for name, pattern in NAME_PATTERNS.items()}
    return rows.withColumns({**checks, "image": text.rlike(IMAGE)})


def mask(text: Column, n_plain: int) -> Column:
    """All but the last ``n_plain`` characters hidden, and never less than half."""
    plain = F.least(F.lit(n_plain), F.floor(F.length(text) / 2)).cast("int")
    shown = F.when(plain > 0, F.right(text, plain)).otherwise("")
    return F.concat(F.repeat(F.lit("*"), F.length(text) - plain), shown)


def truncate(text: Column, max_length: int) -> Column:
    """Cut to ``max_length`` with a closing `` ...``."""
    return F.when(
        F.length(text) > max_length, F.concat(F.substring(text, 1, max_length - 4), F.lit(" ..."))
    ).otherwise(text)


def byte_size(size: Column) -> Column:
    """``17 B``, ``1.5 KiB``, ... in powers of 1024, ties to the even digit."""
    shown = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for power, unit in enumerate("KMGTPE", start=1):
        text = F.format_string(f"%.1f {unit}iB", F.bround(size.cast("double") / float(1024**power), 1))
        shown = shown.otherwise(text) if unit == "E" else shown.when(size < 1024 ** (power + 1), text)
    return shown


def round_text(value: Column, places: int, pad: int = 0) -> Column:
    """A number rounded half away from zero, without idle zeros but at least ``pad`` decimals."""
    scaled = value * (10.0**places)
    rounded = F.when(scaled < 0, F.ceil(scaled - 0.5)).otherwise(F.floor(scaled + 0.5)) / (10.0**places)
    digits = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{places}f", rounded), r"0+$", ""), r"\.$", "")
    if places == 0:
        digits = F.format_string("%.0f", rounded)
    if not pad:
        return digits
    whole = F.split_part(digits, F.lit("."), F.lit(1))
    decimals = F.split_part(digits, F.lit("."), F.lit(2))
    padded = F.when(F.length(decimals) >= pad, decimals).otherwise(F.rpad(decimals, pad, "0"))
    return F.concat(whole, F.lit("."), padded)


def dollars(value: Column, places: int = 2) -> Column:
    return F.concat(F.lit("$"), round_text(value, places, 2))


def duration_text(seconds: Column) -> Column:
    """``59s``, ``5m3s``, ``4h20m``, ``2d4h``: the two largest units, from 48 hours on with days."""
    s = seconds.cast("long")

    def text(big: int, big_unit: str, small: int, small_unit: str) -> Column:
        return F.concat(
            F.floor(s / big).cast("string"),
            F.lit(big_unit),
            F.floor(s % big / small).cast("string"),
            F.lit(small_unit),
        )

    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, text(60, "m", 1, "s"))
        .when(s < 48 * 3600, text(3600, "h", 60, "m"))
        .otherwise(text(86400, "d", 3600, "h"))
    )


def millis_to_time(millis: Column) -> Column:
    return F.timestamp_millis(millis).cast("timestamp_ntz")


def time_to_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def last_split(text: Column, separator: str) -> Column:
    return F.substring_index(text, separator, -1)


def longest_common_prefix(rows: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The longest text that opens every value of a group: what its least and greatest share."""
    ends = rows.groupBy(*keys).agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    lengths = F.sequence(F.lit(0), F.least(F.length("_a"), F.length("_b")))
    same = F.filter(lengths, lambda n: F.substr(F.col("_a"), F.lit(1), n) == F.substr(F.col("_b"), F.lit(1), n))
    return ends.select(*keys, F.substr(F.col("_a"), F.lit(1), F.array_max(same)).alias("prefix"))


def parse_instance_type(rows: DataFrame, column: str = "instance_type") -> DataFrame:
    """Family, generation (the last run of digits), capability letters and size; nulls if malformed."""
    pattern = r"^([^.]*?)(\d+)([^.\d]*)\.([^.]+)$"
    text = F.col(column)
    valid = text.rlike(pattern)
    letters = F.regexp_extract(text, pattern, 3)
    return rows.withColumns(
        {
            "family": F.when(valid, F.regexp_extract(text, pattern, 1)),
            "generation": F.when(valid, F.regexp_extract(text, pattern, 2)).cast("int"),
            "capabilities": F.when(
                valid, F.array_sort(F.array_distinct(F.filter(F.split(letters, ""), lambda c: c != "")))
            ),
            "size": F.when(valid, F.regexp_extract(text, pattern, 4)),
        }
    )
