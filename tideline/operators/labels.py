"""Selecting and rewriting series by their labels (a map column, or plain columns)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Matcher = tuple[str, str, str]  # label, operator, value


def anchored(pattern: str) -> str:
    return f"^(?:{pattern})$"


def match(value: Column, operator: str, wanted: str) -> Column:
    """One matcher; a missing label equals the empty string and regexes match the whole value."""
    value = F.coalesce(value, F.lit(""))
    if operator == "=":
        return value == wanted
    if operator == "!=":
        return value != wanted
    if operator == "=~":
        return value.rlike(anchored(wanted))
    if operator == "!~":
        return ~value.rlike(anchored(wanted))
    raise ValueError(f"unknown matcher operator {operator}")


def match_labels(samples: DataFrame, matchers: Iterable[Matcher], labels: str | None = "labels") -> DataFrame:
    """Rows that satisfy all matchers; ``labels=None`` means that labels are plain columns."""
    for label, operator, wanted in matchers:
        value = F.col(label) if labels is None else F.try_element_at(labels, F.lit(label))
        samples = samples.filter(match(value, operator, wanted))
    return samples


def _joined(sources: Sequence[str], labels: str) -> Column:
    return F.concat_ws(";", *[F.coalesce(F.try_element_at(labels, F.lit(s)), F.lit("")) for s in sources])


def relabel_keep(samples: DataFrame, sources: Sequence[str], regex: str = "(.*)", labels: str = "labels") -> DataFrame:
    return samples.filter(_joined(sources, labels).rlike(anchored(regex)))


def relabel_drop(samples: DataFrame, sources: Sequence[str], regex: str = "(.*)", labels: str = "labels") -> DataFrame:
    return samples.filter(~_joined(sources, labels).rlike(anchored(regex)))


def relabel_replace(
    samples: DataFrame,
    sources: Sequence[str],
    target: str,
    regex: str = "(.*)",
    replacement: str = "$1",
    labels: str = "labels",
) -> DataFrame:
    """Set ``target`` from the joined sources; no match leaves the row alone, and an empty
    result removes the label."""
    joined = _joined(sources, labels)
    value = F.regexp_replace(joined, anchored(regex), re.sub(r"\$\{(\w+)\}", r"$\1", replacement))
    others = F.map_filter(labels, lambda k, v: k != target)
    changed = F.when(value == "", others).otherwise(F.map_concat(others, F.create_map(F.lit(target), value)))
    return samples.withColumn(labels, F.when(joined.rlike(anchored(regex)), changed).otherwise(F.col(labels)))


def label_keep(samples: DataFrame, regex: str, labels: str = "labels") -> DataFrame:
    return samples.withColumn(labels, F.map_filter(labels, lambda k, v: k.rlike(anchored(regex))))


def label_drop(samples: DataFrame, regex: str, labels: str = "labels") -> DataFrame:
    return samples.withColumn(labels, F.map_filter(labels, lambda k, v: ~k.rlike(anchored(regex))))
