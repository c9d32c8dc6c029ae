"""Data-quality rules over records, compiled to one column of violations.

Records are a VARIANT column (:func:`pyspark.sql.functions.parse_json`). A rule set is a list
of :class:`Field`; every rule becomes a column expression and Spark evaluates them all in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SQL_TYPES = {
    "string": "string",
    "bool": "boolean",
    "int": "bigint",
    "int32": "int",
    "float": "double",
    "duration": "string",
}
VIOLATION = "array<struct<path string, rule string>>"


@dataclass(frozen=True)
class Field:
    """Rules for one field; ``type`` is string, bool, int, int32, float, duration, struct, list or map.

    With ``null_as_empty`` a null string is the empty string, and a null list or map has no entries.
    """

    name: str
    type: str = "string"
    required: bool = False
    allow_null: bool = False
    null_as_empty: bool = False
    allow_empty: bool = True
    default: Any = None
    default_field: str | None = None
    allowed: Sequence | None = None
    disallowed: Sequence | None = None
    gt: float | None = None
    ge: float | None = None
    lt: float | None = None
    le: float | None = None
    multiple_of: float | None = None
    prefix: str | None = None
    suffix: str | None = None
    invalid_prefixes: Sequence[str] = ()
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    fields: Sequence[Field] = ()
    item: Field | None = None
    allow_unknown: bool = False
    tag: str | None = None
    variants: dict[str, Sequence[Field]] = field(default_factory=dict)


# JSON kinds by the first letters of the name Spark gives their type.
KINDS = {
    "VOI": "null",
    "STR": "string",
    "BOO": "bool",
    "BIG": "int",
    "DEC": "float",
    "DOU": "float",
    "FLO": "float",
    "OBJ": "struct",
    "ARR": "list",
}


def _step(name: str) -> str:
    return "." + name if name.replace("_", "").isalnum() else f"['{name}']"


def type_of(value: Column) -> Column:
    """JSON kind of a variant: string, bool, int, float, struct, list, null; SQL null if absent."""
    names = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.try_element_at(names, F.substring(F.schema_of_variant(value), 1, 3))


def seconds(text: Column) -> Column:
    """Seconds of a duration such as ``1h30m``, ``250ms``, ``1.5s``; null if malformed."""
    number = r"[0-9]+(?:\.[0-9]+)?"
    valid = text.rlike(rf"^(?:0|(?:{number}(?:h|m|s|ms|us))+)$")
    parts = F.regexp_extract_all(text, F.lit(rf"({number}(?:ms|us|h|m|s))"), F.lit(1))
    scale = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001, "us": 0.000001}

    def one(part: Column) -> Column:
        unit = F.regexp_replace(part, r"[0-9.]", "")
        factor = F.try_element_at(F.create_map(*[F.lit(x) for pair in scale.items() for x in pair]), unit)
        return F.regexp_replace(part, r"[a-z]", "").cast("double") * factor

    return F.when(valid, F.aggregate(F.transform(parts, one), F.lit(0.0), lambda a, x: a + x))


def _typed(raw: Column, kind: Column, rule: Field) -> Column:
    """The value in its SQL type, if the JSON kind fits without loss; else null."""
    kinds = {"string": ["string"], "duration": ["string"], "bool": ["bool"], "float": ["int", "float"]}
    value = F.when(kind.isin(kinds.get(rule.type, ["int"])), F.try_variant_get(raw, "$", SQL_TYPES[rule.type]))
    return F.when(kind == "null", "").otherwise(value) if rule.null_as_empty and rule.type == "string" else value


def _violation(path: Column, rule: str) -> Column:
    return F.struct(path.alias("path"), F.lit(rule).alias("rule"))


def _checks(
    raw: Column, kind: Column, value: Column | None, rule: Field, path: Column, number: Column | None = None
) -> list[Column]:
    """A violation or null for each rule of one field, given its variant, kind and typed value."""
    out = []
    fail = lambda cond, name: out.append(F.when(cond, _violation(path, name)))
    if rule.required:
        fail(raw.isNull(), "required")
    if not rule.allow_null and not rule.null_as_empty:
        fail(kind == "null", "null")
    if value is not None:
        fail(kind.isNotNull() & (kind != "null") & value.isNull(), "type")
        return out + _value_checks(value, rule, path, number)
    wrong = {"struct": "struct", "map": "struct", "list": "list"}[rule.type]
    fail(kind.isNotNull() & ~kind.isin(wrong, "null"), "type")
    return out


def _value_checks(value: Column, rule: Field, path: Column, number: Column | None = None) -> list[Column]:
    """Checks of a typed value; ``number`` are the seconds of a duration, if known already."""
    out = []
    fail = lambda cond, name: out.append(F.when(cond, _violation(path, name)))
    if rule.type != "duration":
        number = value
    else:
        number = seconds(value) if number is None else number
        fail(value.isNotNull() & number.isNull(), "duration")
    if rule.gt is not None:
        fail(number <= rule.gt, "gt")
    if rule.ge is not None:
        fail(number < rule.ge, "ge")
    if rule.lt is not None:
        fail(number >= rule.lt, "lt")
    if rule.le is not None:
        fail(number > rule.le, "le")
    if rule.multiple_of is not None:
        # Durations are compared in whole microseconds.
        if rule.type == "duration":
            fail(F.round(number * 1e6).cast("long") % int(rule.multiple_of * 1e6) != 0, "multiple_of")
        else:
            fail(number % rule.multiple_of != 0, "multiple_of")
    if not rule.allow_empty:
        fail(value == "", "empty")
    if rule.allowed is not None:
        fail(~value.isin(list(rule.allowed)), "allowed")
    if rule.disallowed is not None:
        fail(value.isin(list(rule.disallowed)), "disallowed")
    if rule.max_length is not None:
        fail(F.octet_length(value) > rule.max_length, "max_length")
    if rule.min_length is not None:
        fail(F.octet_length(value) < rule.min_length, "min_length")
    if rule.prefix is not None:
        fail(~F.startswith(value, F.lit(rule.prefix)), "prefix")
    if rule.suffix is not None:
        fail(~F.endswith(value, F.lit(rule.suffix)), "suffix")
    for prefix in rule.invalid_prefixes:
        fail(F.startswith(value, F.lit(prefix)), "invalid_prefix")
    if rule.pattern is not None:
        fail(~value.rlike(rule.pattern), "pattern")
    return out


def _present(checks: Sequence[Column]) -> Column:
    return F.filter(F.array(*checks), lambda v: v.isNotNull())


def _none() -> Column:
    return F.array().cast(VIOLATION)


@dataclass
class _Node:
    """A field found while walking the rules: where it lies and when it is looked at."""

    rule: Field
    path: str
    json_path: str
    parent: str | None  # column with the parent's kind
    guard: tuple[str, str] | None  # column with the tag, wanted tag
    names: tuple[str, ...] | None  # known keys, if unknown ones are flaws
    raw: str = ""
    kind: str = ""
    value: str = ""


def _walk(fields, path, json_path, parent, guard, nodes):
    for rule in fields:
        node = _Node(rule, path + rule.name, json_path + _step(rule.name), parent, guard, None)
        n = len(nodes)
        node.raw, node.kind, node.value = f"_raw{n}", f"_kind{n}", f"_value{n}"
        nodes.append(node)
        if rule.type != "struct":
            continue
        if rule.tag is None:
            if not rule.allow_unknown:
                node.names = tuple(f.name for f in rule.fields)
            _walk(rule.fields, node.path + ".", node.json_path, node.kind, None, nodes)
            continue
        tag = Field(rule.tag, allowed=list(rule.variants))
        _walk([tag], node.path + ".", node.json_path, node.kind, None, nodes)
        tag_node = nodes[-1]
        for name, variant in rule.variants.items():
            _walk(variant, node.path + ".", node.json_path, node.kind, (tag_node.value, name), nodes)


def check_records(
    rows: DataFrame,
    fields: Sequence[Field],
    record: str = "record",
    allow_unknown: bool = False,
    first_only: bool = False,
) -> DataFrame:
    """Adds ``violations``, all of them or (``first_only``) at most the first.

    Values, their kinds and their typed forms are columns of their own, one projection after
    the other, so each is worked out once per row however many rules look at it.
    """
    root = _Node(Field("", "struct"), "", "$", None, None, None, "_raw", "_kind", "")
    root.names = None if allow_unknown else tuple(f.name for f in fields)
    nodes: list[_Node] = []
    _walk(fields, "", "$", "_kind", None, nodes)
    staged = rows.withColumns(
        {"_raw": F.col(record), **{n.raw: F.try_variant_get(record, n.json_path, "variant") for n in nodes}}
    )
    staged = staged.withColumns({n.kind: type_of(F.col(n.raw)) for n in [root, *nodes]})
    values = {}
    for n in nodes:
        if n.rule.type in SQL_TYPES:
            values[n.value] = _typed(F.col(n.raw), F.col(n.kind), n.rule)
        elif n.rule.type == "list":
            values[n.value] = F.when(F.col(n.kind) == "list", F.try_variant_get(n.raw, "$", "array<variant>"))
    for n in [root, *nodes]:
        if n.rule.type == "struct" and (n.names is not None or n.rule.tag):
            keys = F.map_keys(F.try_variant_get(n.raw, "$", "map<string,variant>"))
            values[n.kind + "_keys"] = F.when(F.col(n.kind) == "struct", keys)
    staged = staged.withColumns(values)
    timed = [n for n in nodes if n.rule.type == "duration"]
    staged = staged.withColumns({n.value + "_s": seconds(F.col(n.value)) for n in timed}) if timed else staged
    checks: list[Column] = []
    parts: list[Column] = []
    for n in nodes:
        found, items = _violations_of(n)
        checks += found
        parts += items
    # One array holds the outcome of every plain rule, so the row is filtered once.
    parts = [_present(checks), *parts]
    parts += [_unknown(n) for n in [root, *nodes] if n.names is not None or n.rule.tag]
    whole = F.when(F.col("_kind") == "struct", F.concat(*parts)).otherwise(F.array(_violation(F.lit(""), "type")))
    checked = staged.withColumn("violations", F.slice(whole, 1, 1) if first_only else whole)
    return checked.select(*rows.columns, "violations")


def violation_rows(checked: DataFrame, *keep: str) -> DataFrame:
    """One row per violation.

    The outer form keeps Spark from inferring a filter on the whole array, which would be
    pushed below the staged columns and evaluate every rule anew.
    """
    return checked.select(*keep, F.inline_outer("violations")).filter(F.col("rule").isNotNull())


def _violations_of(n: _Node) -> tuple[list[Column], list[Column]]:
    """Checks of one field, each a violation or null, and arrays of violations in its items."""
    path, rule = F.lit(n.path), n.rule
    value = F.col(n.value) if rule.type in SQL_TYPES else None
    number = F.col(n.value + "_s") if rule.type == "duration" else None
    checks = _checks(F.col(n.raw), F.col(n.kind), value, rule, path, number)
    items: list[Column] = []
    seen = F.lit(True)
    if n.parent is not None and n.parent != "_kind":
        seen = seen & (F.col(n.parent) == "struct")
    if n.guard is not None:
        seen = seen & (F.col(n.guard[0]) == n.guard[1])
    if rule.type == "list":
        size = F.size(n.value)
        if rule.null_as_empty:
            size = F.when(F.col(n.kind) == "null", 0).otherwise(size)
        if rule.min_length is not None:
            checks.append(F.when((size >= 0) & (size < rule.min_length), _violation(path, "min_length")))
        if rule.max_length is not None:
            checks.append(F.when(size > rule.max_length, _violation(path, "max_length")))
        if rule.item is not None:
            kinds = F.transform(n.value, lambda x: F.struct(x.alias("raw"), type_of(x).alias("kind")))
            found = F.flatten(F.transform(kinds, _item_checker(rule.item, n.path)))
            items.append(F.coalesce(F.when(seen, found), _none()))
    if rule.tag is not None:
        tag = F.try_variant_get(n.raw, "$" + _step(rule.tag), "string")
        absent = (F.col(n.kind) == "struct") & tag.isNull()
        checks.append(F.when(absent, _violation(F.lit(f"{n.path}.{rule.tag}"), "tag")))
    nested = n.guard is not None or n.parent not in (None, "_kind")
    return [F.when(seen, c) for c in checks] if nested else checks, items


def _item_checker(rule: Field, path: str):
    """Checks of one list item; items that are structs are looked into, to any depth."""

    def check(item: Column, i: Column) -> Column:
        here = F.concat(F.lit(path + "["), i.cast("string"), F.lit("]"))
        return _inline(item["raw"], item["kind"], rule, here)

    return check


def _inline(raw: Column, kind: Column, rule: Field, here: Column) -> Column:
    """All violations of a value at ``here`` and of everything in it, to any depth."""
    value = _typed(raw, kind, rule) if rule.type in SQL_TYPES else None
    parts = [_present(_checks(raw, kind, value, rule, here))]
    if rule.type == "list":
        parts.append(F.when(kind == "list", _list_inline(raw, rule, here)).otherwise(_none()))
    if rule.type == "struct":
        inside = [_field_inline(raw, inner, here) for inner in rule.fields]
        if rule.tag is not None:
            inside.append(_union_inline(raw, rule, here))
        elif not rule.allow_unknown:
            inside.append(_extra(_keys(raw), [f.name for f in rule.fields], here))
        if inside:
            parts.append(F.when(kind == "struct", F.concat(*inside)).otherwise(_none()))
    return F.concat(*parts)


def _keys(raw: Column) -> Column:
    return F.map_keys(F.try_variant_get(raw, "$", "map<string,variant>"))


def _field_inline(raw: Column, rule: Field, here: Column) -> Column:
    inner = F.try_variant_get(raw, "$" + _step(rule.name), "variant")
    return _inline(inner, type_of(inner), rule, F.concat(here, F.lit("." + rule.name)))


def _list_inline(raw: Column, rule: Field, here: Column) -> Column:
    values = F.try_variant_get(raw, "$", "array<variant>")
    checks = []
    if rule.min_length is not None:
        checks.append(F.when(F.size(values) < rule.min_length, _violation(here, "min_length")))
    if rule.max_length is not None:
        checks.append(F.when(F.size(values) > rule.max_length, _violation(here, "max_length")))
    parts = [_present(checks)] if checks else []
    if rule.item is not None:
        kinds = F.transform(values, lambda x: F.struct(x.alias("raw"), type_of(x).alias("kind")))

        def check(item: Column, i: Column) -> Column:
            inner = F.concat(here, F.lit("["), i.cast("string"), F.lit("]"))
            return _inline(item["raw"], item["kind"], rule.item, inner)

        parts.append(F.flatten(F.transform(kinds, check)))
    return F.concat(*parts) if parts else _none()


def _union_inline(raw: Column, rule: Field, here: Column) -> Column:
    """A tagged union: the tag names the variant, whose fields are checked and are the only ones known."""
    tag = F.try_variant_get(raw, "$" + _step(rule.tag), "string")
    found = _field_inline(raw, Field(rule.tag, allowed=list(rule.variants)), here)
    for name, variant in rule.variants.items():
        own = [_field_inline(raw, inner, here) for inner in variant]
        own.append(_extra(_keys(raw), [rule.tag, *[f.name for f in variant]], here))
        found = F.concat(found, F.when(tag == name, F.concat(*own)).otherwise(_none()))
    absent = F.when(tag.isNull(), _violation(F.concat(here, F.lit("." + rule.tag)), "tag"))
    return F.concat(found, _present([absent]))


def _extra(keys: Column, names: Sequence[str], path: Column) -> Column:
    prefix = F.when(path == "", "").otherwise(F.concat(path, F.lit(".")))
    extra = F.array_except(keys, F.array(*[F.lit(n) for n in names]).cast("array<string>"))
    return F.transform(extra, lambda k: F.struct(F.concat(prefix, k).alias("path"), F.lit("unknown").alias("rule")))


def _unknown(n: _Node) -> Column:
    """Keys that no rule names; for tagged structs those of the tag's own variant count."""
    keys, path = F.col(n.kind + "_keys"), F.lit(n.path)
    if n.rule.tag is None:
        return F.coalesce(_extra(keys, n.names, path), _none())
    tag = F.try_variant_get(n.raw, "$" + _step(n.rule.tag), "string")
    found = _none()
    for name, variant in n.rule.variants.items():
        known = [n.rule.tag, *[f.name for f in variant]]
        found = F.when(tag == name, _extra(keys, known, path)).otherwise(found)
    return F.coalesce(found, _none())


def resolved(rows: DataFrame, fields: Sequence[Field], record: str = "record") -> DataFrame:
    """Adds each plain field as a typed column, absent ones filled from their default or default field."""
    plain = [f for f in fields if f.type in SQL_TYPES]
    staged = rows.withColumns({f"_raw_{f.name}": F.try_variant_get(record, "$" + _step(f.name), "variant") for f in plain})
    staged = staged.withColumns({f"_kind_{f.name}": type_of(F.col(f"_raw_{f.name}")) for f in plain})
    columns: dict[str, Column] = {}
    for rule in plain:
        raw = F.col(f"_raw_{rule.name}")
        value = _typed(raw, F.col(f"_kind_{rule.name}"), rule)
        if rule.default_field is not None:
            value = F.when(raw.isNull(), columns[rule.default_field]).otherwise(value)
        elif rule.default is not None:
            value = F.when(raw.isNull(), F.lit(rule.default)).otherwise(value)
        columns[rule.name] = value
    return staged.select(*rows.columns, *[c.alias(name) for name, c in columns.items()])


def duration_seconds(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({f"{name}_s": seconds(F.col(name)) for name in names})
