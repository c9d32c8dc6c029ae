"""Queries of the native operators: sharding, URL filters, license scans."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tideline.llm import hosts, licenses, sharding
from tideline.llm.registry import query, table

SHARDS = 24

#: The rules of the URL query as (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: Verbatim notices and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Notice templates of the license query.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
    "and associated documentation files",
    "mpl-2.0": "subject to the terms of the Mozilla Public License, v. 2.0",
    "public-domain": "This is free and unencumbered software released into the public domain",
    "reserved": "All rights reserved",
}
CONTAINMENT, BLOCK = 0.8, 64

_D = "coalesce(CAST(doc_id AS VARCHAR), '')"


def _cost(shard: int) -> str:
    return f"CAST('0x' || substr(md5({_D} || ':{shard}'), 1, 13) AS BIGINT)"


#: The cyclic redundancy check of zip files over the bytes of the text, with its table made by rule.
CRC_SQL = """
bits AS (SELECT n, 0 AS k, n AS v FROM range(256) r(n)
         UNION ALL SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END
         FROM bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY n) AS t FROM bits WHERE k = 8)"""

OP2_SQL = f"""
WITH RECURSIVE {CRC_SQL},
bytes AS (
    SELECT doc_id, text, octet_length(encode(coalesce(text, ''))) AS n,
           hex(encode(coalesce(text, ''))) AS h, md5({_D}) AS d,
           [{", ".join(_cost(i) for i in range(SHARDS + 1))}] AS cost
    FROM documents),
placed AS (
    SELECT doc_id, n + 8 AS size, n, h, d, list_position(cost[1:{SHARDS}], list_max(cost[1:{SHARDS}])) - 1 AS shard,
           list_position(cost, list_max(cost)) - 1 AS grown
    FROM bytes),
checked AS (
    SELECT doc_id, size, shard, grown, d,
           xor(list_reduce(list_prepend(4294967295::BIGINT,
               list_transform(range(n), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
    FROM placed, crc_table)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY substr(d, 1, 3), doc_id, size, crc) - 1 AS slot,
       grown::INTEGER AS grown_shard
FROM checked
"""


@query("op2_rendezvous_shards", OP2_SQL)
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    grown = [(i, 1.0) for i in range(SHARDS + 1)]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        sharding.shard_of("doc_id", grown).cast("int").alias("grown_shard"),
    )
    placed = sharding.place(rows, "doc_id", grown[:SHARDS], order=["size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _rules_sql() -> str:
    cases = []
    for verdict, at, start in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block")):
        fits = f"(host = '{at}' OR suffix(host, '.{at}')) AND prefix(path, '{start}')"
        cases.append(f"WHEN {fits} THEN '{at + start}:{verdict}'")
    return "CASE " + " ".join(cases) + " END"


def _shrunk_sql(groups: str, parent: str) -> str:
    """Weight of the beta prior of a level: spread of the groups beyond binomial noise."""
    return f"""(SELECT coalesce(round(CASE WHEN share > 0 THEN least(greatest((1 - share) / share, 1.0), 1000.0)
                ELSE 1000.0 END, 6), 1000.0)
     FROM (SELECT (CASE WHEN total - squares / total > 0 THEN greatest(spread, 0.0) / (total - squares / total) END)
                  / nullif(noise / total, 0) AS share
           FROM (SELECT sum(n * pow(bad / n - {parent}, 2) - {parent} * (1 - {parent})) AS spread,
                        sum(n * {parent} * (1 - {parent})) AS noise, sum(n)::DOUBLE AS total,
                        sum(n::DOUBLE * n) AS squares
                 FROM {groups} WHERE n > 0)))"""


OP7_SQL = rf"""
WITH parts AS (
    SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                              '{hosts.UPPER}', '{hosts.LOWER}') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
ruled AS (SELECT *, {_rules_sql()} AS r FROM parts),
host_n AS (
    SELECT host, count(r) AS n, count(*) FILTER (WHERE r LIKE '%:block')::DOUBLE AS bad, string_split(host, '.') AS l
    FROM ruled GROUP BY host),
named AS (
    SELECT *, CASE WHEN len(l) > 2 AND length(l[-1]) = 2 AND l[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org')
              THEN 2 ELSE 1 END AS k FROM host_n),
h0 AS (
    SELECT host, n, bad, array_to_string(l[-k:], '.') AS suffix, array_to_string(l[-(k + 1):], '.') AS domain FROM named),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad,
              coalesce((SELECT round(sum(bad) / nullif(sum(n), 0), 9) FROM h0), 0.5) AS p FROM h0 GROUP BY suffix),
s1 AS (SELECT suffix, (bad + w * p) / (n + w) AS p FROM (SELECT *, {_shrunk_sql("s0", "p")} AS w FROM s0)),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(p) AS p
       FROM h0 JOIN s1 USING (suffix) GROUP BY domain, suffix),
d1 AS (SELECT domain, suffix, (bad + w * p) / (n + w) AS p FROM (SELECT *, {_shrunk_sql("d0", "p")} AS w FROM d0)),
h1 AS (SELECT host, n, bad, p FROM h0 JOIN d1 USING (domain, suffix)),
h2 AS (SELECT host, n, w, (bad + w * p) / (n + w) AS m FROM (SELECT *, {_shrunk_sql("h1", "p")} AS w FROM h1)),
known AS (SELECT host, m, m - 1.645 * sqrt(m * (1 - m) / (n + w + 1)) AS lower_bound FROM h2)
SELECT page_id, host, path, string_split(r, ':')[1] AS rule,
       coalesce(string_split(r, ':')[2], CASE WHEN lower_bound >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       round(m, 6) AS bad_share
FROM ruled JOIN known USING (host)
"""


@query("op7_host_reputation", OP7_SQL)
def op7(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = hosts.judge(pages, "url", RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("bad_share", 6).alias("bad_share"))


def _templates_sql() -> str:
    rows = []
    for label, words in licenses.template_sets(TEMPLATES).items():
        need = math.ceil(CONTAINMENT * len(words) - 1e-9)
        rows.append(f"('{label}', [{', '.join(repr(w) for w in words)}], {need})")
    return ", ".join(rows)


def _phrase_sql(words: str) -> str:
    return " AND ".join(f"coalesce(w[i + {k + 1}] = '{word}', false)" for k, word in enumerate(words.split()))


OP9_SQL = rf"""
WITH split AS (
    SELECT doc_id, hash(text) AS h, row_number() OVER () AS id,
           regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
templates(label, t, need) AS (VALUES {_templates_sql()}),
blocks AS (
    SELECT id, list_distinct(w[s + 1 : s + {BLOCK}]) AS b
    FROM (SELECT id, w, unnest(range(0, greatest(len(w) - {BLOCK // 2 + 1}, 0) + 1, {BLOCK // 2})) AS s FROM split)),
found AS (
    SELECT id, list(DISTINCT label) AS labels, max(n / len(t)) AS best
    FROM (SELECT id, label, t, need, len(list_intersect(b, t)) AS n FROM blocks, templates) WHERE n >= need
    GROUP BY id),
places AS (
    SELECT id, i, CASE {" ".join(f"WHEN {_phrase_sql(p)} THEN '{label}'" for p, label in PHRASES)} END AS label
    FROM (SELECT id, w, unnest(range(len(w))) AS i FROM split)),
base AS (
    SELECT id, count(*) AS n, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels
    FROM places WHERE label IS NOT NULL GROUP BY id)
SELECT doc_id, len(w) AS n_words, coalesce(base.n, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(coalesce(base.labels, []) || coalesce(found.labels, []))), ',') AS labels,
       CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM split LEFT JOIN base USING (id) LEFT JOIN found USING (id)
"""


@query("op9_license_blocks", OP9_SQL)
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, "doc_id", "text", PHRASES, TEMPLATES, CONTAINMENT, BLOCK).drop("text")
