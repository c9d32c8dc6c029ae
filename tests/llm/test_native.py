"""Sharding, URL filters and license scans: edge cases beside the SQL comparison."""

import collections
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import helpers as h  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402
from tideline.llm import hosts, licenses, sharding  # noqa: E402
from tideline.llm.q_native import BLOCK, CONTAINMENT, PHRASES, RULES, TEMPLATES  # noqa: E402


def shards_of(spark, keys, shards):
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    return {r.k: r.s for r in df.select("k", sharding.shard_of("k", shards).alias("s")).collect()}


def test_few_records_move(spark):
    keys = [f"key{i}" for i in range(4000)]
    before = shards_of(spark, keys, [(i, 1.0) for i in range(8)])
    grown = shards_of(spark, keys, [(i, 1.0) for i in range(9)])
    assert all(grown[k] in (before[k], 8) for k in keys)
    assert 4000 / 9 * 0.8 < sum(grown[k] == 8 for k in keys) < 4000 / 9 * 1.2
    without = shards_of(spark, keys, [(i, 1.0) for i in range(8) if i != 3])
    assert all(without[k] == before[k] for k in keys if before[k] != 3)
    heavier = shards_of(spark, keys, [(i, 3.0 if i == 5 else 1.0) for i in range(8)])
    assert all(heavier[k] in (before[k], 5) for k in keys)
    assert abs(sum(s == 5 for s in heavier.values()) / 4000 - 0.3) < 0.03
    with pytest.raises(ValueError):
        sharding.shard_of("k", [(0, 0.0)])


def test_slots_of_odd_rows(spark):
    docs = h.odd_documents(spark)
    rows = sharding.place(docs, "doc_id", [(i, 1.0) for i in range(3)], ["text"]).collect()
    assert len(rows) == 13
    by_shard = collections.defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert sharding.place(h.empty_documents(spark), "doc_id", [(0, 1.0)]).collect() == []


URLS = [
    (1, "https://WWW.Example.ORG/es/x?y#z", "www.example.org", "/es/x", "example.org/es/", "block"),
    (2, "http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    (3, "http://notexample.org/en/12", "notexample.org", "/en/12", "org/", "allow"),
    (4, "x://a.com/fr/?q=/de/", "a.com", "/fr/", "com/fr/", "allow"),
    (5, "x://a.com?/de/", "a.com", "", None, None),
    (6, "x://org", "org", "", None, None),
    (7, "no scheme/de/", "", "", None, None),
    (8, None, "", "", None, None),
    (9, "", "", "", None, None),
    (10, "a://b://c.org/x", "b:", "//c.org/x", None, None),
    (11, "ftp://x.org\n/a\nb", "x.org\n", "/a\nb", None, None),
    (3, "http://notexample.org/en/12", "notexample.org", "/en/12", "org/", "allow"),
]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "mine") for i, u, *_ in URLS], "page_id long, url string, verdict string")
    rows = hosts.judge(pages, "url", RULES).collect()
    assert len(rows) == len(URLS)
    got = {r.page_id: r for r in rows}
    for i, _, host, path, rule, verdict in URLS:
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), i
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert hosts.judge(pages.limit(0), "url", RULES).collect() == []


def test_reputation_shrinks(spark):
    rows = [("bad.a.com", 1)] * 40 + [("good.a.com", 0)] * 40 + [("new.a.com", None)] * 5 + [("one.a.com", 1)]
    rows += [("x.b.net", 1)] * 30 + [("y.b.net", 1)] * 30 + [("z.b.net", None)] * 3 + [("q.c.co.uk", 0)] * 30 + [(None, 1)]
    pages = spark.createDataFrame(rows, "host string, bad int")
    got = {r.host: r for r in hosts.reputation(pages, "host", "bad").collect()}
    assert got["bad.a.com"].lower > 0.5 > got["good.a.com"].mean
    assert got["good.a.com"].mean < got["new.a.com"].mean < got["one.a.com"].mean < got["bad.a.com"].mean
    assert got["one.a.com"].lower < 0.5  # one page is no verdict
    assert got["z.b.net"].mean > got["new.a.com"].mean  # the domain speaks for its silent host
    assert got["q.c.co.uk"].mean < 0.2 and got[""].n == 1
    silent = hosts.reputation(pages.withColumn("bad", F.lit(None).cast("int")), "host", "bad").collect()
    assert {r.mean for r in silent} == {0.5} and all(r.lower < 0.5 for r in silent)


def test_registered_domains(spark):
    names = {"a.b.example.com": ("example.com", "com"), "x.co.uk": ("x.co.uk", "co.uk"), "w.x.co.uk": ("x.co.uk", "co.uk"),
             "co.uk": ("co.uk", "uk"), "localhost": ("localhost", "localhost"), "": ("", "")}
    df = spark.createDataFrame([(n,) for n in names], "h string")
    got = df.select("h", hosts.domain_of(F.col("h")).alias("d"), hosts.suffix_of(F.col("h")).alias("s")).collect()
    assert {r.h: (r.d, r.s) for r in got} == names


def scan(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licenses.scan(docs, "doc_id", "text", PHRASES, TEMPLATES, CONTAINMENT, BLOCK, **options).collect()
    return {r.doc_id: r for r in rows}


def test_phrases_and_templates(spark):
    filler = " ".join(f"w{i}" for i in range(200))
    got = scan(spark, [
        "CC BY cc-by Cc/By", "ALL RIGHTS\nreserved. General Public License", "ccby cc xby all rights",
        f"{filler} released UNDER the mit: license {filler}", f"{filler} under the MIT\n\nlicense {filler}",
        f"released {filler} under {filler} the {filler} mit {filler} license", "", None,
        "all rights all rights reserved", "version 3 Licence: GNU general public license work is under this licensed the",
    ])
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (6, 3, 0, 4, "cc-by")
    assert (got[1].n_base, got[1].base_labels, got[1].first_word, got[1].last_word) == (2, "gpl,reserved", 0, 3)
    assert (got[2].n_base, got[2].first_word, got[2].labels, got[2].score) == (0, None, "", 0.0)
    assert (got[3].labels, got[3].score) == ("mit", 1.0) and (got[4].labels, got[4].score) == ("mit", 0.8)
    assert got[5].labels == "" and got[6].n_words == got[7].n_words == 0
    assert (got[8].n_base, got[8].first_word) == (1, 2)
    assert "gpl-3.0" in got[9].labels


def test_every_place_is_in_a_block(spark):
    notice = "licensed under the apache license version 2 0"
    texts = [" ".join([*["f"] * n, notice, *["g"] * 90]) for n in range(0, 140, 3)]
    assert all(r.labels == "apache-2.0" for r in scan(spark, texts).values())


def test_license_odd_rows(spark):
    docs = h.odd_documents(spark)
    out = licenses.scan(docs, "doc_id", "text", PHRASES, TEMPLATES)
    assert out.count() == 13 and set(docs.columns) < set(out.columns)
    assert licenses.scan(h.empty_documents(spark), "doc_id", "text", PHRASES, TEMPLATES).collect() == []
    same = spark.createDataFrame([(1, "all rights reserved")] * 3 + [(None, "cc by")], "doc_id long, text string")
    assert [r.labels for r in licenses.scan(same, "doc_id", "text", PHRASES, TEMPLATES).orderBy("labels").collect()] == ["cc-by", *["reserved"] * 3]
