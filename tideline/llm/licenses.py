"""License notices as an exact set-similarity join between text blocks and notice templates.

A text is cut into overlapping blocks of words, so that every place as long as a template lies whole
in some block. A block matches a template when it holds at least ``threshold`` of the template's
distinct words. The join finds all such pairs exactly, without comparing every block with every template:

* prefix filter: template words are ordered by how many documents hold them, rarest first. A
  matching block must hold one of a template's first ``size - need + 1`` words, so only documents with
  such a rare word are cut into blocks at all, and blocks meet templates in an equi-join on it;
* length filter: a block with fewer template words than needed cannot match;
* positional filter: the words after the shared one, in block and template, bound the overlap;
* what is left is verified on the whole word sets.

Only column expressions, aggregates and joins. The templates are configuration, so their word list,
the prefix table and the order (one count per template word, the only thing read back) are small
whatever the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-case words: runs of ASCII letters and digits and anything beyond ASCII; null has none."""
    plain = F.trim(F.regexp_replace(F.lower(text), SEPARATORS, " "))
    return F.when(F.length(plain) > 0, F.split(plain, " ")).otherwise(F.array().cast("array<string>"))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def phrase_places(words: Column, phrases: Sequence[tuple[str, ...]]) -> Column:
    """Starts (from 0) of all places where the words of one of ``phrases`` stand in a row.

    The positions are only walked through in rows that hold a phrase at all.
    """
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    held = F.lit(False)
    for phrase in phrases:
        held = held | joined.contains(f" {' '.join(phrase)} ")

    def starts(i: Column) -> Column:
        found = F.lit(False)
        for phrase in phrases:
            here = F.lit(True)
            for k, word in enumerate(phrase):
                here = here & F.coalesce(F.get(words, i + k) == word, F.lit(False))
            found = found | here
        return found

    return F.when(held, F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), starts)).otherwise(
        F.array().cast("array<int>")
    )


def template_sets(templates: Mapping[str, str]) -> dict[str, list[str]]:
    """Distinct words of each template, by the rule of :func:`words_of` for ASCII texts."""
    out = {}
    for label, text in templates.items():
        plain = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower())
        out[label] = sorted(set(plain.split()))
        if not out[label]:
            raise ValueError(f"template {label} has no words")
    return out


def word_order(docs: DataFrame, words: str, vocabulary: Sequence[str]) -> list[str]:
    """``vocabulary`` by the number of rows that hold each word, rarest first, ties by the word."""
    held = docs.select(F.explode(F.array_intersect(F.col(words), _strings(vocabulary))).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def containment_join(
    docs: DataFrame,
    keys: Sequence[str],
    words: str,
    templates: Mapping[str, str],
    threshold: float = 0.8,
    block: int = 64,
) -> DataFrame:
    """(``keys``, block_start, label, containment): every block that holds ``threshold`` of a template.

    ``words`` is an array column. Blocks have ``block`` words and start every ``block / 2``, so a
    place of up to ``block / 2 + 1`` words is never cut; templates must not be longer. Repeated rows
    give repeated results; rows without words none. Counting the word order reads ``docs`` once, when the
    result is built.
    """
    sets = template_sets(templates)
    if max(len(t) for t in sets.values()) > block // 2:
        raise ValueError("block must be at least twice as long as the longest template")
    vocabulary = sorted({w for t in sets.values() for w in t})
    order = word_order(docs, words, vocabulary)
    rank = {w: i for i, w in enumerate(order)}
    prefixes = []
    for label, tokens in sorted(sets.items()):
        ranks = sorted(rank[w] for w in tokens)
        need = math.ceil(threshold * len(ranks) - 1e-9)
        prefixes += [(r, label, ranks, i, need) for i, r in enumerate(ranks[: len(ranks) - need + 1])]
    spark = docs.sparkSession
    prefix = spark.createDataFrame(prefixes, "rank int, label string, ranks array<int>, place int, need int")
    rare = sorted({p[0] for p in prefixes})
    ranks_of = F.create_map(*[F.lit(x) for w, i in rank.items() for x in (w, i)])

    half = block // 2
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - half - 1, F.lit(0)), F.lit(half))
    blocks = (
        docs.filter(F.arrays_overlap(F.col(words), _strings([order[i] for i in rare])))
        .select(*keys, F.col(words).alias("_words"), F.explode(starts).alias("block_start"))
        .select(
            *keys,
            "block_start",
            F.array_intersect(F.slice("_words", F.col("block_start") + 1, block), _strings(vocabulary)).alias("_known"),
        )
        .filter(F.size("_known") > 0)
        .select(*keys, "block_start", F.array_sort(F.transform("_known", lambda w: ranks_of[w])).alias("_ranks"))
        .filter(F.arrays_overlap("_ranks", F.array(*[F.lit(r) for r in rare])))
    )
    seeds = blocks.select(*keys, "block_start", "_ranks", F.posexplode("_ranks").alias("_at", "rank"))
    size = F.size("_ranks")
    after = F.least(size - F.col("_at"), F.size("ranks") - F.col("place"))  # the shared word counts
    found = seeds.join(prefix, "rank").filter((size >= F.col("need")) & (after >= F.col("need")))
    overlap = F.size(F.array_intersect("_ranks", "ranks"))
    # A pair is taken at its first shared prefix word only.
    first = F.element_at(F.array_intersect("_ranks", F.slice("ranks", 1, F.size("ranks") - F.col("need") + 1)), 1)
    return found.filter((first == F.col("rank")) & (overlap >= F.col("need"))).select(
        *keys, "block_start", "label", (overlap / F.size("ranks")).alias("containment")
    )


def scan(
    docs: DataFrame,
    key: str,
    text: str,
    phrases: Sequence[tuple[str, str]],
    templates: Mapping[str, str],
    threshold: float = 0.8,
    block: int = 64,
) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score.

    ``phrases`` are (words, label) of notices that must stand verbatim; ``templates`` label -> text
    go through :func:`containment_join`. ``score`` is 1 where a phrase stands, else the greatest
    containment found, else 0. Null and empty texts have no words and no labels. Rows are kept one for
    one: a row's matches are found again by its key and a digest of its text, so repeated rows and
    null keys get the labels of their text. Columns of ``docs`` with the names of results are
    replaced.
    """
    results = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    split = [(tuple(words.split()), label) for words, label in phrases]
    base = docs.drop(*results, "_words", "_digest", "_places").withColumn("_words", words_of(F.col(text)))
    rows = base.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_digest"), "_words")
    found = (
        containment_join(rows, ["_key", "_digest"], "_words", templates, threshold, block)
        .groupBy("_key", "_digest")
        .agg(F.array_sort(F.collect_set("label")).alias("_found"), F.max("containment").alias("_best"))
    )
    joined = F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))
    none = F.array().cast("array<string>")
    labels = F.concat(
        *[
            F.when(joined.contains(f" {' '.join(words)} "), F.array(F.lit(label))).otherwise(none)
            for words, label in split
        ]
    )
    marked = (
        base.withColumn("_digest", F.xxhash64(text))
        .withColumn("_places", phrase_places(F.col("_words"), [words for words, _ in split]))
        .withColumn("_base", F.array_distinct(labels))
        .withColumn("n_words", F.size("_words").cast("long"))
        .drop("_words")
    )
    out = marked.join(found, F.col(key).eqNullSafe(F.col("_key")) & (marked["_digest"] == found["_digest"]), "left")
    all_labels = F.array_union("_base", F.coalesce("_found", none))
    return (
        out.withColumn("n_base", F.size("_places").cast("long"))
        .withColumn("first_word", F.array_min("_places").cast("long"))
        .withColumn("last_word", F.array_max("_places").cast("long"))
        .withColumn("base_labels", F.array_join(F.array_sort("_base"), ","))
        .withColumn("labels", F.array_join(F.array_sort(all_labels), ","))
        .withColumn("score", F.when(F.size("_places") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))))
        .select(*docs.drop(*results, "_words", "_digest", "_places").columns, *results)
    )
