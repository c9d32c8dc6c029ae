"""Query of the product codes."""

from __future__ import annotations

from tideline.llm import quantise
from tideline.llm.registry import query, table

PARTS, ENTRIES, ROUNDS = 8, 16, 6


def _codes_sql() -> str:
    """K-means of every part, a round at a time, over all pairs of part and entry."""
    near = """SELECT p.vec_id, p.part, min(row(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e)) AS best
      FROM p JOIN {book} b ON p.part = b.part GROUP BY 1, 2"""
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, part, q[part * len(q) // {PARTS} + 1 : (part + 1) * len(q) // {PARTS}] AS x FROM v, range({PARTS}) t(part))",
        "c0 AS MATERIALIZED (SELECT * FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS c FROM p) "
        f"WHERE e < {ENTRIES})",
    ]
    for r in range(ROUNDS):
        steps += [
            f"a{r} AS MATERIALIZED ({near.format(book=f'c{r}')})",
            f"""m{r} AS MATERIALIZED (SELECT part, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS c FROM (
                SELECT part, a.best[2] AS e, place, sum(x[place]) AS s, count(*) AS n FROM a{r} a JOIN p USING (vec_id, part), range(1, 4096) t(place)
                WHERE place <= len(x) GROUP BY 1, 2, 3) GROUP BY 1, 2)""",
            f"c{r + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.c, b.c) AS c FROM c{r} b LEFT JOIN m{r} m ON b.part = m.part AND b.e = m.e)",
        ]
    last = f"c{ROUNDS}"
    return f"""
    WITH {", ".join(steps)},
    f AS MATERIALIZED ({near.format(book=last)}),
    d AS (SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM f GROUP BY 1),
    h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM {last})
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
    FROM d JOIN v USING (vec_id), h"""


@query("op13_anchor_codes", _codes_sql())
def op13(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    coded = quantise.encode(vectors, "vec_id", "embedding", "label", PARTS, ENTRIES, ROUNDS)
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
