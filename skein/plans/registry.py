"""Where queries and their oracles are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with DuckDB SQL for the same rows unless SQL can't express it."""

    def register(f: Callable[[Tables], DataFrame]):
        name = f.__name__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return register


def troughs_sql(view: str, sigma: float, depth: float, edge: int) -> str:
    """Common table expressions up to tr (contig, w, n, ratio): the troughs of a view (contig, w, n), smoothed by a normal kernel cut at four deviations, mirrored at both ends.

    Series shorter than the kernel's reach go on with their end values. A trough is a level stretch lower than what is on both sides of it, in its middle, under `depth`
    times the median, and `edge` places from the ends.
    """
    reach = max(1, int(4 * sigma + 0.5))
    return (
        f"ro AS (SELECT contig, w, n, row_number() OVER (PARTITION BY contig ORDER BY w) - 1 AS i, count(*) OVER (PARTITION BY contig) AS size FROM {view}), "
        f"kn AS (SELECT o, exp(-0.5 * power(o / CAST({sigma} AS DOUBLE), 2)) AS e FROM (SELECT unnest(generate_series(-{reach}, {reach})) AS o)), "
        f"ix AS (SELECT contig, w, n, i, size, e, i + o AS j, CASE WHEN size >= {reach} THEN CASE WHEN i + o < 0 THEN -1 - i - o WHEN i + o >= size THEN 2 * size - 1 - i - o ELSE i + o END ELSE greatest(0, least(size - 1, i + o)) END AS at FROM ro, kn), "
        "sm AS (SELECT ix.contig, ix.w, ix.n, ix.i, ix.size, round(sum(b.n * e) / (SELECT sum(e) FROM kn), 9) AS v FROM ix JOIN ro b ON b.contig = ix.contig AND b.i = ix.at GROUP BY ALL), "
        "md AS (SELECT contig, median(v) AS med FROM sm GROUP BY contig), "
        "st AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY contig ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM sm), il AS (SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY i) AS island FROM st), "
        "pl AS (SELECT contig, island, min(i) AS a, max(i) AS b, any_value(v) AS v, any_value(size) AS size FROM il GROUP BY contig, island), "
        "nb AS (SELECT *, lag(v) OVER (PARTITION BY contig ORDER BY a) AS before, lead(v) OVER (PARTITION BY contig ORDER BY a) AS after FROM pl), "
        f"tr AS (SELECT sm.contig, sm.w, sm.n, round(nb.v / med, 6) AS ratio FROM nb JOIN md USING (contig) JOIN sm ON sm.contig = nb.contig AND sm.i = (nb.a + nb.b) // 2 WHERE nb.v < before AND nb.v < after AND med > 0 AND nb.v < {depth} * med AND sm.i >= {edge} AND sm.i < nb.size - {edge})"
    )
