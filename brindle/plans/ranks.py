"""RANK and DENSE_RANK as Spark SQL that leaves no task more than a gap between two marks to sort, however few the partitions.

A plain window has a task sort a whole partition. Here the rows are first counted by partition and order key. Of the keys some are marks: a key with n rows
with a chance of n in MARK_EVERY, drawn by its hash, so that some MARK_EVERY rows lie between two marks, and a key with many rows is one almost surely.
Counts at and between the marks give each mark's ranks. Its rows take them from a broadcast join and are not dealt out; all others are ranked by a window
over their gap, beside what lies ahead of it. Partitions much smaller than MARK_EVERY seldom have a mark and are one gap. All rows are counted and ranked: the draw decides only where a partition is cut.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Rows between two marks, on average; a gap is sorted by one task. The marks are broadcast.
MARK_EVERY = 65_536
#: Steps of a search among a group's collected marks: the powers of two up to their number.
STEPS = "transform(sequence(CAST(floor(log2(count(*))) AS INT), 0, -1), k -> shiftleft(1, k)) AS steps"


@dataclass
class Ranking:
    """One OVER: the base's columns that it goes by, and the columns that get its ranks."""

    partition: list[str]
    order: list[str]
    descending: bool
    rank: str
    dense: str


def ranked_sql(base: str, columns: list[str], ranking: Ranking, repeatable: bool) -> str:
    """A query for a base query's columns and its rows' ranks.

    repeatable: whether the base has the same rows and values each time it is run. If not, a column that isn't deterministic has Spark run it once and
    share its shuffled rows, as the counts must be those of the rows that are ranked.
    """
    p, o = ranking.partition, ranking.order
    down = "false" if ranking.descending else "true"
    keys = ", ".join([*p, *o])
    by = f" GROUP BY {', '.join(p)}" if p else ""

    def listed(of: str, names: list[str]) -> str:
        return "".join(f"{of}.{n}, " for n in names)

    def same(a: str, b: str, names: list[str]) -> str:
        return " AND ".join(f"{a}.{n} <=> {b}.{n}" for n in names) or "true"

    def passed(of: str) -> str:
        """How many of its partition's marks a row is at or behind."""
        key = f"struct({', '.join(f'{of}.{n}' for n in o)})"
        return f"aggregate(m.steps, 0, (at, step) -> IF(get(m.marks, at + step - 1).key {'>=' if ranking.descending else '<='} {key}, at + step, at))"

    def over(names: list[str], order: str) -> str:
        return f"({'PARTITION BY ' + ', '.join(names) + ' ' if names else ''}ORDER BY {order})"

    key = f"struct({', '.join(o)})"
    order = ", ".join(f"{n} {'DESC' if ranking.descending else 'ASC'}" for n in o)
    shown = ", ".join(columns)
    own = ", ".join(f"b.{c}" for c in columns)
    gap = over([*p, "at"], order)
    ahead = over(p, "at, NOT own")
    kept = "x.own AND x.r >= x.n AND x.d > 0"  # true of every mark: it has each use of the marks need all counts, so that Spark counts once
    return f"""WITH `__base` AS ({base if repeatable else f'SELECT *, spark_partition_id() AS `__once` FROM ({base}) AS b'}),
`__keys` AS (SELECT {keys}, count(*) AS n FROM `__base` GROUP BY {keys}),
`__marks` AS (SELECT {''.join(f'{n}, ' for n in p)}sort_array(collect_list(struct({key} AS key)), {down}) AS marks, {STEPS} FROM `__keys` WHERE pmod(xxhash64({keys}), {MARK_EVERY}) < n{by}),
`__placed` AS (SELECT /*+ BROADCAST(m) */ {listed('k', p)}k.n, m.marks, {passed('k')} AS at, struct({', '.join(f'k.{n}' for n in o)}) AS key FROM `__keys` AS k JOIN `__marks` AS m ON {same('k', 'm', p)}),
`__counts` AS (SELECT {listed('x', p)}at, own, sum(n) AS n, count(*) AS k FROM (SELECT *, coalesce(get(marks, at - 1).key <=> key, false) AS own FROM `__placed`) AS x GROUP BY {listed('x', p)}at, own),
`__known` AS (SELECT {listed('x', p)}{''.join(f'key.{n} AS {n}, ' for n in o)}key, n, r, d FROM (SELECT /*+ BROADCAST(m) */ x.*, get(m.marks, at - 1).key AS key FROM (SELECT *, sum(n) OVER {ahead} AS r, sum(k) OVER {ahead} AS d FROM `__counts`) AS x JOIN `__marks` AS m ON {same('x', 'm', p)} WHERE {kept}) AS x),
`__lists` AS (SELECT {''.join(f'{n}, ' for n in p)}sort_array(collect_list(struct(key, r, d)), {down}) AS marks, {STEPS} FROM `__known`{by})
SELECT /*+ BROADCAST(m) */ {own}, CAST(m.r - m.n + 1 AS INT) AS {ranking.rank}, CAST(m.d AS INT) AS {ranking.dense} FROM `__base` AS b JOIN `__known` AS m ON {same('b', 'm', [*p, *o])}
UNION ALL
SELECT {shown}, CAST(coalesce(passed.r, 0) + rank() OVER {gap} AS INT) AS {ranking.rank}, CAST(coalesce(passed.d, 0) + dense_rank() OVER {gap} AS INT) AS {ranking.dense} FROM (
SELECT *, get(marks, at - 1) AS passed FROM (
SELECT /*+ BROADCAST(m) */ b.*, m.marks, IF(m.marks IS NULL, 0, {passed('b')}) AS at FROM (
SELECT /*+ BROADCAST(m) */ b.* FROM `__base` AS b LEFT ANTI JOIN `__known` AS m ON {same('b', 'm', [*p, *o])}
) AS b LEFT JOIN `__lists` AS m ON {same('b', 'm', p)}) AS x) AS x"""
