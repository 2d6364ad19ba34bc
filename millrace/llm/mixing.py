"""Operator 1: mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). Each pattern can supply its
tokens up to `max_repeats` times, each repetition at a higher cost (convex), to the quotas of its sources; the
min-cost flow says how many tokens each source takes from each pattern. Documents are then selected in a seeded
order: whole repetitions go to all of a pattern's documents, the rest to those that come first, the last of them in part.

The flow runs on the driver over one row per pattern and source, which is the size of the mixture's own
description; documents are never gathered. Seeded selection needs no sort of a hot source: sizes are summed by
(pattern, hash bucket), and only the one bucket per pattern in which the quota ends is ordered row by row.

Nulls: a null text has size 0, a null source is a source of its own (last in order), a null doc_id is selected as
any other (it sorts first). Repeated rows and ties each count. Empty tables, or sizes that sum to 0, give targets of 0.
Very long texts are counted whole. Extra columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._run import fresh, pick, stash, table

WEIGHTS, MAX_REPEATS, SEED, BUCKET_DIGITS = (5, 2, 1), 3, "mix-1", 3
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: Sequence[int], weights: Sequence[int], cap: int = MAX_REPEATS) -> list[float]:
    """Shares of the total by weight; what a source can't take beyond cap times its size is reshared by weight."""
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(cap * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        over = {i for i in range(len(sizes)) if i not in capped and left * weights[i] > cap * sizes[i] * weight}
        if not over:
            return [float(cap * s) if i in capped else left * weights[i] / weight for i, s in enumerate(sizes)]
        capped |= over


def min_cost_flow(supply: dict, quota: dict, edges: Sequence[tuple], max_repeats: int = MAX_REPEATS) -> dict:
    """Tokens from pattern to source along edges (pattern, source), filling quotas at least cost.

    The k-th repetition of a pattern costs k - 1 a token. As costs only stand at the patterns, quotas are
    filled level by level: max flow at one repetition, then augmented at two, and so on (successive shortest paths).
    """
    flow = {e: 0 for e in edges}
    used, got = dict.fromkeys(supply, 0), dict.fromkeys(quota, 0)
    out: dict = {}
    back: dict = {}
    for p, s in edges:
        out.setdefault(p, []).append(s)
        back.setdefault(s, []).append(p)
    for level in range(1, max_repeats + 1):
        while True:
            came, queue = {}, deque()
            for p in supply:
                if used[p] < level * supply[p]:
                    came[("p", p)] = None
                    queue.append(("p", p))
            end = None
            while queue and end is None:
                kind, x = node = queue.popleft()
                if kind == "p":
                    for s in out.get(x, ()):
                        if ("s", s) not in came:
                            came[("s", s)] = node
                            if got[s] < quota[s]:
                                end = ("s", s)
                                break
                            queue.append(("s", s))
                else:
                    for p in back.get(x, ()):
                        if ("p", p) not in came and flow[(p, x)] > 0:
                            came[("p", p)] = node
                            queue.append(("p", p))
            if end is None:
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            room = [level * supply[path[0][1]] - used[path[0][1]], quota[end[1]] - got[end[1]]]
            room += [flow[(b[1], a[1])] for a, b in zip(path, path[1:]) if a[0] == "s"]
            push = min(room)
            for a, b in zip(path, path[1:]):
                if a[0] == "p":
                    flow[(a[1], b[1])] += push
                else:
                    flow[(b[1], a[1])] -= push
            used[path[0][1]] += push
            got[end[1]] += push
    return flow


def rank(seed: str = SEED, key: str = "doc_id") -> Column:
    """A document's place in the seeded order: the first 15 hex digits of an MD5, the same in every engine."""
    return F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 15)


def mix(documents: DataFrame, members: str = "sources", weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """Words that the mix takes of each row of documents (doc_id, size, `members`: array<string> of its sources).

    Returns doc_id, size, members, pattern, at, source_size, target, whole (times that all of the pattern is taken),
    more (words beyond them) and taken; source_size and target are sums over the row's sources. A row without
    sources takes nothing.
    """
    spark = documents.sparkSession
    docs = stash(documents.select("doc_id", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.col(members).alias("members"), F.to_json(F.struct(F.array_sort(F.col(members)).alias("m"))).alias("pattern"), rank(seed).alias("at")).withColumn("bucket", F.substring("at", 1, BUCKET_DIGITS)), "mix")
    sums = docs.groupBy("pattern", "members", "bucket").agg(F.sum("size").alias("size")).groupBy("pattern").agg(F.sum("size").alias("size"), F.first("members").alias("members")).collect()  # one row per pattern

    none = "\U0010ffff\U0010ffff"  # stands for a null source, after all others
    patterns = {r.pattern: (r.size, [none if m is None else m for m in (r.members or [])]) for r in sums}
    names = sorted({m for _, ms in patterns.values() for m in ms})
    sizes = [sum(n for n, ms in patterns.values() if name in ms) for name in names]
    target = dict(zip(names, targets(sizes, [weights[i % len(weights)] for i in range(len(names))], max_repeats)))
    size_of = dict(zip(names, sizes))
    flow = min_cost_flow({p: n for p, (n, _) in patterns.items()}, {m: int(round(t)) for m, t in target.items()}, [(p, m) for p, (_, ms) in sorted(patterns.items()) for m in dict.fromkeys(ms)], max_repeats)
    rows = [(p, int(sum(size_of[m] for m in set(ms))), float(sum(target[m] for m in set(ms))), int(sum(flow[(p, m)] for m in set(ms)) // n) if n else 0, int(sum(flow[(p, m)] for m in set(ms)) % n) if n else 0) for p, (n, ms) in patterns.items()]
    plan = spark.createDataFrame(rows, "pattern string, source_size long, target double, whole long, rest long")

    by = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = docs.groupBy("pattern", "bucket").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(by)).join(plan, "pattern")
    buckets = buckets.select("pattern", "bucket", "source_size", "target", "whole", (F.col("rest") - (F.col("upto") - F.col("n"))).alias("left"), "n")
    placed = docs.join(buckets, ["pattern", "bucket"])
    columns = ["doc_id", "size", "members", "pattern", "at", "source_size", "target", "whole"]
    clear = placed.where((F.col("left") <= 0) | (F.col("left") >= F.col("n"))).select(*columns, F.when(F.col("left") >= F.col("n"), F.col("size")).otherwise(0).alias("more"))
    order = Window.partitionBy("pattern").orderBy(F.col("at"), F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = placed.where((F.col("left") > 0) & (F.col("left") < F.col("n"))).withColumn("upto", F.sum("size").over(order))
    edge = edge.select(*columns, F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("upto") + F.col("size"))).alias("more"))
    return clear.unionByName(edge).withColumn("taken", (F.col("whole") * F.col("size") + F.col("more")).cast("long"))


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, size in words and the one-source membership of documents (doc_id, text, source)."""
    return pick(documents, "doc_id", "text", "source").select("doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.array("source").alias("sources"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def copies(documents: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it whole; a part counts as a copy from one half on.

    The texts are not shuffled: what decides is one row per pattern (broadcast; the driver has held as many).
    """
    mixed, own = mix(sized(documents)), fresh(documents, "__mix")
    last = F.max(F.when((F.col("more") > 0) & (2 * F.col("more") >= F.col("size")), F.struct("at", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))))
    cuts = mixed.groupBy("pattern").agg(F.first("whole").alias(f"{own}_whole"), last.alias(f"{own}_last")).withColumnRenamed("pattern", f"{own}_pattern")
    here = F.struct(rank().alias("at"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"))
    joined = documents.join(F.broadcast(cuts), F.to_json(F.struct(F.array("source").alias("m"))) == F.col(f"{own}_pattern"))
    n = F.col(f"{own}_whole").cast("int") + F.coalesce((here <= F.col(f"{own}_last")).cast("int"), F.lit(0))
    return joined.withColumn(f"{own}_k", F.explode(F.array_repeat(F.lit(0), n))).select(*[F.col(f"`{c}`") for c in documents.columns])


OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS at
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT source, n, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
o AS (
  SELECT source, n, w, sum(3 * n) OVER b AS capped, sum(w) OVER b AS cw, sum(n) OVER () AS total, sum(w) OVER () AS tw,
         row_number() OVER (ORDER BY n / w, source) AS k
  FROM w WINDOW b AS (ORDER BY n / w, source ROWS UNBOUNDED PRECEDING)),
c AS (SELECT coalesce(max(k), 0) AS k FROM (
  SELECT k, (total - (capped - 3 * n)) * w > 3 * n * (tw - (cw - w)) AS over FROM o) WHERE over),
t AS (
  SELECT o.source, o.n AS source_size,
         CASE WHEN o.k <= c.k THEN CAST(3 * o.n AS DOUBLE)
              ELSE (o.total - coalesce((SELECT max(capped) FROM o x WHERE x.k = c.k), 0)) * o.w / CAST(o.tw - coalesce((SELECT max(cw) FROM o x WHERE x.k = c.k), 0) AS DOUBLE) END AS target
  FROM o, c),
q AS (SELECT source, source_size, target, CAST(round_even(target, 0) AS BIGINT) AS quota FROM t),
r AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.quota // greatest(q.source_size, 1) AS whole, q.quota % greatest(q.source_size, 1) AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.at, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(whole * size + greatest(0, least(size, rest - upto + size)) AS BIGINT) AS taken
FROM r
"""
