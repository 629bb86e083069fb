"""Metrics of rankings and answers, percentiles, and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.functions.text import answer_tokens


def retrieval_by_question(hits: DataFrame, relevance: DataFrame, cutoffs: tuple[int, ...] = (1, 5, 10), keys: tuple[str, ...] = ()) -> DataFrame:
    """A row for each question of relevance(query_id, segment_id): hit rates, reciprocal rank and NDCG.

    hits(query_id, segment_id, rank) may have further key columns, which tell runs apart; every question then counts
    in every run. A question without hits scores 0."""
    truth = relevance.distinct()
    n = truth.groupBy("query_id").agg(F.count("segment_id").alias("n_relevant"))
    found = hits.join(truth, ["query_id", "segment_id"]).groupBy(*keys, "query_id").agg(
        F.min("rank").alias("first"),
        *(F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"_dcg{k}") for k in cutoffs),
    )
    asked = n if not keys else n.crossJoin(F.broadcast(hits.select(*keys).distinct()))  # runs are named by hand, so few
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_relevant").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = asked.join(found, [*keys, "query_id"], "left")
    return out.select(
        *keys, "query_id", "n_relevant",
        *(F.when(F.col("first") <= k, 1.0).otherwise(0.0).alias(f"recall_at_{k}") for k in cutoffs),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        *(F.when(F.col("n_relevant") > 0, F.coalesce(F.col(f"_dcg{k}"), F.lit(0.0)) / ideal(k)).otherwise(0.0).alias(f"ndcg_at_{k}") for k in cutoffs),
    )


def macro_average(by_question: DataFrame, keys: tuple[str, ...] = (), rollup: bool = False) -> DataFrame:
    """Means of all measures; with rollup also over all values of the last key (null there)."""
    measures = [c for c, t in by_question.dtypes if t == "double"]
    grouped = by_question.rollup(*keys) if rollup else by_question.groupBy(*keys)
    return grouped.agg(F.count(F.lit(1)).alias("questions"), *(F.avg(m).alias(m) for m in measures))


def answer_scores(pairs: DataFrame, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """pairs with exact_match and token_f1; a null prediction is an empty one."""
    p, r = answer_tokens(F.coalesce(F.col(prediction), F.lit(""))), answer_tokens(F.coalesce(F.col(reference), F.lit("")))
    count = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    shared = F.aggregate(F.array_distinct(F.col("_r")), F.lit(0), lambda s, t: s + F.least(count(F.col("_r"), t), count(F.col("_p"), t)))
    tokens = pairs.withColumn("_p", p).withColumn("_r", r).withColumn("_n", shared)
    f1 = F.when((F.size("_p") == 0) & (F.size("_r") == 0), 1.0).when(F.col("_n") == 0, 0.0).otherwise(2.0 * F.col("_n") / (F.size("_p") + F.size("_r")))
    return tokens.withColumn("exact_match", F.when(F.array_join("_p", "") == F.array_join("_r", ""), 1.0).otherwise(0.0)).withColumn("token_f1", f1).drop("_p", "_r", "_n")


def percentile_linear(value: Column, q: float) -> Column:
    return F.percentile(value, q)


def percentile_nearest(value: Column, q: float) -> Column:
    """The value at index round((n - 1) q), half to even. The values of one group meet in a task: for a report's few numbers;
    tables go to percentiles()."""
    ordered = F.array_sort(F.collect_list(value))
    return F.element_at(ordered, (F.bround((F.size(ordered) - 1) * F.lit(q)) + 1).cast("int"))


#: Ranges that a group's distinct values are cut into.
RANGES = 256


def percentiles(rows: DataFrame, groups: tuple[str, ...], value: str, linear: dict[str, float] | None = None, nearest: dict[str, float] | None = None) -> DataFrame:
    """(the groups, a column for each name): exact percentiles of groups of any size; nulls don't count. A linear one lies between
    the values at floor and ceil((n - 1) q), a nearest one is that at round((n - 1) q), half to even.

    Values are counted first. A sketch of each group's values cuts them into ranges, the counts of the ranges say in which
    one a wanted place lies, and only those ranges are sorted, each in a task of its own: no task sorts or holds a group."""
    wanted = [(name, q, True) for name, q in (linear or {}).items()] + [(name, q, False) for name, q in (nearest or {}).items()]
    keys = [f"_g{k}" for k in range(len(groups))]
    slim = rows.where(F.col(value).isNotNull()).select(*(F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)), F.col(value).alias("_v"))
    counted = slim.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    probes = [k / RANGES for k in range(1, RANGES)]
    shape = counted.groupBy(*keys).agg(F.percentile_approx("_v", probes, 4 * RANGES).alias("_cuts"), F.sum("_n").alias("_all"))
    at = lambda q: (F.col("_all") - 1) * F.lit(q)
    places = [p for _, q, between in wanted for p in ((F.floor(at(q)), F.ceil(at(q))) if between else (F.bround(at(q)),))]
    shape = shape.withColumn("_want", F.array_distinct(F.array(*(p.cast("long") for p in places))))

    def met(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        named = b.select(*(F.col(c).alias(f"{c}_r") if c in on else F.col(c) for c in b.columns))
        return a.join(named, [F.col(c).eqNullSafe(F.col(f"{c}_r")) for c in on]).drop(*(f"{c}_r" for c in on))

    dealt = met(counted, shape.select(*keys, "_cuts"), keys).withColumn("_r", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    before = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    shares = dealt.groupBy(*keys, "_r").agg(F.sum("_n").alias("_own")).withColumn("_before", F.coalesce(F.sum("_own").over(before), F.lit(0)))
    shares = met(shares, shape.select(*keys, "_want"), keys)
    held = shares.withColumn("_want", F.filter("_want", lambda p: (p >= F.col("_before")) & (p < F.col("_before") + F.col("_own")))).where(F.size("_want") > 0).drop("_own")
    upto = Window.partitionBy(*keys, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = met(dealt, held, [*keys, "_r"]).withColumn("_to", F.col("_before") + F.sum("_n").over(upto))
    picked = placed.select(*keys, "_v", F.explode(F.filter("_want", lambda p: (p < F.col("_to")) & (p >= F.col("_to") - F.col("_n")))).alias("_p"))
    by_place = picked.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_p", "_v"))).alias("_found"))  # two for each percentile
    done = met(by_place, shape.select(*keys, "_all"), keys)

    def result(q: float, between: bool) -> Column:
        value_at = lambda p: F.element_at("_found", p.cast("long"))
        if not between:
            return value_at(F.bround(at(q)))
        low, high = F.floor(at(q)), F.ceil(at(q))
        return F.when(low == high, value_at(low).cast("double")).otherwise((high - at(q)) * value_at(low) + (at(q) - low) * value_at(high))

    return done.select(*(F.col(k).alias(g) for k, g in zip(keys, groups, strict=True)), *(result(q, between).alias(name) for name, q, between in wanted))


def percentiles_nearest(rows: DataFrame, group: str, value: str, **q: float) -> DataFrame:
    return percentiles(rows, (group,), value, nearest=q)


def rank_delta(hits: DataFrame, baseline: DataFrame, relevance: DataFrame, missing: int = 999) -> DataFrame:
    """(query_id, before, after, change): best ranks of any relevant segment in two runs."""
    best = lambda h, name: h.join(relevance.distinct(), ["query_id", "segment_id"]).groupBy("query_id").agg(F.min("rank").alias(name))
    both = relevance.select("query_id").distinct().join(best(baseline, "before"), "query_id", "left").join(best(hits, "after"), "query_id", "left")
    both = both.select("query_id", *(F.coalesce(c, F.lit(missing)).alias(c) for c in ("before", "after")))
    return both.withColumn("change", F.when(F.col("after") < F.col("before"), "improved").when(F.col("after") > F.col("before"), "regressed").otherwise("unchanged"))


def order_parity(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, same_top1, same_order, same_set) of two runs' first k."""
    ids = lambda h, name: h.where(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "segment_id"))), lambda x: x["segment_id"]).alias(name))
    both = ids(a, "x").join(ids(b, "y"), "query_id", "full")
    none = F.array().cast("array<string>")
    both = both.select("query_id", *(F.coalesce(F.col(c).cast("array<string>"), none).alias(c) for c in ("x", "y")))
    return both.select("query_id", (F.try_element_at("x", F.lit(1)).eqNullSafe(F.try_element_at("y", F.lit(1)))).alias("same_top1"), (F.col("x") == F.col("y")).alias("same_order"), (F.array_sort("x") == F.array_sort("y")).alias("same_set"))


def latency_summary(samples: DataFrame, keys: tuple[str, ...] = ("route",), value: str = "ms") -> DataFrame:
    v = F.col(value)
    plain = samples.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.max(v).alias("max"))
    ranked = percentiles(samples, keys, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, {"p95_nearest": 0.95})
    named = ranked.select(*(F.col(k).alias(f"_{k}") for k in keys), "p50", "p95", "p99", "p95_nearest")
    both = plain.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")  # samples without a value keep their row
    return both.select(*keys, "n", "mean", "p50", "p95", "p99", "max", "p95_nearest")
