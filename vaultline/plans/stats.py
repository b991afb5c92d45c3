"""Agreement, resampling and effect sizes, as joins and aggregations over groups."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultline.functions.running import running_sums


def kappa(pairs: DataFrame, by: list[str] = (), a: str = "a", b: str = "b") -> DataFrame:
    """Cohen's kappa and raw agreement of two raters' labels per group; 1 where chance agreement is 1."""
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    one = F.lit(1).alias("_all")
    keys = [*by, "_all"]
    cells = rows.groupBy(*by, one, "a", "b").agg(F.count("*").alias("n"))
    total = cells.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agree"))
    left = cells.groupBy(*keys, F.col("a").alias("label")).agg(F.sum("n").alias("na"))
    right = cells.groupBy(*keys, F.col("b").alias("label")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, [*keys, "label"]).groupBy(*keys).agg(F.sum(F.col("na") * F.col("nb")).alias("chance"))
    both = total.join(chance, keys, "left").withColumns({"po": F.col("agree") / F.col("total"), "pe": F.coalesce("chance", F.lit(0)) / (F.col("total") * F.col("total"))})
    value = F.when(F.col("pe") >= 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return both.select(*by, F.col("total").alias("n"), (F.col("total") - F.col("agree")).alias("disagreements"), F.round("po", 6).alias("agreement"), F.round(value, 6).alias("kappa"))


def label_distribution(labels: DataFrame, column: str) -> DataFrame:
    return labels.groupBy(F.col(column).cast("string").alias("label")).agg(F.count("*").alias("n"))


def gold_labels(gold_hubs: DataFrame, tables: DataFrame) -> DataFrame:
    """hub, split or exclude for each table, by its number of gold hubs."""
    counts = gold_hubs.groupBy("system_id", "source_table").agg(F.count("*").alias("n"))
    joined = tables.join(counts, ["system_id", "source_table"], "left")
    return joined.select("system_id", "source_table", F.when(F.col("n").isNull(), "exclude").when(F.col("n") == 1, "hub").otherwise("split").alias("label"))


def majority(labels: DataFrame, item: str, label: str, order: str) -> DataFrame:
    """Each item's most frequent label; of ties, the one seen first by ``order``."""
    counts = labels.groupBy(item, label).agg(F.count("*").alias("votes"), F.min(order).alias("_first"))
    best = F.max_by(F.struct(label, "votes"), F.struct("votes", -F.col("_first"))).alias("_best")
    return counts.groupBy(item).agg(best).select(item, F.col(f"_best.{label}").alias(label), F.col("_best.votes").alias("votes"))


def kappa_panel(labels: DataFrame, item: str, annotator: str, label: str) -> DataFrame:
    """Kappa of every two annotators over the items that both labelled."""
    left = labels.select(item, F.col(annotator).alias("rater_a"), F.col(label).alias("a"))
    right = labels.select(item, F.col(annotator).alias("rater_b"), F.col(label).alias("b"))
    return kappa(left.join(right, item).where("rater_a < rater_b"), ["rater_a", "rater_b"])


EXACT_VALUE = "decimal(18,6)"


def drawn_number(digits: int, *parts: Column) -> Column:
    """A number of so many hexadecimal digits that the parts decide, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, digits), 16, 10).cast("long")


#: Up to so many values a group's draws are picks from its values, in one row; beyond, weights of its rows.
SMALL = 1000
CHUNKS = 32
#: P(Poisson(1) <= j) of 2^48, for j from 0.
POISSON = [round(2**48 * sum(math.exp(-1) / math.factorial(x) for x in range(j + 1))) for j in range(14)]


def places(df: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """``df`` with ``i``, each row's place from 0 in its group by value and then ``order``; no group is sorted by one task."""
    counted = running_sums(df.withColumn("one", F.lit(1)), by, [value, *order], {"upto": "one"})
    return counted.withColumn("i", (F.col("upto") - 1).cast("int")).drop("one", "upto")


def poisson_weight(number: Column) -> Column:
    """A weight of mean 1 from a number below 2^48."""
    return reduce(lambda a, t: a + (number >= t).cast("int"), POISSON, F.lit(0))


def weight_of(text: Column) -> Column:
    """``poisson_weight`` of a number of 12 hexadecimal digits as text: texts of one length compare as their numbers do, and most are
    decided by the first steps."""
    steps = [f"{t:012x}" for t in POISSON if t < 1 << 48]
    return reduce(lambda rest, k: F.when(text < steps[k], k).otherwise(rest), reversed(range(len(steps))), F.lit(len(steps)))


def bootstrap_ci(df: DataFrame, group: str, value: str, order: list[str], iterations: int = 10_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Percentile interval of each group's mean.

    Rows get a place from 0 in their group. In a group of at most SMALL values, draw i of iteration k takes the value at md5(group, k, i,
    seed) mod n of the group's array. In a larger one the row at place i has a Poisson weight by the same hash, which tends to the same law,
    and an iteration's mean is that of its weighted rows: map tasks add these up, so groups x iterations rows a task are shuffled and
    no row is joined with a draw. Any engine or rerun draws the same; values are summed as decimals, so the order of rows does not matter.
    """
    known = df.where(F.col(value).isNotNull()).select(group, F.col(value).cast(EXACT_VALUE).alias("v"), *order)
    sizes = known.groupBy(group).agg(F.count("*").alias("n"), (F.sum("v").cast("double") / F.count("*")).alias("mean"))
    number = lambda i: drawn_number(12, F.col(group), F.col("k"), i, F.lit(seed))
    few = known.join(sizes.where(F.col("n") <= SMALL).select(group, "n"), group).groupBy(group, "n")
    held = few.agg(F.array_sort(F.collect_list("v")).alias("vs"))
    ranges = [F.struct(F.lit(c * iterations // CHUNKS).alias("a"), F.lit((c + 1) * iterations // CHUNKS - 1).alias("b")) for c in range(CHUNKS) if (c + 1) * iterations // CHUNKS > c * iterations // CHUNKS]
    dealt = held.select("*", F.explode(F.array(*ranges)).alias("r")).repartition(group, "r")
    total = F.aggregate(F.sequence(F.lit(0), F.col("n").cast("int") - 1), F.lit(0).cast("decimal(38,6)"), lambda a, i: (a + F.get("vs", F.pmod(number(i), F.col("n")).cast("int"))).cast("decimal(38,6)"))
    picked = dealt.select(group, "n", "vs", F.explode(F.sequence("r.a", "r.b")).alias("k")).select(group, (total.cast("double") / F.col("n")).alias("m"))
    draws = df.sparkSession.range(iterations).select(F.col("id").alias("k"), F.col("id").cast("string").alias("_k"))
    large = places(known.join(sizes.where(F.col("n") > SMALL).select(group), group), [group], "v", order)
    # a value is three longs of six digits each, whose sums are exact and cost less than those of decimals
    micros = (F.col("v") * 1_000_000).cast("long")
    digits = {"_low": micros % 1_000_000, "_mid": F.expr("_v div 1000000 % 1000000"), "_high": F.expr("_v div 1000000000000")}
    texts = [F.concat_ws("|", F.col(group), F.lit("")).alias("_a"), F.concat(F.lit("|"), F.col("i").cast("string"), F.lit(f"|{seed}")).alias("_z")]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = large.withColumn("_v", micros).select(group, *(c.alias(n) for n, c in digits.items()), *texts).repartition(parts).crossJoin(F.broadcast(draws))
    drawn = many.select(group, "k", *digits, F.substring(F.md5(F.concat("_a", "_k", "_z")), 1, 12).alias("u")).select(group, "k", *digits, weight_of(F.col("u")).cast("long").alias("w"))
    weighed = drawn.groupBy(group, "k").agg(F.sum("w").alias("w"), *(F.sum(F.col(c) * F.col("w")).cast("decimal(38,0)").alias(c) for c in digits))
    exact = F.col("_low") + F.col("_mid") * F.lit(1_000_000) + F.col("_high") * F.lit(1_000_000_000_000)
    weighed = weighed.select(group, "w", (exact.cast("decimal(38,0)") / F.lit(1_000_000)).cast("decimal(38,6)").alias("s"))
    means = picked.unionByName(weighed.select(group, (F.col("s").cast("double") / F.col("w")).alias("m")))
    tail = (1 - level) / 2
    ends = F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail)))
    bounds = means.groupBy(group).agg(ends.alias("e"))
    return sizes.join(bounds, group).select(group, "n", "mean", F.col("e")[0].alias("low"), F.col("e")[1].alias("high"))


EXACT = 18


def permutation_test(pairs: DataFrame, by: list[str], alternative: str = "two-sided", iterations: int = 20_000, seed: int = 42) -> DataFrame:
    """Paired sign-flip test of the mean difference (``d``) per group: all 2^n flips up to 18 pairs, else seeded draws with the
    observed one counted in. Sums are decimals, so equal ones are equal and no order of rows matters. Draws meet a large group's rows
    where these are; map tasks add up each draw, and no group is gathered or sorted by one task."""
    spark = pairs.sparkSession
    rows = places(pairs.select(*by, F.col("d").cast(EXACT_VALUE).alias("d")), by, "d", [])
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("d").alias("observed"))
    sign = lambda bit: F.sum(F.when(bit == 0, F.col("d")).otherwise(-F.col("d"))).alias("s")
    exact = sizes.where(F.col("n") <= EXACT).select(*by, F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.col("n").cast("int")) - 1)).alias("k"))
    flipped = exact.join(rows, by).groupBy(*by, "k").agg(sign(F.call_function("shiftright", F.col("k"), F.col("i")).bitwiseAND(1)))
    coin = drawn_number(4, *map(F.col, by), F.col("k"), F.col("i"), F.lit(seed)).bitwiseAND(1)
    draws = spark.range(iterations).select(F.col("id").cast("int").alias("k"))
    sampled = rows.join(sizes.where(F.col("n") > EXACT).select(*by), by).crossJoin(F.broadcast(draws)).groupBy(*by, "k").agg(sign(coin))
    sums = flipped.unionByName(sampled).join(sizes, by)
    extreme = {"two-sided": F.abs("s") >= F.abs("observed"), "greater": F.col("s") >= F.col("observed"), "less": F.col("s") <= F.col("observed")}[alternative]
    hits = sums.groupBy(*by, "n", "observed").agg(F.sum(extreme.cast("int")).alias("hits"), F.count("*").alias("flips"))
    p = F.when(F.col("n") <= EXACT, F.col("hits") / F.col("flips")).otherwise((F.col("hits") + 1) / (F.col("flips") + 1))
    return hits.select(*by, F.col("n").cast("long").alias("n"), F.round(F.col("observed").cast("double") / F.col("n"), 6).alias("mean_difference"), F.round(p, 6).alias("p_value"))


def magnitude(delta: Column) -> Column:
    size = F.abs(delta)
    return F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large")


def cliffs_delta(rows: DataFrame, by: list[str], side: str, value: str) -> DataFrame:
    """Cliff's delta of side 'a' against side 'b' per group, by cumulative counts over distinct values: no pairs are formed."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.sum((F.col(side) == "a").cast("long")).alias("na"), F.sum((F.col(side) == "b").cast("long")).alias("nb"))
    ranked = running_sums(counts, by, ["v"], {"upto": "nb"}).withColumn("below", F.col("upto") - F.col("nb"))
    sums = ranked.groupBy(*by).agg(F.sum(F.col("na") * F.col("below")).alias("more"), F.sum(F.col("na") * F.col("nb")).alias("same"), F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    less = F.col("na") * F.col("nb") - F.col("more") - F.col("same")
    delta = F.when((F.col("na") > 0) & (F.col("nb") > 0), (F.col("more") - less) / (F.col("na") * F.col("nb")))
    return sums.select(*by, F.col("na").alias("n_a"), F.col("nb").alias("n_b"), F.round(delta, 6).alias("delta"), magnitude(delta).alias("magnitude"))


def paired(records: DataFrame, metric: str, a: str, b: str) -> DataFrame:
    """Values of two conditions side by side per (system, seed); only seeds that both have."""
    own = records.where((F.col("metric") == metric) & F.col("value").isNotNull())
    left = own.where(F.col("condition") == a).select("system_id", "seed", F.col("value").alias("va"))
    right = own.where(F.col("condition") == b).select("system_id", "seed", F.col("value").alias("vb"))
    return left.join(right, ["system_id", "seed"])


def compare(pairs: DataFrame, iterations: int = 2000, seed: int = 42) -> DataFrame:
    """Means, difference with interval, p-value and effect of paired values (system_id, seed, va, vb)."""
    rows = pairs.withColumn("d", F.col("vb") - F.col("va"))
    means = rows.groupBy("system_id").agg(F.count("*").alias("n"), *(F.round(F.sum(F.col(c).cast(EXACT_VALUE)).cast("double") / F.count("*"), 6).alias(n) for c, n in (("va", "mean_a"), ("vb", "mean_b"))))
    test = permutation_test(rows, ["system_id"], seed=seed).drop("n")
    sides = rows.select("system_id", F.lit("b").alias("side"), F.col("va").alias("v")).unionByName(rows.select("system_id", F.lit("a").alias("side"), F.col("vb").alias("v")))
    effect = cliffs_delta(sides, ["system_id"], "side", "v").select("system_id", "delta", "magnitude")
    interval = bootstrap_ci(rows, "system_id", "d", ["seed"], iterations, seed).select("system_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
    return means.join(test, "system_id").join(effect, "system_id").join(interval, "system_id")


def significance(records: DataFrame, metric: str, a: str, b: str, iterations: int = 2000, seed: int = 42) -> DataFrame:
    """``compare`` per system, and a note for systems whose conditions share no seed."""
    systems = records.select("system_id").distinct()
    out = compare(paired(records, metric, a, b), iterations, seed)
    return systems.join(out, "system_id", "left").withColumn("note", F.when(F.col("n").isNull(), "no common seed"))


def self_consistency(prints: DataFrame) -> DataFrame:
    """The share of runs with their system's most common fingerprint."""
    return prints.groupBy("system_id", "fingerprint").agg(F.count("*").alias("n")).groupBy("system_id").agg(F.round(F.max("n") / F.sum("n"), 6).alias("self_consistency"))


def idempotency(prints: DataFrame) -> DataFrame:
    """The share of later runs equal to their system's first."""
    first = prints.groupBy("system_id").agg(F.min_by("fingerprint", "run_id").alias("first"), F.min("run_id").alias("first_run"))
    later = prints.join(first, "system_id").where("run_id <> first_run")
    share = later.groupBy("system_id").agg(F.round(F.avg((F.col("fingerprint") == F.col("first")).cast("int")), 6).alias("idempotency"))
    return first.select("system_id").join(share, "system_id", "left").na.fill(1.0, ["idempotency"])
