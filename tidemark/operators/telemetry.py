"""Analytics over the append-only request log: summaries, quotas, limits, health."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Daily limits of providers; a null limit is none. (provider, model, requests a day, tokens a day)
QUOTAS = [
    ("p0", None, 40, 500_000),
    ("p0", "m1", 30, 100_000),
    ("p1", None, None, None),
    ("p2", None, None, 10_000_000),
    ("p3", None, 40, None),
    ("p4", None, 50, None),
]
#: Models to fall back on. (provider, model, tier, vision, context window)
FALLBACKS = [("p0", "m0", 1, True, 128_000), ("p1", "m1", 1, False, 32_000), ("p2", "m2", 2, True, 8_000), ("p3", "m0", 2, True, 200_000), ("p4", "m1", 3, False, 16_000), ("p5", "m2", 3, True, 64_000)]


def quotas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUOTAS, "provider string, model string, rpd long, tpd long")


def fallbacks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FALLBACKS, "provider string, model string, tier int, vision boolean, context_window long")


def summary(log: DataFrame, *by: str) -> DataFrame:
    """Requests, success rate, mean latency of successes, tokens; one row without groups, also for an empty log."""
    good = F.count_if("success")
    mean = F.sum(F.when(F.col("success"), F.col("latency_ms").cast("decimal(18,2)"))).cast("double") / F.greatest(good, F.lit(1))
    return log.groupBy(*by).agg(F.count("*").alias("total_requests"), F.round(good / F.greatest(F.count("*"), F.lit(1)), 3).alias("success_rate"), F.coalesce(F.round(mean, 1), F.lit(0.0)).alias("mean_latency_ms"), F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0)).alias("total_tokens"))


def p95_by(log: DataFrame, by: str) -> DataFrame:
    """sorted[floor(0.95 n)] of the successes' latencies in each group, counted from 0.

    Ranks come from a window within the group, ordered by Spark with spill; no list is gathered.
    """
    w = Window.partitionBy(by)
    ranked = log.where("success").select(by, "latency_ms", F.row_number().over(w.orderBy("latency_ms")).alias("at"), F.count("*").over(w).alias("n"))
    return ranked.where(F.col("at") == F.floor(F.col("n") * 0.95) + 1).select(by, F.col("latency_ms").alias("p95_ms"))


def p95(log: DataFrame) -> DataFrame:
    """The same over the whole log, in two levels: how many successes each latency has, then ranges of latencies by prefix sums."""
    counts = log.where("success").groupBy("latency_ms").agg(F.count("*").alias("k")).withColumn("range", F.floor(F.col("latency_ms") / 256))
    sums = counts.groupBy("range").agg(F.sum("k").alias("in_range"))
    w = Window.orderBy("range")  # a row for every 256 ms
    sums = sums.select("range", (F.sum("in_range").over(w) - F.col("in_range")).alias("before"), F.sum("in_range").over(Window.partitionBy()).alias("n"))
    upto = F.col("before") + F.sum("k").over(Window.partitionBy("range").orderBy("latency_ms"))
    return counts.join(F.broadcast(sums), "range").withColumn("upto", upto).where(F.col("upto") > F.floor(F.col("n") * 0.95)).agg(F.coalesce(F.min("latency_ms"), F.lit(0.0)).alias("p95_ms"))


def usage(log: DataFrame, zone: str = "America/Los_Angeles") -> DataFrame:
    """Requests and tokens of each provider on each quota day of its zone."""
    day = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("ts")))
    return log.groupBy("provider", day.alias("quota_day")).agg(F.count("*").alias("requests"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))


def policy_of(log: DataFrame, policies: DataFrame) -> DataFrame:
    """Each request with its limits: the exact model's, else the provider's default, else none."""
    exact = policies.where("model is not null").select("provider", "model", F.col("rpd").alias("rpd_m"), F.col("tpd").alias("tpd_m"), F.lit(True).alias("exact"))
    default = policies.where("model is null").select("provider", F.col("rpd").alias("rpd_p"), F.col("tpd").alias("tpd_p"))
    both = log.join(F.broadcast(exact), ["provider", "model"], "left").join(F.broadcast(default), "provider", "left")  # the policy list is a constant
    return both.withColumn("rpd", F.when(F.col("exact"), F.col("rpd_m")).otherwise(F.col("rpd_p"))).withColumn("tpd", F.when(F.col("exact"), F.col("tpd_m")).otherwise(F.col("tpd_p"))).drop("exact", "rpd_m", "tpd_m", "rpd_p", "tpd_p")


def running_quota(log: DataFrame, policies: DataFrame) -> DataFrame:
    """Whether each request was within its limits, by what its provider had used that day before it."""
    w = Window.partitionBy("provider", F.to_date("ts")).orderBy("ts", "request_id").rowsBetween(Window.unboundedPreceding, -1)
    used = policy_of(log, policies).withColumn("before", F.count("*").over(w)).withColumn("tokens_before", F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")).over(w), F.lit(0)))
    ok = F.coalesce(F.col("before") < F.col("rpd"), F.lit(True)) & F.coalesce(F.col("tokens_before") < F.col("tpd"), F.lit(True))
    return used.select("request_id", "provider", "before", "tokens_before", ok.alias("allowed"))


def seconds_to_reset(log: DataFrame, zone: str = "America/Los_Angeles") -> DataFrame:
    """Whole seconds from each request to the next midnight in the zone."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("ts"))
    midnight = F.date_trunc("day", local) + F.expr("interval 1 day")
    return log.select("request_id", F.timestamp_diff("SECOND", local, midnight).alias("seconds_to_reset"))


def attempts_limit(actions: DataFrame, limit: int, window_s: int) -> DataFrame:
    """Rejects an attempt when more than limit attempts, rejected ones included, lie in the window that ends with it."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id", "action").orderBy("at").rangeBetween(-(window_s * 1_000_000 - 1), 0)
    return actions.withColumn("at", micros).withColumn("in_window", F.count("*").over(w)).select("user_id", "action", "ts", "in_window", (F.col("in_window") > limit).alias("rejected"))


def accepted_limit(actions: DataFrame, limit: int, window_s: int) -> DataFrame:
    """As attempts_limit, but only accepted attempts count: each decision depends on those before, so it is a fold by user and action."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", kind="stable")
        accepted: list[int] = []
        out = []
        for t in pdf["at"]:
            accepted = [a for a in accepted if a > t - window_s * 1_000_000]
            ok = len(accepted) < limit
            if ok:
                accepted.append(t)
            out.append(not ok)
        return pdf.assign(rejected=out)

    rows = actions.select("user_id", "action", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return rows.groupBy("user_id", "action").applyInPandas(fold, "user_id long, action string, ts timestamp_ntz, at long, rejected boolean").drop("at")


def last_calls(log: DataFrame, n: int = 100) -> DataFrame:
    """The last n calls of each provider and model."""
    w = Window.partitionBy("provider", "model").orderBy(F.desc("ts"), F.desc("request_id"))
    return log.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def provider_stats(log: DataFrame, n: int = 100) -> DataFrame:
    """Success rate, mean latency and samples over the last n calls, and the score that orders providers."""
    calls = last_calls(log, n).groupBy("provider", "model").agg((F.count_if("success") / F.count("*")).alias("rate"), (F.sum(F.col("latency_ms").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("latency"), F.count("*").alias("samples"))
    return calls.select("provider", "model", F.round("rate", 4).alias("success_rate"), F.round("latency", 2).alias("mean_latency_ms"), "samples", score(F.col("rate"), F.col("latency") / 1000).alias("score"))


def stats_of(asked: DataFrame, stats: DataFrame) -> DataFrame:
    """Statistics of each asked (provider, model); without calls the success rate is 1 and the rest 0."""
    return asked.join(stats.drop("score"), ["provider", "model"], "left").na.fill({"success_rate": 1.0, "mean_latency_ms": 0.0, "samples": 0})


def score(rate: Column, latency_s: Column) -> Column:
    """70 % success, 30 % speed; 50 when nothing is known."""
    return F.coalesce(F.round(0.7 * rate * 100 + 0.3 * F.greatest(F.lit(0.0), 100 - 10 * latency_s), 2), F.lit(50.0))


def fallback_order(models: DataFrame, stats: DataFrame) -> DataFrame:
    """Models by tier, then by score, best first; untested ones score 50."""
    both = models.join(stats.select("provider", "model", "score"), ["provider", "model"], "left").withColumn("score", F.coalesce("score", F.lit(50.0)))
    return both.withColumn("rank", F.row_number().over(Window.orderBy("tier", F.desc("score"), "provider", "model")))  # a short list of models


def candidates(models: DataFrame, health: DataFrame, usage_today: DataFrame, policies: DataFrame, vision: bool, context: int) -> DataFrame:
    """Models that have what a task needs, whose provider is not open and has quota left."""
    default = policies.where("model is null").select("provider", "rpd")
    fit = models.where((F.lit(not vision) | F.col("vision")) & (F.col("context_window") >= context))
    fit = fit.join(health.select("provider", "is_open"), "provider", "left").join(usage_today.select("provider", "requests"), "provider", "left").join(F.broadcast(default), "provider", "left")
    left = F.coalesce(F.coalesce("requests", F.lit(0)) < F.col("rpd"), F.lit(True))
    return fit.where(~F.coalesce("is_open", F.lit(False)) & left).select("provider", "model", "tier")


def preferred_first(chain: DataFrame, provider: str) -> DataFrame:
    """The preferred provider's models before the rest of the chain."""
    first = chain.where(F.col("provider") == provider).withColumn("part", F.lit(0))
    rest = chain.join(chain.where(F.col("provider") == provider).select("provider", "model"), ["provider", "model"], "left_anti").withColumn("part", F.lit(1))
    return first.unionByName(rest).withColumn("position", F.row_number().over(Window.orderBy("part", "tier", "provider", "model"))).drop("part")


def health(log: DataFrame, *by: str, threshold: int = 3) -> DataFrame:
    """Failures since the last success, last success and failure, and whether the breaker is open."""
    keys = list(by) or ["provider"]
    newest = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("request_id"))
    since = log.withColumn("good_after", F.sum(F.col("success").cast("int")).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    return since.groupBy(*keys).agg(
        F.count("*").alias("requests"), F.count_if("success").alias("successes"), F.count_if((F.col("good_after") == 0) & ~F.col("success")).alias("consecutive_failures"),
        F.max(F.when(F.col("success"), F.col("ts"))).alias("last_success"), F.max(F.when(~F.col("success"), F.col("ts"))).alias("last_failure"),
    ).withColumn("is_open", F.col("consecutive_failures") >= threshold)


#: Seconds that a provider rests after its breaker opens, and after it was told that it asks too often.
COOLDOWN_S, RATE_LIMIT_COOLDOWN_S = 120, 60


def cooldowns(log: DataFrame, threshold: int = 3) -> DataFrame:
    """(provider, failures, is_open, cooldown_until) by a log with ts, success and rate_limited.

    A success closes the breaker; a rate limit rests the provider without counting as a failure; other failures
    count since the last success, and from the third on each rests it. The latest rest since that success holds.
    """
    newest = Window.partitionBy("provider").orderBy(F.desc("ts"), F.desc("request_id")).rowsBetween(Window.unboundedPreceding, 0)
    since = log.withColumn("good_after", F.sum(F.col("success").cast("int")).over(newest)).where("good_after = 0")
    counted = ~F.col("success") & ~F.col("rate_limited")
    nth = F.count_if(counted).over(Window.partitionBy("provider").orderBy("ts", "request_id").rowsBetween(Window.unboundedPreceding, 0))
    rests = F.when(F.col("rate_limited"), RATE_LIMIT_COOLDOWN_S).when(nth >= threshold, COOLDOWN_S)
    rows = since.withColumn("until", F.unix_micros(F.col("ts").cast("timestamp")) + rests * 1_000_000)
    last = F.max_by("until", F.when(F.col("until").isNotNull(), F.struct("ts", "request_id")))
    found = rows.groupBy("provider").agg(F.count_if(counted).alias("failures"), last.alias("until"))
    out = log.select("provider").distinct().join(found, "provider", "left")
    return out.select("provider", F.coalesce("failures", F.lit(0)).alias("failures"), (F.coalesce("failures", F.lit(0)) >= threshold).alias("is_open"), F.col("until").alias("cooldown_until_us"))


#: Parameters: how much each part of a candidate's score counts for a task; the last two are taken off. (task, quality, health, speed, quota, reliability, failures, cooldown)
WEIGHTS = [("final_notes", 3.0, 1.5, 0.5, 1.0, 1.5, 1.0, 2.0), ("preprocessing", 0.5, 1.5, 3.0, 1.0, 1.0, 1.0, 2.0), ("default", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
PARTS = ("quality", "health", "speed", "quota", "reliability", "failures", "cooldown")


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WEIGHTS, "task string, " + ", ".join(f"{p} double" for p in PARTS))


def candidate_parts(models: DataFrame, stats: DataFrame, cooled: DataFrame, used: DataFrame, policies: DataFrame, now_us: Column, threshold: int = 3) -> DataFrame:
    """What is known of each model, every part between 0 and 1.

    models: provider, model, tier and quality; stats: of provider_stats; cooled: of cooldowns; used: requests and tokens of a provider on the quota day.
    quality is given. health: 0 while an opened breaker rests, half once it may be tried, else 1. speed: 1 at once, 0 from 10 s on. quota: what
    is left of the tighter daily limit, 1 without one. reliability: share of successes. failures: those since the last success, over threshold.
    cooldown: 1 while the provider rests, for whatever reason. A model that nothing is known of has a speed and a reliability of half.
    """
    known = models.join(stats.select("provider", "model", "success_rate", "mean_latency_ms"), ["provider", "model"], "left").join(cooled.select("provider", F.col("failures").alias("failed"), "cooldown_until_us"), "provider", "left")
    known = policy_of(known.join(used.select("provider", F.col("requests").alias("used"), F.col("tokens").alias("used_tokens")), "provider", "left"), policies)
    left = lambda amount, limit: F.when(F.col(limit).isNull(), 1.0).when(F.col(limit) <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.coalesce(amount, F.lit(0)) / F.col(limit)))
    failed, resting = F.coalesce("failed", F.lit(0)), F.coalesce(F.col("cooldown_until_us") > now_us, F.lit(False))
    return known.select(
        "provider", "model", "tier", F.coalesce("quality", F.lit(0.0)).alias("quality"), F.when(failed < threshold, 1.0).when(resting, 0.0).otherwise(0.5).alias("health"),
        F.greatest(F.lit(0.0), F.coalesce(1 - F.col("mean_latency_ms") / 10_000, F.lit(0.5))).alias("speed"), F.least(left("used", "rpd"), left("used_tokens", "tpd")).alias("quota"), F.coalesce("success_rate", F.lit(0.5)).alias("reliability"),
        F.least(F.lit(1.0), failed / threshold).alias("failures"), F.when(resting, 1.0).otherwise(0.0).alias("cooldown"),
    )


def candidate_scores(parts: DataFrame, weights: DataFrame) -> DataFrame:
    """(task, provider, model, tier, score, rank): the weighed parts of each candidate for each task, best first; a weight that isn't given is 0. Both tables are short lists of models and tasks."""
    named = weights.select("task", *(F.coalesce(p, F.lit(0.0)).alias(f"w_{p}") for p in PARTS))
    weighed = [F.col(f"w_{p}") * F.col(p) for p in PARTS]
    total = weighed[0] + weighed[1] + weighed[2] + weighed[3] + weighed[4] - weighed[5] - weighed[6]
    both = parts.join(F.broadcast(named), F.lit(True)).withColumn("score", F.round(total, 4))  # parameters: a row for each kind of task
    order = Window.partitionBy("task").orderBy(F.desc("score"), "tier", "provider", "model")
    return both.select("task", "provider", "model", "tier", "score", F.row_number().over(order).alias("rank"))


def provider_of(model: Column) -> Column:
    """The provider that a model's name stands for."""
    return F.when(model.startswith("m0"), "alpha").when(model.startswith("m1"), "beta").otherwise("other")


def stage_metrics(log: DataFrame) -> DataFrame:
    """Requests, failures, retry share (another call for the same video and task) and mean latency of each stage."""
    calls = log.groupBy("task", "video_id").agg(F.count("*").alias("n"), F.count_if(~F.col("success")).alias("failed"), F.sum(F.col("latency_ms").cast("decimal(18,2)")).alias("ms"))
    return calls.groupBy("task").agg(F.sum("n").alias("requests"), F.sum("failed").alias("failures"), F.round((F.sum("n") - F.count("*")) / F.sum("n"), 4).alias("retry_rate"), F.round(F.sum("ms").cast("double") / F.sum("n"), 2).alias("mean_latency_ms"))
