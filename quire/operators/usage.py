"""Usage counters, prices, cost, and admission under a spending cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: spellings of the counters in provider responses, first present wins
INPUT_KEYS = ("promptTokenCount", "prompt_token_count", "totalInputTokens", "total_input_tokens", "prompt_tokens", "input_tokens")
OUTPUT_KEYS = ("responseTokenCount", "response_token_count", "candidatesTokenCount", "candidates_token_count", "totalOutputTokens", "total_output_tokens", "completion_tokens", "output_tokens")
THOUGHT_KEYS = ("thoughtsTokenCount", "thoughts_token_count", "totalThoughtTokens", "total_thought_tokens", "completion_tokens_details.reasoning_tokens")
CACHED_KEYS = ("cachedContentTokenCount", "cached_content_token_count", "totalCachedTokens", "total_cached_tokens", "prompt_tokens_details.cached_tokens")
TOTAL_KEYS = ("totalTokenCount", "total_token_count", "totalTokens", "total_tokens")
COST_KEYS = ("cost", "estimated_cost", "estimated_cost_usd")
GENERIC_PROVIDER = "openai-compatible"  # fixed value
#: model, valid from, valid to (dates, null: open), tokens from which the row holds, dollars a million of input, cached input, output
PRICE_COLUMNS = "model string, valid_from date, valid_to date, min_input_tokens long, input decimal(10,4), cached decimal(10,4), output decimal(10,4)"


def _first(usage: Column | str, keys) -> Column:
    number = lambda k: F.floor(F.get_json_object(usage, f"$.{k}").cast("double")).cast("long")
    return F.coalesce(*[F.when(number(k) < 0, 0).otherwise(number(k)) for k in keys], F.lit(0)).cast("long")


def usage_from_responses(responses: DataFrame, json_col: str = "response") -> DataFrame:
    """Adds input, output, thought, cached, total tokens and exact_cost, read from whichever spelling is there."""
    u = F.coalesce(*[F.get_json_object(json_col, f"$.{k}") for k in ("usageMetadata", "usage_metadata", "usage")])
    rows = responses.withColumn("__u", u)
    one = F.get_json_object("__u", "$.completion_tokens").isNotNull() | F.get_json_object("__u", "$.output_tokens").isNotNull()
    rows = rows.select("*",
        *[_first("__u", k).alias(n) for n,
            k in (("input_tokens", INPUT_KEYS), ("output_tokens", OUTPUT_KEYS), ("thought_tokens", THOUGHT_KEYS), ("cached_tokens", CACHED_KEYS),
                ("__total", TOTAL_KEYS))], F.coalesce(*[F.get_json_object("__u", f"$.{k}").cast("double") for k in COST_KEYS]).alias("exact_cost"),
        one.alias("__one"))
    total = F.when(F.col("__total") > 0, F.col("__total")).otherwise(F.col("input_tokens") + F.col("output_tokens") + F.when(F.col("__one"), 0).otherwise(F.col("thought_tokens")))
    return rows.withColumn("total_tokens", total).drop("__u", "__total", "__one")


def combine_parts(parts: DataFrame) -> DataFrame:
    """Parts of a request summed; the cost is exact only if every part has one."""
    return parts.groupBy("request_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.when(F.bool_and(F.col("exact_cost").isNotNull()), F.sum("exact_cost")).alias("exact_cost"), F.count("*").alias("parts"))


def attach_prices(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Each request with the price row of its model, day and highest token tier it reaches.

    Where ``usage`` has them, ``custom_input`` and ``custom_output`` (dollars a million, both or neither) come before the table, and requests whose
    ``provider`` is the generic endpoint have no table price: a model's name says nothing about its bill there. Prices meet requests as one array a model."""
    by_model = prices.groupBy("model").agg(F.collect_list(F.struct("min_input_tokens", "valid_from", "valid_to", "input", "cached", "output")).alias("__prices"))
    day = F.to_date("ts")
    holds = F.filter("__prices", lambda p: (p["valid_from"].isNull() | (day >= p["valid_from"])) & (p["valid_to"].isNull() | (day < p["valid_to"])) & (F.col("input_tokens") >= p["min_input_tokens"]))
    listed = usage.join(by_model, "model", "left").withColumn("__p", F.array_max(holds))  # tiers come first in the struct
    shown = F.col("provider") != GENERIC_PROVIDER if "provider" in usage.columns else F.lit(True)
    price = {c: F.when(shown, F.col(f"__p.{c}")) for c in ("input", "cached", "output")}
    if "custom_input" in usage.columns:
        own = F.col("custom_input").isNotNull() & F.col("custom_output").isNotNull()
        price = {c: F.when(own, x).otherwise(price[c]) for c,
            x in (("input", F.col("custom_input").cast("decimal(10,4)")), ("cached", F.lit(None).cast("decimal(10,4)")),
                ("output", F.col("custom_output").cast("decimal(10,4)")))}
    return listed.select(*usage.columns, *[price[c].alias(f"{c}_price") for c in ("input", "cached", "output")])


def estimate_cost(priced: DataFrame) -> DataFrame:
    """Adds ``cost`` (dollars, eight places): the exact one if positive, else tokens by price (cached input at its own price). An exact zero stands where
    there is no price; without either the cost is null. Where ``thoughts_in_output`` is true, thoughts are part of the output already."""
    cached = F.least(F.greatest("cached_tokens", F.lit(0)), F.col("input_tokens"))
    thoughts = F.when(F.col("thoughts_in_output"), 0).otherwise(F.col("thought_tokens")) if "thoughts_in_output" in priced.columns else F.col("thought_tokens")
    sum_ = (F.col("input_tokens") - cached) * F.col("input_price") + cached * F.coalesce("cached_price", "input_price") + (F.col("output_tokens") + thoughts) * F.col("output_price")
    estimate = F.round(sum_.cast("decimal(28,4)") * F.lit("0.000001").cast("decimal(7,6)"), 8).cast("decimal(20,8)")
    exact = F.col("exact_cost").cast("decimal(20,8)")
    return priced.withColumn("cost", F.when(exact > 0, exact).otherwise(F.coalesce(estimate, exact)))


def _totals() -> list[Column]:
    return [F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("requests"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0)), 8).cast("decimal(20,8)").alias("cost")]


def usage_rollup(usage: DataFrame, *keys: str) -> DataFrame:
    """Totals and cost (of a column ``cost``, to eight places) by ``keys`` and every prefix of them, and requests that reported nothing."""
    return usage.rollup(*keys).agg(*_totals(), F.count_if(~F.col("reported")).alias("unreported"), F.sum("cached_tokens").alias("cached_tokens"))


def cost_admission(docs: DataFrame, cap: float, prior: float = 0.0, bucket: int = 1024) -> DataFrame:
    """In submission order a document starts while prior and earlier spending are below the cap; resumed ones are free.

    A prefix sum in two levels: totals of runs of ``bucket`` positions, summed over runs, then inside each run,
    so that no job is ordered in one task. Costs are never negative."""
    cost = F.when(F.col("skip_reason") == "resumed", F.lit(0)).otherwise(F.col("cost")).cast("decimal(20,8)")
    rows = docs.withColumn("__c", cost).withColumn("__b", F.floor(F.col("pos") / bucket))
    runs = rows.groupBy("run_id", "__b").agg(F.sum("__c").alias("t"))
    before = runs.select("run_id", "__b", F.coalesce(F.sum("t").over(W.partitionBy("run_id").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("__c").over(W.partitionBy("run_id", "__b").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spent = rows.withColumn("__i", inner).join(before, ["run_id", "__b"]).withColumn("spent_before", (F.col("base") + F.col("__i")).cast("decimal(20,8)"))
    free = F.coalesce(F.col("skip_reason") == "resumed", F.lit(False))
    admitted = free | (F.col("spent_before") + F.lit(prior).cast("decimal(20,8)") < F.lit(cap).cast("decimal(20,8)"))
    return spent.select("run_id", "pos", "doc_id", "spent_before", admitted.alias("admitted"), F.when(~admitted, "cost-limit").alias("reason"))


def usage_gaps(docs: DataFrame) -> DataFrame:
    """Under a cap, a paid request that reported no usage closes its run: all later documents are refused.

    The first gap is a minimum by run, joined back."""
    gap = docs.where("not reported and skip_reason is null").groupBy("run_id").agg(F.min("pos").alias("first_gap"), F.count("*").alias("gaps"))
    return docs.join(gap, "run_id", "left").select("run_id", "pos", "doc_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce(F.col("pos") > F.col("first_gap"), F.lit(False)).alias("closed"))


def cumulative_usage(prior: DataFrame, current: DataFrame, resume: bool = True) -> DataFrame:
    """Tokens, requests and cost of a job with those of the runs it resumes; an overwriting job starts at nothing."""
    both = prior.unionByName(current) if resume else current
    return both.groupBy("job_id").agg(*_totals())


def throttle_audit(requests: DataFrame, rpm: int, bucket_ms: int = 3_600_000) -> DataFrame:
    """For each request its gap to the one before, whether that is below 60000 / rpm ms, and its earliest allowed start (ms).

    In two levels: requests are numbered inside stretches of ``bucket_ms``, the stretches of a job are summed up in order, and both are put together,
    so no job is ordered in one task."""
    gap = 60_000 // rpm
    rows = requests.select("job_id", "request_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")).withColumn("b", F.floor(F.col("ms") / bucket_ms))
    inside = W.partitionBy("job_id", "b").orderBy("ts", "request_id")
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("i", F.row_number().over(inside) - 1).withColumn("lag", F.lag("ms").over(inside)).withColumn("peak", F.max(F.col("ms") - F.col("i") * gap).over(upto))
    # of each stretch: requests before it, the last of them, and the highest of ms - number * gap so far
    whole = rows.groupBy("job_id", "b").agg(F.count("*").alias("n"), F.max("ms").alias("last"), F.max("peak").alias("top"))
    before = W.partitionBy("job_id").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    whole = whole.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    whole = whole.select("job_id", "b", "base", F.max("last").over(before).alias("last"), F.max(F.col("top") - F.col("base") * gap).over(before).alias("top"))
    both = rows.join(whole, ["job_id", "b"])
    since = F.col("ms") - F.coalesce("lag", "last")
    earliest = F.greatest(F.col("peak") - F.col("base") * gap, F.col("top")) + (F.col("base") + F.col("i")) * gap
    return both.select("job_id", "request_id", since.alias("since_ms"), F.coalesce(since < gap, F.lit(False)).alias("too_soon"), earliest.alias("earliest_ms"))
