"""Price lists, costs, repricing and bills."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dims import TimeWindow, provider

RATES = ("input_cost_per_token", "output_cost_per_token", "cache_creation_input_token_cost", "cache_read_input_token_cost")
#: A price above this is refused, in USD per million tokens.
MOST_PER_MILLION = 1000.0
#: Share of known models that a new list keeps, in per cent.
LEAST_KEPT = 95
#: Bounded lists (a model's price, its rates) are broadcast up to this number of rows and joined by a shuffle beyond it.
SMALL_ROWS = 200_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def cost_cents(
    model_price: dict[str, Column],
    cache_creation_1h: Column | None = None,
    fast: Column | None = None,
    web_searches: Column | None = None,
) -> Column:
    """Cents of a call from per-million prices: 1-hour cache writes at twice the input price, fast mode six times, 1 cent a web search."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    long_writes = F.lit(0) if cache_creation_1h is None else F.least(F.coalesce(cache_creation_1h, F.lit(0)), n("cache_creation_tokens"))
    usd = (
        n("input_tokens") * model_price["input"]
        + n("output_tokens") * model_price["output"]
        + (n("cache_creation_tokens") - long_writes) * model_price["write"]
        + n("cache_read_tokens") * model_price["read"]
    )
    if cache_creation_1h is not None:
        usd = usd + long_writes * model_price["input"] * 2
    usd = usd / 1e6
    if fast is not None:
        usd = F.when(F.coalesce(fast, F.lit(False)), usd * 6).otherwise(usd)
    if web_searches is not None:
        usd = usd + F.coalesce(web_searches, F.lit(0)) * 0.01
    return F.round(usd * 100, 8)


def per_million() -> dict[str, Column]:
    names = dict(zip(("input", "output", "write", "read"), RATES))
    return {k: F.coalesce(F.col(c), F.lit(0.0)) * 1e6 for k, c in names.items()}


def with_prices(rows: DataFrame, price_list: DataFrame, aliases: DataFrame, model: str = "model") -> DataFrame:
    """``rows`` with the four rates of their model, ``priced_model`` and ``by_alias``; null for unknown models.

    A model that the list has itself is met by its own name, others by the alias that leads to one."""
    own = price_list.select(F.col("model").alias("__model"), F.col("model").alias("priced_model"), F.lit(False).alias("by_alias"), *RATES)
    led = aliases.select(F.col("alias").alias("__model"), F.col("canonical").alias("priced_model")).join(price_list.select("model"), F.col("__model") == F.col("model"), "left_anti")
    met = led.join(price_list, F.col("priced_model") == F.col("model")).select("__model", "priced_model", F.lit(True).alias("by_alias"), *RATES)
    names = small(own.unionByName(met))
    return rows.join(names, F.col(model) == F.col("__model"), "left").drop("__model")


def _given(messages: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in messages.columns else F.lit(None).cast(kind)


def priced(messages: DataFrame, price_list: DataFrame, aliases: DataFrame, version: int = 1) -> DataFrame:
    """Messages with cost_cents_ingested, cost_cents_effective, pricing_source and cost_confidence.

    A cost that is there already (``cost_cents_ingested``, from a source that tells the exact one) stays, with its confidence and source.
    Assistant rows without one are priced by the list: fast mode (``speed``), 1-hour cache writes (``cache_creation_1h_tokens``) and web
    searches (``web_search_requests``) count where the columns are there. An unknown model costs nothing, searches included. Other rows cost
    nothing; without tokens their source says so, else it is null."""
    rows = with_prices(messages, price_list, aliases)
    given = _given(messages, "cost_cents_ingested", "double")
    assistant = F.coalesce(F.col("role"), F.lit("assistant")) == "assistant"
    tokens = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")), F.lit(0))
    known = F.col("priced_model").isNotNull()
    extra = {"cache_creation_1h": _given(messages, "cache_creation_1h_tokens", "bigint"), "fast": _given(messages, "speed", "string") == "fast", "web_searches": _given(messages, "web_search_requests", "bigint")}
    by_list = F.when(assistant & known, cost_cents(per_million(), **extra)).otherwise(0.0)
    label = F.when(F.col("by_alias"), f"manifest:v{version}:alias").otherwise(f"manifest:v{version}")
    told, sure = _given(messages, "pricing_source", "string"), F.nullif(_given(messages, "cost_confidence", "string"), F.lit(""))
    made = {
        "cost_cents_ingested": F.coalesce(given, by_list),
        "cost_cents_effective": F.coalesce(given, by_list),
        "pricing_source": F.when(given.isNotNull(), F.coalesce(told, F.lit("upstream:api"))).when(assistant & known, label).when(assistant, "unknown").otherwise(F.coalesce(told, F.when(tokens == 0, "unpriced:no_tokens"))),
        "cost_confidence": F.when(~assistant, sure).when(given.isNotNull(), F.coalesce(sure, F.lit("estimated"))).when(known, "estimated").otherwise("estimated_unknown_model"),
    }
    return rows.withColumns(made).drop("priced_model", "by_alias", *RATES)


def checked_prices(price_list: DataFrame, previous: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(kept rows, refused rows with a reason, whether the list may be installed)."""
    bad = F.lit(None).cast("string")
    for c in RATES:
        v = F.col(c) * 1e6
        bad = F.coalesce(bad, F.when(F.isnan(c), f"{c} is no number").when(v < 0, f"{c} is negative").when(v > MOST_PER_MILLION, f"{c} is too high"))
    marked = price_list.withColumn("reason", bad)
    kept = marked.where("reason IS NULL").drop("reason")
    before = previous.select("model").distinct()
    n = before.count()
    still = before.join(kept.select("model"), "model", "left_semi").count()
    return kept, marked.where("reason IS NOT NULL").orderBy("model"), still >= -(-n * LEAST_KEPT // 100)


def backfilled(messages: DataFrame, price_list: DataFrame, aliases: DataFrame, version: int) -> DataFrame:
    """Rows of unknown price get one as soon as the list has their model: that of their tokens, whatever their speed and searches."""
    rows = with_prices(messages, price_list, aliases)
    now = (F.col("pricing_source") == "unknown") & F.col("priced_model").isNotNull()
    cents = cost_cents(per_million())
    return rows.withColumns(
        {
            "cost_cents_ingested": F.when(now, cents).otherwise(F.col("cost_cents_ingested")),
            "cost_cents_effective": F.when(now, cents).otherwise(F.col("cost_cents_effective")),
            "pricing_source": F.when(now, f"backfilled:v{version}").otherwise(F.col("pricing_source")),
        }
        | ({"cost_confidence": F.when(now, "estimated").otherwise(F.col("cost_confidence"))} if "cost_confidence" in messages.columns else {})
    ).drop("priced_model", "by_alias", *RATES)


TOKEN_TYPES = {"input": "input_tokens", "output": "output_tokens", "cache_write": "cache_creation_tokens", "cache_read": "cache_read_tokens"}


def team_rates(models: DataFrame, rates: DataFrame, region: str) -> DataFrame:
    """model and a rate per token type: patterns match exactly or by a trailing *, later rows win."""
    p, text = F.col("model_pattern"), lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("text"))
    pattern = F.when(p.endswith("*"), text("prefix", F.left(p, F.length(p) - 1))).otherwise(text("whole", p))
    r = rates.where((F.col("region") == region) | F.col("region").isNull()).withColumn("fits", pattern)
    # a model meets its patterns by its own text and by all its prefixes: equal keys, no matching of pairs
    prefixes = F.transform(F.sequence(F.lit(0), F.length("model")), lambda n: text("prefix", F.left("model", n)))
    each = models.select("model").distinct().withColumn("fits", F.explode(F.concat(F.array(text("whole", F.col("model"))), prefixes)))
    best = lambda t: F.max_by(F.when(F.col("token_type") == t, F.col("sale_usd_per_mtok")), F.when(F.col("token_type") == t, F.col("row_no")))
    return each.join(r, "fits").groupBy("model").agg(*[best(t).alias(f"rate_{t}") for t in TOKEN_TYPES])


def repriced(messages: DataFrame, rates: DataFrame | None, region: str = "global") -> DataFrame:
    """cost_cents_effective by negotiated rates; a missing rate for tokens that are there, or no list, falls back to the ingested cost."""
    if rates is None:
        return messages.withColumn("cost_cents_effective", F.col("cost_cents_ingested"))
    by_model = team_rates(messages.where("model IS NOT NULL"), rates, region)  # a row per model: adaptive execution broadcasts it
    rows = messages.join(by_model, "model", "left")
    lacks, usd = F.lit(False), F.lit(0.0)
    for t, c in TOKEN_TYPES.items():
        lacks = lacks | ((F.col(c) > 0) & F.col(f"rate_{t}").isNull())
        usd = usd + F.col(c) * F.coalesce(F.col(f"rate_{t}"), F.lit(0.0)) / 1e6
    own = F.when((F.col("role") != "assistant") | lacks, F.col("cost_cents_ingested")).otherwise(F.round(usd * 100, 8))
    return rows.withColumn("cost_cents_effective", own).drop(*[f"rate_{t}" for t in TOKEN_TYPES]).select(*messages.columns)


def reprice_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """processed, changed, cents before and after of a repricing."""
    both = before.select("id", F.col("cost_cents_effective").alias("b")).join(after.select("id", F.col("cost_cents_effective").alias("a")), "id")
    m = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(20,8)")), F.lit(0).cast("decimal(20,8)")).cast("double")
    return both.agg(
        F.count("*").alias("processed"), F.count_if(F.abs(F.col("a") - F.col("b")) > 1e-9).alias("changed"), m("b").alias("before_cents"), m("a").alias("after_cents")
    )


def savings(messages: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """One row: the cents that negotiated rates have saved in the last ``days``."""
    cents = F.sum(F.coalesce("cost_cents_ingested", F.lit(0.0)).cast("decimal(20,8)") - F.coalesce("cost_cents_effective", F.lit(0.0)).cast("decimal(20,8)"))
    return messages.where(TimeWindow(since=now - timedelta(days=days)).where()).agg(F.coalesce(cents, F.lit(0)).cast("double").alias("savings_cents"))


def reconciled(messages: DataFrame, bill: DataFrame) -> DataFrame:
    """Costs scaled, by (date, model), to what was billed; a bucket without a cost is spread evenly over its rows (effective only)."""
    b = bill.where("amount_in_cents > 0").select(F.col("date").alias("__d"), F.col("model").alias("__m"), "amount_in_cents")
    day = F.col("timestamp").cast("date")
    rows = messages.withColumn("__day", day).join(b, (F.col("__day") == F.col("__d")) & (F.col("model") == F.col("__m")), "left")
    sums = rows.where("amount_in_cents IS NOT NULL").groupBy("__day", "model").agg(
        F.sum(F.col("cost_cents_effective").cast("decimal(20,8)")).cast("double").alias("__sum"), F.count("*").alias("__n")
    )
    rows = rows.join(sums, ["__day", "model"], "left")
    billed = F.col("amount_in_cents").isNotNull()
    ratio, even = F.col("amount_in_cents") / F.nullif(F.col("__sum"), F.lit(0.0)), F.col("amount_in_cents") / F.col("__n")
    scaled = billed & (F.col("__sum") > 0)
    return rows.withColumns(
        {
            "cost_cents_ingested": F.when(scaled, F.round(F.col("cost_cents_ingested") * ratio, 8)).otherwise(F.col("cost_cents_ingested")),
            "cost_cents_effective": F.when(scaled, F.round(F.col("cost_cents_effective") * ratio, 8)).when(billed, F.round(even, 8)).otherwise(F.col("cost_cents_effective")),
            "cost_confidence": F.when(scaled, "exact").when(billed, "estimated").otherwise(F.col("cost_confidence")),
        }
    ).select(*messages.columns)


def org_managed(bill_runs: DataFrame) -> DataFrame:
    """Cycles in which two runs in a row returned no rows: cycle_end, org_managed."""
    w = W.partitionBy("cycle_end").orderBy("run_at")
    empty = F.col("n_rows") == 0
    return bill_runs.withColumn("__two", empty & F.coalesce(F.lag("n_rows").over(w) == 0, F.lit(False))).groupBy("cycle_end").agg(F.bool_or("__two").alias("org_managed"))


def pricing_label(c: Column) -> Column:
    """struct(kind, version) of a pricing_source."""
    version = F.regexp_extract(c, "^(?:(?:manifest|backfilled|embedded):v([0-9]+)|manifest:v([0-9]+):alias)$", 1)
    by_alias = F.regexp_extract(c, "^manifest:v([0-9]+):alias$", 1)
    kind = F.when(version != "", F.split_part(c, F.lit(":"), F.lit(1))).when(by_alias != "", "manifest_alias").when(c.startswith("unpriced"), "unpriced").otherwise(c)
    version = F.concat(version, by_alias)
    return F.struct(kind.alias("kind"), F.when(version != "", version).cast("int").alias("version"))


def unknown_models(messages: DataFrame) -> DataFrame:
    """Models without a price and how many messages they have."""
    return messages.where("pricing_source = 'unknown' AND model IS NOT NULL").groupBy("model").agg(F.count("*").alias("messages")).orderBy(F.desc("messages"), "model")


def unknown_by_provider(messages: DataFrame) -> DataFrame:
    """Models without a price by provider: when they were first seen and how many messages they have."""
    rows = messages.where("pricing_source = 'unknown' AND model IS NOT NULL").groupBy(provider().alias("provider"), "model")
    return rows.agg(F.min("timestamp").alias("first_seen_at"), F.count("*").alias("messages")).orderBy(F.desc("messages"), "model", "provider")


def price_status(messages: DataFrame, price_list: DataFrame, aliases: DataFrame, previous: DataFrame, version: int) -> DataFrame:
    """One row on the list in use: its version, how many models and aliases it knows, rows refused, models and messages without a price.

    ``checked_prices``, ``aliases`` and ``unknown_by_provider`` have the rows behind the numbers."""
    kept, refused, _ = checked_prices(price_list, previous)
    told = unknown_by_provider(messages).agg(F.count_distinct("model").alias("unknown_models"), F.coalesce(F.sum("messages"), F.lit(0)).alias("unknown_messages"))
    one = told.withColumn("version", F.lit(version))
    for name, rows, column in (("known_models", kept, "model"), ("aliases", aliases, "alias"), ("refused_rows", refused, "model")):
        n = F.count("*") if name == "refused_rows" else F.count_distinct(column)
        one = one.join(F.broadcast(rows.agg(n.alias(name))), F.lit(True))  # one row each
    return one
