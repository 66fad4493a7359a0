"""Rule sets over one row: arrays of reason codes, in a fixed order, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def codes(rules: list[tuple[Column, str | Column]]) -> Column:
    """The codes of the rules that hold (null does not), in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(rule, code) for rule, code in rules])))


# Names of the states of a daily row, as audits report them.
FATAL = ["NEGATIVE_TOTAL_TRADED_QUANTITY", "HIGH_BELOW_LOW"]
BLOCKING = ["OPEN_OUTSIDE_DAILY_RANGE_UNRESOLVED_BASIS", "CLOSE_OUTSIDE_DAILY_RANGE_UNRESOLVED_BASIS"]
INFORMATIONAL = ["ZERO_VOLUME_PRICE_STATE", "SETTLEMENT_OUTSIDE_DAILY_RANGE_SEPARATE_BASIS"]


def ohlc_states(open_: Column, high: Column, low: Column, close: Column, settlement: Column, volume: Column) -> Column:
    """What is wrong or to be noted in a row. A fatal fault stands alone; so does a day without volume, whose prices are
    not trades; otherwise open and close outside the range block, a settlement outside it is a note."""
    outside = lambda x: ~x.between(low, high)
    fatal = codes([(volume < 0, FATAL[0]), (high < low, FATAL[1])])
    within = codes([(outside(open_), BLOCKING[0]), (outside(close), BLOCKING[1]), (outside(settlement), INFORMATIONAL[1])])
    return F.when(F.size(fatal) > 0, F.slice(fatal, 1, 1)).when(volume == 0, F.array(F.lit(INFORMATIONAL[0]))).otherwise(within)


def ohlc_severity(states: Column) -> Column:
    some = lambda names: F.arrays_overlap(states, F.array(*[F.lit(n) for n in names]))
    return F.when(some(FATAL), "FATAL").when(some(BLOCKING), "BLOCKING").when(F.size(states) > 0, "INFORMATIONAL").otherwise("CLEAN")


def limiting_factors(sample: Column, width: Column, folds: Column, coverage: Column, fresh: Column, costs: Column, parameters: Column, multiplicity: Column, decay: Column) -> Column:
    """The nine factors that limit confidence. sample is a number, width that of an interval; the others tell whether
    all is well. A factor that is not known limits."""
    no = lambda x: ~F.coalesce(x, F.lit(False))
    return codes([
        (no(sample >= 30), "SMALL_EFFECTIVE_SAMPLE"), (no(width <= 1.0), "WIDE_UNCERTAINTY_INTERVAL"), (no(folds), "FOLD_INSTABILITY"), (no(coverage), "NARROW_COVERAGE"),
        (no(fresh), "STALE_OR_INCOMPLETE_DATA"), (no(costs), "COST_SENSITIVITY"), (no(parameters), "PARAMETER_SENSITIVITY"), (no(multiplicity), "MULTIPLE_TESTING_BURDEN"), (no(decay), "RECENT_DECAY"),
    ])


def confidence_band(factors: Column) -> Column:
    return F.when(F.size(factors) == 0, "HIGH").when(F.size(factors) <= 2, "MODERATE").otherwise("LOW")


def quote_reasons(as_of: Column, max_age_s: dict[str, int]) -> Column:
    """Why a quote is not shown, of the columns twin (another record has its key or token), exchange, instrument_class,
    currency, source_state, price, missing_reason, cache_state, quote_at, retrieved_at, inventory_at and trade_at."""
    c = F.col
    reasons = [
        (c("twin"), "AMBIGUOUS_IDENTITY"), ((c("exchange") != "SIMULATED") | (c("instrument_class") != "EQ"), "INELIGIBLE_IDENTITY"), (c("currency") != "INR", "INCOMPATIBLE_CURRENCY"),
        (c("source_state") != "AVAILABLE", c("source_state")), (c("price").isNull(), "MISSING_PRICE"), (c("price").isNull(), F.coalesce("missing_reason", F.lit("MISSING_REASON_UNSPECIFIED"))),
        (c("price") <= 0, "INVALID_PRICE"), ((c("price") > 0) & c("missing_reason").isNotNull(), "INCONSISTENT_MISSINGNESS"), (c("cache_state").isin("STALE_CACHE", "UNKNOWN"), c("cache_state")),
    ]
    for name, at in (("QUOTE", "quote_at"), ("RETRIEVAL", "retrieved_at"), ("INVENTORY", "inventory_at")):
        old = F.unix_micros(as_of) - F.unix_micros(at) > max_age_s[name] * 1_000_000
        reasons += [(c(at).isNull(), f"{name}_TIME_UNKNOWN"), (c(at) > as_of, f"{name}_TIME_FUTURE"), (old, f"{name}_STALE")]
    reasons += [
        (c("trade_at").isNull(), "TRADE_TIME_UNKNOWN"), (c("trade_at") > as_of, "TRADE_TIME_FUTURE"), (c("trade_at") > c("quote_at"), "TRADE_AFTER_QUOTE"),
        (c("quote_at") > c("retrieved_at"), "QUOTE_AFTER_RETRIEVAL"), (c("inventory_at") > c("retrieved_at"), "INVENTORY_AFTER_RETRIEVAL"),
    ]
    return codes(reasons)


def limit_state(observed: Column, most: Column, least: bool = False) -> Column:
    """UNKNOWN, BLOCK beyond the limit, BINDING within a fifth of it, else PASS; if least, the limit is a lower bound."""
    beyond, near = (observed < most, observed < most * 1.25) if least else (observed > most, observed > most * 0.8)
    return F.when(observed.isNull(), "UNKNOWN").when(beyond, "BLOCK").when(near, "BINDING").otherwise("PASS")
