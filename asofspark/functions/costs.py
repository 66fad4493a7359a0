"""Transaction costs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statutory and brokerage rates as shares of the traded value.
BROKERAGE, BROKERAGE_CAP, SEBI, GST, SLIPPAGE = 0.0003, 20.0, 0.000001, 0.18, 0.0005
DELIVERY = {"stt": 0.001, "exchange": 0.0000297, "stamp": 0.00015}
FUTURES = {"stt": 0.0002, "exchange": 0.0000173, "stamp": 0.00002}


def _leg(value: Column, stt: Column, exchange: float, stamp: Column) -> Column:
    brokerage = F.least(F.lit(BROKERAGE_CAP), value * BROKERAGE)
    return brokerage + stt + value * exchange + value * SEBI + stamp + (brokerage + value * exchange + value * SEBI) * GST + value * SLIPPAGE


def delivery_leg(value: Column, side: str) -> Column:
    """Cost of one delivery leg: securities tax on both sides, stamp duty on purchases only."""
    return _leg(value, value * DELIVERY["stt"], DELIVERY["exchange"], value * DELIVERY["stamp"] if side == "buy" else F.lit(0.0))


def futures_leg(value: Column, side: str) -> Column:
    """Cost of one futures leg: securities tax on sales only, stamp duty on purchases only."""
    stt = F.lit(0.0) if side == "buy" else value * FUTURES["stt"]
    return _leg(value, stt, FUTURES["exchange"], value * FUTURES["stamp"] if side == "buy" else F.lit(0.0))
