"""Messages as a stream: parse on arrival and drop repeated payments within a watermark.

An extension: batch and stream share the parser and the payment key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cowrie.operators.duplicates import payment_key
from cowrie.operators.messages import parse_messages


def read_payments(messages: DataFrame, delay: str = "2 days") -> DataFrame:
    """Payments of a stream with trader_id, raw, today and received_at; state is bounded by ``delay``."""
    parsed = parse_messages(messages).where("ok")
    key = payment_key(*[F.col(c) for c in ("ref", "time", "direction", "amount", "date", "raw")])
    return parsed.withColumn("payment_key", key).withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["trader_id", "payment_key"])


def daily_inflows(payments: DataFrame, delay: str = "2 days") -> DataFrame:
    """Money received per trader and day of arrival."""
    late = payments.withWatermark("received_at", delay)
    return late.where("direction = 'in'").groupBy("trader_id", F.window("received_at", "1 day")).agg(F.sum("amount").alias("received"), F.count("*").alias("payments"))
