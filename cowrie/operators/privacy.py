"""What a lender may see: consent, masking and share codes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cowrie.functions.text import mask_phone, mask_phones_in_text, normalize_share_code, short_name


def consented(rows: DataFrame, traders: DataFrame) -> DataFrame:
    """Rows of traders whose consent is granted."""
    return rows.join(traders.where("consent.granted").select(F.col("id").alias("trader_id")), "trader_id", "left_semi")


def redact_payments(payments: DataFrame) -> DataFrame:
    """Phones masked (in the text as well), names shortened."""
    return payments.withColumns({"phone": mask_phone(F.col("phone")), "counterparty": short_name(F.col("counterparty")), "raw": mask_phones_in_text(F.col("raw"))})


def redact_traders(traders: DataFrame) -> DataFrame:
    return traders.withColumn("phone", mask_phone(F.col("phone")))


def redact_sources(sources: DataFrame) -> DataFrame:
    """Phones inside the text of pages masked."""
    return sources.withColumn("text", mask_phones_in_text(F.col("text")))


def lender_bundle(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables of traders whose consent is granted, as a lender may see them: no phone and no full name of a customer is left.

    Lines and events pass as they are; without consent a trader has no row in any table.
    """
    seen = {n: t if n == "traders" else consented(t, tables["traders"]) for n, t in tables.items()}
    seen["traders"] = tables["traders"].where("consent.granted")
    masks = {"traders": redact_traders, "payments": redact_payments, "sources": redact_sources}
    return {n: masks[n](t) if n in masks else t for n, t in seen.items()}


def find_shared(traders: DataFrame, code: str) -> DataFrame:
    """The trader that granted access under a share code, however it is typed."""
    return traders.where("consent.granted").where(F.col("consent.code") == normalize_share_code(F.lit(code)))
