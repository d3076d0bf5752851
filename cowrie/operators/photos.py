"""Photos as new pages: what is refused, what repeats another photo, and the events to record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cowrie.operators.duplicates import exact_duplicates, near_duplicates

# Kinds of photos, the largest size and the shape of a picture hash.
KINDS = ("notebook", "receipt", "momo_screenshot")
MOST_BYTES = 10 << 20
HASH = "^[0-9a-f]{64}$"


def ingest_photos(uploads: DataFrame, sources: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Append ``problem``, ``status``, ``duplicate_of``, ``cross_trader`` and ``distance`` to uploads (id, ord, trader_id, kind, bytes, mime, sha256, dhash, name).

    ``problem`` is invalid_input (unknown kind), image_too_large, image_invalid (no
    ``mime``), duplicate_photo (the bytes of a page in ``sources`` or of an upload
    before it), or null. Sound uploads are pending, or duplicate if an earlier page
    or sound upload looks alike; ``duplicate_of`` names the closest, the first on
    ties. Hashes of another shape become null, names are cut to 120 signs. ``ord``
    orders uploads and, in ``sources`` (id, ord, trader_id, sha256, dhash), pages;
    ids are unique over both. Null digests repeat nothing.
    """
    problem = F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "invalid_input").when(F.col("bytes") > most_bytes, "image_too_large").when(F.col("mime").isNull(), "image_invalid")
    t = uploads.withColumns({"problem": problem, "dhash": F.when(F.col("dhash").rlike(HASH), F.col("dhash")), "name": F.left("name", F.lit(120))})
    place = lambda batch: F.struct(F.lit(batch).alias("batch"), F.col("ord").alias("at")).alias("ord")
    keep = lambda df, batch: df.select("id", "trader_id", "sha256", "dhash", place(batch))
    both = exact_duplicates(keep(sources, 0).unionByName(keep(t.where("problem IS NULL"), 1)))
    blocked = (F.col("ord.batch") == 1) & F.col("first_id").isNotNull()
    stored = both.where(~blocked)
    near = near_duplicates(stored.withColumn("asked", F.col("ord.batch") == 1), asked="asked").join(stored.select(F.col("id").alias("near_id"), F.col("trader_id").alias("near_trader")), "near_id")
    exact = both.where(blocked).select("id", F.lit("exact").alias("match"), F.col("first_id").alias("duplicate_of"), "cross_trader", F.lit(0).alias("distance"))
    near = near.join(t.select("id", "trader_id"), "id").select("id", F.lit("near").alias("match"), F.col("near_id").alias("duplicate_of"), (~F.col("near_trader").eqNullSafe(F.col("trader_id"))).alias("cross_trader"), F.col("bits").alias("distance"))
    out = t.join(exact.unionByName(near), "id", "left").withColumn("problem", F.coalesce("problem", F.when(F.col("match") == "exact", "duplicate_photo")))
    return out.withColumn("status", F.when(F.col("problem").isNull(), F.when(F.col("match") == "near", "duplicate").otherwise("pending"))).drop("match")


def photo_events(decided: DataFrame) -> DataFrame:
    """(trader_id, source_id, type, of, cross_trader, distance): photos added, flagged as alike and blocked as copies; other refusals leave no event."""
    event = lambda when, name, source, *columns: F.when(when, F.struct(source, F.lit(name).alias("type"), *columns))
    source, none, detail = F.col("id").alias("source_id"), F.lit(None), [F.col("duplicate_of").alias("of"), F.col("cross_trader").alias("cross_trader"), F.col("distance").alias("distance")]
    kinds = {f.name: f.dataType for f in decided.schema}
    empty = [none.cast(kinds["duplicate_of"]).alias("of"), none.cast("boolean").alias("cross_trader"), none.cast("int").alias("distance")]
    nobody = none.cast(kinds["id"]).alias("source_id")
    sound = F.col("problem").isNull()
    happened = F.array_compact(F.array(
        event(sound, "photo_added", source, *empty), event(sound & (F.col("status") == "duplicate"), "photo_duplicate_flagged", source, *detail),
        event(F.col("problem") == "duplicate_photo", "photo_duplicate_blocked", nobody, *detail),
    ))
    return decided.select("trader_id", F.inline(happened))
