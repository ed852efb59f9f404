"""Single-document mutations re-aimed as change-log merges.

Each job reduces a change log to one row per key with aggregates (latest
non-null value per field = max of struct(ts, value)), which combine map-side:
a key with a third of all changes costs one partial row per input partition.
The reduced log is then joined to the current table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalytics.functions.predicates import edit_is_valid
from catalytics.operators.listings import LISTING_COLUMNS, listing_view

CAT = "categoryName"
# The editable listing fields and the editable profile fields.
EDITABLE_LISTING_FIELDS = ("title", "categoryName", "price", "stars", "boughtInLastMonth", "isBestSeller",
                           "description")
EDITABLE_PROFILE_FIELDS = ("name", "phone", "department", "city", "role")
TS_FORMAT = "yyyy-MM-dd HH:mm"


def latest_non_null(c: str, ts: str = "ts") -> Column:
    """Value of ``c`` at the greatest ts among rows where it is not null."""
    return F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(c).alias("v"))))["v"]


def _listing_key(df: DataFrame) -> DataFrame:
    return df.withColumn("_owner", F.lower(F.trim("owner_email")))


def listing_updates(listings: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply the latest non-null value of each editable field of the valid requests per
    (id, owner); a request from a non-owner matches nothing."""
    return updated_rows(listing_view(listings).select(*LISTING_COLUMNS), updates)


def updated_rows(rows: DataFrame, updates: DataFrame) -> DataFrame:
    """U2 over typed listing rows."""
    red = (_listing_key(updates.where(edit_is_valid())).groupBy("id", "_owner")
           .agg(*[latest_non_null(f).alias(f"_new_{f}") for f in EDITABLE_LISTING_FIELDS],
                F.max("ts").alias("_ts")))
    j = _listing_key(rows).join(red, ["id", "_owner"], "left")
    return j.select("asin", "id", "owner_email",
                    *[F.coalesce(F.col(f"_new_{f}"), F.col(f)).alias(f) for f in EDITABLE_LISTING_FIELDS],
                    "image_filename", "added_on", F.date_format("_ts", TS_FORMAT).alias("updated_on"))


def listing_deletes(listings: DataFrame, deletes: DataFrame) -> DataFrame:
    """Remove listings named by (id, owner) delete requests (left anti join)."""
    keys = _listing_key(deletes).select("id", "_owner").distinct()
    cur = _listing_key(listing_view(listings).select(*LISTING_COLUMNS))
    return cur.join(keys, ["id", "_owner"], "left_anti").drop("_owner")


def stored_updates(rows: DataFrame, updates: DataFrame) -> DataFrame:
    """U2 over stored rows: as ``updated_rows``, and a row that nothing changes keeps its time of change."""
    new = updated_rows(rows.drop("updated_on"), updates).withColumnRenamed("updated_on", "_new_time")
    return new.join(rows.select("id", "updated_on"), "id").withColumn("updated_on", F.coalesce("_new_time", "updated_on")).drop("_new_time")


def stored_deletes(rows: DataFrame, deletes: DataFrame) -> DataFrame:
    """U3 over stored rows."""
    keys = _listing_key(deletes).select("id", "_owner").distinct()
    return _listing_key(rows).join(keys, ["id", "_owner"], "left_anti").drop("_owner")


def seller_activity_merge(listings: DataFrame, uploads: DataFrame) -> DataFrame:
    """Newest uploaded image per (id, owner) sets image_filename/updated_on."""
    red = (_listing_key(uploads).groupBy("id", "_owner")
           .agg(F.max(F.struct(F.col("ts").alias("t"), F.col("image_filename").alias("v"))).alias("_m")))
    cur = _listing_key(listing_view(listings).select(*LISTING_COLUMNS))
    j = cur.join(red, ["id", "_owner"], "left")
    return j.select("asin", "id", "owner_email",
                    F.coalesce(F.col("_m.v"), F.col("image_filename")).alias("image_filename"),
                    F.date_format(F.col("_m.t"), TS_FORMAT).alias("updated_on"))


def safe_projection(users: DataFrame) -> DataFrame:
    """Every user column except the password hash."""
    return users.drop("password_hash", "_id")


def profile_updates(users: DataFrame, updates: DataFrame) -> DataFrame:
    """U4: merge the latest non-empty value of each allowed field per email; the hash is never given out."""
    return safe_projection(merged_profiles(users, updates))


def merged_profiles(users: DataFrame, updates: DataFrame) -> DataFrame:
    """U4 with the stored password hash: a ``new_password`` in the log replaces it by its SHA-256."""
    # an empty string means "not supplied"
    u = updates.select(F.lower(F.trim("email")).alias("_email"), "ts",
                       *[F.when(F.col(f) != "", F.col(f)).alias(f) for f in EDITABLE_PROFILE_FIELDS],
                       (F.when(F.col("new_password") != "", F.sha2("new_password", 256)) if "new_password" in updates.columns
                        else F.lit(None).cast("string")).alias("password_hash"))
    fields = (*EDITABLE_PROFILE_FIELDS, "password_hash")
    red = u.groupBy("_email").agg(*[latest_non_null(f).alias(f"_new_{f}") for f in fields])
    cur = users.withColumn("_email", F.lower(F.trim("email")))
    return cur.join(red, "_email", "left").select("email", *[F.coalesce(F.col(f"_new_{f}"), F.col(f)).alias(f) for f in fields], "joined")


def duplicate_registration(users: DataFrame, registrations: DataFrame) -> DataFrame:
    """Accepted sign-ups: the first per normalized email in the batch
    (min by (ts, event_id), a partial aggregate), minus emails already
    registered (left anti join, case-insensitive)."""
    r = registrations.withColumn("email_norm", F.lower(F.trim("email")))
    first = (r.groupBy("email_norm")
              .agg(F.min(F.struct("ts", "event_id", "name")).alias("_f"), F.count("*").alias("attempts")))
    known = users.select(F.lower(F.trim("email")).alias("email_norm")).distinct()
    return (first.join(known, "email_norm", "left_anti")
                 .select(F.col("email_norm").alias("email"), F.col("_f.name").alias("name"),
                         F.col("_f.event_id").alias("event_id"), "attempts",
                         F.lit("Analyst").alias("role"),
                         F.date_format(F.col("_f.ts"), "yyyy-MM-dd").alias("joined")))


def registration_outcomes(users: DataFrame, registrations: DataFrame) -> DataFrame:
    """U5 summary: sign-ups per outcome (accepted / duplicate in batch /
    already registered), from aggregates only."""
    r = registrations.withColumn("email_norm", F.lower(F.trim("email")))
    per_email = r.groupBy("email_norm").agg(F.count("*").alias("n"))
    known = users.select(F.lower(F.trim("email")).alias("email_norm"), F.lit(True).alias("known")).distinct()
    j = per_email.join(known, "email_norm", "left")
    return j.agg(
        F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).cast("bigint").alias("accepted"),
        F.sum(F.when(F.col("known").isNull(), F.col("n") - 1).otherwise(0)).cast("bigint").alias("duplicate_in_batch"),
        F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).cast("bigint").alias("already_registered"))
