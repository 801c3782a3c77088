"""Idempotent reconciliation of desired with recorded contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ostinata.functions import text as tx
from ostinata.operators.library import first_by, in_order

ADD_BATCH = 100


def desired(members: DataFrame, resolved: DataFrame, playlist: str = "name") -> DataFrame:
    """playlist, desired ids: targets of the members in order, unresolved ones dropped, each target once."""
    hit = members.join(resolved, "key").where("coalesce(target_id, '') <> ''")
    once = first_by(hit.select(playlist, "pos", "target_id"), [playlist, "target_id"], ["pos"])
    return once.groupBy(playlist).agg(in_order("pos", "target_id").alias("desired"))


def reconcile(rows: DataFrame, recorded: str = "recorded", wanted: str = "desired") -> DataFrame:
    """Adds to_add and ordered: the missing suffix if the recorded ids begin the desired ones, else the desired ids that aren't recorded, unordered."""
    none = F.array().cast("array<string>")
    cur, want = F.coalesce(F.col(recorded).cast("array<string>"), none), F.coalesce(F.col(wanted).cast("array<string>"), none)
    prefix = (F.size(cur) <= F.size(want)) & (F.slice(want, F.lit(1), F.size(cur)) == cur)
    suffix = F.slice(want, F.size(cur) + 1, F.greatest(F.size(want) - F.size(cur), F.lit(0)))
    return rows.withColumn("to_add", F.when(prefix, suffix).otherwise(F.filter(want, lambda x: ~F.array_contains(cur, x)))).withColumn("ordered", prefix)


def missing_from_library(members: DataFrame, resolved: DataFrame, refs: DataFrame, added: DataFrame, playlist: str = "name") -> DataFrame:
    """playlist, pos, target_id of members that the target collection lacks.

    members(playlist, pos, key, title, artists); refs(playlist, title, artist): what is there; added(playlist, target_id): what was added before.
    A member counts as there by its id or by its normalised title and artists.
    """
    hit = members.join(resolved, "key").where("coalesce(target_id, '') <> ''").withColumn("_ref", tx.ref_key("title", F.array_join("artists", " ")))
    there = refs.select(playlist, tx.ref_key("title", "artist").alias("_ref"))
    left = hit.join(added.select(playlist, "target_id"), [playlist, "target_id"], "left_anti").join(there, [playlist, "_ref"], "left_anti")
    return first_by(left.select(playlist, "pos", "target_id"), [playlist, "target_id"], ["pos"])


def decisions(playlists: DataFrame, state: DataFrame, existing: DataFrame, adopt: bool = False) -> DataFrame:
    """name, action: 'resume' what is on record, 'adopt' or 'skip' what exists without a record, 'create' the rest. existing(name, id, ord): later ids win."""
    there = existing.groupBy("name").agg(F.max_by("id", "ord").alias("existing_id"))
    j = playlists.select("name").join(state.select("name", "target_id"), "name", "left").join(there, "name", "left")
    action = F.when(F.coalesce("target_id", F.lit("")) != "", F.lit("resume")).when(F.col("existing_id").isNotNull(), F.lit("adopt" if adopt else "skip")).otherwise(F.lit("create"))
    return j.select("name", action.alias("action"), F.coalesce(F.nullif("target_id", F.lit("")), "existing_id").alias("target_id"))


def batches(rows: DataFrame, playlist: str = "name", size: int = ADD_BATCH) -> DataFrame:
    """Numbers append requests: the batch of each row within its collection."""
    w = W.partitionBy(playlist).orderBy("pos")
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def push_plan(playlists: DataFrame, members: DataFrame, resolved: DataFrame, state: DataFrame, existing: DataFrame, refs: DataFrame, adopt: bool = False) -> DataFrame:
    """name, action, target_id, to_add, ordered of every collection: what a push would append, and to what (NULL where it is to be created). Nothing is written (dry run).

    state(name, target_id, added_ids, adopted). Adopted collections are compared with their contents, others with the record.
    """
    act = decisions(playlists, state, existing, adopt)
    want = playlists.select("name").join(desired(members, resolved), "name", "left")
    rec = want.join(state.select("name", F.col("added_ids").alias("recorded"), "adopted"), "name", "left").join(act, "name")
    by_record = reconcile(rec)
    added = state.select("name", F.explode("added_ids").alias("target_id"))
    lacking = missing_from_library(members, resolved, refs, added).groupBy("name").agg(in_order("pos", "target_id").alias("lacking"))
    none = F.array().cast("array<string>")
    diff = (F.col("action") == "adopt") | F.coalesce("adopted", F.lit(False))
    out = by_record.join(lacking, "name", "left")
    to_add = F.when(F.col("action") == "skip", none).when(diff, F.coalesce("lacking", none)).otherwise(F.col("to_add"))
    return out.select("name", "action", "target_id", to_add.alias("to_add"), F.when(diff, F.lit(True)).otherwise(F.col("ordered")).alias("ordered"))


def next_state(state: DataFrame, plan: DataFrame, created: DataFrame | None = None) -> DataFrame:
    """The record after a push: created ones get their id from created(name, target_id) (by name without it), adopted ones that of what was found,
    appended ids are recorded, all but skipped ones are done."""
    none = F.array().cast("array<string>")
    p = plan.select("name", "action", "to_add", *[F.col(c).alias("_found") for c in plan.columns if c == "target_id"])
    j = p.join(state, "name", "full")
    if created is not None:
        j = j.join(created.select("name", F.col("target_id").alias("_new")), "name", "left")
    done = F.coalesce(F.col("action") != "skip", F.lit(False))
    fresh = F.col("_new") if created is not None else F.concat(F.lit("new:"), "name")
    known = F.nullif("target_id", F.lit(""))
    found = F.when(F.col("action") == "adopt", F.col("_found")) if "_found" in j.columns else F.lit(None).cast("string")
    return j.select(
        "name",
        F.coalesce(known, found, F.when(done & (F.col("action") != "resume"), fresh)).alias("target_id"),
        F.when(done, F.concat(F.coalesce("added_ids", none), "to_add")).otherwise(F.coalesce("added_ids", none)).alias("added_ids"),
        (done | F.coalesce("done", F.lit(False))).alias("done"),
        (F.coalesce(F.col("action") == "adopt", F.lit(False)) | F.coalesce("adopted", F.lit(False))).alias("adopted"),
    )
