"""Sinks: canonical lists by slug, whole-table overwrites, appends to target collections."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinata.functions import text as tx
from ostinata.operators.library import in_order, with_ids
from ostinata.operators.reconcile import batches, next_state
from ostinata.sources.storage import Scratch


def assembled(members: DataFrame, key: str = "slug", name: str = "name") -> DataFrame:
    """key, name, tracks of lists from their members (key, name, pos, track fields)."""
    fields = [c for c in members.columns if c not in (key, name, "pos")]
    return members.groupBy(key, name).agg(in_order("pos", F.struct(*fields)).alias("tracks"))


def write_lists(lists: DataFrame, folder: str) -> None:
    """<slug>.json in the folder for each list (name, tracks), as read_library reads them; absent fields are left out, other files stay.

    Lists with one slug are one file: the name of the last and all tracks, in the order of ord (or of name where there is no ord).
    """
    spark = lists.sparkSession
    order = "ord" if "ord" in lists.columns else "name"
    slugged = lists.select(tx.slugify("name").alias("slug"), F.col(order).alias("_o"), "name", "tracks")
    one = slugged.groupBy("slug").agg(F.max_by("name", "_o").alias("name"), F.flatten(in_order("_o", "tracks")).alias("tracks"))
    made = f"{folder}/_lists-{uuid.uuid4().hex}"
    one.repartition("slug").write.partitionBy("slug").json(made)
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    fs = path(folder).getFileSystem(conf)
    # one rename for each list: files are what this sink is for
    for d in fs.listStatus(path(made)):
        slug = unquote(d.getPath().getName().partition("=")[2])
        for part in fs.listStatus(d.getPath()) if d.isDirectory() else []:
            target = path(folder, f"{slug}.json")
            fs.delete(target, False)
            fs.rename(part.getPath(), target)
    fs.delete(path(made), True)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_snapshot(playlists: DataFrame, user: str, path: str) -> None:
    """The library as one object with its time of pulling."""
    order = in_order("ord", F.struct("name", "description", "kind", "owner_id", "source_id", "tracks"))
    overwrite(playlists.agg(order.alias("playlists")).select(F.current_timestamp().alias("pulled_at"), F.lit(user).alias("user_id"), "playlists"), path)


def save_views(**tables: DataFrame) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def append_tracks(plan: DataFrame, path: str) -> None:
    """to_add of a push plan as rows (name, pos, target_id, batch) added to a table of contents."""
    rows = plan.select("name", F.posexplode("to_add").alias("pos", "target_id"))
    batches(rows).write.mode("append").parquet(path)


def create_targets(plan: DataFrame, path: str) -> DataFrame:
    """(name, target_id) of the collections that a plan creates, added to a table of targets; the same name gets the same id again."""
    made = plan.where("action = 'create'").select("name", F.concat(F.lit("p."), F.substring(F.sha2("name", 256), 1, 20)).alias("target_id"))
    made.write.mode("append").parquet(path)
    return made


def commit_push(plan: DataFrame, state: DataFrame, folder: str, group: int = 1000) -> DataFrame:
    """Carry out a push plan in groups of collections (in the order of their names), saving the record after each; returns the record.

    folder/contents gets the appended ids, folder/targets the created collections and folder/state/<n> the record after group n, which is written
    last. Each group overwrites its own parts, so a push that broke off goes on behind the last record saved, and nothing is appended twice.
    """
    spark = plan.sparkSession
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    ranked = with_ids(plan.where("action <> 'skip'"), ["name"], "_n").withColumn("_g", F.floor((F.col("_n") - 1) / group))
    ranked = Scratch(spark).keep(ranked)
    last = ranked.agg(F.max("_g")).first()[0]
    now = state
    for g in range(0 if last is None else last + 1):
        saved = f"{folder}/state/{g}"
        if not path(saved, "_SUCCESS").getFileSystem(conf).exists(path(saved, "_SUCCESS")):
            mine = ranked.where(F.col("_g") == g).drop("_n", "_g")
            new = mine.where("action = 'create'").select("name", F.concat(F.lit("p."), F.substring(F.sha2("name", 256), 1, 20)).alias("target_id"))
            new.write.mode("overwrite").parquet(f"{folder}/targets/group={g}")
            batches(mine.select("name", F.posexplode("to_add").alias("pos", "target_id"))).write.mode("overwrite").parquet(f"{folder}/contents/group={g}")
            next_state(now, mine, new).write.mode("overwrite").parquet(saved)
        now = spark.read.parquet(saved)
    return now
