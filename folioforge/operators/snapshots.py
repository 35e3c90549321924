"""Content-addressed snapshots: fingerprints, merges, extensions, status, reuse plans."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def config_hash(config: dict, size: int = 16) -> str:
    """Hash of a configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:size]


def index_key(data_id: str, **hashes: str) -> str:
    """Key of an index: the data and every configuration that shapes it."""
    return config_hash({"data": data_id, **hashes}, 12)


def deep_merge(base: dict, override: dict) -> dict:
    """Override wins; dictionaries are merged key by key."""
    return base | {k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in override.items()}


def masked(config):
    """A copy without secrets: values of keys that name one become ***."""
    if isinstance(config, dict):
        return {k: "***" if any(w in k.lower() for w in ("api_key", "secret", "password")) and v else masked(v) for k, v in config.items()}
    return [masked(x) for x in config] if isinstance(config, list) else config


def content_hash(content: Column) -> Column:
    """SHA-256 of a text's bytes; null for a null text."""
    return F.sha2(content, 256)


def data_ids(files: DataFrame, by: str, sha: str) -> DataFrame:
    """(by, data_id, files): order-independent id of a set of files.

    The id is by definition a hash of the snapshot's whole sorted list, so one task holds 64 characters a file, but no texts.
    """
    return files.where(F.col(sha).isNotNull()).groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(sha)), "|"), 256).alias("data_id"), F.count("*").alias("files"))


def merged(files: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Union of snapshots: the first file of each path in ``order``."""
    return files.withColumn("_k", F.row_number().over(Window.partitionBy(path).orderBy(*order))).where("_k = 1").drop("_k")


def merge_counts(files: DataFrame, path: str, source: str, order: list[str]) -> DataFrame:
    """(source, offered, added, duplicates): how many files each snapshot adds to a merge, and how many earlier ones had."""
    place = F.row_number().over(Window.partitionBy(path).orderBy(*order))
    added = F.count_if(F.col("_k") == 1)
    return files.withColumn("_k", place).groupBy(source).agg(F.count("*").alias("offered"), added.alias("added"), (F.count("*") - added).alias("duplicates"))


def extended(base: DataFrame, more: DataFrame, path: str, refuse_empty: bool = False) -> DataFrame:
    """Base files and those of ``more`` whose path is new; with ``refuse_empty`` an error if none is."""
    new = more.join(base.select(path).distinct(), path, "left_anti")
    if refuse_empty and new.isEmpty():
        raise ValueError("no file is new")
    return base.unionByName(new)


def latest_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both; where both have a key, each field is the new one's unless that is null."""
    fields = [c for c in old.columns if c != key]
    later = new.select(key, *(F.col(c).alias(f"_new_{c}") for c in fields))
    return old.join(later, key, "full").select(key, *(F.coalesce(f"_new_{c}", c).alias(c) for c in fields))


def case_actions(saved: DataFrame, wanted: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, action): duplicate where the same kind of case is saved already, type_changed where another one is, else saved."""
    both = wanted.join(saved.select(key, F.col(kind).alias("_saved")), key, "left")
    return both.select(key, F.when(F.col("_saved").isNull(), "saved").when(F.col("_saved") == F.col(kind), "duplicate").otherwise("type_changed").alias("action"))


def statistics(files: DataFrame, pages: DataFrame, chunks: DataFrame, by: str, path: str) -> DataFrame:
    """(by, files, pages, chunks) of each snapshot; ``pages`` and ``chunks`` have one row each with its file's path."""
    counts = files.select(by, path)
    for name, rows in (("pages", pages), ("chunks", chunks)):
        counts = counts.join(rows.groupBy(path).agg(F.count("*").alias(f"_{name}")), path, "left")
    return counts.groupBy(by).agg(F.count("*").alias("files"), *(F.coalesce(F.sum(f"_{name}"), F.lit(0)).alias(name) for name in ("pages", "chunks")))


def status(recorded: DataFrame, present: DataFrame, by: str, path: str, sha: str) -> DataFrame:
    """available, missing, changed or mixed for each snapshot, with counts."""
    both = recorded.join(present.select(path, F.col(sha).alias("_now")), path, "left")
    gone, other = F.count_if(F.col("_now").isNull()), F.count_if(F.col("_now") != F.col(sha))
    state = F.when((gone == 0) & (other == 0), "available").when(gone == 0, "changed").when(other == 0, "missing").otherwise("mixed")
    return both.groupBy(by).agg(state.alias("status"), gone.alias("n_missing"), other.alias("n_changed"))


def unparsed(files: DataFrame, manifest: DataFrame, path: str, sha: str) -> DataFrame:
    """Files that the manifest lacks or has with other content."""
    return files.join(manifest.select(path, sha), [path, sha], "left_anti")


def equivalence_groups(files: DataFrame, path: str) -> DataFrame:
    """(group_key, members): paths of one folder whose stems differ only in an edition mark, where there are several."""
    from folioforge.functions import text as T

    posix = F.translate(F.col(path), "\\", "/")
    key = F.concat_ws("/", F.regexp_extract(posix, r"^(.*)/[^/]*$", 1), F.regexp_replace(T.stem(F.col(path)), r"(_摘要|摘要|_英文版_|_修订版_)$", ""))
    return files.groupBy(key.alias("group_key")).agg(F.array_sort(F.collect_set(path)).alias("members")).where(F.size("members") > 1)


def canonical(lists: DataFrame, key: str, column: str, groups: DataFrame) -> DataFrame:
    """(key, column): arrays of paths with each member of an equivalence group replaced by its group's key, in place.

    A path in several groups takes the first key. Groups of one folder are few; the lists are exploded, not collected.
    """
    member = groups.select("group_key", F.explode("members").alias("_path")).groupBy("_path").agg(F.min("group_key").alias("_group"))
    places = lists.select(key, F.posexplode_outer(F.col(column)).alias("_k", "_path"))
    named = places.join(member, "_path", "left").select(key, "_k", F.coalesce("_group", "_path").alias("_p"))
    ordered = F.sort_array(F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_k", "_p"))))
    return named.groupBy(key).agg(F.transform(ordered, lambda x: x["_p"]).alias(column))


def plan(wanted: DataFrame, done: DataFrame, name: str, hashed: str) -> DataFrame:
    """run, reuse or confirm for each variant: new, done with the same hash, done with another."""
    both = wanted.join(done.select(name, F.col(hashed).alias("_done"), "completed"), name, "left")
    action = F.when(F.coalesce(F.col("completed"), F.lit(False)) & F.col("_done").eqNullSafe(F.col(hashed)), "reuse").when(F.coalesce(F.col("completed"), F.lit(False)), "confirm").otherwise("run")
    return both.select(name, action.alias("action"))


def differences(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old, new) for every field in which two rows of one key differ; nulls are equal to nulls."""
    a = left.select(key, F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.col(f).cast("string") for f in fields))).alias("a"))
    b = right.select(key, F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.col(f).cast("string") for f in fields))).alias("b"))
    each = a.join(b, key).select(key, F.explode(F.array(*map(F.lit, fields))).alias("field"), "a", "b")
    values = each.select(key, "field", F.col("a")[F.col("field")].alias("old"), F.col("b")[F.col("field")].alias("new"))
    return values.where(~F.col("old").eqNullSafe(F.col("new")))
