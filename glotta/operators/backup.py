"""Learner backups: merging two states, and their JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMAT = "glotta-backup"


def merge_cards(mine: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: of both states' cards the one with the later due day; of equal days mine, of mine the last by all columns.

    Rows without a due day, such as words, are mine where both have them.
    """
    columns = mine.columns
    both = theirs.select(*columns, F.lit(0).alias("src")).unionByName(mine.select(*columns, F.lit(1).alias("src")))
    rest = [c for c in columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*[c for c in ("due",) if c in rest], "src", *[c for c in rest if c != "due"])).alias("x")
    return both.groupBy(*keys).agg(best).select(*keys, *(F.col(f"x.{c}").alias(c) for c in rest)).select(columns)


def merge_counters(mine: DataFrame, theirs: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """The larger of each counter."""
    return mine.select(key, *counters).unionByName(theirs.select(key, *counters)).groupBy(key).agg(*(F.max(c).alias(c) for c in counters))


def merge_maps(mine: Column, theirs: Column, kind: str) -> Column:
    """The entries of both maps (``kind`` is their type); of a key in both, mine, null values included."""
    none = F.create_map().cast(kind)
    mine, theirs = F.coalesce(mine, none), F.coalesce(theirs, none)
    return F.map_zip_with(theirs, mine, lambda k, t, m: F.when(F.map_contains_key(mine, k), m).otherwise(t))


def merge_states(mine: DataFrame, theirs: DataFrame, key: str, counters: list[str], maps: list[str]) -> DataFrame:
    """One row per learner: the larger of each counter, the union of each map with mine first; a state that only one side has as it is, counters at least 0."""
    kinds = {f.name: f.dataType.simpleString() for f in mine.schema}
    named = lambda df, side: df.select(key, *(F.col(c).alias(f"_{side}_{c}") for c in counters + maps))
    both = named(mine, "m").join(named(theirs, "t"), key, "full")
    larger = [F.coalesce(F.greatest(f"_m_{c}", f"_t_{c}"), F.lit(0)).alias(c) for c in counters]
    joined = [merge_maps(F.col(f"_m_{c}"), F.col(f"_t_{c}"), kinds[c]).alias(c) for c in maps]
    return both.select(key, *larger, *joined)


def backup_json(cards: DataFrame, learner: str, version: int = 1) -> DataFrame:
    """(learner, json): a learner's cards as one backup document. A learner's state is small; learners are many."""
    rest = [c for c in cards.columns if c != learner]
    state = F.struct(F.array_sort(F.collect_list(F.struct(*rest))).alias("cards"))
    body = F.struct(F.lit(FORMAT).alias("format"), F.lit(version).alias("version"), state.alias("state"))
    return cards.groupBy(learner).agg(F.to_json(body).alias("json"))


def valid_backups(backups: DataFrame, card_schema: str, column: str = "json") -> DataFrame:
    """``backups`` with ``cards`` of those that have the format and cards; all others are left out."""
    parsed = F.from_json(column, f"struct<format:string,version:int,state:struct<cards:array<{card_schema}>>>")
    return backups.withColumn("_parsed", parsed).where((F.col("_parsed.format") == FORMAT) & F.col("_parsed.state.cards").isNotNull()).withColumn("cards", F.col("_parsed.state.cards")).drop("_parsed")


def whole_backups(backups: DataFrame, card_schema: str, column: str = "json") -> DataFrame:
    """``valid_backups`` of those whose state also has words (vocab), as a list or by name."""
    vocab = F.get_json_object(column, "$.state.vocab")
    return valid_backups(backups.where(vocab.startswith("[") | vocab.startswith("{")), card_schema, column)
