"""An external catalog kept as entity, attribute, value: lookup, pivot, keyword search, attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions.scalars import catalog_year

# Item types searched, and fields whose values count.
ITEM_TYPES = ("journalArticle", "preprint", "conferencePaper", "book", "bookSection", "thesis", "report", "document", "manuscript", "webpage")
FIELDS = ("title", "abstractNote", "publicationTitle", "DOI", "date")


def pivot_fields(item_data: DataFrame, fields: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """(itemID, one column per field name): the value of each field. Known names make it a single aggregate."""
    rows = item_data.join(F.broadcast(fields.filter(F.col("fieldName").isin(names))), "fieldID").join(values, "valueID")  # at most as many fields as names
    return rows.groupBy("itemID").agg(*[F.min(F.when(F.col("fieldName") == n, F.col("value"))).alias(n) for n in names])


def creators(item_creators: DataFrame, people: DataFrame) -> DataFrame:
    """(itemID, creators): names in order, joined by `; `."""
    name = F.trim(F.concat_ws(" ", "firstName", "lastName"))
    rows = item_creators.join(people, "creatorID").groupBy("itemID").agg(F.array_sort(F.collect_list(F.struct("orderIndex", name.alias("name")))).alias("l"))
    return rows.select("itemID", F.array_join(F.filter(F.transform("l", lambda x: x["name"]), lambda x: x != ""), "; ").alias("creators"))


def assemble(items: DataFrame, pivoted: DataFrame, names: DataFrame) -> DataFrame:
    """Catalog rows: title with a default, year of the date or year field, publication or proceedings, creators."""
    r = items.join(pivoted, "itemID", "left").join(names, "itemID", "left")
    have = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return r.select("itemID", "key", F.coalesce(have("title"), F.lit("(untitled)")).alias("title"), F.coalesce(catalog_year("date"), catalog_year("year")).alias("year"), F.coalesce(have("publicationTitle"), have("proceedingsTitle"), F.lit("")).alias("publication"), F.coalesce("creators", F.lit("")).alias("creators"))


def alive(items: DataFrame, deleted: DataFrame) -> DataFrame:
    return items.join(deleted.select("itemID"), "itemID", "left_anti")


def item_count(items: DataFrame, types: DataFrame, deleted: DataFrame) -> DataFrame:
    return alive(items, deleted).join(types.select("itemTypeID"), "itemTypeID", "left_semi").agg(F.count("*").alias("n"))


def lookup(items: DataFrame, deleted: DataFrame, ref: str) -> DataFrame:
    """The item meant by a number or a key: the number first, then the key regardless of case."""
    live = alive(items, deleted)
    by_key = live.filter(F.lower("key") == ref.strip().lower()).withColumn("way", F.lit(2))
    both = live.filter(F.col("itemID") == int(ref)).withColumn("way", F.lit(1)).unionByName(by_key) if ref.strip().isdigit() else by_key
    return both.orderBy("way", "itemID").limit(1).drop("way")


def keyword_search(items: DataFrame, data: DataFrame, people: DataFrame, deleted: DataFrame, query: str, k: int = 20) -> DataFrame:
    """(itemID, bucket) of live items where a value or creator contains the query or whose key it is; those with a
    hit in the title first, then in the creators, then others. data: (itemID, fieldName, value); people: (itemID, name)."""
    q = F.lit(query.strip().lower())
    value = data.filter(F.contains(F.lower("value"), q)).select("itemID", F.when(F.col("fieldName") == "title", 0).otherwise(2).alias("bucket"))
    name = people.filter(F.contains(F.lower("name"), q)).select("itemID", F.lit(1).alias("bucket"))
    key = items.filter(F.lower("key") == q).select("itemID", F.lit(2).alias("bucket"))
    hits = value.union(name).union(key).groupBy("itemID").agg(F.min("bucket").alias("bucket"))
    return hits.join(alive(items, deleted).select("itemID"), "itemID", "left_semi").orderBy("bucket", "itemID").limit(k)


def attachments(rows: DataFrame, items: DataFrame, deleted: DataFrame, storage: str) -> DataFrame:
    """(parentItemID, itemID, path): live attachments; `storage:` paths lie in the item key's folder."""
    own = rows.join(alive(items, deleted).select("itemID", "key"), "itemID")
    stored = F.concat(F.lit(storage.rstrip("/") + "/"), "key", F.lit("/"), F.regexp_replace("path", "^storage:", ""))
    path = F.when(F.col("path").startswith("storage:"), stored).when(F.col("path").startswith("attachments:"), F.regexp_replace("path", "^attachments:", "")).otherwise(F.col("path"))
    return own.filter("path is not null").select("parentItemID", "itemID", "contentType", path.alias("path"))
