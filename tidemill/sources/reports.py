"""Reports of what a folder holds, as JSON texts: read with a schema, faults as rows, and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is read of a report; other keys are ignored.
REPORT = (
    "probeVersion variant, uidValidity map<string,variant>, sample array<struct<uid:variant,internalDate:variant,internalIdSha256:variant>>, folders array<variant>, _corrupt string"
)
#: Fixed value: the version of reports that is understood.
VERSION = 1

_NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\)|TINYINT|SMALLINT|INT)$"


def _is(kind: str, value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike(kind), F.lit(False))


def report_faults(parsed: Column) -> Column:
    """The names of what is wrong with a report that was read with REPORT: not_json, version, uid_validity, sample; empty for a good one.

    Numbers and texts are told by their type in the JSON, never converted: a uid in quotes is a fault. An id in the sample is a text or null. JSON that is no object, or in which a
    list stands for an object, is not_json.
    """
    sample = parsed["sample"]
    entry_good = lambda s: _is(_NUMBER, s["uid"]) & _is("^STRING$", s["internalDate"]) & (s["internalIdSha256"].isNull() | _is("^(STRING|VOID)$", s["internalIdSha256"]))
    number = F.coalesce(F.try_variant_get(parsed["probeVersion"], "$", "double") == VERSION, F.lit(False)) & _is(_NUMBER, parsed["probeVersion"])
    broken = {
        "version": ~number,
        "uid_validity": parsed["uidValidity"].isNull() | F.exists(F.map_values(parsed["uidValidity"]), lambda v: ~_is(_NUMBER, v)),
        "sample": sample.isNull() | F.exists(sample, lambda s: s.isNull() | ~entry_good(s)),
    }
    named = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in broken.items()]), lambda x: x.isNotNull())
    unread = parsed.isNull() | parsed["_corrupt"].isNotNull()
    return F.when(unread, F.array(F.lit("not_json"))).otherwise(named)


def read_reports(texts: DataFrame, text: str = "value") -> DataFrame:
    """``texts`` with ``report`` (struct<uid_validity map<string,long>, sample array<struct<uid, internal_date, id>>, folders array<string>>, null if it has faults) and ``faults``.

    Each text is read where it is, by ``from_json`` with a schema and a column for what it cannot read; no row is lost and none stops the others.
    """
    parsed = F.from_json(text, REPORT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    read = texts.withColumn("__r", parsed).withColumn("faults", report_faults(F.col("__r")))
    as_long = lambda v: F.try_variant_get(v, "$", "double").cast("long")
    as_text = lambda v: F.try_variant_get(v, "$", "string")
    report = F.struct(
        F.transform_values("__r.uidValidity", lambda _, v: as_long(v)).alias("uid_validity"),
        F.transform("__r.sample", lambda s: F.struct(as_long(s["uid"]).alias("uid"), as_text(s["internalDate"]).alias("internal_date"), as_text(s["internalIdSha256"]).alias("id"))).alias("sample"),
        F.coalesce(F.transform("__r.folders", as_text), F.array().cast("array<string>")).alias("folders"),
    )
    return read.withColumn("report", F.when(F.size("faults") == 0, report)).drop("__r")


def compared(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, n_matched, n_uid_changed, n_date_changed, n_missing, new_folders, missing_folders) of each key's report before and after.

    Entries of the sample are matched by their id (those without one are not); an id that stands twice in the report after counts once, with its last place.
    Folder sets are compared as sets, in order of their names.
    """
    entries = lambda df, at: df.select(key, F.posexplode("report.sample").alias("place", "s")).select(key, "place", "s.*").where("id is not null")
    last = entries(after, "a").groupBy(key, "id").agg(F.max_by(F.struct("uid", "internal_date"), "place").alias("now"))
    joined = entries(before, "b").join(last, [key, "id"], "left")
    hit = F.col("now").isNotNull()
    counts = joined.groupBy(key).agg(
        F.count_if(hit).alias("n_matched"),
        F.count_if(hit & (F.col("uid") != F.col("now.uid"))).alias("n_uid_changed"),
        F.count_if(hit & (F.col("internal_date") != F.col("now.internal_date"))).alias("n_date_changed"),
        F.count_if(~hit).alias("n_missing"),
    )
    folders = before.select(key, F.col("report.folders").alias("old")).join(after.select(key, F.col("report.folders").alias("new")), key)
    sets = folders.select(key, F.array_sort(F.array_except("new", "old")).alias("new_folders"), F.array_sort(F.array_except("old", "new")).alias("missing_folders"))
    return sets.join(counts, key, "left").na.fill(0, ["n_matched", "n_uid_changed", "n_date_changed", "n_missing"])


def duplicate_entries(entries: DataFrame, document: str, place: str, identities: dict[str, Column]) -> DataFrame:
    """(document, kind, first, again, value): entries of a configuration that repeat an identity of an earlier one, for each kind of identity that must be unique.

    ``identities`` are normalised by the caller (a name in small letters, a server with its user and folder); a null one repeats none. All faults come at once.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value")) for kind, value in identities.items()]))
    told = entries.select(document, place, kinds.alias("i")).select(document, place, "i.*").where("value is not null")
    first = told.groupBy(document, "kind", "value").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return told.join(first, [document, "kind", "value"]).where(F.col(place) > F.col("first")).select(document, "kind", "first", F.col(place).alias("again"), "value")


def out_of_range(entries: DataFrame, keys: list[str], ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """(keys..., field, value): settings that are not whole numbers of their range; one that is absent (null) has its default and is no fault."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value"), F.lit(low).alias("low"), F.lit(high).alias("high")) for f, (low, high) in ranges.items()]))
    told = entries.select(*keys, fields.alias("r")).select(*keys, "r.*")
    return told.where(F.col("value").isNotNull() & (~F.col("value").between(F.col("low"), F.col("high")) | (F.col("value") != F.floor("value")))).select(*keys, "field", "value")
