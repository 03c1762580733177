"""One table from JSON files whose fields drift, and the log of every change.

Each file's records are summed up to footer-like metadata (which key, which
JSON type, how often); everything else works on that catalogue: runs of equal
state per source and field are islands found with ``lag``, and their starts and
ends are the changes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.parse_errors import alias_keys, field_key, plain_number, trimmed

MOST_ALIASES = 10_000  # names in an alias table that can become columns


def _json_kind(value: Column) -> Column:
    name = F.schema_of_variant(value)
    return (
        F.when(name.isNull() | (name == "VOID"), F.lit(None).cast("string"))
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name.startswith("ARRAY"), "array")
        .when(name.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def cells(feed: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per record and key: source, file_name, delivered_at, rec_no, field_key, key, value."""
    parsed = feed.select(
        "source",
        "file_name",
        "delivered_at",
        "rec_no",
        F.from_json("record", "map<string,variant>").alias("fields"),
    )
    keys = parsed.select("source", "file_name", "delivered_at", "rec_no", F.explode("fields").alias("key", "value"))
    named = keys.withColumn("field_key", field_key(F.col("key")))
    # The alias table names fields, not rows: a few hundred rows at most; Spark broadcasts it by its size.
    known = named.join(alias_keys(aliases), "field_key", "left")
    return known.withColumn("field_name", F.coalesce("canonical", "field_key")).drop("canonical")


def catalogue(cell_rows: DataFrame) -> DataFrame:
    """Footer metadata: source, file_name, field_name, key_name, json_type (null if only nulls), fraction.

    ``fraction``: whether any number of the field isn't whole.
    """
    counted = (
        cell_rows.select(
            "source", "file_name", "field_name", "key", _json_kind(F.col("value")).alias("json_type"),
            F.schema_of_variant("value").rlike("DOUBLE|FLOAT|DECIMAL").alias("fraction"),
        )
        .groupBy("source", "file_name", "field_name", "key", "json_type")
        .agg(F.count("*").alias("n"), F.max("fraction").alias("fraction"))
    )
    per_type = counted.groupBy("source", "file_name", "field_name", "json_type").agg(
        F.sum("n").alias("n_type"), F.max(F.struct("n", "key")).alias("top_key"), F.max("fraction").alias("fraction")
    )
    typed = F.col("json_type").isNotNull()
    return per_type.groupBy("source", "file_name", "field_name").agg(
        F.max_by("top_key", "top_key")["key"].alias("key_name"),
        F.max(F.when(typed, F.struct("n_type", "json_type")))["json_type"].alias("json_type"),
        F.coalesce(F.max("fraction"), F.lit(False)).alias("fraction"),
    )


def file_order(feed: DataFrame) -> DataFrame:
    """source, file_name, seq: a source's files by delivery, then name."""
    files = feed.groupBy("source", "file_name").agg(F.min("delivered_at").alias("delivered_at"))
    order = Window.partitionBy("source").orderBy(F.col("delivered_at").asc_nulls_first(), "file_name")
    return files.select("source", "file_name", F.row_number().over(order).alias("seq"))


@dataclass
class Drift:
    changes: DataFrame
    lifespans: DataFrame
    tables: Callable[[], tuple[DataFrame, DataFrame]]

    @cached_property
    def _tables(self) -> tuple[DataFrame, DataFrame]:
        return self.tables()  # the fields' types are read first, which only these two need

    @property
    def records(self) -> DataFrame:
        return self._tables[0]

    @property
    def failed_casts(self) -> DataFrame:
        return self._tables[1]


def schema_drift(feed: DataFrame, aliases: DataFrame) -> Drift:
    """Read drifting JSON records into one table and report each change.

    ``feed`` needs source, file_name, delivered_at, rec_no and record (one JSON
    object per row); other columns are ignored.

    * changes: source, file_name, field_name, change_kind. Each file is compared
      with the preceding one of its source; ``file_name`` is the later file.
    * lifespans: source, field_name, key_name, json_type, first_file, last_file:
      the islands of files in which a field kept its key and type.
    * records: source, file_name, rec_no, one column per canonical field, and
      ``rest``: the values of keys without alias, and of second keys of a field.
    * failed_casts: source, file_name, rec_no, field_name, value: what a record
      holds but its column's type can't.

    The columns' types come from the catalogue: a field is of the JSON type that
    it has in most files (of equally many, the first by name); whole numbers alone
    may be codes and stay text. A record
    that isn't a JSON object has no fields, but its file counts. Keys without
    alias are fields under their normalised name in changes. The more frequent key (type) stands for a field's key
    (type) in a file, of equally frequent ones the last by name. A field with
    only null values has no type and is never retyped. Null sources form one
    source. Empty tables give empty results.
    """
    feed = feed.withColumn("source", F.struct("source"))  # a struct is never null, so null sources meet in joins
    cell_rows = cells(feed, aliases)
    files = file_order(feed)
    meta = catalogue(cell_rows).join(files, ["source", "file_name"])
    last = files.groupBy("source").agg(F.max("seq").alias("last_seq"))

    by_field = Window.partitionBy("source", "field_name").orderBy("seq")
    state = meta.select(
        "source",
        "field_name",
        "file_name",
        "seq",
        "key_name",
        "json_type",
        F.lag("seq").over(by_field).alias("prev_seq"),
        F.lag("key_name").over(by_field).alias("prev_key"),
        F.lag("json_type").over(by_field).alias("prev_type"),
        F.lead("seq").over(by_field).alias("next_seq"),
    ).join(last, "source")
    adjacent = F.col("prev_seq") == F.col("seq") - 1
    starts = (F.col("seq") > 1) & F.coalesce(~adjacent, F.lit(True))
    ends = (F.col("seq") < F.col("last_seq")) & F.coalesce(F.col("next_seq") != F.col("seq") + 1, F.lit(True))
    events = state.select(
        "source",
        "field_name",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.col("seq").alias("at"), F.when(starts, "added").alias("change_kind")),
                    F.struct((F.col("seq") + 1).alias("at"), F.when(ends, "removed").alias("change_kind")),
                    F.struct(
                        F.col("seq").alias("at"),
                        F.when(adjacent & (F.col("prev_key") != F.col("key_name")), "renamed").alias("change_kind"),
                    ),
                    F.struct(
                        F.col("seq").alias("at"),
                        F.when(adjacent & (F.col("prev_type") != F.col("json_type")), "retyped").alias("change_kind"),
                    ),
                ),
                lambda e: e["change_kind"].isNotNull(),
            )
        ).alias("e"),
    )
    changes = (
        events.select("source", F.col("e.at").alias("seq"), "field_name", F.col("e.change_kind").alias("change_kind"))
        .join(files, ["source", "seq"])
        .select("source", "file_name", "field_name", "change_kind")
    )

    new_run = F.coalesce(
        ~adjacent | (F.col("prev_key") != F.col("key_name")) | ~F.col("prev_type").eqNullSafe(F.col("json_type")),
        F.lit(True),
    )
    runs = state.withColumn("run", F.sum(new_run.cast("int")).over(by_field))
    lifespans = runs.groupBy("source", "field_name", "run", "key_name", "json_type").agg(
        F.min_by("file_name", "seq").alias("first_file"),
        F.max_by("file_name", "seq").alias("last_file"),
        F.count("*").alias("n_files"),
    )
    plain = F.col("source.source").alias("source")
    return Drift(
        changes.withColumn("source", plain),
        lifespans.drop("run").withColumn("source", plain),
        lambda: consistent_records(feed.withColumn("source", plain), aliases, meta),
    )


def field_types(meta: DataFrame) -> dict[str, str]:
    """The SQL type of each field, by the JSON type that most files give it; at most MOST_ALIASES rows are collected.

    Whole numbers alone may be codes, so only a field with a fraction somewhere becomes a number.
    """
    typed = meta.where("json_type is not null").groupBy("field_name", "json_type").agg(
        F.count("*").alias("n"), F.max("fraction").alias("fraction")
    )
    rank = F.struct((-F.col("n")).alias("n"), "json_type", "fraction")
    chosen = typed.groupBy("field_name").agg(F.min(rank).alias("r")).limit(MOST_ALIASES)
    return {
        r["field_name"]: "double" if r["json_type"] == "number" and r["fraction"] else "boolean" if r["json_type"] == "boolean" else "string"
        for r in chosen.select("field_name", "r.json_type", "r.fraction").collect()
    }


def consistent_records(feed: DataFrame, aliases: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All records, as delivered, in one schema generated from the alias table and the catalogue; and what it can't hold.

    Raises if the alias table has more than MOST_ALIASES names.
    """
    known = alias_keys(aliases).limit(MOST_ALIASES + 1).collect()
    if len(known) > MOST_ALIASES:
        raise ValueError(f"an alias table of more than {MOST_ALIASES} names can't become columns")
    names = F.lit(None).cast("map<string,string>")
    if known:
        names = F.create_map(*[F.lit(x) for r in known for x in (r["field_key"], r["canonical"])])
    canonical = sorted({r["canonical"] for r in known})
    types = field_types(meta.join(aliases.select(F.col("canonical").alias("field_name")).distinct(), "field_name"))
    fields = F.from_json("record", "map<string,variant>")
    entries = F.transform(
        F.map_entries(fields),
        lambda e: F.struct(
            F.try_element_at(names, field_key(e["key"])).alias("name"),
            e["key"].alias("key"),
            F.try_variant_get(e["value"], "$", "string").alias("text"),
        ),
    )
    # of several keys of one field the first that isn't null stands in its column
    ordered = F.array_sort(entries)
    parsed = feed.select("source", "file_name", "rec_no", ordered.alias("entries"))

    def chosen(name: str) -> Column:
        own = F.filter("entries", lambda e: (e["name"] == name) & e["text"].isNotNull())
        return F.try_element_at(own, F.lit(1))

    picked = parsed.select("source", "file_name", "rec_no", "entries", *[chosen(n).alias(f"cell_{n}") for n in canonical])

    def typed(name: str) -> Column:
        text = F.col(f"`cell_{name}`")["text"]
        if types.get(name) == "double":
            return plain_number(text).try_cast("double")
        return trimmed(text).try_cast(types.get(name, "string"))

    taken = F.array(*[F.col(f"`cell_{n}`")["key"] for n in canonical]).cast("array<string>")
    left = F.filter("entries", lambda e: ~F.array_contains(F.array_compact(taken), e["key"]) & e["text"].isNotNull())
    rest = F.map_from_entries(F.transform(left, lambda e: F.struct(e["key"], e["text"])))
    records = picked.select("source", "file_name", "rec_no", *[typed(n).alias(n) for n in canonical], rest.alias("rest"))
    lost = [
        F.when(F.col(f"`cell_{n}`").isNotNull() & (trimmed(F.col(f"`cell_{n}`")["text"]) != "") & typed(n).isNull(),
               F.struct(F.lit(n).alias("field_name"), F.col(f"`cell_{n}`")["text"].alias("value")))
        for n in canonical if types.get(n, "string") != "string"
    ]
    nothing = F.array().cast("array<struct<field_name:string,value:string>>")
    failed = picked.select("source", "file_name", "rec_no", F.explode(F.array_compact(F.array(*lost)) if lost else nothing).alias("x"))
    return records, failed.select("source", "file_name", "rec_no", "x.*")
