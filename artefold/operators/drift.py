"""Rescue-column ingestion of JSON files whose schema drifts.

``ingest`` enforces the target schema of a store on every record: values that
fit their target column are typed, everything else (unknown fields, values of
another type) is kept as it came in the rescue column.  ``changes`` compares
what each file holds with the file before it in its stream.  ``replay``
promotes approved fields and casts rescued values into typed columns, leaving
in the rescue column only what no column can take.

Files of a stream are ordered by segments of time, values meet on (file,
record, value), so neither a large stream nor a large file is gathered in one
task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artefold.operators.segments import carry_previous
from artefold.session import written

VARIANTS = "map<string,variant>"
#: JSON types by the name Spark gives a variant.
JSON_TYPES = {"BOOLEAN": "boolean", "BIGINT": "integer", "DECIMAL": "decimal", "DOUBLE": "decimal", "FLOAT": "decimal", "STRING": "string", "ARRAY": "array", "OBJECT": "object"}
SQL_TYPES = {"boolean": "boolean", "integer": "bigint", "decimal": "double", "string": "string", "array": "string", "object": "string"}


@dataclass(frozen=True)
class Store:
    """Target schema of one kind of file: JSON type names by field."""

    name: str
    array: str
    key: str
    root: dict[str, str] = field(default_factory=dict)
    record: dict[str, str] = field(default_factory=dict)


def json_type(value: Column) -> Column:
    """boolean, integer, decimal, string, array or object; null for a JSON null."""
    head = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.element_at(F.create_map(*[F.lit(x) for kv in JSON_TYPES.items() for x in kv]), head)


def distinct_files(files: DataFrame) -> DataFrame:
    """One row per ``file_id``: a readable copy before an unreadable one, then the first ingested.

    Rows without ``file_id`` name no file and are left out.
    """
    rank = F.struct(F.expr("try_parse_json(content)").isNull(), F.col("ingested_at").isNull(), F.col("ingested_at"), F.xxhash64("content"))
    return (
        files.filter("file_id is not null")
        .groupBy("file_id")
        .agg(F.min_by(F.struct("stream_id", "written_at", "content"), rank).alias("f"))
        .select("file_id", "f.*")
    )


def _targets(stores: tuple[Store, ...], part: str) -> Column:
    pairs = [(f"{s.name}.{f}", t) for s in stores for f, t in (s.root if part == "root" else {s.key: "string"} | s.record).items()]
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def ingest(files: DataFrame, stores: tuple[Store, ...]) -> DataFrame:
    """The records of all readable files, typed against their store.

    Columns: ``file_id, stream_id, written_at, store, part`` (``root`` or
    ``record``), ``ordinal, rec_key, typed, rescued``; the last two map field
    names to variants.  A file that is no JSON object gives no rows; a file
    without records gives its root row only.  Elements that are no objects
    are rescued under the name ''.
    """
    read = distinct_files(files).withColumn("doc", F.expr(f"try_variant_get(try_parse_json(content), '$', '{VARIANTS}')")).filter("doc is not null").drop("content")
    store = F.coalesce(*[F.when(F.map_contains_key("doc", s.array), s.name) for s in stores])
    by_store = lambda get: F.element_at(F.create_map(*[F.lit(x) for s in stores for x in (s.name, get(s))]), F.col("store"))
    read = read.withColumn("store", store).withColumn("items", F.expr("try_variant_get(doc[" + "coalesce(" + ", ".join(f"case when map_contains_key(doc, '{s.array}') then '{s.array}' end" for s in stores) + ")], '$', 'array<variant>')"))
    arrays = [s.array for s in stores]
    root = read.select(
        "file_id", "stream_id", "written_at", "store", F.lit("root").alias("part"), F.lit(-1).alias("ordinal"), F.lit("").alias("rec_key"),
        F.map_filter("doc", lambda k, v: ~k.isin(arrays)).alias("doc"),
    )
    records = read.select("file_id", "stream_id", "written_at", "store", by_store(lambda s: s.key).alias("key_field"), F.posexplode("items").alias("ordinal", "item"))
    records = records.withColumn("doc", F.expr(f"coalesce(try_variant_get(item, '$', '{VARIANTS}'), map('', item))"))
    records = records.select(
        "file_id", "stream_id", "written_at", "store", F.lit("record").alias("part"), "ordinal",
        F.expr("try_variant_get(doc[key_field], '$', 'string')").alias("rec_key"), "doc",
    )

    def typed(df: DataFrame, part: str) -> DataFrame:
        targets = _targets(stores, part)
        fits = lambda e: F.coalesce(F.element_at(targets, F.concat_ws(".", F.col("store"), e["key"])) == json_type(e["value"]), F.lit(False))
        some = F.filter(F.map_entries("doc"), lambda e: ~F.is_variant_null(e["value"]))
        judged = F.transform(some, lambda e: F.struct(e.alias("e"), fits(e).alias("fits")))  # each value is looked at once
        side = lambda test: F.map_from_entries(F.transform(F.filter("judged", test), lambda x: x["e"]))
        return df.withColumn("judged", judged).select(
            "file_id", "stream_id", "written_at", "store", "part", "ordinal", "rec_key", side(lambda x: x["fits"]).alias("typed"), side(lambda x: ~x["fits"]).alias("rescued")
        )

    return typed(root, "root").unionByName(typed(records, "record"))


def _named(stores: tuple[Store, ...], name: Column) -> Column:
    """A field as the change list names it."""
    arrays = F.create_map(*[F.lit(x) for s in stores for x in (s.name, s.array + ".")])
    return F.when(F.col("part") == "root", name).otherwise(F.concat(F.element_at(arrays, F.col("store")), name))


def field_types(ingested: DataFrame, stores: tuple[Store, ...]) -> DataFrame:
    """``file_id, stream_id, written_at, part, field, kind, n``: how many values of each type a field has in a file.

    What the target schema took has the type of its column; only rescued
    values are looked at.
    """
    where = ["file_id", "stream_id", "written_at", "store", "part"]
    target = lambda part: F.element_at(_targets(stores, part), F.concat_ws(".", "store", "k"))
    took = F.transform(F.map_keys("typed"), lambda k: F.struct(k.alias("k"), F.lit(None).cast("string").alias("kind")))
    left = F.transform(F.map_entries("rescued"), lambda e: F.struct(e["key"].alias("k"), json_type(e["value"]).alias("kind")))
    rows = ingested.select(*where, F.explode(F.concat(took, left)).alias("f")).select(*where, "f.k", "f.kind").filter("k <> ''")
    rows = rows.groupBy(*where, "k", "kind").agg(F.count("*").alias("n"))
    kind = F.coalesce("kind", F.when(F.col("part") == "root", target("root")).otherwise(target("record")))
    return rows.select("file_id", "stream_id", "written_at", "part", _named(stores, F.col("k")).alias("field"), kind.alias("kind"), "n")


def field_values(ingested: DataFrame, stores: tuple[Store, ...], wanted: DataFrame) -> DataFrame:
    """``file_id, part, field, rec_key, type, text``: the values of the ``wanted`` fields ``(file_id, part, field)``."""
    keep = wanted.groupBy("file_id", "part").agg(F.collect_set("field").alias("__f"))  # names of one file's fields
    rows = ingested.join(keep, ["file_id", "part"])
    held = F.map_filter(F.map_concat("typed", "rescued"), lambda k, v: F.array_contains("__f", _named(stores, k)))
    long = rows.select("file_id", "store", "part", "rec_key", F.explode(held).alias("name", "value"))
    return long.select("file_id", "part", _named(stores, F.col("name")).alias("field"), "rec_key", json_type(F.col("value")).alias("type"), F.to_json("value").alias("text"))


def changes(files: DataFrame, stores: tuple[Store, ...], *, segment: str = "week", least_equal: float = 0.5) -> DataFrame:
    """``file_id, change_type, field_path, new_path``: every schema change of a file.

    A file is compared with the readable file before it in its stream by
    ``written_at`` (then ``file_id``), in record fields with the one before it
    that has records.  A removed and an added field are one renamed field if,
    in the records of both files where both have a value, at least
    ``least_equal`` of the values are equal (all of them for booleans); each
    takes its best partner.  Mixed types count as the most frequent, integers
    beside decimals as decimals.  Broken files, nulls and empty tables give no
    rows.  Types come first, from what fits the target schema and what was
    rescued; values are read only of fields that went or came.
    """
    types = written(field_types(ingest(files, stores), stores), "drift-types")
    kinds = ("boolean", "integer", "decimal", "string", "array", "object")
    present = types.groupBy("file_id", "stream_id", "written_at", "part", "field").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in kinds])
    counts = F.array(*[F.struct((F.when((F.col("decimal") > 0), F.col("decimal") + F.col("integer")).otherwise(0) if k == "decimal" else F.when(F.col("decimal") > 0, 0).otherwise(F.col("integer")) if k == "integer" else F.col(k)).cast("bigint").alias("n"), F.lit(k).alias("k")) for k in kinds])
    present = written(present.select("file_id", "stream_id", "written_at", "part", "field", F.array_max(counts)["k"].alias("type")), "drift-present")

    seen = present.groupBy("file_id", "stream_id", "written_at").agg(F.bool_or(F.col("part") == "record").alias("has_records"))
    before = carry_previous(seen, ["stream_id"], ["written_at", "file_id"], F.date_trunc(segment, "written_at"), {"any_file": F.col("file_id"), "rec_file": F.when(F.col("has_records"), F.col("file_id"))})
    pairs = before.select("file_id", F.explode(F.array(
        F.struct(F.lit("root").alias("part"), F.col("any_file").alias("prev_id")),
        F.struct(F.lit("record").alias("part"), F.when(F.col("has_records"), F.col("rec_file")).alias("prev_id")),
    )).alias("p")).select("file_id", "p.*").filter("prev_id is not null")
    pairs = written(pairs, "drift-pairs")

    now = present.join(pairs, ["file_id", "part"]).select("file_id", "part", "field", F.col("type").alias("now"), F.lit(None).cast("string").alias("was"))
    was = present.withColumnRenamed("file_id", "prev_id").join(pairs, ["prev_id", "part"]).select("file_id", "part", "field", F.lit(None).cast("string").alias("now"), F.col("type").alias("was"))
    differing = now.unionByName(was).groupBy("file_id", "part", "field").agg(F.max("now").alias("now"), F.max("was").alias("was")).filter("not (now <=> was)")
    differing = written(differing, "drift-fields")
    gone, come = differing.filter("now is null"), differing.filter("was is null")
    both_ways = gone.select("file_id", "part").intersect(come.select("file_id", "part"))

    meets = pairs.join(both_ways, ["file_id", "part"])
    went = gone.join(meets, ["file_id", "part"]).select("file_id", "prev_id", "part", "field")
    came = come.join(both_ways, ["file_id", "part"], "left_semi").select("file_id", "part", "field")
    wanted = written(went.select(F.col("prev_id").alias("file_id"), "part", "field").unionByName(came).distinct(), "drift-wanted")
    few = ingest(files.join(wanted.select("file_id").distinct(), "file_id", "left_semi"), stores)
    values = written(field_values(few, stores, wanted), "drift-values")
    old = values.withColumnRenamed("file_id", "prev_id").join(went, ["prev_id", "part", "field"]).select("file_id", "part", "rec_key", F.col("field").alias("old"), "type", "text")
    new = values.join(came, ["file_id", "part", "field"]).select("file_id", "part", "rec_key", F.col("field").alias("new"), "type", "text")
    equal = old.join(new, ["file_id", "part", "rec_key", "type", "text"]).groupBy("file_id", "part", "old", "new").agg(F.countDistinct("rec_key").alias("equal"), F.max("type").alias("type"))
    shared = (
        equal.join(old.select("file_id", "part", "old", "rec_key").distinct(), ["file_id", "part", "old"])
        .join(new.select("file_id", "part", "new", "rec_key").distinct(), ["file_id", "part", "new", "rec_key"])
        .groupBy("file_id", "part", "old", "new").agg(F.first("equal").alias("equal"), F.first("type").alias("type"), F.count("*").alias("both"))
    )
    shared = shared.withColumn("share", F.col("equal") / F.col("both")).filter(F.col("share") >= F.when(F.col("type") == "boolean", 1.0).otherwise(least_equal))
    rank = lambda side, other: F.row_number().over(_by("file_id", side).orderBy(F.desc("share"), F.desc("equal"), other))
    renamed = shared.withColumns({"a": rank("old", "new"), "b": rank("new", "old")}).filter("a = 1 and b = 1").select("file_id", "old", "new")
    renamed = written(renamed, "drift-renamed")

    plain = differing.join(renamed.select("file_id", F.col("old").alias("field"), F.lit("old").alias("side")).unionByName(renamed.select("file_id", F.col("new").alias("field"), F.lit("new").alias("side"))), ["file_id", "field"], "left")
    plain = plain.filter("side is null or (now is not null and was is not null)").select(
        "file_id", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("retyped").alias("change_type"), F.col("field").alias("field_path"), F.lit("").alias("new_path")
    )
    return plain.unionByName(renamed.select("file_id", F.lit("renamed").alias("change_type"), F.col("old").alias("field_path"), F.col("new").alias("new_path")))


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def aliases(found: DataFrame, stores: tuple[Store, ...]) -> dict[str, str]:
    """Today's field name -> target field, by following the renames in ``found``.

    Only distinct pairs of names reach the driver, which are schema metadata.
    A name that came from several gets the one it
    came from most often; a chain that meets no target field gives no alias.
    """
    links = found.filter("change_type = 'renamed'").groupBy("field_path", "new_path").agg(F.count("*").alias("n"))
    rows = links.orderBy("new_path", F.desc("n"), "field_path").collect()
    came_from: dict[str, str] = {}
    for r in rows:
        came_from.setdefault(r.new_path, r.field_path)
    targets = {f for s in stores for f in s.root} | {f"{s.array}.{f}" for s in stores for f in s.record}
    result = {}
    for name in came_from:
        at, path = name, set()
        while at not in targets and at in came_from and at not in path:
            path.add(at)
            at = came_from[at]
        if at in targets and at != name:
            result[name] = at
    return result


def replay(ingested: DataFrame, store: Store, renames: dict[str, str], approved: dict[str, str]) -> DataFrame:
    """One consistent table of the records of ``store``.

    Columns: ``stream_id, file_id, written_at, ordinal``, the key, all record
    fields of the store, the ``approved`` further fields (name -> JSON type)
    and ``rescued``, a JSON object of what is left, null if nothing.  For each
    column the typed value counts, else a rescued one under the same or a
    former name: text is cast, an object that wraps a value with its unit is
    opened, an ISO time becomes Unix seconds in an integer column.  A cast
    that would lose something leaves the value rescued.
    """
    columns = {store.key: "string"} | store.record | approved
    names = {c: [c, *sorted(n.split(".", 1)[1] for n, t in renames.items() if t == f"{store.array}.{c}")] for c in columns}
    records = ingested.filter((F.col("store") == store.name) & (F.col("part") == "record"))
    out, taken = [], []
    for c, kind in columns.items():
        options = []
        for n in names[c]:
            quoted = n.replace("\\", "\\\\").replace("'", "\\'")
            raw = f"coalesce(typed['{quoted}'], rescued['{quoted}'])"
            inner = f"coalesce(try_variant_get({raw}, '$.v', 'variant'), try_variant_get({raw}, '$.value', 'variant'), {raw})" if kind not in ("object", "array") else raw
            text = f"coalesce(try_variant_get({inner}, '$', 'string'), to_json({inner}))"
            got = {
                "string": text,
                "object": text,
                "array": text,
                "boolean": f"try_cast({text} as boolean)",
                "decimal": f"try_cast({text} as double)",
                "integer": f"case when try_cast({text} as decimal(38,9)) = try_cast({text} as bigint) then try_cast({text} as bigint) else unix_timestamp(try_cast(case when {text} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ].*(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$' then {text} when {text} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ]' then concat({text}, 'Z') end as timestamp)) end",
            }[kind]
            options.append(f"case when {raw} is not null then {got} end")
            taken.append((n, f"({got}) is not null"))
        out.append(F.expr("coalesce(" + ", ".join(options) + ")" if len(options) > 1 else options[0]).alias(c))
    used = F.array_compact(F.array(*[F.when(F.expr(ok), F.lit(n)) for n, ok in taken]))
    left = F.map_filter("rescued", lambda k, v: ~F.array_contains(F.col("__used"), k))
    return records.withColumn("__used", used).select("stream_id", "file_id", "written_at", "ordinal", *out, F.when(F.size(left) > 0, F.to_json(left)).alias("rescued"))
