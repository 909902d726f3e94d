"""Records checked against a declared schema, and records put together from paths; both over VARIANT, in the JVM.

A schema is plain data: a `Rows` or `Record` of fields with kinds and bounds, and rules across fields. `errors` compiles it into one Column: the
list of (path, message) of what is wrong, in the order of the schema, list members by their number (`sizes.0.price_amount`). Unknown keys are let through. A missing field is
an error only where it is required; a JSON null only where the field may not be null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import bound


@dataclass(frozen=True)
class Text:
    least: int = 0
    pattern: str | None = None
    one_of: tuple[str, ...] = ()
    url: bool = False
    required: bool = False
    nullable: bool = False


@dataclass(frozen=True)
class Number:
    whole: bool = False
    least: float | None = None
    required: bool = False
    nullable: bool = False


@dataclass(frozen=True)
class Flag:
    required: bool = False
    nullable: bool = False


@dataclass(frozen=True)
class Record:
    fields: dict[str, object] = field(default_factory=dict)
    #: (message, rule over the record's variant): true where all is well.
    rules: tuple[tuple[str, Callable[[Column], Column]], ...] = ()
    required: bool = False
    nullable: bool = False


@dataclass(frozen=True)
class Rows:
    of: Record = field(default_factory=Record)
    required: bool = False
    nullable: bool = False


# The product record of an import.
HEX = "^#[0-9a-fA-F]{6}$"
_MAYBE = Text(nullable=True)
_WHOLE = Number(whole=True, nullable=True)
PRODUCT = Record(
    {
        "source_url": Text(url=True),
        "category_slug": Text(least=1, required=True),
        "brand_name": Text(least=1),
        "brand_slug": Text(least=1),
        "name": Text(least=1, required=True),
        "slug": Text(least=1),
        "description": _MAYBE,
        "scent_summary": _MAYBE,
        "release_year": _WHOLE,
        "wax_type": _MAYBE,
        "vessel_material": _MAYBE,
        "is_discontinued": Flag(),
        "sizes": Rows(Record({"size_value": Number(nullable=True), "size_unit": _MAYBE, "size_grams": _WHOLE, "price_amount": _WHOLE, "price_currency": _MAYBE, "burn_time_hours": _WHOLE, "sku": _MAYBE, "availability": _MAYBE, "source_url": _MAYBE, "is_primary": Flag()})),
        "images": Rows(
            Record(
                {"source_url": Text(url=True), "data_base64": Text(least=1), "content_type": Text(), "position": Number(whole=True, least=0, required=True), "is_primary": Flag(required=True)},
                (("Image must include source_url or data_base64", lambda v: (F.coalesce(F.try_variant_get(v, "$.source_url", "string"), F.lit("")) != "") | (F.coalesce(F.try_variant_get(v, "$.data_base64", "string"), F.lit("")) != "")),),
            )
        ),
        "notes": Rows(Record({"note_slug": Text(least=1, required=True), "name": Text(least=1, required=True), "pyramid_stage": Text(one_of=("top", "middle", "base", "general", "unknown")), "color": Text(pattern=HEX), "color_gradient": Text()})),
        "accords": Rows(Record({"accord_slug": Text(least=1, required=True), "name": Text(least=1, required=True), "color": Text(pattern=HEX), "color_gradient": Text()})),
    }
)
#: Keys of a record that an import leaves behind.
PRIVATE = ("_provenance", "_timing", "_llm_error")
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*:(//)?[^\s/?#]+\S*$"


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)


def _faults(kind, v: Column, path: Column) -> Column:
    """array<struct<path, message>> of a value that is there; v is named often, so it must be a column or bound."""
    one = lambda bad, message: F.when(bad, F.array(F.struct(path.alias("path"), F.lit(message).alias("message"))))
    none = F.array().cast("array<struct<path: string, message: string>>")
    told = _kind(v)
    if isinstance(kind, Text):
        text = F.try_variant_get(v, "$", "string")
        found = one(told != "STRING", "expected text")
        if kind.least:
            found = F.coalesce(found, one(F.char_length(text) < kind.least, f"shorter than {kind.least}"))
        if kind.pattern:
            found = F.coalesce(found, one(~text.rlike(kind.pattern), "not of the pattern"))
        if kind.one_of:
            found = F.coalesce(found, one(~text.isin(*kind.one_of), "not one of " + ", ".join(kind.one_of)))
        if kind.url:
            found = F.coalesce(found, one(~text.rlike(_URL), "not a url"))
    elif isinstance(kind, Number):
        number = F.try_variant_get(v, "$", "double")
        found = one(~told.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT"), "expected a number")
        if kind.whole:
            found = F.coalesce(found, one(number != F.floor(number), "not whole"))
        if kind.least is not None:
            found = F.coalesce(found, one(number < kind.least, f"below {kind.least:g}"))
    elif isinstance(kind, Flag):
        found = one(told != "BOOLEAN", "expected true or false")
    elif isinstance(kind, Rows):
        items = F.try_variant_get(v, "$", "array<variant>")
        each = F.transform(items, lambda item, i: _faults(kind.of, item, F.concat(path, F.lit("."), i.cast("string"))))
        found = F.coalesce(one(told != "ARRAY", "expected a list"), F.flatten(each))
    else:
        parts = [_field(name, k, v, path) for name, k in kind.fields.items()]
        fits = F.concat(*parts) if parts else none
        broken = [F.coalesce(one(~F.coalesce(rule(v), F.lit(False)), message), none) for message, rule in kind.rules]
        # rules across fields are asked where the fields are right
        whole = F.get(F.transform(F.array(fits), lambda f: F.when(F.size(f) > 0, f).otherwise(F.concat(*broken))), F.lit(0)) if broken else fits
        found = F.coalesce(one(told != "OBJECT", "expected an object"), whole)
    return F.coalesce(found, none)


def _field(name: str, kind, holder: Column, path: Column) -> Column:
    here = F.when(path == "", F.lit(name)).otherwise(F.concat(path, F.lit(f".{name}")))
    return bound(F.try_variant_get(holder, f"$['{name}']", "variant"), lambda value: _judged(kind, value, here))


def _judged(kind, value: Column, here: Column) -> Column:
    none = F.array().cast("array<struct<path: string, message: string>>")
    missing = F.array(F.struct(here.alias("path"), F.lit("required").alias("message"))) if kind.required else none
    if kind.nullable:
        return F.when(value.isNull(), missing).when(F.is_variant_null(value), none).otherwise(_faults(kind, value, here))
    return F.when(value.isNull(), missing).otherwise(_faults(kind, value, here))


def errors(record: Column, schema: Record = PRODUCT) -> Column:
    """What is wrong with a record (variant) as array<struct<path, message>>; a null variant is no JSON."""
    no_json = F.array(F.struct(F.lit("").alias("path"), F.lit("not JSON").alias("message")))
    # bound: the record may be text that is parsed here, once instead of for every field
    return bound(record, lambda v: F.when(v.isNull(), no_json).otherwise(_faults(schema, v, F.lit(""))))


def public(record: Column) -> Column:
    """A record without its private keys."""
    fields = F.try_variant_get(record, "$", "map<string,variant>")
    return F.when(fields.isNotNull(), F.to_variant_object(F.map_filter(fields, lambda k, _: ~k.isin(*PRIVATE)))).otherwise(record)


def import_files(files: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Uploaded files (file, text), each a JSON list of products, as three tables.

    products: file, place, record (without private keys); invalid: file, place, reason; files: file, brand_slug, brand_name, products, images, invalid,
    error (of a file that can't be taken: no JSON, no list, empty, no brand).
    """
    parsed = files.select("file", F.try_parse_json(text_col).alias("v"))
    listed = F.when(_kind(F.col("v")) == "ARRAY", F.try_variant_get("v", "$", "array<variant>"))
    parsed = parsed.select("file", "v", listed.alias("entries"))
    rows = parsed.select("file", F.posexplode("entries").alias("place", "entry"))
    text = lambda f: F.when(_kind(F.try_variant_get("entry", f"$.{f}", "variant")) == "STRING", F.nullif(F.try_variant_get("entry", f"$.{f}", "string"), F.lit("")))
    reason = F.when(~_kind(F.col("entry")).isin("OBJECT", "ARRAY") | F.col("entry").isNull(), "Not an object").when(text("name").isNull(), "Missing product name").when(text("category_slug").isNull(), "Missing category_slug")
    judged = rows.select("file", "place", "entry", reason.alias("reason"), text("brand_slug").alias("brand_slug"), text("brand_name").alias("brand_name"))
    images = F.coalesce(F.size(F.try_variant_get("entry", "$.images", "array<variant>")), F.lit(0))
    ok = F.col("reason").isNull()
    first = lambda c: F.min_by(F.when(ok, F.col(c)), F.when(ok & F.col(c).isNotNull(), F.col("place")))
    counted = judged.groupBy("file").agg(first("brand_slug").alias("brand_slug"), first("brand_name").alias("brand_name"), F.count_if(ok).alias("products"), F.sum(F.when(ok, images).otherwise(0)).alias("images"), F.count_if(~ok).alias("invalid"))
    told = parsed.select("file", F.when(F.col("v").isNull(), "Invalid JSON file").when(F.col("entries").isNull(), "Expected a JSON array of products").when(F.size("entries") == 0, "File contains no products").alias("error"))
    told = told.join(counted, "file", "left").select("file", "brand_slug", F.coalesce("brand_name", "brand_slug").alias("brand_name"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("products", "images", "invalid")], F.coalesce("error", F.when(F.col("brand_slug").isNull(), "Could not detect brand_slug from import file")).alias("error"))
    taken = told.filter("error is null").select("file")
    products = judged.filter(ok).join(taken, "file", "left_semi").select("file", "place", public(F.col("entry")).alias("record"))
    return products, judged.filter(~ok).select("file", "place", "reason"), told


def assembled(rows: DataFrame, depth: int | None = None) -> DataFrame:
    """key, record (variant) of rows (key, path, value, place): values at dotted paths, put together from the deepest level up.

    `a[].b` is `a.b`. Writes count in the order of place, like assignments: the last to a path stays, a value over a path drops what was
    below it before, and a deeper path drops a value above it. value is a variant (not an object: write its fields). Null and blank paths are left out. A level
    is one grouping by key and the path above, so no record is held by a task but in its last step. `depth` is the most parts that a path has, where that is known (a
    deeper path is an error); else the rows are asked once for it. The rows of a key are dealt once: all steps after that go by the key and more.
    """
    parts = F.filter(F.split(F.replace("path", F.lit("[]"), F.lit(".")), r"\."), lambda p: p != "")
    given = rows.select("key", parts.alias("parts"), "value", "place").filter(F.size("parts") > 0)
    if depth is None:
        depth = given.agg(F.max(F.size("parts"))).first()[0] or 0
    else:
        too_deep = F.raise_error(F.concat(F.lit(f"a path of more than {depth} parts: "), F.array_join("parts", "."))).cast("array<string>")
        given = given.withColumn("parts", F.when(F.size("parts") <= depth, F.col("parts")).otherwise(too_deep))
    last = given.repartition("key").groupBy("key", "parts").agg(F.max_by("value", "place").alias("value"), F.max("place").alias("place"))
    # a path meets those above and below it at its beginnings: itself, and each shorter one
    heads = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.slice("parts", 1, n))
    met = last.select("key", "parts", "place", "value", F.explode(heads).alias("head"))
    own, at = F.size("head") == F.size("parts"), Window.partitionBy("key", "head")
    met = met.select("key", "parts", F.when(own, F.col("value")).alias("value"), own.alias("own"), "place", F.max(F.when(own, F.col("place"))).over(at).alias("held"), F.max(F.when(~own, F.col("place"))).over(at).alias("deeper"))
    lost = F.when(F.col("own"), F.col("deeper") >= F.col("place")).otherwise(F.col("held") > F.col("place"))
    alive = met.groupBy("key", "parts").agg(F.max_by("value", "own").alias("value"), F.bool_or(F.coalesce(lost, F.lit(False))).alias("lost")).filter("not lost").select("key", "parts", "value")
    # one chain of groupings: paths of fewer parts pass a level as they are (no path that is left stands above another)
    for deep in range(depth, 0, -1):
        here, up = F.size("parts") == deep, F.slice("parts", 1, deep - 1)
        entries = F.collect_list(F.struct(F.when(here, F.element_at("parts", -1)).alias("name"), F.col("value")))
        alive = alive.groupBy("key", F.when(here, up).otherwise(F.col("parts")).alias("parts")).agg(entries.alias("entries"))
        below = F.get("entries", F.lit(0))
        alive = alive.select("key", "parts", F.when(below["name"].isNotNull(), F.to_variant_object(F.map_from_entries(F.when(below["name"].isNotNull(), F.col("entries"))))).otherwise(below["value"]).alias("value"))
    return alive.select("key", F.col("value").alias("record"))
