"""From a raw model response to a validated label, natively: VARIANT functions parse, arrays validate.

Only text that strict JSON rejects goes through Python (repair), and only names that match no category exactly are
compared with all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.functions.text import fuzzy_names, repair_json, strip
from tagmill.schemas import API_ERROR, PARSE_ERROR, PROCESSING_ERROR, UNCLASSIFIED, UNMATCHED

RESULT = ("label", "confidence", "confidence_detail", "is_low_confidence", "parse_status")
NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf(inity)?|nan)$"
#: Python's names of JSON types, by those that schema_of_variant gives.
TYPE_NAMES = (("BIGINT", "int"), ("DECIMAL", "float"), ("DOUBLE", "float"), ("FLOAT", "float"), ("STRING", "str"), ("BOOLEAN", "bool"), ("VOID", "NoneType"))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _python_type(kind: Column) -> Column:
    out = F.when(kind.startswith("OBJECT"), "dict").when(kind.startswith("ARRAY"), "list")
    for name, python in TYPE_NAMES:
        out = out.when(kind.startswith(name), python)
    return out.otherwise(F.lower(kind))


def _text(v: Column) -> Column:
    """As Python's str() shows it; objects and arrays as JSON."""
    kind = _kind(v)
    return F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(_get(v, "$", "string"))).otherwise(_get(v, "$", "string"))


def _falsy(v: Column) -> Column:
    kind = _kind(v)
    number = F.when(kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE"), _get(v, "$", "double"))
    return (
        v.isNull()
        | (kind == "VOID")
        | (kind.startswith("OBJECT") & (F.size(_get(v, "$", "map<string,variant>")) == 0))
        | (kind.startswith("ARRAY") & (F.size(_get(v, "$", "array<variant>")) == 0))
        | ((kind == "STRING") & (_get(v, "$", "string") == ""))
        | ((kind == "BOOLEAN") & ~_get(v, "$", "boolean"))
        | F.coalesce(number == 0, F.lit(False))
    )


def _confidence(v: Column) -> Column:
    """As a double: truncated, 0 where it is no number; infinity stays."""
    kind = _kind(v)
    text = strip(_get(v, "$", "string"))
    number = (
        F.when(v.isNull() | (kind == "VOID"), F.lit(0.0))
        .when(kind == "BOOLEAN", F.when(_get(v, "$", "boolean"), 1.0).otherwise(0.0))
        .when(kind == "STRING", F.when(F.lower(text).rlike(NUMBER), text.try_cast("double")))
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(0.0))
        .otherwise(_get(v, "$", "double"))
    )
    plain = F.nanvl(F.coalesce(number, F.lit(0.0)), F.lit(0.0))
    return F.when(F.abs(plain) == float("inf"), plain).otherwise(F.signum(plain) * F.floor(F.abs(plain)))


def quoted(text: Column) -> Column:
    """As a JSON string; null stays null."""
    made = F.to_json(F.struct(text.alias("s")))
    return F.when(text.isNotNull(), F.substring(made, F.lit(6), F.length(made) - 6))


def parse(df: DataFrame, categories: list[str], threshold: int, raw: str = "raw_response") -> DataFrame:
    """df with the columns of RESULT, in place of any that it has by these names."""
    cats = F.array(*map(F.lit, categories)).cast("array<string>")
    # the row travels as one struct, so that no column of it can clash with a step's
    step = df.select(F.struct(*(df[c] for c in df.columns if c not in RESULT)).alias("_row"), df[raw].alias("_raw"))
    raw = "_raw"
    mended = repair_json()(F.when(F.try_parse_json(raw).isNull(), F.col(raw)))
    step = step.withColumn("_mended", mended).withColumn("_v", F.coalesce(F.try_parse_json(raw), F.try_parse_json("_mended")))
    step = step.withColumn("_kind", _kind(F.col("_v")))
    is_object, is_array = F.col("_kind").startswith("OBJECT"), F.col("_kind").startswith("ARRAY")
    step = step.withColumn("_labels", F.when(is_object, _get(F.col("_v"), "$.labels", "variant")).when(is_array, F.col("_v")))
    step = step.withColumns(
        {
            "_none": _falsy(F.col("_labels")),
            "_error": is_object & F.map_contains_key(_get(F.col("_v"), "$", "map<string,variant>"), F.lit("error")),
            "_lkind": _kind(F.col("_labels")),
        }
    )
    items = F.coalesce(F.when(F.col("_lkind").startswith("ARRAY"), _get(F.col("_labels"), "$", "array<variant>")), F.array().cast("array<variant>"))

    def item(v: Column, i: Column) -> Column:
        field = lambda name: _get(v, f"$.{name}", "variant")
        return F.when(
            _kind(v).startswith("OBJECT"),
            F.struct(
                i.alias("pos"),
                F.coalesce(_text(field("name")), F.lit("")).alias("name"),
                _confidence(field("confidence")).alias("conf"),
                F.coalesce(_text(field("reason")), F.lit("")).alias("reason"),
            ),
        )

    step = step.withColumn("_items", F.filter(F.transform(items, item), lambda x: x.isNotNull() & (strip(x["name"]) != "")))
    step = step.withColumn("_items", F.transform("_items", lambda x: F.struct(x.pos, x["name"].alias("name"), x.conf, x.reason, F.when(F.array_contains(cats, x["name"]), x["name"]).when(F.array_contains(cats, strip(x["name"])), strip(x["name"])).alias("exact"))))
    step = step.withColumn("_close", fuzzy_names(categories)(F.transform("_items", lambda x: F.when(x.exact.isNull(), x["name"]))))

    def validated(x: Column, i: Column) -> Column:
        close = F.get(F.col("_close"), i)
        return F.struct(
            (-x.conf).alias("rank"),
            x.pos.alias("pos"),
            F.coalesce(x.exact, close, x["name"]).alias("name"),
            x.conf.alias("conf"),
            x.reason.alias("reason"),
            x.exact.isNotNull().alias("exact_match"),
            F.when(x.exact.isNull(), x["name"]).alias("original_name"),
        )

    step = step.withColumn("_fixed", F.transform("_items", validated))
    step = step.withColumn("_sorted", F.array_sort("_fixed"))
    enough = F.filter("_sorted", lambda x: x.conf >= threshold)
    step = step.withColumn("_low", F.size(enough) == 0).withColumn("_taken", F.when(F.size(enough) > 0, enough).otherwise(F.slice("_sorted", 1, 1)))
    step = step.withColumn("_names", F.array_distinct(F.transform("_taken", lambda x: F.when(F.array_contains(cats, x["name"]), x["name"]).otherwise(F.concat(F.lit(UNMATCHED), x["name"])))))
    changed = F.filter("_fixed", lambda x: ~x.exact_match & (x["name"] != x.original_name))
    fixed = F.array_join(F.transform(changed, lambda x: F.concat(x.original_name, F.lit(" → "), x["name"])), "; ")
    strange = F.array_join(F.filter("_names", lambda x: x.startswith(UNMATCHED)), "; ")
    notes = F.array_compact(F.array(F.when(F.size(changed) > 0, F.concat(F.lit("fuzzy_corrected: "), fixed)), F.when(strange != "", F.concat(F.lit("unmatched: "), strange))))
    status = F.when(F.size(notes) == 0, F.lit("ok")).otherwise(F.array_join(notes, "; "))
    fields = lambda x: (("name", quoted(x["name"])), ("confidence", x.conf.try_cast("int").cast("string")), ("reason", quoted(x.reason)), ("exact_match", x.exact_match.cast("string")), ("original_name", quoted(x.original_name)))
    entry = lambda x: F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{k}": '), F.coalesce(v, F.lit("null"))) for k, v in fields(x))), F.lit("}"))
    detail = F.concat(F.lit("["), F.array_join(F.transform("_sorted", entry), ", "), F.lit("]"))
    plain = F.coalesce(F.col(raw), F.lit(""))
    whole = F.to_json("_v")
    # what Python can't iterate over, and numbers it can't make whole, are exceptions of the item
    odd = F.concat(F.lit("'"), _python_type(F.col("_lkind")), F.lit("' object is not iterable"))
    cannot = F.col("_lkind").startswith("BIGINT") | F.col("_lkind").startswith("D") | (F.col("_lkind") == "BOOLEAN")
    endless = F.exists("_items", lambda x: F.abs(x.conf) == float("inf"))
    overflow = F.lit("cannot convert float infinity to integer")

    def outcome(label, conf, text, low, why) -> Column:
        return F.struct(label.alias("label"), conf.cast("int").alias("confidence"), text.alias("confidence_detail"), low.alias("is_low_confidence"), why.alias("parse_status"))

    yes, zero, lit = F.lit("yes"), F.lit(0), F.lit
    made = (
        F.when(F.col("_v").isNull(), outcome(lit(PARSE_ERROR), zero, plain, yes, lit("json_parse_failed")))
        .when(F.col("_error") & F.col("_none"), outcome(lit(API_ERROR), zero, whole, yes, F.concat(lit("api_error: "), F.coalesce(_text(_get(F.col("_v"), "$.error", "variant")), lit("None")))))
        .when(~is_object & ~is_array, outcome(lit(PARSE_ERROR), zero, plain, yes, F.concat(lit("unexpected_type: "), _python_type(F.col("_kind")))))
        .when(F.col("_none"), outcome(lit(UNCLASSIFIED), zero, whole, yes, lit("no_labels")))
        .when(cannot, outcome(lit(PROCESSING_ERROR), zero, odd, yes, F.concat(lit("exception: "), odd)))
        .when(endless, outcome(lit(PROCESSING_ERROR), zero, overflow, yes, F.concat(lit("exception: "), overflow)))
        .when(F.size("_sorted") == 0, outcome(lit(UNCLASSIFIED), zero, whole, yes, lit("no_valid_labels_after_validation")))
        .otherwise(outcome(F.array_join("_names", "|"), F.get(F.col("_sorted"), lit(0)).conf.try_cast("int"), detail, F.when(F.col("_low"), "yes").otherwise("no"), status))
    )
    return step.withColumn("_made", made).select("_row.*", "_made.*")
