"""The document model as a value: JSON envelope, validation, style presets, output settings."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA, VERSION = "vellum/document", 1
PRESET = "vellum/style-preset"
# What a style can mean, and the kinds of failure.
MAPPINGS = ("body", "title", "subtitle", "author", "heading1", "heading2", "heading3", "heading4", "heading5", "heading6", "caption", "blockquote", "code", "footnote", "ignore")
ERRORS = ("cancelled", "invalid-input", "unsupported-format", "encrypted-document", "resource-limit", "invalid-model", "conversion-failed")
RECORDS, LISTS = ("metadata", "assets", "equations", "notes"), ("blocks", "styles", "warnings")


def to_json(value) -> str:
    """JSON with bytes as `{"$binary": "uint8-array", "bytes": [..]}`; numbers must be finite."""

    def coded(x):
        if isinstance(x, (bytes, bytearray)):
            return {"$binary": "uint8-array", "bytes": list(x)}
        if isinstance(x, float) and not math.isfinite(x):
            raise ValueError("a number is not finite")
        if isinstance(x, dict):
            return {k: coded(v) for k, v in x.items() if v is not None}
        return [coded(v) for v in x] if isinstance(x, (list, tuple)) else x

    return json.dumps(coded(value), ensure_ascii=False, separators=(",", ":"))


def from_json(text: str):
    def decoded(x: dict):
        if x.get("$binary") != "uint8-array":
            return x
        if not isinstance(x.get("bytes"), list) or any(not isinstance(b, int) or isinstance(b, bool) or not 0 <= b <= 255 for b in x["bytes"]):
            raise ValueError("bytes are out of range")
        return bytes(x["bytes"])

    return json.loads(text, object_hook=decoded)


def issues(model) -> list[tuple[str, str]]:
    """(path, code) of what is wrong with a model, in the order of the rules."""
    if not isinstance(model, dict):
        return [("$", "not-object")]
    found = [("$.schema", "schema")] * (model.get("schema") != SCHEMA) + [("$.version", "version")] * (model.get("version") != VERSION)
    found += [(f"$.{k}", "not-record") for k in RECORDS if not isinstance(model.get(k), dict)]
    found += [(f"$.{k}", "not-list") for k in LISTS if not isinstance(model.get(k), list)]
    assets = model.get("assets")
    found += [(f"$.assets.{k}.data", "not-binary") for k, a in (assets.items() if isinstance(assets, dict) else ()) if not isinstance(a, dict) or not isinstance(a.get("data"), bytes)]
    return found


def model_issues(text: Column) -> Column:
    """Issues of models in JSON, as an array of (path, code), in the order of the rules; text that is no JSON object is none.

    The same rules as issues(), on the text as a variant: nothing goes to Python.
    """
    v = F.try_parse_json(text)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    issue = lambda test, path, code: F.when(F.coalesce(test, F.lit(True)), F.struct(F.lit(path).alias("path"), F.lit(code).alias("code")))
    is_list = lambda path: kind(path).startswith("ARRAY")
    is_record = lambda path: kind(path).startswith("OBJECT")
    rules = [
        issue(F.try_variant_get(v, "$.schema", "string") != SCHEMA, "$.schema", "schema"),
        issue(F.try_variant_get(v, "$.version", "string") != str(VERSION), "$.version", "version"),
        *[issue(~is_record(f"$.{k}"), f"$.{k}", "not-record") for k in RECORDS],
        *[issue(~is_list(f"$.{k}"), f"$.{k}", "not-list") for k in LISTS],
    ]
    held = F.map_entries(F.coalesce(F.try_variant_get(v, "$.assets", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    binary = lambda a: (F.try_variant_get(a, "$.data.$binary", "string") == "uint8-array") & F.coalesce(F.forall(F.try_variant_get(a, "$.data.bytes", "array<int>"), lambda b: b.between(0, 255)), F.lit(False))
    assets = F.transform(F.filter(held, lambda e: ~F.coalesce(binary(e["value"]), F.lit(False))), lambda e: F.struct(F.concat(F.lit("$.assets."), e["key"], F.lit(".data")).alias("path"), F.lit("not-binary").alias("code")))
    whole = F.array(F.struct(F.lit("$").alias("path"), F.lit("not-object").alias("code")))
    return F.when(F.coalesce(is_record("$"), F.lit(False)), F.concat(F.array_compact(F.array(*rules)), assets)).otherwise(whole)


_ASSETS = "array<struct<asset_id:string,media_type:string,filename:string,data:binary>>"


def model_rows(packages: DataFrame, *kept: str) -> DataFrame:
    """(doc_id, json): the model of each package that could be read as an envelope, for any sink of text: `write.text`, JSON lines.
    Columns `kept` come after them.

    Bytes are `{"$binary": "uint8-array", "bytes": [..]}`.
    """
    octets = lambda data: F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda k: F.conv(F.hex(F.substring(data, k, 1)), 16, 10).cast("int"))
    binary = lambda data: F.struct(F.lit("uint8-array").alias("$binary"), F.when(F.octet_length(data) > 0, octets(data)).otherwise(F.array().cast("array<int>")).alias("bytes"))
    assets = F.map_from_entries(F.transform("assets", lambda a: F.struct(a["asset_id"], F.struct(a["media_type"].alias("mediaType"), a["filename"].alias("filename"), binary(a["data"]).alias("data")))))
    part = lambda path: F.get_json_object("model", path)
    lists = {"styles": F.to_json("styles"), "warnings": F.to_json("warnings"), "assets": F.to_json(assets), "metadata": F.lit("{}")} | {k: part(f"$.{k}") for k in ("blocks", "notes", "equations")}
    pieces = [F.concat(F.lit(f'"{k}":'), F.coalesce(c, F.lit("{}"))) for k, c in lists.items()]
    text = F.concat(F.lit(f'{{"schema":"{SCHEMA}","version":{VERSION},'), F.concat_ws(",", *pieces), F.lit("}"))
    return packages.filter("error IS NULL").select("doc_id", text.alias("json"), *kept)


def read_models(rows: DataFrame, *kept: str) -> DataFrame:
    """(doc_id, model, assets, issues) of envelopes (doc_id, json) as model_rows() makes them; with issues, nothing else. Columns
    `kept` come after them."""
    v = F.try_parse_json("json")
    held = F.map_entries(F.coalesce(F.try_variant_get(v, "$.assets", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    data = lambda a: F.unhex(F.array_join(F.transform(F.try_variant_get(a, "$.data.bytes", "array<int>"), lambda b: F.lpad(F.hex(b), 2, "0")), ""))
    assets = F.transform(held, lambda e: F.struct(e["key"].alias("asset_id"), F.try_variant_get(e["value"], "$.mediaType", "string").alias("media_type"), F.try_variant_get(e["value"], "$.filename", "string").alias("filename"), data(e["value"]).alias("data")))
    found = rows.withColumn("issues", model_issues(F.col("json")))
    good = F.size("issues") == 0
    return found.select("doc_id", F.when(good, F.col("json")).alias("model"), F.when(good, assets.cast(_ASSETS)).alias("assets"), "issues", *kept)


def preset_json(mappings: Column) -> Column:
    """A style preset of a map of style to meaning."""
    return F.to_json(F.struct(F.lit(PRESET).alias("schema"), F.lit(VERSION).alias("version"), mappings.alias("mappings")))


def preset_mappings(text: Column) -> Column:
    """The map of a preset; null if it is of another schema or version, has a forbidden key or an unknown meaning."""
    p = F.from_json(text, "schema string, version int, mappings map<string,string>")
    known = F.forall(F.map_entries(p["mappings"]), lambda e: e["value"].isin(*MAPPINGS) & ~e["key"].isin("__proto__", "constructor", "prototype"))
    return F.when((p["schema"] == PRESET) & (p["version"] == VERSION) & known, p["mappings"])


#: What a conversion does where its settings say nothing.
DEFAULTS = {"format": "html", "html_mode": "standalone", "markdown_mode": "single", "formula": "mathml", "assets": "embedded", "cover": True}


def output_settings(format: Column, html_mode: Column, markdown_mode: Column) -> Column:
    """(format, mode) that settings choose, with DEFAULTS where they are null."""
    of = F.coalesce(format, F.lit(DEFAULTS["format"]))
    mode = F.when(of == "html", F.coalesce(html_mode, F.lit(DEFAULTS["html_mode"]))).when(of == "markdown", F.coalesce(markdown_mode, F.lit(DEFAULTS["markdown_mode"]))).otherwise("epub")
    return F.struct(of.alias("format"), mode.alias("mode"))


def output_extension(format: Column, mode: Column) -> Column:
    return F.when(format == "epub", ".epub").when(mode == "zip", ".zip").when(format == "html", ".html").otherwise(".md")


def media_type(format: Column, mode: Column) -> Column:
    return F.when(mode == "zip", "application/zip").when(format == "epub", "application/epub+zip").when(format == "html", "text/html;charset=utf-8").otherwise("text/markdown;charset=utf-8")
