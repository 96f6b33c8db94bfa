"""Checks and repairs of structured answers, which come as JSON texts: all as expressions, errors as arrays of texts with paths."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import normalize, normalize_title
from .evidence import near

#: The fields of an analysis of a paper and of a synthesis of a domain, and what some of them may be.
PAPER_TEXTS = ("research_problem", "background_gap", "study_object", "method_pipeline", "evidence_type", "source_basis", "confidence")
PAPER_LISTS = ("data_or_materials", "methods", "core_findings", "limitations", "open_questions", "reusable_resources", "supporting_text")
DOMAIN_TEXTS = ("domain", "one_sentence_summary", "confidence")
DOMAIN_LISTS = ("core_problem_system", "method_system", "mature_findings", "controversies_or_uncertainties", "research_gaps", "candidate_research_questions")
DOMAIN_RECORDS = {
    "problem_method_matrix": {"problem": "string", "methods": "array", "representative_papers": "array"},
    "recommended_reading_order": {"title": "string", "reason": "string"},
    "evidence_index": {"claim": "string", "papers": "array"},
}
BASES = ("metadata_only", "abstract_only", "pdf_text")
LEVELS = ("low", "medium", "high")

#: How a JSON value's type is called in an error, by how the type of its variant begins.
KINDS = (("OBJECT", "dict"), ("ARRAY", "list"), ("STRING", "str"), ("BIGINT", "int"), ("BOOLEAN", "bool"), ("DECIMAL", "float"), ("DOUBLE", "float"), ("FLOAT", "float"))
#: Which of them fit a type of a schema.
FITS = {"object": ("dict",), "array": ("list",), "string": ("str",), "number": ("int", "float"), "integer": ("int",), "boolean": ("bool",), "null": ("NoneType",)}


def record(fields: dict[str, str | dict]) -> dict:
    """A schema of an object that has just these fields, each a type's name ("array": of strings) or a schema."""

    def of(kind: str | dict) -> dict:
        return kind if isinstance(kind, dict) else {"type": kind} | ({"items": {"type": "string"}} if kind == "array" else {})

    return {"type": "object", "additionalProperties": False, "properties": {k: of(v) for k, v in fields.items()}, "required": list(fields)}


def _choice(values: Sequence[str]) -> dict:
    return {"type": "string", "enum": list(values)}


PAPER_SCHEMA = record({k: "string" for k in PAPER_TEXTS} | {k: "array" for k in PAPER_LISTS} | {"source_basis": _choice(BASES), "confidence": _choice(LEVELS)})
DOMAIN_SCHEMA = record({k: "string" for k in DOMAIN_TEXTS} | {k: "array" for k in DOMAIN_LISTS} | {k: {"type": "array", "items": record(v)} for k, v in DOMAIN_RECORDS.items()} | {"confidence": _choice(LEVELS)})


def parsed(answer: Column) -> Column:
    """A JSON text as a variant; null if it is none."""
    return F.try_parse_json(F.coalesce(answer, F.lit("")))


def kind_of(value: Column) -> Column:
    """The type's name as in errors; what is absent or null is NoneType."""
    begins = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    return reduce(lambda out, k: F.when(F.startswith(begins, F.lit(k[0])), k[1]).otherwise(out), reversed(KINDS), F.lit("NoneType"))


def _none() -> Column:
    return F.array().cast("array<string>")


def schema_errors(value: Column, schema: dict, path: Column | str = "$") -> Column:
    """Errors of a variant against a schema of the keywords type, enum, properties, required, additionalProperties and items.

    A wrong type is the only error of its value. A Boolean is no number. Unexpected fields come in the order of their names."""
    path = F.lit(path) if isinstance(path, str) else path
    said = lambda text, *more: F.concat(path, F.lit(text), *more)
    kind, want = kind_of(value), schema.get("type")
    found: list[Column] = []
    if "enum" in schema:
        text = F.coalesce(F.try_variant_get(value, "$", "string"), F.lit("None"))
        shown = F.when(kind == "str", F.concat(F.lit("'"), text, F.lit("'"))).otherwise(text)
        known = (kind == "str") & text.isin(*schema["enum"])
        found.append(F.when(known, _none()).otherwise(F.array(said(f": expected one of {schema['enum']}, got ", shown))))
    if want == "object":
        fields = {k: F.try_variant_get(value, f"$['{k}']", "variant") for k in {*schema.get("properties", {}), *schema.get("required", [])}}
        absent = F.array(*[F.when(fields[k].isNull(), said(f".{k}: missing required field")) for k in schema.get("required", [])])
        found.append(F.filter(absent.cast("array<string>"), lambda e: e.isNotNull()))
        if schema.get("additionalProperties") is False:
            names = F.coalesce(F.array_sort(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))), _none())
            found.append(F.transform(F.filter(names, lambda k: ~k.isin(*schema.get("properties", {}))), lambda k: said(".", k, F.lit(": unexpected field"))))
        for k, sub in schema.get("properties", {}).items():
            found.append(F.when(fields[k].isNull(), _none()).otherwise(schema_errors(fields[k], sub, said(f".{k}"))))
    if want == "array" and schema.get("items"):
        items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
        found.append(F.flatten(F.transform(items, lambda x, i: schema_errors(x, schema["items"], said("[", i.cast("string"), F.lit("]"))))))
    out = F.concat(*found) if found else _none()
    if want not in FITS:
        return out
    return F.when(kind.isin(*FITS[want]), out).otherwise(F.array(said(f": expected {want}, got ", kind)))


def blank_errors(value: Column, keys: Sequence[str]) -> Column:
    """An error for each of the fields that isn't a text with something in it."""

    def bad(k: str) -> Column:
        x = F.try_variant_get(value, f"$['{k}']", "variant")
        return (kind_of(x) != "str") | (F.trim(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit(""))) == "")

    marks = F.array(*[F.when(bad(k), F.lit(f"$.{k}: must be a non-empty string")) for k in keys])
    return F.filter(marks.cast("array<string>"), lambda e: e.isNotNull())


def repaired(value: Column, texts: Sequence[str], lists: Sequence[str], choices: dict[str, tuple[Sequence[str], Column | str]], defaults: dict[str, Column | str] | None = None) -> Column:
    """A struct of the fields: absent texts get their default (else ""), what should be a list and isn't becomes an empty one, and
    a text outside its choices its fall-back. Items of lists stay as JSON texts if they aren't strings."""
    defaults = defaults or {}
    out = []
    for k in texts:
        x = F.coalesce(F.try_variant_get(value, f"$['{k}']", "string"), _lit(defaults.get(k, "")))
        if k in choices:
            x = F.when(x.isin(*choices[k][0]), x).otherwise(_lit(choices[k][1]))
        out.append(x.alias(k))
    for k in lists:
        items = F.coalesce(F.try_variant_get(value, f"$['{k}']", "array<variant>"), F.array().cast("array<variant>"))
        out.append(F.transform(items, lambda x: F.try_variant_get(x, "$", "string")).alias(k))
    return F.struct(*out)


def _lit(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def repaired_analysis(answer: Column, basis: Column | str) -> Column:
    return repaired(parsed(answer), PAPER_TEXTS, PAPER_LISTS, {"source_basis": (BASES, basis), "confidence": (LEVELS, "low")}, {"source_basis": basis, "confidence": "low"})


def repaired_synthesis(answer: Column, domain: Column | str) -> Column:
    return repaired(parsed(answer), DOMAIN_TEXTS, (*DOMAIN_LISTS, *DOMAIN_RECORDS), {"confidence": (LEVELS, "low")}, {"domain": domain, "confidence": "low"})


def is_empty_synthesis(answer: Column) -> Column:
    """Whether none of a synthesis's lists holds anything."""
    sizes = [F.size(F.coalesce(F.try_variant_get(parsed(answer), f"$['{k}']", "array<variant>"), F.array().cast("array<variant>"))) for k in (*DOMAIN_LISTS, *DOMAIN_RECORDS)]
    return reduce(Column.__add__, sizes) == 0


def selected_text(chunks: Column) -> Column:
    """The texts of the selected chunks (array of structs with text), one after another."""
    return F.array_join(F.transform(F.coalesce(chunks, F.array().cast("array<struct<text:string>>")), lambda c: F.coalesce(c["text"], F.lit(""))), "\n")


def unsupported(snippets: Column, basis: Column, least: float = 0.92) -> Column:
    """Of an array of snippets those that the basis neither holds nor nearly holds, trimmed; blank ones don't count. What is
    contained is settled by an expression; only the rest goes to Python."""

    @F.pandas_udf("array<string>")
    def far(left: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([[s["shown"] for s in some if not near(s["plain"], t, least)] if some is not None and len(some) else [] for some, t in zip(left, text)])

    plain = normalize(basis)
    rows = F.transform(F.filter(F.transform(F.coalesce(snippets, _none()), lambda s: F.trim(s)), lambda s: s != ""), lambda s: F.struct(s.alias("shown"), normalize(s).alias("plain")))
    left = F.filter(rows, lambda s: ~F.contains(plain, s["plain"]))
    return F.when(plain == "", F.transform(left, lambda s: s["shown"])).when(F.size(left) == 0, _none()).otherwise(far(left, F.when(F.size(left) > 0, plain)))  # a function is called for all rows: others send no text


def checked_analyses(rows: DataFrame) -> DataFrame:
    """(answer, abstract, extracted_text, selected_chunks, ...) gets errors and unsupported_supporting_text: a snippet has to be
    found in abstract, text or chunks."""
    value = parsed(F.col("answer"))
    snippets = F.transform(F.coalesce(F.try_variant_get(value, "$.supporting_text", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.try_variant_get(x, "$", "string"))
    basis = F.concat_ws("\n", F.coalesce("abstract", F.lit("")), F.coalesce("extracted_text", F.lit("")), selected_text(F.col("selected_chunks")))
    return rows.withColumn("errors", F.concat(schema_errors(value, PAPER_SCHEMA), blank_errors(value, ["research_problem", "source_basis", "confidence"]))).withColumn("unsupported_supporting_text", unsupported(snippets, basis))


def cited_papers(syntheses: DataFrame) -> DataFrame:
    """(domain, answer) -> (domain, item, pos, claim, paper): the papers that a synthesis's claims name."""
    items = F.try_variant_get(parsed(F.col("answer")), "$.evidence_index", "array<variant>")
    rows = syntheses.select("domain", F.posexplode(items).alias("item", "e"))
    papers = F.try_variant_get("e", "$.papers", "array<variant>")
    rows = rows.select("domain", "item", F.coalesce(F.try_variant_get("e", "$.claim", "string"), F.lit("")).alias("claim"), F.posexplode(papers).alias("pos", "p"))
    return rows.select("domain", "item", "pos", F.trim("claim").alias("claim"), F.try_variant_get("p", "$", "string").alias("paper"))


def unknown_citations(syntheses: DataFrame, known: DataFrame) -> DataFrame:
    """The cited papers of each domain that are neither the id nor the title of one of its analysed papers (domain, paper_id,
    title), after normalisation."""
    keys = known.select("domain", F.explode(F.array("paper_id", "title")).alias("k")).select("domain", normalize_title(F.col("k")).alias("_k")).where("_k <> ''").distinct()
    return cited_papers(syntheses).withColumn("_k", normalize_title(F.col("paper"))).join(keys, ["domain", "_k"], "left_anti").drop("_k")


def checked_syntheses(syntheses: DataFrame, known: DataFrame) -> DataFrame:
    """(domain, answer) gets errors, the last of them its unknown citations, and unknown_evidence_papers."""
    unknown = unknown_citations(syntheses, known).groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("item", "pos", "paper"))), lambda x: x["paper"]).alias("unknown_evidence_papers"))
    value = parsed(F.col("answer"))
    rows = syntheses.join(unknown, "domain", "left").withColumn("unknown_evidence_papers", F.coalesce("unknown_evidence_papers", _none()))
    told = F.transform("unknown_evidence_papers", lambda t: F.concat(F.lit("$.evidence_index: unknown paper title '"), t, F.lit("'")))
    return rows.withColumn("errors", F.concat(schema_errors(value, DOMAIN_SCHEMA), blank_errors(value, ["domain", "one_sentence_summary", "confidence"]), told))
