"""Scalar functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import NS, XSD


def xsd_for(sql_type: Column) -> Column:
    """Datatype of an SQL type name; null for binary types. The first rule that fits holds."""
    t = F.upper(sql_type)
    out = F.when(t.contains("INT"), "integer").when(t.rlike("REAL|FLOA|DOUB|NUMERIC|DECIMAL"), "decimal").when(t.contains("BOOL"), "boolean")
    out = out.when(t.rlike("DATETIME|TIMESTAMP"), "dateTime").when(t.contains("DATE"), "date").when(t.contains("BLOB"), None).otherwise("string")
    return F.when(out.isNotNull(), F.concat(F.lit(XSD), out))


def scalar_for(datatype: Column) -> Column:
    d = F.substring_index(datatype, "#", -1)
    return F.when(d.isin("integer", "int", "long", "nonNegativeInteger", "positiveInteger"), "Int").when(d.isin("decimal", "double", "float"), "Float").when(d == "boolean", "Boolean").otherwise("String")


def datatype_kind(datatype: Column) -> Column:
    d = F.substring_index(datatype, "#", -1)
    return F.when(d.isin("integer", "int", "long", "decimal", "double", "float"), "number").when(d == "boolean", "boolean").when(d == "date", "date").when(d == "dateTime", "datetime").otherwise("text")


def cast_scalar(value: Column, scalar: str) -> Column:
    return value.try_cast({"Int": "long", "Float": "double", "Boolean": "boolean"}.get(scalar, "string"))


def sane(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9_-]", "_")


def slug(x: Column) -> Column:
    dashed = F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-|-$", ""), F.lit("")), F.lit("field"))


def humanize(x: Column) -> Column:
    """Spaces for _ and -, a space at camel humps, each word capitalised but short all-capital words."""
    spaced = F.regexp_replace(F.regexp_replace(x, "[_-]+", " "), "([a-z])([A-Z])", "$1 $2")
    words = F.filter(F.split(F.trim(spaced), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when((F.length(w) <= 3) & (w == F.upper(w)), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))), " ")


def local_name(iri: Column) -> Column:
    return F.try_url_decode(F.element_at(F.filter(F.split(iri, "[#/]"), lambda w: w != ""), -1))


def display_name(label: Column, iri: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(label), F.lit("")), humanize(local_name(iri)))


def class_iri(table: Column) -> Column:
    return F.concat(F.lit(NS), table)


def prop_iri(table: Column, column: Column) -> Column:
    return F.concat(F.lit(NS), table, F.lit("_"), column)


def encode_key(x: Column, composite: bool = False) -> Column:
    """Percent-encoding of a key part; null as empty. In composite keys the joining _ is encoded too."""
    e = F.url_encode(F.coalesce(x.cast("string"), F.lit("")))
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return F.replace(e, F.lit("_"), F.lit("%5F")) if composite else e


def decode_key(x: Column) -> Column:
    return F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))


def mint(base: str, keys: list[Column]) -> Column:
    """Subject IRI: base, then the encoded keys joined by _."""
    return F.concat(F.lit(base), F.concat_ws("_", *[encode_key(k, len(keys) > 1) for k in keys]))


def esc_literal(x: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def serialize_term(o: Column, kind: Column, datatype: Column, lang: Column) -> Column:
    quoted = F.concat(F.lit('"'), esc_literal(o), F.lit('"'))
    literal = F.when(lang.isNotNull(), F.concat(quoted, F.lit("@"), lang)).when(datatype.isNotNull() & (datatype != XSD + "string"), F.concat(quoted, F.lit("^^<"), datatype, F.lit(">"))).otherwise(quoted)
    return F.when(kind == "iri", F.concat(F.lit("<"), o, F.lit(">"))).when(kind == "bnode", o).otherwise(literal)


def valid_iri(x: Column) -> Column:
    return ~x.rlike(r'[\x00-\x20<>"{}|^`\\]') & (F.length(x) > 0)


def infer_term(raw: Column) -> list[Column]:
    """(o, o_kind, datatype) of what a user typed."""
    x = F.trim(raw)
    inner = F.regexp_extract(x, "^<(.*)>$", 1)
    iri = x.rlike("^<[^<>\\s]+>$") | x.rlike("^(https?://|urn:)\\S+$")
    number = F.when(x.rlike(r"^[+-]?\d+$"), "integer").when(x.rlike(r"^[+-]?\d*\.\d+$"), "decimal").when(x.isin("true", "false"), "boolean").when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date").otherwise("string")
    return [F.when(iri & (inner != ""), inner).otherwise(x).alias("o"), F.when(iri, "iri").otherwise("literal").alias("o_kind"), F.when(~iri, F.concat(F.lit(XSD), number)).alias("datatype")]


def shrink_iri(iri: Column, prefixes: dict[str, str]) -> Column:
    """prefix:local by the longest namespace whose rest is a name or nothing; else the IRI as it is. prefixes: prefix -> namespace."""
    out = iri
    for prefix, ns in sorted(prefixes.items(), key=lambda e: (len(e[1]), e[0])):  # the longest is asked first
        local = F.substr(iri, F.lit(len(ns) + 1))
        out = F.when(iri.startswith(ns) & (local.rlike(r"^[A-Za-z_][\w.-]*$") | (local == "")), F.concat(F.lit(prefix + ":"), local)).otherwise(out)
    return out


def expand_curie(x: Column, prefixes: dict[str, str]) -> Column:
    """The IRI of prefix:local where the prefix is known; whatever holds // or has another prefix passes as it is."""
    prefix = F.regexp_extract(x, r"^([A-Za-z_][\w-]*):", 1)
    out = x
    for p, ns in prefixes.items():
        out = F.when((prefix == p) & ~x.contains("//"), F.concat(F.lit(ns), F.substr(x, F.lit(len(p) + 2)))).otherwise(out)
    return out


def tokens(x: Column) -> Column:
    """Search tokens: lower case, runs of letters and digits."""
    return F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def tokenize_name(x: Column) -> Column:
    """Words of a column or table name."""
    humps = F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(humps), "[^a-z0-9]+"), lambda w: w != "")


def norm_header(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]", "")


@F.pandas_udf(T.StringType())
def strip_marks(x: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; Spark has no normalisation function."""
    return x.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.category(c).startswith("M")))


def norm_label(x: Column, ascii_only: bool = False) -> Column:
    """Crosswalk key: marks stripped, lower case, other characters as single spaces."""
    plain = x if ascii_only else strip_marks(x)
    return F.trim(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}]+", " "))


def system_class(iri: Column) -> Column:
    from ..model import OWL, RDF, RDFS, RR, SH, SKOS

    return F.when(iri.isNull(), False).otherwise(sum((iri.startswith(n).cast("int") for n in (RDF, RDFS, OWL, SKOS, SH, RR)), F.lit(0)) > 0)


def extract_params(text: Column) -> Column:
    """Names of {{name}} in order of first use."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{\{\s*(\w+)\s*\}\}"), F.lit(1)))


def apply_params(text: Column, params: dict[str, str]) -> Column:
    """{{name}} replaced; names without a value stay."""
    for k, v in params.items():
        if v not in (None, ""):
            text = F.regexp_replace(text, F.lit(r"\{\{\s*" + k + r"\s*\}\}"), F.lit(v.replace("\\", "\\\\").replace("$", "\\$")))
    return text
