"""Licence scans: canonical digest lookup, in DataFrame operations only.

A text is brought to a canonical form (case, punctuation, copyright lines, equivalent spellings), and its SHA-256 is
looked up among the digests of known licences, which the same expressions make. Entire texts are compared. Known licences
are a constant of this package, or a table that the caller gives, which is broadcast only up to a counted size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .license_texts import TEXTS

#: Lines that only name a holder (not a wrapped line that goes on with `copyright notice`); Java and RE2 read these alike.
COPYRIGHT = r"(^|\n)[ \t#*/;-]*(copyright[ \t]*(\(c\)|©|[0-9<\[{]|by )|\(c\)|©|all rights reserved)[^\n]*"
NOT_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
SPELLINGS = (("licenc", "licens"), (" sub licens", " sublicens"), (" non infring", " noninfring"), ("whilst", "while"), ("behaviour", "behavior"), ("favour", "favor"), ("colour", "color"), ("authoris", "authoriz"), ("organis", "organiz"), ("recognis", "recogniz"), ("merchantib", "merchantab"), (" https ", " http "), (" per cent ", " percent "), (" acknowledgement", " acknowledgment"), (" judgement", " judgment"))


def canonical(text: Column) -> Column:
    """Canonical form; that of null and of texts without words is empty."""
    c = F.regexp_replace(common.ascii_lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "\n")
    c = F.concat(F.lit(" "), F.regexp_replace(c, NOT_WORD, " "), F.lit(" "))
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(c)


def known(spark: SparkSession, licences: DataFrame | None = None) -> DataFrame:
    """license_id and canonical_sha256 of licences (license_id, license_text), else of TEXTS.

    Of licences with one canonical form the least id counts; those without words are left out, as no text matches them.
    """
    if licences is not None:
        x = licences.select("license_id", canonical(F.col("license_text")).alias("c")).where("c <> ''")
        return x.groupBy(F.sha2("c", 256).alias("canonical_sha256")).agg(F.min("license_id").alias("license_id"))
    rows = spark.createDataFrame(sorted(TEXTS.items()), "license_id string, license_text string")
    return rows.select("license_id", F.sha2(canonical(F.col("license_text")), 256).alias("canonical_sha256"))


def scan(docs: DataFrame, text_col: str = "text", licences: DataFrame | None = None) -> DataFrame:
    """All columns of docs and canonical_sha256, license_id (null: no known licence; columns of these names are replaced).

    Null and empty texts have the digest of the empty form and never match. Each of repeated rows gets its own answer. Texts of
    any length are brought to canonical form whole, in some copies of the text at a time.
    """
    rest = [c for c in docs.columns if c not in ("canonical_sha256", "license_id")]
    digest = docs.select(*rest, F.sha2(canonical(F.col(text_col)), 256).alias("canonical_sha256"))
    digests = known(docs.sparkSession, licences)
    digests = F.broadcast(digests) if licences is None else common.sized_broadcast(common.materialize(digests, "licences"))
    return digest.join(digests, "canonical_sha256", "left").select(*rest, "canonical_sha256", "license_id")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "canonical_sha256", "license_id")


def license_scan_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan over whole licences: as they are, in capitals under a copyright line, and with words added (no licence)."""
    x = spark.createDataFrame(sorted(TEXTS.items()), "name string, t string")
    dress = F.array(F.col("t"), F.concat(F.lit("Copyright (c) 2020 Jane Roe\n\n"), F.translate("t", common.UPPER.lower(), common.UPPER)), F.concat(F.col("t"), F.lit(" and more")))
    return scan(x.select("name", F.posexplode(dress).alias("dress", "text"))).select("name", "dress", "canonical_sha256", "license_id")


def canonical_sql(column: str) -> str:
    c = f"regexp_replace({common.lower_sql(column)}, '{COPYRIGHT}', chr(10), 'g')"
    c = f"' ' || regexp_replace({c}, '{NOT_WORD}', ' ', 'g') || ' '"
    for a, b in SPELLINGS:
        c = f"replace({c}, '{a}', '{b}')"
    return f"trim({c})"


def _known_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEXTS.items()))
    return f"""known(license_id, license_text) AS (VALUES {rows}),
k AS (SELECT license_id, sha256({canonical_sql("license_text")}) AS canonical_sha256 FROM known)"""


def sql() -> str:
    return f"""
WITH {_known_sql()},
d AS (SELECT doc_id, sha256({canonical_sql("text")}) AS canonical_sha256 FROM documents)
SELECT doc_id, canonical_sha256, license_id FROM d LEFT JOIN k USING (canonical_sha256)
"""


def known_sql() -> str:
    return f"""
WITH {_known_sql()},
x AS (SELECT license_id AS name, 0 AS dress, license_text AS text FROM known UNION ALL SELECT license_id, 1, 'Copyright (c) 2020 Jane Roe' || chr(10) || chr(10) || translate(license_text, '{common.UPPER.lower()}', '{common.UPPER}') FROM known
 UNION ALL SELECT license_id, 2, license_text || ' and more' FROM known),
d AS (SELECT name, dress, sha256({canonical_sql("text")}) AS canonical_sha256 FROM x)
SELECT name, dress, canonical_sha256, license_id FROM d LEFT JOIN k USING (canonical_sha256)
"""
