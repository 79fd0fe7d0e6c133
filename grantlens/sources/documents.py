"""Nested JSON documents in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.provenance import canonical_json
from ..functions.scalar import slugify
from . import schemas


def split_evidence(evidence: Column) -> Column:
    """Evidence rows as JSON text -> separate text and number fields, a number also with its digits as written.

    Parsed as a string or a variant, 1e23 would come back as 9.999999999999999E22 and 1.50 as 1.5.
    """
    def read(e: Column) -> Column:
        return F.struct(F.from_json(e, schemas.EVIDENCE_ROW).alias("row"), F.regexp_extract(e, schemas.EVIDENCE_VALUE, 1).alias("value"))

    def row(read: Column) -> Column:
        e, value = read["row"], read["value"]
        digits = F.when(value.rlike("^[-0-9tf]"), value)
        return F.struct(
            e["source"].alias("source"),
            e["rowId"].alias("row_id"),
            e["field"].alias("field"),
            F.when(value == '"', e["value"]).alias("value_str"),
            digits.try_cast("decimal(38,10)").alias("value_num"),
            digits.alias("value_raw"),
            e["asOf"].alias("as_of"),
        )

    return F.transform(F.transform(evidence, read), row)


def _typed_token(token: Column) -> Column:
    return token.withField("evidence", split_evidence(token["evidence"]))


def _raw_token() -> str:
    return schemas.token(schemas.RAW_EVIDENCE)


def read_findings(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """JSON array(s) of finding cards, each file in one task; one_per_line reads bulk files, which are split."""
    schema = schemas.as_schema(schemas.finding_card(_raw_token()))
    raw = spark.read.schema(schema).option("multiLine", not one_per_line).json(path)
    return raw.withColumn("proofToken", _typed_token(F.col("proofToken")))


def read_briefs(spark: SparkSession, folder: str, one_per_line: bool = False) -> DataFrame:
    """One brief per file, named by its slug; one_per_line reads bulk files of many briefs."""
    schema = schemas.as_schema(schemas.brief(_raw_token()))
    raw = spark.read.schema(schema).option("multiLine", not one_per_line).option("pathGlobFilter", "*.json").json(folder)
    slug = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return raw.withColumn("slug", slug).withColumn("proofToken", _typed_token(F.col("proofToken")))


def read_register(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    return spark.read.schema(schemas.as_schema(schemas.REGISTER)).option("multiLine", not one_per_line).json(path)


def read_citations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.as_schema(schemas.CITATION)).json(path)


def export_tokens(tokens: DataFrame, issuer: str, verify_base: str, note: str, token: str = "proofToken") -> DataFrame:
    """(proof_id, file_name, body): the token as JSON with an envelope that says where to verify it."""
    t = F.col(token)
    envelope = F.struct(
        F.lit(issuer).alias("issuer"),
        t["issuedAt"].alias("issuedAt"),
        t["version"].alias("methodologyVersion"),
        F.concat(F.lit(verify_base.rstrip("/") + "/"), t["proofId"]).alias("verifyAt"),
        F.lit(note).alias("note"),
    )
    return tokens.select(
        t["proofId"].alias("proof_id"),
        F.concat(F.lit("ppm-"), t["proofId"], F.lit(".json")).alias("file_name"),
        canonical_json(t.withField("_verifiability", envelope)).alias("body"),
    )


def write_exports(exports: DataFrame, path: str) -> None:
    exports.select("body").write.mode("overwrite").text(path)


def write_keyed_dossiers(dossiers: DataFrame, path: str, cached_at: str, key: str = "seed") -> None:
    """One JSON document per key, in a folder named by the key's slug."""
    stamped = dossiers.withColumn("cachedAt", F.lit(cached_at)).withColumn("slug", slugify(key))
    stamped.write.mode("overwrite").partitionBy("slug").option("ignoreNullFields", False).json(path)


def write_dossiers(dossiers: DataFrame, path: str, cached_at: str) -> None:
    """One JSON document per line with the time it was cached; that time is a parameter so runs repeat."""
    stamped = dossiers.withColumn("cachedAt", F.lit(cached_at))
    stamped.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_dossiers(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
