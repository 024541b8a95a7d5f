"""Files: annotation folders, JSON lines, manifests, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_IDS = "evidence_span_ids:array<string>"
#: The annotation record.
ANNOTATION = (
    "schema_version string, annotation_status string, annotator_id string, notice_id bigint, version_id bigint, source struct<source_id:string,name:string>, title string, raw_text string, "
    "publication_time string, observed_at string, url string, content_hash string, evidence_spans array<struct<evidence_id:string,field:string,text:string,start_char:int,end_char:int>>, "
    "obligations array<struct<obligation_id:string,"
    f"audience:struct<raw_text:string,applies_to_all_students:boolean,faculties:array<string>,majors:array<string>,cohorts:array<string>,programs:array<string>,{_IDS}>,"
    f"action:struct<action_type:string,text:string,{_IDS}>,deadline:struct<raw_text:string,normalized:string,precision:string,timezone:string,{_IDS}>,"
    f"amount:struct<raw_text:string,value_vnd:bigint,currency:string,{_IDS}>,location:struct<text:string,{_IDS}>,"
    f"required_documents:array<struct<text:string,{_IDS}>>,exceptions:array<struct<text:string,{_IDS}>>>>, "
    f"temporal_relations array<struct<relation_type:string,target_notice_id:bigint,target_version_id:bigint,changed_fields:array<string>,{_IDS},note:string>>, notes string"
)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotations of a folder of JSON files, one each; malformed files are skipped, the last by name of a version counts."""
    rows = spark.read.schema(ANNOTATION + ", _corrupt string").option("multiLine", True).option(
        "columnNameOfCorruptRecord", "_corrupt"
    ).json(path)
    rows = rows.withColumn("__file", F.input_file_name()).filter("_corrupt is null and notice_id is not null and version_id is not null")
    rest = [c for c in rows.columns if c not in ("notice_id", "version_id", "_corrupt")]
    last = rows.groupBy("notice_id", "version_id").agg(F.max_by(F.struct(*rest), "__file").alias("r"))
    return last.select("notice_id", "version_id", "r.*").drop("__file")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by an explicit schema; lines that do not parse are left out."""
    return spark.read.schema(schema + ", _corrupt string").option(
        "columnNameOfCorruptRecord", "_corrupt"
    ).json(path).filter("_corrupt is null").drop("_corrupt")


def write_jsonl(df: DataFrame, path: str) -> DataFrame:
    """Write JSON lines with nulls and return the manifest: one row with the number of rows and an order-free digest."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return fingerprint(df)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: number of rows, and a digest that depends on all values but not on the order of rows.

    A row's values as text, nested ones as JSON, are hashed by MD5, and the
    first 60 bits of all hashes are summed.
    """
    text = [F.to_json(c) if t.startswith(("array", "struct", "map")) else F.col(c).cast("string") for c, t in df.dtypes]
    row = F.md5(F.array_join(F.array(*[F.coalesce(x, F.lit("\\N")) for x in text]), "\u001f"))
    number = F.conv(F.left(row, F.lit(15)), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("digest"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files of a folder."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
