"""The synthetic tables read as evidence: events and orders are records, customers subjects, lineitems attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The instants at which rules over events and over orders are evaluated.
EVENTS_AT, ORDERS_AT = "2024-01-31T00:00:00Z", "2001-12-31T00:00:00Z"
_NO_REFS = "array<string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iso(ts) -> F.Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _none(kind: str):
    return F.lit(None).cast(kind)


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of their type. Every fiftieth has no subject; purchases link a component, and clicks with odd ids an actor."""
    e = table(spark, sf_dir, "events")
    empty = F.array().cast(_NO_REFS)
    return e.select(
        F.lit("events").alias("package_id"), F.col("event_id").cast("string").alias("record_id"), F.col("event_type").alias("record_type"), iso("ts").alias("timestamp"),
        F.when(F.col("event_id") % 3 == 0, "design").when(F.col("event_id") % 3 == 1, "deployment").alias("lifecycle_phase"),
        F.when(F.col("event_id") % 4 < 2, "provider").when(F.col("event_id") % 4 == 2, "deployer").alias("obligation_role"),
        F.when(F.col("event_id") % 50 == 0, empty).otherwise(F.array(F.col("user_id").cast("string"))).alias("subject_refs"),
        F.when(F.col("event_type") == "purchase", F.array(F.lit("c1"))).otherwise(empty).alias("component_refs"), empty.alias("dataset_refs"),
        F.when((F.col("event_type") == "click") & (F.col("event_id") % 2 == 1), F.array(F.lit("a1"))).otherwise(empty).alias("actor_refs"),
        F.col("props").alias("payload"), _none("array<struct<path:string,hash:string,media_type:string,attachment_type:string>>").alias("attachments"),
        F.when(F.col("value") > 50, "sig").otherwise("").alias("attestation_signature"), F.col("event_id").alias("seq"),
        F.array(F.concat(F.lit("art-"), (F.col("event_id") % 7).cast("string"))).alias("provisions_addressed"), F.when(F.col("event_id") % 10 == 0, "regulator-only").otherwise("public").alias("confidentiality"), _none("string").alias("redaction_method"),
    )


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of their priority, their lineitems as attachments (kind by return flag, media type by line status)."""
    a = F.struct(F.concat_ws("/", F.lit("artifacts"), "l_orderkey", "l_linenumber").alias("path"), F.lit("").alias("hash"), F.col("l_linestatus").alias("media_type"), F.col("l_returnflag").alias("attachment_type"))
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(a).alias("attachments"))
    o = table(spark, sf_dir, "orders").join(items, "o_orderkey", "left")
    empty = F.array().cast(_NO_REFS)
    return o.select(
        F.lit("orders").alias("package_id"), F.col("o_orderkey").cast("string").alias("record_id"), F.col("o_orderpriority").alias("record_type"), iso("o_orderdate").alias("timestamp"),
        _none("string").alias("lifecycle_phase"), F.col("o_orderstatus").alias("obligation_role"), F.array(F.col("o_custkey").cast("string")).alias("subject_refs"),
        empty.alias("component_refs"), empty.alias("dataset_refs"), empty.alias("actor_refs"), F.to_json(F.struct(F.col("o_totalprice").alias("total"))).alias("payload"),
        "attachments", F.lit("").alias("attestation_signature"), F.col("o_orderkey").alias("seq"), empty.alias("provisions_addressed"), F.lit("public").alias("confidentiality"), _none("string").alias("redaction_method"),
    )


def event_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that events name, with their market segment as risk and their nation's region as modality; the segment
    HOUSEHOLD has no risk classification."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey")).distinct()
    c = c.join(users, "c_custkey", "left_semi").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select(F.lit("events").alias("package_id"), F.col("c_custkey").cast("string").alias("subject_id"), F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.col("c_mktsegment")).alias("risk"), F.array("r_name").alias("modalities"))


def order_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.lit("orders").alias("package_id"), F.col("c_custkey").cast("string").alias("subject_id"), F.col("c_mktsegment").alias("risk"), F.array().cast(_NO_REFS).alias("modalities"))


def packages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("events", "2024-01-20T00:00:00Z"), ("orders", ORDERS_AT)], "package_id string, package_time string")


def event_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One signature for each fourth of the suppliers, by nation parity RS256 or ES256."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 0")
    return s.select(F.lit("events").alias("package_id"), F.when(F.col("s_nationkey") % 2 == 0, "RS256").otherwise("ES256").alias("alg"))


def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of a package each twenty-five of them, with their hashes."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.concat(F.lit("pages-"), F.floor(F.col("page_id") / 25).cast("string")).alias("package_id"), F.format_string("artifacts/%06d.html", "page_id").alias("path"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha256"))
