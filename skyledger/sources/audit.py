"""Audit-log and finding sources: files, queue message bodies, JSON-in-a-column rows, scenario folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.session import cut_lineage
from skyledger.sources.split_json import file_fragments, object_fragments, open_object, split_objects

AUDIT_RECORD = """
    eventVersion STRING, eventID STRING, eventTime STRING, eventSource STRING, eventName STRING,
    awsRegion STRING, sourceIPAddress STRING, userAgent STRING, readOnly BOOLEAN,
    recipientAccountId STRING, errorCode STRING,
    userIdentity STRUCT<type: STRING, arn: STRING, accountId: STRING, userName: STRING, accessKeyId: STRING,
        invokedBy: STRING,
        sessionContext: STRUCT<sessionIssuer: STRUCT<type: STRING, arn: STRING, userName: STRING>,
                               attributes: STRUCT<mfaAuthenticated: STRING, creationDate: STRING>>>,
    requestParameters STRING, responseElements STRING,
    resources ARRAY<STRUCT<ARN: STRING, type: STRING>>,
    additionalEventData STRUCT<bytesTransferred: BIGINT>
"""
_ACTION = "STRUCT<RemoteIpDetails: STRUCT<IpAddressV4: STRING, Organization: STRUCT<Asn: STRING>, Country: STRUCT<CountryName: STRING>>>"
FINDING = f"""
    AccountId STRING, Region STRING, Type STRING, Id STRING, Severity DOUBLE,
    CreatedAt STRING, UpdatedAt STRING, Title STRING,
    Resource STRUCT<ResourceType: STRING,
        AccessKeyDetails: STRUCT<AccessKeyId: STRING, PrincipalId: STRING, UserType: STRING, UserName: STRING>,
        InstanceDetails: STRUCT<InstanceId: STRING>>,
    Service STRUCT<EventFirstSeen: STRING, EventLastSeen: STRING, Count: INT,
        Action: STRUCT<ActionType: STRING, AwsApiCallAction: {_ACTION}, NetworkConnectionAction: {_ACTION},
                       PortProbeAction: {_ACTION}>>
"""


def parse_audit(text: Column) -> Column:
    return F.from_json(text, AUDIT_RECORD)


def parse_finding(text: Column) -> Column:
    return F.from_json(text, FINDING)


def _raw(df: DataFrame, record: Column, prefix: Column, event_id: Column, source: str) -> DataFrame:
    return df.select(
        record.alias("record"),
        F.concat(prefix, F.lit("#"), F.coalesce(event_id, F.lit("unknown"))).alias("raw_ref"),
        F.lit(source).alias("source"),
        *[c for c in ("path", "pos") if c in df.columns],
    )


def _records(objects: DataFrame) -> DataFrame:
    """(path, pos, rec) of the delivery documents ``{"Records": [...]}`` among split objects."""
    return objects.filter("section = 'Records' AND item IS NOT NULL").select("path", "pos", parse_audit(F.col("item")).alias("rec"))


def read_audit_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Delivery files ``{"Records": [...]}``, plain or compressed (codec chosen from the file extension).

    A plain file is read by as many tasks as it has ranges. ``path``/``pos`` keep arrival order: file path, then position in the file.
    """
    return _raw(_records(split_objects(file_fragments(spark, path))), F.col("rec"), F.col("path"), F.col("rec.eventID"), "cloudtrail")


def read_delivered(spark: SparkSession, path: str | list[str], opener: Callable = open_object) -> DataFrame:
    """Delivery objects below ``path``, gzip or plain as their content says, whatever they are named.

    Only names are listed; each object is streamed by an executor, so neither it nor its inflated text is held whole.
    """
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return _raw(_records(split_objects(object_fragments(names, "path", opener))), F.col("rec"), F.col("path"), F.col("rec.eventID"), "cloudtrail")


def read_finding_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Finding files: a bare JSON array or ``{"Findings": [...]}``; anything else holds none."""
    objects = split_objects(file_fragments(spark, path)).filter("coalesce(section, 'Findings') = 'Findings' AND item IS NOT NULL")
    return _raw(objects.select("path", "pos", parse_finding(F.col("item")).alias("rec")), F.col("rec"), F.col("path"), F.col("rec.Id"), "guardduty")


ENVELOPE = "`detail-type` STRING, detail STRING, id STRING, eventID STRING, Records ARRAY<STRING>"
NOTIFICATION = "s3 STRUCT<bucket: STRUCT<name: STRING>, object: STRUCT<key: STRING>>"


def classify_messages(messages: DataFrame, body: str = "body") -> DataFrame:
    """Parse queue message bodies once and name their shape; works on a stream as well."""
    env = F.from_json(F.col(body), ENVELOPE)
    first = F.from_json(F.try_element_at(F.col("env.Records"), F.lit(1)), NOTIFICATION)
    shape = (F.when((F.col("env.detail-type") != "") & F.ltrim(F.col("env.detail")).startswith("{"), "eventbridge")
             .when(first["s3"].isNotNull(), "notification")
             .when(F.col("env.Records").isNotNull(), "records")
             .otherwise("bare"))
    return messages.withColumn("env", env).withColumn("shape", shape)


def records_from_messages(messages: DataFrame, body: str = "body") -> DataFrame:
    """Records carried inside the bodies; delivery notifications are resolved by :func:`notified_objects`."""
    m = classify_messages(messages, body).filter(F.col("shape") != "notification")
    items = (F.when(F.col("shape") == "eventbridge", F.array("env.detail"))
             .when(F.col("shape") == "records", F.col("env.Records"))
             .otherwise(F.array(F.col(body))))
    rows = m.select("shape", F.col("env.id").alias("mid"), F.posexplode(items).alias("pos", "item"))
    rows = rows.withColumn("rec", parse_audit(F.col("item")))
    ref_id = F.coalesce(F.col("rec.eventID"), F.lit("unknown"))
    ref = F.when(F.col("shape") == "eventbridge", F.concat(F.lit("eventbridge://"), F.coalesce("mid", ref_id)))
    return rows.select(F.col("rec").alias("record"),
                       F.coalesce(ref, F.concat(F.lit("sqs://raw#"), ref_id)).alias("raw_ref"),
                       F.lit("cloudtrail").alias("source"), "pos")


def notified_objects(messages: DataFrame, body: str = "body") -> DataFrame:
    """(bucket, key) of every delivery object announced by the messages."""
    m = classify_messages(messages, body).filter(F.col("shape") == "notification")
    return (m.select(F.explode("env.Records").alias("item"))
            .select(F.from_json("item", NOTIFICATION)["s3"].alias("s3"))
            .select(F.col("s3.bucket.name").alias("bucket"), F.col("s3.object.key").alias("key")))


def read_notified(objects: DataFrame, root: str = "s3://", opener: Callable = open_object) -> DataFrame:
    """Records of announced delivery objects (bucket, key) with the provenance ``s3://bucket/key#id``.

    The executors fetch the objects; no name passes through the driver. An object announced twice is read once.
    """
    uri = F.concat(F.lit(root), "bucket", F.lit("/"), "key").alias("uri")
    once = cut_lineage(objects.select("bucket", "key").distinct().withColumn("uri", uri))
    rows = _records(split_objects(object_fragments(once, "uri", opener))).join(once, F.col("path") == F.col("uri"))
    return _raw(rows, F.col("rec"), F.concat(F.lit("s3://"), "bucket", F.lit("/"), "key"), F.col("rec.eventID"), "cloudtrail")


def land_notified(messages: DataFrame, out: str, epoch: int | str, body: str = "body", root: str = "s3://", opener: Callable = open_object) -> DataFrame:
    """Land the records of one batch of messages below ``out`` and note the objects read; for ``foreachBatch`` too.

    Objects of other batches in the manifest are not read again. Records are written before the manifest, both in a folder of the batch
    that a rerun overwrites, so a batch that was cut off or is replayed adds nothing twice. Returns the landed records.
    """
    spark = messages.sparkSession
    records, manifest = f"{out.rstrip('/')}/records", f"{out.rstrip('/')}/manifest"
    wanted = notified_objects(messages, body).distinct()
    schema = "bucket string, key string, batch string"
    try:
        done = spark.read.schema(schema).parquet(manifest).filter(F.col("batch") != str(epoch))
        done.isEmpty()
    except AnalysisException:  # the first batch
        done = spark.createDataFrame([], schema)
    wanted = cut_lineage(wanted.join(done, ["bucket", "key"], "left_anti"))
    rows = read_notified(wanted, root, opener).unionByName(records_from_messages(messages, body), allowMissingColumns=True)
    rows.write.mode("overwrite").parquet(f"{records}/batch={epoch}")
    wanted.write.mode("overwrite").parquet(f"{manifest}/batch={epoch}")
    return spark.read.parquet(f"{records}/batch={epoch}")


def records_from_json_column(rows: DataFrame, column: str = "CloudTrailEvent", id_column: str = "EventId") -> DataFrame:
    """Rows whose payload is a JSON string column, as returned by the event lookup API."""
    rec = parse_audit(F.col(column))
    return (rows.withColumn("rec", rec)
            .select(F.col("rec").alias("record"),
                    F.concat(F.lit("localstack://cloudtrail#"),
                             F.coalesce("rec.eventID", id_column, F.lit("unknown"))).alias("raw_ref"),
                    F.lit("cloudtrail").alias("source")))


def read_scenarios(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Scenario fixtures (``{"Records": [...]}`` or a bare array), one scenario per file name."""
    objects = split_objects(file_fragments(spark, path)).filter("coalesce(section, 'Records') = 'Records' AND item IS NOT NULL")
    file = F.substring_index("path", "/", -1)
    return objects.select(F.regexp_replace(file, r"\.json$", "").alias("scenario"), parse_audit(F.col("item")).alias("record"),
                          F.concat(file, F.lit(":"), F.col("pos")).alias("raw_ref"), F.lit("cloudtrail").alias("source"), F.col("pos").cast("int").alias("pos"))
