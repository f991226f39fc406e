"""Flow tables: CSV scan, column roles, context construction, scored-event cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwarden.functions.signature import (
    behaviour_signature, anomaly_severity, classification_certainty, risk_severity, traffic_volume,
)

# Texts that mean "no value" in flow files, and integer columns that are categories.
NULL_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
              "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
CODED_CATEGORIES = ("is_ftp_login", "is_sm_ips_ports", "ct_state_ttl")
LABELS = ("label", "attack_cat")


def read_flows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Header CSV with a declared schema; every null spelling becomes null before the cast.

    The file is read as text columns in one pass, so no inference scan runs over it.
    """
    target = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in target.fields])
    raw = spark.read.csv(path, header=True, schema=texts, enforceSchema=False, mode="PERMISSIVE")
    typed = []
    for f in target.fields:
        value = F.when(~F.col(f.name).isin(*NULL_TEXTS), F.col(f.name))
        typed.append((value if isinstance(f.dataType, T.StringType) else value.try_cast(f.dataType)).alias(f.name))
    return raw.select(*typed)


def split_labels(flows: DataFrame) -> DataFrame:
    """Drop the row id; a missing class is Normal."""
    return flows.drop("id").withColumn("attack_cat", F.coalesce("attack_cat", F.lit("Normal")))


def column_roles(flows: DataFrame) -> tuple[list[str], list[str]]:
    """(categorical, numeric) feature names: text columns and coded integers, sorted; then the rest."""
    features = [(n, t) for n, t in flows.dtypes if n not in LABELS and n != "id"]
    categorical = sorted(n for n, t in features if t == "string" or n in CODED_CATEGORIES)
    return categorical, [n for n, _ in features if n not in categorical]


def categorical_view(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("unknown"))


def numeric_view(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def feature_views(flows: DataFrame) -> DataFrame:
    """Categories as text with `unknown`, numbers as doubles with 0."""
    categorical, numeric = column_roles(flows)
    others = [c for c in flows.columns if c not in categorical and c not in numeric]
    return flows.select(
        *others,
        *[categorical_view(c).alias(c) for c in categorical],
        *[numeric_view(c).alias(c) for c in numeric],
    )


def with_context_columns(scored: DataFrame) -> DataFrame:
    """Round the risks as a context does and add the behaviour signature."""
    rounded = scored.withColumns({
        "fused_risk": F.round("fused_risk", 3),
        "cat_risk": F.round("cat_risk", 3),
        "anomaly_risk": F.round("anomaly_risk", 3),
        "incident_entropy": F.round("incident_entropy", 4),
    })
    return rounded.withColumn("signature", behaviour_signature(
        F.col("proto"), F.col("service"), F.col("state"), F.col("threat"), F.col("fused_risk"),
        F.col("anomaly_risk"), F.col("spkts"), F.col("incident_entropy")))


def construct_context(scored: DataFrame, telemetry: list[str]) -> DataFrame:
    """Nested context rows; the event's own time stands in for processing time."""
    return scored.select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.struct(
            F.round("cat_risk", 3).alias("categorical_risk"),
            F.round("anomaly_risk", 3).alias("anomaly_risk"),
            F.round("fused_risk", 3).alias("fused_risk"),
            F.round("incident_entropy", 4).alias("incident_entropy"),
        ).alias("ml_risk_profile"),
        F.col("threat").cast("string").alias("predicted_threat_classification"),
        F.struct(*[F.col(c) for c in telemetry]).alias("network_telemetry"),
    )


def slim_context(events: DataFrame) -> Column:
    """Twelve-key JSON of one event; keys without a value stay as null."""
    return F.to_json(F.struct(
        F.col("fused_risk"), F.col("cat_risk"), F.col("threat").alias("threat_class"),
        F.col("proto"), F.col("service"), F.col("state"), F.col("spkts"), F.col("dpkts"),
        risk_severity(F.col("fused_risk")).alias("fused_risk_severity"),
        anomaly_severity(F.col("anomaly_risk")).alias("anomaly_severity"),
        traffic_volume(F.col("spkts")).alias("traffic_volume"),
        classification_certainty(F.col("incident_entropy")).alias("classification_certainty"),
    ), {"ignoreNullFields": "false"})


def write_scored(scored: DataFrame, path: str) -> None:
    scored.write.mode("overwrite").parquet(path)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
