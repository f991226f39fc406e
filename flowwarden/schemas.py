"""Table shapes shared by sources, operators and sinks."""

from pyspark.sql import types as T

LEDGER = T.StructType([
    T.StructField("signature", T.StringType(), False),
    T.StructField("confirmed_normal", T.DoubleType()),
    T.StructField("confirmed_attack", T.DoubleType()),
    T.StructField("trust_bias", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("last_seq", T.LongType()),
])

EVIDENCE = T.StructType([
    T.StructField("signature", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("verdict", T.StringType(), False),
    T.StructField("confidence", T.DoubleType(), False),
])

RULE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("condition", T.StringType()),
    T.StructField("playbook", T.StringType()),
    T.StructField("is_fp", T.BooleanType()),
    T.StructField("is_fn", T.BooleanType()),
    T.StructField("rationale", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("source", T.StringType()),
])

MEMORY_DOCUMENT = T.StructType([
    T.StructField("dynamic_allowlist", T.ArrayType(T.StringType())),
    T.StructField("active_quarantines", T.ArrayType(T.StringType())),
    T.StructField("trust_scores", T.MapType(T.StringType(), T.StructType([
        T.StructField("latest", T.DoubleType()),
        T.StructField("previous", T.DoubleType()),
        T.StructField("evaluated_at", T.StringType()),
        T.StructField("violations", T.ArrayType(T.StringType())),
    ]))),
    T.StructField("signatures", T.MapType(T.StringType(), T.StructType([
        T.StructField("confirmed_normal", T.DoubleType()),
        T.StructField("confirmed_attack", T.DoubleType()),
        T.StructField("trust_bias", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("last_updated", T.StringType()),
    ]))),
])

VECTOR = T.StructType([
    T.StructField("collection", T.StringType(), False),
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
    T.StructField("document", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("version", T.LongType()),
])

THRESHOLD = T.StructType([
    T.StructField("optimal_threshold", T.DoubleType()),
    T.StructField("soc_cost", T.LongType()),
    T.StructField("is_fallback", T.BooleanType()),
    T.StructField("cost_fn", T.LongType()),
    T.StructField("cost_fp", T.LongType()),
    T.StructField("min_precision", T.DoubleType()),
    T.StructField("min_recall", T.DoubleType()),
    T.StructField("achieved_precision", T.DoubleType()),
    T.StructField("achieved_recall", T.DoubleType()),
    T.StructField("confusion", T.StructType([
        T.StructField("tn", T.LongType()),
        T.StructField("fp", T.LongType()),
        T.StructField("fn", T.LongType()),
        T.StructField("tp", T.LongType()),
    ])),
])

RULE_HEALTH = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("fn_count", T.LongType()),
    T.StructField("fp_count", T.LongType()),
    T.StructField("last", T.ArrayType(T.StructType([
        T.StructField("recorded_at", T.StringType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("line", T.StringType()),
    ]))),
])
