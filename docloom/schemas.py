"""Logical tables as Spark schemas."""

from pyspark.sql import types as T

RAW_FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

PARSED_CONTENTS = T.MapType(T.StringType(), T.StringType())

PARSING = T.StructType(
    [
        T.StructField("doc_parsed_contents", PARSED_CONTENTS, True),
        T.StructField("parser_status", T.StringType(), True),
    ]
)

RATING = T.StructType([T.StructField("value", T.StringType())])
RATINGS = T.MapType(T.StringType(), RATING)

ASSESSMENT_LOG = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("source", T.StructType([T.StructField("id", T.StringType())])),
        T.StructField("step_id", T.StringType()),
        T.StructField(
            "text_assessment",
            T.StructType([T.StructField("ratings", RATINGS), T.StructField("suggested_output", T.StringType())]),
        ),
        T.StructField(
            "retrieval_assessment",
            T.StructType(
                [
                    T.StructField("position", T.IntegerType()),
                    T.StructField("step_id", T.StringType()),
                    T.StructField("ratings", RATINGS),
                ]
            ),
        ),
    ]
)

REQUEST_LOG = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("request", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("trace", T.StringType()),
    ]
)

CONTEXT_ENTRY = T.StructType([T.StructField("doc_uri", T.StringType()), T.StructField("content", T.StringType())])
CONTEXT = T.ArrayType(CONTEXT_ENTRY)

# Our trace format: {"retrieved": [{"doc_uri": ..., "content": ...}, ...]}
TRACE = T.StructType([T.StructField("retrieved", CONTEXT)])

GOLD_QUESTIONS = T.StructType(
    [
        T.StructField("request", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("expected_response", T.StringType()),
        T.StructField("expected_retrieved_context", T.ArrayType(T.StructType([T.StructField("doc_uri", T.StringType())]))),
    ]
)

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
