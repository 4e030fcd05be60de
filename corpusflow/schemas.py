"""Fixed schemas of the data model (documents, predictions, metrics, statistics)."""

from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("abstract_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("filepath", T.StringType()),
])

PREPARED = T.StructType(DOCUMENT.fields + [
    T.StructField("label_id", T.IntegerType()),
    T.StructField("split", T.StringType()),
])

SCORING_INPUT = T.StructType([
    T.StructField("abstract_id", T.StringType()),
    T.StructField("text", T.StringType()),
])

LABEL_MAP = T.StructType([
    T.StructField("label2id", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("id2label", T.MapType(T.StringType(), T.StringType())),
])

PREDICTION = T.StructType([
    T.StructField("abstract_id", T.StringType()),
    T.StructField("predicted_labels", T.ArrayType(T.StringType())),
    T.StructField("confidence_scores", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("extracted_diseases", T.ArrayType(T.StringType())),
])
