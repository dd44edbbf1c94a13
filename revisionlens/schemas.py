"""Fixed schemas of the tables the operators read and write."""

from pyspark.sql import types as T

ARTICLES = T.StructType([
    T.StructField("entry_id", T.LongType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("summary", T.StringType()),
    T.StructField("source", T.StringType()),
])

SPLIT_SENTENCES = T.StructType([
    T.StructField("entry_id", T.LongType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("sent_idx", T.IntegerType()),
    T.StructField("sentence", T.StringType()),
    T.StructField("source", T.StringType()),
])

TOKENS = T.StructType([
    T.StructField("entry_id", T.LongType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("sent_idx", T.IntegerType()),
    T.StructField("num_words", T.LongType()),
    T.StructField("word_idx", T.IntegerType()),
    T.StructField("token", T.StringType()),
    T.StructField("word_embedding", T.ArrayType(T.FloatType())),
])

MATCHED_SENTENCES = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("entry_id", T.LongType()),
    T.StructField("version_x", T.IntegerType()),
    T.StructField("version_y", T.IntegerType()),
    T.StructField("sent_idx_x", T.IntegerType()),
    T.StructField("sent_idx_y", T.IntegerType()),
    T.StructField("avg_sentence_distance_x", T.DoubleType()),
    T.StructField("avg_sentence_distance_y", T.DoubleType()),
])

# key columns
PAIR = ["source", "entry_id", "version_x", "version_y"]
VERSION = ["source", "entry_id", "version"]
SENTENCE = ["source", "entry_id", "version", "sent_idx"]
