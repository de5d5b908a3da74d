"""Small frames with the cases that every operator must stand."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 20_000
TEXTS = [
    (1, "The cat sat on the mat and looked at the moon tonight", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "The cat sat on the mat and looked at the moon tonight", "en"),
    (4, "The cat sat on the mat and looked at the moon tonight", "en"),
    (5, LONG, "la"),
    (6, "12 34 !!", "en"),
    (7, "   \n\t ", None),
    (8, "naïve Σίσυφος ﬁ 日本語 \U0001f600 İstanbul", "el"),
    (9, "The cat sat on the mat and looked at the sun tonight", "en"),
    (None, "no id here at all", "en"),
    (None, None, None),
]
# names that operators use for their own columns
CLASHES = [
    "key", "text_crc32", "fp", "id", "component_id", "score", "lang_pred", "predicted", "held_out", "chunk", "n_tokens", "piece", "shard",
    "slot", "digest", "block", "__block", "copies", "x", "u", "v", "sha", "first", "count", "rows",
]

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in CLASHES],
    ]
)


def documents(spark, rows=TEXTS):
    """Documents with odd texts, repeated rows, null ids and clashing extra columns."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), *["c"] * len(CLASHES)) for i, t, lang in rows], DOCS)


def labels(spark, rows=((1, 1, 0), (6, 0, 0), (5, 0, 1), (9, 1, 0), (9, 1, 0), (2, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))




def multiset(rows):
    return sorted(map(repr, rows))
