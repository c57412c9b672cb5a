"""Small document tables with the awkward cases that every operator must take."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the cat sat on the mat and the dog ran to the house with a bone that was old"
DE = "der hund und die katze sind in dem haus und der mann ist mit dem kind nicht da"


def table(spark: SparkSession, rows: list[tuple], schema: str = SCHEMA) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def documents(spark: SparkSession) -> DataFrame:
    rows = [
        (1, EN, "en", "a", 1),
        (2, EN.replace(" ", "\n\t "), "en", "a", 1),
        (3, DE, "de", "b", 1),
        (4, None, None, None, None),
        (5, "", "en", "b", 0),
        (6, " \n ", "de", None, 3),
        (7, "42 - 17", "en", "c", 7),
        (8, DE, "de", "b", 1),
        (8, DE, "de", "b", 1),
        (None, EN, None, "c", 1),
        (9, "word " * 30_000, "en", "c", 150_000),
        (10, "x" * 20_000, "en", "a", 20_000),
        (11, EN + " again", "en", "a", 1),
    ]
    return table(spark, rows)


#: Names that operators use inside, as extra columns of the input.
CLASHING = "row long, digest string, fp long, key long, bucket int, size long, copies__ long, kept_id__ long, group int, first__ long, m__ long, l__ string, u double"


def clashing(spark: SparkSession) -> DataFrame:
    docs = documents(spark)
    from pyspark.sql import functions as F

    for part in CLASHING.split(", "):
        name, kind = part.split(" ")
        docs = docs.withColumn(name, F.lit(None).cast(kind))
    return docs


def empty(spark: SparkSession) -> DataFrame:
    return table(spark, [])
