from pyspark.sql import functions as F


def one(spark, text, expression):
    """The value of a column expression over one text."""
    return spark.createDataFrame([(text,)], "text string").select(expression(F.col("text")).alias("x")).first()[0]


def many(spark, texts, expression):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", expression(F.col("text")).alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]
