"""Accuracy against what raters said: sf0.01 was looked at when the rules were written, sf0.1 was not."""

import pytest
from pyspark.sql import functions as F

from stelae.llm.text_quality import layouts


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_agreement_with_raters(spark, folder):
    labels = spark.read.parquet(f"{folder}/doc_labels.parquet")
    judged = labels.join(layouts(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text").select("doc_id", F.col("body").alias("measured")), "doc_id")
    case = F.col("measured").isin("list", "table", "junk")
    agree = judged.select(F.avg((case == (F.col("body") != "prose")).cast("double"))).first()[0]
    assert agree >= 0.95  # a few ratings are wrong
