"""Time to replay synthetic logs: python tools/replay_bench.py [SIZE...]

A log holds a third concepts and two thirds claims and citations of earlier
records; the time is that of validating it and counting what is held and current.
"""

import json
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from pyspark.sql import functions as F

from stelae.functions.identity import claim_identity, concept_identity
from stelae.operators import history
from stelae.session import Scratch, local_session


def synthetic(spark, size):
    """Concepts at every third position, each followed by a claim about it and a
    citation of that claim."""
    turn, name = F.col("id") % 3, F.concat(F.lit("concept "), F.floor(F.col("id") / 3).cast("string"))
    concept = concept_identity(name)
    claim = claim_identity(concept, F.lit("holds"))
    kind = F.when(turn == 0, "concept").when(turn == 1, "claim").otherwise("assertion")
    empty = F.lit("")
    return spark.range(size).select(
        (F.col("id") + 1).alias("seq"), kind.alias("kind"), F.lit("asserted").alias("standing"), empty.alias("successor"),
        empty.alias("because"), F.when(turn == 1, concept).when(turn == 2, claim).otherwise(empty).alias("ref"),
        F.when(turn == 0, name).when(turn == 1, "holds").otherwise(empty).alias("text"),
        F.when(turn == 2, "a source").otherwise(empty).alias("source"), empty.alias("scope"), F.col("id").alias("at"),
    )


def main(sizes):
    spark = local_session(8, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for size in [1_000, *sizes]:  # the first warms up
        log = Scratch(spark, "replay").keep(synthetic(spark, size), "log")
        began = time.perf_counter()
        counts = history.replay(log).first()
        took[size] = round(time.perf_counter() - began, 3)
        assert counts.refused_at is None and counts.held == (size + 2) // 3, counts
    took.pop(1_000, None)
    print(json.dumps({"metric": "replay_seconds", "sizes": took}))


if __name__ == "__main__":
    main([int(x) for x in sys.argv[1:]] or [750, 1_500, 3_000, 6_000, 12_000, 100_000, 1_000_000])
