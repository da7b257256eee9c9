"""Request files in, decision files out: batch scoring as micro-batches.

Scoring is stateless, so there is no watermark and no state store; every
micro-batch goes through exactly the code of the batch table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from renewlens.operators.attribution import LinearScorer
from renewlens.operators.compiled import CompiledScorer
from renewlens.operators.score import rows_to_features, score_table


def request_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet request files as a stream; the schema is part of the contract."""
    return spark.readStream.schema(schema).parquet(path)


def score_batch(
    requests: DataFrame,
    scorer: LinearScorer | CompiledScorer,
    assumptions: DataFrame,
    feature_order: Sequence[str],
    *,
    at_expiry: bool = True,
    reasons: bool = True,
) -> DataFrame:
    """Requests -> decisions, with the warnings about each request."""
    features = rows_to_features(requests, feature_order, allow_empty=True, warnings="warnings")
    return score_table(
        features, scorer, assumptions, at_expiry=at_expiry, warnings="warnings", reasons=reasons
    )


def score_stream(
    requests: DataFrame,
    scorer: LinearScorer | CompiledScorer,
    assumptions: DataFrame,
    feature_order: Sequence[str],
    *,
    out: str,
    checkpoint: str,
    at_expiry: bool = True,
    reasons: bool = True,
) -> StreamingQuery:
    """Score all waiting request files. Each batch replaces its own folder, so a retry after
    a failure cannot duplicate decisions."""

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = score_batch(
            batch, scorer, assumptions, feature_order, at_expiry=at_expiry, reasons=reasons
        )
        scored.withColumn("scored_in_batch", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{out}/batch={batch_id}"
        )

    return (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
