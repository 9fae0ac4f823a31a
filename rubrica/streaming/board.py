"""A running leaderboard that equals the batch one: seeds collapsed, errored seeds left out.

The stream collapses seeds with the aggregates of the batch run: per (model, prompt) the state store holds their
fixed-size buffers, and rows are folded where they are read, so a prompt with very many seeds does not pull them into one
task. After a micro-batch the collapsed rows of the prompts it touched are written to a folder named after the batch, so a
batch that is run again replaces its own. The board is the batch board over the newest row of every prompt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rubrica.operators import judgments as J
from rubrica.operators import scores as A
from rubrica.streaming.state import start_stateful

_KEYS = ["model", "prompt_id"]
_ROW = ["score_am", "score_gm", "seed_std_dev_am", "seed_std_dev_gm", "n_seeds", "covered"]
_SCHEMA = (
    "model string, prompt_id string, score_am double, score_gm double, seed_std_dev_am double, "
    "seed_std_dev_gm double, n_seeds bigint, covered boolean"
)


def board_changes(judgments: DataFrame) -> DataFrame:
    """Collapsed rows of resolved judgments (model, prompt_id, seed, score_am, score_gm, judge_error), as they change."""
    rows = judgments.select(*_KEYS, "seed", "score_am", "score_gm", "judge_error")
    return J.collapse_seeds(rows).select(*_KEYS, *_ROW)


def write_board(judgments: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the collapsed rows below ``path``, those that a micro-batch changed in a folder of their own."""

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = board_changes(judgments).writeStream.outputMode("update").foreachBatch(add)
    return start_stateful(judgments.sparkSession, writer, checkpoint, available_now)


def read_board(spark: SparkSession, path: str) -> DataFrame:
    """The leaderboard as of the last finished batch, in the columns of the batch table."""
    rows = spark.read.schema(f"{_SCHEMA}, batch_id bigint").parquet(path)
    # Fixed-size buffers only: the newest batch of a prompt wins column by column.
    newest = rows.groupBy(*_KEYS).agg(*[F.max_by(c, "batch_id").alias(c) for c in _ROW])
    return A.leaderboard(newest.withColumns({"score": F.col("score_am"), "seed_std_dev": F.col("seed_std_dev_am")}))
