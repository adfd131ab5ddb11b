"""Requests scored as they arrive, against a model that stays put.

Records are independent, so no state or watermark is needed: every micro-batch
runs the batch job and writes to a folder of its own. A batch that is run again
after a failure overwrites that folder, so each answer exists once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from phraseloom.operators.records import rejects_of, request_rows
from phraseloom.operators.tagging import Tagger
from phraseloom.params import DEFAULTS, Params
from phraseloom.plans.pipelines import answered_records
from phraseloom.sources.tables import read_model
from phraseloom.staging import Workspace, stage


def score_stream(
    requests: DataFrame,
    model_path: str,
    output: str,
    checkpoint: str,
    tagger: Tagger | None = None,
    p: Params = DEFAULTS,
    rejects: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Start scoring a stream of (request_id, body). Answers are rows
    (request_id, pos, record) below ``output``; bodies that are no request are
    rows (request_id, corrupt_body) below ``rejects``, by default the folder
    of that name beside the output. ``trigger`` is what
    ``DataStreamWriter.trigger`` takes; the default runs what is there and
    stops."""

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        model = read_model(batch.sparkSession, model_path)
        with Workspace(batch.sparkSession) as workspace:
            rows = stage(request_rows(batch), "requests", workspace)
            answers = answered_records(rows, model, tagger, p, workspace)
            answers.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
            refused = rejects_of(rows)
            refused.write.mode("overwrite").parquet(f"{rejects or output + '-rejects'}/batch={batch_id}")

    return (
        requests.writeStream.foreachBatch(score_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
