"""Documents as a stream: every micro-batch goes through the pipeline and is made durable.

Documents are independent, so there is no state and no watermark; what one
batch has translated later ones find in the cache.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from inkloom.operators.backend import Backend
from inkloom.operators.memo import Memo
from inkloom.plans.document import translate


def translate_stream(docs: DataFrame, backend: Backend, out: str, checkpoint: str, memo: Memo | None = None, *, doc: str = "source", once: bool = True, **options) -> StreamingQuery:
    """Write doc, text and prose of each document to out, a batch number to each run of rows."""

    def batch(rows: DataFrame, number: int) -> None:
        done = translate(rows, backend, doc=doc, memo=memo, **options).texts
        # A batch that runs again replaces what it wrote before.
        done.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
