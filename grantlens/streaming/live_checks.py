"""The language rules over a stream. They are stateless, so no watermark or state is involved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.text_checks import calibration_sweep

def sweep_stream(
    texts: DataFrame, text: str, id_cols: Sequence[str], checkpoint: str, sink: str = "parquet", path: str | None = None
) -> DataStreamWriter:
    """Append writer of the violations in a streaming text source; call start() on it.

    checkpoint is a folder of the caller's in shared storage. A query started again with the same
    folder goes on where it stopped, and the file sink then holds every violation once.
    """
    if not texts.isStreaming:
        raise ValueError("sweep_stream takes a streaming DataFrame; use calibration_sweep for tables")
    writer = calibration_sweep(texts, text, id_cols).writeStream.outputMode("append").format(sink)
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.option("path", path) if path else writer
