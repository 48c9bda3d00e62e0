"""Books that arrive as a stream: the chunking projection needs no state, so it runs as it is; finished chunks are written exactly once per batch, and totals are kept by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quire.operators.chunking import ARABIC, Profile, chunk_documents
from quire.operators.translate import Config, dry_run


def chunk_stream(docs: DataFrame, text: str = "text", max_tokens: int = 1500, overlap_tokens: int = 200, profile: Profile = ARABIC) -> DataFrame:
    return chunk_documents(docs, text, max_tokens, overlap_tokens, profile=profile)


def totals(chunks: DataFrame, time: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Chunks and tokens by window of event time; later ones are dropped."""
    return chunks.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


def translate_stream(docs: DataFrame, out: str, checkpoint: str, cfg: Config = Config(), profile: Profile = ARABIC) -> StreamingQuery:
    """Dry-run outputs of whole documents appended to `out`; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        done = dry_run(chunk_documents(batch, "text", cfg.chunk_size, cfg.overlap, profile=profile), cfg)
        done.select("doc_id", "chunk_index", "output").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
