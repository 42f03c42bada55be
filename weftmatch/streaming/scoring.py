"""Submissions scored in micro-batches against a frozen index of samples.

Every batch is scored as the batch queries do and replaces what was stored for its documents, so a batch that runs twice
after a failure, or a document that comes again, leaves one result (the one of the batch that came last).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import EngineConfig
from ..operators import matching as m
from ..operators import sentences as st
from ..operators import statistics as stats
from ..sources.versions import replace_by_key


def score_batch(batch: DataFrame, samples: DataFrame, idf: DataFrame, weights: DataFrame, config: EngineConfig) -> DataFrame:
    """Report statistics of the documents (doc_id, text) of a batch; ``samples``, ``idf`` and ``weights`` are of the samples alone."""
    docs = batch.dropDuplicates(["doc_id"]).select("doc_id", "text", F.lit(False).alias("is_sample"))
    own = st.sentence_index(docs, config)
    index = own.unionByName(samples)
    found = m.sentence_matches(index, st.term_weights(own, idf).unionByName(weights), config)
    return stats.report_stats(index, found)


def stream_score(incoming: DataFrame, samples: DataFrame, idf: DataFrame, weights: DataFrame, out: str, checkpoint: str, config: EngineConfig | None = None) -> StreamingQuery:
    """Score a stream of documents (doc_id, text) until what is there is done; results are versions of the table ``rows`` in ``out``.

    A batch that comes again after a crash carries the same token, so it is not stored twice."""
    config = config or EngineConfig()

    def store(batch: DataFrame, number: int) -> None:
        replace_by_key(score_batch(batch, samples, idf, weights, config), out, "doc_id", token=f"{checkpoint} {number}")

    return incoming.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
