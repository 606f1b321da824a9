"""Registered queries of the subpackage and, where there is any, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.llm import abuse, density, mix, neardup, neighbors, split, tokens
from stratavec.session import table


def _embedded(s: SparkSession, d: str) -> DataFrame:
    """Operations whose op is exactly Inserted or Changed."""
    return table(s, d, "operations").filter(F.col("op").isin("Inserted", "Changed"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_token_budget": lambda s, d: tokens.token_budget(tokens.operation_tokens(table(s, d, "operations"))),
    "p1_usage": lambda s, d: tokens.usage_comparison(tokens.operation_tokens(table(s, d, "operations")), table(s, d, "embedding_usage")),
    "p2_found": lambda s, d: neighbors.close_pairs(table(s, d, "embedding_data")),
    "p2_neighbours": lambda s, d: neighbors.nearest(table(s, d, "embedding_data"), asks=F.col("vec_id") % 100 == 0),
    "p3_found": lambda s, d: density.linked_groups(table(s, d, "embedding_data")),
    "p3_clusters": lambda s, d: density.Clusters(table(s, d, "embedding_data")).summary(),
    "p3_members": lambda s, d: density.Clusters(table(s, d, "embedding_data")).members(),
    "p4_found": lambda s, d: neardup.operation_duplicates(table(s, d, "operations")).pairs().withColumnsRenamed({"key_a": "seq_a", "key_b": "seq_b"}),
    "p4_groups": lambda s, d: neardup.operation_duplicates(table(s, d, "operations")).groups().withColumnRenamed("key", "seq"),
    "p5_found": lambda s, d: split.split_texts(_embedded(s, d)).select("seq").distinct(),
    "p5_pieces": lambda s, d: split.split_texts(table(s, d, "operations")),
    "p7_ids": lambda s, d: tokens.encode(table(s, d, "documents")),
    "p8_mix": lambda s, d: mix.mix(table(s, d, "documents"), table(s, d, "mix_targets")),
    "p8_shares": lambda s, d: mix.reached_shares(mix.mix(table(s, d, "documents"), table(s, d, "mix_targets")), table(s, d, "mix_targets")),
    "p9_found": lambda s, d: abuse.score(table(s, d, "documents")).filter(F.col("score") >= abuse.THRESHOLD).select("doc_id"),
    "p9_scores": lambda s, d: abuse.score(table(s, d, "documents")),
    "p9_rates": lambda s, d: abuse.rates(abuse.score(table(s, d, "documents"))),
}

ORACLE_SQL: dict[str, str] = {
    "p5_found": "SELECT DISTINCT seq FROM operations WHERE op IN ('Inserted', 'Changed') AND length(string) > 4000",
}
