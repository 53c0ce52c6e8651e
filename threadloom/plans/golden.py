"""Golden-set job: sample, record, describe, write."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import SEED
from ..operators import golden
from ..sources import tables


def run(conversations: DataFrame, out_dir: str, target: int = 200, seed: int = SEED) -> DataFrame:
    """Writes the golden set, its review layout and its distributions; returns the set as written."""
    built = golden.build_golden_set(conversations, target, seed)
    tables.write_parquet(built, f"{out_dir}/golden", partition_by=None)
    written = conversations.sparkSession.read.schema(built.schema).parquet(f"{out_dir}/golden")
    tables.write_csv(golden.review_table(written), f"{out_dir}/review")
    tables.write_report(golden.distributions(written), f"{out_dir}/golden_metadata")
    return written
