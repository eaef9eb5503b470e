"""Run-time parameters; the defaults suit a full scholarly graph."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Config:
    start_year: int = 1950  # exclusive
    final_year: int = 2025
    year_filters: tuple[int, ...] = (1950, 2010, 2015, 2020, 2021, 2022, 2023, 2024)
    min_papers_institution: int = 250
    min_papers_source: int = 200
    min_author_works: int = 8
    min_author_citations: int = 400
    max_authors: int = 20
    min_citations: int = 1
    work_kinds: tuple[str, ...] = ("article", "book", "review")
    min_topic_score: float = 0.7
    hit_citations: int = 1000
    era_years: int = 11
    top_relations: int = 8
    max_siblings: int = 16
    specialization_rate: float = 0.45
    fixed_authors: tuple[int, ...] = field(default=())
    dropped_institutions: tuple[int, ...] = field(default=())


def checkpoint_folder(spark: SparkSession) -> None:
    """The cluster's shared folder is used as it is; only in a local session that names none (tests) a private one is set."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() is not None:
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lattica-"))
