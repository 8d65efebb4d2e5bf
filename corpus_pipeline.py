"""A training corpus from raw documents: five stages, each a table that the next one reads.

Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's
docs; all but the last return the columns of docs. A result must be written before the next stage is called, as that
deletes the tables which the stage before it kept between its steps.

Cases, for all stages: an empty table gives an empty one; extra columns pass through, whatever their names; ties are
decided by doc_id and text, so that reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from nestra.llm import decontaminate, language, mixing, pii, simhash
from nestra.llm.common import read, release_paths, scratch_paths, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables between the steps of the last stage. Its result reads them until it is written.
_left: set[str] = set()


def _stage(f: Stage) -> Stage:
    """A stage that first deletes what the stage before left: by then that one's result has been written."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_paths(_left)
        before = scratch_paths()
        out = f(spark, docs, sf_dir)
        _left.clear()
        _left.update(scratch_paths() - before)
        return out

    return run_stage


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language. A null or empty text stays if its declaration, address suffix or host tells a
    language; repeated rows are decided alike; very long texts count whole."""
    return language.keep(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id. Null and empty texts are copies
    of one another; repeated rows leave one; a null doc_id stays only where no other of its group has an id."""
    return simhash.deduplicate(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark; a text of which more than half was such passages goes. Null and empty
    texts pass; repeated rows are cut alike; an empty benchmark changes nothing."""
    return decontaminate.scrub(docs, read(spark, sf_dir, "benchmark"))


@_stage
def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data. Null and empty texts pass; repeated rows get the same surrogates."""
    return pii.replace(docs).select(*docs.columns)


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row per repetition, with mix_epoch and mix_words. Null and empty texts have no words and no row; a
    null source is a source; repeated rows are taken each for itself."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("surrogates", surrogates),
    ("source_mix", source_mix),
]

#: The stages hold fingerprint components, an automaton and fitted language models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    _left.clear()  # the result reads the last stage's tables: they stay until the program ends
    return docs
