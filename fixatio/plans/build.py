"""The four build steps from raw files to the scene table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fixatio import model as M
from fixatio.operators import events as E
from fixatio.operators import prepare as P
from fixatio.operators import scene as S
from fixatio.sources import raw
from fixatio.sources import tables as TB


def build_stimuli(spark: SparkSession, config_path: str, target: str) -> None:
    TB.write_table(TB.lists_as_json(raw.read_stimuli(spark, config_path)), target)


def build_forms(spark: SparkSession, forms_path: str, target: str) -> None:
    TB.write_table(raw.read_forms(spark, forms_path), target)


def build_sessions(spark: SparkSession, recordings: str, forms: str, target: str) -> None:
    files = raw.session_files(spark, recordings)
    TB.write_table(P.sessions_table(files, TB.read_table(spark, forms)), target)


def build_scene_metrics(
    spark: SparkSession, recordings: str, config_path: str, fixations_target: str,
    scene_rows_target: str, target: str, gates: M.Gates = M.Gates(),
) -> None:
    """Fixations and scene facts are stored on the way, so neither is computed again for the metrics;
    each of the three steps puts the samples it reads in order."""
    samples = raw.read_samples(spark, recordings)
    TB.write_table(E.extract_fixations(samples), fixations_target)
    TB.write_table(E.scene_samples(samples, gates), scene_rows_target)
    wide: DataFrame = S.scene_metrics(
        samples,
        raw.read_stimuli(spark, config_path),
        raw.read_schedule(spark, config_path),
        gates,
        fixations=TB.read_table(spark, fixations_target),
        scene_rows=TB.read_table(spark, scene_rows_target),
    )
    TB.write_table(TB.lists_as_json(wide), target, partition_by=["folder"])
