"""Readers and writers of stage tables and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_shots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of documents {"shots": [...]}; ``schema`` is the type of one shot."""
    docs = spark.read.option("multiLine", "true").schema(f"project_id string, shots array<{schema}>").json(path)
    return docs.select("project_id", F.explode("shots").alias("s")).select("project_id", "s.*")


def rough_shots_for(shots: DataFrame, assets: DataFrame) -> DataFrame:
    """The rough shots of each asset of a project, or one row over the whole asset where there is none."""
    rows = assets.join(shots, ["project_id", "asset_id"], "left")
    return rows.withColumns({"start_us": F.coalesce("start_us", F.lit(0)), "end_us": F.coalesce("end_us", "duration_us")})


def read_decisions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of documents {"timeline": [...]} in order."""
    docs = spark.read.option("multiLine", "true").schema(f"project_id string, timeline array<{schema}>").json(path)
    return docs.select("project_id", F.posexplode("timeline").alias("seq", "d")).select("project_id", "seq", "d.*")


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files with their names."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("script_id"), F.col("value").alias("text"))


def write_stage(rows: DataFrame, path: str) -> None:
    """K1: a stage's table, by project."""
    rows.write.mode("overwrite").partitionBy("project_id").parquet(path)


#: Columns of a document in lines: sections come in order, lines of a section in the order of place, then nth.
LINE = ["project_id", "section", "place", "nth", "value"]


def framed(lines: DataFrame, projects: DataFrame, frame: dict[int, str]) -> DataFrame:
    """``lines`` (section, place, nth, value by project) with the fixed lines of ``frame``, by section, for each of ``projects``."""
    fixed = F.explode(F.array(*[F.struct(F.lit(k).alias("section"), F.lit(v).alias("value")) for k, v in frame.items()]))
    none = F.lit(None).cast(lines.schema["place"].dataType)
    rows = projects.select("project_id").distinct().select("project_id", fixed.alias("f"))
    return lines.select(*LINE).unionByName(rows.select("project_id", "f.section", none.alias("place"), F.lit(0).cast("bigint").alias("nth"), "f.value"))


def stage_lines(rows: DataFrame, name: str) -> DataFrame:
    """K1: the JSON document of each project in lines: a head, a line for each row in the order of its values, a foot.

    Equal rows are counted before they are ordered; the first of a project alone has no comma before it.
    """
    record = F.struct(*[c for c in rows.columns if c != "project_id"])
    counted = rows.select("project_id", record.alias("place")).groupBy("project_id", "place").agg(F.count("*").alias("n"))
    first = counted.groupBy("project_id").agg(F.min("place").alias("first"))
    each = counted.join(first, "project_id").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    comma = F.when((F.col("nth") == 1) & F.col("place").eqNullSafe(F.col("first")), "").otherwise(",")
    lines = each.select("project_id", F.lit(1).alias("section"), "place", "nth", F.concat(comma, F.to_json("place")).alias("value"))
    return framed(lines, rows, {0: f'{{"{name}":[', 2: "]}"})


def whole(lines: DataFrame, joint: str) -> DataFrame:
    """One text per project of its lines; for projects that fit a row (``write_lines`` has no such bound)."""
    rows = lines.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("section", "place", "nth", "value"))).alias("rows"))
    return rows.select("project_id", F.array_join(F.transform("rows", lambda r: r["value"]), joint).alias("value"))


def stage_documents(rows: DataFrame, name: str) -> DataFrame:
    """K1: one JSON document per project of its rows, in a row; ``stage_lines`` is for projects of any size."""
    return whole(stage_lines(rows, name), "")


def write_lines(lines: DataFrame, path: str) -> None:
    """K1, K6, K7: documents of any size as ordered text files in the project's folder.

    Lines are cut into ranges by project and order, so a large project is written by many
    tasks; its files, read in the order of their names, are its document.
    """
    order = [F.col(c).asc_nulls_first() for c in LINE[:-1]]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select("project_id", "value").write.mode("overwrite").partitionBy("project_id").text(path)


#: K3: columns of the decision table and their headings.
DECISION_COLUMNS = {
    "sequence": "序列", "shot_id": "镜头ID", "source_file": "源文件", "tc_in": "入点", "tc_out": "出点", "speed": "速度",
    "technique": "剪辑手法", "transition": "转场", "audio": "音频", "purpose": "叙事目的", "notes": "备注",
}


def decision_rows(decisions: DataFrame) -> DataFrame:
    """K3: the eleven columns of the decision table under their headings, in order."""
    return decisions.select(*[F.col(c).alias(n) for c, n in DECISION_COLUMNS.items()]).orderBy("序列")


def write_csv(rows: DataFrame, path: str) -> None:
    """K2-K4: a table with a header whose first name carries a byte order mark."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", "true").csv(path)


def write_text(rows: DataFrame, path: str) -> None:
    """K6, K7, K9: one text per project, in the project's folder."""
    rows.select("project_id", "value").write.mode("overwrite").partitionBy("project_id").text(path)
