"""Writing cards, tables, manifests and summaries."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_cards(cards: DataFrame, path: str, partition: str = "big_bucket") -> None:
    """Cards as JSON, one folder per bug; folders of other bugs stay, so a resumed run replaces only its own."""
    cards.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).json(path)


def write_table(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A table as CSV with header, columns in a fixed order (by name if none is given); lists and structs as JSON, outer blanks of texts kept."""
    columns = columns or sorted(df.columns)
    flat = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, T.ArrayType | T.StructType | T.MapType) else F.col(c) for c in columns]
    df.select(*flat).write.mode("overwrite").option("header", "true").option("emptyValue", "").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").option("escape", '"').csv(path)


def sorted_struct(df: DataFrame) -> Column:
    """All columns as one struct whose members, at every level, are sorted by name."""
    def ordered(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            made = F.struct(*[ordered(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
            return F.when(c.isNotNull(), made)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(c, lambda x: ordered(x, kind.elementType))
        return c

    return F.struct(*[ordered(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)])


@F.pandas_udf(T.StringType())
def _ascii(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), ensure_ascii=True, sort_keys=True))


def json_text(df: DataFrame) -> DataFrame:
    """``value``: each row as JSON with sorted names in ASCII; only rows with other characters leave the engine for it."""
    plain = F.to_json(sorted_struct(df), {"ignoreNullFields": "false"})
    return df.select(plain.alias("v")).select(F.when(F.col("v").rlike(r"^\p{ASCII}*$"), F.col("v")).otherwise(_ascii(F.when(~F.col("v").rlike(r"^\p{ASCII}*$"), F.col("v")))).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    json_text(df).write.mode("overwrite").text(path)


def write_task_list(representatives: DataFrame, path: str) -> None:
    """The paths of the representatives' cards, one per line in order."""
    representatives.select(F.col("copied_target_file").alias("value")).orderBy("value").write.mode("overwrite").text(path)


def write_summary(row: DataFrame, path: str) -> None:
    """A one-row table as JSON."""
    json_text(row).coalesce(1).write.mode("overwrite").text(path)


def write_vectors(vectors: DataFrame, path: str, meta: dict) -> None:
    """Vectors as Parquet with a JSON description beside them."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    vectors.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/vectorizer_meta")


def write_clustering(grid: DataFrame, selected: DataFrame, diagnostic: DataFrame, assignments: DataFrame, path: str) -> None:
    """The grid, the assignments of the selected and of the diagnostic threshold, and a summary."""
    write_table(grid, f"{path}/grid")
    columns = ["record_id", "true_label", "pred_cluster", "weight", "cause_card_id", "source_crash_id", "copied_file_name"]
    for name, row in (("selected", selected), ("oracle_diagnostic", diagnostic)):
        own = assignments.join(row.select("block", "distance_threshold"), ["block", "distance_threshold"], "left_semi").withColumnRenamed("pred", "pred_cluster")
        write_table(own, f"{path}/assignments_{name}", [c for c in columns if c in own.columns])
    both = selected.withColumn("which", F.lit("selected")).unionByName(diagnostic.withColumn("which", F.lit("oracle_diagnostic")))
    write_json_lines(both.withColumn("selection", F.lit("max_silhouette_over_average_linkage_agglomerative_threshold_grid")), f"{path}/summary")


def audit_rows(results: DataFrame) -> DataFrame:
    """Results with the first 4,000 characters of the answer, for a table of runs to debug."""
    return results.withColumn("last_content_preview", F.left(F.coalesce("content", F.lit("")), F.lit(4000))).drop("content")
