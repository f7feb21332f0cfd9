"""Readers: JSON arrays, JSON lines, catalog maps, split families, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INSTANCE_DDL = (
    "qid bigint, question string, sql string, "
    "schema struct<database:string,metadata:array<struct<name:string,columns:array<string>>>>"
)
DUMP_DDL = (
    "db_id string, table_names_original array<string>, table_names array<string>, "
    "column_names_original array<array<string>>, column_names array<array<string>>, "
    "column_types array<string>, primary_keys array<string>, foreign_keys array<array<int>>"
)
CATALOG_MAP_DDL = (
    "map<string,array<struct<name:string,normalized_name:string,"
    "columns:array<struct<name:string,normalized_name:string,type:string,"
    "primary_key:boolean,foreign_key:struct<`table`:string,`column`:string>>>>>>"
)


def read_instances(
    spark: SparkSession, paths: str | list[str], schema: str = INSTANCE_DDL
) -> DataFrame:
    """Records of one or more JSON-array files, concatenated."""
    return spark.read.schema(schema).json(paths, multiLine=True)


def read_jsonl(
    spark: SparkSession, paths: str | list[str], schema: str = INSTANCE_DDL
) -> DataFrame:
    """Records of line-delimited JSON files; splittable, so preferred at scale."""
    return spark.read.schema(schema).json(paths)


def read_catalog(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Flat columns from files that each hold one ``db -> tables`` map.

    A map file cannot be split, so large catalogs come as a folder of files.
    """
    files = spark.read.text(paths, wholetext=True)
    dbs = files.select(F.explode(F.from_json("value", CATALOG_MAP_DDL)).alias("db", "tables"))
    tables = dbs.select("db", F.posexplode("tables").alias("tbl_pos", "t"))
    return tables.select(
        "db",
        F.col("tbl_pos").cast("bigint").alias("tbl_pos"),
        F.col("t.name").alias("tbl"),
        F.col("t.normalized_name").alias("tbl_norm"),
        F.posexplode("t.columns").alias("col_pos", "c"),
    ).select(
        "db",
        "tbl_pos",
        "tbl",
        "tbl_norm",
        F.col("col_pos").cast("bigint").alias("col_pos"),
        F.col("c.name").alias("col"),
        F.col("c.normalized_name").alias("col_norm"),
        F.col("c.type").alias("type"),
        F.coalesce("c.primary_key", F.lit(False)).alias("is_pk"),
        F.col("c.foreign_key.table").alias("fk_tbl"),
        F.col("c.foreign_key.column").alias("fk_col"),
    )


def read_tables(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(db, tbl_pos, tbl, tbl_norm) of the same files, also of tables without columns."""
    files = spark.read.text(paths, wholetext=True)
    dbs = files.select(F.explode(F.from_json("value", CATALOG_MAP_DDL)).alias("db", "tables"))
    return dbs.select("db", F.posexplode("tables").alias("tbl_pos", "t")).select(
        "db",
        F.col("tbl_pos").cast("bigint").alias("tbl_pos"),
        F.col("t.name").alias("tbl"),
        F.col("t.normalized_name").alias("tbl_norm"),
    )


def read_split_family(
    spark: SparkSession,
    root: str,
    dataset: str,
    train_data: str = "synthetic",
    schema: str = INSTANCE_DDL,
    dev_as_train: tuple[str, ...] = (),
    multi_line: bool = True,
) -> DataFrame:
    """All splits of a dataset and its variants, with a ``split`` column.

    ``train_data`` picks the original files, the synthetic one or both. A
    variant named in ``dev_as_train`` trains on its ``dev.json`` instead. A split
    is a JSON-array file or, with ``multi_line`` off, a folder of JSON lines.
    """
    folder = F.regexp_extract(
        F.col("_metadata.file_path"), r"([^/]+)/(?:train|test|dev|synthetic)\.json(?:/|$)", 1
    )

    def load(paths: str | list[str]) -> DataFrame:
        frame = spark.read.schema(schema).json(paths, multiLine=multi_line)
        return frame.select("*", folder.alias("variant"))

    parts = []
    if train_data in ("original", "all"):
        train = load(f"{root}/{dataset}*/train.json")
        if dev_as_train:
            train = train.where(~F.col("variant").isin(*dev_as_train))
            train = train.unionByName(load([f"{root}/{v}/dev.json" for v in dev_as_train]))
        parts.append(train.withColumn("split", F.lit("train")))
    if train_data in ("synthetic", "all"):
        parts.append(
            load(f"{root}/{dataset}/synthetic.json").withColumn("split", F.lit("train"))
        )
    if not parts:
        raise ValueError(f"unknown train_data: {train_data}")
    suffix = F.substring(F.col("variant"), F.lit(len(dataset) + 2), F.length("variant"))
    parts.append(
        load(f"{root}/{dataset}*/test.json").withColumn(
            "split",
            F.when(F.col("variant") == dataset, F.lit("test")).otherwise(
                F.concat(F.lit("test_"), suffix)
            ),
        )
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_metrics_tree(
    spark: SparkSession, root: str, filename: str = "metrics.json"
) -> DataFrame:
    """(run, key, value text) of every metrics file below ``root``.

    A run is named by the last two folders of its path.
    """
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", filename)
        .text(root, wholetext=True)
    )
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)/[^/]+$", 1)
    return files.select(
        run.alias("run"),
        F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"),
    )
