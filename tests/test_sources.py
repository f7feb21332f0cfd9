import json

from pyspark.sql import functions as F

from routewright.sources import readers, writers


def record(i, db="d"):
    return {"qid": i, "question": f"q{i}", "sql": "select 1", "schema": {"database": db, "metadata": [{"name": "t", "columns": ["a"]}]}, "extra": 1}


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(data, indent=2))


def test_json_arrays_and_lines(spark, tmp_path):
    put(tmp_path / "a.json", [record(1), record(2)])
    put(tmp_path / "b.json", [record(3)])
    rows = readers.read_instances(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")])
    assert sorted(r["qid"] for r in rows.collect()) == [1, 2, 3]
    (tmp_path / "dev.jsonl").write_text("\n".join(json.dumps(record(i)) for i in range(4)))
    back = readers.read_jsonl(spark, str(tmp_path / "dev.jsonl"))
    assert back.count() == 4 and back.first()["schema"]["metadata"][0]["columns"] == ["a"]


def test_catalog_map(spark, tmp_path):
    col = {"name": "id", "normalized_name": "id", "type": "number", "primary_key": True}
    fk = {"name": "x", "normalized_name": "x y", "type": "text", "foreign_key": {"table": "t", "column": "id"}}
    put(tmp_path / "schemas.json", {"d": [{"name": "t", "normalized_name": "T", "columns": [col]}, {"name": "u", "normalized_name": "U", "columns": [fk]}]})
    rows = {r["tbl"]: r for r in readers.read_catalog(spark, str(tmp_path / "schemas.json")).collect()}
    assert rows["t"]["is_pk"] is True and rows["t"]["fk_tbl"] is None and rows["t"]["tbl_pos"] == 0
    assert rows["u"]["is_pk"] is False and (rows["u"]["fk_tbl"], rows["u"]["fk_col"]) == ("t", "id")


def test_split_family(spark, tmp_path):
    put(tmp_path / "sp" / "train.json", [record(1)])
    put(tmp_path / "sp" / "synthetic.json", [record(2)])
    put(tmp_path / "sp" / "test.json", [record(3)])
    put(tmp_path / "sp_syn" / "train.json", [record(4)])
    put(tmp_path / "sp_syn" / "test.json", [record(5)])
    put(tmp_path / "sp_syn" / "dev.json", [record(6)])

    def splits(**kw):
        return {(r["split"], r["qid"]) for r in readers.read_split_family(spark, str(tmp_path), "sp", **kw).collect()}

    tests = {("test", 3), ("test_syn", 5)}
    assert splits() == {("train", 2)} | tests
    assert splits(train_data="original") == {("train", 1), ("train", 4)} | tests
    assert splits(train_data="all") == {("train", 1), ("train", 2), ("train", 4)} | tests
    assert splits(train_data="original", dev_as_train=("sp_syn",)) == {("train", 1), ("train", 6)} | tests


def test_metrics_tree(spark, tmp_path):
    put(tmp_path / "test" / "calm-sea" / "metrics.json", {"R@1": 0.5, "loss": 2})
    put(tmp_path / "test" / "calm-sea" / "other.json", {"R@1": 9})
    put(tmp_path / "fit" / "red-sun" / "metrics.json", {"loss": 1})
    rows = {(r["run"], r["key"]): r["value"] for r in readers.read_metrics_tree(spark, str(tmp_path)).collect()}
    assert rows == {("test/calm-sea", "R@1"): "0.5", ("test/calm-sea", "loss"): "2", ("fit/red-sun", "loss"): "1"}


def test_writers(spark, tmp_path):
    gold = spark.createDataFrame([(1, "select 1", "d")], "qid bigint, sql string, db string")
    writers.write_gold_tsv(gold, str(tmp_path / "gold"))
    assert spark.read.text(str(tmp_path / "gold")).first()["value"] == "select 1\td"
    lines = writers.scored_sql_lines(gold.select("qid", "sql"), gold.select("qid", "db"))
    assert lines.first()["line"] == "select 1\n\t----- bird -----\td"
    preds = spark.createDataFrame([("test", 1), ("test_syn", 2)], "split string, qid bigint")
    writers.write_predictions_by_split(preds, str(tmp_path / "pred"))
    assert (tmp_path / "pred" / "split=test_syn").is_dir()
    writers.write_json_arrays(spark.range(10).withColumnRenamed("id", "qid"), str(tmp_path / "arrays"), F.floor(F.col("qid") / 4))
    back = spark.read.schema("qid bigint").json(str(tmp_path / "arrays" / "*"), multiLine=True)
    assert sorted(r["qid"] for r in back.collect()) == list(range(10))
