"""Readers, writers, registry and results consolidation on files."""

import json
import shutil
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import functions as F

from urlgauge.operators import results
from urlgauge.operators.clean import feed_urls, labelled_urls
from urlgauge.plans.pipeline import feature_tables, prepare
from urlgauge.sources import readers, registry, writers


def test_csv_reads_by_name_and_keeps_file_order(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(
        'Extra,Label,URL\n1, Bad ,b.com\n2,good,"a.com/x,""y"""\n3,GOOD,b.com\n4,,c.com\n5,bad,\n6,bad,nan\n',
        encoding="utf-8",
    )
    raw = readers.read_labelled_csv(spark, str(path))
    got = {r["url"]: (r["label"], r["source"]) for r in labelled_urls(raw).collect()}
    assert got == {"b.com": (1, "github"), 'a.com/x,"y"': (0, "github")}
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<Label:string,URL:string>" in plan


def test_csv_first_copy_wins_across_many_blocks(spark, tmp_path):
    path = tmp_path / "raw.csv"
    lines = [f"u{i % 700},{'bad' if i < 700 else 'good'}" for i in range(3000)]
    path.write_text("URL,Label\n" + "\n".join(lines) + "\n", encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        raw = readers.read_labelled_csv(spark, str(path))
        assert raw.rdd.getNumPartitions() > 4
        rows = labelled_urls(raw).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 700 and all(r["label"] == 1 for r in rows)


def test_csv_contract(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="nothing.csv"):
        readers.read_labelled_csv(spark, str(tmp_path / "nothing.csv"))
    path = tmp_path / "raw.csv"
    path.write_text("URL,Kind\na,b\n")
    with pytest.raises(ValueError, match="Label"):
        readers.read_labelled_csv(spark, str(path))


def test_feed_reads_odd_bytes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "feed.txt"
    path.write_bytes("a.com\r\n  b.com \n\n c.com\x0cd.com\n\xa0\na.com\n".encode() + b"e\xff.com\xc3\nnan\n\xef\xbf\xbdf\n")
    rows = feed_urls(readers.read_feed(spark, str(path))).collect()
    assert sorted(r["url"] for r in rows) == ["a.com", "b.com", "c.com", "d.com", "e.com", "�f"]
    assert {(r["label"], r["source"]) for r in rows} == {(1, "openphish")}


def test_prepare_writes_prunable_splits(spark, tmp_path):
    csv, feed = tmp_path / "raw.csv", tmp_path / "feed.txt"
    csv.write_text("URL,Label\n" + "\n".join(f"u{i}.com/login,{'bad' if i % 3 else 'good'}" for i in range(300)))
    feed.write_text("\n".join([f"u{i}.com/login" for i in range(20)] + [f"n{i}.com" for i in range(7)] * 2))
    splits = prepare(spark, str(csv), str(feed), str(tmp_path / "splits"))
    assert (splits.train.count(), splits.test.count()) == (240, 67)
    assert "PartitionFilters: [isnotnull(split" in splits.train._jdf.queryExecution().executedPlan().toString()
    train, test = feature_tables(splits.train, splits.test, str(tmp_path / "features"))
    assert train.columns[:3] == ["url", "label", "source"] and len(train.columns) == 25
    assert train.filter("kw_login = 1").count() == 240 and test.count() == 67


def test_error_slices_prune(spark, tmp_path):
    df = spark.createDataFrame([("a", "FP"), ("b", "TN"), ("c", "FP")], "url string, error_type string")
    writers.write_error_slices(df, str(tmp_path / "errors"))
    part = writers.read_error_slice(spark, str(tmp_path / "errors"), "FP")
    assert sorted(r["url"] for r in part.collect()) == ["a", "c"]
    assert writers.read_error_slice(spark, str(tmp_path / "errors")).count() == 3


def test_registry_picks_the_newest_complete_run(spark, tmp_path):
    root = str(tmp_path / "models")
    model = PipelineModel([SQLTransformer(statement="SELECT * FROM __THIS__")])
    with pytest.raises(FileNotFoundError, match="root"):
        registry.find_model(spark, root)
    registry.save_run(model, root, datetime(2024, 1, 2, 3, 4, 5))
    newest = registry.save_run(model, root, datetime(2024, 10, 1))
    # an interrupted save: a pipeline's metadata is committed before its stages
    half = tmp_path / "models" / "run_20250101_000000"
    shutil.copytree(f"{newest}/metadata", half / "metadata")
    again = registry.save_run(model, root, datetime(2024, 1, 2, 3, 4, 5))
    assert again.endswith("run_20240102_030405_0002") and registry.is_complete(spark, again)
    assert registry.find_model(spark, root).endswith(newest.rsplit("/", 1)[-1])
    flags = {r["run_id"]: r["valid"] for r in registry.list_runs(spark, root).collect()}
    assert flags == {
        "run_20240102_030405": True, "run_20240102_030405_0002": True, "run_20241001_000000": True, "run_20250101_000000": False,
    }
    assert registry.find_model(spark, newest) == newest  # a model folder given as the root
    with pytest.raises(FileNotFoundError, match="complete"):
        registry.find_model(spark, root, f"{root}/run_20250101_000000")
    payload = [("hybrid_results.json", json.dumps({"meta": {"bert_dir": "", "bert_model_dir": f"{root}/run_20240102_030405"}}))]
    recorded = registry.recorded_path(spark.createDataFrame(payload, "source_file string, payload string"), payload[0][0])
    assert registry.find_model(spark, root, recorded=recorded) == f"{root}/run_20240102_030405"
    assert registry.find_model(spark, root, recorded=f"{root}/gone").endswith("run_20241001_000000")
    assert len(registry.load_model(spark, root, newest).stages) == 1


MODEL = {"accuracy": 0.9, "precision": 0.8, "recall": 0.7, "f1": 0.75, "mcc": 0.5, "roc_auc": None, "pr_auc": "0.5"}


def store(folder, **files):
    for name, payload in files.items():
        (folder / f"{name}_results.json").write_text(json.dumps(payload, indent=2), encoding="utf-8")


def test_results_of_all_forms(spark, tmp_path):
    meta = {"n_train": 7, "n_train_sampled": 0, "n_test": 3, "positive_rate_train": 0.0, "pos_rate_train": 0.25}
    store(
        tmp_path,
        ml={"meta": meta, "results": [{"model": "A", **MODEL}, "noise", {**MODEL, "f1": None}]},
        ngram={"meta": {**meta, "model_name": "", "train_size": 9}, "metrics": {**MODEL, "f1": 0.1}},
        bert={"accuracy": "x", "f1": "0.99"},
    )
    rows = [r.asDict() for r in results.summarize(readers.read_metrics(spark, str(tmp_path))).collect()]
    assert [r["model"] for r in rows] == ["DistilBERT", "A", "CharTFIDF(2-3)+LogReg", "ML_Model"]
    bert, a, ngram, unnamed = rows
    assert bert["f1"] == 0.99 and bert["accuracy"] is None and bert["n_train"] is None
    assert (a["n_train"], a["n_test"], a["pos_rate_train"], a["roc_auc"], a["pr_auc"]) == (7, 3, 0.25, None, 0.5)
    assert ngram["n_train"] == 7 and unnamed["f1"] is None
    assert list(rows[0]) == list(results.SUMMARY_COLUMNS)


def test_results_of_a_bare_list(spark, tmp_path):
    store(tmp_path, ml=[{"model": "A", **MODEL}, 5])
    row = results.summarize(readers.read_metrics(spark, str(tmp_path))).collect()
    assert [(r["model"], r["n_train"]) for r in row] == [("A", None)]


def test_no_results_at_all(spark, tmp_path):
    summary = results.summarize(readers.read_metrics(spark, str(tmp_path)))
    with pytest.raises(RuntimeError, match="no metrics"):
        results.require_rows(summary)
    with pytest.raises(FileNotFoundError):
        readers.read_metrics(spark, str(tmp_path), skip_missing=False)


def test_summary_files(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.25, None), ("a", 0.5, 3)], "model string, f1 double, n bigint")
    writers.write_summary(df, str(tmp_path / "out"), [F.desc_nulls_last("f1")])
    text = "".join(p.read_text() for p in (tmp_path / "out" / "summary_md").glob("part-*"))
    assert text.splitlines() == ["| model | f1 | n |", "| --- | --- | --- |", "| a | 0.5000 | 3 |", "| b | 0.2500 |  |"]
    table = spark.read.option("header", True).csv(str(tmp_path / "out" / "summary_csv"))
    assert [tuple(r) for r in table.collect()] == [("a", "0.5", "3"), ("b", "0.25", None)]


def test_savers_of_one_second_never_meet(spark, tmp_path):
    model = PipelineModel([VectorAssembler(inputCols=["a"], outputCol="v")])
    at, root = datetime(2024, 1, 2, 3, 4, 5), str(tmp_path / "runs")
    with ThreadPoolExecutor(10) as pool:
        paths = list(pool.map(lambda _: registry.save_run(model, root, at), range(10)))
    assert len(set(paths)) == 10
    runs = registry.list_runs(spark, root).collect()
    assert len(runs) == 10 and all(r.valid for r in runs)
    assert {r.run_id for r in runs} == {"run_20240102_030405", *(f"run_20240102_030405_{k:04d}" for k in range(2, 11))}


def test_one_of_many_creates_a_file(spark, tmp_path):
    with ThreadPoolExecutor(12) as pool:
        for nth in range(5):
            made = list(pool.map(lambda _: registry.create_if_absent(spark, str(tmp_path / f"claims/{nth}")), range(12)))  # noqa: B023
            assert sum(made) == 1


def test_rows_follow_their_files(spark, tmp_path):
    """Places of files come from a listing, odd names included; blocks and empty files do not disturb them."""
    names = ["b c.csv", "a%20b.csv", "a.csv", "ä.csv", "z=1.csv"]
    for nth, name in enumerate(names):
        rows = "" if nth == 4 else "\n".join(f"http://{nth}.com/{i},bad" for i in range(200))
        (tmp_path / name).write_text(f"URL,Label\n{rows}\n" if rows else "URL,Label\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        rows = readers.read_labelled_csv(spark, str(tmp_path)).orderBy("ordinal").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 800 and len({r.ordinal for r in rows}) == 800
    files = [r.url.split("/")[2] for r in rows]
    order = [f"{names.index(n)}.com" for n in sorted(names[:4], key=lambda n: n.replace("%", "%25").replace(" ", "%20").encode())]
    assert [f for f, before in zip(files, [None, *files], strict=False) if f != before] == order
    assert all(int(r.url.rsplit("/", 1)[1]) == i % 200 for i, r in enumerate(rows))
