"""Display values against exact decimals, result files with their commits and aborts."""

import os
import random
import struct
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import display as D
from tessera.sources import result_files as RF
from tessera.sources import results_io as IO


def _exact(x, digits):
    with localcontext() as c:
        c.prec = 1200
        size = Decimal(abs(x)).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP)
    return ("-" if x < 0 else "") + format(size, "f")


@pytest.mark.parametrize("digits", [0, 2, 3, 4])
def test_fixed_digits_are_those_of_the_exact_value(spark, digits):
    rng = random.Random(digits)
    values = [1.005, -1.005, 0.5, 1.5, 2.5, -0.5, 0.125, 0.375, 0.03125, -0.03125, 0.00005, -0.00005, 0.0, -0.0, 5e-324, 1e-9,
              0.99995, 0.99999999, 8.345, 1.45, 10.235, 1e7 + 0.125, 123456.00005]
    values += [rng.uniform(-1, 1) for _ in range(2000)] + [k / 10 ** (digits + 1) for k in range(-3005, 3005, 10)]
    values += [rng.randrange(1 << 20) / 1024 for _ in range(500)] + [
        v for v in (struct.unpack("d", rng.randbytes(8))[0] for _ in range(3000)) if abs(v) < 1e10]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", D.to_fixed(F.col("x"), digits).alias("s")).collect()
    assert [r.s for r in got] == [_exact(r.x, digits) for r in got]


def test_fixed_digits_of_no_number(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    assert [r[0] for r in df.select(D.to_fixed(F.col("x"), 2)).collect()] == [None, "NaN", "Infinity", "-Infinity"]
    shown = spark.createDataFrame([(-1.5,), (-1.0,), (0.3,), (None,)], "c double")
    assert [r[0] for r in shown.select(D.shown_contrast(F.col("c"))).collect()] == [-1.0, -1.0, 0.3, None]


def _nested(spark, docs, score):
    numbers = [c for c in IO.COHERENCE + IO.BOUNDARIES + IO.SEARCH]
    rows = [(m, d, f"id/{m}", *[score] * len(numbers), score) for d in docs for m in ("one", "two \"quoted\"")]
    schema = "model_name string, doc string, model_id string, " + ", ".join(f"{c} double" for c in numbers) + ", overall_score double"
    return IO.nest(spark.createDataFrame(rows, schema))


def _found(spark, path):
    return sorted((r.doc or "", r.model_name, r.overall_score) for r in RF.read_result_files(spark, path).collect())


def _want(docs, score):
    return sorted((d or "", m, score) for d in docs for m in ("one", "two \"quoted\""))


def test_result_files_are_replaced_and_added_to(spark, tmp_path):
    path = str(tmp_path / "results")
    with pytest.raises(Exception, match="no results were committed"):
        _found(spark, path)
    RF.write_result_files(_nested(spark, ["a", "bü\n", None], 0.1), path)
    assert _found(spark, path) == _want(["a", "bü\n", None], 0.1)
    RF.write_result_files(_nested(spark, ["c"], 1 / 3), path, "append")
    assert _found(spark, path) == sorted(_want(["a", "bü\n", None], 0.1) + _want(["c"], 1 / 3))
    for score in (0.25, 0.5, None):
        RF.write_result_files(_nested(spark, ["d"], score), path)
    assert _found(spark, path) == _want(["d"], None)
    left = [n for n in os.listdir(path) if n.startswith("part-")]
    assert len(left) == 2          # those of the last commit and of the one before
    RF.write_result_files(_nested(spark, ["d"], 0.5).limit(0), path)
    assert _found(spark, path) == []


def test_rows_are_split_over_files(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.dataSource.register(RF.ResultFiles)
    rows = spark.range(0, 250, 1, 4).select(F.col("id").cast("string").alias("doc"), F.lit("{}").alias("results_json"), "id")
    rows.write.format("tessera_results").mode("overwrite").option("rowsPerFile", 20).save(path)
    parts = [n for n in os.listdir(path) if n.startswith("part-")]
    assert len(parts) == 16 and max(sum(1 for _ in open(f"{path}/{n}")) for n in parts) == 20
    back = spark.read.format("tessera_results").load(path)
    assert sorted(int(r.doc) for r in back.collect()) == list(range(250)) and back.columns == ["doc", "results_json"]
    with pytest.raises(Exception, match="results_json"):
        rows.drop("results_json").write.format("tessera_results").mode("append").save(path)


def test_an_aborted_write_leaves_the_former_results(spark, tmp_path):
    path = str(tmp_path / "kept")
    RF.write_result_files(_nested(spark, ["a", "b"], 0.75), path)
    before = sorted(os.listdir(path))
    broken = spark.range(0, 200, 1, 4).select(
        F.col("id").cast("string").alias("doc"),
        F.when(F.col("id") == 199, F.raise_error(F.lit("row of a failing task"))).otherwise(F.lit("{}")).alias("results_json"))
    for mode in ("overwrite", "append"):
        with pytest.raises(Exception, match="failing task"):
            broken.write.format("tessera_results").mode(mode).save(path)
        assert sorted(os.listdir(path)) == before
    assert _found(spark, path) == _want(["a", "b"], 0.75)


def test_a_task_at_work_after_an_abort_leaves_nothing(tmp_path):
    path = str(tmp_path / "late")
    writer = RF.ResultWriter(path, True, 1)
    batch = pa.RecordBatch.from_pydict({"doc": ["a"], "results_json": ["{}"]})

    def rows():
        yield batch
        writer.abort([])
        yield batch
    with pytest.raises(OSError):
        writer.write(rows())
    assert os.listdir(path) == []
