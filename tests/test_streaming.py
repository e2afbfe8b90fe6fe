from tidewash.operators.conversion import fit_conversions
from tidewash.operators.missing import fit_imputation
from tidewash.operators.outliers import outlier_limits
from tidewash.streaming import clean_stream


def test_kept_plan_on_a_stream(spark, tmp_path):
    known = spark.createDataFrame([(f"{i}GB", "a") for i in range(1, 9)], "size string, s string")
    conversions = fit_conversions(known)
    typed = conversions.apply(known)
    imputation = fit_imputation(typed.unionByName(spark.createDataFrame([(None, None)], typed.schema)))
    limits = outlier_limits(typed)
    arriving = spark.createDataFrame([("7GB", " b "), ("NA", None), ("900GB", "c")], known.schema)
    arriving.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(known.schema).parquet(str(tmp_path / "in"))
    query = (
        clean_stream(stream, conversions, imputation, limits).writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(7.0, "b"), (4.5, "a")}
