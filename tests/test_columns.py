from tidewash.operators.columns import (
    FieldSpec,
    apply_mapping,
    column_samples,
    dense_row_id,
    mapping_report,
    resolve_duplicates,
    unique_names,
    with_row_id,
)

SPEC = FieldSpec.parse(
    {
        "fields": {
            "Ram": {"aliases": ["ram", "memory_ram"]},
            "Weight": {"aliases": ["weight", "mass"]},
            "Price": {"aliases": ["cost", "product_price"]},
            "Company": {"aliases": ["brand"]},
            "Maker": {"aliases": ["brand"]},
        }
    }
)


def test_resolution_order():
    got = {n: SPEC.resolve(n) for n in ("Ram", "ram", "RAM", "product_price", "Screen", "memory_ram", "MASS", "brand")}
    assert got == {
        "Ram": ("Ram", "exact"), "ram": ("Ram", "alias"), "RAM": ("Ram", "case_insensitive"), "product_price": ("Price", "alias"),
        "Screen": ("Screen", "unmapped"), "memory_ram": ("Ram", "alias"), "MASS": ("Weight", "case_insensitive"), "brand": ("Maker", "alias"),
    }


def test_mapping_and_duplicates(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["ram", "WEIGHT", "Screen", "memory_ram"])
    report = {r["original"]: r["match_type"] for r in mapping_report(df, SPEC).collect()}
    assert report == {"ram": "alias", "WEIGHT": "case_insensitive", "Screen": "unmapped", "memory_ram": "alias"}
    mapped = resolve_duplicates(apply_mapping(df, SPEC))
    assert mapped.columns == ["Ram", "Weight", "Screen", "Ram_1"] and tuple(mapped.first()) == (1, 2, 3, 4)
    assert apply_mapping(df.limit(0), SPEC, check_empty=True).columns == df.columns


def test_unique_names_skips_taken_suffixes():
    names, renames = unique_names(["a", "a", "a_1", "a", None])
    assert names == ["a", "a_2", "a_1", "a_3", ""]
    assert [(r.position, r.before, r.after) for r in renames] == [(1, "a", "a_2"), (3, "a", "a_3")]


def test_row_numbers_are_dense(spark, tmp_path):
    spark.range(0, 1000, 1, 7).write.parquet(str(tmp_path / "t"))
    df = dense_row_id(with_row_id(spark.read.parquet(str(tmp_path / "t"))))
    rows = df.orderBy("_row_id").collect()
    assert [r["_row_id"] for r in rows] == list(range(1000))


def test_samples(spark):
    df = spark.createDataFrame([(2, "c"), (0, "a"), (1, None)], "_row_id long, s string")
    assert column_samples(df, 2) == {"s": ["a", None]}
