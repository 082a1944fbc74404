from cordon.lens import view


def test_parks_are_the_whole_part_table(spark, sf):
    assert view(spark, sf, "parks").count() == spark.read.parquet(f"{sf}/part.parquet").count()
