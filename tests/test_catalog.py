"""Every catalogue query against its SQL on the smallest tables; partition counts don't change results."""

import duckdb
import pandas as pd
import pytest

from chronoweave.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    def one(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return None
        if isinstance(v, bool):
            return v
        try:
            return round(float(v), 6)
        except (TypeError, ValueError):
            return str(v)

    columns = sorted(frame.columns)
    return columns, sorted((tuple(one(v) for v in r) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, name):
    got = catalog.queries()[name](spark, sf_dir)
    assert len(set(got.columns)) == len(got.columns)
    frame = got.toPandas()
    if name in catalog.oracle_sql():
        db = duckdb.connect()
        for t in TABLES:
            db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        assert rows(frame) == rows(db.execute(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["quiet_runs", "interval_overlap", "edl_positions"])
def test_partitions_do_not_matter(spark, sf_dir, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = rows(catalog.queries()[name](spark, sf_dir).toPandas())
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert rows(catalog.queries()[name](spark, sf_dir).toPandas()) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
