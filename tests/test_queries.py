"""Every registered query of the reference's operators against its SQL, or for rows where it has none."""

import pytest

from paperloom.plans import catalog
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, name):
    df = catalog.QUERIES[name](spark, tables)
    if name in catalog.ORACLE_SQL:
        same(df, catalog.ORACLE_SQL[name], tables)
    else:
        assert df.limit(1).count() == 1


@pytest.mark.parametrize("name", ["reciprocal_rank_fusion", "temporal_gaps", "co_citation"])
def test_partition_count_does_not_matter(spark, tables, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(str, catalog.QUERIES[name](spark, tables).collect())))
        assert found[0] == found[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
