"""op12 against its SQL and against filters applied one after the other."""

from itertools import permutations

from pyspark.sql import functions as F

from paperloom.llm import filter_audit
from paperloom.llm import queries as llm
from tests.oracle import rows as as_rows
from tests.oracle import same

LONG = " ".join(f"word{i}" for i in range(60))


def applied(rows):
    """rows: (part, set of failed letters, good, toxic); every order run as a loop over documents."""
    out, parts = {}, {r[0] or "" for r in rows}
    for order in map("".join, permutations("ABCDE")):
        for part in parts:
            own = [r for r in rows if (r[0] or "") == part]
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                out[part, order, step] = [len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    shares = {}
    for (part, order, step), x in out.items():
        shares[part, order[step - 1]] = shares.get((part, order[step - 1]), 0) + x[1]
    return sorted((part, order, step, *x, shares[part, order[step - 1]]) for (part, order, step), x in out.items())


def test_rules_and_orders(spark):
    texts = {
        0: (LONG, ""), 1: (LONG + " x", ""), 2: (LONG, "E"), 3: ("few words", "A"), 4: (None, "A"), 5: ("", "AE"), 6: ("la " * 100, "B"), 7: (LONG.upper(), "C"),
        8: (LONG + " 5%", "D"), 9: ("AB | AB AB", "ABCD"), 10: ("few words", "AE"), 11: ("été " * 60, "B"), 12: (LONG + " É", ""),
    }
    source = ["s1", None, "s2", ""]
    rows = [(i, t, source[i % 4]) for i, (t, _) in texts.items()] + [(3, "few words", "s1"), (None, LONG, "s1")]
    failed = [set(f) for _, f in texts.values()] + [{"A"}, set()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("good", F.lit("x")).withColumn("A", F.lit("x")).withColumn("part", F.lit("x"))
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 0), (3, 1, 1), (9, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    marks = {2: (1, 0), 3: (1, 1), 9: (0, 1)}
    want = applied([(s, f, *marks.get(i, (0, 0))) for (i, _, s), f in zip(rows, failed)])
    got = filter_audit.filter_audit(filter_audit.judged_documents(docs, labels), list("ABCDE"), ["good", "toxic"])
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == want
    names = ["doc_id", "text", "source"]
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.select(*names).toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", labels.toPandas().astype({"doc_id": "Int64", "quality": "Int64"}))
    found = con.sql(filter_audit.OP12_SQL)
    assert as_rows(got.columns, want) == as_rows(found.columns, found.fetchall())


def test_no_rows_and_no_failures(spark):
    docs = spark.createDataFrame([(1, LONG, "s")], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    audit = lambda df: filter_audit.filter_audit(filter_audit.judged_documents(df, labels), list("ABCDE"), ["good", "toxic"]).collect()
    assert audit(docs.limit(0)) == []
    assert {tuple(r)[3:] for r in audit(docs)} == {(1, 0, 0, 0, 0, 0, 0)} and len(audit(docs)) == 600


def test_query(spark, tables):
    same(llm.QUERIES["op12_filter_audit"](spark, tables), llm.ORACLE_SQL["op12_filter_audit"], tables)
