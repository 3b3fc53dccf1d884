import pytest

from stallwise.sources import keyed


def rows_of(path, sql):
    with keyed.connect(path) as con:
        return con.execute(sql).fetchall()


def put(spark, path, rows, page=2, parts=1):
    frame = spark.createDataFrame(rows, "k long, name string, price double").coalesce(parts)
    frame.write.format("keyed_table").options(path=path, table="ads", key="k", page=page).mode("append").save()


@pytest.fixture
def path(spark, tmp_path):
    keyed.register(spark)
    keyed.create(f"{tmp_path}/t.db", "ads", "k INTEGER PRIMARY KEY, name TEXT NOT NULL, price REAL CHECK (price >= 0)")
    return f"{tmp_path}/t.db"


def test_upserts_and_failed_batches(spark, path):
    first = [(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0), (4, None, 4.0), (5, "e", 5.0)]
    put(spark, path, first)
    assert rows_of(path, "SELECT * FROM ads") == [(1, "a", 1.0), (2, "b", 2.0), (5, "e", 5.0)]
    ((n, error),) = rows_of(path, "SELECT n_rows, error FROM ads_failed")
    assert n == 2 and "NOT NULL" in error
    put(spark, path, first)  # again: the table stays
    put(spark, path, [(2, "B", None), (6, "f", 1.0), (7, "g", -1.0)], page=1, parts=3)
    assert rows_of(path, "SELECT * FROM ads") == [(1, "a", 1.0), (2, "B", None), (5, "e", 5.0), (6, "f", 1.0)]
    assert len(rows_of(path, "SELECT * FROM ads_failed")) == 3 and len(rows_of(path, "SELECT name FROM sqlite_master WHERE type = 'table'")) == 2


def test_a_job_that_ends_halfway_changes_nothing(spark, path):
    put(spark, path, [(1, "a", 1.0)])

    def breaks(batches):
        for batch in batches:
            yield batch
        raise RuntimeError("halfway")

    frame = spark.createDataFrame([(1, "x", 9.0), (2, "y", 9.0)], "k long, name string, price double").coalesce(1)
    with pytest.raises(Exception, match="halfway"):
        frame.mapInArrow(breaks, frame.schema).write.format("keyed_table").options(path=path, table="ads", key="k", page=1).mode("append").save()
    assert rows_of(path, "SELECT * FROM ads") == [(1, "a", 1.0)] and len(rows_of(path, "SELECT name FROM sqlite_master WHERE type = 'table'")) == 2


def test_pages_and_filters(spark, path):
    put(spark, path, [(i, f"n{i % 3}", float(i)) for i in range(1, 2138)], page=500)
    found = spark.read.format("keyed_table").options(path=path, table="ads", key="k", page=1000).load()
    assert found.rdd.getNumPartitions() == 3 and sorted(x["k"] for x in found.collect()) == list(range(1, 2138))
    assert found.filter("name = 'n1' and price > 1000 and k in (1, 1003, 1006, 7)").count() == 2 and found.filter("length(name) = 3").count() == 0
    reader = keyed._Reader({"path": path, "table": "ads", "key": "k"}, found.schema)
    left = list(reader.pushFilters([keyed.EqualTo(("name",), "n1"), keyed.In(("k",), (1, 4)), keyed.GreaterThan(("a", "b"), 1)]))
    assert len(left) == 1 and [x[0] for p in reader.partitions() for x in reader.read(p)] == [1, 4]
    empty = spark.read.format("keyed_table").options(path=path, table="ads_failed", key="job").load()
    assert empty.count() == 0
