import duckdb
import pytest

from tallyloom.llm import mixing
from tests.llm.conftest import documents


def rows_of(df):
    return sorted(tuple(str(v) for v in r) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect())


def check(docs):
    pandas = docs.select("doc_id", "text", "source").toPandas().convert_dtypes()  # noqa: F841  read by DuckDB
    con = duckdb.connect()
    con.register("documents", pandas)
    expected = con.execute(mixing.SQL).fetchall()
    got = rows_of(mixing.mixture(docs))
    assert got == sorted(tuple(str(v) for v in r) for r in expected)
    return got


def test_against_sql(spark):
    rows = [(i, "w " * (i * 7 % 31 + 1), f"s{i % 7}" if i % 11 else None) for i in range(400)]
    check(documents(spark, rows))


def test_hot_and_tiny_sources(spark):
    rows = [(i, "w " * 5, "hot") for i in range(300)] + [(1000 + i, "v " * 2, f"tiny{i:02}") for i in range(12)]
    got = check(documents(spark, rows))
    for _, size, source_size, target, taken in got:
        assert float(target) <= 3 * int(source_size)
        assert int(taken) <= 3 * int(size)


def test_sums_come_near_the_targets(spark):
    rows = [(i, "w " * (1 + i % 13), f"s{i % 4}") for i in range(2000)]
    df = mixing.mixture(documents(spark, rows).withColumnRenamed("lang", "size"))
    sums = {}
    for r in df.collect():
        sums.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for (_, target), taken in sums.items():
        assert abs(sum(taken) - target) <= 13


def test_mixed_repeats_rows(spark, odd):
    assert mixing.mixed(odd).columns == odd.columns
    copies = {(r["doc_id"], r["size"]): r["copies"] for r in mixing.mixture(odd).collect()}
    counts = {}
    for r in mixing.mixed(odd).collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert counts.get(4, 0) == copies[4, 320_000] and counts.get(7, 0) == copies[7, 1]
    assert counts.get(5, 0) == 2 * copies[5, 3]


def test_odd_and_empty(spark, odd):
    assert len(check(odd)) == 10
    assert mixing.mixture(odd.limit(0)).collect() == []
    assert mixing.mixed(odd.limit(0)).collect() == []


@pytest.mark.parametrize("k", [1, 2])
def test_reruns_agree(spark, k):
    rows = [(i, f"word {i} " * (i % 5), f"s{i % 3}") for i in range(200)]
    assert rows_of(mixing.mixture(documents(spark, rows))) == rows_of(mixing.mixture(documents(spark, rows).repartition(k)))
