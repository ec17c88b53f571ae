import pytest
from pyspark.sql import functions as F

from clinloom.llm import extendible_shards as x
from clinloom.llm import queries


def check(rows, limit):
    """Buckets cover the hash space once, each fits or is one row, and none could be less deep."""
    size, alone = {}, {}
    for r in rows:
        size[r["shard"]] = size.get(r["shard"], 0) + r["n_bytes"]
        alone[r["shard"]] = alone.get(r["shard"], 0) + 1
        assert len(r["shard"].split("+")[0]) == r["depth"]
    assert all(b <= limit or alone[s] == 1 for s, b in size.items())
    bits = sorted({s.split("+")[0] for s in size})
    assert not any(b.startswith(a) for a, b in zip(bits, bits[1:], strict=False))
    for s in bits:
        if s and len(s) < 60:
            parent = sum(b for t, b in size.items() if t.startswith(s[:-1]))
            assert parent > limit
    return size


@pytest.mark.parametrize("limit", [1, 50, 1000, 20_000, 10**9])
def test_limits(spark, limit):
    df = spark.range(3000).selectExpr("id as doc_id", "repeat('x', cast(id % 40 as int)) as text")
    rows = x.assign_shards(df, "doc_id", F.octet_length("text"), limit).collect()
    assert len(rows) == 3000
    if limit >= 50:
        size = check(rows, limit)
        assert len(size) == 1 or limit < 10**9


def test_one_key_goes_to_pages(spark):
    df = spark.range(2000).selectExpr("5L as doc_id", "repeat('x', cast(id % 90 as int)) as text")
    rows = x.assign_shards(df, "doc_id", F.octet_length("text"), 500).collect()
    assert len(rows) == 2000
    check(rows, 500)
    assert len({r["shard"] for r in rows}) < 3 * 2000 * 45 / 500


def test_a_hot_key_among_others(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 7L, id) as doc_id", "repeat('x', 20) as text")
    rows = x.assign_shards(df, "doc_id", F.octet_length("text"), 400).collect()
    assert len(rows) == 3000
    check(rows, 400)


def test_odd_rows(odd, empty):
    rows = x.assign_shards(odd, "doc_id", F.octet_length("text"), 5000).collect()
    assert len(rows) == odd.count()
    check(rows, 5000)
    assert x.assign_shards(empty, "doc_id", F.octet_length("text"), 10).count() == 0
    with pytest.raises(ValueError):
        x.assign_shards(odd, "doc_id", F.octet_length("text"), 0)


def test_written_shards(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assigned = x.assign_shards(docs, "doc_id", F.octet_length("text"), 60_000)
    x.write_shards(docs, assigned, "doc_id", str(tmp_path / "out"))
    back = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b")).where("b > 60000").count() == 0


def test_oracle(spark, sf_dir, monkeypatch):
    from compare import oracle, spark_rows

    monkeypatch.setattr(queries, "SHARD_BYTES", 50_000)
    sql = queries.ORACLE_SQL["op10_extendible_shards"].replace(str(8 << 20), "50000")
    assert spark_rows(queries.op10_extendible_shards(spark, sf_dir)) == oracle(sql, sf_dir)
    assert spark_rows(queries.op10_extendible_shards(spark, sf_dir))[1].total() == 200


def test_query(spark, sf_dir):
    out = queries.op10_extendible_shards(spark, sf_dir)
    check(out.collect(), queries.SHARD_BYTES)
    assert out.count() == 200 and "Python" not in out._jdf.queryExecution().executedPlan().toString()
