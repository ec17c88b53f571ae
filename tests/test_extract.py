"""Tables behind the Data Source, and snapshot hashes by ranges."""

import datetime
import hashlib
import shutil

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from clinloom.sources import extract, snapshot


def duck(sql, folder, *tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return c.execute(sql).fetchall()


@pytest.mark.parametrize("split", [extract.SPLIT, 20_000])
def test_parquet_place_equals_sql(spark, sf_dir, split):
    keys = list(range(0, 4000, 7))
    where = [("o_orderstatus", "=", "F"), ("o_orderdate", ">=", "1995-01-01"), ("o_orderkey", "in", keys)]
    orders = extract.read_table(spark, "orders", ["o_orderkey", "o_orderpriority"], where, path=sf_dir, split=split)
    assert orders.columns == ["o_orderkey", "o_orderpriority"]
    expected = duck("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= '1995-01-01' AND o_orderkey % 7 = 0 AND o_orderkey < 4000", sf_dir, "orders")
    assert sorted(map(tuple, orders.collect())) == sorted(expected) and expected
    whole = extract.read_table(spark, "orders", path=sf_dir, split=split)
    assert whole.count() == duck("SELECT count(*) FROM orders", sf_dir, "orders")[0][0]
    # One relation, used twice with other filters of the plan, is right too.
    f, o = (whole.where(f"o_orderstatus = '{x}'") for x in "FO")
    assert f.union(o).count() == duck("SELECT count(*) FROM orders WHERE o_orderstatus IN ('F', 'O')", sf_dir, "orders")[0][0] and whole.count() > f.count()


def test_only_what_is_asked_for_is_read(spark, sf_dir):
    """Rows that don't meet the conditions and columns that aren't named never leave the scan."""
    where = [("o_orderstatus", "=", "F"), ("o_orderkey", ">", 100)]
    orders = extract.read_table(spark, "orders", ["o_orderkey"], where, path=sf_dir)
    expected = duck("SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey > 100", sf_dir, "orders")[0][0]
    orders.write.format("noop").mode("overwrite").save()
    plan = orders._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter (" not in plan and "o_totalprice" not in plan
    place, schema = extract.place_of({"path": sf_dir}), T.StructType([orders.schema["o_orderkey"]])
    (split,) = place.splits("orders", schema.names, [], None)
    batches = list(place.read(split, "orders", schema, [extract.Term(*t) for t in where], None))
    assert sum(b.num_rows for b in batches) == expected and {tuple(b.schema.names) for b in batches} == {("o_orderkey",)}


def test_sql_text():
    schema = T.StructType.fromDDL("a long, s string, d date, x array<int>, f double")
    terms = extract.terms_of([("a", "!=", 1), ("s", "not in", ["x'y", "z"]), ("s", "starts with", "q"), ("a", "IS NOT NULL"), ("d", "<", datetime.date(2020, 1, 2)), ("a", "in", [])], schema)
    assert extract.select("t.u", ["a", "s"], terms) == """SELECT "a", "s" FROM "t"."u" WHERE "a" <> 1 AND "s" NOT IN ('x''y', 'z') AND starts_with("s", 'q') AND "a" IS NOT NULL AND "d" < DATE '2020-01-02' AND FALSE"""
    assert extract.literal(True) == "TRUE" and extract.select("t", []) == 'SELECT NULL FROM "t"'
    for bad in (("a", "like", "x"), ("a", "=", None), ("b", "=", 1), ("x", "=", 1), ("a", "contains", "1"), ("d", "=", "no date"), ("f", "=", float("nan"))):
        with pytest.raises(extract.ExtractError):
            extract.terms_of([bad], schema)


def test_conditions_with_nulls_equal_spark(spark, tmp_path):
    """Every kind of condition over nulls, NaN and several row groups and files: the same rows as Spark's own reader gives."""
    n = 500
    table = pa.table({
        "k": pa.array([None if i % 9 == 0 else i % 37 for i in range(n)], pa.int64()), "s": pa.array([None if i % 5 == 0 else f"{'ab'[i % 2]}{i % 11}'x" for i in range(n)]),
        "f": pa.array([None if i % 7 == 0 else float("nan") if i % 3 == 0 else i / 4 for i in range(n)]), "d": pa.array([datetime.date(2020, 1, 1 + i % 28) for i in range(n)]),
    })
    (tmp_path / "t.parquet").mkdir()
    pq.write_table(table, tmp_path / "t.parquet" / "1.parquet", row_group_size=50)
    pq.write_table(table.select(["k", "s", "f"]), tmp_path / "t.parquet" / "2.parquet", row_group_size=500)  # a column is absent
    pq.write_table(table.slice(0, 0), tmp_path / "t.parquet" / "3.parquet")
    plain = spark.read.schema(extract.read_table(spark, "t", path=str(tmp_path)).schema).parquet(str(tmp_path / "t.parquet"))
    cases = [
        ([("k", "=", 3)], "k = 3"), ([("k", "!=", 3)], "k <> 3"), ([("k", "in", [1, 2, 36])], "k in (1, 2, 36)"), ([("k", "not in", [1, 2])], "k not in (1, 2)"), ([("k", "is null")], "k is null"), ([("k", "is not null")], "k is not null"),
        ([("s", "starts with", "a")], "s like 'a%'"), ([("s", "ends with", "x")], "s like '%x'"), ([("s", "contains", "1")], "s like '%1%'"), ([("s", "=", "a2'x")], "s = \"a2'x\""), ([("d", ">=", "2020-01-20")], "d >= date'2020-01-20'"), ([("d", "is null")], "d is null"),
        ([("k", "<", 5), ("s", ">", "b")], "k < 5 and s > 'b'"), ([("f", ">", 50)], "f > 50"), ([("f", "<=", 50.5)], "f <= 50.5"), ([("f", "!=", 1.25)], "f <> 1.25"), ([("k", "in", [])], "false"),
    ]
    spark.conf.set("spark.sql.parquet.filterPushdown", "false")  # Spark's own pushdown loses NaN, which statistics leave out
    for where, same in cases:
        own = extract.read_table(spark, "t", None, where, path=str(tmp_path), split=700)
        assert sorted(map(str, own.collect())) == sorted(map(str, plain.where(same).collect())), same
    spark.conf.unset("spark.sql.parquet.filterPushdown")
    assert extract.read_table(spark, "t", ["s"], [("k", "=", 3)], path=str(tmp_path)).columns == ["s"]


def test_byte_cap(spark, sf_dir):
    narrow = extract.read_table(spark, "lineitem", ["l_returnflag"], path=sf_dir, max_bytes=50_000)
    assert narrow.count() > 0
    wide = extract.read_table(spark, "lineitem", path=sf_dir, max_bytes=50_000)
    with pytest.raises(Exception, match="the cap is 50000"):
        wide.count()


def test_refusals(spark, sf_dir, tmp_path):
    for options, message in (({"table": "none", "path": sf_dir}, "does not exist"), ({"table": "orders"}, "needs a path"), ({"table": "orders", "place": "nowhere"}, "neither parquet"), ({"table": "orders", "place": "warehouse_client:connect", "folder": sf_dir, "shards": 2}, "needs shard_by")):
        with pytest.raises(extract.ExtractError, match=message):
            extract.read_table(spark, options.pop("table"), **options)
    with pytest.raises(extract.ExtractError, match="has no column nope"):
        extract.read_table(spark, "orders", ["nope"], path=sf_dir)
    (tmp_path / "e.parquet").mkdir()
    with pytest.raises(extract.ExtractError, match="no Parquet file"):
        extract.read_table(spark, "e", path=str(tmp_path))


@pytest.mark.parametrize("shards", [1, 3])
def test_warehouse(spark, sf_dir, tmp_path, shards):
    log = tmp_path / "log"
    place = {"place": "warehouse_client:connect", "folder": sf_dir, "log": log, "max_bytes": 1 << 30, "shards": shards, "shard_by": "o_orderkey"}
    orders = extract.read_table(spark, "orders", ["o_orderkey", "o_orderpriority"], [("o_orderpriority", "=", "1-URGENT")], **place)
    assert sorted(map(tuple, orders.collect())) == sorted(duck("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'", sf_dir, "orders"))
    asked = sorted(log.read_text().splitlines())
    assert len(asked) == shards and all(x.startswith(f"{1 << 30}|SELECT \"o_orderkey\", \"o_orderpriority\" FROM \"orders\" WHERE ") and "\"o_orderpriority\" = '1-URGENT'" in x for x in asked)


def test_warehouse_identity(sf_dir):
    place = {"place": "warehouse_client:connect", "folder": sf_dir}
    one = extract.warehouse_snapshot(["orders", "nation"], **place)
    assert one.startswith("warehouse-sha256:") and one == extract.warehouse_snapshot(["orders", "nation"], **place) != extract.warehouse_snapshot(["nation", "orders"], **place)
    with pytest.raises(extract.ExtractError, match="can't be identified"):
        extract.warehouse_snapshot(["region"], **place)
    with pytest.raises(extract.ExtractError, match="by the bytes"):
        extract.warehouse_snapshot(["orders"], path=sf_dir)


def plain_tree(files, size):
    text = ""
    for name, data in files:
        ranges = [data[i : i + size] for i in range(0, max(len(data), 1), size)]
        digest = hashlib.sha256(b"".join(hashlib.sha256(r).digest() for r in ranges)).hexdigest()
        text += f"{name}\n{len(data)}\n{digest}\n"
    return f"tree-sha256-{size}:{hashlib.sha256(text.encode()).hexdigest()}"


def test_tree_hash(spark, tmp_path):
    data = bytes(range(256)) * 40
    (tmp_path / "A.csv").write_bytes(data)
    (tmp_path / "B.csv").mkdir()
    for k, part in enumerate((b"", data[:1000], data[:1001])):
        (tmp_path / "B.csv" / f"part-{k}.csv").write_bytes(part)
    files = [("A", data), *((f"B/part-{k}.csv", p) for k, p in enumerate((b"", data[:1000], data[:1001])))]
    for size in (100, 1000, 1 << 20):
        assert snapshot.tree_hash(spark, str(tmp_path), ["A", "B"], size=size) == plain_tree(files, size)
    whole = snapshot.tree_hash(spark, str(tmp_path), ["A", "B"])
    shutil.copytree(tmp_path, tmp_path / "copy", ignore=shutil.ignore_patterns("copy"))
    assert snapshot.tree_hash(spark, f"file://{tmp_path}/copy", ["A", "B"]) == whole
    changed = bytearray(data)
    changed[5000] ^= 1
    (tmp_path / "copy" / "A.csv").write_bytes(changed)
    assert snapshot.tree_hash(spark, str(tmp_path / "copy"), ["A", "B"]) != whole != snapshot.tree_hash(spark, str(tmp_path), ["B", "A"])
    with pytest.raises(extract.ExtractError):
        snapshot.tree_hash(spark, str(tmp_path), ["C"])
