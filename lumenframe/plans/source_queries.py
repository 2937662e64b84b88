"""Registered queries of sources and sinks: a driver table is written in a format and read back through its source."""

from __future__ import annotations

import json
import os
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..evidence import inventory, receipts
from ..functions.text import parse_integer, parse_number
from ..operators import select, stats
from ..session import shared_dir
from ..sources import arrays, delimited, ecsv, fits, plots, sinks
from ..streaming import batches
from .queries import query, r, table

BLOCK = 2880


def folder(spark: SparkSession) -> str:
    """A new folder that the driver and the executors share."""
    path = os.path.join(shared_dir(spark).removeprefix("file://"), f"lumen-files-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def _cards(cards: list[tuple[str, object]]) -> bytes:
    def card(key: str, value) -> str:
        shown = ("T" if value else "F").rjust(20) if isinstance(value, bool) else str(value).rjust(20) if not isinstance(value, str) else f"'{value:<8}'"
        return f"{key:<8}= {shown}".ljust(80)

    raw = "".join([card(*c) for c in cards] + ["END".ljust(80)]).encode()
    return raw.ljust(-(-len(raw) // BLOCK) * BLOCK)


def _fits(path: str, image: np.ndarray, columns: list[tuple[str, str, np.ndarray]]) -> str:
    """A file with an image of doubles and a binary table."""
    rows = len(columns[0][2])
    width = sum(a.dtype.itemsize * int(np.prod(a.shape[1:])) for _, _, a in columns)
    body = b"".join(b"".join(a[i : i + 1].tobytes() for _, _, a in columns) for i in range(rows))
    pad = lambda raw: raw.ljust(-(-len(raw) // BLOCK) * BLOCK, b"\0")
    head = _cards([("SIMPLE", True), ("BITPIX", -64), ("NAXIS", 1), ("NAXIS1", len(image))]) + pad(image.astype(">f8").tobytes())
    cards = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", width), ("NAXIS2", rows), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(columns))]
    for i, (name, form, _) in enumerate(columns, 1):
        cards += [(f"TTYPE{i}", name), (f"TFORM{i}", form)]
    with open(path, "xb") as f:
        f.write(head + _cards(cards) + pad(body))
    return path


def _customers(spark: SparkSession, d: str) -> str:
    """The customers, in the order of their keys, as FITS: balances as the image, and all as a table."""
    t = table(spark, d, "customer").orderBy("c_custkey").toArrow()
    key, nation, balance = (t.column(c).to_numpy() for c in ("c_custkey", "c_nationkey", "c_acctbal"))
    segment = np.array(t.column("c_mktsegment").to_pylist(), "S12")
    columns = [("CUSTKEY", "1K", key.astype(">i8")), ("NATION", "1J", nation.astype(">i4")), ("BALANCE", "1D", balance.astype(">f8")), ("SEGMENT", "12A", segment)]
    return _fits(os.path.join(folder(spark), "customer.fits"), balance, columns)


@query("SELECT p_partkey AS key, p_name AS name, p_retailprice AS price FROM part")
def csv_read_back(spark, d):
    path = os.path.join(folder(spark), "part")
    sinks.write_parts(table(spark, d, "part").select(F.col("p_partkey").cast("string"), "p_name", F.col("p_retailprice").cast("string")), path)
    rows = delimited.read(spark, path)
    return rows.select(parse_integer("p_partkey").cast("long").alias("key"), F.col("p_name").alias("name"), parse_number("p_retailprice").alias("price"))


@query('SELECT count(*) AS "count", round(sum(o_totalprice), 2) AS "sum", round(avg(o_totalprice), 6) AS mean, min(o_totalprice) AS "min", max(o_totalprice) AS "max" FROM orders')
def tsv_scan_stats(spark, d):
    path = os.path.join(folder(spark), "orders")
    sinks.write_parts(table(spark, d, "orders").select(F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string")), path, "\t")
    return delimited.scan_stats(spark, path, "o_totalprice", "\t").withColumns({"sum": r("sum", 2), "mean": r("mean")})


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS place, s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier")
def csv_export_order(spark, d):
    at = folder(spark)
    rows = stats.with_ordinal(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    path = sinks.export(rows, at, "supplier.csv", ["s_suppkey", "s_name"])
    return delimited.read(spark, path).select(F.col("_ord").alias("place"), "s_suppkey", "s_name")


@query("SELECT 's_suppkey' AS first_header, 2 AS n_columns, count(*) AS n_rows FROM supplier")
def csv_shape(spark, d):
    at = folder(spark)
    rows = table(spark, d, "supplier").orderBy("s_suppkey").select("s_suppkey", "s_name").collect()
    path = sinks.write_csv(at, "supplier.csv", 2, ["s_suppkey", "s_name", *[str(v) for x in rows for v in x]])
    return spark.createDataFrame([(delimited.headers(path)[0], delimited.columns(path), delimited.rows(spark, path))], "first_header string, n_columns int, n_rows long")


@query("SELECT c_custkey AS \"CUSTKEY\", c_nationkey AS \"NATION\", c_acctbal AS \"BALANCE\", c_mktsegment AS \"SEGMENT\" FROM customer")
def fits_table_read(spark, d):
    return fits.read(spark, _customers(spark, d), 1, bytes_per_partition=4096).select("CUSTKEY", "NATION", "BALANCE", "SEGMENT")


@query("SELECT count(*) AS valid_count, round(avg(c_acctbal), 6) AS mean, min(c_acctbal) AS \"min\", max(c_acctbal) AS \"max\" FROM customer")
def fits_column_stats(spark, d):
    return fits.column_stats(spark, _customers(spark, d), 1, "balance").withColumn("mean", r("mean"))


@query("SELECT 2 AS hdus, 4 AS n_columns, count(*) AS n_rows, count(*) AS n_pixels, round(avg(c_acctbal), 6) AS mean, arg_min(c_acctbal, c_custkey) AS first_pixel, arg_max(c_mktsegment, c_custkey) AS last_text FROM customer")
def fits_image_and_cells(spark, d):
    path = _customers(spark, d)
    n = fits.rows(path, 1)
    row = (fits.hdu_count(path), fits.columns(path, 1), n, fits.count(path), round(fits.mean(spark, path), 6), fits.pixel(spark, path, 0), fits.cell_text(spark, path, 1, "segment", n - 1))
    return spark.createDataFrame([row], "hdus int, n_columns int, n_rows long, n_pixels long, mean double, first_pixel double, last_text string")


@query("SELECT count(*) AS selected, count(*) AS used, count(*)::DOUBLE AS weight_sum, round(avg(c_acctbal), 6) AS mean FROM customer WHERE c_nationkey >= 3 AND c_nationkey < 9")
def fits_select_stats(spark, d):
    out = fits.select_stats(spark, _customers(spark, d), 1, "NATION", 3, 9, "BALANCE")
    return out.withColumns({"weight_sum": F.col("weight_sum").cast("double"), "mean": r("mean")})


@query("SELECT c_custkey::VARCHAR AS custkey, c_mktsegment AS segment FROM customer WHERE c_acctbal > 0 AND c_nationkey <> 7")
def fits_export_csv(spark, d):
    path = _customers(spark, d)
    rows = fits.select_rows(spark, path, 1, ["CUSTKEY", "SEGMENT"], select.all_of([select.where("BALANCE", ">", 0), select.where("NATION", "!=", 7)]))
    out = sinks.export(rows, os.path.dirname(path), "out.csv", ["CUSTKEY", "SEGMENT"])
    return delimited.read(spark, out).select(F.col("CUSTKEY").alias("custkey"), F.col("SEGMENT").alias("segment"))


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS idx, s_acctbal AS value FROM supplier")
def npy_numbers(spark, d):
    path = os.path.join(folder(spark), "balance.npy")
    np.save(path, table(spark, d, "supplier").orderBy("s_suppkey").toArrow().column("s_acctbal").to_numpy())
    return arrays.numbers(spark, arrays.npy_array(path))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS idx, n_name AS value FROM nation")
def npz_texts(spark, d):
    path = os.path.join(folder(spark), "nation.npz")
    t = table(spark, d, "nation").orderBy("n_nationkey").toArrow()
    np.savez(path, key=t.column("n_nationkey").to_numpy(), name=np.array(t.column("n_name").to_pylist()))
    return arrays.texts(spark, arrays.npz_array(path, arrays.npz_keys(path)[1]))


@query('SELECT s_nationkey::BIGINT AS "row", s_suppkey AS col, s_acctbal AS "value" FROM supplier')
def sparse_matrix(spark, d):
    path = os.path.join(folder(spark), "matrix.npz")
    t = table(spark, d, "supplier").toArrow()
    i, j, v = (t.column(c).to_numpy() for c in ("s_nationkey", "s_suppkey", "s_acctbal"))
    np.savez(path, format=np.array("coo"), shape=np.array([int(i.max()) + 1, int(j.max()) + 1]), data=v, row=i, col=j)
    return arrays.sparse(spark, path)[0].select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("value").cast("double"))


@query("SELECT s_suppkey AS s_suppkey, s_name, round(s_acctbal * 1000, 6) AS metres FROM supplier")
def ecsv_read_back(spark, d):
    rows = table(spark, d, "supplier").orderBy("s_suppkey").select("s_suppkey", "s_name", "s_acctbal").collect()
    head = ["# %ECSV 1.0", "# ---", "# delimiter: ','", "# datatype:", "# - {name: s_suppkey, datatype: int64}", "# - {name: s_name, datatype: string}", "# - {name: s_acctbal, unit: km, datatype: float64}"]
    path = sinks.write_text(folder(spark), "supplier.ecsv", [*head, "s_suppkey,s_name,s_acctbal", *[f"{k},{sinks.quote(n, ',')},{b!r}" for k, n, b in rows]])
    e = ecsv.Ecsv.open(path)
    return e.frame(spark).select("_ord", "s_suppkey", "s_name").join(e.numbers(spark, "s_acctbal"), "_ord").select(F.col("s_suppkey").cast("long"), "s_name", r("value").alias("metres"))


@query("SELECT count(*) AS n_rows, ceil(count(*) / 64.0)::BIGINT AS n_batches, round(sum(c_acctbal), 2) AS total FROM customer")
def csv_batches(spark, d):
    at = folder(spark)
    rows = table(spark, d, "customer").orderBy("c_custkey").select("c_custkey", "c_acctbal").collect()
    opened = batches.Batches()
    out = opened.write(at, "customer.csv", ["c_custkey", "c_acctbal"], 64 << 20)
    for lo in range(0, len(rows), 100):
        out.write([[str(k), repr(b)] for k, b in rows[lo : lo + 100]])
    out.close()
    source = opened.read(os.path.join(at, "customer.csv"), ["c_acctbal"], 64, 1 << 20, 64 << 20)
    sizes, total = [], stats.neumaier(np.zeros(0))
    for batch in source:
        sizes.append(len(batch))
        total = stats.neumaier(np.array([float(x) for (x,) in batch]), *total)
    source.close()
    opened.finish()
    return spark.createDataFrame([(sum(sizes), len(sizes), round(sum(total), 2))], "n_rows long, n_batches long, total double")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def stream_files(spark, d):
    at = folder(spark)
    table(spark, d, "orders").select("o_orderkey", "o_totalprice").repartition(6).write.parquet(f"{at}/in")
    batches.stream_copy(spark, f"{at}/in", ["o_orderkey", "o_totalprice"], f"{at}/out", files_per_batch=2)
    return spark.read.parquet(f"{at}/out")


@query("WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), b AS (SELECT least(floor((o_totalprice - lo) / (hi - lo) * 12), 11)::INT AS bin FROM orders, e) SELECT g.i::INT AS bin, count(b.bin) AS n FROM range(12) g(i) LEFT JOIN b ON b.bin = g.i GROUP BY 1")
def plot_histogram(spark, d):
    path = plots.histogram(table(spark, d, "orders"), "o_totalprice", 12, folder(spark), "price.svg", "orders", "price")
    with open(path + ".json", encoding="utf-8") as f:
        counts = json.load(f)["counts"]
    return spark.createDataFrame(list(enumerate(counts)), "bin int, n long")


@query("WITH t AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, * FROM customer), k AS (SELECT DISTINCT (i * ((SELECT count(*) FROM t) - 1)) // 49 AS i FROM range(50) g(i)) SELECT c_custkey::DOUBLE AS x, c_acctbal AS y FROM t JOIN k USING (i)")
def plot_fits_scatter(spark, d):
    path = _customers(spark, d)
    out = plots.fits_scatter(spark, path, 1, "CUSTKEY", "BALANCE", 50, os.path.dirname(path), "balance.svg", "balances")
    with open(out + ".json", encoding="utf-8") as f:
        side = json.load(f)
    number = lambda h: struct.unpack(">d", bytes.fromhex(h))[0]
    return spark.createDataFrame(pa.table({"x": [number(h) for h in side["x_bits"]], "y": [number(h) for h in side["y_bits"]]}))


@query("SELECT n_nationkey || '.txt' AS path, CASE WHEN n_regionkey = 0 THEN 'MISSING' WHEN n_regionkey = 1 THEN 'CONTENT_CHANGED' ELSE 'MATCH' END AS status FROM nation")
def folder_check(spark, d):
    before, after = folder(spark), folder(spark)
    for row in table(spark, d, "nation").collect():
        name, text = f"{row['n_nationkey']}.txt", row["n_name"]
        sinks.write_text(before, name, [text])
        if row["n_regionkey"]:
            sinks.write_text(after, name, [text * (2 if row["n_regionkey"] == 1 else 1)])
    return inventory.check(inventory.inventory(spark, before), inventory.inventory(spark, after)).select(F.col("key").alias("path"), "status")


@query("SELECT 0::BIGINT AS problems, 1::BIGINT AS entries, count(*) AS sealed FROM nation")
def run_receipt(spark, d):
    at = folder(spark)
    ledger = receipts.Ledger(os.path.join(at, "ledger.jsonl"))
    names = table(spark, d, "nation").select("n_name")
    with receipts.Run(at, "nations", ledger) as run:
        run.output(sinks.write_text(at, "names.txt", [x["n_name"] for x in names.orderBy("n_name").collect()]))
        run.seal("nations", names.count())
    sealed = receipts.load(run.folder)["seals"]["nations"]
    return spark.createDataFrame([(len(receipts.verify(run.folder)), len(ledger.audit()), sealed)], "problems long, entries long, sealed long")
