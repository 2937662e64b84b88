import io
import json
import os
import struct
import zipfile
import zlib

import numpy as np
import pytest

from lumenframe.errors import ArrayRefusal, ArtifactRefusal, DataRefusal, LedgerRefusal, RandomRefusal
from lumenframe.evidence import access, inventory, joins, receipts
from lumenframe.operators import random, select
from lumenframe.sources import arrays, delimited, ecsv, fits, plots, sinks
from lumenframe.streaming.batches import Batches, FitsBatchReader, stream_copy


def put(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_delimited(spark, tmp_path):
    p = put(tmp_path / "a.csv", '﻿id,v\r\n0007,"a,b"\r\n 7,"say ""x""\n2"\r\n,π\r\n')
    df = delimited.read(spark, p).orderBy("_ord")
    assert [(r["id"], r["v"]) for r in df.collect()] == [("0007", "a,b"), (" 7", 'say "x"\n2'), ("", "π")]
    assert delimited.headers(p) == ["id", "v"] and delimited.rows(spark, p) == 3 and delimited.columns(p) == 2
    n = put(tmp_path / "n.tsv", "x\ty\n1\t2.5\n2\t1e1\n")
    row = delimited.scan_stats(spark, n, "y", "\t").first()
    assert (row["count"], row["sum"], row["min"], row["max"]) == (2, 12.5, 2.5, 10.0)
    with pytest.raises(Exception, match="G601"):
        delimited.numbers(spark, p, "v").collect()


@pytest.mark.parametrize("bad", ["", "a,a\n1,2\n", "a,\n1,2\n", "a,b\n1\n", "a,b\n1,2,3\n", 'a\n"x\n', 'a\nx"y"\n', 'a\n"x"y\n', "a\nx\0\n", "a\rb\n", b"a\n\xff\n", "a,b\n\n"])
def test_delimited_refuses(spark, tmp_path, bad):
    p = put(tmp_path / "bad.csv", bad)
    with pytest.raises(Exception, match="G601"):
        delimited.read(spark, p).count()


def card(key, value):
    if isinstance(value, bool):
        v = ("T" if value else "F").rjust(20)
    elif isinstance(value, str):
        v = f"'{value}'"
    else:
        v = str(value).rjust(20)
    return f"{key:8}= {v}".ljust(80)


def block(cards):
    text = "".join(card(k, v) for k, v in cards) + "END".ljust(80)
    return text.ljust(-(-len(text) // 2880) * 2880).encode()


def padded(data):
    return data + bytes(-len(data) % 2880)


def table_file(path, columns, rows, data):
    width = len(data) // rows if rows else 0
    cards = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", width), ("NAXIS2", rows), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(columns))]
    for i, c in enumerate(columns, 1):
        cards += [(f"{k}{i}", v) for k, v in c.items()]
    primary = block([("SIMPLE", True), ("BITPIX", 16), ("NAXIS", 2), ("NAXIS1", 2), ("NAXIS2", 2), ("BSCALE", 2.0), ("BZERO", 1.0), ("BLANK", 4)]) + padded(struct.pack(">4h", 1, 2, 3, 4))
    return put(path, primary + block(cards) + padded(data))


COLUMNS = [{"TTYPE": "SOURCE_ID", "TFORM": "1K"}, {"TTYPE": "Z", "TFORM": "1D"}, {"TTYPE": "QUALITY", "TFORM": "1I", "TNULL": -999}, {"TTYPE": "OBJECT", "TFORM": "8A"}, {"TTYPE": "VALID", "TFORM": "1L"}, {"TTYPE": "SCALED", "TFORM": "1I", "TSCAL": 0.5, "TZERO": 1.0, "TNULL": -999, "TUNIT": "m"}, {"TTYPE": "PAIR", "TFORM": "2J"}]


def rows_of(items):
    return b"".join(struct.pack(">qdh8scHii", i, z, q, o, v, s & 0xFFFF, a, b) for i, z, q, o, v, s, a, b in items)


def test_fits(spark, tmp_path):
    data = rows_of([(2**53 + 1, 1.5, 3, b"a,b", b"T", 2, 1, 2), (-(2**63), float("nan"), -999, b'q"', b"F", -999, 3, 4), (7, -0.5, 4, b"", b"?", 4, 5, 6)])
    p = table_file(tmp_path / "t.fits", COLUMNS, 3, data)
    assert fits.hdu_count(p) == 2 and fits.rows(p, 1) == 3 and fits.columns(p, 1) == 7 and fits.axis(p, 1) == 2 and fits.count(p) == 4
    df = fits.read(spark, p, 1, bytes_per_partition=40).orderBy("_ord")
    got = [tuple(r) for r in df.collect()]
    assert got[0] == (0, 2**53 + 1, 1.5, 3, "a,b", True, 2.0, [1, 2])
    assert got[1] == (1, -(2**63), None, None, 'q"', False, None, [3, 4])
    assert got[2][5] is None and got[2][6] == 3.0
    assert fits.cell_text(spark, p, 1, "source_id", 0) == str(2**53 + 1) and fits.cell(spark, p, 1, "pair", 2, 1) == 6
    with pytest.raises(DataRefusal):
        fits.cell(spark, p, 1, "SOURCE_ID", 0)
    with pytest.raises(DataRefusal):
        fits.cell(spark, p, 1, "Z", 1)
    assert fits.pixel(spark, p, 1) == 5.0 and fits.mean(spark, p) == 5.0
    with pytest.raises(DataRefusal):
        fits.pixel(spark, p, 3)
    stat = fits.column_stats(spark, p, 1, "Z").first()
    assert (stat["valid_count"], stat["min"], stat["max"]) == (2, -0.5, 1.5)
    assert fits.select_stats(spark, p, 1, "QUALITY", 3, 5, "Z").first()["mean"] == 0.5
    out = sinks.export(fits.select_rows(spark, p, 1, ["OBJECT", "Z"], select.where("QUALITY", "!=", 4)), str(tmp_path), "out.csv", ["OBJECT", "Z"])
    assert open(out, encoding="utf-8").read() == 'OBJECT,Z\n"a,b",1.5\n'
    assert fits.header(p, "BSCALE") == 2.0
    r = FitsBatchReader(p, 1, ["OBJECT", "z", "SOURCE_ID", "VALID"], 2, 1000, 1 << 20)
    assert [row for batch in r for row in batch] == [["a,b", "1.5", str(2**53 + 1), "T"], ['q"', "\\N", str(-(2**63)), "F"], ["", "-0.5", "7", "\\N"]]
    r.close()
    h = plots.fits_histogram(spark, p, 1, "Z", 2, 3, str(tmp_path), "z.svg", "z")
    assert json.load(open(h + ".json", encoding="utf-8"))["counts"] == [1, 1]
    assert os.path.exists(plots.fits_scatter(spark, p, 1, "source_id", "Z", 3, str(tmp_path), "s.svg", "s"))


def test_fits_reads_only_the_wanted_rows(spark, tmp_path):
    data = rows_of([(i, float(i), i % 100, b"x", b"T", 1, i, i) for i in range(1000)])
    p = table_file(tmp_path / "many.fits", COLUMNS, 1000, data)
    table = lambda: fits._TableReader(p, fits.unit(p, 1), fits.unit(p, 1).columns, fits.T.StructType([]), 64)
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    r = table()
    assert list(r.pushFilters([EqualTo(("_ord",), 700), EqualTo(("Z",), 1.0)])) == [EqualTo(("Z",), 1.0)] and [(x.first, x.count) for x in r.partitions()] == [(700, 1)]
    r = table()
    assert list(r.pushFilters([GreaterThan(("_ord",), 899), LessThanOrEqual(("_ord",), 989)])) == [] and [(x.first, x.count) for x in r.partitions()] == [(900, 64), (964, 26)]
    r = table()
    list(r.pushFilters([EqualTo(("_ord",), 5000)]))
    assert [x.count for x in r.partitions()] == [0]
    df = fits.read(spark, p, 1, bytes_per_partition=4000)
    assert fits.cell(spark, p, 1, "SOURCE_ID", 637) == 637 and df.where("_ord >= 250 and _ord < 270 and QUALITY > 60").count() == 9
    assert df.where("_ord = 1000").count() == 0 and df.where("_ord < 0").count() == 0 and fits.pixel(spark, p, 2) == 7.0


def test_fits_cells_without_pushdown(plain, tmp_path):
    p = table_file(tmp_path / "many.fits", COLUMNS, 1000, rows_of([(i, float(i), i % 100, b"x", b"T", 1, i, i) for i in range(1000)]))
    assert fits.cell(plain, p, 1, "SOURCE_ID", 637) == 637 and fits.read(plain, p, 1).where("_ord >= 250 and _ord < 270 and QUALITY > 60").count() == 9
    assert [r["_ord"] for r in fits.read(plain, p, 1, bytes_per_partition=40, only=999).collect()] == [999]
    for row in (-1, 1000):
        with pytest.raises(DataRefusal):
            fits.cell(plain, p, 1, "SOURCE_ID", row)


def test_fits_refuses(tmp_path, spark):
    good = rows_of([(1, 1.0, 1, b"x", b"T", 1, 1, 1)])
    twice = [dict(COLUMNS[0]), dict(COLUMNS[1], TTYPE="source_id"), *COLUMNS[2:]]
    p = table_file(tmp_path / "d.fits", twice, 1, good)
    with pytest.raises(DataRefusal):
        fits.unit(p, 1).column("SOURCE_ID")
    q = table_file(tmp_path / "v.fits", [{"TTYPE": "P", "TFORM": "1P"}], 1, bytes(8))
    with pytest.raises(DataRefusal):
        fits.unit(q, 1).column("P")
    with pytest.raises(DataRefusal):
        fits.hdus(put(tmp_path / "short.fits", (tmp_path / "d.fits").read_bytes()[:-2880]))


def test_arrays(spark, tmp_path):
    c = np.arange(1.0, 7).reshape(2, 3)
    for name, a in (("c", c), ("f", np.asfortranarray(c))):
        np.save(tmp_path / f"{name}.npy", a)
        got = arrays.npy_array(str(tmp_path / f"{name}.npy"))
        assert arrays.shape(got) == [2, 3] and [r["value"] for r in arrays.numbers(spark, got).orderBy("idx").collect()] == [1.0, 2, 3, 4, 5, 6]
    ids = np.array([9007199254740993, 18446744073709551615], "<u8")
    with pytest.raises(DataRefusal):
        arrays.numbers(spark, ids)
    assert [r["value"] for r in arrays.texts(spark, ids).orderBy("idx").collect()] == ["9007199254740993", "18446744073709551615"]
    assert [r["value"] for r in arrays.texts(spark, np.array(["Ada π", "科学", ""])).orderBy("idx").collect()] == ["Ada π", "科学", ""]
    np.savez_compressed(tmp_path / "z.npz", x=c, y=np.array([True, False]))
    assert arrays.npz_keys(str(tmp_path / "z.npz")) == ["x", "y"] and arrays.npz_array(str(tmp_path / "z.npz"), "x").tolist() == c.tolist()
    buf = io.BytesIO()
    np.save(buf, np.array([{}], object), allow_pickle=True)
    for bad in (buf.getvalue(), b"no array"):
        with pytest.raises(DataRefusal):
            arrays.parse_npy(bad)
    with pytest.raises(DataRefusal):
        np.save(tmp_path / "nan.npy", np.array([np.nan]))
        arrays.npy_array(str(tmp_path / "nan.npy"))


def sparse_file(path, **members):
    with zipfile.ZipFile(path, "w") as z:
        for k, v in members.items():
            b = io.BytesIO()
            np.save(b, np.asarray(v))
            z.writestr(f"{k}.npy", b.getvalue())
    return str(path)


def test_sparse(spark, tmp_path):
    data = [1.0, 2, 3, 4]
    files = [
        sparse_file(tmp_path / "csr.npz", format=np.bytes_("csr"), shape=[3, 4], data=data, indices=[1, 3, 0, 2], indptr=[0, 2, 3, 4]),
        sparse_file(tmp_path / "csc.npz", format=np.bytes_("csc"), shape=[3, 4], data=[3.0, 1, 4, 2], indices=[1, 0, 2, 0], indptr=[0, 1, 2, 3, 4]),
        sparse_file(tmp_path / "coo.npz", format=np.bytes_("coo"), shape=[3, 4], data=data, row=[0, 0, 1, 2], col=[1, 3, 0, 2]),
    ]
    for f in files:
        df, shape, _ = arrays.sparse(spark, f)
        assert [r["value"] for r in arrays.dense(df, shape).orderBy("idx").collect()] == [0, 1, 0, 2, 3, 0, 0, 0, 0, 0, 4, 0]
        assert [r["value"] for r in arrays.sparse_row(df, shape, 2).orderBy("idx").collect()] == [0, 0, 4, 0]
    with pytest.raises(DataRefusal):
        arrays.sparse(spark, sparse_file(tmp_path / "two.npz", format=np.bytes_("coo"), shape=[3, 4], data=[1.0, 2], row=[0, 0], col=[1, 1]))


ECSV = "# %ECSV 1.0\n# ---\n# datatype:\n# - {name: d, unit: km, datatype: float32}\n# - {name: v, unit: m / s, datatype: float64}\n# - {name: i, datatype: uint64}\n# - {name: b, datatype: bool}\n# - {name: s, datatype: string}\n# schema: astropy-2.0\nd v i b s\n1.25 3.0 9007199254740993 True \"Ada π\"\n2.5 4.0 18446744073709551615 False x\n"


def test_ecsv(spark):
    e = ecsv.Ecsv(ECSV)
    assert e.headers() == ["d", "v", "i", "b", "s"] and e.unit("v") == "m / s" and e.dtype("i") == "uint64"
    assert [r["value"] for r in e.numbers(spark, "d").orderBy("_ord").collect()] == [1250.0, 2500.0]
    assert [str(r["i"]) for r in e.frame(spark).orderBy("_ord").collect()] == ["9007199254740993", "18446744073709551615"]
    assert ecsv.unit_factor("kg m**2 / (s^2 K)") == (1.0, (1, 2, -2, -1, 0, 0))
    for bad in (ECSV.replace("km", "Jy"), ECSV.replace("True", '""'), ECSV.replace("9007199254740993", "-1"), ECSV.replace("1.0\n", "2.0\n", 1), ECSV.replace("d v i", "d w i")):
        with pytest.raises(DataRefusal):
            ecsv.Ecsv(bad)


def test_sinks(spark, tmp_path):
    d = str(tmp_path)
    assert open(sinks.write_csv(d, "a.csv", 2, ["x", "y,z", "q\"", ""]), encoding="utf-8").read() == 'x,"y,z"\n"q""",\n'
    assert open(sinks.write_tsv(d, "a.tsv", 2, ["a\tb", "c\nd"]), encoding="utf-8").read() == "a b\tc d\n"
    assert json.load(open(sinks.write_json(d, "a.json", [("k", 1)]), encoding="utf-8")) == {"k": 1}
    for f in (lambda: sinks.write_text(d, "a.csv", []), lambda: sinks.write_text(d, "../x", []), lambda: sinks.write_csv(d, "b.csv", 2, ["x"]), lambda: sinks.write_json(d, "b.json", [("k", 1), ("k", 2)])):
        with pytest.raises(ArtifactRefusal):
            f()
    p = plots.histogram(spark.range(10).selectExpr("cast(id as double) x"), "x", 3, d, "h.svg", "t", "x")
    assert json.load(open(p + ".json", encoding="utf-8"))["counts"] == [3, 3, 4]
    assert open(plots.line(d, "l.svg", [1.0, 2], [3.0, 4], "a<b", "x", "y"), encoding="utf-8").read().count("a&lt;b") == 1


def test_batches(tmp_path):
    p = put(tmp_path / "in.csv", "a,b,c\n" + "".join(f"{i},{'x' * (i % 7)},z\n" for i in range(50)))
    run = Batches()
    r, w = run.read(p, ["a", "b"], 8, 1000, 1 << 20), run.write(str(tmp_path), "out.csv", ["a", "b"], 1 << 20)
    with pytest.raises(DataRefusal):
        r.close()
    for batch in r:
        assert len(batch) <= 8
        n = w.write(batch)
    r.close()
    w.close()
    run.finish()
    assert n == 50 and (tmp_path / "out.csv").read_text().splitlines()[50] == "49,"
    left = run.write(str(tmp_path), "late.csv", ["a"], 1 << 20)
    left.write([["1"]])
    with pytest.raises(DataRefusal):
        run.finish()
    assert (tmp_path / "late.csv.partial").exists()


def test_stream_copy(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.range(100).selectExpr("id", "id * 2 as v", "'x' as s").repartition(5).write.parquet(src)
    assert stream_copy(spark, src, ["id", "v"], out, lambda df: df.where("id >= 10"), files_per_batch=2) == 90
    assert stream_copy(spark, src, ["id", "v"], out, lambda df: df.where("id >= 10"), files_per_batch=2) == 90


def test_evidence(spark, tmp_path):
    src = put(tmp_path / "in.txt", "data")
    book = receipts.Ledger(str(tmp_path / "ledger.jsonl"))
    folders = []
    for _ in range(2):
        with receipts.Run(str(tmp_path), "run", book) as run:
            run.input(src)
            run.seal("rows", spark.range(10).repartition(3))
            run.seal("mean", 4.5)
            assert run.time_date() == run.time_date()
            with pytest.raises(ArtifactRefusal):
                run.seal("mean", 1)
        folders.append(run.folder)
    a, b = (receipts.load(f) for f in folders)
    assert receipts.diff(a, b)["verdict"] == "IDENTICAL" and receipts.verify(folders[0]) == [] and len(book.audit()) == 2
    receipts.freeze(folders[0], "first")
    receipts.revise(folders[1], folders[0], "again")
    assert receipts.lineage(folders) == [a["run"], b["run"]]
    (tmp_path / "in.txt").write_text("other")
    assert len(receipts.verify(folders[0])) == 1
    lines = open(book.path, encoding="utf-8").read().replace("passed", "failed", 1)
    open(book.path, "w", encoding="utf-8").write(lines)
    with pytest.raises(LedgerRefusal):
        book.audit()


def test_png_plots(spark, tmp_path):
    d = str(tmp_path)
    made = [plots.scatter(d, "s.png", [0.0, 1, 2], [5.0, 3, 9], "dots", "x", "y"), plots.line(d, "l.png", [0.0, 1, 2], [5.0, 3, 9], "path", "x", "y"), plots.histogram(spark.range(10).selectExpr("cast(id as double) x"), "x", 3, d, "h.png", "bars", "x"), plots.line(d, "l.svg", [0.0, 1], [5.0, 3], "p", "x", "y")]
    dark = []
    for path in made[:3]:
        raw = open(path, "rb").read()
        at, idat = 8, b""
        while at < len(raw):
            n, kind = struct.unpack(">I4s", raw[at : at + 8])
            assert zlib.crc32(raw[at + 4 : at + 8 + n]) == struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0]
            idat += raw[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
            at += 12 + n
        image = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(400, 641)
        assert not image[:, 0].any() and image[10, 10] == 255
        dark.append(int((image[:, 1:] < 200).sum()))
    assert dark[0] < dark[1] < dark[2]
    assert [plots.provenance(p)["kind"] for p in made] == ["scatter", "line", "histogram", "line"]
    again = plots.scatter(d, "again.png", [0.0, 1, 2], [5.0, 3, 9], "dots", "x", "y")
    assert open(again, "rb").read() == open(made[0], "rb").read()
    side = json.load(open(made[3] + ".json", encoding="utf-8"))
    put(tmp_path / "l.svg.json", json.dumps(side | {"title": "other"}))
    with pytest.raises(DataRefusal):
        plots.provenance(made[3])


def test_inventory(spark, tmp_path):
    d = tmp_path / "d"
    os.makedirs(d / "sub")
    for name, text in (("a.txt", "1"), ("sub/b.txt", "2"), ("gone.txt", "4"), ("linked.txt", "5")):
        put(d / name, text)
    before = spark.createDataFrame(inventory.inventory(spark, str(d)).collect(), inventory.SCHEMA)
    assert inventory.verdict(inventory.check(before, inventory.inventory(spark, str(d)))) == "MATCH"
    put(d / "a.txt", "changed")
    put(d / "c.txt", "3")
    os.unlink(d / "gone.txt")
    os.unlink(d / "linked.txt")
    os.symlink(d / "a.txt", d / "linked.txt")
    after = inventory.inventory(spark, str(d))
    got = {r["key"]: r["status"] for r in inventory.check(before, after).collect()}
    assert got == {"a.txt": "CONTENT_CHANGED", "sub/b.txt": "MATCH", "c.txt": "ADDED", "gone.txt": "MISSING", "linked.txt": "UNSUPPORTED"}
    other = spark.createDataFrame([("sub", None, None, "NOT_LISTED"), ("a.txt", None, None, "UNSTABLE_DURING_READ"), ("c.txt", None, None, "UNREADABLE")], inventory.SCHEMA)
    results = inventory.check(before, other)
    assert {r["key"]: r["status"] for r in results.collect()} == {"a.txt": "UNSTABLE_DURING_READ", "c.txt": "UNREADABLE", "sub/b.txt": "NOT_OBSERVED", "gone.txt": "NOT_OBSERVED", "linked.txt": "NOT_OBSERVED"}
    assert inventory.verdict(results) == "INCOMPLETE"


def test_observation_of_a_file_that_changes(tmp_path, monkeypatch):
    p = put(tmp_path / "x", "1" * 10)
    assert inventory._observe(p)[2] == "OBSERVED" and inventory._observe(str(tmp_path / "no"))[2] == "UNREADABLE" and inventory._observe(str(tmp_path))[2] == "UNSUPPORTED"
    stat, calls = os.stat, []

    def later(path, **kw):
        calls.append(path)
        if len(calls) == 2:
            put(tmp_path / "x", "2" * 11)
        return stat(path, **kw)

    monkeypatch.setattr(inventory.os, "stat", later)
    assert inventory._observe(p) == (None, None, "UNSTABLE_DURING_READ")


def test_access_and_parameters(tmp_path):
    a = access.Access(files=2, calls=4)
    a.open(str(tmp_path / "x.csv"), "csv")
    a.open(str(tmp_path / "." / "x.csv"), "csv")
    with pytest.raises(DataRefusal):
        a.open(str(tmp_path / "x.csv"), "fits")
    a.open(str(tmp_path / "y.csv"), "csv")
    with pytest.raises(DataRefusal):
        a.open(str(tmp_path / "z.csv"), "csv")
    a.open(str(tmp_path / "y.csv"), "csv")
    with pytest.raises(DataRefusal):
        a.open(str(tmp_path / "y.csv"), "csv")
    p = access.Parameters(["one", "two"], ["yes"])
    assert p.evidence()["arguments"] is None and (p.argc(), p.argv(1), p.input("really?")) == (2, "two", "yes")
    for f in (lambda: p.argv(2), lambda: p.argv(-1), lambda: p.input(), lambda: access.Parameters().input(), lambda: access.Parameters(["x"] * 100)):
        with pytest.raises(ArrayRefusal):
            f()
    assert p.evidence() == {"arguments": ["one", "two"], "answers": [{"prompt": "really?", "answer": "yes"}]}


def test_traces():
    def half(x):
        return x / 2

    one, two = access.Trace(), access.Trace()
    for t in (one, two):
        f = t.traced(half)
        assert [f(x) for x in (1, 2)] == [0.5, 1.0]
    assert one.evidence() == two.evidence() and one.evidence()["half"]["calls"] == 2
    two.traced(half)(3)
    assert one.evidence() != two.evidence()
    s = random.Stream(5, 6)
    s.words(7)
    s.uniform()
    body = access.stream_evidence(5, 6, s, 9)
    assert access.replays(body) and not access.replays(body | {"words": 8})
    with pytest.raises(RandomRefusal):
        access.stream_evidence(5, 6, s, 10)


def test_joins_run_again(spark, tmp_path):
    left = put(tmp_path / "l.csv", "id,v\n7,a\n3,\"b,c\"\n5,d\n")
    right = put(tmp_path / "r.csv", "id,w\n5,x\n7,\n")
    folder = str(tmp_path / "run")
    out = joins.join_files(spark, folder, "out.csv", left, right, "id", "id", "left", "L_", "R_")
    assert open(out, encoding="utf-8").read() == '__join_matched,L_id,L_v,R_id,R_w\ntrue,7,a,7,\nfalse,3,"b,c",\\N,\\N\ntrue,5,d,5,x\n'
    joins.reconstruct(spark, folder)
    assert sorted(os.listdir(folder)) == ["imports", "join.json", "out.csv"]
    put(tmp_path / "run" / "imports" / "right-r.csv", "id,w\n5,y\n7,\n")
    with pytest.raises(DataRefusal):
        joins.reconstruct(spark, folder)
    with pytest.raises(DataRefusal):
        joins.join_files(spark, str(tmp_path / "other"), "out.csv", left, put(tmp_path / "d.csv", "id,w\n5,y\n5,z\n"), "id", "id", "left", "L_", "R_")
