import struct

import pytest
from conftest import rows
from pyspark.sql import types as T

from cindermap.session import materialize, shared_folder
from cindermap.sources import tables as S
from cindermap.sources.dbf import read_dbf
from cindermap.sources.schemas import CHAPTER_CROSSWALK, layout


def write(path, text):
    path.write_text(text)
    return str(path)


def dbf(path, fields, records, deleted=()):
    described = b"".join(n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, k, w, d in fields)
    width = 1 + sum(f[2] for f in fields)
    body = b"".join((b"*" if i in deleted else b" ") + "".join(v.ljust(f[2]) for v, f in zip(r, fields)).encode("latin-1") for i, r in enumerate(records))
    path.write_bytes(struct.pack("<B3xIHH20x", 3, len(records), 33 + len(described), width) + described + b"\r" + body + b"\x1a")
    return str(path)


FIELDS = [("STATE", "C", 2, 0), ("FDID", "C", 5, 0), ("DEATHS", "N", 4, 0), ("LON", "N", 9, 3), ("SEEN", "L", 1, 0)]


def test_dbf_types_blanks_and_deleted(spark, tmp_path):
    path = dbf(tmp_path / "x.dbf", FIELDS, [["WA", "00012", "   3", "-122.500", "T"], ["", " ", "", ".", "?"], ["OR", "1", "9", "1", "N"], ["é", "b", "12", "0.5", "f"]], deleted={2})
    df = read_dbf(spark, path)
    assert [f.dataType for f in df.schema.fields] == [T.StringType(), T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()]
    assert rows(df) == [(None, None, None, None, None), ("WA", "00012", 3, -122.5, True), ("é", "b", 12, 0.5, False)]


def test_dbf_splits_folders_and_schema(spark, tmp_path):
    for part in range(2):
        dbf(tmp_path / f"p{part}.DBF", FIELDS, [["WA", f"{i:05d}", str(i), "1.5", "T"] for i in range(part * 1000, part * 1000 + 1000)])
    df = read_dbf(spark, str(tmp_path), layout("FDID DEATHS"), records_per_task=300)
    assert df.rdd.getNumPartitions() == 8
    assert rows(df) == [(f"{i:05d}", str(i)) for i in range(2000)]


def test_empty_dbf(spark, tmp_path):
    assert read_dbf(spark, dbf(tmp_path / "e.dbf", FIELDS, [])).count() == 0


def test_caret_columns_by_name(spark, tmp_path):
    path = write(tmp_path / "a.txt", "INC_NO^STATE^N^EXTRA\n007^WA^3^x\n8^^^y\n")
    assert rows(S.read_caret(spark, path, layout("STATE INC_NO", "N"))) == [(None, "8", None), ("WA", "007", 3)]
    with pytest.raises(ValueError):
        S.read_caret(spark, path, layout("STATE MISSING"))


def test_years_of_mixed_formats(spark, tmp_path):
    schema = layout("K", "N")
    specs = {
        2009: {"format": "dbf", "path": dbf(tmp_path / "y.dbf", [("K", "C", 3, 0), ("N", "N", 3, 0)], [["01", "5"]]), "schema": schema},
        2012: {"format": "caret", "path": write(tmp_path / "y.txt", "N^K\n6^02\n"), "schema": schema},
        2013: {"format": "csv", "path": write(tmp_path / "y.csv", "K,N\n03,7\n"), "schema": schema},
    }
    years = S.read_years(spark, specs)
    assert rows(years) == [("01", 5, "2009"), ("02", 6, "2012"), ("03", 7, "2013")]
    stored = S.save_by_year(years, str(tmp_path / "store"))
    assert rows(stored.filter("year = '2012'")) == [("02", 6, "2012")]
    with pytest.raises(ValueError):
        S.read_one(spark, {"format": "xls", "path": "x"})


def test_parts_title_and_round_trip(spark, tmp_path):
    (tmp_path / "parts").mkdir()
    write(tmp_path / "parts" / "a.csv", "1,47.1,-122.2,530330001001\n")
    write(tmp_path / "parts" / "b.csv", "2,,-122.3,error\n")
    assert rows(S.read_parts(spark, str(tmp_path / "parts"), layout("id lat lon block"))) == [("1", "47.1", "-122.2", "530330001001"), ("2", None, "-122.3", "error")]
    titled = write(tmp_path / "t.csv", "Chapter list,,,,,\nCounty FIPS,a,b,c,d,e\n01001,r,R,c,C,Autauga\n")
    assert rows(S.read_below_title(spark, titled, CHAPTER_CROSSWALK, "county_fips", "^[0-9]{5}$")) == [("01001", "r", "R", "c", "C", "Autauga")]
    df = spark.createDataFrame([("01", 1.5), (None, 2.0)], "id string, x double")
    S.write_delimited(df, str(tmp_path / "out"), sep="\t")
    assert rows(S.read_delimited(spark, str(tmp_path / "out"), layout("id", "", "x"), sep="\t")) == rows(df)


def test_row_ids_and_cut(spark):
    visits = spark.createDataFrame([("b",), ("a",), ("c",)], "v string")
    assert rows(S.with_row_id(visits, ["v"])) == [("a", 1), ("b", 2), ("c", 3)]
    stored = materialize(visits)
    assert rows(stored) == rows(visits)
    folder = shared_folder(spark).split("file:")[-1].strip("/")
    assert all(folder in f for f in stored.inputFiles())
