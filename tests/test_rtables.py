"""R's files, written by a small encoder of the same form, read back."""

import bz2
import gzip
import lzma
import struct

import pytest

from ledgerloom.sources import filings, rtables

NA = -(1 << 31)
i4 = lambda *x: b"".join(struct.pack(">i", v) for v in x)
END = i4(254)


def chars(s, latin=False):
    if s is None:
        return i4(9, -1)
    b = s.encode("latin-1" if latin else "utf-8")
    return i4(9 | (4 if latin else 8) << 12, len(b)) + b


def symbol(name):
    return i4(1) + chars(name)


def pairs(**held):
    return b"".join(i4(2 | 0x400) + symbol(k.replace("_", ".")) + v for k, v in held.items()) + END


def vector(kind, body, n, **attributes):
    return i4(kind | (0x200 if attributes else 0), n) + body + (pairs(**attributes) if attributes else b"")


def strings(*x, latin=False, **attributes):
    return vector(16, b"".join(chars(s, latin) for s in x), len(x), **attributes)


def reals(*x, **attributes):
    return vector(14, b"".join(struct.pack(">d", v) for v in x), len(x), **attributes)


def ints(*x, kind=13, **attributes):
    return vector(kind, i4(*x), len(x), **attributes)


def frame(columns):
    return vector(19, b"".join(columns.values()), len(columns), names=strings(*columns), row_names=ints(NA, -2), **{"class": strings("data.frame")})


def compact(form, state):
    return i4(238) + i4(2) + symbol(form) + i4(2) + symbol("base") + END + state + END


COLUMNS = {
    "cik": ints(320193, NA),
    "company.name": strings("Æsir AG", None, latin=True),
    "form.type": ints(2, 1, levels=strings("8-K", "10-K"), **{"class": strings("factor")}),
    "date.filed": reals(19000.0, float("nan"), **{"class": strings("Date")}),
    "at": reals(0.5, 86400.0, **{"class": strings("POSIXct", "POSIXt")}),
    "amount": reals(2.0, 2.5),
    "done": ints(1, NA, kind=10),
    "nth": compact("compact_intseq", reals(2.0, 5.0, 1.0)),
    "shown": compact("deferred_string", i4(2) + ints(7, 8) + END),
    "wrapped": compact("wrap_string", vector(19, strings("x", "ÿ") + ints(0, 0), 2)),
}
WANT = {
    "cik": ["320193", None], "company.name": ["Æsir AG", None], "form.type": ["10-K", "8-K"], "date.filed": ["2022-01-08", None], "at": ["1970-01-01 00:00:00.500000", "1970-01-02 00:00:00"],
    "amount": ["2", "2.5"], "done": ["TRUE", None], "nth": ["5", "6"], "shown": ["7", "8"], "wrapped": ["x", "ÿ"],
}


def saved(body, version=2, name="master"):
    head = b"X\n" + i4(version, 0x30500, 0x20300) + (i4(5) + b"UTF-8" if version == 3 else b"")
    return f"RDX{version}\n".encode() + head + i4(2 | 0x400) + symbol("a.note") + strings("no table") + i4(2 | 0x400) + symbol(name) + body + END


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, bytes])
@pytest.mark.parametrize("version", [2, 3])
def test_columns_of_all_kinds(pack, version):
    found = rtables.table(pack(saved(frame(COLUMNS), version)))
    assert {k: rtables.texts(v) for k, v in found.items()} == WANT
    alone = rtables.table(pack(b"X\n" + i4(2, 0, 0) + frame({"cik": COLUMNS["cik"]})))
    assert rtables.texts(alone["cik"]) == ["320193", None]


def test_names_that_repeat_are_references():
    body = frame({"a": ints(1, 1, levels=strings("x"), **{"class": strings("factor")})})
    # the second factor's attributes refer to symbols met before: names, row.names and class come later, so levels is 3 and class 4
    second = i4(13 | 0x200, 1, 1) + i4(2 | 0x400, 255 | 3 << 8) + strings("y") + i4(2 | 0x400, 255 | 4 << 8) + strings("factor") + END
    data = saved(vector(19, ints(1, levels=strings("x"), **{"class": strings("factor")}) + second, 2, names=strings("a", "b"), **{"class": strings("data.frame")}))
    assert {k: rtables.texts(v) for k, v in rtables.table(data).items()} == {"a": ["x"], "b": ["y"]}
    assert rtables.texts(rtables.table(saved(body))["a"]) == ["x", "x"]


def test_files_with_bad_ones_among_them(spark, tmp_path):
    whole = saved(frame({k: COLUMNS[k] for k in ("cik", "company.name", "form.type")}))
    (tmp_path / "2020master.Rda").write_bytes(gzip.compress(whole))
    (tmp_path / "2021master.Rda").write_bytes(bz2.compress(saved(frame({"cik": COLUMNS["amount"], "extra": COLUMNS["shown"]}), 3)))
    (tmp_path / "2022master.Rda").write_bytes(gzip.compress(whole)[:60])
    (tmp_path / "2023master.Rda").write_bytes(gzip.compress(whole[:-90]))
    (tmp_path / "2024master.Rda").write_bytes(b"A\n2\n")
    (tmp_path / "2025master.Rda").write_bytes(saved(strings("no table at all")))
    (tmp_path / "empty.Rda").write_bytes(b"")
    rows = rtables.r_table(spark, f"{tmp_path}/*.Rda")
    assert rows.columns == ["source_file", "cik", "company.name", "extra", "form.type"]
    assert sorted((tuple(r)[1:] for r in rows.collect()), key=str) == sorted([("320193", "Æsir AG", None, "10-K"), (None, None, None, "8-K"), ("2", None, "7", None), ("2.5", None, "8", None)], key=str)
    one = rtables.r_table(spark, f"{tmp_path}/*.Rda", ["extra"])
    assert one.columns == ["source_file", "extra"] and one.where("extra IS NOT NULL").count() == 2
    assert rtables.r_table(spark, f"{tmp_path}/2025*.Rda") is None
    (tmp_path / "daily.csv").write_text("CIK,Form.Type\n5,10-Q\n")
    index = filings.index_tables(spark, [f"{tmp_path}/2020master.Rda", f"{tmp_path}/2024master.Rda", f"{tmp_path}/daily.csv", f"{tmp_path}/none.Rda"])
    assert sorted((r["cik"] or "", r["form_type"]) for r in index.collect()) == [("", "8-K"), ("320193", "10-K"), ("5", "10-Q")]
