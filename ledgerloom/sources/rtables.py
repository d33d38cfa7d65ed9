"""Tables in R's serialised form: files of saved objects, each read by one task; those that can't be read are left out."""

from __future__ import annotations

import bz2
import datetime
import gzip
import lzma
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ENDINGS = (".rda", ".rdata", ".rds")
#: Rows handed on together.
ROWS = 20_000
#: Type codes of the format, and its missing whole number.
_REF, _ALT, _SYMBOL, _PAIRS, _CHARS, _LOGICAL, _INT, _REAL, _COMPLEX, _STRINGS, _LIST, _RAW = 255, 238, 1, 2, 9, 10, 13, 14, 15, 16, 19, 24
_EMPTY, _MISSING = {0, 241, 242, 250, 251, 252, 253, 254}, -(1 << 31)
BROKEN = (struct.error, ValueError, EOFError, OSError, IndexError, KeyError, TypeError, AttributeError, RecursionError, OverflowError, zlib.error, lzma.LZMAError)


class _Stream:
    """Objects of a serialised stream: vectors as (type, values, attributes), pair lists as lists of (name, object)."""

    def __init__(self, data: bytes):
        self.data, self.at, self.refs = data, 0, []

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the file ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def int(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def start(self) -> None:
        if self.data[:5] in (b"RDX2\n", b"RDX3\n"):
            self.at = 5
        if self.take(2) != b"X\n":
            raise ValueError("not in the binary form")
        version = self.int()
        self.take(8)
        if version == 3:
            self.take(self.int())
        elif version != 2:
            raise ValueError("unknown version")

    def item(self):
        flags = self.int()
        kind, attributes = flags & 0xFF, bool(flags & 0x200)
        if kind in _EMPTY:
            return None
        if kind == _REF:
            return self.refs[(flags >> 8 or self.int()) - 1]
        if kind == _SYMBOL:
            self.refs.append(self.item())
            return self.refs[-1]
        if kind == _CHARS:
            n = self.int()
            return None if n == -1 else self.take(n).decode("latin-1" if flags >> 12 & 4 else "utf-8", "replace")
        if kind == _PAIRS:
            return self.pairs(flags)
        if kind == _ALT:
            return self.compact()
        n = self.int()
        if n == -1:
            n = (self.int() << 32) + (self.int() & 0xFFFFFFFF)
        if kind in (_LOGICAL, _INT):
            values = np.frombuffer(self.take(4 * n), ">i4")
        elif kind == _REAL:
            values = np.frombuffer(self.take(8 * n), ">f8")
        elif kind in (_STRINGS, _LIST):
            values = [self.item() for _ in range(n)]
        elif kind in (_COMPLEX, _RAW):
            values = self.take(16 * n if kind == _COMPLEX else n)
        else:
            raise ValueError(f"type {kind}")
        return kind, values, dict(self.item() or ()) if attributes else {}

    def pairs(self, flags: int) -> list[tuple]:
        out = []
        while flags & 0xFF == _PAIRS:
            if flags & 0x200:
                self.item()
            name = self.item() if flags & 0x400 else None
            out.append((name, self.item()))
            before, flags = self.at, self.int()
        if flags & 0xFF not in _EMPTY:  # a pair whose rest is no list
            self.at = before
            out.append((None, self.item()))
        return out

    def compact(self):
        """A vector that is kept in a shorter form: a sequence, numbers to be shown as text, or one in a wrapper."""
        info, state, attributes = self.item(), self.item(), self.item()
        form, held = info[0][1], dict(attributes or ())
        if form in ("compact_intseq", "compact_realseq"):
            n, first, step = (float(x) for x in state[1])
            return (_INT if form == "compact_intseq" else _REAL), first + step * np.arange(int(n)), held
        if form == "deferred_string":
            return _STRINGS, texts(state[0][1]), held
        if form.startswith("wrap_"):
            inner = state[1][0] if state[0] == _LIST else state[0][1]
            return inner[0], inner[1], held or inner[2]
        raise ValueError(form)


def _strings(vector) -> list[str | None]:
    return list(vector[1]) if vector and vector[0] == _STRINGS else []


def texts(vector) -> list[str | None]:
    """A column's values as text: levels of factors, dates and times (UTC) in ISO form, whole numbers without a point; None where missing."""
    kind, values, attributes = vector
    classes = _strings(attributes.get("class"))
    if kind == _STRINGS:
        return list(values)
    if kind not in (_LOGICAL, _INT, _REAL):
        raise ValueError("no column of single values")
    found = [None if x != x or kind != _REAL and x == _MISSING else x for x in np.asarray(values).tolist()]
    if "factor" in classes:
        levels = _strings(attributes["levels"])
        return [None if x is None else levels[int(x) - 1] for x in found]
    if "Date" in classes:
        return [None if x is None else str(datetime.date(1970, 1, 1) + datetime.timedelta(days=int(x // 1))) for x in found]
    if "POSIXct" in classes:
        return [None if x is None else str(datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=x)) for x in found]
    if kind == _LOGICAL:
        return [None if x is None else "TRUE" if x else "FALSE" for x in found]
    return [None if x is None else str(int(x)) if float(x).is_integer() else repr(x) for x in found]


def unpacked(data: bytes) -> bytes:
    for mark, f in ((b"\x1f\x8b", gzip.decompress), (b"BZh", bz2.decompress), (b"\xfd7zXZ", lzma.decompress)):
        if data.startswith(mark):
            return f(data)
    return data


def table(data: bytes) -> dict[str, tuple]:
    """The columns of a file's table: the object itself, or of several saved ones the first by name that is a table."""
    stream = _Stream(unpacked(data))
    stream.start()
    found = stream.item()
    objects = sorted(found, key=lambda p: p[0] or "") if isinstance(found, list) else [("", found)]
    for _, x in objects:
        if isinstance(x, tuple) and x[0] == _LIST and "names" in x[2] and "data.frame" in _strings(x[2].get("class")):
            return dict(zip(_strings(x[2]["names"]), x[1]))
    raise ValueError("no table")


def r_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame | None:
    """source_file and the columns of the tables in R's files under a path or pattern, all text, bound by name; columns that a file lacks are null.

    With columns only those are made into text. Files that are damaged, of another form or without
    a table give no rows; without columns and without any table that can be read the result is None.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def names(batches):
        for b in batches:
            out = set()
            for x in b.column(1):
                try:
                    out |= set(table(x.as_py()))
                except BROKEN:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.string())], names=["name"])

    columns = columns or sorted(r["name"] for r in files.mapInArrow(names, "name string").distinct().collect())
    if not columns:
        return None

    def rows(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    held = table(content.as_py())
                    found = {c: texts(held[c]) for c in columns if c in held}
                    n = max(len(x[1]) for x in held.values()) if held else 0
                    if any(len(x) != n for x in found.values()):
                        continue
                except BROKEN:
                    continue
                for at in range(0, n, ROWS):
                    size = min(ROWS, n - at)
                    part = [pa.array(found[c][at : at + size], pa.string()) if c in found else pa.nulls(size, pa.string()) for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * size), *part], names=["source_file", *columns])

    quoted = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    return files.mapInArrow(rows, f"source_file string, {quoted}")
