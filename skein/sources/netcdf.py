"""Classic NetCDF files (versions 1, 2 and 5) without a library: read into a dictionary or a field of series, and written.

The format is big-endian: ``CDF`` and a version byte, the number of records, lists
of dimensions, global attributes and variables (name, dimensions, attributes, type,
size, offset), then the data; variables over the unlimited dimension lie record by
record. Files of version 4 are HDF5 and raise.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.blocks import ensure_workers

#: Fixed values of the format: type number -> numpy type.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
_NUMBER = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6}


class _Reader:
    def __init__(self, data: bytes) -> None:
        if data[:4] == b"\x89HDF":
            raise ValueError("a NetCDF 4 (HDF5) file; convert it to the classic format")
        if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
            raise ValueError("not a classic NetCDF file")
        self.data, self.at, self.version = data, 4, data[3]

    def int(self, wide: bool = False) -> int:
        n = 8 if wide else 4
        self.at += n
        return int.from_bytes(self.data[self.at - n : self.at], "big")

    def size(self) -> int:
        return self.int(self.version == 5)

    def name(self) -> str:
        n = self.size()
        out = self.data[self.at : self.at + n].decode("utf-8")
        self.at += -(-n // 4) * 4
        return out

    def values(self) -> object:
        kind, n = TYPES[self.int()], self.size()
        size = n * np.dtype(kind).itemsize
        raw = self.data[self.at : self.at + size]
        self.at += -(-size // 4) * 4
        if kind == "S1":
            return raw.decode("utf-8", "replace").rstrip("\x00")
        v = np.frombuffer(raw, kind).astype(np.dtype(kind).newbyteorder("="))
        return v.item() if n == 1 else v

    def attributes(self) -> dict:
        self.int()
        return {self.name(): self.values() for _ in range(self.size())}


def read_dictionary(data: bytes, with_arrays: bool = True) -> dict:
    """``{"dimensions": {name: length}, "global_attributes": {...}, "variables": {name: {"dimensions", "attributes", "type", "array"}}}`` of a file's bytes. Arrays have their scale factor and offset applied and NaN for fill values."""
    r = _Reader(data)
    records = r.size()
    r.int()
    dims = [(r.name(), r.size()) for _ in range(r.size())]
    dims = [(n, size or records) for n, size in dims], [n for n, size in dims if size == 0]
    (dims, unlimited) = dims
    attributes = r.attributes()
    r.int()
    found = []
    for _ in range(r.size()):
        name = r.name()
        own = [dims[r.size()] for _ in range(r.size())]
        more = r.attributes()
        kind, size, start = TYPES[r.int()], r.size(), r.int(r.version != 1)
        found.append((name, own, more, kind, size, start))
    is_record = lambda own: bool(own) and own[0][0] in unlimited
    step = sum(f[4] for f in found if is_record(f[1]))
    variables = {}
    for name, own, more, kind, size, start in found:
        shape, out = [n for _, n in own], None
        if with_arrays:
            item = np.dtype(kind).itemsize
            if is_record(own):
                count = int(np.prod(shape[1:], dtype=np.int64))
                pad = step if sum(is_record(f[1]) for f in found) > 1 else count * item
                out = np.stack([np.frombuffer(data, kind, count, start + k * pad) for k in range(shape[0])]) if shape[0] else np.zeros((0, count), kind)
            else:
                out = np.frombuffer(data, kind, int(np.prod(shape, dtype=np.int64)), start)
            out = out.reshape(shape)
            if kind != "S1":
                fill = [more[k] for k in ("_FillValue", "missing_value") if k in more]
                raw, out = out, out.astype(np.float64)
                for v in fill:
                    out[raw == np.asarray(v).ravel()[0]] = np.nan
                out = out * more.get("scale_factor", 1.0) + more.get("add_offset", 0.0)
        variables[name] = {"dimensions": [n for n, _ in own], "attributes": more, "type": kind.lstrip(">"), "array": out}
    return {"dimensions": dict(dims), "global_attributes": attributes, "variables": variables}


def write_dictionary(d: dict) -> bytes:
    """A file of version 2 from a dictionary as :func:`read_dictionary` gives it; every dimension of fixed length. Types: i1, i2, i4, f4, f8 (else f8) and S1."""
    pad = lambda b: b + b"\x00" * (-len(b) % 4)
    num = lambda n: struct.pack(">i", n)
    name = lambda s: num(len(s.encode())) + pad(s.encode())

    def attributes(a: dict) -> bytes:
        if not a:
            return num(0) + num(0)
        out = num(12) + num(len(a))
        for k, v in a.items():
            if isinstance(v, str):
                out += name(k) + num(2) + num(len(v.encode())) + pad(v.encode())
            else:
                x = np.atleast_1d(np.asarray(v))
                kind = ">i4" if x.dtype.kind in "iu" and (np.abs(x) < 1 << 31).all() else ">f8"
                out += name(k) + num(_NUMBER[kind[1:]]) + num(len(x)) + pad(x.astype(kind).tobytes())
        return out

    dims = list(d["dimensions"])
    head = b"CDF\x02" + num(0) + (num(10) + num(len(dims)) if dims else num(0) + num(0))
    head += b"".join(name(k) + num(d["dimensions"][k]) for k in dims) + attributes(d.get("global_attributes", {}))
    head += num(11) + num(len(d["variables"])) if d["variables"] else num(0) + num(0)
    rows, body = [], []
    for k, v in d["variables"].items():
        kind = v.get("type", "f8")
        kind = kind if kind in _NUMBER else "f8"
        data = pad(np.ascontiguousarray(v["array"]).astype(kind if kind in ("i1", "S1") else ">" + kind).tobytes())
        rows.append(name(k) + num(len(v["dimensions"])) + b"".join(num(dims.index(x)) for x in v["dimensions"]) + attributes(v.get("attributes", {})) + num(_NUMBER[kind]) + num(len(data)))
        body.append(data)
    at = len(head) + sum(len(r) + 8 for r in rows)
    out = head
    for r, data in zip(rows, body, strict=True):
        out += r + struct.pack(">q", at)
        at += len(data)
    return out + b"".join(body)


def load_field(spark: SparkSession, path: str, variable: str, time: str = "time", lat: str = "lat", lon: str = "lon", level: int | None = None, index: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``obs(node, t, x)`` and ``grid(node, lat, lon)`` of a variable over (time, [level], lat, lon), or over (time, [level], ``index``) with coordinate variables ``lat`` and ``lon`` along the index.

    Nodes are numbered latitude by latitude; t is the time's place from 0. Missing
    values are null. One task reads a file, so a record of many files is as many tasks;
    files follow one another in order of name.
    """
    ensure_workers(spark)
    raw = spark.read.format("binaryFile").load(path)

    def one(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = read_dictionary(bytes(data))["variables"]
        x = v[variable]["array"]
        x = x[:, level or 0] if x.ndim == (3 if index else 4) else x
        la, lo = v[lat]["array"], v[lon]["array"]
        if not index:
            la, lo = np.repeat(la, len(lo)), np.tile(lo, len(v[lat]["array"]))
        return x.reshape(len(x), -1), la, lo

    def lengths(frames):
        for f in frames:
            yield pd.DataFrame({"path": f.path, "n": [len(one(c)[0]) for c in f.content]})

    before, total = [], 0
    for r in sorted(raw.select("path", "content").mapInPandas(lengths, "path string, n long").collect(), key=lambda r: r.path):
        before.append((r.path, total))
        total += r.n
    first = F.broadcast(spark.createDataFrame(before, "path string, first long"))  # a row for each file

    def series(frames):
        for f in frames:
            for c, start in zip(f.content, f["first"], strict=True):
                x, _, _ = one(c)
                for t, row in enumerate(x):
                    yield pd.DataFrame({"node": np.arange(len(row)), "t": start + t, "x": row})

    def points(frames):
        for f in frames:
            for c in f.content:
                _, la, lo = one(c)
                yield pd.DataFrame({"node": np.arange(len(la)), "lat": la, "lon": lo})

    obs = raw.select("path", "content").join(first, "path").mapInPandas(series, "node long, t long, x double")
    grid = raw.orderBy("path").limit(1).select("content").mapInPandas(points, "node long, lat double, lon double")
    return obs.withColumn("x", F.when(F.isnan("x"), None).otherwise(F.col("x"))), grid
