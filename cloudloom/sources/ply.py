"""PLY files: header, record layout, a partitioned reader and a writer (SRC1-SRC7, SRC20).

``spark.dataSource.register(PlySource)`` adds the format ``ply``: a file is split by byte range at whole records, and each
task reads its own range in pieces, so a file of any size is read in parallel.  Files are opened through Arrow's file
systems, so paths may be local or URIs that Arrow knows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# PLY scalar types and their aliases.
TYPES = {
    "char": "<i1", "int8": "<i1", "uchar": "<u1", "uint8": "<u1",
    "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2",
    "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4",
    "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8",
}
#: Bytes of a partition, and of a piece that a task reads at once.
SPLIT_BYTES, PIECE_BYTES = 64 << 20, 8 << 20
#: Bytes in which a header must end.
HEADER_BYTES = 1 << 20


class PlyError(ValueError):
    """A file that can't be read as PLY."""


@dataclass
class Header:
    """D8."""

    format: str = ""
    vertices: int = 0
    offset: int = 0
    comments: list[str] = field(default_factory=list)
    properties: list[tuple[str, str]] = field(default_factory=list)

    def has(self, *names: str) -> bool:
        """SRC2."""
        known = {n for _, n in self.properties}
        return all(n in known for n in names)

    @property
    def has_rgb(self) -> bool:
        return self.has("red", "green", "blue")

    @property
    def fields(self) -> list[str]:
        """SRC3: names of scalar fields, in order, without their prefix."""
        return [n.removeprefix("scalar_") for _, n in self.properties if n.startswith("scalar_")]

    @property
    def is_splat(self) -> bool:
        return self.has("f_dc_0", "opacity", "scale_0", "rot_0")

    @property
    def is_cloud(self) -> bool:
        return self.has("x", "y", "z") and not self.is_splat

    def layout(self) -> np.dtype:
        """SRC4: the record; any unknown type makes the whole file unreadable."""
        for t, n in self.properties:
            if t not in TYPES:
                raise PlyError(f"property {n} has the unsupported type {t}")
        if not self.has("x", "y", "z"):
            raise PlyError("x, y and z are required")
        names: dict[str, int] = {}
        out = []
        for t, n in self.properties:  # a repeated name keeps its bytes
            names[n] = names.get(n, 0) + 1
            out.append((n if names[n] == 1 else f"{n}#{names[n]}", TYPES[t]))
        return np.dtype(out)

    def normals(self) -> tuple[str, ...] | None:
        for names in (("normal_x", "normal_y", "normal_z"), ("nx", "ny", "nz")):
            if self.has(*names):
                return names
        return None

    def indexed(self, prefix: str) -> list[str]:
        """SRC6: properties named prefix and digits, by number."""
        found = {int(n[len(prefix) :]): n for _, n in self.properties if re.fullmatch(re.escape(prefix) + r"\d+", n)}
        return [found[k] for k in sorted(found)]


def parse_header(data: bytes) -> Header:
    """SRC1."""
    out, at, seen = Header(), 0, False
    while True:
        end = data.find(b"\n", at)
        if end < 0:
            raise PlyError("the header does not end")
        line = data[at:end].decode("ascii", "replace").rstrip("\r\n")
        at = end + 1
        words = line.split()
        if not words:
            continue
        if not seen:
            if words != ["ply"]:
                raise PlyError("the first line is not ply")
            seen = True
        elif words[0] == "end_header":
            out.offset = at
            return out
        elif words[0] == "format" and len(words) > 1:
            out.format = words[1]
        elif words[0] == "comment":
            out.comments.append(line[len("comment") :].strip())
        elif words[:2] == ["element", "vertex"]:
            out.vertices = int(words[2])
        elif words[0] == "property" and len(words) > 2:
            out.properties.append((words[1], words[2]))


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        system, inner = pafs.FileSystem.from_uri(path)
    else:
        system, inner = pafs.LocalFileSystem(), path
    return system.open_input_file(inner)


def read_header(path: str) -> Header:
    with _open(path) as f:
        return parse_header(f.read(min(HEADER_BYTES, f.size())))


def _ddl(h: Header, kind: str) -> str:
    if kind == "splat":
        return "point_index long, x float, y float, z float, opacity float, scale array<float>, rot array<float>, sh array<float>"
    out = "point_index long, x float, y float, z float"
    if h.has_rgb:
        out += ", red short, green short, blue short"
    if h.normals():
        out += ", nx float, ny float, nz float"
    return out + "".join(f", `{f}` float" for f in h.fields)


def columns(h: Header, records: np.ndarray, first: int, kind: str) -> list[tuple[str, pa.Array]]:
    """SRC5, SRC7: the columns of some records: colours 0..255, unit normals, fields as float32, splats' arrays as stored."""
    n = len(records)
    out = [("point_index", pa.array(np.arange(first, first + n)))]
    f4 = lambda name: records[name].astype(np.float64).astype(np.float32)
    out += [(a, pa.array(f4(a))) for a in "xyz"]
    if kind == "splat":
        dc, rest, scales, rots = (h.indexed(p) for p in ("f_dc_", "f_rest_", "scale_", "rot_"))
        if len(dc) < 3 or len(rest) < 45 or len(scales) < 3 or len(rots) < 4 or not h.has("opacity"):
            raise PlyError("a splat needs 3 f_dc, 45 f_rest, opacity, 3 scale and 4 rot properties")
        lists = lambda names: pa.array(np.stack([f4(x) for x in names], 1).tolist(), pa.list_(pa.float32()))
        return [*out, ("opacity", pa.array(f4("opacity"))), ("scale", lists(scales[:3])), ("rot", lists(rots[:4])), ("sh", lists(dc[:3] + rest[:45]))]
    if h.has_rgb:
        out += [(c, pa.array(np.clip(np.nan_to_num(records[c].astype(float)), 0, 255).astype(np.int16))) for c in ("red", "green", "blue")]
    if names := h.normals():
        v = np.stack([records[c].astype(float) for c in names], 1)
        n2 = (v * v).sum(1)
        ok = np.isfinite(n2) & (n2 > 1e-12)
        v = np.where(ok[:, None], v / np.sqrt(np.where(ok, n2, 1))[:, None], 0.0)
        out += [(c, pa.array(v[:, i].astype(np.float32))) for i, c in enumerate(("nx", "ny", "nz"))]
    return out + [(x.removeprefix("scalar_"), pa.array(f4(x))) for _, x in h.properties if x.startswith("scalar_")]


@dataclass
class _Range(InputPartition):
    first: int
    count: int


class PlyReader(DataSourceReader):
    def __init__(self, path: str, header: Header, kind: str, wanted: list[str], split: int):
        self.path, self.header, self.kind, self.wanted, self.split = path, header, kind, wanted, split

    def partitions(self):
        size = self.header.layout().itemsize
        step = max(1, self.split // size)
        n = self.header.vertices
        return [_Range(i, min(step, n - i)) for i in range(0, n, step)] or [_Range(0, 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        layout = self.header.layout()
        step = max(1, PIECE_BYTES // layout.itemsize)
        with _open(self.path) as f:
            for first in range(partition.first, partition.first + partition.count, step):
                n = min(step, partition.first + partition.count - first)
                data = f.read_at(n * layout.itemsize, self.header.offset + first * layout.itemsize)
                if len(data) < n * layout.itemsize:
                    raise PlyError("the file is shorter than its header says")
                own = [(c, a) for c, a in columns(self.header, np.frombuffer(data, layout), first, self.kind) if c in self.wanted]
                yield pa.RecordBatch.from_arrays([a for _, a in own], [c for c, _ in own])


class PlySource(DataSource):
    """Options: path; kind (cloud or splat; by default what the header looks like); split (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def _header(self) -> tuple[Header, str]:
        h = read_header(self.options["path"])
        if h.format != "binary_little_endian":
            raise PlyError(f"format {h.format or 'none'} is not read, binary_little_endian is")
        return h, self.options.get("kind", "splat" if h.is_splat else "cloud")

    def schema(self) -> str:
        return _ddl(*self._header())

    def reader(self, schema) -> PlyReader:
        h, kind = self._header()
        return PlyReader(self.options["path"], h, kind, schema.fieldNames(), int(self.options.get("split", SPLIT_BYTES)))


def read_ply(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(PlySource)
    return spark.read.format("ply").options(path=path, **{k: str(v) for k, v in options.items()}).load()


def write_ply(df: DataFrame, path: str, fields: list[str], *, comment: str = "") -> int:
    """SRC20: one file of x, y, z, optional colours and the fields as scalar_*, ordered by point_index; returns the points written.

    Rows stream to the driver a partition at a time.  An empty table is an error.
    """
    rgb = all(c in df.columns for c in ("red", "green", "blue"))
    spec = [*[(a, "<f4", "float", a) for a in "xyz"], *[(c, "u1", "uchar", c) for c in ("red", "green", "blue") if rgb], *[(f, "<f4", "float", f"scalar_{f}") for f in fields]]
    n = df.count()
    if not n:
        raise PlyError("nothing to write")
    lines = ["ply", "format binary_little_endian 1.0", *([f"comment {comment}"] if comment else []), f"element vertex {n}", *[f"property {t} {name}" for _, _, t, name in spec], "end_header"]
    layout = np.dtype([(c, t) for c, t, _, _ in spec])
    ordered = df.orderBy("point_index").select(*[c for c, *_ in spec])
    with open(path, "wb") as out:
        out.write(("\n".join(lines) + "\n").encode())
        held = []
        for row in ordered.toLocalIterator(prefetchPartitions=True):
            held.append(tuple(row))
            if len(held) == 65536:
                out.write(np.array(held, layout).tobytes())
                held.clear()
        out.write(np.array(held, layout).tobytes())
    return n
