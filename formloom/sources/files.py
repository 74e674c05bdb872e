"""Files for other programs, one a specimen and named by it: a sink of Spark that commits all files of a job, or none.

Tasks write below a folder of the job's own and the driver moves the files to their names once all tasks have succeeded;
if one fails, that folder is deleted. Meshes are streamed: a task gets a specimen's counts, points and faces in this
order, holds the points' ids to number corners by, and formats a batch at a time (polydata needs its arrays one after
another, so a specimen's numbers are held for it).

Folders are local or shared paths, or addresses that pyarrow's file systems know (hdfs, s3, gs).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMATS = {"ply": "ply", "ply-ascii": "ply", "vtp": "vtp"}


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
    return fs.LocalFileSystem(), folder


class _Ply:
    """Points as doubles with further arrays, and triangles; as text or little-endian."""

    def __init__(self, out, arrays: list[str], ascii_: bool):
        self.out, self.arrays, self.ascii = out, arrays, ascii_

    def begin(self, points: int, faces: int) -> None:
        names = "".join(f"property double {a.replace(' ', '_')}\n" for a in ("x", "y", "z", *self.arrays))
        kind = "ascii" if self.ascii else "binary_little_endian"
        self.out.write(f"ply\nformat {kind} 1.0\nelement vertex {points}\n{names}element face {faces}\nproperty list uchar int vertex_indices\nend_header\n".encode())

    def points(self, values: np.ndarray) -> None:
        self.out.write("".join(" ".join(map(repr, r)) + "\n" for r in values.tolist()).encode() if self.ascii else values.astype("<f8").tobytes())

    def faces(self, corners: np.ndarray) -> None:
        if self.ascii:
            self.out.write("".join("3 {} {} {}\n".format(*r) for r in corners.tolist()).encode())
        else:
            made = np.empty(len(corners), np.dtype([("n", "u1"), ("v", "<i4", 3)]))
            made["n"], made["v"] = 3, corners
            self.out.write(made.tobytes())

    def end(self) -> None:
        pass


class _Vtp:
    """XML polydata, its arrays appended as they are."""

    def __init__(self, out, arrays: list[str]):
        self.out, self.arrays, self.held, self.corners = out, arrays, [], []

    def begin(self, points: int, faces: int) -> None:
        self.counts = points, faces

    def points(self, values: np.ndarray) -> None:
        self.held.append(values)

    def faces(self, corners: np.ndarray) -> None:
        self.corners.append(corners)

    def end(self) -> None:
        n, m = self.counts
        values = np.concatenate(self.held) if self.held else np.empty((0, 3 + len(self.arrays)))
        corners = np.concatenate(self.corners) if self.corners else np.empty((0, 3), np.int64)
        parts = [np.ascontiguousarray(values[:, 3 + i], "<f8") for i in range(len(self.arrays))]
        parts += [np.ascontiguousarray(values[:, :3], "<f8"), corners.astype("<i8"), np.arange(3, 3 * m + 3, 3, dtype="<i8")]
        at = np.cumsum([0, *(8 + p.nbytes for p in parts)]).tolist()
        said = lambda i, kind, more: f'<DataArray type="{kind}" {more} format="appended" offset="{at[i]}"/>'
        k = len(self.arrays)
        self.out.write(
            (
                f'<?xml version="1.0"?>\n<VTKFile type="PolyData" version="1.0" byte_order="LittleEndian" header_type="UInt64"><PolyData><Piece NumberOfPoints="{n}" NumberOfVerts="0" NumberOfLines="0" NumberOfStrips="0" NumberOfPolys="{m}"><PointData>'
                + "".join(said(i, "Float64", f"Name={quoteattr(a)}") for i, a in enumerate(self.arrays))
                + f"</PointData><Points>{said(k, 'Float64', 'Name="Points" NumberOfComponents="3"')}</Points><Polys>{said(k + 1, 'Int64', 'Name="connectivity"')}{said(k + 2, 'Int64', 'Name="offsets"')}</Polys></Piece></PolyData>"
                + '<AppendedData encoding="raw">\n_'
            ).encode()
        )
        for p in parts:
            self.out.write(np.uint64(p.nbytes).astype("<u8").tobytes())
            self.out.write(p.tobytes())
        self.out.write(b"\n</AppendedData></VTKFile>\n")


@dataclass
class _Done(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.format, self.ending = options["folder"], options["kind"], options["ending"]
        self.arrays, self.temporary = json.loads(options.get("arrays", "[]")), f"_temporary-{uuid.uuid4().hex}"

    def _path(self, name: str) -> str:
        return f"{_store(self.folder)[1].rstrip('/')}/{name}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, _ = _store(self.folder)
        names: list[str] = []
        out = made = ids = None
        store.create_dir(self._path(self.temporary), recursive=True)

        def begin(name: str):
            nonlocal out
            if not name or "/" in name or name.startswith((".", "_")):
                raise ValueError(f"{name!r} can't be the name of a file")
            names.append(f"{name}{self.ending}")
            out = store.open_output_stream(self._path(f"{self.temporary}/{names[-1]}"))
            return out

        def end():
            nonlocal out, made
            if made is not None:
                made.end()
            if out is not None:
                out.close()
            out = made = None

        for b in iterator:
            if self.format == "whole":
                for name, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    begin(name).write(content)
                    end()
                continue
            if not b.num_rows:
                continue
            specimen, kind, number = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy()
            starts = [i for i in range(b.num_rows) if not i or kind[i] != kind[i - 1] or kind[i] == 0]
            for i, j in zip(starts, [*starts[1:], b.num_rows], strict=True):
                values = b.column(3).slice(i, j - i)
                flat = values.flatten().to_numpy(zero_copy_only=False).astype(float)
                if kind[i] == 0:
                    end()
                    own = begin(specimen[i])
                    made = _Vtp(own, self.arrays) if self.format == "vtp" else _Ply(own, self.arrays, self.format == "ply-ascii")
                    made.begin(int(flat[0]), int(flat[1]))
                    ids = []
                elif kind[i] == 1:
                    ids.append(number[i:j])
                    made.points(flat.reshape(j - i, -1))
                else:
                    if isinstance(ids, list):
                        ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
                    corners = flat.reshape(-1, 3).astype(np.int64)
                    at = np.searchsorted(ids, corners)
                    if len(corners) and (not len(ids) or (at >= len(ids)).any() or (ids[np.minimum(at, len(ids) - 1)] != corners).any()):
                        raise ValueError(f"faces of {specimen[i]!r} have corners that aren't points")
                    made.faces(at)
        end()
        return _Done(names)

    def _drop(self) -> None:
        store, _ = _store(self.folder)
        if store.get_file_info(self._path(self.temporary)).type != fs.FileType.NotFound:
            store.delete_dir(self._path(self.temporary))

    def commit(self, messages: list) -> None:
        store, _ = _store(self.folder)
        names = [n for m in messages if m is not None for n in m.names]
        if len(set(names)) < len(names):
            self._drop()
            raise ValueError("specimens share a name")
        for n in names:
            store.move(self._path(f"{self.temporary}/{n}"), self._path(n))
        self._drop()

    def abort(self, messages: list) -> None:
        self._drop()


class SpecimenFiles(DataSource):
    """The sink `specimen_files`; options: folder, kind (whole, ply, ply-ascii, vtp), ending, arrays as a JSON list."""

    @classmethod
    def name(cls) -> str:
        return "specimen_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def _save(df: DataFrame, folder: str, kind: str, ending: str, arrays: tuple[str, ...] = ()) -> None:
    df.sparkSession.dataSource.register(SpecimenFiles)
    df.write.format("specimen_files").option("folder", folder).option("kind", kind).option("ending", ending).option("arrays", json.dumps(arrays)).mode("append").save()


def write_named(contents: DataFrame, folder: str, ending: str) -> None:
    """A file <specimen_id><ending> for each row (specimen_id, value), text or binary."""
    _save(contents.select(F.col("specimen_id").cast("string"), F.col("value").cast("binary")), folder, "whole", ending)


def write_meshes(points: DataFrame, faces: DataFrame, folder: str, kind: str = "ply", arrays: tuple[str, ...] = (), values: str | None = None) -> None:
    """A mesh file for each specimen, named by it; points are numbered anew from 0 in the order of their ids.

    arrays: further columns of points, or the names of what the column `values`, an array of doubles, holds.
    """
    if kind not in FORMATS:
        raise ValueError(f"kind is {kind!r}; it must be one of {sorted(FORMATS)}")
    own = F.array(*[F.col(c).cast("double") for c in ("x", "y", "z", *(() if values else arrays))])
    own = F.concat(own, F.col(values)) if values else own
    whole = F.when(F.size(own) == 3 + len(arrays), own).otherwise(F.raise_error(F.lit("a point lacks some of its values")).cast("array<double>"))
    name = F.col("specimen_id").cast("string").alias("specimen_id")
    p = points.select(name, F.lit(1).alias("kind"), F.col("point_id").cast("long").alias("id"), whole.alias("values"))
    f = faces.select(name, F.lit(2).alias("kind"), F.col("face_id").cast("long").alias("id"), F.array(*[F.col(f"v{k}").cast("double") for k in range(3)]).alias("values"))
    each = p.select("specimen_id", "kind").unionByName(f.select("specimen_id", "kind")).groupBy("specimen_id")
    count = lambda k: F.count(F.when(F.col("kind") == k, 1)).cast("double")
    head = each.agg(F.array(count(1), count(2)).alias("values")).select("specimen_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), "values")
    rows = head.unionByName(p).unionByName(f).repartition("specimen_id").sortWithinPartitions("specimen_id", "kind", "id")
    _save(rows, folder, kind, f".{FORMATS[kind]}", arrays)
