"""Planar video files: one container of Y, U, V planes per frame, and one file per frame."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual, WriterCommitMessage

SCHEMA = "clip string, plane string, frame int, y int, x int, v double"


#: Name of a file that holds a clip from a later frame on: clip, first frame, suffix.
SEGMENT = re.compile(r"(.*)@(\d{10})$")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int
    first: int = 0


def _clip_and_first(path: str) -> tuple[str, int]:
    """The clip of a container file and the frame that the file begins with."""
    stem = path.rpartition("/")[2].rpartition(".")[0]
    found = SEGMENT.match(stem)
    return (found[1], int(found[2])) if found else (stem, 0)


def _planes(raw: bytes, clip: str, frame: int, sizes: list[tuple[str, int, int]], kind: np.dtype) -> Iterator[pa.RecordBatch]:
    """Samples of a frame's bytes; a frame that lacks some is followed by a bit for each place, set where there is a sample."""
    whole, first = sum(h * w for _, h, w in sizes), 0
    body = whole * kind.itemsize
    if len(raw) not in (body, body + -(-whole // 8)):
        raise ValueError(f"frame {frame} of {clip} has {len(raw)} bytes, not {body}")
    values = np.frombuffer(raw, kind, whole)
    seen = np.unpackbits(np.frombuffer(raw, np.uint8, offset=body), count=whole).astype(bool) if len(raw) > body else np.ones(whole, bool)
    for plane, height, width in sizes:
        spots = np.flatnonzero(seen[first : first + height * width]).astype(np.int32)
        v, n = values[first + spots].astype(float), len(spots)
        first += height * width
        y, x = np.divmod(spots, np.int32(width))
        yield pa.RecordBatch.from_arrays([pa.array([clip] * n, pa.string()), pa.array([plane] * n, pa.string()), pa.array(np.full(n, frame, np.int32)), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(v)], ["clip", "plane", "frame", "y", "x", "v"])


def _sizes(options: dict) -> list[tuple[str, int, int]]:
    h, w = int(options["height"]), int(options["width"])
    ch, cw = int(options.get("cheight", h)), int(options.get("cwidth", w))
    return [(p, h, w) if k == 0 else (p, ch, cw) for k, p in enumerate(options.get("planes", "y,u,v").split(","))]


#: Suffix of a file that holds one frame which lacks samples: its bytes, then a bit for each place.
PART = ".part"


class PlanarReader(DataSourceReader):
    """One partition for each range of frames; comparisons on frame cut the ranges."""

    def __init__(self, options: dict):
        self.options, self.sizes = options, _sizes(options)
        self.kind = np.dtype(options.get("dtype", "uint8"))
        self.low, self.high = int(options.get("start", 0)), int(options.get("frames", 1 << 40)) - 1

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThanOrEqual, LessThanOrEqual)) and f.attribute == ("frame",):
                if not isinstance(f, LessThanOrEqual):
                    self.low = max(self.low, f.value)
                if not isinstance(f, GreaterThanOrEqual):
                    self.high = min(self.high, f.value)
            yield f  # Spark checks rows again

    def partitions(self):
        from pyarrow import fs

        step = int(self.options.get("frames_per_task", 8))
        body = sum(h * w for _, h, w in self.sizes) * self.kind.itemsize
        store, path = fs.FileSystem.from_uri(self.options["path"])
        own = store.get_file_info(path)
        files = [own] if own.is_file else sorted((f for f in store.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name[0] not in "._"), key=lambda f: f.path)
        out = []
        for f in files:
            first = _clip_and_first(f.path)[1]
            low, stop = max(self.low, first), min(self.high + 1, first + (1 if f.path.endswith(PART) else f.size // body))
            out += [Range(f.path, a, min(a + step, stop), first) for a in range(low, stop, step)]
        return out or [Range(path, 0, 0)]

    def read(self, partition: Range):
        size = sum(h * w for _, h, w in self.sizes) * self.kind.itemsize
        from pyarrow import fs

        if partition.start == partition.stop:
            return
        store, _ = fs.FileSystem.from_uri(self.options["path"])
        clip = self.options.get("clip") or _clip_and_first(partition.path)[0]
        with store.open_input_file(partition.path) as f:
            if partition.path.endswith(PART):
                yield from _planes(f.read(), clip, partition.first, self.sizes, self.kind)
                return
            for frame in range(partition.start, partition.stop):
                f.seek((frame - partition.first) * size)
                yield from _planes(f.read(size), clip, frame, self.sizes, self.kind)


@dataclass
class Segments(WriterCommitMessage):
    """What one task has staged: (clip, first frame, frames, file, suffix of its name)."""

    found: list[tuple[str, int, int, str, str]] = field(default_factory=list)


class PlanarWriter(DataSourceArrowWriter):
    """Containers of whole frames in two phases: tasks stage segments of consecutive frames, the driver names them and checks that they meet.

    Rows (clip, plane, frame, y, x, v) of a partition come in the order of clip,
    frame, plane, y and x, all rows of a frame in one partition. A task appends
    frame after frame to a file of its own in a staging folder and reports where
    which frames are. Only what tasks report is moved into place, so that a task
    which ran twice or died leaves nothing; abort deletes the staging folder.
    With the option `partial` frames may lack samples, and clips frames: such a
    frame gets a file of its own that also tells which places have a sample.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.sizes, self.overwrite = options["path"], _sizes(options), overwrite
        self.kind = np.dtype(options.get("dtype", "uint8"))
        self.partial = options.get("partial", "false").lower() == "true"
        self.stage = f"_staged-{uuid.uuid4().hex}"

    def _store(self):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path)
        return store, path.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Segments:
        store, path = self._store()
        folder, done = f"{path}/{self.stage}", Segments()
        store.create_dir(folder, recursive=True)
        if self.partial:
            return self._write_partial(iterator, store, folder)
        whole = sum(h * w for _, h, w in self.sizes)
        out, now, missing = None, None, 0  # the open file, its clip and frame, samples that the frame still lacks
        try:
            for batch in iterator:
                clips, frames, values = batch.column("clip").to_pylist(), batch.column("frame").to_numpy(), batch.column("v").to_numpy()
                raw = self._coded(values)
                edges = [0, *[i for i in range(1, len(clips)) if frames[i] != frames[i - 1] or clips[i] != clips[i - 1]], len(clips)]
                for a, b in zip(edges, edges[1:], strict=False):
                    if a == b:
                        continue
                    key = (clips[a], int(frames[a]))
                    if key != now:
                        if missing:
                            raise ValueError(f"frame {now} lacks {missing} samples")
                        if out is None or now is None or key != (now[0], now[1] + 1):
                            if out is not None:
                                out.close()
                            name = f"{folder}/{uuid.uuid4().hex}"
                            out = store.open_output_stream(name)
                            done.found.append((*key, 0, name, ".yuv"))
                        done.found[-1] = (*done.found[-1][:2], done.found[-1][2] + 1, *done.found[-1][3:])
                        now, missing = key, whole
                    self._in_place(batch.slice(a, b - a), whole - missing)
                    missing -= b - a
                    out.write(raw[a:b].tobytes())
            if missing:
                raise ValueError(f"frame {now} lacks {missing} samples")
        finally:
            if out is not None:
                out.close()
        return done

    def _write_partial(self, iterator: Iterator[pa.RecordBatch], store, folder: str) -> Segments:
        """write() of frames that may lack samples; a task holds one frame's bytes."""
        done, out, now = Segments(), None, None
        whole = sum(h * w for _, h, w in self.sizes)
        body, seen = np.zeros(whole, self.kind), np.zeros(whole, bool)

        def put() -> None:
            """Writes the frame that body and seen hold."""
            nonlocal out
            suffix = ".yuv" if seen.all() else PART
            last = done.found[-1] if done.found else None
            if last is None or suffix == PART or last[4] == PART or (last[0], last[1] + last[2]) != now:
                if out is not None:
                    out.close()
                name = f"{folder}/{uuid.uuid4().hex}"
                out = store.open_output_stream(name)
                last = (*now, 0, name, suffix)
                done.found.append(last)
            done.found[-1] = (*last[:2], last[2] + 1, *last[3:])
            out.write(body.tobytes() + (np.packbits(seen).tobytes() if suffix == PART else b""))
            body[:], seen[:] = 0, False

        try:
            for batch in iterator:
                clips, frames = batch.column("clip").to_pylist(), batch.column("frame").to_numpy()
                raw, spots = self._coded(batch.column("v").to_numpy()), self._places(batch)
                edges = [0, *[i for i in range(1, len(clips)) if frames[i] != frames[i - 1] or clips[i] != clips[i - 1]], len(clips)]
                for a, b in zip(edges, edges[1:], strict=False):
                    if a == b:
                        continue
                    key = (clips[a], int(frames[a]))
                    if now is not None and key != now:
                        put()
                    now = key
                    if seen[spots[a:b]].any() or len(np.unique(spots[a:b])) < b - a:
                        raise ValueError(f"frame {now} has a sample twice")
                    body[spots[a:b]], seen[spots[a:b]] = raw[a:b], True
            if now is not None:
                put()
        finally:
            if out is not None:
                out.close()
        return done

    def _places(self, rows: pa.RecordBatch) -> np.ndarray:
        """Each row's place in the bytes of its frame."""
        planes, y, x = np.array(rows.column("plane").to_pylist()), rows.column("y").to_numpy(), rows.column("x").to_numpy()
        out, first = np.full(rows.num_rows, -1), 0
        for plane, height, width in self.sizes:
            own = (planes == plane) & (y >= 0) & (y < height) & (x >= 0) & (x < width)
            out[own] = first + y[own] * width + x[own]
            first += height * width
        if (out < 0).any():
            raise ValueError(f"samples outside the planes {self.sizes}")
        return out

    def _coded(self, v: np.ndarray) -> np.ndarray:
        """Values as they are stored: whole types are rounded half away from zero and cut to their range."""
        if self.kind.kind == "f":
            return v.astype(self.kind)
        limits = np.iinfo(self.kind)
        return np.clip(np.trunc(v + np.copysign(0.5, v)), limits.min, limits.max).astype(self.kind)

    def _in_place(self, rows: pa.RecordBatch, at: int) -> None:
        """Raises unless the rows are those of the frame from sample `at` on."""
        first, planes = 0, rows.column("plane").to_pylist()
        spots = np.stack([rows.column("y").to_numpy(), rows.column("x").to_numpy()])
        for plane, height, width in self.sizes:
            a, b = max(at, first), min(at + len(planes), first + height * width)
            if a < b and (set(planes[a - at : b - at]) != {plane} or not np.array_equal(spots[:, a - at : b - at], np.divmod(np.arange(a - first, b - first), width))):
                raise ValueError(f"samples of plane {plane} are not in order or not of {height} x {width}")
            first += height * width
        if at + len(planes) > first:
            raise ValueError(f"a frame has more than {first} samples")

    def commit(self, messages: Sequence[Segments | None]) -> None:
        store, path = self._store()
        found = sorted(s for m in messages if m is not None for s in m.found)
        moved: list[str] = []
        try:
            for one, two in zip(found, found[1:], strict=False):
                if one[0] == two[0] and (one[1] + one[2] > two[1] if self.partial else one[1] + one[2] != two[1]):
                    raise ValueError(f"clip {one[0]} has frames up to {one[1] + one[2] - 1} and then {two[1]}")
            if self.overwrite:
                self._clear(store, path)
            for clip, first, _, name, suffix in found:
                target = f"{path}/{clip}{suffix}" if first == 0 else f"{path}/{clip}@{first:010d}{suffix}"
                if not self.overwrite and store.get_file_info(target).type.name != "NotFound":
                    raise ValueError(f"{target} exists")
                store.move(name, target)
                moved.append(target)
        except Exception:
            for target in moved:
                store.delete_file(target)
            raise
        finally:
            self._unstage()

    def abort(self, messages: Sequence[Segments | None]) -> None:
        self._unstage()

    def _clear(self, store, path: str) -> None:
        from pyarrow import fs

        for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if f.is_file:
                store.delete_file(f.path)

    def _unstage(self) -> None:
        store, path = self._store()
        if store.get_file_info(f"{path}/{self.stage}").type.name == "Directory":
            store.delete_dir(f"{path}/{self.stage}")


class PlanarSource(DataSource):
    """spark.read.format("planar") with path, height, width and, at will, frames, cheight, cwidth, planes, dtype, start, clip.

    path is a container file or a folder of them, one or more a clip, in a store
    that pyarrow opens by its address. A partition reads only its own range of
    frames. df.write.format("planar") takes the same options; write_planar()
    puts the rows in order for it.
    """

    @classmethod
    def name(cls) -> str:
        return "planar"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return PlanarReader(dict(self.options))

    def writer(self, schema, overwrite: bool):
        return PlanarWriter(dict(self.options), overwrite)


def scan_planar(spark: SparkSession, path: str, height: int, width: int, frames: int | None = None, **options) -> DataFrame:
    """Samples of a container file or a folder of them, of the first `frames` frames where a number is given."""
    spark.dataSource.register(PlanarSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else Spark refuses sources that take filters
    if frames is not None:
        options["frames"] = frames
    return spark.read.format("planar").options(path=path, height=height, width=width, **options).load()


def write_planar(samples: DataFrame, path: str, height: int, width: int, mode: str = "append", **options) -> None:
    """Writes (clip, plane, frame, y, x, v) as planar containers, which scan_planar() reads back.

    A clip is one file, or one for each range of frames that a task had; ranges
    must meet. Values are rounded and cut to the type's range. With mode
    "overwrite" the folder's files go when all tasks are done, not before.
    Frames with missing or extra samples, and gaps between frames, are errors
    that leave the folder as it was. With partial="true" missing samples and
    frames are kept as missing; scan_planar() makes no rows of them.
    """
    planes = options.get("planes", "y,u,v").split(",")
    rank = F.array_position(F.array(*map(F.lit, planes)), F.col("plane"))
    rows = samples.select("clip", "plane", F.col("frame").cast("int").alias("frame"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v"))
    samples.sparkSession.dataSource.register(PlanarSource)
    rows.repartitionByRange("clip", "frame").sortWithinPartitions("clip", "frame", rank, "y", "x").write.format("planar").options(path=path, height=height, width=width, **options).mode(mode).save()


def scan_planar_template(spark: SparkSession, glob: str, height: int, width: int, dtype: str = "uint8", planes: str = "y") -> DataFrame:
    """Samples of one file per frame, whose last number in the name is the frame; missing ones are told as frame_bytes() does."""
    files = spark.read.format("binaryFile").load(glob).select(F.regexp_extract("path", r"(\d+)\.[^./]*$", 1).cast("int").alias("frame"), F.regexp_extract("path", r"([^/]*?)_?\d+\.[^./]*$", 1).alias("clip"), "content")
    sizes, kind = [(p, height, width) for p in planes.split(",")], np.dtype(dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, clip, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _planes(raw, clip, frame, sizes, kind)

    return files.mapInArrow(run, SCHEMA)


def write_files(files: DataFrame, folder: str) -> None:
    """Writes (name, content binary) as files of a folder, from the tasks; a task that runs again writes the same files."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{base}/{name}") as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files.select("name", "content").mapInArrow(put, "n bigint").agg(F.sum("n")).collect()


def frame_bytes(samples: DataFrame, sizes: Sequence[tuple[str, int, int]] | None = None) -> DataFrame:
    """(clip, frame, body binary): clipped and rounded to bytes, planes in order, rows then columns.

    With sizes (plane, height, width), a frame that lacks samples has 0 in their
    places and, after its bytes, a bit for each place, set where there is one.
    """
    byte = F.least(F.greatest(F.round("v"), F.lit(0.0)), F.lit(255.0)).cast("int")
    order = F.when(F.col("plane") == "y", 0).when(F.col("plane") == "u", 1).otherwise(2)
    rows = samples.groupBy("clip", "frame", order.alias("p"), "y").agg(F.array_sort(F.collect_list(F.struct("x", byte.alias("b")))).alias("row"))
    rows = rows.withColumn("xs", F.transform("row", lambda s: s["x"])).withColumn("row", F.unhex(F.array_join(F.transform("row", lambda s: F.lpad(F.hex(s["b"]), 2, "0")), "")))
    whole = rows.groupBy("clip", "frame").agg(F.array_sort(F.collect_list(F.struct("p", "y", "row", "xs"))).alias("rows"))
    bodies = whole.select("clip", "frame", F.unhex(F.array_join(F.transform("rows", lambda s: F.hex(s["row"])), "")).alias("body"), "rows")
    if sizes is None:
        return bodies.drop("rows")
    n = sum(h * w for _, h, w in sizes)
    rank, first = {"y": 0, "u": 1}, {}
    for k, (plane, _, width) in enumerate(sizes):
        first[rank.get(plane, 2)] = (sum(h * w for _, h, w in sizes[:k]), width)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, lines in zip(batch.column("body").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                if len(body) != n:
                    spots = np.array([first[s["p"]][0] + s["y"] * first[s["p"]][1] + x for s in lines for x in s["xs"]])
                    full, seen = np.zeros(n, np.uint8), np.zeros(n, bool)
                    full[spots], seen[spots] = np.frombuffer(body, np.uint8), True
                    body = full.tobytes() + np.packbits(seen).tobytes()
                out.append(body)
            yield pa.RecordBatch.from_arrays([batch.column("clip"), batch.column("frame"), pa.array(out, pa.binary())], ["clip", "frame", "body"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bodies.select("clip", "frame").schema)
    return bodies.mapInArrow(spread, kinds + ", body binary")
