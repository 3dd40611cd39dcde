"""Recorded scenes as a data source: one file a scene, several a large one, read without a simulator (S11, 2.14).

    spark.dataSource.register(RecordedScenes)
    spark.read.format("recorded_scenes").load(folder).where("scene_id = 'kitchen 1'")

A scene's file is named by its id, so a filter on scene_id is answered before any file is opened: the
source lists the folder, keeps the scenes that are asked for, and makes partitions of them. Another
source of scenes implements SceneSource and plugs into the same reader. A large scene is written and read
by many tasks, a file each: its files are numbered after a +, which no quoted id has.
"""

from __future__ import annotations

import io
import json
import math
from collections.abc import Iterator
from itertools import batched
from typing import Protocol
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition

from corroborate.operators.lineage import ROWS_PER_TASK

SCHEMA = "scene_id string, object_id string, object_type string, properties map<string,string>, relations array<struct<predicate: string, object: string>>"
SUFFIX = ".scene.json"
#: Bytes of scenes that a partition holds, about; a larger scene or piece of one is alone.
PARTITION_BYTES = 32 << 20
#: Objects of a file, about; a scene of more is written as several files.
OBJECTS_PER_FILE = ROWS_PER_TASK
#: Objects that a reading task hands on at a time.
BATCH = 5000
_RELATIONS = pa.list_(pa.struct([("predicate", pa.string()), ("object", pa.string())]))
_KINDS = {"scene_id": pa.string(), "object_id": pa.string(), "object_type": pa.string(), "properties": pa.map_(pa.string(), pa.string()), "relations": _RELATIONS}


class SceneSource(Protocol):
    """What the reader needs of a store of scenes. Each call may come from another process. A store whose scenes
    are large may have `pieces` besides: (id, piece, bytes) of what a task may read alone, by objects(id, piece)."""

    def scenes(self) -> Iterator[tuple[str, int]]:
        """(id, bytes) of every scene."""

    def objects(self, scene_id: str) -> Iterator[dict]:
        """The scene's objects: object_id, object_type, properties, relations."""


def _file(scene_id: str, piece: int | None) -> str:
    return quote(scene_id, safe="") + ("" if piece is None else f"+{piece}") + SUFFIX


class FolderOfScenes:
    """Scenes as JSON Lines files of objects, in a folder of any file system that Arrow knows."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _at(self) -> tuple[fs.FileSystem, str]:
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return store, root.rstrip("/")

    def scenes(self) -> Iterator[tuple[str, int]]:
        sizes: dict[str, int] = {}
        for scene_id, _, size in self.pieces():
            sizes[scene_id] = sizes.get(scene_id, 0) + size
        yield from sizes.items()

    def pieces(self) -> Iterator[tuple[str, int | None, int]]:
        """(id, number, bytes) of every file; no number where it is the whole scene."""
        store, root = self._at()
        for info in store.get_file_info(fs.FileSelector(root, recursive=False)):
            if info.type == fs.FileType.File and info.base_name.endswith(SUFFIX):
                name, _, piece = info.base_name.removesuffix(SUFFIX).partition("+")
                yield unquote(name), int(piece) if piece else None, info.size

    def objects(self, scene_id: str, piece: int | None = None) -> Iterator[dict]:
        store, root = self._at()
        with store.open_input_stream(f"{root}/{_file(scene_id, piece)}") as f:
            for line in io.TextIOWrapper(io.BufferedReader(f, 1 << 20), encoding="utf-8", newline="\n"):
                if line.strip():
                    yield json.loads(line)


class _Scenes(InputPartition):
    def __init__(self, pieces: list[tuple]) -> None:
        #: The arguments of `objects`, for each.
        self.pieces = pieces

    @property
    def ids(self) -> list[str]:
        return [scene_id for scene_id, *_ in self.pieces]


class _SceneReader(DataSourceReader):
    def __init__(self, source: SceneSource) -> None:
        self.source = source
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Equality and lists on scene_id are answered by the listing; the rest is Spark's."""
        for f in filters:
            if getattr(f, "attribute", None) == ("scene_id",) and isinstance(f, EqualTo | EqualNullSafe | In):
                asked = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted = asked if self.wanted is None else self.wanted & asked
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Scenes that are asked for, by id, in partitions of PARTITION_BYTES."""
        found = self.source.pieces() if hasattr(self.source, "pieces") else self.source.scenes()
        out, pieces, size = [], [], 0
        for *piece, n in sorted(found, key=lambda x: (x[0], -1 if x[1] is None else x[1])):
            if self.wanted is not None and piece[0] not in self.wanted:
                continue
            if pieces and size + n > PARTITION_BYTES:
                out.append(_Scenes(pieces))
                pieces, size = [], 0
            pieces, size = [*pieces, tuple(piece)], size + n
        return out + [_Scenes(pieces)] * bool(pieces)

    def read(self, partition: _Scenes) -> Iterator[pa.RecordBatch]:
        for piece in partition.pieces if isinstance(partition, _Scenes) else ():
            for some in batched(self.source.objects(*piece), BATCH):
                relations = [[(r.get("predicate"), r.get("object")) for r in o.get("relations") or []] for o in some]
                properties = [[(k, None if v is None else str(v)) for k, v in (o.get("properties") or {}).items()] for o in some]
                columns = [[piece[0]] * len(some), [o.get("object_id") for o in some], [o.get("object_type") for o in some], properties, relations]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS.values(), strict=True)], list(_KINDS))


class RecordedScenes(DataSource):
    """Format recorded_scenes; option path: the folder."""

    @classmethod
    def name(cls) -> str:
        return "recorded_scenes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _SceneReader(FolderOfScenes(self.options["path"]))


def read_scenes(spark: SparkSession, path: str, scene_ids: list[str] | None = None) -> DataFrame:
    """(scene_id, object_id, object_type, properties, relations) of recorded scenes; with ids, of these
    only: other scenes' files are not opened."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedScenes)
    rows = spark.read.format("recorded_scenes").load(path)
    return rows if scene_ids is None else rows.where(F.col("scene_id").isin(*scene_ids)) if scene_ids else rows.limit(0)


def write_scenes(objects: DataFrame, path: str) -> None:
    """Scenes (scene_id and the columns above) as files that read_scenes reads. A scene of more than
    OBJECTS_PER_FILE objects is dealt by their lines to as many files as it takes, so no task has it whole;
    lines are made in the JVM and written as they come. Scenes that are there already are replaced."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = FolderOfScenes(path)
        store, root = folder._at()
        store.create_dir(root, recursive=True)
        old: dict[str, list[int | None]] = {}
        for scene_id, piece, _ in folder.pieces():
            old.setdefault(scene_id, []).append(piece)
        now, out, n = None, None, 0
        try:
            for b in batches:
                lines = b.column("line").to_pylist()
                ends = sorted({e for c in ("scene_id", "piece") for e in pc.run_end_encode(b.column(c)).run_ends.to_pylist()})
                for begin, end in zip([0, *ends], ends):  # noqa: B905
                    scene_id, piece, files = (b.column(c)[begin].as_py() for c in ("scene_id", "piece", "files"))
                    if out is None or (scene_id, piece) != now:
                        if out:
                            out.close()
                        for k in old.pop(scene_id, ()):  # of an earlier write with another number of files
                            if (k is not None) if files == 1 else (k is None or k >= files):
                                _dropped(store, f"{root}/{_file(scene_id, k)}")
                        # a retried or second attempt writes the same bytes over
                        now, out, n = (scene_id, piece), store.open_output_stream(f"{root}/{_file(scene_id, piece if files > 1 else None)}"), n + 1
                    out.write(("\n".join(lines[begin:end]) + "\n").encode())
        finally:
            if out:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = objects.where(F.col("scene_id").isNotNull())
    # one row for each scene of several files, one for all others
    counts = rows.groupBy("scene_id").agg(F.count("*").alias("n"))
    large = counts.groupBy(F.when(F.col("n") > OBJECTS_PER_FILE, F.col("scene_id")).alias("scene_id")).agg(F.sum("n").alias("n")).collect()
    tasks = 2 * math.ceil(sum(r.n for r in large) / OBJECTS_PER_FILE)
    sizes = rows.sparkSession.createDataFrame([(r.scene_id, math.ceil(r.n / OBJECTS_PER_FILE)) for r in large if r.scene_id is not None], "scene_id string, files int")
    properties = F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties")
    line = F.to_json(F.struct("object_id", "object_type", properties, "relations"), {"ignoreNullFields": "false"})
    lines = rows.select("scene_id", line.alias("line")).join(F.broadcast(sizes), "scene_id", "left").withColumn("files", F.coalesce("files", F.lit(1)))
    dealt = lines.withColumn("h", F.xxhash64("line")).withColumn("piece", F.pmod("h", "files").cast("int")).repartition(max(1, tasks), "scene_id", "piece")
    # lines begin alike, so their hashes are compared first
    dealt.sortWithinPartitions("scene_id", "piece", "h", "line").drop("h").mapInArrow(each, "n long").agg(F.sum("n")).collect()


def _dropped(store: fs.FileSystem, file: str) -> None:
    try:
        store.delete_file(file)
    except FileNotFoundError:  # another task was first
        pass
