"""GeoJSON features as a table of part files under a manifest: a sink that shows a write whole or not at all, and its reader.

    spark.dataSource.register(Features)
    tracks_as_features.write.format("trackloom_features").option("path", folder).mode("append").save()
    spark.read.format("trackloom_features").option("path", folder).load()

A task writes the features of its partition to a file of its own, one a line, and tells its name and rows. When all have ended, the
driver writes one manifest that lists them: only then they exist for a reader. A failed job removes what its tasks told of; what a
lost task left is listed nowhere. Overwriting names the manifests that count no more in the new one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .landed import opened

SCHEMA = "track_id string, feature string"
MANIFESTS, PARTS = "manifests", "parts"


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


def manifests(folder: str) -> list[dict]:
    """The manifests that count, oldest first."""
    fs, path = opened(folder)
    found = []
    for i in fs.get_file_info(pafs.FileSelector(f"{path}/{MANIFESTS}", allow_not_found=True)):
        if i.path.endswith(".json"):
            with fs.open_input_stream(i.path) as f:
                found.append(json.loads(f.read()) | {"name": i.base_name})
    gone = {n for m in found for n in m["replaces"]}
    return sorted((m for m in found if m["name"] not in gone), key=lambda m: m["name"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite = folder, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, path = opened(self.folder)
        fs.create_dir(f"{path}/{PARTS}", recursive=True)
        name, rows = f"{uuid.uuid4().hex}.jsonl", 0
        with fs.open_output_stream(f"{path}/{PARTS}/{name}") as out:
            for b in iterator:
                for track, feature in zip(b["track_id"].to_pylist(), b["feature"].to_pylist(), strict=True):
                    out.write((json.dumps({"track_id": track, "feature": feature}, ensure_ascii=False) + "\n").encode())
                rows += b.num_rows
        return Part(name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        fs, path = opened(self.folder)
        fs.create_dir(f"{path}/{MANIFESTS}", recursive=True)
        now = manifests(self.folder)
        number = 1 + max((int(m["name"].split("-")[0]) for m in now), default=0)
        said = {"parts": [{"name": m.name, "rows": m.rows} for m in messages if m and m.rows], "replaces": [m["name"] for m in now] if self.overwrite else []}
        final = f"{path}/{MANIFESTS}/{number:012d}-{uuid.uuid4().hex}.json"
        # Complete before it has the name that readers look for.
        with fs.open_output_stream(f"{final}.tmp") as out:
            out.write(json.dumps(said).encode())
        fs.move(f"{final}.tmp", final)

    def abort(self, messages: list[Part | None]) -> None:
        fs, path = opened(self.folder)
        for m in messages:
            if m and fs.get_file_info(f"{path}/{PARTS}/{m.name}").is_file:
                fs.delete_file(f"{path}/{PARTS}/{m.name}")


class _Reader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p["name"]) for m in manifests(self.folder) for p in m["parts"]] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        if partition.value is None:
            return
        fs, path = opened(self.folder)
        with fs.open_input_stream(f"{path}/{PARTS}/{partition.value}") as f:
            rest = b""
            while block := f.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    row = json.loads(line)
                    yield row["track_id"], row["feature"]


class Features(DataSource):
    """track_id, feature (GeoJSON text)."""

    @classmethod
    def name(cls) -> str:
        return "trackloom_features"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)
