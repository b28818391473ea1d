"""A data source whose rows appear all at once or not at all: ``format("run_records")``.

Each task writes its rows as one JSON-lines file under a name that nothing lists.
Only when all tasks are done does the driver write a commit, a small file that names
them; readers see the files that commits name.  A task that is killed, run twice, or
part of a job that fails leaves files that no commit names, which `sweep` removes.
With option ``partial`` the rows of a run that a cap cut short are committed apart,
and read only with the same option.

``format("evidence_script")`` reads a script that sets ``window.EVIDENCE``: a row
for each of its items.

Paths are those of `pyarrow.fs`, in a folder that driver and executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _names(path: str, folder: str, ending: str) -> list[str]:
    from pyarrow import fs

    store, base = _open(path)
    found = store.get_file_info(fs.FileSelector(f"{base}/{folder}", allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.endswith(ending))


def committed(path: str, partial: bool) -> list[str]:
    """The data files that commits name."""
    store, base = _open(path)
    files = []
    for name in _names(path, "partial-commits" if partial else "commits", ".json"):
        with store.open_input_stream(name) as f:
            files += json.loads(f.read())["files"]
    return [f"{base}/{f}" for f in files]


def sweep(path: str) -> int:
    """Removes data files that no commit names; no writer may be at work."""
    store, _ = _open(path)
    named = {*committed(path, False), *committed(path, True)}
    gone = [f for f in _names(path, "data", ".jsonl") if f not in named]
    for f in gone:
        store.delete_file(f)
    return len(gone)


@dataclass
class _Wrote(WriterCommitMessage):
    file: str
    rows: int


@dataclass
class _File(InputPartition):
    name: str


class _Writer(DataSourceWriter):
    def __init__(self, path: str, partial: bool):
        self.path, self.partial = path, partial

    def write(self, rows: Iterator[Row]) -> _Wrote:
        store, base = _open(self.path)
        store.create_dir(f"{base}/data", recursive=True)
        name, n = f"data/{uuid.uuid4().hex}.jsonl", 0
        with store.open_output_stream(f"{base}/{name}") as f:
            for row in rows:
                f.write((json.dumps(row.asDict(recursive=True), ensure_ascii=False, allow_nan=False, default=str) + "\n").encode())
                n += 1
        return _Wrote(name, n)

    def commit(self, messages: list[_Wrote | None]) -> None:
        store, base = _open(self.path)
        folder = f"{base}/{'partial-commits' if self.partial else 'commits'}"
        store.create_dir(folder, recursive=True)
        name = uuid.uuid4().hex
        done = [m for m in messages if m and m.rows]
        with store.open_output_stream(f"{folder}/.{name}") as f:
            f.write(json.dumps({"files": [m.file for m in done], "rows": sum(m.rows for m in done)}).encode())
        store.move(f"{folder}/.{name}", f"{folder}/{name}.json")

    def abort(self, messages: list[_Wrote | None]) -> None:
        store, base = _open(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{base}/{m.file}")


class _Reader(DataSourceReader):
    def __init__(self, path: str, partial: bool, schema: StructType):
        self.path, self.partial, self.schema = path, partial, schema

    def partitions(self) -> list[_File]:
        return [_File(f) for f in committed(self.path, self.partial)] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.name:
            return
        store, _ = _open(self.path)
        with store.open_input_stream(partition.name) as f:
            rest = b""
            while block := f.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    yield _row(json.loads(line), self.schema)


def _row(value: dict, schema: StructType) -> tuple:
    """The fields of ``schema`` in order; nested structs become tuples."""

    def of(x: object, kind) -> object:
        name = kind.typeName()
        if x is None:
            return None
        if name == "struct":
            return tuple(of(x.get(f.name), f.dataType) for f in kind)
        if name == "array":
            return [of(v, kind.elementType) for v in x]
        if name == "map":
            return {k: of(v, kind.valueType) for k, v in x.items()}
        return float(x) if name == "double" else x

    return of(value, schema)


class RunRecords(DataSource):
    """Options: path, partial (false)."""

    @classmethod
    def name(cls) -> str:
        return "run_records"

    def _partial(self) -> bool:
        return self.options.get("partial", "false").lower() == "true"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("records are only added: use mode('append')")
        return _Writer(self.options["path"], self._partial())

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], self._partial(), schema)


class _Script(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, place = _open(self.path)
        with store.open_input_stream(place) as f:
            text = f.read().decode()
        found = json.JSONDecoder().raw_decode(text, text.index("{"))[0]
        for item in found.get("items", []):
            yield _row(item, self.schema)


class EvidenceScript(DataSource):
    """Option: path, of one file."""

    @classmethod
    def name(cls) -> str:
        return "evidence_script"

    def reader(self, schema: StructType) -> _Script:
        return _Script(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RunRecords)
    spark.dataSource.register(EvidenceScript)
