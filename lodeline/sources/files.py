"""Readers of graph JSON and of document folders, as sources of Spark's Python data
source interface: spark.read.format("evidence_graph") and ("document_folder").

A table is as many partitions as the folder has files (or groups of small ones), so a
folder of any size is read by many tasks; both can be read as streams, which give out
each file once.  Folders are opened by pyarrow, so the path may be of any store that it
knows, on a disk that all executors share or remote.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import MapType, StringType, StructType

from ..schema import ENTITY, EVIDENCE, RELATIONSHIP

#: Bytes of files that a partition reads, at least one file.
PARTITION_BYTES = 16 << 20
PARTS = {"entities": (ENTITY, ("entities", "nodes")), "relationships": (RELATIONSHIP, ("relationships", "edges")), "evidence": (EVIDENCE, ("evidence",))}
DOCUMENT = "doc_id string, text string"


def _opened(path: str):
    """The store of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[int, str, int]]:
    """Time (ns), name and size of the files of a folder, oldest first; those whose names
    begin with a dot or underscore are no data."""
    from pyarrow import fs

    store, where = _opened(path)
    info = store.get_file_info(where)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(where, recursive=True))
    hidden = lambda p: any(x[:1] in "._" for x in p.removeprefix(where).split("/") if x)
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == fs.FileType.File and (f is info or not hidden(f.path)))


def _text(path: str, name: str) -> str:
    with _opened(path)[0].open_input_stream(name) as f:
        return f.read().decode("utf-8", "replace")


@dataclass
class Files(InputPartition):
    names: list[str]

    def __init__(self, names: list[str]) -> None:
        super().__init__(len(names))
        self.names = names


def grouped(files: list[tuple[int, str, int]], size: int = PARTITION_BYTES) -> list[Files]:
    out: list[list[str]] = []
    held = size
    for _, name, n in files:
        if held + n > size:
            out.append([])
            held = 0
        out[-1].append(name)
        held += n
    return [Files(names) for names in out]


def _cell(value, kind):
    """A JSON value as a value of a column; a list or map of a text column stays JSON."""
    if value is None:
        return None
    name = kind.typeName()
    if name == "array":
        return [None if v is None else str(v) for v in (value if isinstance(value, list) else [value])]
    if name == "map":
        return {k: _cell(v, kind.valueType) for k, v in value.items()} if isinstance(value, dict) else None
    try:
        return {"double": float, "integer": int, "boolean": bool}[name](value) if name != "string" else value if isinstance(value, str) else json.dumps(value)
    except (TypeError, ValueError):
        return None


def graph_rows(text: str, part: str) -> Iterator[tuple]:
    """The records of a part of a graph file; evidence may be a map by id."""
    schema, names = PARTS[part]
    whole = json.loads(text) if text.strip() else {}
    for name in names:
        found = whole.get(name)
        if found is None:
            continue
        if isinstance(found, dict):
            found = [{"evidence_id": k} | v for k, v in found.items()]
        for record in found:
            row = tuple(_cell(record.get(f.name), f.dataType) for f in schema.fields)
            extra = {k: v if isinstance(v, str) else json.dumps(v) for k, v in record.items() if k not in schema.names and v is not None}
            yield *([] if v is None and f.dataType.typeName() == "array" else v for v, f in zip(row, schema.fields, strict=True)), extra
        return


class _Graph:
    def __init__(self, options) -> None:
        self.path, self.part = options["path"], options.get("part", "entities")

    def rows(self, name: str) -> Iterator[tuple]:
        return graph_rows(_text(self.path, name), self.part)


class _Documents:
    def __init__(self, options) -> None:
        self.path = options["path"]

    def rows(self, name: str) -> Iterator[tuple]:
        yield name.rsplit("/", 1)[-1], _text(self.path, name)


class _Reader(DataSourceReader):
    def __init__(self, of) -> None:
        self.of = of

    def partitions(self) -> list[Files]:
        return grouped(listed(self.of.path))

    def read(self, partition: Files) -> Iterator[tuple]:
        for name in partition.names:
            yield from self.of.rows(name)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the time and name of the last file; files must be put in the folder whole, by a move."""

    def __init__(self, of) -> None:
        self.of = of

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = listed(self.of.path)
        return {"time": files[-1][0], "name": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        place = lambda o: (o["time"], o["name"])
        return grouped([f for f in listed(self.of.path) if place(start) < f[:2] <= place(end)])

    def read(self, partition: Files) -> Iterator[tuple]:
        return _Reader(self.of).read(partition)

    def commit(self, end: dict) -> None:
        pass


class GraphSource(DataSource):
    """Options: path, a file or folder of graph JSON; part, entities (as is),
    relationships or evidence."""

    @classmethod
    def name(cls) -> str:
        return "evidence_graph"

    def schema(self) -> StructType:
        return StructType([*PARTS[self.options.get("part", "entities")][0].fields]).add("extras", MapType(StringType(), StringType()))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(_Graph(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(_Graph(self.options))


class DocumentSource(DataSource):
    """Option: path, a folder of text files, each of which is a document."""

    @classmethod
    def name(cls) -> str:
        return "document_folder"

    def schema(self) -> str:
        return DOCUMENT

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(_Documents(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(_Documents(self.options))


def register(spark: SparkSession) -> None:
    for source in (GraphSource, DocumentSource):
        spark.dataSource.register(source)
