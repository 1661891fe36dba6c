"""A stream sink for result documents: an epoch is there as a whole, once, or not at all.

    spark.dataSource.register(DocumentSink)
    documents.writeStream.format("windrow_documents").option("path", "hdfs://.../results").start()

Tasks write files that nobody reads; commit moves an epoch's files into its folder and then gives the folder its name. An
epoch that runs again after its folder has got that name changes nothing. A task that fails removes its file; abort removes
those of the others. documents_of() reads what is there: equal documents are one, as in a set.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from uuid import uuid4

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

STAGED = "_staged"


@dataclass
class Written(WriterCommitMessage):
    file: str
    documents: int


class DocumentWriter(DataSourceStreamWriter):
    """Rows become JSON documents, one a line; a row of one string column named value is a document by itself."""

    def __init__(self, options: Mapping[str, str]):
        self.path = options["path"].rstrip("/")

    def _folder(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[Row]) -> Written:
        files, top = self._folder()
        files.create_dir(f"{top}/{STAGED}", recursive=True)
        name, n = f"{uuid4().hex}.json", 0
        try:
            with files.open_output_stream(f"{top}/{STAGED}/{name}") as out:
                for row in iterator:
                    values = row.asDict(recursive=True)
                    line = values["value"] if list(values) == ["value"] else json.dumps(values, default=str, ensure_ascii=False)
                    out.write(line.encode() + b"\n")
                    n += 1
        except BaseException:
            self._remove([name])
            raise
        return Written(name, n)

    def _remove(self, names: list[str]) -> None:
        files, top = self._folder()
        for name in names:
            at = f"{top}/{STAGED}/{name}"
            if files.get_file_info(at).type != fs.FileType.NotFound:
                files.delete_file(at)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        files, top = self._folder()
        done = f"{top}/epoch={batchId}"
        if files.get_file_info(done).type != fs.FileType.NotFound:
            return self.abort(messages, batchId)
        making = f"{top}/_epoch-{batchId}-{uuid4().hex}"
        files.create_dir(making, recursive=True)
        for m in messages:
            if m is not None and m.documents:
                files.move(f"{top}/{STAGED}/{m.file}", f"{making}/{m.file}")
            elif m is not None:
                self._remove([m.file])
        files.move(making, done)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._remove([m.file for m in messages if m is not None])


class DocumentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "windrow_documents"

    def streamWriter(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options)


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """value: the documents of all epochs, equal ones once."""
    return spark.read.option("recursiveFileLookup", False).text(f"{path.rstrip('/')}/epoch=*").select("value").distinct()
