"""A Python data source: spark.read.format("docobj").load(folder) gives the nodes of every file in it.

Options: password, mode (tolerant or strict), view (nodes, xref or scan), glob. Register once for a session with
register(spark). Each file is one partition; a broken file is one error row.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioforge.functions.codecs import CodecError
from folioforge.functions.crypt import CryptError
from folioforge.sources.files import ERROR, NODES, XREF, File, Options, node_rows
from folioforge.sources.syntax import SyntaxIssue, kind_of

SCAN = "file_id string, ord int, obj long, gen long, kind string"


class DocumentObjects(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docobj"

    def schema(self) -> str:
        view = self.options.get("view", "nodes")
        return f"{ {'nodes': NODES, 'xref': XREF, 'scan': SCAN}[view] }, {ERROR}"

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options, len(schema.fields))


class Reader(DataSourceReader):
    def __init__(self, options: dict, width: int):
        self.options, self.width = options, width

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        path = self.options["path"].removeprefix("file://")
        found = [path] if os.path.isfile(path) else sorted(glob.glob(os.path.join(path, "**", self.options.get("glob", "*.pdf")), recursive=True))
        return [InputPartition(p) for p in found]

    def read(self, partition: InputPartition):
        o = Options(self.options.get("mode", "tolerant") != "strict", self.options.get("password", "").encode())
        fail = lambda *row: (*row, *[None] * (self.width - len(row)))
        try:
            with open(partition.value, "rb") as f:
                file = File.open(f.read(), o)
            yield from self.rows(partition.value, file)
        except (SyntaxIssue, CodecError, CryptError) as e:
            yield (*fail(partition.value)[:-2], e.code, str(e))

    def rows(self, name: str, f: File):
        view = self.options.get("view", "nodes")
        if view == "xref":
            for rev, section in enumerate(f.sections):
                for i, e in section:
                    yield name, rev, i, e.kind, e.pos, e.gen, e.stream, e.index, None, None
        elif view == "scan":
            for at, (ref, v, error) in enumerate(f.scan()):
                yield name, at, ref.id if ref else None, ref.gen if ref else None, kind_of(v) if error is None else None, error, error
        else:
            for i, e in sorted(f.table.items()):
                if e.kind != "Free":
                    try:
                        for row in node_rows(name, i, e.gen, f.get(i)):
                            yield *row, None, None
                    except (SyntaxIssue, CodecError, CryptError) as issue:
                        yield name, i, e.gen, *[None] * 15, issue.code, str(issue)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentObjects)
