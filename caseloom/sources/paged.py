"""A source that is read page by page, as an HTTP table service is: one task a page, equality and range filters applied where the page is read, errors raised and never an empty result instead."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: What a page can be asked for, besides its columns.
_TESTS = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def export(rows: DataFrame, path: str, size: int) -> None:
    """rows as pages of at most `size` rows below a path that all machines see."""
    rows.write.option("maxRecordsPerFile", size).parquet(path)


class Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str):
        self.kinds, self.names, self.path, self.tests = schema, schema.names, path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters that a page answers itself stay here, the others go back to Spark."""
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in self.names:
                self.tests.append((type(f), f.attribute[0], f.value))
            else:
                yield f

    def partitions(self) -> list[Page]:
        store, root = fs.FileSystem.from_uri(self.path)
        found = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
        if not found:
            raise FileNotFoundError(f"no page below {self.path}")
        return [Page(p) for p in found]

    def read(self, page: Page) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        kinds = to_arrow_schema(self.kinds)
        with store.open_input_file(page.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=list(self.names)):
                rows = pa.Table.from_batches([batch]).select(self.names).cast(kinds)
                for kind, name, value in self.tests:
                    rows = rows.filter(_TESTS[kind](rows.column(name), value))
                yield from rows.to_batches()


class PagedSource(DataSource):
    """Options: path, a URI of a folder of pages."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("a paged source needs a schema")

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, self.options["path"])


def scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all pages; filters on one column against a value go to the pages."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").schema(schema).option("path", path).load()
