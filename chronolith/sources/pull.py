"""A pull-style adapter as a Spark data source: numbered batches until one is empty."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class BatchPartition(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class SequenceReader(DataSourceReader):
    """Reads ``batches`` numbered batches of ``size`` rows; every task takes a range of them."""

    def __init__(self, options: dict[str, str]):
        self.batches, self.size, self.tasks = (int(options.get(k, d)) for k, d in (("batches", "4"), ("size", "256"), ("tasks", "2")))

    def partitions(self):
        step = -(-self.batches // self.tasks)
        return [BatchPartition(i, min(i + step, self.batches)) for i in range(0, self.batches, step)]

    def read(self, partition: BatchPartition):
        for batch in range(partition.first, partition.last):
            for i in range(self.size):
                seq = batch * self.size + i
                yield seq, f"entity-{seq % 97}", f"observation {seq}"


class RequestSource(DataSource):
    """``spark.dataSource.register(RequestSource)``; then ``spark.read.format("requests")``."""

    @classmethod
    def name(cls) -> str:
        return "requests"

    def schema(self) -> str:
        return "seq long, entity string, content string"

    def reader(self, schema) -> DataSourceReader:
        return SequenceReader(self.options)
