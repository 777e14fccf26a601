"""A data source over flattened samples, read at once or as a stream that stops and goes on anywhere, also within an image row.

``store_samples`` writes samples in order with their places; the source
``qa_samples`` reads them.  A stream's offset is a place, written out as the
row, the question type and the number of the last sample before it.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import accumulate, groupby

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from caravel.operators.ordering import running


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    uri = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
    return (pyarrow.fs.LocalFileSystem(), uri) if "://" not in uri else pyarrow.fs.FileSystem.from_uri(uri)


def _open(path: str) -> pyarrow.dataset.Dataset:
    system, place = _place(path)
    return pyarrow.dataset.dataset(place, filesystem=system, format="parquet", exclude_invalid_files=False)


#: Bytes of a stored row group, the least that a task reads; tasks of a read or batch at most.
GROUP_BYTES, TASKS = 1 << 20, 1_000


def store_samples(samples: DataFrame, path: str) -> None:
    """Write samples (row_index, ord, qa_index and others) as Parquet in their order, with ``place`` from 0."""
    order = ["row_index", "ord", "qa_index"]
    placed = running(samples, [], order, into="place")
    placed.repartitionByRange("place").sortWithinPartitions("place").write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(path)


class Stretch(InputPartition):
    """The samples of places ``begin`` to ``end`` - 1, and the row groups of files that can hold them."""

    def __init__(self, begin: int, end: int, parts: list[tuple[str, list[int]]]) -> None:
        self.begin, self.end, self.parts = begin, end, parts


class _Groups:
    """The row groups of stored samples by their places, read once from the ends of the files."""

    def __init__(self, path: str) -> None:
        found = []
        for file in _open(path).get_fragments():
            for group in file.row_groups:
                held = (group.statistics or {}).get("place")  # without it the group can hold any place
                found.append((held["min"], held["max"], file.path, group.id) if held else (-1, 2**63, file.path, group.id))
        self.found = sorted(found)
        self.least = [f[0] for f in self.found]
        self.most = list(accumulate((f[1] for f in self.found), max))

    def stretch(self, begin: int, end: int) -> Stretch:
        near = self.found[bisect_left(self.most, begin) : bisect_left(self.least, end)]
        held = [(file, group) for _, most, file, group in near if most >= begin]
        return Stretch(begin, end, [(file, [g for _, g in groups]) for file, groups in groupby(held, lambda f: f[0])])

    def stretches(self, begin: int, end: int, size: int) -> list[Stretch]:
        size = max(size, -(-(end - begin) // TASKS))
        return [self.stretch(i, min(i + size, end)) for i in range(begin, end, size)] or [Stretch(begin, begin, [])]


class _Samples:
    def __init__(self, options: dict[str, str]) -> None:
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.size = options["path"], int(options.get("samplespertask", 100_000))
        self.most = int(options["samplesperbatch"]) if "samplesperbatch" in options else None
        self.file = options.get("progress")
        self.columns = json.loads(options["columns"]) if "columns" in options else None

    def total(self) -> int:
        return _open(self.path).count_rows(use_threads=False)

    def tables(self, stretch: Stretch, columns: list[str] | None) -> Iterator[pa.Table]:
        """What a stretch holds, a row group at a time; only its own files are opened."""
        system, _ = _place(self.path)
        place = pyarrow.dataset.field("place")
        within = (place >= stretch.begin) & (place < stretch.end)
        for file, groups in stretch.parts:
            for group in pyarrow.dataset.ParquetFileFormat().make_fragment(file, filesystem=system, row_groups=groups).split_by_row_group():
                yield group.to_table(columns=columns, filter=within, use_threads=False)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        for rows in self.tables(partition, self.columns):
            yield from rows.sort_by("place").to_batches(max_chunksize=4_096) if "place" in rows.column_names else rows.to_batches(max_chunksize=4_096)

    def offset(self, place: int) -> dict:
        """The place with the row, question type and number of the last sample before it."""
        out = {"place": place, "row": -1, "category": "", "index": -1}
        if place:
            found = self.tables(_Groups(self.path).stretch(place - 1, place), ["row_index", "category", "qa_index"])
            last = next((r for rows in found for r in rows.to_pylist()), None)
            if last:
                out |= {"row": last["row_index"], "category": last["category"], "index": last["qa_index"]}
        return out


class SampleReader(_Samples, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        return _Groups(self.path).stretches(0, self.total(), self.size)


class SampleStreamReader(_Samples, DataSourceStreamReader):
    """A batch takes all that is there, or ``samplesPerBatch`` samples.

    The engine asks for the end of a batch before it tells where it begins, so
    with samplesPerBatch the last planned end is kept in the file ``progress``,
    which belongs to the stream's checkpoint.
    """

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        if self.most is not None and not self.file:
            raise ValueError("samplesPerBatch needs the option progress, a file beside the stream's checkpoint")

    def planned(self) -> int:
        system, place = _place(self.file)
        if system.get_file_info(place).type == pyarrow.fs.FileType.NotFound:
            return 0
        with system.open_input_file(place) as f:
            return json.loads(f.read())["place"]

    def initialOffset(self) -> dict:
        return self.offset(0)

    def latestOffset(self) -> dict:
        total = self.total()
        return self.offset(total if self.most is None else min(total, self.planned() + self.most))

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if self.most is not None:
            system, place = _place(self.file)
            system.create_dir(place.rsplit("/", 1)[0], recursive=True)
            done = json.dumps({"place": max(end["place"], self.planned())}).encode()
            with system.open_output_stream(f"{place}.new") as f:
                f.write(done)
            system.move(f"{place}.new", place)
        return _Groups(self.path).stretches(start["place"], end["place"], self.size)


class SampleSource(DataSource):
    """Options: ``path``; ``columns`` (JSON list), samplesPerTask; for streams samplesPerBatch with progress.

    A task reads samplesPerTask samples, or more where a read or batch would
    else have more than ``TASKS`` tasks: each costs a tenth of a second and a
    stream's sink a file, however little it reads.
    """

    @classmethod
    def name(cls) -> str:
        return "qa_samples"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        whole = _open(self.options["path"]).schema
        names = json.loads(self.options["columns"]) if "columns" in self.options else whole.names
        return from_arrow_schema(pa.schema([whole.field(n) for n in names]))

    def reader(self, schema) -> DataSourceReader:
        return SampleReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SampleStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("qa_samples")`` and ``spark.readStream.format("qa_samples")`` known."""
    spark.dataSource.register(SampleSource)


def split_at(samples: DataFrame, place: int) -> DataFrame:
    """The samples from a place on."""
    return samples.filter(F.col("place") >= place)
