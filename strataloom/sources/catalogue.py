"""A catalogue of blocks as a data source: pages by key that are read in parallel, a log of commits that a stream can follow, writes that count as a whole.

A catalogue is a folder: ``parts/<write>/`` holds Parquet files of (root, wire), ``log/`` a JSON file a commit that names its files with their first and last root.
A write's files exist for readers only once its log entry does, so a write that fails or is aborted changes nothing, and retried tasks leave
no second copy. Spark's parts run in workers of their own, so all of it is in one class that is sent whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "root string, wire string"
NAME = "block_catalogue"


def source_class():
    """The data source. Options: path; after (only roots behind it), until (only roots up to it); from (streams: commits to leave out)."""
    import contextlib
    import json
    import uuid

    from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

    class Folder:
        def __init__(self, path: str):
            from pyarrow import fs

            path = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
            self.fs, self.root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

        def log(self) -> list[tuple[int, str]]:
            from pyarrow import fs

            found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/log", allow_not_found=True))
            return sorted((int(f.base_name[:-5]), f.path) for f in found if f.base_name.endswith(".json"))

        def files(self, since: int, upto: int | None) -> list[dict]:
            out = []
            for number, path in self.log():
                if number > since and (upto is None or number <= upto):
                    with self.fs.open_input_stream(path) as f:
                        out += json.loads(f.read())
            return out

        def append(self, files: list[dict]) -> None:
            self.fs.create_dir(f"{self.root}/log", recursive=True)
            number = max([n for n, _ in self.log()], default=0) + 1
            draft = f"{self.root}/log/{number:012d}.{uuid.uuid4().hex}"
            with self.fs.open_output_stream(draft) as f:
                f.write(json.dumps(sorted(files, key=lambda x: x["first"])).encode())
            self.fs.move(draft, f"{self.root}/log/{number:012d}.json")

    class Keys(InputPartition):
        def __init__(self, file: str):
            super().__init__(file)
            self.file = file

    class Message(WriterCommitMessage):
        def __init__(self, files: list[dict]):
            self.files = files

    def parts(folder: Folder, options: dict, since: int = 0, upto: int | None = None) -> list:
        after, until = options.get("after", ""), options.get("until")
        return [Keys(f["file"]) for f in folder.files(since, upto) if f["last"] > after and (until is None or f["first"] <= until)]

    def rows(options: dict, part: Keys):
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        folder, after, until = Folder(options["path"]), options.get("after"), options.get("until")
        with folder.fs.open_input_file(f"{folder.root}/{part.file}") as f:
            for batch in pq.ParquetFile(f).iter_batches(8192):
                keep = None
                for bound, test in ((after, pc.greater), (until, pc.less_equal)):
                    if bound is not None:
                        ok = test(batch.column("root"), bound)
                        keep = ok if keep is None else pc.and_(keep, ok)
                yield batch if keep is None else batch.filter(keep)

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = options

        def partitions(self):
            return parts(Folder(self.options["path"]), self.options) or [Keys("")]

        def read(self, partition):
            if partition.file:
                yield from rows(self.options, partition)

    class Stream(DataSourceStreamReader):
        def __init__(self, options: dict):
            self.options = options

        def initialOffset(self):
            return {"commit": int(self.options.get("from", 0))}

        def latestOffset(self):
            return {"commit": max([n for n, _ in Folder(self.options["path"]).log()], default=int(self.options.get("from", 0)))}

        def partitions(self, start, end):
            return parts(Folder(self.options["path"]), self.options, start["commit"], end["commit"]) or [Keys("")]

        def read(self, partition):
            if partition.file:
                yield from rows(self.options, partition)

        def commit(self, end):
            pass

    class Writer(DataSourceArrowWriter):
        def __init__(self, options: dict):
            self.path, self.write_id = options["path"], uuid.uuid4().hex

        def write(self, iterator):
            import pyarrow as pa
            import pyarrow.compute as pc
            import pyarrow.parquet as pq

            folder, n, first, last, out = Folder(self.path), 0, None, None, None
            name = f"parts/{self.write_id}/{uuid.uuid4().hex}.parquet"
            kind = pa.schema([("root", pa.string()), ("wire", pa.string())])
            for b in iterator:
                if not b.num_rows:
                    continue
                if b.column("root").null_count:
                    raise ValueError("a row of the catalogue needs a root")
                if out is None:
                    folder.fs.create_dir(f"{folder.root}/parts/{self.write_id}", recursive=True)
                    out = pq.ParquetWriter(folder.fs.open_output_stream(f"{folder.root}/{name}"), kind)
                ends = pc.min_max(b.column("root")).as_py()
                first, last = min(x for x in (first, ends["min"]) if x is not None), max(x for x in (last, ends["max"]) if x is not None)
                n += b.num_rows
                out.write_batch(pa.RecordBatch.from_arrays([b.column("root").cast(pa.string()), b.column("wire").cast(pa.string())], schema=kind))
            if out is None:
                return Message([])
            sink = out.sink if hasattr(out, "sink") else None
            out.close()
            with contextlib.suppress(AttributeError, ValueError):
                (sink or out.file_handle).close()
            return Message([{"file": name, "first": first, "last": last, "rows": n}])

        def commit(self, messages):
            files = [f for m in messages if m is not None for f in m.files]
            if files:
                Folder(self.path).append(files)

        def abort(self, messages):
            folder = Folder(self.path)
            with contextlib.suppress(FileNotFoundError, OSError):
                folder.fs.delete_dir(f"{folder.root}/parts/{self.write_id}")

    class BlockCatalogue(DataSource):
        @classmethod
        def name(cls):
            return NAME

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader(dict(self.options))

        def streamReader(self, schema):
            return Stream(dict(self.options))

        def writer(self, schema, overwrite):
            if overwrite:
                raise ValueError("a catalogue is only appended to")
            return Writer(dict(self.options))

    return BlockCatalogue


def registered(spark: SparkSession) -> SparkSession:
    """The session, with the format ``block_catalogue``."""
    spark.dataSource.register(source_class())
    return spark


def append(rows: DataFrame, path: str) -> None:
    """Write (root, wire) as one commit, in files of key ranges that don't overlap."""
    registered(rows.sparkSession)
    rows.select("root", "wire").repartitionByRange("root").sortWithinPartitions("root").write.format(NAME).mode("append").option("path", path).save()


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    return registered(spark).read.format(NAME).options(path=path, **options).load()


def follow(spark: SparkSession, path: str, **options) -> DataFrame:
    """A stream of what is committed, commit by commit."""
    return registered(spark).readStream.format(NAME).options(path=path, **options).load()
