"""Files of length-prefixed frames, as recorded requests are kept: a data source for batches and streams.

A frame is the length of its payload as a little-endian unsigned 32-bit number, and the payload, of at most
``MOST`` bytes.  A file is split at frame borders, so one large file is many tasks' work.  A frame that is over the limit or not whole is an
error that names the file and the place.  Files are reached by Arrow's file systems (a local path, or a URI such as hdfs://), from the
driver and from all executors.

    spark.dataSource.register(FrameSource)
    spark.read.format("frames").load(folder)                     # file, at, payload
    df.select("payload").write.format("frames").mode("append").save(folder)
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MOST = 64 * 1024 * 1024
#: Bytes of a file that one task reads, unless the option ``splitBytes`` says otherwise.
SPLIT = 32 * 1024 * 1024
SUFFIX = ".frames"


class FrameError(ValueError):
    pass


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a folder's files of frames, or of one file, in order of name."""
    fs, at = _open(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    if info.type == pafs.FileType.NotFound:
        return []
    top = path.rstrip("/")
    return sorted((f"{top}/{f.base_name}", f.size) for f in fs.get_file_info(pafs.FileSelector(at)) if f.type == pafs.FileType.File and f.base_name.endswith(SUFFIX))


def _length(head: bytes, file: str, at: int) -> int:
    if len(head) < 4:
        raise FrameError(f"{file}: frame at byte {at} isn't whole")
    n = int.from_bytes(head, "little")
    if n > MOST:
        raise FrameError(f"{file}: frame at byte {at} is too large: {n} bytes of at most {MOST}")
    return n


def borders(file: str, start: int, end: int, split: int) -> list[tuple[int, int]]:
    """Ranges of about ``split`` bytes that begin and end between frames; only lengths are read."""
    fs, path = _open(file)
    out, at, begin = [], start, start
    with fs.open_input_file(path) as f:
        while at < end:
            f.seek(at)
            at += 4 + _length(f.read(min(4, end - at)), file, at)
            if at > end:
                raise FrameError(f"{file}: the last frame isn't whole")
            if at - begin >= split or at == end:
                out.append((begin, at))
                begin = at
    return out


class Frames(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def _read(part: Frames) -> Iterator[tuple[str, int, bytes]]:
    fs, path = _open(part.file)
    at = part.start
    with fs.open_input_file(path) as f:
        f.seek(at)
        while at < part.end:
            n = _length(f.read(4), part.file, at)
            payload = f.read(n)
            if len(payload) < n:
                raise FrameError(f"{part.file}: frame at byte {at} isn't whole")
            yield part.file, at, payload
            at += 4 + n


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "file string, at long, payload binary"

    def _where(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("splitBytes", SPLIT))

    def reader(self, schema: StructType) -> DataSourceReader:
        return FrameReader(*self._where())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FrameStream(*self._where())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("frames are appended to a folder")
        if len(schema.fields) != 1:
            raise ValueError("one column of payloads is written")
        return FrameWriter(self.options["path"])


class FrameReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        return [Frames(file, a, b) for file, size in _files(self.path) for a, b in borders(file, 0, size, self.split)]

    def read(self, partition: Frames) -> Iterator[tuple[str, int, bytes]]:
        # without any file there is one partition of nothing
        return _read(partition) if isinstance(partition, Frames) else iter(())


class FrameStream(DataSourceStreamReader):
    """Offsets are the bytes read of each file: new files and what was appended to old ones make the next micro-batch."""

    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return dict(_files(self.path))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Frames(f, a, b) for f, size in sorted(end.items()) if size > start.get(f, 0) for a, b in borders(f, start.get(f, 0), size, self.split)]

    def read(self, partition: Frames) -> Iterator[tuple[str, int, bytes]]:
        return _read(partition)


class Written(WriterCommitMessage):
    def __init__(self, draft: str, final: str):
        self.draft, self.final = draft, final


class FrameWriter(DataSourceWriter):
    """A file for each task that has rows, under a name that readers pass over until the job is committed."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        fs, top = _open(self.path)
        name = f"part-{uuid.uuid4().hex}"
        draft, out = f"{top}/{name}.draft", None
        try:
            for (payload,) in iterator:
                raw = bytes(payload or b"")
                if len(raw) > MOST:
                    raise FrameError(f"a payload is too large: {len(raw)} bytes of at most {MOST}")
                if out is None:
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(draft)
                out.write(len(raw).to_bytes(4, "little") + raw)
        except BaseException:
            if out is not None:
                out.close()
                fs.delete_file(draft)
            raise
        if out is None:
            return Written("", "")
        out.close()
        return Written(draft, f"{top}/{name}{SUFFIX}")

    def commit(self, messages: list) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            if m is not None and m.draft:
                fs.move(m.draft, m.final)

    def abort(self, messages: list) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            if m is not None and m.draft:
                fs.delete_file(m.draft)
