"""A data source of files as they change: new, changed in place, and gone.

`spark.read.format("changed_files")` gives every file of a folder; `readStream` gives, batch by
batch, what has changed since the last: rows (path, mtime, change, content), change `put` with the
content or `gone` without. Spark's own file stream sees new names only.

The driver holds listings (paths and times), never contents. Each listing that differs from the
one before is written to the folder of the option `listings`, once, under the next number, and a
stream's offset is that number: a batch is the difference of two listings, the same however often
it is run. A file that has changed again before its batch ran is read as it then is, and comes
again with the next. Tasks read the contents, `files_a_task` at a time.

Options: path, listings (streams only), suffix ('' for all), files_a_task. Folders may be in any
store that pyarrow's file systems reach.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, mtime long, change string, content string"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listing(path: str, suffix: str = "") -> dict[str, int]:
    """{path: modification time in microseconds} of the files under a folder."""
    from pyarrow import fs

    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return {f.path: f.mtime_ns // 1000 for f in found if f.type == fs.FileType.File and f.path.endswith(suffix)}


def differences(before: dict[str, int], after: dict[str, int]) -> list[tuple[str, int, str]]:
    """(path, mtime, change) from one listing to another, in order."""
    put = [(p, t, "put") for p, t in after.items() if before.get(p) != t]
    return sorted(put + [(p, t, "gone") for p, t in before.items() if p not in after])


class Slice(InputPartition):
    def __init__(self, changes: list[tuple[str, int, str]]) -> None:
        self.changes = changes


class _Reader:
    def __init__(self, options: dict) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.most = int(options.get("files_a_task", "200"))

    def _slices(self, changes: list[tuple[str, int, str]]) -> list[Slice]:
        return [Slice(changes[i : i + self.most]) for i in range(0, len(changes), self.most)] or [Slice([])]

    def read(self, part: Slice) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for path, mtime, change in part.changes:
            content = None
            if change == "put":
                try:
                    with store.open_input_stream(path) as f:
                        content = f.read().decode("utf-8", "replace")
                except FileNotFoundError:
                    change = "gone"  # since it was listed; the next listing says so too
            yield path, mtime, change, content


class Files(_Reader, DataSourceReader):
    def partitions(self) -> list[Slice]:
        return self._slices(differences({}, listing(self.path, self.suffix)))


class ChangedFiles(_Reader, DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.listings = options["listings"]

    def _at(self, number: int) -> dict[str, int]:
        if number == 0:
            return {}
        store, root = _store(self.listings)
        with store.open_input_stream(f"{root}/{number:09d}.json") as f:
            return json.loads(f.read())

    def _last(self) -> int:
        from pyarrow import fs

        store, root = _store(self.listings)
        names = [f.base_name for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True))]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:9].isdigit()), default=0)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listing": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        last, now = self._last(), listing(self.path, self.suffix)
        if now != self._at(last):
            last += 1
            store, root = _store(self.listings)
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/{last:09d}.part") as f:
                f.write(json.dumps(now).encode())
            store.move(f"{root}/{last:09d}.part", f"{root}/{last:09d}.json")
        return {"listing": last}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return self._slices(differences(self._at(start["listing"]), self._at(end["listing"])))

    def commit(self, end: dict) -> None:
        """Listings before the one that is done are no longer needed."""
        store, root = _store(self.listings)
        from pyarrow import fs

        for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.base_name.endswith(".json") and f.base_name[:9].isdigit() and int(f.base_name[:9]) < end["listing"] - 1:
                store.delete_file(f.path)


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Files(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return ChangedFiles(self.options)
