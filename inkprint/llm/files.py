"""Files of our own formats in the shared folder, written by tasks and committed once.

A task writes under a temporary name that no other attempt uses and returns a
manifest row. The manifest is a Spark table: of several attempts of a task, only
the one that Spark accepts has its rows there. Files then get their final names,
and readers open what the committed manifest lists and nothing else.
"""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import rows_by_python, stage


MAX_TASKS = 20_000
FILES_PER_TASK = 4


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def make_folder(path: str) -> None:
    store, at = place(path)
    store.create_dir(at, recursive=True)


def spread(files: DataFrame) -> DataFrame:
    """A manifest with a task for every few files, however small its rows are."""
    return files.repartition(max(1, min(-(-files.count() // FILES_PER_TASK), MAX_TASKS)), "file")


def commit(manifest: DataFrame, home: str, name: str) -> DataFrame:
    """Give the files of ``manifest`` (column ``temp``) their final names (``file``).

    Each task moves its rows' files; a repeated move finds the work done. The
    returned table is the committed manifest.
    """
    def move(batches):
        store, at = place(home)
        for batch in batches:
            for temp, final in zip(batch.column("temp").to_pylist(), batch.column("file").to_pylist()):
                if store.get_file_info(f"{at}/{temp}").type != fs.FileType.NotFound:
                    store.move(f"{at}/{temp}", f"{at}/{final}")
                if store.get_file_info(f"{at}/{final}").type == fs.FileType.NotFound:
                    raise OSError(f"{final} is missing")
            yield batch

    listed = stage(manifest, f"{name}-written")
    done = rows_by_python(spread(listed), move, listed.schema)
    return stage(done.orderBy("file"), f"{name}-manifest").select(
        *[F.col(c) for c in listed.columns if c != "temp"])
