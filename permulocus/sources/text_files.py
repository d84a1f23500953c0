"""Named text files as a Spark data source to write: each file is one task's lines in order, a stream however long it is.

Files appear when the whole job commits.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StructType

from .commit import Files, FolderWriter


class TextFilesWriter(FolderWriter):
    def write(self, iterator: Iterator) -> Files:
        files: dict[str, str] = {}
        out, now = None, None
        try:
            for file, line in iterator:
                if out is None or file != now:
                    if file in files:
                        raise ValueError(f"{file} comes in two stretches")
                    if out is not None:
                        out.close()
                    system, files[file] = self.temporary()
                    out, now = system.open_output_stream(files[file]), file
                out.write(f"{line}\n".encode())
        finally:
            if out is not None:
                out.close()
        return Files([(temporary, file) for file, temporary in files.items()])


class TextFiles(DataSource):
    """Format text_files, to write only: rows (file, line), a file's lines in one task and together. file is a path below the folder."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def writer(self, schema: StructType, overwrite: bool) -> TextFilesWriter:
        if schema.fieldNames() != ["file", "line"]:
            raise ValueError("rows are file, line")
        return TextFilesWriter(self.options["path"], overwrite)
