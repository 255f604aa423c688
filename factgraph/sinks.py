"""Results written out: JSON with camel-case names, and documents as text files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def camel_case(name: str) -> str:
    return re.sub(r"_+(\w)", lambda m: m[1].upper(), name.rstrip("_"))


def utc_stamp(moment: Column) -> Column:
    """A timestamp as ``yyyy-MM-ddTHH:mm:ssZ``; the session's time zone must be UTC."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def json_lines(frame: DataFrame, *, nulls: bool = True) -> DataFrame:
    """One JSON object a row, names in camel case; nulls are written out unless told otherwise."""
    row = F.struct(*[F.col(f"`{c}`").alias(camel_case(c)) for c in frame.columns])
    return frame.select(F.to_json(row, {"ignoreNullFields": str(not nulls).lower()}).alias("json"))


def write_texts(documents: DataFrame, folder: str, *, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Write each text to its path below a folder, which all executors must see, and return (path, n_bytes).

    Lazy: the files are written as the result is read. A file is written whole under another name and
    then moved, so a task that is run again leaves the same file; a null text is written as an empty one.
    Paths that lead out of the folder are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for batch in batches:
            sizes = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                steps = path.strip("/").split("/")
                if ".." in steps:
                    raise ValueError(f"path leads out of the folder: {path}")
                target, data = "/".join([root.rstrip("/"), *steps]), (text or "").encode()
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                draft = f"{target}.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    out.write(data)
                system.move(draft, target)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "n_bytes"])

    return documents.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).mapInArrow(run, "path string, n_bytes long")

