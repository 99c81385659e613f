"""Converting containers as they arrive in a folder."""

from __future__ import annotations

from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..convert import CONTAINER_SUFFIX, convert_container
from ..functions.names import safe_name
from ..sources.codebook import find_codebook


_FILES = "path string, modificationTime timestamp, length long, content binary"


def convert_arrivals(spark: SparkSession, folder: str, output: str, checkpoint: str, formats: list[str] | None = None, once: bool = True) -> StreamingQuery:
    """A streaming query over new containers below folder; each is converted once into output/<name>.

    Only paths and lengths are read by the stream, never a file's content.
    With once it ends when all present files are done. Empty files and files
    without codebook are left out; a file that fails is told in its own report.
    """

    def convert(batch: DataFrame, _: int) -> None:
        for r in batch.toLocalIterator():
            path = unquote(urlparse(r["path"]).path)
            try:
                convert_container(path, find_codebook(path), str(Path(output, safe_name(Path(path).stem))), formats, verbose=False, spark=spark)
            except (FileNotFoundError, RuntimeError, ValueError) as e:
                target = Path(output, safe_name(Path(path).stem))
                target.mkdir(parents=True, exist_ok=True)
                (target / "failed.txt").write_text(str(e), encoding="utf-8")

    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*" + CONTAINER_SUFFIX).option("recursiveFileLookup", "true").load(folder)
    w = files.select("path", "length").where("length > 0").writeStream.foreachBatch(convert).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
