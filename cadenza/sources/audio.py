"""WAV and FLAC files as tables, told apart by their first bytes when read and by their names when written."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flac, wav

FORMATS = tuple(wav.FORMATS)
_DEPTH = {"i16": 16, "i24": 24, "i32": 32}


def parse(data: bytes) -> tuple[int, int, str, np.ndarray]:
    """Channels, rate, format name and samples (frames x channels, from -1 to 1) of a WAV or FLAC file's bytes."""
    if data[:4] != b"fLaC":
        return wav.parse(data)
    channels, rate, depth, x = flac.decode(data)
    fmt = "i16" if depth <= 16 else "i24" if depth <= 24 else "i32"
    return channels, rate, fmt, np.clip(x / max(2 ** (depth - 1) - 1, 1), -1, 1)


def build(name: str, samples: np.ndarray, rate: int, fmt: str) -> bytes:
    """A file's bytes; the name's ending says which kind."""
    if not name.lower().endswith(".flac"):
        return wav.build(samples, rate, fmt)
    if fmt not in _DEPTH:
        raise flac.FlacError("FLAC holds integers only")
    scaled = np.clip(np.nan_to_num(samples, nan=0.0), -1, 1) * (2 ** (_DEPTH[fmt] - 1) - 1)
    return flac.encode((np.sign(scaled) * np.floor(np.abs(scaled) + 0.5)).astype(np.int64), rate, _DEPTH[fmt])


def read_audio(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row for each file and channel, as read_wav gives them. A broken file is one row with an error."""

    def rows(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    channels, rate, fmt, x = parse(bytes(content))
                    yield pd.DataFrame([(path, channels, rate, fmt, len(x), c, x[:, c], None) for c in range(channels)], columns=wav._COLUMNS)
                except (wav.WavError, flac.FlacError) as e:
                    yield pd.DataFrame([(path, None, None, None, None, None, None, str(e))], columns=wav._COLUMNS).astype({"channels": "Int32", "input_rate": "Int32", "frames": "Int64", "channel": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{[wW][aA][vV],[fF][lL][aA][cC]}").load(paths).select("path", "content")
    return files.mapInPandas(rows, wav.SCHEMA)


def write_audio(tracks: DataFrame, *, path: str, rate: str, fmt: str, samples: str) -> DataFrame:
    """Writes each row's samples (an array of channels) to the URI in its column ``path``. Returns path and error, null where all went well.

    Files are written in parallel and failures collected. Collect the result once: that does the writing.
    """
    rows = tracks.select(F.col(path).alias("path"), F.col(rate).alias("rate"), F.col(fmt).alias("fmt"), F.col(samples).alias("samples"))

    def work(batches: Iterator) -> Iterator:
        import pandas as pd
        from pyarrow import fs

        for batch in batches:
            errors: list[str | None] = []
            for row in batch.itertuples(index=False):
                try:
                    data = build(row.path, np.stack([np.asarray(c, dtype=np.float64) for c in row.samples], axis=1), int(row.rate), row.fmt)
                    target, place = fs.FileSystem.from_uri(row.path)
                    target.create_dir(place.rpartition("/")[0], recursive=True)
                    with target.open_output_stream(place + ".part") as f:
                        f.write(data)
                    target.move(place + ".part", place)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  every failure becomes a row
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": batch["path"], "error": errors})

    return rows.mapInPandas(work, "path string, error string")
