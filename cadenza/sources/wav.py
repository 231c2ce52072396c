"""WAV files as tables: a distributed reader on Spark's binaryFile source, and a writer with one file for each track."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The format tags of the RIFF header.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
#: Output formats: bits of a sample and format tag.
FORMATS = {"i16": (16, PCM), "i24": (24, PCM), "i32": (32, PCM), "f32": (32, FLOAT), "f64": (64, FLOAT)}
SCHEMA = "path string, channels int, input_rate int, source_format string, frames long, channel int, samples array<double>, error string"


class WavError(ValueError):
    """A file that is not a WAV file this reader knows."""


def parse(data: bytes) -> tuple[int, int, str, np.ndarray]:
    """Channels, rate, format name and the samples (frames x channels, from -1 to 1) of a file's bytes."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise WavError("no RIFF/WAVE header")
    at, head, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            head = data[at + 8 : at + 8 + size]
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if head is None or body is None or len(head) < 16:
        raise WavError("no fmt or data chunk")
    tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", head)
    if tag == EXTENSIBLE and len(head) >= 26:
        tag = struct.unpack_from("<H", head, 24)[0]
    fmt = next((f for f, (b, t) in FORMATS.items() if (b, t) == (bits, tag)), "u8" if (bits, tag) == (8, PCM) else None)
    if fmt is None or not channels:
        raise WavError(f"format tag {tag} with {bits} bits is not supported")
    body = body[: len(body) // (channels * bits // 8) * (channels * bits // 8)]
    if fmt == "i24":
        raw = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16) << 8 >> 8) / 8_388_607
    elif fmt == "u8":
        x = (np.frombuffer(body, dtype=np.uint8).astype(np.float64) - 128) / 127
    else:
        kind = {"i16": "<i2", "i32": "<i4", "f32": "<f4", "f64": "<f8"}[fmt]
        x = np.frombuffer(body, dtype=kind).astype(np.float64) / {"i16": 32_767, "i32": 2_147_483_647}.get(fmt, 1)
    return channels, rate, fmt, (np.clip(x, -1, 1) if fmt[0] in "iu" else x).reshape(-1, channels)


def build(samples: np.ndarray, rate: int, fmt: str) -> bytes:
    """A file's bytes from samples (frames x channels). Integers are clamped, scaled and rounded half away from zero."""
    bits, tag = FORMATS[fmt]
    channels = samples.shape[1]
    if tag == PCM:
        scaled = np.clip(np.nan_to_num(samples, nan=0.0), -1, 1) * (2 ** (bits - 1) - 1)
        whole = (np.sign(scaled) * np.floor(np.abs(scaled) + 0.5)).astype(np.int64)
        body = whole.astype("<i4").ravel().view(np.uint8).reshape(-1, 4)[:, :3].tobytes() if bits == 24 else whole.astype(f"<i{bits // 8}").tobytes()
    else:
        body = samples.astype(f"<f{bits // 8}").tobytes()
    head = struct.pack("<HHIIHH", tag, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    chunks = b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def _rows(batches: Iterator) -> Iterator:
    import pandas as pd

    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            try:
                channels, rate, fmt, x = parse(bytes(content))
            except WavError as e:
                yield pd.DataFrame([(path, None, None, None, None, None, None, str(e))], columns=_COLUMNS).astype({"channels": "Int32", "input_rate": "Int32", "frames": "Int64", "channel": "Int32"})
                continue
            yield pd.DataFrame([(path, channels, rate, fmt, len(x), c, x[:, c], None) for c in range(channels)], columns=_COLUMNS)


_COLUMNS = ["path", "channels", "input_rate", "source_format", "frames", "channel", "samples", "error"]


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file and channel: path, format, and samples from -1 to 1. A broken file is one row with an error. Any path that Spark can list works."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").load(path).select("path", "content")
    return files.mapInPandas(_rows, SCHEMA)


def write_wav(tracks: DataFrame, folder: str, *, name: str, rate: str, fmt: str, samples: str) -> DataFrame:
    """Writes each row's samples (an array of channels, each an array) to ``folder``/``name``.wav. Returns name and error, null where all went well.

    Rows are written where they are, in parallel; failures are collected, not raised. ``folder`` is a URI of a store
    that all executors reach. The result is a table: count or collect it to start the writing, and only once.
    """
    rows = tracks.select(F.col(name).cast("string").alias("name"), F.col(rate).alias("rate"), F.col(fmt).alias("fmt"), F.col(samples).alias("samples"))

    def work(batches: Iterator) -> Iterator:
        import pandas as pd
        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(folder)
        target.create_dir(base, recursive=True)
        for batch in batches:
            errors = []
            for row in batch.itertuples(index=False):
                try:
                    data = build(np.stack([np.asarray(c, dtype=np.float64) for c in row.samples], axis=1), int(row.rate), row.fmt)
                    # Under a name of its own first, so that a task that is tried again leaves whole files only.
                    with target.open_output_stream(f"{base}/{row.name}.wav.part") as f:
                        f.write(data)
                    target.move(f"{base}/{row.name}.wav.part", f"{base}/{row.name}.wav")
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  every failure becomes a row
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"name": batch["name"], "error": errors})

    return rows.mapInPandas(work, "name string, error string")
