"""Command line: resample WAV and FLAC files. Run with spark-submit or python -m cadenza.cli."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.tapers import KINDS, Taper
from cadenza.operators.resample import resample_groups, with_context
from cadenza.plans.config import PRESETS, Config, ResampleError, preset
from cadenza.sources.audio import FORMATS, read_audio, write_audio

ENDINGS = (".wav", ".flac")
#: Alpha and beta of each taper where the command line gives none.
TAPER_DEFAULTS = {"cosine": (3.4375, 1.0), "planck": (3.4375, 1.0), "beta": (10.0, 10.0), "bessel": (6.0, 1.0)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cadenza", description=__doc__)
    p.add_argument("--input", "-i", action="append", required=True, help="a file; may be given again")
    p.add_argument("--output", "-o", action="append", required=True, help="a file for each input, in the same order")
    p.add_argument("--rate", "-r", type=int, required=True, help="output samples a second")
    p.add_argument("--preset", choices=PRESETS, default="high")
    p.add_argument("--quality", type=int)
    p.add_argument("--bandwidth", type=float)
    p.add_argument("--taper", choices=KINDS)
    p.add_argument("--alpha", type=float)
    p.add_argument("--beta", type=float)
    p.add_argument("--phase", type=float, default=0.0)
    p.add_argument("--phase-intensity", type=float)
    p.add_argument("--out-format", choices=["same", *FORMATS], default="same")
    p.add_argument("--gapless", action="store_true", help="the inputs are one album, in order")
    return p


def checked(args: argparse.Namespace) -> argparse.Namespace:
    """The arguments, or a ResampleError for a combination that can't be."""
    taper = args.taper or "cosine"
    for bad, message in (
        (len(args.input) != len(args.output), "there must be an output for each input"),
        (args.rate <= 0, "the rate must be positive"),
        (any(not f.lower().endswith(ENDINGS) for f in (*args.input, *args.output)), "files must end in .wav or .flac"),
        (len(set(args.output)) != len(args.output), "outputs must differ"),
        (args.beta is not None and taper != "beta", "--beta is for the beta taper"),
        (args.alpha is not None and taper == "planck", "the planck taper has no alpha"),
    ):
        if bad:
            raise ResampleError("Arguments", message)
    return args


def config_for(args: argparse.Namespace, rate: int, channels: int) -> Config:
    """The preset with the arguments' changes."""
    config = preset(args.preset).with_rates(rate, args.rate).with_channels(channels).with_phase(args.phase, args.phase_intensity)
    if args.quality is not None:
        config = config.with_quality(args.quality)
    if args.bandwidth is not None:
        config = config.with_bandwidth(args.bandwidth)
    if args.taper or args.alpha is not None:
        kind = args.taper or "cosine"
        alpha, beta = TAPER_DEFAULTS[kind]
        config = config.with_taper(Taper(kind, alpha if args.alpha is None else args.alpha, beta if args.beta is None else args.beta))
    return config.validated()


def convert(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Reads, resamples and writes all files; a row for each output with its error, null where all went well."""
    uris = [f if "://" in f else "file://" + os.path.abspath(f) for f in args.input]
    order = spark.createDataFrame([(i, u.split("://", 1)[1].lstrip("/"), o if "://" in o else "file://" + os.path.abspath(o)) for i, (u, o) in enumerate(zip(uris, args.output, strict=True))], "seq int, file string, output string")
    tracks = read_audio(spark, uris).withColumn("file", F.regexp_replace("path", "^[a-z0-9]+:/+", "")).join(F.broadcast(order), "file").cache()
    broken = tracks.where("error is not null").select("path", "error").collect()
    if broken:
        raise ResampleError("Input", "; ".join(f"{r.path}: {r.error}" for r in broken))
    formats = [(r.channels, r.input_rate) for r in tracks.select("channels", "input_rate").distinct().collect()]
    if args.gapless and len(formats) != 1:
        raise ResampleError("Gapless", "a gapless album must be of one format")
    configs = {(c, r): config_for(args, r, c) for c, r in formats}
    context: dict[str, str | None] = {"pre": None, "post": None}
    if args.gapless and not configs[formats[0]].passthrough:
        tracks = with_context(tracks, configs[formats[0]], album=["channel"], order="seq")
        context = {"pre": "pre", "post": "post"}
    done = resample_groups(tracks, configs, **context)
    fmt = F.first("source_format") if args.out_format == "same" else F.lit(args.out_format)
    planar = done.groupBy("output").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "samples"))), lambda x: x["samples"]).alias("samples"), fmt.alias("fmt")).withColumn("rate", F.lit(args.rate))
    return write_audio(planar, path="output", rate="rate", fmt="fmt", samples="samples")


def main(argv: list[str] | None = None) -> int:
    try:
        args = checked(parser().parse_args(argv))
        spark = SparkSession.builder.appName("cadenza").getOrCreate()
        failed = [r for r in convert(spark, args).collect() if r.error]
    except ResampleError as e:
        print(f"cadenza: {e}", file=sys.stderr)
        return 2
    for r in failed:
        print(f"cadenza: {r.path}: {r.error}", file=sys.stderr)
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
