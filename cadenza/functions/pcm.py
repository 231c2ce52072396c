"""Integer sample formats: quantising and decoding columns, and the rules that name formats and containers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest value of a sample of so many bits.
FULL_SCALE = {16: 32_767, 24: 8_388_607, 32: 2_147_483_647}


def encode(x: Column, bits: int) -> Column:
    """A sample from -1 to 1 as an integer: clamped, scaled, rounded half away from zero. NaN is 0, as an integer has none."""
    x = F.when(F.isnan(x), F.lit(0.0)).otherwise(x)
    return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * F.lit(float(FULL_SCALE[bits]))).cast("int")


def decode(x: Column, bits: Column | int) -> Column:
    """An integer sample of so many bits as a number from -1 to 1."""
    bits = F.lit(bits) if isinstance(bits, int) else bits
    scale = F.greatest(F.pow(F.lit(2.0), bits - 1) - 1, F.lit(1.0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double") / scale))


def encode_as(x: Column, fmt: Column) -> Column:
    """A sample as the integer that a format column (i16, i24, i32) asks for; null for formats without integers."""
    return F.when(fmt == "i16", encode(x, 16)).when(fmt == "i24", encode(x, 24)).when(fmt == "i32", encode(x, 32))


def container_of(path: Column) -> Column:
    """wav or flac by the file name's ending, in any case; null for others."""
    ending = F.lower(F.element_at(F.split(path, r"\."), -1))
    return F.when(ending.isin("wav", "flac") & path.contains("."), ending)


def wav_format(encoding: Column) -> Column:
    """The output format that a WAV encoding's name means; f32 where it says nothing."""
    name = F.lower(encoding)
    out = F.when(name.contains("64"), "f64")
    for part, fmt in (("float", "f32"), ("24", "i24"), ("16", "i16"), ("32", "i32")):
        out = out.when(name.contains(part), fmt)
    return out.otherwise("f32")


def flac_format(bits: Column) -> Column:
    """The output format for so many bits a sample."""
    return F.when(bits <= 16, "i16").when(bits <= 24, "i24").otherwise("i32")


def resolved_format(requested: Column, source: Column) -> Column:
    """The requested format, or the source's where ``same`` or nothing was asked for."""
    return F.when(requested.isNull() | (F.lower(requested) == "same"), source).otherwise(F.lower(requested))
