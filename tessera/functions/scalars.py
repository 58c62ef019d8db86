"""Scalars of the codec and its tools as built-in expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.kernels.block import MOST_INPUT, VERSION

__all__ = [
    "acceleration_of_level", "base_name", "block_label", "block_size_of", "compress_bound", "container_member", "fitting_block_id", "frame_bound",
    "human_size", "in_place_margin", "is_skippable_magic", "literals_price", "megabytes", "mode_of_name", "net_power", "parse_list", "parse_size", "range_bounds",
    "ratio_pct", "ring_buffer_size", "sequence_price", "split_share", "workers_of", "frequency_point", "last_number", "clamp_block_size", "version_number", "version_string", "hash_version",
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("long")


def compress_bound(n) -> Column:
    """The most bytes that a block of n bytes takes; 0 where n is too many."""
    n = _c(n).cast("long")
    return F.when((n < 0) | (n > MOST_INPUT), F.lit(0).cast("long")).otherwise(n + _div(n, 255) + 16)


def block_size_of(block_id) -> Column:
    """Bytes of block ids 4 to 7, 0 being the default of 64 KB; null for others."""
    k = _c(block_id)
    return F.when(k.isin(0, 4), 65536).when(k == 5, 262144).when(k == 6, 1048576).when(k == 7, 4194304).cast("long")


def fitting_block_id(n, most=7) -> Column:
    """The smallest block id that holds n bytes, up to the one asked for."""
    n = _c(n)
    return F.least(F.when(n <= 65536, 4).when(n <= 262144, 5).when(n <= 1048576, 6).otherwise(7), _c(most))


def frame_bound(n, block_id=7, block_checksum: bool = False, content_checksum: bool = True) -> Column:
    """The most bytes of a frame of n bytes: header of 19, four a block (eight with checksums), end mark and checksum."""
    n, size = _c(n).cast("long"), block_size_of(fitting_block_id(n, block_id))
    blocks = F.ceil(n / size).cast("long")
    return F.lit(19 + 4 + 4 * content_checksum) + n + blocks * (4 + 4 * block_checksum)


def block_label(block_id, independent) -> Column:
    return F.concat(F.lit("B"), _c(block_id).cast("string"), F.when(_c(independent), "I").otherwise("D"))


def human_size(n) -> Column:
    """Two decimals (ties to even) and the unit of 1024 that leaves less than 1024; bytes have none."""
    n = _c(n).cast("double")
    units = ["", "K", "M", "G", "T", "P"]
    out = None
    for k, unit in enumerate(units):
        text = F.concat(F.format_string("%.2f", F.bround(n / F.lit(1024.0**k), 2)), F.lit(unit))
        last = k == len(units) - 1
        here = n < F.lit(1024.0 ** (k + 1))
        out = (F.when(here, text) if out is None else out.otherwise(text) if last else out.when(here, text))
    return out


def base_name(path) -> Column:
    """What is behind the last slash, or else the last backslash."""
    p = _c(path)
    return F.when(F.contains(p, F.lit("/")), F.substring_index(p, "/", -1)).otherwise(F.substring_index(p, "\\", -1))


def parse_size(text) -> Column:
    """Bytes of `12`, `12K`, `12KB`, `12KiB`, `12M`, ...; null for anything else."""
    t = _c(text)
    number = F.regexp_extract(t, r"^(\d+)(?:[KM](?:i?B)?)?$", 1)
    unit = F.regexp_extract(t, r"^\d+([KM])", 1)
    return F.when(number != "", F.try_to_number(number, F.lit("999999999999")).cast("long") * F.when(unit == "K", 1024).when(unit == "M", 1048576).otherwise(1))


def version_number() -> Column:
    """The format's version as one number: 100 * 100 * major + 100 * minor + release."""
    major, minor, release = VERSION
    return F.lit(10_000 * major + 100 * minor + release)


def version_string() -> Column:
    return F.lit(".".join(map(str, VERSION)))


def hash_version() -> Column:
    """The hashes' version as one number, from the library that computes them."""
    import xxhash

    major, minor, release = (int(x) for x in xxhash.XXHASH_VERSION.split("."))
    return F.lit(10_000 * major + 100 * minor + release)


def clamp_block_size(n) -> Column:
    """A custom block size: 32 bytes to 4 MB."""
    return F.least(F.greatest(_c(n), F.lit(32)), F.lit(4 << 20))


def mode_of_name(name, suffix: str = ".lz") -> Column:
    return F.when(F.endswith(_c(name), F.lit(suffix)), "decompress").otherwise("compress")


def container_member(name, suffix: str = ".lz") -> Column:
    """The output name: the suffix added, or taken away."""
    n = _c(name)
    return F.when(F.endswith(n, F.lit(suffix)), F.regexp_replace(n, F.lit("\\Q" + suffix + "\\E$"), F.lit(""))).otherwise(F.concat(n, F.lit(suffix)))


def is_skippable_magic(magic) -> Column:
    return _c(magic).cast("long").bitwiseAND(F.lit(0xFFFFFFF0).cast("long")) == F.lit(0x184D2A50).cast("long")


def ring_buffer_size(n) -> Column:
    """Bytes of a decoding ring buffer for blocks of n bytes."""
    return F.lit(65536 + 14) + F.greatest(F.lit(16), _c(n))


def in_place_margin(n) -> Column:
    """Extra bytes for decoding n compressed bytes in their own buffer."""
    return F.shiftright(_c(n).cast("long"), 8) + 32


def acceleration_of_level(level) -> Column:
    """Negative levels are greedy with acceleration 1 - level; others have acceleration 1."""
    k = _c(level)
    return F.when(k < 0, F.least(1 - k, F.lit(65537))).otherwise(1)


def literals_price(n) -> Column:
    n = _c(n).cast("long")
    return n + F.when(n >= 15, 1 + _div(n - 15, 255)).otherwise(0)


def sequence_price(n, length) -> Column:
    m = _c(length).cast("long")
    return 3 + literals_price(n) + F.when(m >= 19, 1 + _div(m - 19, 255)).otherwise(0)


def megabytes(n) -> Column:
    return F.coalesce(_c(n).cast("double"), F.lit(0.0)) / F.lit(1048576.0)


def ratio_pct(compressed, raw) -> Column:
    """Compressed as a percentage of raw; null for an empty input."""
    return F.when(_c(raw) > 0, 100.0 * _c(compressed) / _c(raw))


def parse_list(text, kind: str = "string") -> Column:
    """Items of a comma list, trimmed, empty ones left out."""
    items = F.filter(F.transform(F.split(_c(text), ","), lambda x: F.trim(x)), lambda x: x != "")
    return items.cast(f"array<{kind}>")


def workers_of(cores, most: int = 200) -> Column:
    """Workers chosen for a number of cores: all but one and an eighth, one at least."""
    n = _c(cores).cast("long")
    return F.least(F.greatest(n - 1 - _div(n, 8), F.lit(1)), F.lit(most))


def range_bounds(job, jobs, n) -> Column:
    """struct(first, last): the contiguous range of n blocks that a job gets."""
    job, jobs, n = _c(job), _c(jobs), _c(n)
    return F.struct(F.floor(job * n / jobs).cast("long").alias("first"), F.floor((job + 1) * n / jobs).cast("long").alias("last"))


def split_share(n, ratio) -> Column:
    """Blocks of n that the first of two devices takes at a ratio; both get one at least where the ratio is between 0 and 1."""
    n, r = _c(n).cast("long"), _c(ratio).cast("double")
    first = n - F.floor(n * (1 - r) + 0.5).cast("long")
    return F.when(r <= 0, 0).when(r >= 1, n).when(n < 2, first).otherwise(F.least(F.greatest(first, F.lit(1)), n - 1)).cast("long")


def net_power(average, idle, most_idle_share: float = 0.95) -> Column:
    """Average less idle power, of which at most a share of the average counts; never negative."""
    a, i = F.coalesce(_c(average).cast("double"), F.lit(0.0)), F.greatest(F.coalesce(_c(idle).cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.when(a <= 0, F.lit(0.0)).otherwise(F.greatest(a - F.least(i, a * most_idle_share), F.lit(0.0)))


def frequency_point(text) -> Column:
    """struct(kind, value, label) of NA, 50% or 1900MHz."""
    t = F.trim(_c(text))
    percent, mhz = F.regexp_extract(t, r"^(\d+)\s*%$", 1), F.regexp_extract(t, r"(?i)^(\d+)\s*(?:mhz)?$", 1)
    kind = F.when((t == "") | F.upper(t).isin("NA", "NONE", "-"), "none").when(percent != "", "percent").when(mhz != "", "mhz")
    value = F.when(percent != "", percent).when(mhz != "", mhz).cast("int")
    return F.struct(kind.alias("kind"), value.alias("value"), F.when(kind == "none", "NA").when(kind == "percent", F.concat(percent, F.lit("pct"))).when(kind == "mhz", F.concat(mhz, F.lit("mhz"))).alias("label"))


def last_number(text, name: str) -> Column:
    """The last number behind `name` and a colon or equals sign in a log."""
    return F.element_at(F.regexp_extract_all(_c(text), F.lit(rf"{name}\s*[:=]\s*([0-9]+(?:\.[0-9]+)?)"), 1), -1).cast("double")
