"""Times as DOUBLE seconds: parsing, formatting, mapping between clocks, sample plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """A number from any text or number; null for what is not a finite one."""
    n = x.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != F.lit(float("inf"))), n)


def finite_or(x: Column, fallback: float) -> Column:
    return F.coalesce(finite(x), F.lit(float(fallback)))


def parse_clock(text: Column) -> Column:
    """Seconds from SS, MM:SS or HH:MM:SS, each with an optional fraction in the last part; null for anything else."""
    t = F.trim(text)
    part = F.split(t, ":")
    number = lambda i: F.try_element_at(part, F.lit(i)).try_cast("double")
    shape = t.rlike(r"^\d+(\.\d+)?$|^\d+:\d+(\.\d+)?$|^\d+:\d+:\d+(\.\d+)?$")
    seconds = F.when(F.size(part) == 1, number(1)).when(F.size(part) == 2, number(1) * 60 + number(2)).otherwise(number(1) * 3600 + number(2) * 60 + number(3))
    return F.when(shape, seconds)


def cue_seconds(text: Column) -> Column:
    """Seconds of a caption time, HH:MM:SS.mmm with a point or comma; the hour has two digits."""
    at = lambda i: F.regexp_extract(text, r"^(\d{2}):(\d{2}):(\d{2})[.,](\d{3})$", i).try_cast("int")
    return at(1) * 3600 + at(2) * 60 + at(3) + at(4) / 1000


def format_clock(seconds: Column, hours: bool = True) -> Column:
    """mm:ss, or h:mm:ss from an hour on; rounded half to even first."""
    whole = F.bround(seconds, 0).cast("bigint")
    short = F.format_string("%02d:%02d", (whole / 60).cast("bigint"), whole % 60)
    if not hours:
        return short
    long_ = F.format_string("%d:%02d:%02d", (whole / 3600).cast("bigint"), ((whole % 3600) / 60).cast("bigint"), whole % 60)
    return F.when(whole >= 3600, long_).otherwise(short)


def parse_clock_list(text: Column) -> Column:
    """Distinct sorted seconds of a comma-separated list; what cannot be read is left out."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.split(text, ","), parse_clock))))


def parse_range_list(text: Column) -> Column:
    """(start, end) of each START-END in a comma-separated list, in order; end must follow start."""
    pair = lambda x: F.struct(parse_clock(F.get(F.split(x, "-"), 0)).alias("start"), parse_clock(F.get(F.split(x, "-"), 1)).alias("end"))
    return F.filter(F.transform(F.split(text, ","), pair), lambda r: r["end"] > r["start"])


def rate(text: Column) -> Column:
    """A frame rate like 30000/1001 or 25 as a number; 0 for what cannot be read."""
    part = F.split(text, "/")
    over = F.coalesce(finite(F.get(part, 1)), F.when(F.size(part) == 1, F.lit(1.0)))
    return F.coalesce(F.try_divide(finite(F.get(part, 0)), over), F.lit(0.0))


def frame_duration(fps: Column) -> Column:
    return F.when(fps > 0, 1 / fps).otherwise(F.lit(0.04))


def media_probe(document: Column) -> Column:
    """duration, start_time, width, height, fps and frame_duration of a prober's JSON: the container's numbers, else the first picture stream's, else 0."""
    v = F.try_parse_json(document)
    of = lambda x, k: F.try_variant_get(x, f"$.{k}", "string")
    streams = F.coalesce(F.try_variant_get(v, "$.streams", "array<variant>"), F.array().cast("array<variant>"))
    video = F.get(F.filter(streams, lambda s: of(s, "codec_type") == "video"), 0)
    either = lambda k: F.coalesce(finite(of(v, f"format.{k}")), finite(of(video, k)), F.lit(0.0))
    size = lambda k: F.coalesce(of(video, k).try_cast("int"), F.lit(0))
    named = lambda k: F.when(of(video, k) != "", of(video, k))
    fps = F.coalesce(rate(F.coalesce(named("avg_frame_rate"), named("r_frame_rate"))), F.lit(0.0))
    return F.struct(either("duration").alias("duration"), either("start_time").alias("start_time"), size("width").alias("width"), size("height").alias("height"), fps.alias("fps"), frame_duration(fps).alias("frame_duration"))


def to_source_time(pts: Column, source_start: Column, media_start: Column) -> Column:
    """Where in the source a time of a downloaded part lies."""
    return source_start + (pts - media_start)


def to_media_time(t: Column, source_start: Column, media_start: Column) -> Column:
    return media_start + (t - source_start)


def drifted(actual: Column, requested: Column, duration_of_frame: Column) -> Column:
    """Whether a decoded time is too far from the one asked for: over 0.10 s and over 2.5 frames."""
    return F.abs(actual - requested) > F.greatest(F.lit(0.10), 2.5 * duration_of_frame)


def clamp_window(lo: Column, hi: Column, start: Column, end: Column, least: float = 0.05) -> Column:
    """The part of [lo, hi] within [start, end]; null if shorter than ``least``."""
    a, b = F.greatest(lo, start), F.least(hi, end)
    return F.when(b - a >= least, F.struct(a.alias("lo"), b.alias("hi")))


def within(t: Column, start: Column, end: Column) -> Column:
    return (t >= start) & (t < end)


def near_within(t: Column, start: Column, end: Column, tolerance: float = 0.05) -> Column:
    return (t >= start - tolerance) & (t <= end + tolerance)


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return (start < other_end) & (end > other_start)


def shift(seconds: Column, offset: Column) -> Column:
    return F.round(seconds + offset, 3)


def even_size(width: Column, height: Column, wanted: Column) -> tuple[Column, Column]:
    """Width and height scaled to fit ``wanted`` wide, never enlarged, both even and at least 2."""
    w = F.least(width, wanted)
    h = F.bround(height * w / width, 0).cast("int")
    even = lambda x: F.greatest(F.lit(2), x - x % 2).cast("int")
    return even(w.cast("int")), even(h)


def image_tokens(width: Column, height: Column, patch: int = 28) -> Column:
    """Patches of ``patch`` pixels that an image takes; 512 x 288 takes 209."""
    return (F.ceil(width / patch) * F.ceil(height / patch)).cast("bigint")


def token_budget(budget: Column, sheets: Column, per_image: Column, most: int = 30) -> tuple[Column, Column]:
    """Images that fit beside the sheets (0 to ``most``) and whether the sheets alone are over budget."""
    left = budget - sheets
    allowed = F.greatest(F.lit(0), F.least(F.lit(most), F.floor(left / per_image))).cast("int")
    return allowed, left < 0


def chunk_plan(size: Column, seconds: Column, most_bytes: int = 24_000_000, most_seconds: int = 598) -> Column:
    """Equal slices (offset, duration) of a recording so that each stays below both limits; the last takes the rest."""
    n = F.greatest(F.lit(1), F.ceil(size / most_bytes), F.ceil(seconds / most_seconds)).cast("int")
    each = seconds / n
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * each).alias("offset"), F.when(i == n - 1, seconds - i * each).otherwise(each).alias("duration")))


def look_back(offset: Column, duration: Column, back: float = 2.0) -> Column:
    """A slice extended to the left by ``back`` seconds, but not before 0; the first stays."""
    start = F.greatest(F.lit(0.0), offset - back)
    return F.when(offset <= 0, F.struct(offset.alias("start"), duration.alias("length"))).otherwise(F.struct(start.alias("start"), (offset - start + duration).alias("length")))


def sample_fractions(start: Column, end: Column, fractions: list[float]) -> Column:
    """Times at fractions of an interval, first come first kept, equal ones (to a microsecond) once."""
    return F.array_distinct(F.array(*[F.round(start + (end - start) * f, 6) for f in fractions]))


def linked_time(url: Column, seconds: Column, hosts: list[str]) -> Column:
    """The address with a start time, for the hosts that understand one; others stay as they are."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^(www|m)\\.", "")
    mark = F.when(F.contains(url, F.lit("?")), "&t=").otherwise("?t=")
    return F.when(host.isin(hosts), F.concat(url, mark, F.floor(seconds).cast("bigint").cast("string"), F.lit("s"))).otherwise(url)
