"""Profiles, precedence, metadata and union-typed fields."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two profiles' knobs that data operators read.
PROFILES = {
    "standard": {
        "cap": 48, "per_target": 2, "unplanned_floor": 12, "scene_threshold": 0.15, "scene_floor": None,
        "action_offsets": (0.20, 0.80, 1.60), "state_offsets": (0.0, 0.60), "state_fractions": (), "slide_fractions": (),
        "coverage_min": 1, "cue_offsets": (0.5, 1.5), "scan_fps": 2.0, "probe_fps": 1.0, "sheet_tiles": 16, "shortlist_px": 640,
    },
    "high": {
        "cap": 64, "per_target": 3, "unplanned_floor": 16, "scene_threshold": None, "scene_floor": 0.04,
        "action_offsets": (0.10, 0.35, 0.70, 1.20, 1.80, 2.40), "state_offsets": (), "state_fractions": (0.10, 0.30, 0.50, 0.70, 0.90), "slide_fractions": (0.30, 0.70),
        "coverage_min": 2, "cue_offsets": (0.2, 0.5, 1.0, 1.5, 2.0), "scan_fps": 2.0, "probe_fps": 1.0, "sheet_tiles": 16, "shortlist_px": 768,
    },
}
#: Older names of the profiles.
ALIASES = {"light": "standard", "advanced": "high"}


def resolve_profile(name: str, override: dict | None = None) -> dict:
    """A profile with some knobs replaced; unknown profiles and knobs are refused."""
    name = ALIASES.get(name, name)
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name}")
    unknown = set(override or {}) - set(PROFILES[name])
    if unknown:
        raise ValueError(f"unknown knobs: {', '.join(sorted(unknown))}")
    return PROFILES[name] | (override or {})


def profile_digest(profile: dict) -> str:
    return hashlib.sha256(json.dumps(profile, sort_keys=True).encode()).hexdigest()


def target_times(kind: Column, anchor: Column, lo: Column, hi: Column, profile: dict, terminal: Column | None = None) -> Column:
    """Sample times of a target, kept within its window.

    Actions: offsets from the anchor. Slides and diagrams: the anchor, then where the picture
    is complete (``terminal``, else 0.25 before the window's end), then fractions of the
    window. Others: offsets, then fractions; equal times (to a microsecond) once, in order.
    """
    clamp = lambda x: F.least(hi, F.greatest(lo, x))
    span = F.greatest(F.lit(0.05), hi - lo)
    parts = lambda xs: [lo + span * x for x in xs]
    once = lambda xs: F.array_distinct(F.array(*[F.round(x, 6) for x in xs])) if xs else F.array().cast("array<double>")
    full = F.greatest(lo, hi - 0.25) if terminal is None else F.coalesce(clamp(terminal), F.greatest(lo, hi - 0.25))
    action = F.array(*[F.round(clamp(anchor + x), 6) for x in profile["action_offsets"]])
    slide = once([clamp(anchor), full, *parts(profile["slide_fractions"])])
    other = once([*[clamp(anchor + x) for x in profile["state_offsets"]], *parts(profile["state_fractions"])])
    return F.when(kind == "action_result", action).when(kind.isin("diagram", "slide"), slide).otherwise(other)


def first_known(*values: Column, among: tuple[str, ...] | None = None, default: str | None = None) -> Column:
    """The first value that is set (and allowed), else the default."""
    out = [F.when((v != "") & (v.isin(*among) if among else F.lit(True)), v) for v in values]
    return F.coalesce(*out, F.lit(default))


def caption_fields(caption: Column) -> Column:
    """(shows, why, look_at) of a caption in JSON that is an object or a plain string."""
    v = F.try_parse_json(caption)
    get = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    plain = F.coalesce(F.try_variant_get(v, "$", "string"), F.when(v.isNull(), caption))
    is_object = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    return F.struct(F.when(is_object, get("shows")).otherwise(plain).alias("shows"), F.when(is_object, get("why")).alias("why"), F.when(is_object, get("look_at")).alias("look_at"))


def metadata(info: Column) -> Column:
    """title, channel (or uploader), duration, language, id of a metadata document in JSON."""
    v = F.try_parse_json(info)
    get = lambda k, t="string": F.try_variant_get(v, f"$.{k}", t)
    return F.struct(get("title").alias("title"), F.coalesce(get("channel"), get("uploader")).alias("channel"), get("duration", "double").alias("duration"), get("language").alias("language"), get("id").alias("id"))


def inventory_fault(info: Column) -> Column:
    """malformed_response where a caption inventory in JSON is not one, else null.

    It needs an id that is not blank, a finite duration above 0, and tables of subtitles and
    automatic captions (absent ones are empty) whose entries are objects with texts as url and ext.
    """
    v = F.try_parse_json(info)
    get = lambda k, t: F.try_variant_get(v, f"$.{k}", t)
    shape = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    is_text = lambda c: F.coalesce(F.schema_of_variant(c) == "STRING", F.lit(True))
    entry = lambda e: F.startswith(F.schema_of_variant(e), F.lit("OBJECT")) & is_text(F.try_variant_get(e, "$.url", "variant")) & is_text(F.try_variant_get(e, "$.ext", "variant"))

    def table(name: str) -> Column:
        there = get(name, "variant")
        track = F.map_values(get(name, "map<string,variant>"))
        rows = lambda t: F.try_variant_get(t, "$", "array<variant>")
        whole = F.forall(track, lambda t: F.coalesce(F.forall(rows(t), entry), F.lit(False)))
        return F.coalesce(F.when(there.isNull() | (shape(name) == "VOID"), True).otherwise(whole), F.lit(False))

    named = F.coalesce((shape("id") == "STRING") & (F.trim(get("id", "string")) != ""), F.lit(False))
    length = F.when(shape("duration").rlike("^(BIGINT|DECIMAL|DOUBLE)"), get("duration", "double"))
    lasting = F.coalesce((length > 0) & (length < float("inf")), F.lit(False))
    return F.when(~(named & lasting & table("subtitles") & table("automatic_captions")), "malformed_response")


#: The media types of pictures by their suffix.
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif"}


def data_uri(name: Column, content: Column) -> Column:
    """A picture's bytes as a data address; null for other suffixes."""
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv]), suffix)
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def is_asset_name(name: Column) -> Column:
    """A base name with an image suffix and no path in it."""
    return name.rlike(r"(?i)^[^/\\:\x00]+\.(jpg|jpeg|png|webp|gif)$")


def relative(path: Column, root: Column) -> Column:
    """The path without its root."""
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).otherwise(path)


def largest_format(formats: Column) -> Column:
    """Of an array of (width, height, ...) the largest, the first on a tie."""
    area = lambda f: F.coalesce(f["width"], F.lit(0)) * F.coalesce(f["height"], F.lit(0))
    return F.aggregate(formats, F.get(formats, 0), lambda best, f: F.when(area(f) > area(best), f).otherwise(best))


def tile_times(start: Column, tiles: Column, step: Column) -> Column:
    """The times of a sheet's tiles."""
    return F.transform(F.sequence(F.lit(0), tiles - 1), lambda i: start + i * step)
