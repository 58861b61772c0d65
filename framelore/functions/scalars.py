"""Scalar functions, as columns: codecs, names, geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelore.functions import fixed


# --- codecs ------------------------------------------------------------------------------------------------------------


def label_to_int(label: Column, strict: bool = True) -> Column:
    """no_fall 0, fall 1; anything else is an error, or null where not strict."""
    other = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))).cast("int") if strict else F.lit(None).cast("int")
    return F.when(label == "no_fall", 0).when(label == "fall", 1).otherwise(other)


def int_to_label(value: Column, strict: bool = True) -> Column:
    other = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(value.cast("string"), F.lit("null")))).cast("string") if strict else F.lit(None).cast("string")
    return F.when(value == 0, "no_fall").when(value == 1, "fall").otherwise(other)


def normalised(text: Column) -> Column:
    """Trimmed and in lower case; null stays null."""
    return F.lower(F.trim(text))


def to_bool(text: Column) -> Column:
    """true, yes, 1 and false, no, 0 in any case; anything else, empty texts too, null."""
    t = normalised(text)
    return F.when(t.isin("true", "yes", "1"), True).when(t.isin("false", "no", "0"), False)


def bad_bool(text: Column) -> Column:
    """Whether a text is neither empty nor a boolean."""
    return text.isNotNull() & (normalised(text) != "") & to_bool(text).isNull()


def hard_label(score: Column, threshold: float) -> Column:
    """1 where score >= threshold, else 0; NaN is 0 (as in Spark NaN is above all numbers)."""
    return F.when(score.isNull(), None).otherwise(((score >= threshold) & ~F.isnan(score)).cast("int"))


def context(value: Column) -> Column:
    """An execution context; anything unknown, null too, is "unknown", which has no privileges."""
    return F.when(normalised(value).isin(*fixed.CONTEXTS), normalised(value)).otherwise(F.lit("unknown"))


def slice_tags(**tags: Column) -> Column:
    """Map of the tags that are not null; booleans as true and false."""
    pairs = [x for name, c in tags.items() for x in (F.lit(name), c.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


# --- names -------------------------------------------------------------------------------------------------------------


def clip_folder(name: Column) -> Column:
    """(label, sequence, camera) of a clip's folder name, such as fall-01-cam0-rgb; null where it names none.

    A copy's number in brackets at the end doesn't count.  The label comes from the prefix; sequence is the second
    part; camera the first later part that is "cam" and digits.
    """
    plain = F.regexp_replace(normalised(name), r"\s+\(\d+\)\s*$", "")
    parts = F.split(plain, "-")
    label = F.when(plain.startswith("fall-"), "fall").when(plain.startswith("adl-"), "no_fall")
    camera = F.get(F.filter(F.slice(parts, 3, 1 << 20), lambda p: p.rlike(r"^cam\d+$")), F.lit(0))
    return F.when(label.isNotNull(), F.struct(plain.alias("name"), label.alias("label"), F.get(parts, F.lit(1)).alias("sequence"), camera.alias("camera")))


def clip_id_of_folder(folder: Column) -> Column:
    return F.concat(F.lit(fixed.CLIP_ID_PREFIX), F.lower(folder))


def sequence_of_clip(clip_id: Column) -> Column:
    """fall-NN or adl-NN of a clip id; null where the id has another form."""
    found = F.regexp_extract(clip_id, rf"^{fixed.CLIP_ID_PREFIX}((?:fall|adl)-.*){fixed.CLIP_ID_SUFFIX}$", 1)
    return F.when(found != "", found)


def clip_type(sequence: Column) -> Column:
    return F.when(sequence.startswith("fall-"), "fall").when(sequence.startswith("adl-"), "adl")


def folder_of_url(url: Column) -> Column:
    """The last part of an address without .zip."""
    return F.regexp_replace(basename(url), r"\.zip$", "")


def sidecar(frame: dict[str, Column], crop: dict[str, Column]) -> Column:
    """The JSON sidecar of a frame: fields that aren't known as null, how it was cropped as one object."""
    cropped = F.struct(*(crop[n].alias(n) for n in fixed.SIDECAR_CROP)).alias("crop_config")
    rest = (frame[n].alias(n) for n in fixed.SIDECAR_LAST)
    return F.to_json(F.struct(*(frame[n].alias(n) for n in fixed.SIDECAR_FIELDS), cropped, *rest), {"ignoreNullFields": "false"})


def trailing_number(stem: Column) -> Column:
    """Digits at the end of a name, or -1."""
    return F.coalesce(F.regexp_extract(stem, r"(\d+)\s*$", 1).try_cast("bigint"), F.lit(-1).cast("bigint"))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def safe_name(text: Column) -> Column:
    """Letters, digits, _ and -; others become _; nothing left is "unnamed"."""
    clean = F.regexp_replace(text, r"[^A-Za-z0-9_-]", "_")
    return F.when(F.coalesce(clean, F.lit("")) == "", "unnamed").otherwise(clean)


def shard_name(index: Column, width: Column) -> Column:
    """shard-, the index padded to width (never cut), .tar."""
    digits = index.cast("string")
    return F.concat(F.lit("shard-"), F.lpad(digits, F.greatest(width, F.length(digits)), F.lit("0")), F.lit(".tar"))


def shard_width(most: Column) -> Column:
    """Digits of shard numbers where there are at most so many shards: four or more, the same for the same bound."""
    return F.greatest(F.lit(4), F.length(F.greatest(F.lit(1), most).cast("string")))


def member_key(source: Column, track: Column, window: Column) -> Column:
    return F.concat(safe_name(source), F.lit("_t"), track.cast("string"), F.lit("_w"), F.lpad(window.cast("string"), F.greatest(F.lit(3), F.length(window.cast("string"))), F.lit("0")))


# --- geometry ----------------------------------------------------------------------------------------------------------


def expand_box(x0: Column, y0: Column, x1: Column, y1: Column, margin: float) -> tuple[Column, Column, Column, Column]:
    """A square around the box's centre, its side the longer side (1 at least) times 1 + margin."""
    half = F.greatest(x1 - x0, y1 - y0, F.lit(1.0)) * (1.0 + margin) / 2.0
    cx, cy = (x0 + x1) / 2.0, (y0 + y1) / 2.0
    return cx - half, cy - half, cx + half, cy + half


def clamp_box(x0: Column, y0: Column, x1: Column, y1: Column, width: int, height: int) -> tuple[Column, Column, Column, Column]:
    def inside(v: Column, most: int) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(float(most)), v))

    return inside(x0, width), inside(y0, height), inside(x1, width), inside(y1, height)


def square(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The square canvas of a box and where the box lies centred on it."""
    w, h = F.greatest(F.lit(0.0), x1 - x0), F.greatest(F.lit(0.0), y1 - y0)
    side = F.greatest(w, h)
    return F.struct(
        x0.alias("x_min"), y0.alias("y_min"), side.alias("size"), ((side - w) / 2.0).alias("offset_x"), ((side - h) / 2.0).alias("offset_y"),
        w.alias("clipped_width"), h.alias("clipped_height"),
    )


def crop_geometry(x0: Column, y0: Column, x1: Column, y1: Column, margin: float, width: int, height: int) -> Column:
    return square(*clamp_box(*expand_box(x0, y0, x1, y1, margin), width, height))


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


def shorter_side(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.least(F.greatest(F.lit(0.0), x1 - x0), F.greatest(F.lit(0.0), y1 - y0))


def rate(frames: Column, seconds: Column) -> Column:
    """Frames a second, 0 where no time has passed."""
    return F.coalesce(F.when(seconds > 0, F.try_divide(frames, seconds)), F.lit(0.0))


def latency_ms(frames: Column, seconds: Column) -> Column:
    return F.coalesce(F.when(frames > 0, F.try_divide(seconds * 1000.0, frames)), F.lit(0.0))


def track_colour(track: Column) -> Column:
    """(r, g, b) of a track: hue 47 degrees on for each id, saturation 0.85, value 0.95."""
    hue = F.pmod(track * fixed.TRACK_HUE_STEP, F.lit(360)) / 60.0
    sector = F.floor(hue).cast("int")
    part, v, s = hue - F.floor(hue), fixed.TRACK_VALUE, fixed.TRACK_SATURATION
    p, q, t = F.lit(v * (1 - s)), F.lit(v) * (1 - F.lit(s) * part), F.lit(v) * (1 - F.lit(s) * (1 - part))
    full = F.lit(v)

    def pick(*by_sector: Column) -> Column:
        out = by_sector[5]
        for k in range(4, -1, -1):
            out = F.when(sector == k, by_sector[k]).otherwise(out)
        return F.floor(out * 255).cast("int")

    return F.struct(pick(full, q, p, p, t, full).alias("r"), pick(t, full, full, q, p, p).alias("g"), pick(p, p, t, full, full, q).alias("b"))


def box_label(track: Column, confidence: Column) -> Column:
    """The track, if there is one, and the confidence with two digits, an exact half to the even one."""
    shown = F.when(confidence * 8 == F.floor(confidence * 8), F.bround(confidence, 2)).otherwise(confidence)  # only eighths lie exactly between
    return F.when(track.isNull(), F.format_string("%.2f", shown)).otherwise(F.format_string("track %d %.2f", track, shown))


def subsample(items: Column, count: int) -> Column:
    """``count`` items evenly spread over an array: all, every k-th where it divides, else rounded half to even.

    A longer result than the array is an error.
    """
    n = F.size(items)
    even = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.element_at(items, (i * F.floor(n / count) + 1).cast("int")))
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.element_at(items, (F.bround(i * (n - 1) / F.lit(max(count - 1, 1))) + 1).cast("int"))
    )
    return F.when(n < count, F.raise_error(F.lit("can't take more frames than there are"))).when(n % count == 0, even).otherwise(spread)
