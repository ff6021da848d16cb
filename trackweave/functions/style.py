"""Modes of transport, colours, drawing tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackweave.functions.geo import interpolated

# For each mode the line weight in points, the lowest zoom, the colour of a line without one and the drawing order.
MODES = {
    "longdistance": (3.364, 0, "#e30513", 50),
    "regional": (2.804, 6, "#014895", 40),
    "suburban": (2.804, 7, "#4b8f46", 30),
    "subway": (2.243, 9, "#0069b4", 20),
    "tram": (2.243, 10, "#951b81", 10),
    "coach": (2.243, 5, "#73d700", 5),
}
# Colours for lines without one, chosen by a hash of the key.
PALETTE = ("#014895", "#00887d", "#951b81", "#4b8f46", "#0069b4", "#e30513", "#fed060", "#87b6dd")
# Colour names and what they stand for.
NAMED = {
    "red": "#e30513", "blue": "#0069b4", "green": "#4b8f46", "yellow": "#fed060", "purple": "#951b81",
    "violet": "#951b81", "orange": "#e8720c", "brown": "#8b5a2b", "black": "#1a1a1a", "grey": "#808080",
    "gray": "#808080", "white": "#ffffff", "magenta": "#e6007e", "cyan": "#00a5b5", "pink": "#e6007e",
}
# By rank of a stop the lowest zoom of its mark and of its label.
STOP_TIERS = {0: (6.0, 8.0), 1: (9.0, 10.0), 2: (11.0, 12.0), 3: (12.0, 13.5)}
# Effects of a closure, worst first, with their rank.
EFFECT_RANK = {"closed": 4, "single-track": 3, "diverted": 2, "slower": 1, "other": 0}
# Lowest zoom at which a closure of each effect is drawn.
CLOSURE_ZOOM = {"closed": 6.0, "single-track": 6.0, "diverted": 10.0, "slower": 10.0, "other": 10.0}
# Factors by zoom on the line weight and on the spread of a bundle; pixels in a point; widening of a chosen line.
WEIGHT_STOPS = [(5, 0.45), (8, 0.7), (11, 1.0), (14, 1.6)]
SPREAD_STOPS = [(5, 0.0), (6, 0.08), (8, 0.4), (11, 1.0), (14, 1.6)]
PIXELS_PER_POINT, CHOSEN_FACTOR, PITCH_FACTOR = 1.4, 2.1, 1.02
TILE_ZOOM, PIXELS_PER_UNIT = 14, 2.0


def lookup(col: Column, table: dict, default: Column | None = None) -> Column:
    """A small table of constants as an expression; null where it has no entry."""
    out = None
    for key, value in table.items():
        out = F.when(col == key, F.lit(value)) if out is None else out.when(col == key, F.lit(value))
    return out if default is None else out.otherwise(default)


def mode_order(mode: Column) -> Column:
    return lookup(mode, {m: v[3] for m, v in MODES.items()})


def normalise_colour(col: Column) -> Column:
    """#rrggbb in lower case of #rgb, #rrggbb or a name; null if it is none of these."""
    v = F.lower(F.trim(col))
    short = F.regexp_replace(v, "^#(.)(.)(.)$", "#$1$1$2$2$3$3")
    return F.when(v.rlike("^#[0-9a-f]{6}$"), v).when(v.rlike("^#[0-9a-f]{3}$"), short).otherwise(lookup(v, NAMED))


def fnv1a(key: Column) -> Column:
    """32-bit FNV-1a over the characters, as a signed number."""
    mask = F.lit(0xFFFFFFFF)
    chars = F.filter(F.split(key, ""), lambda c: c != "")
    # The prime is 2**24 + 403: the product stays within 64 bits if only the low 8 bits are shifted by 24.
    step = lambda h, c: ((h.bitwiseXOR(F.ascii(c).cast("long")) * 403) + F.shiftleft(h.bitwiseXOR(F.ascii(c).cast("long")).bitwiseAND(F.lit(0xFF)), 24)).bitwiseAND(mask)
    h = F.aggregate(chars, F.lit(2166136261).cast("long"), step)
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)


def fallback_colour(key: Column, mode: Column) -> Column:
    """The same colour for the same key; long-distance, coach and keyless lines have their mode's."""
    pick = F.pmod(F.abs(fnv1a(key)), F.lit(len(PALETTE))).cast("int")
    own = lookup(mode, {m: v[2] for m, v in MODES.items()})
    return F.when(mode.isin("longdistance", "coach") | (F.coalesce(key, F.lit("")) == ""), own).otherwise(F.get(F.array(*map(F.lit, PALETTE)), pick))


def luminance(colour: Column) -> Column:
    def channel(at: int) -> Column:
        c = F.conv(F.substring(colour, at, 2), 16, 10).cast("double") / 255
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * channel(2) + 0.7152 * channel(4) + 0.0722 * channel(6)


def text_on(colour: Column) -> Column:
    """Dark text on light colours."""
    return F.when(luminance(colour) > 0.179, "#1a1a1a").otherwise("#ffffff")


def band_reach(zoom: Column, widest: Column) -> Column:
    """Pixels from the centre of a bundle to the outer edge of its outermost band."""
    heaviest = max(v[0] for v in MODES.values())
    pitch = MODES["regional"][0] * PIXELS_PER_POINT * PITCH_FACTOR
    return F.abs(widest) * pitch * interpolated(SPREAD_STOPS, zoom) + heaviest * PIXELS_PER_POINT * interpolated(WEIGHT_STOPS, zoom) * CHOSEN_FACTOR / 2


def tile_margin(widest: Column) -> Column:
    return F.ceil(band_reach(F.lit(float(TILE_ZOOM)), widest) / PIXELS_PER_UNIT)


def stop_rank(modes: Column, lines: Column, major: Column) -> Column:
    only = lambda m: (F.size(modes) > 0) & F.forall(modes, lambda x: x == m)
    main = F.array_contains(modes, "longdistance") | (major & (lines >= 3))
    middle = (lines >= 3) | major | (F.size(modes) >= 2)
    return F.when(only("tram"), 3).when(only("coach"), 1).when(main, 0).when(middle, 1).otherwise(2)
