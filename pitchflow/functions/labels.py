"""Colours, jersey numbers and other labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: hue 0-180, saturation and value 0-255, tested in this order
HSV_RANGES = (
    ("Maroon", (0, 10, 50, 255, 20, 100)),
    ("Maroon", (170, 180, 50, 255, 20, 100)),
    ("Red", (0, 15, 60, 255, 40, 255)),
    ("Red", (165, 180, 60, 255, 40, 255)),
    ("Orange", (15, 20, 80, 255, 60, 255)),
    ("Gold", (20, 25, 40, 255, 50, 255)),
    ("Yellow", (25, 35, 120, 255, 40, 255)),
    ("Lime", (35, 55, 40, 255, 40, 255)),
    ("Green", (55, 85, 40, 255, 20, 255)),
    ("Teal", (80, 95, 40, 255, 30, 150)),
    ("Cyan", (85, 105, 50, 255, 40, 255)),
    ("Blue", (100, 140, 50, 255, 81, 255)),
    ("Navy", (105, 145, 40, 255, 20, 80)),
    ("Purple", (140, 150, 40, 255, 40, 255)),
    ("Pink", (150, 170, 30, 255, 80, 255)),
    ("White", (0, 180, 0, 50, 180, 255)),
    ("Silver", (0, 180, 0, 30, 120, 180)),
    ("Black", (0, 180, 0, 255, 0, 30)),
    ("Gray", (0, 180, 0, 40, 40, 150)),
)
# fixed values: names that mean the same, and hues, in the order tested
KIT_MERGE = {"Maroon": "Red", "Pink": "Red", "Orange": "Red", "Navy": "Blue", "Cyan": "Blue", "Teal": "Blue", "Lime": "Green", "Gold": "Yellow", "Silver": "White", "Gray": "White"}
HUE_FALLBACK = ((15, "Red"), (20, "Red"), (25, "Yellow"), (35, "Yellow"), (55, "Green"), (85, "Green"), (95, "Blue"), (105, "Blue"), (145, "Blue"), (150, "Purple"))
BASIC_HUES = ((10, "red"), (25, "orange"), (35, "gold"), (55, "yellow"), (85, "green"), (105, "cyan"), (135, "blue"), (155, "purple"), (170, "magenta"))
SYNONYMS = {"maroon": "Red", "pink": "Red", "orange": "Red", "crimson": "Red", "navy": "Blue", "cyan": "Blue", "teal": "Blue", "sky": "Blue", "skyblue": "Blue", "lime": "Green", "gold": "Yellow", "silver": "White", "gray": "White", "grey": "White"}
REFERENCE_HUES = {"red": 0, "orange": 15, "yellow": 30, "gold": 30, "green": 60, "lime": 60, "teal": 75, "cyan": 90, "blue": 120, "navy": 120, "purple": 140, "magenta": 155, "pink": 170, "maroon": 0}
# fixed values: digit pairs that readers confuse
CONFUSABLE = ("17", "38", "39", "89", "08", "06", "68", "56", "59", "27", "49", "58")


def kit_color(h: Column, s: Column, v: Column) -> Column:
    """One of eight kit colours for a hue, saturation and value."""
    out = F.when((s <= 70) & (v > 150), "White").when((s <= 70) & (v < 80), "Black").when(s <= 70, "White")
    for name, (h1, h2, s1, s2, v1, v2) in HSV_RANGES:
        out = out.when(h.between(h1, h2) & s.between(s1, s2) & v.between(v1, v2), KIT_MERGE.get(name, name))
    out = out.when(h > 165, "Red")
    for limit, name in HUE_FALLBACK:
        out = out.when(h < limit, name)
    return out.otherwise("Red")


def basic_hue(h: Column) -> Column:
    out = F.when(h.isNull(), "unknown")
    for limit, name in BASIC_HUES:
        out = out.when(h < limit, name)
    return out.otherwise("red")


def describe_color(h: Column, s: Column, v: Column) -> Column:
    """s and v between 0 and 1."""
    base = basic_hue(h)
    gray = F.when(v > 0.75, "white").when(v < 0.35, "black").otherwise("gray")
    return F.when(s < 0.25, gray).when(v > 0.80, F.concat(F.lit("light_"), base)).when(v < 0.35, F.concat(F.lit("dark_"), base)).otherwise(base)


def rgb_label(r: Column, g: Column, b: Column) -> Column:
    return (
        F.when((r > 200) & (g > 200) & (b > 200), "White")
        .when((r < 50) & (g < 50) & (b < 50), "Black")
        .when((r > 150) & (g < 100) & (b < 100), "Red")
        .when((b > 150) & (r < 100) & (g < 100), "Blue")
        .when((r > 200) & (g > 200) & (b < 100), "Yellow")
        .when((g > 150) & (r < 100) & (b < 100), "Green")
        .otherwise("Unknown")
    )


def _lookup(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])


def canonical_color(name: Column) -> Column:
    own = F.lower(F.trim(name))
    return F.when(F.length(own) > 0, F.coalesce(F.try_element_at(_lookup(SYNONYMS), own), F.concat(F.upper(F.substring(own, 1, 1)), F.substring(own, 2, 1000))))


def hue_distance(a: Column, b: Column) -> Column:
    """On the circle of hues; 180 if either colour has none."""
    hues = _lookup(REFERENCE_HUES)
    d = F.abs(F.try_element_at(hues, F.lower(a)) - F.try_element_at(hues, F.lower(b)))
    return F.coalesce(F.least(d, 180 - d), F.lit(180))


def nearest_kit(color: Column, kits: Column) -> Column:
    """color, or the first of the nearest kits if it is none of them, has a hue, and lies within 30 of one."""
    near = F.filter(F.transform(kits, lambda k, i: F.struct(hue_distance(color, k).alias("d"), i.alias("i"), k.alias("k"))), lambda x: x.d <= 30)
    return F.when(F.array_contains(kits, color), color).otherwise(F.coalesce(F.array_min(near).k, color))


def digits_number(text: Column) -> Column:
    """1 to 99 if the digits of text are one or two, else null."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    n = F.when(F.length(digits).between(1, 2), digits.cast("int"))
    return F.when(n.between(1, 99), n)


def first_number(text: Column) -> Column:
    """The first run of digits, if it is 1 to 99."""
    run = F.regexp_extract(text, "[0-9]+", 0)
    n = F.when(F.length(run).between(1, 9), run.cast("int"))
    return F.when(n.between(1, 99), n)


def plausible_misread(a: Column, b: Column) -> Column:
    """Same number of digits, one of them different, and that pair is confusable."""
    pairs = F.array(*[F.lit(x) for p in CONFUSABLE for x in (p, p[::-1])])
    x, y = a.cast("string"), b.cast("string")
    differ = F.filter(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: F.when(p != q, F.concat(p, q))), lambda d: d.isNotNull())
    return (F.length(x) == F.length(y)) & (F.size(differ) == 1) & F.array_contains(pairs, F.coalesce(F.get(differ, F.lit(0)), F.lit("")))


def tier_score(tier: Column) -> Column:
    return F.when(tier == "high", 0.9).when(tier == "medium", 0.6).when(tier == "low", 0.3).otherwise(0.0)


def confidence_tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, 3).when(confidence >= 0.5, 2).otherwise(1)


def class_decision(probabilities: Column, first: int = 0) -> Column:
    """number, confidence, entropy and status from class probabilities; number 1 counts a tenth less."""
    top = F.array_max(probabilities)
    number = (F.array_position(probabilities, top) - 1 + first).cast("int")
    entropy = -F.aggregate(probabilities, F.lit(0.0), lambda acc, p: acc + p * F.log(p + 1e-10))
    confidence = top * F.when(number == 1, 0.9).otherwise(1.0)
    known = (confidence >= 0.20) & (entropy <= 4.0)
    return F.struct(F.when(known, number).alias("number"), F.when(known, confidence).otherwise(0.0).alias("confidence"), entropy.alias("entropy"), F.when(known, "valid").otherwise("unknown").alias("status"))


def url_key(url: Column) -> Column:
    """Key of a source: the address without its query."""
    return F.sha1(F.when(url.startswith("http"), F.regexp_replace(url, r"[?#].*$", "")).otherwise(url))


def owner_of_path(path: Column) -> Column:
    parts = F.split(path, "/")
    prefix = F.when(F.instr(path, "_") > 0, F.substring_index(path, "_", 1))
    second = F.get(parts, F.lit(1))
    return F.coalesce(F.when(F.length(second) > 0, second), prefix, F.lit("unknown"))


# fixed values: which kits count as one in team assignment, and the likely opponent of a single known kit
TEAM_MERGE = {"lime": "green", "teal": "green", "navy": "blue", "cyan": "blue", "maroon": "red", "pink": "red", "orange": "red", "silver": "white", "gray": "white", "gold": "yellow", "purple": "blue"}
OPPONENT = {"Red": "Blue", "Blue": "Red", "Green": "White", "White": "Red", "Black": "White", "Yellow": "Blue"}


def team_color(name: Column) -> Column:
    """The kit that a colour counts as when teams are assigned; Unknown stays."""
    merged = F.lower(name)
    for a, b in TEAM_MERGE.items():
        merged = F.when(F.lower(name) == a, b).otherwise(merged)
    return F.initcap(merged)


def likely_opponent(kit: Column) -> Column:
    out = F.when(F.lit(False), "")
    for a, b in OPPONENT.items():
        out = out.when(kit == a, b)
    return out.otherwise("TeamB")


def reference_hue(name: Column) -> Column:
    """Null for white, black, gray, silver and unknown names."""
    out = F.when(F.lit(False), 0)
    for a, h in REFERENCE_HUES.items():
        out = out.when(F.lower(name) == a, h)
    return out


def nearer_reference(b: Column, g: Column, r: Column, first: tuple[int, int, int], second: tuple[int, int, int], names: tuple[str, str] = ("first", "second")) -> Column:
    """The one of two calibrated colours that is nearer in blue, green and red; the second of equals."""
    d = lambda ref: sum((c - F.lit(x)) * (c - F.lit(x)) for c, x in zip((b, g, r), ref))
    return F.when(d(first) < d(second), names[0]).otherwise(names[1])


def nearest_named(b: Column, g: Column, r: Column, palette: dict[str, tuple[int, int, int]]) -> Column:
    """Name of the palette's nearest colour by squared distance, the first of equals."""
    every = F.array(*[F.struct(sum((c - F.lit(x)) * (c - F.lit(x)) for c, x in zip((b, g, r), ref)).alias("d"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, ref) in enumerate(palette.items())])
    return F.array_min(every)["name"]


def jersey_range(number: Column) -> Column:
    """Whether a number is none, or one that a player can wear."""
    return number.isNull() | number.between(1, 99)
