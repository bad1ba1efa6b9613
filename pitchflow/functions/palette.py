"""Named colours, and the nearest of them to any colour by a table of cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: standard web colours by name, as blue, green and red; of equal ones the first counts
WEB = {
    "Maroon": (0, 0, 128), "DarkRed": (0, 0, 139), "Brown": (42, 42, 165), "Firebrick": (34, 34, 178), "Crimson": (60, 20, 220), "Red": (0, 0, 255),
    "Tomato": (71, 99, 255), "Coral": (80, 127, 255), "IndianRed": (92, 92, 205), "LightCoral": (128, 128, 240), "DarkSalmon": (122, 150, 233),
    "Salmon": (114, 128, 250), "LightSalmon": (122, 160, 255), "OrangeRed": (0, 69, 255), "DarkOrange": (0, 140, 255), "Orange": (0, 165, 255),
    "Gold": (0, 215, 255), "DarkGoldenRod": (11, 134, 184), "GoldenRod": (32, 165, 218), "PaleGoldenRod": (170, 232, 238),
    "DarkKhaki": (107, 183, 189), "Khaki": (140, 230, 240), "Olive": (0, 128, 128), "Yellow": (0, 255, 255), "YellowGreen": (50, 205, 154),
    "DarkOliveGreen": (47, 107, 85), "OliveDrab": (35, 142, 107), "LawnGreen": (0, 252, 124), "Chartreuse": (0, 255, 127),
    "GreenYellow": (47, 255, 173), "DarkGreen": (0, 100, 0), "Green": (0, 128, 0), "ForestGreen": (34, 139, 34), "Lime": (0, 255, 0),
    "LimeGreen": (50, 205, 50), "PaleGreen": (152, 251, 152), "LightGreen": (144, 238, 144), "MediumSpringGreen": (154, 250, 0),
    "SpringGreen": (127, 255, 0), "MediumSeaGreen": (113, 179, 60), "SeaGreen": (87, 139, 46), "Teal": (128, 128, 0), "DarkCyan": (139, 139, 0),
    "LightSeaGreen": (170, 178, 32), "CadetBlue": (160, 158, 95), "DarkTurquoise": (209, 206, 0), "MediumTurquoise": (204, 209, 72),
    "Turquoise": (208, 224, 64), "Aqua": (255, 255, 0), "Cyan": (255, 255, 0), "Aquamarine": (212, 255, 127), "PaleTurquoise": (238, 238, 175),
    "LightCyan": (255, 255, 224), "Navy": (128, 0, 0), "DarkBlue": (139, 0, 0), "MediumBlue": (205, 0, 0), "Blue": (255, 0, 0),
    "MidnightBlue": (112, 25, 25), "RoyalBlue": (225, 105, 65), "SteelBlue": (180, 130, 70), "DodgerBlue": (255, 144, 30),
    "DeepSkyBlue": (255, 191, 0), "CornflowerBlue": (237, 149, 100), "SkyBlue": (235, 206, 135), "LightSkyBlue": (250, 206, 135),
    "LightSteelBlue": (222, 196, 176), "LightBlue": (230, 216, 173), "PowderBlue": (230, 224, 176), "Indigo": (130, 0, 75), "Purple": (128, 0, 128),
    "DarkMagenta": (139, 0, 139), "DarkViolet": (211, 0, 148), "DarkOrchid": (204, 50, 153), "MediumOrchid": (211, 85, 186),
    "Magenta": (255, 0, 255), "Fuchsia": (255, 0, 255), "Violet": (238, 130, 238), "Plum": (221, 160, 221), "Thistle": (216, 191, 216),
    "Lavender": (250, 230, 230), "MistyRose": (225, 228, 255), "AntiqueWhite": (215, 235, 250), "Linen": (230, 240, 250), "Beige": (220, 245, 245),
    "WhiteSmoke": (245, 245, 245), "LavenderBlush": (245, 240, 255), "OldLace": (230, 245, 253), "AliceBlue": (255, 248, 240),
    "Seashell": (238, 245, 255), "GhostWhite": (255, 248, 248), "Honeydew": (240, 255, 240), "FloralWhite": (240, 250, 255),
    "Azure": (255, 255, 240), "MintCream": (250, 255, 245), "Snow": (250, 250, 255), "Ivory": (240, 255, 255), "White": (255, 255, 255),
    "Black": (0, 0, 0), "DarkSlateGray": (79, 79, 47), "DimGray": (105, 105, 105), "SlateGray": (144, 128, 112), "LightSlateGray": (153, 136, 119),
    "Gray": (128, 128, 128), "LightGray": (211, 211, 211), "DarkGray": (169, 169, 169), "Silver": (192, 192, 192), "Gainsboro": (220, 220, 220),
}
#: Side of a cell of the colour cube.
CELL = 16


def cells(palette: dict[str, tuple[int, int, int]] = WEB, side: int = CELL) -> list[tuple[int, list[tuple[int, int, int, int, str]]]]:
    """For each cell of the cube of colours, the names that are nearest to some point of it: those whose least distance to
    the cell is not above the least of all largest distances."""
    ref = np.array(list(palette.values()), dtype=np.int64)
    n = -(-256 // side)
    low = np.stack(np.meshgrid(*[np.arange(n) * side] * 3, indexing="ij"), axis=-1).reshape(-1, 1, 3)
    high = np.minimum(low + side - 1, 255)
    far = np.maximum(np.abs(ref - low), np.abs(ref - high))
    near = np.maximum(np.maximum(low - ref, ref - high), 0)
    may = (near * near).sum(axis=2) <= (far * far).sum(axis=2).min(axis=1, keepdims=True)
    names = list(palette)
    return [(cell, [(k, *ref[k].tolist(), names[k]) for k in np.flatnonzero(row).tolist()]) for cell, row in enumerate(may)]


def nearest_names(rows: DataFrame, b: str = "b", g: str = "g", r: str = "r", name: str = "name", palette: dict[str, tuple[int, int, int]] = WEB, side: int = CELL) -> DataFrame:
    """rows with the name of the palette's colour that is nearest by squared distance, the first of equals. A row meets the
    few candidates of its cell, not the whole palette; a row with a missing part has none."""
    spark: SparkSession = rows.sparkSession
    # (256 / side)^3 rows, whatever the input
    table = spark.createDataFrame(cells(palette, side), "_cell int, _names array<struct<k:int,b:int,g:int,r:int,name:string>>")
    n = -(-256 // side)
    at = lambda c: F.expr(f"CAST(floor(`{c}`) AS INT) DIV {side}")
    cell = ((at(b) * n + at(g)) * n + at(r)).cast("int")
    off = lambda c, x: (F.col(c) - x[c0[c]]) * (F.col(c) - x[c0[c]])
    c0 = {b: "b", g: "g", r: "r"}
    best = F.array_min(F.transform("_names", lambda x: F.struct((off(b, x) + off(g, x) + off(r, x)).alias("d"), x["k"].alias("k"), x["name"].alias("name"))))
    return rows.withColumn("_cell", cell).join(F.broadcast(table), "_cell", "left").withColumn(name, best["name"]).drop("_cell", "_names")
