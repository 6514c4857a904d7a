"""Label vocabulary and name parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = "__IGNORE__"
# Class names by id, expected instances, and the label maps of the sources.
CLASSES = [
    (0, "C1_longitudinal_crack", 26016), (1, "C2_transverse_crack", 11830), (2, "C3_alligator_crack", 10617), (3, "C4_pothole", 6544),
    (4, "C5_white_line_blur", 5057), (5, "C6_crosswalk_blur", 793), (6, "C7_rutting", 902),
]
LABEL_MAP = {
    "rdd2022": {
        "D00": "C1_longitudinal_crack", "D01": "C1_longitudinal_crack", "D10": "C2_transverse_crack", "D11": "C2_transverse_crack",
        "D20": "C3_alligator_crack", "D40": "C4_pothole", "D43": "C6_crosswalk_blur", "D44": "C5_white_line_blur",
        "D50": IGNORE, "Repair": IGNORE, "Block crack": IGNORE, "D0w0": IGNORE,
    },
    "rdd2018": {
        "D00": "C1_longitudinal_crack", "D01": "C1_longitudinal_crack", "D10": "C2_transverse_crack", "D11": "C2_transverse_crack",
        "D20": "C3_alligator_crack", "D40": "C4_pothole", "D43": "C6_crosswalk_blur", "D44": "C5_white_line_blur",
    },
}


def view_of(country: Column, default: str = "forward") -> Column:
    return F.when(F.lower(country).contains("drone"), "topdown").otherwise(default)


def country_of_path(path: Column) -> Column:
    """The folder above the first `train` folder, else above the first `test` folder; else the last folder that isn't structural; else unknown."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    above = lambda s: (F.array_position(F.transform(parts, F.lower), s) - 1).cast("int")
    folders = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: ~F.lower(p).isin("images", "annotations", "xmls"))
    split = lambda s: F.when(above(s) > 0, F.get(parts, above(s) - 1))
    return F.coalesce(split("train"), split("test"), F.when(F.size(folders) > 0, F.element_at(folders, -1)), F.lit("unknown"))


def country_of_stem(stem: Column) -> Column:
    return F.regexp_replace(stem, "_[^_]*$", "")


def stem_of(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "^.*/", ""), r"\.[^.]*$", "")


def sequence_of(name: Column) -> Column:
    """Number between the last underscore and the extension, null if there is none."""
    return F.nullif(F.regexp_extract(name, r"_(\d+)\.", 1), F.lit("")).try_cast("bigint")
