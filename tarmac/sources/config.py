"""Small configuration texts, read on the driver: class maps, data descriptions, tiling headers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TILING = r"tile\s*[=:]\s*(\d+).*?overlap\s*[=:]\s*([0-9.]+)(?:.*?tile_above\s*[=:]\s*(\d+))?"


def class_map(text: str, source: str) -> dict[str, str]:
    """label -> target of one source of a class map; YAML if the library is there, else a reader of its plain two-level form."""
    try:
        import yaml

        return dict(yaml.safe_load(text)["sources"][source]["label_map"])
    except ImportError:
        out, at, inside = {}, None, False
        for line in text.splitlines():
            body = line.split(" #")[0].rstrip()
            if re.fullmatch(r"  \w+:", body):
                at, inside = body.strip(" :"), False
            elif body.strip() == "label_map:":
                inside = at == source
            elif inside and (m := re.fullmatch(r"      \"?([^\":]+)\"?: *(\S+)", body)):
                out[m[1]] = m[2]
            elif inside and body and not body.startswith("      "):
                inside = False
        return out


def data_description(text: str) -> dict:
    """Provenance comments, image folders and class names of a data description."""
    head = {m[1]: m[2] for m in re.finditer(r"^#\s*([\w.]+)\s*[:=]\s*(.+?)\s*$", text, re.M)}
    keys = {m[1]: m[2] for m in re.finditer(r"^(path|train|val|test):\s*(\S+)\s*$", text, re.M)}
    names = {int(m[1]): m[2] for m in re.finditer(r"^\s+(\d+):\s*(\S+)\s*$", text, re.M)}
    val = keys.get("val", "")
    return {"provenance": head, **keys, "val_images": val, "val_labels": val.replace("images", "labels", 1), "names": names}


def tiling_of(header: Column) -> Column:
    """Struct of tile, overlap and tile_above that a header states, null where it doesn't."""
    part = lambda i, t: F.nullif(F.regexp_extract(header, TILING, i), F.lit("")).try_cast(t)
    return F.struct(part(1, "int").alias("tile"), part(2, "double").alias("overlap"), part(3, "int").alias("tile_above"))
