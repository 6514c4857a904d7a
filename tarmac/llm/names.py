"""Keys that image file names and object ids give, whatever their spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# country, drive and frame, in that order: words of letters, a marked drive number, a frame number
# that may be marked, and whatever else (copy marks, extension) after it.
FILE_NAME = (
    r"^(\p{L}+(?:[ _.\-]+\p{L}+)*?)[ _.\-]+d(?:rive)?[ _.\-]*([0-9]+)"
    r"[ _.\-]+(?:f(?:rame)?[ _.\-]*)?([0-9]+)(?:[^0-9\p{L}].*)?$"
)
OBJECT_ID = r"^[\s\p{Z}]*(ob-[0-9]+)[\s\p{Z}]*$"


def _base(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def _number(text: Column) -> Column:
    return F.regexp_replace(text, "^0+(?=[0-9])", "")


def drive_key(name: Column) -> Column:
    """'unitedstates-34', null if the name says nothing."""
    b = _base(name)
    key = F.concat(F.regexp_replace(F.regexp_extract(b, FILE_NAME, 1), r"[^\p{L}]", ""), F.lit("-"), _number(F.regexp_extract(b, FILE_NAME, 2)))
    return F.when(b.rlike(FILE_NAME), key)


def frame_key(name: Column) -> Column:
    """'unitedstates-34-7', null if the name says nothing."""
    b = _base(name)
    return F.when(b.rlike(FILE_NAME), F.concat(drive_key(name), F.lit("-"), _number(F.regexp_extract(b, FILE_NAME, 3))))


def object_key(uid: Column) -> Column:
    """'ob-00000017', null for anything but an object id."""
    low = F.lower(uid)
    return F.when(low.rlike(OBJECT_ID), F.regexp_extract(low, OBJECT_ID, 1))


def split_of(hint: Column) -> Column:
    """train, val or test by the hint, whatever its spelling; else null."""
    h = F.lower(F.regexp_replace(hint, r"[^\p{L}]", ""))
    return F.when(h.isin("train", "training", "trn"), "train").when(h.isin("val", "valid", "validation", "dev"), "val").when(h.isin("test", "testing", "tst"), "test")
