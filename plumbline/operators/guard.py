"""What may be read: splits, languages, paths, ids."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of splits and what they stand for; names that are never read.
SPLITS = {"train": "dev/train", "dev/train": "dev/train", "val": "dev/val", "dev/val": "dev/val"}
LANGUAGES = ("de", "fr", "it")
FORBIDDEN = ("test", "full")


class HeldOut(PermissionError):
    """Held-out material was asked for."""


def normal_split(name: Column) -> Column:
    """Full split name; null for what is not allowed."""
    low = F.replace(F.lower(F.trim(name)), F.lit("_"), F.lit("/"))
    allowed = F.create_map(*[F.lit(x) for kv in SPLITS.items() for x in kv])
    return F.when(~F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, FORBIDDEN))), F.try_element_at(allowed, low))


def forbidden_path(path: Column) -> Column:
    """Whether a component of a path names held-out material."""
    parts = F.split(F.lower(path), "[/.]")
    return F.arrays_overlap(parts, F.array(*map(F.lit, FORBIDDEN)))


def allowed_language(lang: Column, languages: tuple[str, ...] = LANGUAGES) -> Column:
    return lang.isin(*languages)


def unknown_ids(ids: DataFrame, manifest: DataFrame, key: str = "id") -> DataFrame:
    return ids.join(manifest, key, "left_anti")


def assert_known(ids: DataFrame, manifest: DataFrame, key: str = "id") -> None:
    first = [r[0] for r in unknown_ids(ids, manifest, key).select(key).limit(5).collect()]
    if first:
        raise HeldOut(f"ids outside the manifest: {first}")


def assert_inside(path: str, root: str) -> Path:
    """The real path; no link, nothing outside ``root``, no forbidden component."""
    p = Path(path)
    if any(x.is_symlink() for x in (p, *p.parents)):
        raise HeldOut(f"a link: {path}")
    real, base = p.resolve(), Path(root).resolve()
    if not real.is_relative_to(base) or set(x.lower() for x in real.relative_to(base).parts) & set(FORBIDDEN):
        raise HeldOut(f"not allowed: {path}")
    return real


def duplicate_ids(records: DataFrame, key: str = "id") -> DataFrame:
    return records.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
