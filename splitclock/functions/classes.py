"""Car classes and surfaces: fixed lookups as map and ``when`` expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Raw class name -> canonical class.
CLASS_NAMES = {
    "Rally2": [
        "rally2", "rally 2", "Rally 2", "Rally2", "Rally2 Kit", "rally2 kit", "VR4K", "R4", "VR4", "NR4",
        "Grup NR4", "S2000", "S2000-Rally", "Sınıf N", "Grup N 2000+", "2",
    ],
    "Rally3": ["rally3", "Rally 3", "Rally3", "3"],
    "Rally4": ["rally4", "Rally 4", "Rally4", "R2", "Grup R2", "R3", "R3T", "R3D", "Grup A", "Grup A 2000", "4"],
    "Rally5": ["rally5", "Rally 5", "Rally5", "Rally5 Kit", "R1", "R1T", "5"],
    "K1": ["Kategori 1", "H11", "K1"],
    "K2": ["Kategori 2", "H12", "K2"],
    "K3": ["Kategori 3", "H13", "Open 1600", "K3"],
    "K4": ["Kategori 4", "H14", "Open 2000", "K4"],
    "H1": ["H1"],
    "H2": ["H2"],
    "N": ["N"],
}

# Live reference-time factor per class, and the default.
LIVE_CLASS_FACTORS = {
    "WRC": 1.0, "Rally1": 1.0, "Rally2": 1.08, "R5": 1.08, "Rally3": 1.15, "R2": 1.15, "Rally4": 1.12,
    "Rally5": 1.18, "N": 1.15, "K1": 1.10, "K2": 1.12, "K3": 1.18, "K4": 1.22, "H1": 1.10, "H2": 1.15,
}
MANUAL_CLASS_FACTORS = {
    "WRC": 1.0, "Rally1": 1.0, "Rally2": 1.08, "R5": 1.08, "R4": 1.08, "Rally3": 1.15, "R2": 1.15,
    "N4": 1.12, "NR4": 1.12,
}
FALLBACK_CLASS_FACTORS = {
    "WRC": 1.0, "Rally1": 1.0, "Rally2": 1.08, "R5": 1.08, "Rally3": 1.15, "R2": 1.15, "N4": 1.12,
}
DEFAULT_CLASS_FACTOR = 1.10

# Class strength order.
CLASS_ORDER = {"R2": 1, "Rally3": 2, "Rally2": 3, "R5": 4, "N4": 5, "Rally1": 6, "WRC": 7}

# Surface by the first of these place names found in an event name, in this order.
SURFACE_KEYWORDS = {
    "sarıkamış": "snow",
    "bodrum": "asphalt",
    "marmaris": "asphalt",
    "kocaeli": "gravel",
    "istanbul": "gravel",
    "bursa": "asphalt",
    "eskişehir": "asphalt",
    "hitit": "gravel",
    "yeşil bursa": "asphalt",
    "ege": "asphalt",
    "troia": "gravel",
    "çanakkale": "gravel",
}
DEFAULT_SURFACE = "gravel"


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def _class_map() -> Column:
    return literal_map({raw: name for name, raws in CLASS_NAMES.items() for raw in raws})


def normalize_class(raw: Column) -> Column:
    """Canonical class: exact name, then lower-cased name, else the trimmed input; empty is ``Unknown``."""
    t = F.trim(raw)
    names = _class_map()
    known = F.coalesce(F.try_element_at(names, t), F.try_element_at(names, F.lower(t)), t)
    return F.when(F.coalesce(raw, F.lit("")) == "", "Unknown").otherwise(known)


def class_factor(name: Column, factors: dict, default: float = DEFAULT_CLASS_FACTOR, second: Column | None = None) -> Column:
    table = literal_map(factors)
    tries = [F.try_element_at(table, name)]
    if second is not None:
        tries.append(F.try_element_at(table, second))
    return F.coalesce(*tries, F.lit(default))


def class_ordinal(name: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(CLASS_ORDER), name), F.lit(0))


def surface_from_name(name: Column, default: str = DEFAULT_SURFACE) -> Column:
    t = F.lower(name)
    out = F.lit(None).cast("string")
    for keyword, surface in reversed(SURFACE_KEYWORDS.items()):
        out = F.when(t.contains(keyword), surface).otherwise(out)
    return F.coalesce(out, F.lit(default))


# Words that rule an event out or in.
EXCLUDED_EVENTS = "baja|off-road|offroad|cross country|autocross|slalom|tırmanma"
INCLUDED_EVENTS = "ralli|rally|türkiye ralli şampiyonası|fia rally"


def is_event_category(name: Column, category: Column | None = None, tables: Column | None = None) -> Column:
    """Does a page describe a rally? Name words decide first, then the category tag, then the table count."""
    t = F.lower(name)
    out = F.when(t.rlike(EXCLUDED_EVENTS), False).when(t.rlike(INCLUDED_EVENTS), True)
    if category is not None:
        c = F.lower(category)
        out = out.when(c.rlike("ralli|rally"), True).when(c.rlike("baja|offroad"), False)
    return out.otherwise(F.coalesce(tables >= 6, F.lit(False)) if tables is not None else F.lit(False))


# Placemark names that are no stage.
NON_STAGE_WORDS = "servis|service|start|finish|finiş|zk|transfer|liaison|park"


def is_stage_placemark(name: Column, distance_km: Column | None = None) -> Column:
    ok = ~F.lower(F.coalesce(name, F.lit(""))).rlike(NON_STAGE_WORDS)
    if distance_km is not None:
        ok = ok & ~F.coalesce((distance_km > 0) & (distance_km < 0.5), F.lit(False))
    return ok


def is_marked_stage(name: Column, marker: str = "ÖE") -> Column:
    """The stricter variant: only names that carry the stage marker."""
    return F.coalesce(name.contains(marker), F.lit(False))
