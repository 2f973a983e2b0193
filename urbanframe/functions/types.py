"""Type names of the model, and tests on small lists, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public city-model format, version 2.0.
OBJECT_TYPES = (
    "Bridge", "BridgePart", "BridgeInstallation", "BridgeConstructiveElement", "BridgeRoom", "BridgeFurniture",
    "Building", "BuildingPart", "BuildingInstallation", "BuildingConstructiveElement", "BuildingFurniture", "BuildingStorey", "BuildingRoom", "BuildingUnit",
    "CityFurniture", "CityObjectGroup", "Default", "GenericCityObject", "LandUse", "OtherConstruction", "PlantCover", "SolitaryVegetationObject", "TINRelief",
    "WaterBody", "Waterway", "Road", "Railway", "TransportSquare",
    "Tunnel", "TunnelPart", "TunnelInstallation", "TunnelConstructiveElement", "TunnelHollowSpace", "TunnelFurniture",
)
SEMANTIC_TYPES = (
    "RoofSurface", "GroundSurface", "WallSurface", "ClosureSurface", "OuterCeilingSurface", "OuterFloorSurface", "Window", "Door", "InteriorWallSurface", "CeilingSurface", "FloorSurface",
    "WaterSurface", "WaterGroundSurface", "WaterClosureSurface", "TrafficArea", "AuxiliaryTrafficArea", "TransportationMarking", "TransportationHole",
)
IMAGE_TYPES = ("PNG", "JPG")
WRAP_MODES = ("wrap", "mirror", "clamp", "border", "none")
TEXTURE_TYPES = ("unknown", "specific", "typical")
CONTACT_TYPES = ("individual", "organization")


def known(text: Column, names: tuple[str, ...], extensions: bool = False) -> Column:
    """Whether a name is one of ``names``, or with ``extensions`` starts with a plus; null for null."""
    return text.isin(*names) | text.startswith("+") if extensions else text.isin(*names)


def parsed(text: Column, names: tuple[str, ...], what: str, extensions: bool = False) -> Column:
    """The name; null for null, an error for one that is not known."""
    return F.when(text.isNull() | known(text, names, extensions), text).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), text)))


def boundary_level(boundary: dict[str, Column]) -> Column:
    """The deepest level of an offset-form boundary that has a member."""
    out = F.when(F.size(boundary["vertex_indices"]) > 0, "point").otherwise("none")
    for level in ("line", "ring", "surface", "shell", "solid"):
        held = boundary.get(f"{level}_offsets")
        if held is not None:
            out = F.when(held.isNotNull() & (F.size(held) > 0), level).otherwise(out)
    return out


def uniform(values: Column) -> Column:
    """All values are equal and none is null; false for an empty list."""
    return (F.size(values) > 0) & F.coalesce(F.forall(values, lambda v: F.coalesce(v == values[0], F.lit(False))), F.lit(False))


def shortest_float(x: Column) -> Column:
    """A 32-bit float as the double of its shortest decimal."""
    return x.cast("float").cast("string").cast("double")
