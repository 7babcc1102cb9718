"""Imports every query module so that the registry is complete."""

from facetry.plans import algebra, graphs, labelling, learning, meshes, spatial, statistics  # noqa: F401
from facetry.plans.registry import ORACLES, QUERIES  # noqa: F401
