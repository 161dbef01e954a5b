"""Queries over fleet telemetry; importing the package registers them."""

from . import registry  # noqa: F401
from . import extras, features, files, grouped, joined, models, ordered, pipelines, rows, spatial, stacked, stops  # noqa: F401
