"""Named queries; importing the folder registers them all."""

from . import catalogue, lifecycle, retrieval, rules  # noqa: F401
