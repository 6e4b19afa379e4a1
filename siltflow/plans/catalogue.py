"""Imports every module that registers queries."""

from siltflow.plans import files, frames, learning, mining, relational, reviews, scalars, streams, udfs  # noqa: F401
