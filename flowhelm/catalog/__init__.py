"""Registered queries; importing the section modules fills the registry."""

from flowhelm.catalog import (  # noqa: F401
    activity, detection, flagship, flows, graphs, gsamples, learning, prepare, samples, scoring, storage, streams,
)
