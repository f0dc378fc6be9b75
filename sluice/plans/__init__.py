"""Flows: graphs of processors, evaluated as DataFrames."""

from sluice.plans.flow import Flow, Processor, diff, from_json, replace_processor, sink
from sluice.plans.graph import Graph

__all__ = ["Flow", "Graph", "Processor", "diff", "from_json", "replace_processor", "sink"]
