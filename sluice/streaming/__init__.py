"""Running flows: batch actions and streaming queries."""

from sluice.streaming.app import App, submit
from sluice.streaming.stateful import counting, flush_by_timer, running_sum

__all__ = ["App", "counting", "flush_by_timer", "running_sum", "submit"]
