"""Combinators for state machines: a process maps (state, input) to (state, outputs)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

Step = Callable[[Any, Any], tuple[Any, list]]


class Process:
    """A composable step."""

    def __init__(self, step: Step):
        self._step = step

    def __call__(self, state: Any, value: Any) -> tuple[Any, list]:
        new, outputs = self._step(state, value)
        return new, list(outputs)

    def map(self, f: Callable[[Any], Any]) -> Process:
        """The same states; every output goes through ``f``."""

        def step(state, value):
            state, outputs = self(state, value)
            return state, [f(x) for x in outputs]

        return Process(step)

    def flat_map(self, f: Callable[[Any], Process]) -> Process:
        """Each output chooses a process, which runs on the original input; only its outputs are emitted."""

        def step(state, value):
            state, firsts = self(state, value)
            emitted: list = []
            for first in firsts:
                state, more = f(first)(state, value)
                emitted += more
            return state, emitted

        return Process(step)

    def and_then(self, other: Process) -> Process:
        """Both on the same input, one after the other; outputs are put together."""

        def step(state, value):
            state, mine = self(state, value)
            state, theirs = other(state, value)
            return state, mine + theirs

        return Process(step)

    def chain(self, other: Process) -> Process:
        """Outputs become the other's inputs; one state serves both."""

        def step(state, value):
            state, mine = self(state, value)
            emitted: list = []
            for x in mine:
                state, more = other(state, x)
                emitted += more
            return state, emitted

        return Process(step)

    @staticmethod
    def skip() -> Process:
        """No output, no change."""
        return Process(lambda state, _: (state, []))

    @staticmethod
    def output(*values: Any) -> Process:
        """These outputs whatever the input."""
        return Process(lambda state, _: (state, list(values)))

    @staticmethod
    def output_each(values: Iterable[Any]) -> Process:
        """All of a sequence as outputs."""
        fixed = list(values)
        return Process(lambda state, _: (state, fixed))

    @staticmethod
    def on(choose: Callable[[Any, Any], Process]) -> Process:
        """The process that state and input choose."""
        return Process(lambda state, value: choose(state, value)(state, value))

    @staticmethod
    def on_input(choose: Callable[[Any], Process]) -> Process:
        """The process that the input chooses."""
        return Process.on(lambda _, value: choose(value))

    @staticmethod
    def on_state(choose: Callable[[Any], Process]) -> Process:
        """The process that the state chooses."""
        return Process.on(lambda state, _: choose(state))

    @staticmethod
    def set_state(state: Any) -> Process:
        """Another state, no output."""
        return Process(lambda _, __: (state, []))

    @staticmethod
    def from_aggregator(append: Callable[[Any, Any], Any], present: Callable[[Any], Any]) -> Process:
        """Take the input into the state and emit what it amounts to."""

        def step(state, value):
            state = append(state, value)
            return state, [present(state)]

        return Process(step)
