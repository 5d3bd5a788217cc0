"""Finite-state transducers over small alphabets, and their composition."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Transducer:
    """A deterministic transducer: in a state, a symbol leads to a state and puts out a symbol. State 0 is the start."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str]]):
        self.arcs = arcs

    @classmethod
    def built(cls, start: object, alphabet: Iterable[str], step: Callable[[object, str], tuple[object, str]]) -> Transducer:
        """Explore ``step(state, symbol) -> (state, output)`` from ``start``; states are numbered as they are met."""
        alphabet = sorted(alphabet)
        numbers, waiting, arcs = {start: 0}, [start], {}
        while waiting:
            state = waiting.pop()
            for symbol in alphabet:
                to, out = step(state, symbol)
                if to not in numbers:
                    numbers[to] = len(numbers)
                    waiting.append(to)
                arcs[numbers[state], symbol] = (numbers[to], out)
        return cls(arcs)

    def inputs(self) -> set[str]:
        return {symbol for _, symbol in self.arcs}

    def outputs(self) -> set[str]:
        return {out for _, out in self.arcs.values()}

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one puts out is what ``other`` reads."""

        def step(state: tuple[int, int], symbol: str) -> tuple[tuple[int, int], str]:
            mine, middle = self.arcs[state[0], symbol]
            theirs, out = other.arcs[state[1], middle]
            return (mine, theirs), out

        return Transducer.built((0, 0), self.inputs(), step)

    def run(self, symbols: Iterable[str]) -> list[str]:
        state, out = 0, []
        for symbol in symbols:
            state, made = self.arcs[state, symbol]
            out.append(made)
        return out
