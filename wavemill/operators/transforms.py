"""Views of a signal as amplitudes and phases, with the parameters of the transform kept."""

from __future__ import annotations

from abc import ABC, abstractmethod

from .filters import amplitude, analytic, phase
from .signal import BLOCK, Signal


class Transform(ABC):
    """A complex view of a signal. Nothing is computed before a plan of its parts runs."""

    def __init__(self, data: Signal, block: int = BLOCK, **settings):
        self.data, self.block, self.settings = data, block, settings

    @property
    @abstractmethod
    def signal(self) -> Signal:
        """The complex signal: columns re and im."""

    def amplitudes(self) -> Signal:
        return amplitude(self.signal)

    def phases(self) -> Signal:
        """In [0, 2 pi)."""
        return phase(self.signal)

    def __repr__(self) -> str:
        settings = "".join(f", {k}={v!r}" for k, v in self.settings.items())
        return f"{type(self).__name__}({', '.join(self.data.keys)} at {self.data.fs:g} samples a second{settings})"


class Analytic(Transform):
    """By a Hilbert filter; settings: width of its transitions in Hz, gpass, gstop."""

    def __init__(self, data: Signal, width: float = 2.0, block: int = BLOCK, **settings):
        super().__init__(data, block, width=width, **settings)

    @property
    def signal(self) -> Signal:
        return analytic(self.data, block=self.block, **self.settings)
