"""What a format of recordings has to offer to be read, written and annotated like the ones that are built in."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession

from ..operators.signal import Signal
from . import annotations, edf


class Reader(ABC):
    """A recording that is opened by its path. Samples are read by Spark when the signal's plan runs, so nothing has to be closed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    @abstractmethod
    def channels(self) -> list[int]:
        """Numbers of the channels that hold samples."""

    @abstractmethod
    def shape(self) -> tuple[int, int]:
        """Channels, and samples of the longest."""

    @abstractmethod
    def read(self, start: int = 0, stop: int | None = None, channels=None, padvalue: float | None = None) -> Signal:
        """Samples start .. stop of the channels (ch, idx, value)."""


class Writer(ABC):
    """A recording that is written to a path."""

    def __init__(self, path: str):
        self.path = path

    @abstractmethod
    def write(self, signal: Signal, header) -> None: ...


class Annotations(ABC):
    """Annotations of a recording."""

    def __init__(self, spark: SparkSession, path: str, **options):
        self.spark, self.path, self.options = spark, path, options

    @abstractmethod
    def read(self, labels=None) -> DataFrame:
        """(label, time, duration, channel), times in seconds from the recording's start."""


class EdfReader(Reader):
    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path)
        self.header = edf.read_header(spark, path)

    @property
    def channels(self) -> list[int]:
        return self.header.channels

    def shape(self) -> tuple[int, int]:
        return len(self.header.channels), max(self.header.samples, default=0)

    def read(self, start=0, stop=None, channels=None, padvalue=None) -> Signal:
        return edf.read(self.spark, self.path, channels, start, stop, padvalue)


class EdfWriter(Writer):
    def write(self, signal: Signal, header: edf.Header) -> None:
        edf.write(signal, header, self.path)


class TextAnnotations(Annotations):
    def read(self, labels=None) -> DataFrame:
        return annotations.read_annotations(self.spark, self.path, labels=labels, **self.options)


FORMATS: dict[str, type[Reader]] = {"edf": EdfReader}


def register(suffix: str, reader: type[Reader]) -> None:
    """Makes open_recording() use a reader for files of a suffix."""
    if not (isinstance(reader, type) and issubclass(reader, Reader)):
        raise TypeError(f"{reader!r} is no Reader")
    FORMATS[suffix.lower().lstrip(".")] = reader


def open_recording(spark: SparkSession, path: str) -> Reader:
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"no reader for files of suffix {suffix!r}; there are {sorted(FORMATS)}")
    return FORMATS[suffix](spark, path)
