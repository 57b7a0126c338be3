"""Errors of the readers, one tree under ReaderLibraryError."""

import re


class ReaderLibraryError(RuntimeError):
    pass


class StreamError(ReaderLibraryError):
    pass


class InflateError(StreamError):
    pass


class RecordError(ReaderLibraryError):
    pass


class CorruptRecordError(RecordError):
    pass


class CorruptHeaderError(CorruptRecordError):
    pass


class CorruptFooterError(CorruptRecordError):
    pass


class RecordTooLargeError(RecordError):
    pass


class DataReaderError(ReaderLibraryError):
    pass


class SchemaError(DataReaderError):
    pass


class InvalidInstanceError(DataReaderError):
    pass


class NotSupportedError(ReaderLibraryError):
    pass


def _kinds(kind: type) -> dict[str, type]:
    return {kind.__name__: kind} | {k: v for s in kind.__subclasses__() for k, v in _kinds(s).items()}


def translated(error: BaseException) -> ReaderLibraryError | None:
    """The error of this library that a task raised, told by its name in what Spark says; None where it is another.
    Raise it from the Spark error, which stays its cause."""
    kinds = _kinds(ReaderLibraryError)
    found = re.findall(rf"^(?:.*[.\] ])?({'|'.join(kinds)}): (.*)$", str(error), re.MULTILINE)
    if not found:
        return None
    name, message = found[-1] if len(found) > 1 and "Traceback" in str(error) else found[0]
    return kinds[name](re.sub(r" SQLSTATE: \w+$", "", message.strip()))
