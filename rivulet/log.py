"""The library's log: off, warnings (default), information or details, to a handler of choice."""

from __future__ import annotations

import logging
from collections.abc import Callable
from enum import Enum

logger = logging.getLogger("rivulet")
logger.setLevel(logging.WARNING)


class LogLevel(Enum):
    OFF = logging.CRITICAL + 10
    WARNING = logging.WARNING
    INFO = logging.INFO
    DEBUG = logging.DEBUG


class _Calls(logging.Handler):
    def __init__(self, call: Callable[[LogLevel, str], None]):
        super().__init__()
        self.call = call

    def emit(self, record: logging.LogRecord) -> None:
        self.call(next((x for x in LogLevel if x.value == record.levelno), LogLevel.WARNING), record.getMessage())


def set_log_level(level: LogLevel) -> None:
    logger.setLevel(level.value)


def get_log_level() -> LogLevel:
    return next((x for x in LogLevel if x.value == logger.level), LogLevel.WARNING)


def set_log_handler(call: Callable[[LogLevel, str], None] | None) -> None:
    """call(level, message) for each message in place of Python's handlers; None goes back to these."""
    for own in [h for h in logger.handlers if isinstance(h, _Calls)]:
        logger.removeHandler(own)
    logger.propagate = call is None
    if call is not None:
        logger.addHandler(_Calls(call))
