"""Parameters of the readers."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from rivulet.errors import NotSupportedError


class LastExampleHandling(Enum):
    NONE = "none"
    DROP = "drop"
    DROP_WARN = "drop_warn"
    PAD = "pad"
    PAD_WARN = "pad_warn"


class BadExampleHandling(Enum):
    ERROR = "error"
    SKIP = "skip"
    SKIP_WARN = "skip_warn"
    PAD = "pad"
    PAD_WARN = "pad_warn"


class MaxFieldLengthHandling(Enum):
    TREAT_AS_BAD = "treat_as_bad"
    TRUNCATE = "truncate"
    TRUNCATE_WARN = "truncate_warn"


@dataclass(frozen=True)
class ReaderParams:
    """Row operators of a reader, in their fixed order: skip and limit, shard, sample, shuffle, batch."""

    batch_size: int = 1
    num_instances_to_skip: int = 0
    num_instances_to_read: int | None = None
    num_shards: int = 0
    shard_index: int = 0
    sample_ratio: float | None = None
    shuffle_instances: bool = False
    shuffle_window: int = 0
    shuffle_seed: int | None = None
    reshuffle_each_epoch: bool = True
    last_example_handling: LastExampleHandling = LastExampleHandling.NONE
    bad_example_handling: BadExampleHandling = BadExampleHandling.ERROR
    warn_bad_instances: bool = False
    #: Taken and left to Spark: how many batches are made ahead and at a time.
    num_prefetched_examples: int = 0
    num_parallel_reads: int = 0

    def __post_init__(self):
        if self.batch_size < 1:
            raise ValueError("batch_size must be at least 1")
        if self.num_shards > 1 and not 0 <= self.shard_index < self.num_shards:
            raise ValueError("shard_index must be below num_shards")
        if self.sample_ratio is not None and not 0 < self.sample_ratio < 1:
            raise ValueError("sample_ratio must lie between 0 and 1")


@dataclass(frozen=True)
class CsvParams:
    column_names: tuple[str, ...] = ()
    name_prefix: str = ""
    use_columns: frozenset[str] = frozenset()
    use_columns_by_index: frozenset[int] = frozenset()
    default_data_type: str | None = None
    column_types: dict[str, str] = field(default_factory=dict)
    column_types_by_index: dict[int, str] = field(default_factory=dict)
    header_row_index: int | None = 0
    has_single_header: bool = False
    dedupe_column_names: bool = True
    delimiter: str = ","
    quote_char: str = '"'
    comment_char: str | None = None
    skip_blank_lines: bool = True
    allow_quoted_new_lines: bool = False
    encoding: str | None = None
    compression: str | None = None
    max_field_length: int | None = None
    max_field_length_handling: MaxFieldLengthHandling = MaxFieldLengthHandling.TREAT_AS_BAD
    max_line_length: int | None = None
    nan_values: frozenset[str] = frozenset()
    number_base: int = 10

    def __post_init__(self):
        if self.number_base != 10:
            raise NotSupportedError("numbers are read to base 10 only")
