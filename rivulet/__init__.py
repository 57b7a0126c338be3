"""Ordered dataset reading, position-based row operators and column analysis on Spark DataFrames."""

from rivulet.errors import (
    CorruptFooterError, CorruptHeaderError, CorruptRecordError, DataReaderError, InflateError, InvalidInstanceError, NotSupportedError,
    ReaderLibraryError, RecordError, RecordTooLargeError, SchemaError, StreamError,
)
from rivulet.log import LogLevel, get_log_level, set_log_handler, set_log_level
from rivulet.operators.insights import ColumnAnalysis, DataAnalysis, analyze, analyze_dataset
from rivulet.params import BadExampleHandling, CsvParams, LastExampleHandling, MaxFieldLengthHandling, ReaderParams
from rivulet.readers import CsvReader, DataReader, ImageReader, PipeReader, TensorRecordReader, TextLineReader
from rivulet.schema import Attribute, Schema
from rivulet.sources.images import ImageParams
from rivulet.sources.pipes import PipeStore
from rivulet.sources.stores import DataStore, File, InMemoryStore, InputStream, list_files, list_objects
from rivulet.streaming.examples import Example, Examples, Records
from rivulet.streaming.pipe_stream import stream_batches, stream_csv, stream_messages, stream_pipe
from rivulet.streaming.tensors import CooTensor, DenseTensor

__all__ = [
    "Attribute", "BadExampleHandling", "ColumnAnalysis", "CooTensor", "CorruptFooterError", "CorruptHeaderError", "CorruptRecordError", "CsvParams",
    "CsvReader", "DataAnalysis", "DataReader", "DataReaderError", "DataStore", "DenseTensor", "Example", "Examples", "File", "ImageParams",
    "ImageReader", "InMemoryStore", "InflateError", "InputStream", "InvalidInstanceError", "LastExampleHandling", "LogLevel", "MaxFieldLengthHandling",
    "NotSupportedError", "PipeReader", "PipeStore", "ReaderLibraryError", "ReaderParams", "RecordError", "RecordTooLargeError", "Records", "Schema", "SchemaError",
    "StreamError", "TensorRecordReader", "TextLineReader", "analyze", "analyze_dataset", "get_log_level", "list_files", "list_objects",
    "set_log_handler", "set_log_level", "stream_batches", "stream_csv", "stream_messages", "stream_pipe",
]
