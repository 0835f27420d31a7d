"""Readers and writers: the partitioned event export, lookup tables, saved
report tables, and the test fixture that builds an export from flat events."""

from clickfold.sources.events import (
    date_key,
    in_window,
    read_events,
    read_table,
    write_table,
)
from clickfold.sources.lookups import read_buyers, read_campaigns

__all__ = [
    "date_key", "in_window", "read_events", "read_table", "write_table",
    "read_buyers", "read_campaigns",
]
