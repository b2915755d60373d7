"""Table readers, sinks and the shared scratch folder."""

from quern.sources.tables import table
from quern.sources.shared import discard, shared_dir, write_and_read

__all__ = ["discard", "shared_dir", "table", "write_and_read"]
