"""Search and upkeep of large catalogs of filesystem-like entries on Spark."""

from .engine import Engine
from .operators.preview import Limits, preview
from .operators.search import SearchResults, Typeahead, search
from .operators.snapshot import Snapshot
from .plans.query import Query, parse
from .sources.config import Config
from .streaming.watch import Status, Watcher

__all__ = ["Config", "Engine", "Limits", "Query", "SearchResults", "Snapshot", "Status", "Typeahead", "Watcher", "parse", "preview", "search"]
