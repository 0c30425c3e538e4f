"""Spark-native hybrid document search and analytics."""

from shiori.config import Config
from shiori.operators.blockmax import BlockIndex
from shiori.operators.embedding import HashedEmbedder, StaticEmbedder
from shiori.operators.ingest import Outcome, drop_files, list_docs, reindex, search_store, status, update_files
from shiori.operators.pivots import Pivots
from shiori.operators.search import hybrid
from shiori.sources.store import Conflict, Store
from shiori.streaming.watch import watch

__all__ = ["BlockIndex", "Config", "Conflict", "HashedEmbedder", "Outcome", "Pivots", "StaticEmbedder", "Store", "drop_files", "hybrid", "list_docs", "reindex", "search_store", "status", "update_files", "watch"]
__version__ = "0.2.0"
