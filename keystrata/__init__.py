"""Versioned key-value analytics on Spark: changelogs, merge-on-read views, segments and compaction."""
