"""labelloom: large-scale multi-label analytics as PySpark DataFrame dataflows."""
