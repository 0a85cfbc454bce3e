"""Live path: continuous ingest, provisional aggregates, latest values."""
