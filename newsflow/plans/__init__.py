"""The jobs: collector, CSV load, news page and image backfill."""
