"""The modules that register queries."""

from quillon.plans import acquisition_queries, aggregate_queries, association_queries, bank_queries, catalog_queries, chain_queries, fitting_queries, graph_queries, ingest_queries, interval_queries, kernel_queries, ordered_queries, phase_queries, product_queries, projection_queries, sky_queries, slice_queries, snapshot_queries, streaming_queries, survey_queries, track_queries  # noqa: F401
