"""Streaming.

The reference has no stream, watermark, window or stateful operator: its
programs read static tables and recompute. Nothing is built here on purpose
(see README, "Not built"). Every operator in :mod:`lapse.operators` is a
DataFrame → DataFrame function, so it can already be applied per micro-batch
inside a ``foreachBatch`` sink by a caller who streams new order files.
"""
