"""Streaming.

The reference has no streaming operators (no watermarks, windows or state), so
none are defined here. Every row-wise operator in ``wardlens.functions`` and the
projection/repair operators that take their statistics as parameters (e.g.
``clean.repair_o2(..., bound=...)``, ``clean.topn_keep(..., levels=...)``) are
stateless and apply unchanged to a DataFrame from ``spark.readStream``.
"""
