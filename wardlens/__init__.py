"""wardlens: admission-cohort analytics as Spark DataFrame operators.

Layout:
  functions/  Column -> Column building blocks (text, codes, bands, repairs, arrays)
  operators/  DataFrame -> DataFrame operators (projection, look-up, profiling,
              windows, derivations, cleaning, features, splits, metrics, models, text)
  sources/    readers and writers (explicit schemas, unions, round trips)
  plans/      fixture views, column presets and composed preparation flows
  streaming/  notes on running the stateless operators on streams
"""

from wardlens.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
