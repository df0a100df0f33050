"""Normative-deviation analytics on Spark: operators over any table of entities, ordered segments, channels and states."""
