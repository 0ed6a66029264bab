"""Adapters of the driver tables, registered queries with their SQL twins, and the stage pipeline."""
