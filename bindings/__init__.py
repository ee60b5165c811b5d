"""Binds the engine's operators and analyses to the driver tables, with SQL twins."""
