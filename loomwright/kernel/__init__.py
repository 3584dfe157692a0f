"""Pure functions on one JSON text each; no Spark here."""
