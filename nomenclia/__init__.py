"""nomenclia: resolves free-text product descriptions against a catalogue, on Spark."""
