"""Population waveform-shape analytics as Spark DataFrame operators."""
