"""Sources and sinks: dataset catalogue (S4), readers and writers (S1-S3, S5-S9), and the
adapters that derive the reference's inputs from the driver tables."""
