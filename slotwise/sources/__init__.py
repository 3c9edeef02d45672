"""Sources and sinks: declared schema, table bundle, fixture views over the test data."""
