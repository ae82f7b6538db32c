"""Sources and sinks: table sets, text/flat-file ingest, writers, fixtures."""
