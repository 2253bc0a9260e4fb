"""Sources and sinks: corpus files, result CSVs, decision logs, profiles."""
