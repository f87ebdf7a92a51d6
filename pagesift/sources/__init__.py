"""Sources and sinks: snapshot tables, rendered test pages, exports, ledger."""
