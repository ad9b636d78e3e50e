"""Sources and sinks: file scans, tables, snapshots, stores."""
