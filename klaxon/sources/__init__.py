"""Where alarms and samples come from, and where tables are kept."""
