"""Reading monitored tables, history tables and JSON documents."""
