"""Reports: functions of tables, a window and an instant, returning DataFrames."""
