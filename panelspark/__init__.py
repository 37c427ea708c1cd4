"""Factor analytics on keyed panels: functions from DataFrames to a DataFrame."""
