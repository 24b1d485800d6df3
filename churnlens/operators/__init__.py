"""Analytical operators: functions from DataFrames (plus column names) to DataFrames."""
