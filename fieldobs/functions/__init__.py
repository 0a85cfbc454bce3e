"""Column expressions: rounding, station clocks, wind, text and geography."""
