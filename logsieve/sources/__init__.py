"""Where event logs, score tables and reports are read from and written to."""
