"""DataFrame-to-DataFrame operators on canonical event logs."""
