"""Tables on shared storage: scans, and the stores that are written back."""
