"""Time windows, and the requests that combine operators into answers."""
