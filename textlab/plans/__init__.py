"""Compositions of operators into the reference's end-to-end jobs, and the
registered queries that bind them to the driver's tables."""
