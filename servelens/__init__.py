"""servelens - telemetry analytics for model-serving systems, written as Spark jobs.

Every operator is a plain function from DataFrame to DataFrame (or Column to
Column).  Nothing here starts a session, collects data or keeps state between
calls; Catalyst sees one declarative plan per query.
"""
