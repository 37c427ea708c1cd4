"""DataFrame operators: reshaping, cleaning, calendars, joins, aggregation, scores."""
