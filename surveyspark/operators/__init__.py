"""DataFrame operators: recode, filters, joins, weighted statistics, reshaping."""
