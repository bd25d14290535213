"""DataFrame operators: judging, aggregation, parsing, conversion and statistics."""
