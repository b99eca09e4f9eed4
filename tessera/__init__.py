"""A relational analytics engine written for Spark: dialect, operators, SQL front-end, snapshot tables."""
