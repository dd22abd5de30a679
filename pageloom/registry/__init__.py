"""The registered queries, their input tables, and the SQL each one is checked against."""
