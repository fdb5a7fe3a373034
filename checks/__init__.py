"""Landing tables, source exports and score sheets derived from the test tables, the queries
registered over them, and the SQL each is checked against."""
