"""Table jobs (silver, gold), report queries, SQL queries and the query registry."""
