"""The SQL front end and the registered queries."""
