"""The queries offered for checking, and the SQL that states their expected results."""
