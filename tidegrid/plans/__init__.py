"""Named queries over a folder of tables, and the SQL that must give the same rows."""
