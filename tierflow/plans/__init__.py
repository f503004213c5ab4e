"""Named queries over the tables and the SQL that checks them."""
