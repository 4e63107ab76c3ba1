"""Named queries over the driver tables, each with an SQL counterpart."""
