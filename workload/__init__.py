"""The registered queries over the driver's test tables, and SQL to check them against."""
